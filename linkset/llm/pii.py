"""Personal data by fixed forms, and by contexts learnt from what they find.

The base forms (email, ip, card, phone) give spans and, at the same time, the
seed entities of a bootstrap over the whole corpus:

* every base span and every other identifier-like token (it holds a digit or
  an at sign) is an *instance* with up to three lexical *patterns*: the two
  words before it, the words around it, the two words after it;
* patterns and distinct instances form a graph. Per kind, seeds have score 1;
  a pattern scores the mean over its instances if at least MIN_SUPPORT of them
  are believed, an instance combines the patterns that score TRUST or more
  (noisy or). Scores are passed back and forth, and what is believed after one
  round supports new patterns in the next. Scores only grow; the rounds end
  when one lifts no instance over a multiple of STEP. A mean is over all its
  instances: a pattern that as many unknown as believed instances share, and
  whose unknown ones have no better pattern, is never trusted;
* tokens in a pattern that scores CERTAIN, and that score CERTAIN themselves,
  are new spans of that kind.

Only DataFrame functions are used. Positions come from cutting a text at the
matches: the pieces between matches and the matches tile the text, so running
sums of their lengths are the offsets. What is shuffled are instances, never
texts; both joins of a round spread hot patterns and hot instances.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkset.llm.common import attach, bind, table, text_of, words
from linkset.plans.workspace import Workspace

KINDS = ("email", "ip", "card", "phone")
#: The contract's forms. Repeats are possessive, and a match starts where a run
#: of its first characters starts or where the last match ended: the same
#: matches, in time linear in the text.
FORMS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TOKEN = (r"(?:(?<=[\x20\x09-\x0D])|\G)[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
#: Characters of context looked at first on either side, and then, if the two
#: words are not whole in them; after these the whole text.
CONTEXT = (120, 1920, 30720)
LONG = 120           # a longer word stands in a pattern by its digest
MIN_SUPPORT = 3
TRUST = 0.5
CERTAIN = 0.9
STEP = 0.05          # TRUST and CERTAIN are multiples of it
SPAN = "array<struct<start:int,k:int,end:int,value:string>>"


def _tiles(text: Column, form: str, found: Column, k: int) -> Column:
    """Matches ``found`` of ``form`` as (start, kind number, end, value)."""
    def place(gaps: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(gaps, i))
            end = start + F.length(F.get(found, i))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(
                start.alias("start"), F.lit(k).alias("k"), end.alias("end"),
                F.get(found, i).alias("value")))).alias("out"))
        first = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), first, add, lambda a: a["out"])
    return F.when(F.size(found) == 0, F.array().cast(SPAN)).otherwise(
        bind(F.split(text, form, -1), place))


def _matches(text: Column, form: str, k: int) -> Column:
    return bind(F.regexp_extract_all(text, F.lit(form), F.lit(0)),
                lambda found: _tiles(text, form, found, k))


def _luhn(digits: Column) -> Column:
    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        d = F.when(i % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)
        return acc + d
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]+", "")
    if kind == "ip":
        small = lambda p: F.regexp_replace(p, "^0+", "").rlike(
            "^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")
        return F.forall(F.split(value, r"\."), small)
    if kind == "card":
        return F.length(digits).between(14, 19) & F.when(
            F.length(digits).between(14, 19), bind(digits, _luhn)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start and then kind; offsets in code points,
    end exclusive. A match that fails its kind's test is dropped, not retried."""
    def of(k: int, kind: str) -> Column:
        return F.filter(_matches(text, FORMS[kind], k), lambda s: _valid(kind, s["value"]))
    return F.sort_array(F.concat(*[of(k, kind) for k, kind in enumerate(KINDS)]))


def _other_tokens(text: Column, base: Column) -> Column:
    """Identifier-like tokens off the base spans, without outer punctuation."""
    def trim(s: Column) -> Column:
        lead = F.length(F.regexp_extract(s["value"], r"^[^\p{L}0-9@+]*+", 0))
        core = F.regexp_replace(s["value"], r"^[^\p{L}0-9@+]++|[^\p{L}0-9]++$", "")
        start = s["start"] + lead
        return F.struct(start.alias("start"), F.lit(-1).alias("k"),
                        (start + F.length(core)).alias("end"), core.alias("value"))
    found = F.transform(_matches(text, TOKEN, -1), trim)
    free = lambda s: (s["end"] > s["start"]) & ~F.exists(
        base, lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"]))
    return F.filter(found, free)


def _beside(text: Column, s: Column, before: bool, sizes: tuple[int, ...] = CONTEXT) -> Column:
    """Words of the text before or after a span, the next two of them whole."""
    def part(size: Column) -> Column:
        if not before:
            return F.substring(text, s["end"] + 1, size)
        a = F.greatest(s["start"] - size, F.lit(0))
        return F.substring(text, a + 1, s["start"] - a)
    if not sizes:
        return words(F.lower(part(s["start"] if before else F.lit(2 ** 31 - 1))))

    def enough(x: Column) -> Column:      # the outermost word may be cut, the text ends in a shorter part
        return F.when((F.size(x["w"]) > 2) | (F.length(x["part"]) < sizes[0]), x["w"]).otherwise(
            _beside(text, s, before, sizes[1:]))
    return bind(part(F.lit(sizes[0])), lambda p: bind(
        F.struct(p.alias("part"), words(F.lower(p)).alias("w")), enough))


def _patterns(text: Column, s: Column) -> Column:
    """The lexical patterns of a span, as strings."""
    def of(lr: Column) -> Column:
        word = lambda w, i: bind(F.get(w, i), lambda x: F.when(
            F.length(x) > LONG, F.concat(F.lit(" "), F.sha2(x, 256))).otherwise(x))
        lw, rw = lr["l"], lr["r"]
        near = F.struct(word(lw, F.size(lw) - 1).alias("l1"), word(lw, F.size(lw) - 2).alias("l2"),
                        word(rw, F.lit(0)).alias("r1"), word(rw, F.lit(1)).alias("r2"))
        return bind(near, lambda w: F.array_compact(F.array(
            F.concat(w["l2"], F.lit(" "), w["l1"], F.lit(" _")),
            F.concat(w["l1"], F.lit(" _ "), w["r1"]),
            F.concat(F.lit("_ "), w["r1"], F.lit(" "), w["r2"]))))
    return bind(F.struct(_beside(text, s, True).alias("l"), _beside(text, s, False).alias("r")), of)


def with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` plus ``_h`` (hash of the text) and ``_base``, its base spans."""
    t = text_of("text")
    return docs.withColumns({"_h": F.xxhash64(t), "_base": base_spans(t)})


def occurrences(docs: DataFrame, workspace: Workspace) -> DataFrame:
    """One row per instance and place: ``doc_id _h start end value k patterns``."""
    d = with_spans(docs.select("doc_id", "text"))
    d = d.withColumn("_t", text_of("text"))
    both = F.concat(F.col("_base"), _other_tokens(F.col("_t"), F.col("_base")))
    rows = d.withColumn("_all", F.when(F.col("_t").rlike("[0-9@]"), both))
    rows = rows.select("doc_id", "_h", F.explode(F.transform("_all", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["k"].alias("k"),
        F.lower(s["value"]).alias("value"), _patterns(F.col("_t"), s).alias("patterns")))).alias("s"))
    return workspace.save(rows.select("doc_id", "_h", "s.*"), "occurrences")


def score(found: DataFrame, workspace: Workspace) -> tuple[DataFrame, DataFrame]:
    """Pattern and instance scores: ``pattern n c0..c3`` and ``value n s0..s3``."""
    ks = range(len(KINDS))
    edges = workspace.save(
        found.select("value", "k", F.explode("patterns").alias("pattern"))
        .groupBy("pattern", "value").agg(F.max("k").alias("k")), "edges")
    # a pattern of fewer instances never has enough that are believed, in any round
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    sizes = workspace.save(sizes.where(F.col("n") >= MIN_SUPPORT).withColumn("kept", F.lit(True)), "sizes")
    edges = workspace.save(attach(edges, sizes, ["pattern"], "n", ["value"])
                           .where("kept").drop("kept"), "kept-edges")
    seed = [F.max((F.col("k") == k).cast("double")).alias(f"s{k}") for k in ks]
    inst = workspace.save(edges.groupBy("value").agg(
        F.count(F.lit(1)).alias("n"), F.max("k").alias("k"), *seed), "instances-0")
    reached = F.sum(F.when(F.col("k") < 0, sum(F.floor(F.col(f"s{k}") / STEP + 1e-9) for k in ks)).otherwise(0))
    height, r = 0, 0
    while True:
        r += 1
        e = attach(edges.drop("k"), inst, ["value"], "n", ["pattern"])
        mean = [F.when(F.count(F.when(F.col(f"s{k}") >= TRUST, 1)) >= MIN_SUPPORT,
                       F.avg(f"s{k}")).otherwise(0.0).alias(f"c{k}") for k in ks]
        pats = workspace.save(e.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), *mean),
                              f"patterns-{r}")
        e = attach(edges, pats, ["pattern"], "n", ["value"])
        miss = [F.sum(F.when(F.col(f"c{k}") >= TRUST, F.log(F.lit(1.0001) - F.col(f"c{k}")))
                      .otherwise(0.0)).alias(f"m{k}") for k in ks]
        inst = e.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("k"), *miss)
        now = [F.when(F.col("k") >= 0, (F.col("k") == k).cast("double"))
               .otherwise(1 - F.exp(F.col(f"m{k}"))).alias(f"s{k}") for k in ks]
        inst = workspace.save(inst.select("value", "n", "k", *now), f"instances-{r}", {"reached": reached})
        if (inst.metrics["reached"] or 0) <= height:
            return pats, inst.drop("k")
        height = inst.metrics["reached"]


def discoveries(found: DataFrame, workspace: Workspace) -> DataFrame:
    """New spans, one row per document: ``doc_id _h _new`` (array of spans)."""
    pats, inst = score(found, workspace)
    sure = lambda name: F.array(*[F.col(f"{name}{k}") >= CERTAIN for k in range(len(KINDS))])
    good = workspace.save(pats.select("pattern", sure("c").alias("ok"))
                          .where(F.exists("ok", lambda x: x)), "good-patterns")
    open_ = (found.where("k = -1").select("doc_id", "_h", "start", "end", "value",
                                          F.explode("patterns").alias("pattern")))
    counts = open_.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    good = workspace.save(good.join(counts, "pattern"), "good-patterns-n")
    hits = attach(open_, good, ["pattern"], "n", ["value", "start"]).where("ok is not null")
    named = inst.select("value", sure("s").alias("sure")).where(F.exists("sure", lambda x: x))
    counts = open_.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    named = workspace.save(named.join(counts, "value"), "good-instances")
    hits = attach(hits, named, ["value"], "n", ["doc_id", "start"]).where("sure is not null")
    k = F.array_position(F.zip_with("ok", "sure", lambda a, b: a & b), True) - 1
    hits = hits.withColumn("k", k.cast("int")).where("k >= 0")
    return workspace.save(hits.groupBy("doc_id", "_h").agg(F.sort_array(F.collect_set(
        F.struct("start", "k", "end", "value"))).alias("_new")), "discoveries")


def all_spans(docs: DataFrame, workspace: Workspace) -> DataFrame:
    """``docs`` plus ``_base`` and ``_spans``: base spans, and these with new ones.

    New spans come back to the rows by id and hash of the text (ids may be null
    or repeat); a document has one row of new spans however often it repeats.
    """
    new = discoveries(occurrences(docs, workspace), workspace)
    d = with_spans(docs)
    if new.isEmpty():
        return d.withColumn("_spans", F.col("_base")).drop("_h")
    new = new.select(F.xxhash64("doc_id", "_h").alias("_nk"), F.col("_h").alias("_nh"), "_new")
    j = d.withColumn("_k", F.xxhash64("doc_id", "_h")).join(
        new, F.expr("_k = _nk and _h = _nh"), "left")
    both = F.sort_array(F.concat("_base", F.coalesce("_new", F.array().cast(SPAN))))
    return j.withColumn("_spans", both).drop("_h", "_k", "_nk", "_nh", "_new")


def _written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["k"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, workspace: Workspace) -> DataFrame:
    """``doc_id n_email n_ip n_card n_phone base_sha256 spans`` for every row.

    Counts and digest are those of the base spans, ``spans`` also has what the
    bootstrap found. A null text is empty, repeated rows give repeated rows,
    texts may be of any length, an empty table gives no rows.
    """
    d = all_spans(docs.select("doc_id", "text"), workspace)
    count = lambda k: F.size(F.filter("_base", lambda s: s["k"] == k)).cast("long")
    return d.select("doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
                    F.sha2(_written(F.col("_base")), 256).alias("base_sha256"),
                    _written(F.col("_spans")).alias("spans"))


def _masked(text: Column, spans: Column) -> Column:
    """The text with every span (overlapping ones together) replaced by [KIND]."""
    mark = lambda k: F.concat(F.lit("["), F.element_at(
        F.array(*[F.lit(x.upper()) for x in KINDS]), k + 1), F.lit("]"))

    def join(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        piece = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), mark(s["k"]))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(new, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    end = lambda a: F.concat(F.array_join(a["out"], ""),
                             F.substring(text, a["at"] + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, first, join, end))


def masked(docs: DataFrame, workspace: Workspace) -> DataFrame:
    """``docs`` with personal data masked and ``n_chars`` set to the new length.
    A null text stays null."""
    d = all_spans(docs, workspace).withColumn("_masked", _masked(text_of("text"), F.col("_spans")))
    new = {"text": F.when(F.col("text").isNull(), F.col("text")).otherwise(F.col("_masked"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("_masked").cast("long")
    return d.withColumns(new).select(*docs.columns)


def op2_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents. Nulls, empty texts, repeated rows and empty
    tables as in :func:`find_pii`."""
    return find_pii(table(spark, sf_dir, "documents"), Workspace(spark, label="op2"))

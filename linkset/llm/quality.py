"""Quality rules with thresholds learnt from the corpus.

Every document gets a few integer measures. Per language and source, each
measure is summarised by a quantile sketch: a histogram over buckets that are
exact up to 32 and then 1/32 of an octave wide. Such sketches merge by adding
counts, so the sketch of a language, or of the corpus, is the sum of its
sources' sketches. A group's threshold for a measure is the fence
``q75 + FENCE * max(q75 - q25, SLACK)``; a group of fewer than ``min_docs``
documents takes the fence of its language, or of the corpus. Thresholds are
joined back to the measures, and a document above any of them goes.

Only DataFrame functions are used. Shuffled are sketch buckets (map-side
added) and the narrow measures, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from linkset.llm.common import NOT_SPACE, SPACE, attach, bind, table, text_of, words
from linkset.plans.workspace import Workspace

WINDOW = 5
MIN_DOCS = 100
FENCE = 4
SUB = 32                       # sketch buckets per octave
#: Measure -> the least spread that a fence assumes, in the measure's unit.
SLACK = {"symbols": 25, "repeats": 60, "dup_lines": 150, "stutter": 25, "upper": 40, "word_len": 10}


def _repeat_words(w: Column) -> Column:
    """Words inside WINDOW-word windows that the text holds twice or more."""
    span = F.lit(WINDOW)

    def covered(pos: Column) -> Column:
        step = F.transform(pos, lambda p, k: F.least(
            span, F.coalesce(F.get(pos, k + 1) - p, span)))
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, b: a + b)

    def repeated(s: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        hit = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
        return bind(F.sort_array(F.transform(hit, lambda x: x["i"])), covered)

    def of_windows(win: Column) -> Column:
        return F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0).cast("long")).otherwise(
            bind(F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
                 repeated))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW),
                           lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WINDOW)]))

    return F.when(F.size(w) < WINDOW + 1, F.lit(0).cast("long")).otherwise(
        bind(F.transform(w, lambda x: F.xxhash64(x)), lambda h: bind(windows(h), of_windows)))


def _stutters(w: Column) -> Column:
    """Words equal to the word before them."""
    return bind(w, lambda a: F.size(F.filter(
        a, lambda x, i: F.coalesce(F.get(a, i - 1) == x, F.lit(False))))).cast("long")


def _chars(text: Column, other: str) -> Column:
    """Code points left when runs of ``other`` are taken out."""
    return F.length(F.regexp_replace(text, other, "")).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns ``n_words word_chars n_symbols n_dup_lines
    n_repeat_words base_failed`` and ``m``, a struct of the integer measures.

    A null text counts as empty. Windows are compared by a 64-bit hash of
    their words within one text.
    """
    t = text_of(text)
    d = docs.withColumns({"_t": t, "_w": words(t),
                          "_l": F.filter(F.split(t, "\n", -1), lambda x: x.rlike(NOT_SPACE))})
    d = d.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": _chars(F.col("_t"), SPACE),
        "n_symbols": _chars(F.col("_t"), r"[^#*$%&|<>]+"),
        "n_lines": F.size("_l").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_repeat_words": _repeat_words(F.col("_w")),
        "n_stutter": _stutters(F.col("_w")),
        "n_upper": _chars(F.col("_t"), r"[^\p{Lu}]+"),
    })
    per = lambda part, whole, unit=1000: F.expr(f"({part} * {unit}L) div greatest({whole}, 1L)")
    m = F.struct(per("n_symbols", "n_words").alias("symbols"),
                 per("n_repeat_words", "n_words").alias("repeats"),
                 per("n_dup_lines", "n_lines").alias("dup_lines"),
                 per("n_stutter", "n_words").alias("stutter"),
                 per("n_upper", "word_chars").alias("upper"),
                 per("word_chars", "n_words", 10).alias("word_len"))
    return (d.withColumn("base_failed", (F.col("n_words") < 10)
                         | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20))
            .withColumn("m", m).drop("_t", "_w", "_l", "n_lines", "n_upper", "n_stutter"))


def bucket_of(v: Column) -> Column:
    """Sketch bucket of an integer >= 0: itself below 2 * SUB, else log-linear."""
    shift = F.length(F.bin(v)) - 6
    return F.when(v < 2 * SUB, v).otherwise(
        (shift * SUB + F.call_function("shiftright", v, shift)).cast("long"))


def edge_of(b: Column) -> Column:
    """The largest value of a bucket."""
    shift = F.expr(f"cast(({{b}} - {SUB}) div {SUB} as int)".replace("{b}", "bucket"))
    return F.when(b < 2 * SUB, b).otherwise(
        F.call_function("shiftleft", b - shift * SUB + 1, shift) - 1)


def sketches(measured: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group, measure and sketch bucket with its count ``n``."""
    names = list(SLACK)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"),
                                        bucket_of(F.col(f"m.{k}")).alias("bucket"))
                               for k in names]))
    return (measured.select(*keys, each.alias("e")).select(*keys, "e.*")
            .groupBy(*keys, "measure", "bucket").agg(F.count(F.lit(1)).alias("n")))


def merge(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser groups: counts of equal buckets add up."""
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: ``docs`` and a struct ``fence`` with a threshold per measure.

    The window below holds one sketch, whose size is bounded by its buckets.
    """
    by = Window.partitionBy(*keys, "measure")
    run = by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    c = sketch.withColumns({"run": F.sum("n").over(run), "all": F.sum("n").over(by),
                            "edge": edge_of(F.col("bucket"))})
    q = lambda k: F.min(F.when(F.col("run") * 4 >= F.col("all") * k, F.col("edge")))
    slack = F.coalesce(*[F.when(F.col("measure") == k, F.lit(v)) for k, v in SLACK.items()])
    per = (c.groupBy(*keys, "measure").agg(F.max("all").alias("docs"), q(1).alias("q1"),
                                           q(3).alias("q3"))
           .withColumn("fence", F.col("q3") + FENCE * F.greatest(F.col("q3") - F.col("q1"), slack)))
    return per.groupBy(*keys).agg(
        F.max("docs").alias("docs"),
        F.struct(*[F.max(F.when(F.col("measure") == k, F.col("fence"))).alias(k)
                   for k in SLACK]).alias("fence"))


def thresholds(measured: DataFrame, workspace: Workspace, lang: str = "lang",
               source: str = "source", min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per (lang, source) with its number of documents and fences."""
    fine = workspace.save(sketches(measured, [lang, source]), "sketches")
    by_lang = merge(fine, [lang])
    own = fences(fine, [lang, source])
    of_lang = fences(by_lang, [lang]).select(F.col(lang).alias("_lang"), F.col("docs").alias("lang_docs"),
                                             F.col("fence").alias("lang_fence"))
    of_all = fences(merge(by_lang, []), []).select(F.col("fence").alias("all_fence"))
    # one row per language and one for the corpus
    t = own.join(of_lang, F.col(lang).eqNullSafe(F.col("_lang")), "left").join(F.broadcast(of_all))
    pick = (F.when(F.col("docs") >= min_docs, F.col("fence"))
            .when(F.col("lang_docs") >= min_docs, F.col("lang_fence")).otherwise(F.col("all_fence")))
    return workspace.save(t.select(lang, source, F.col("docs").alias("n"), pick.alias("fence")),
                          "thresholds")


def judge(measured: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source",
          spread: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``measured`` with ``kept``: not failed, and at or below each fence."""
    j = attach(measured, limits, [lang, source], "n", spread)
    ok = ~F.col("base_failed")
    for k in SLACK:
        ok = ok & (F.col(f"m.{k}") <= F.col(f"fence.{k}"))
    return j.withColumn("kept", F.coalesce(ok, F.lit(False))).drop("fence", "m")


def quality_rules(docs: DataFrame, workspace: Workspace, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per document (repeated rows stay repeated): ``doc_id n_words
    word_chars n_symbols n_dup_lines n_repeat_words base_failed kept``.

    Null text is empty (fails the base rule), null lang or source form groups
    of their own, extra columns are ignored, an empty table gives no rows.
    """
    m = workspace.save(measure(docs.select("doc_id", "lang", "source", "text")).drop("text"),
                       "measures")
    return judge(m, thresholds(m, workspace, min_docs=min_docs)).drop("lang", "source")


def keep_good(docs: DataFrame, workspace: Workspace, min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_rules` keeps, columns unchanged.

    Verdicts depend on text, language and source alone; they come back to the
    rows by a join on doc_id and a hash of the text, which spreads evenly.
    """
    mark = {"_h": F.xxhash64("text", "lang", "source")}
    m = workspace.save(measure(docs.select("doc_id", "lang", "source", "text").withColumns(mark))
                       .drop("text"), "measures")
    good = judge(m, thresholds(m, workspace, min_docs=min_docs), spread=("doc_id", "_h"))
    good = good.where("kept").select(F.col("doc_id").alias("_d"), "_h").distinct()
    rows = docs.withColumns(mark).alias("d")
    return (rows.join(good.alias("g"), (F.col("d._h") == F.col("g._h"))
                      & F.col("d.doc_id").eqNullSafe(F.col("g._d")), "left_semi")
            .select(*[f"d.{c}" for c in docs.columns]))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents. Nulls, empty texts, repeated rows and empty tables as in
    :func:`quality_rules`."""
    return quality_rules(table(spark, sf_dir, "documents"), Workspace(spark, label="op5"))


_SLACK_SQL = "CASE measure " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SLACK.items()) + " END"
_FENCE_SQL = f"""
    SELECT {{keys}} measure, max(whole) AS docs, min(CASE WHEN run * 4 >= whole * 3 THEN edge END)
           + {FENCE} * greatest(min(CASE WHEN run * 4 >= whole * 3 THEN edge END)
           - min(CASE WHEN run * 4 >= whole THEN edge END), {_SLACK_SQL}) AS fence
    FROM (SELECT *, sum(n) OVER (PARTITION BY {{keys}} measure ORDER BY bucket) AS run,
                 sum(n) OVER (PARTITION BY {{keys}} measure) AS whole,
                 CASE WHEN bucket < 64 THEN bucket
                      ELSE ((bucket - (bucket - 32) // 32 * 32 + 1) << ((bucket - 32) // 32)) - 1 END AS edge
          FROM (SELECT {{keys}} measure, bucket, count(*) AS n FROM b GROUP BY ALL))
    GROUP BY {{keys}} measure"""
OP5_SQL = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
                  list_filter(string_split(coalesce(text, ''), chr(10)),
                              lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
w AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS word FROM d),
g AS (SELECT doc_id, i, word, lag(word) OVER o AS prior, CASE WHEN count(*) OVER f = 5 THEN string_agg(word, ' ') OVER f END AS s
      FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i),
                    f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
r AS (SELECT *, CASE WHEN s IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, s) > 1 THEN 1 END AS again FROM g),
c AS (SELECT doc_id, count(*) FILTER (WHERE hit) AS n_repeat_words, count(*) FILTER (WHERE word = prior) AS n_stutter
      FROM (SELECT *, count(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) > 0 AS hit FROM r)
      GROUP BY doc_id),
f AS (SELECT doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(len(ls) AS BIGINT) AS n_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_stutter, 0) AS n_stutter,
             CAST(length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS BIGINT) AS n_upper
      FROM d LEFT JOIN c USING (doc_id)),
m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
             n_symbols * 1000 // greatest(n_words, 1) AS symbols, n_repeat_words * 1000 // greatest(n_words, 1) AS repeats,
             n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_lines, n_stutter * 1000 // greatest(n_words, 1) AS stutter,
             n_upper * 1000 // greatest(word_chars, 1) AS upper, word_chars * 10 // greatest(n_words, 1) AS word_len FROM f),
u AS (SELECT doc_id, lang, source, unnest({list(SLACK)}) AS measure, unnest([{', '.join(SLACK)}]) AS v FROM m),
b AS (SELECT *, CASE WHEN v < 64 THEN v ELSE (length(bin(v)) - 6) * 32 + (v >> (length(bin(v)) - 6)) END AS bucket FROM u),
own AS ({_FENCE_SQL.format(keys="lang, source,")}),
by_lang AS ({_FENCE_SQL.format(keys="lang,")}),
by_all AS ({_FENCE_SQL.format(keys="")}),
bad AS (SELECT DISTINCT b.doc_id FROM b JOIN own o ON o.lang IS NOT DISTINCT FROM b.lang
               AND o.source IS NOT DISTINCT FROM b.source AND o.measure = b.measure
        JOIN by_lang l ON l.lang IS NOT DISTINCT FROM b.lang AND l.measure = b.measure
        JOIN by_all a ON a.measure = b.measure
        WHERE b.v > CASE WHEN o.docs >= {MIN_DOCS} THEN o.fence WHEN l.docs >= {MIN_DOCS} THEN l.fence ELSE a.fence END)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM m
"""

"""Mixing sources to target weights by weighted sampling without replacement.

Sizes are words. Each source gets a target: all sizes together, shared by the
sources' weights, no target above ``MAX_EPOCHS`` times its source (what is
over is shared again). A source is taken whole as often as its target holds
it; the rest is a fraction of one more epoch, drawn by Efraimidis-Spirakis
sampling: document ``i`` gets the key ``-ln(u_i) / w_i`` with a quality weight
``w_i``, and the smallest keys are taken while the prefix sum of sizes stays
within the rest. What is then missing is less than one document; the later
document whose size fits it best is taken too, if that brings the sum nearer.
Rows that repeat are numbered, and each has a key of its own.

A source may hold a third of all rows, so no task sorts a source. The keys of
a source are counted in PARTS cells between the smallest and the largest of them; the
cell in which the budget ends is counted again in as many, until it has at
most SORTED rows. Only these are sorted, and what comes out is one
cutoff key per source. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from linkset.llm.common import attach, n_words, table, text_of
from linkset.plans.workspace import Workspace

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 7
PARTS = 1024
SORTED = 1 << 12


def quality_weight(text: Column) -> Column:
    """Between 0.05 and 1: the share of letters among the characters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return F.lit(0.05) + F.lit(0.95) * letters / F.greatest(F.length(text), F.lit(1))


def _digest(doc_id: str, text: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(doc_id).cast("string"), text))


def _numbered(rows: DataFrame, workspace: Workspace) -> DataFrame:
    """Adds ``_occ``: 0, 1, ... for rows of equal ``_h``, whichever is first.

    Few rows repeat, but those that do may be many: they are numbered inside the
    input partitions (the high bits of ``_rid``) and shifted by the counts of
    the partitions before.
    """
    per = rows.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").withColumn("_again", F.lit(True))
    per = workspace.save(per, "repeated", {"rows": F.count(F.lit(1))})
    if not per.metrics["rows"]:
        return rows.withColumn("_occ", F.lit(0).cast("long"))
    rows = attach(rows, per, ["_h"], "_n", ["_rid"]).withColumn("_pid", F.shiftright("_rid", 33))
    again = rows.where("_again")
    counts = again.groupBy("_h", "_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_h").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_h", "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    at = F.row_number().over(Window.partitionBy("_h", "_pid").orderBy("_rid")) - 1
    again = again.withColumn("_at", at).join(base, ["_h", "_pid"]).withColumn("_occ", F.col("_at") + F.col("_base"))
    return (again.drop("_at", "_base").unionByName(
        rows.where("_again IS NULL").withColumn("_occ", F.lit(0).cast("long"))).drop("_again", "_pid"))


def with_keys(docs: DataFrame, workspace: Workspace, seed: int = SEED) -> DataFrame:
    """``docs`` (doc_id, source, text and others, none of them with a leading
    underscore but ``_c0``, ``_c1``, ...) plus ``size`` and ``key``.

    ``u`` comes from 52 bits of a hash of seed, id and text, so reruns agree; of
    rows that repeat, all but the first hash their number as well.
    """
    t = text_of("text")
    rows = docs.withColumns({
        "size": n_words(t), "_d": _digest("doc_id", t, seed), "_w": quality_weight(t),
        "_h": F.xxhash64("doc_id", "source", t), "_rid": F.monotonically_increasing_id()})
    rows = _numbered(rows.drop("text"), workspace)
    digest = F.when(F.col("_occ") == 0, F.col("_d")).otherwise(F.md5(F.concat_ws("|", "_d", F.col("_occ").cast("string"))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    return rows.withColumn("key", -F.log(u) / F.col("_w")).drop("_d", "_w", "_h", "_rid", "_occ")


def source_targets(sized: DataFrame, workspace: Workspace,
                   weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source n source_size target`` per source (null is a source, sorted last).

    Targets are ``min(MAX_EPOCHS * size, level * weight)`` with the one level
    at which they add up to all sizes. The windows run over one row per source.
    """
    s = workspace.save(sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "sources")
    order = Window.orderBy(F.col("source").asc_nulls_last())
    at = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (at + 1).cast("int")))
    s = workspace.save(s.withColumn("cap", F.col("source_size") * MAX_EPOCHS), "weighted")
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = ((F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
             / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))))
    found = (s.withColumns({"level": level, "fills": F.col("cap") / F.col("w")})
             .where("level <= fills").agg(F.min(F.struct("fills", "level")).alias("m")).first().m)
    return s.select("source", "n", "source_size", F.least(
        F.col("cap").cast("double"),
        F.lit(float(found.level if found else 0)) * F.col("w")).alias("target"))


def _end_cells(sized: DataFrame, t: DataFrame, workspace: Workspace) -> DataFrame:
    """``source lo hi base below``: the keys between which the budget of a source
    ends, at most SORTED of them, the words below ``lo``, and the largest key there.

    Each pass reads the sizes once more and counts the last pass's cell in
    PARTS smaller ones; a cell of one key is not cut any more.
    """
    spread = ["doc_id", "key"]
    span = sized.groupBy(F.col("source").alias("_s")).agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    now = workspace.save(t.join(span, F.expr("source <=> _s")).select(
        "source", "n", "rest", "lo", "hi", F.lit(0).cast("long").alias("base"), F.lit(None).cast("double").alias("below"),
        F.col("n").alias("held")), "cells-0")
    done = None
    k = 0
    while True:
        k += 1
        ready = now.where((F.col("held") <= SORTED) | (F.col("lo") == F.col("hi")))
        done = ready if done is None else done.unionByName(ready)
        now = now.where((F.col("held") > SORTED) & (F.col("lo") < F.col("hi")))
        if now.isEmpty():
            return done.select("source", "lo", "hi", "base", "below")
        rows = attach(sized, now.select("source", "n", "lo", "hi"), ["source"], "n", spread).where("key between lo and hi")
        cell = F.least(F.floor((F.col("key") - F.col("lo")) / (F.col("hi") - F.col("lo")) * PARTS), F.lit(PARTS - 1))
        sums = rows.groupBy(F.col("source").alias("_s"), cell.alias("cell")).agg(
            F.sum("size").alias("words"), F.count(F.lit(1)).alias("held"),
            F.min("key").alias("lo"), F.max("key").alias("hi"))
        before = Window.partitionBy("_s").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumns({"_before": F.coalesce(F.sum("words").over(before), F.lit(0)),
                                 "_below": F.max("hi").over(before),
                                 "_last": F.col("cell") == F.max("cell").over(Window.partitionBy("_s"))})
        found = sums.join(now.select("source", "n", "rest", "base", "below"), F.expr("source <=> _s")).where(
            "base + _before <= rest and (base + _before + words > rest or _last)")
        now = workspace.save(found.select(
            "source", "n", "rest", "lo", "hi", (F.col("base") + F.col("_before")).alias("base"),
            F.coalesce("_below", "below").alias("below"), "held"), f"cells-{k}")


def cutoffs(sized: DataFrame, workspace: Workspace,
            weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Per source ``n source_size target epochs cut last``: documents with a key
    up to ``cut`` (null: none), and the one with the key ``last``, are taken
    once more than ``epochs`` times.

    ``sized`` (doc_id, source, size, key) must be a written table.
    """
    t = source_targets(sized, workspace, weights)
    epochs = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long")
    t = t.withColumn("epochs", epochs)
    t = workspace.save(t.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "targets")
    spread = ["doc_id", "key"]
    ends = workspace.save(_end_cells(sized, t, workspace).withColumnRenamed("source", "_s"), "ends")
    t = workspace.save(t.join(ends, F.expr("source <=> _s"), "left").drop("_s"), "placed")
    last = attach(sized, t.select("source", "n", "lo", "hi", "base", "rest"), ["source"],
                  "n", spread).where("key between lo and hi")
    run = F.col("base") + F.sum("size").over(Window.partitionBy("source").orderBy("key"))
    near = (last.withColumn("run", run).where(F.col("run") <= F.col("rest"))
            .groupBy(F.col("source").alias("_s"))
            .agg(F.max("key").alias("in_end"), F.max("run").alias("filled")))
    t = workspace.save(t.join(near, F.expr("source <=> _s"), "left").withColumns(
        {"cut": F.coalesce("in_end", "below"),
         "gap": F.col("rest") - F.coalesce("filled", "base")}).drop("_s"), "cuts")
    # of the documents after the cut, the one whose size fits the gap best
    after = (attach(sized, t.select("source", "n", "cut", "gap"), ["source"], "n", spread)
             .where("gap > 0 and size > 0 and (cut is null or key > cut)")
             .groupBy("source", "key").agg(F.sum("size").alias("size"), F.max("gap").alias("gap"))
             .where("size < 2 * gap").groupBy(F.col("source").alias("_s"))
             .agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")), "key"))["key"].alias("last")))
    out = t.join(after, F.expr("source <=> _s"), "left")
    return workspace.save(out.select("source", "n", "source_size", "target", "epochs", "cut",
                                     "last"), "cutoffs")


def take(keyed: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds ``source_size target copies`` to rows that have source, size, key."""
    j = attach(keyed, cuts, ["source"], "n", ["key"])
    more = F.coalesce(F.col("key") <= F.col("cut"), F.lit(False)) | F.col("key").eqNullSafe(F.col("last"))
    return (j.withColumn("copies", F.col("epochs") + more.cast("long"))
            .drop("epochs", "cut", "last"))


def mix(docs: DataFrame, workspace: Workspace, weights: tuple[int, ...] = WEIGHTS,
        seed: int = SEED) -> DataFrame:
    """``doc_id size source_size target taken`` for every row of ``docs``.

    A null text has size 0, a null source is one of the sources, a repeated row is
    taken or left for itself, an empty table gives no rows; equal keys, as of two ids in
    2^52, are taken together.
    """
    sized = workspace.save(with_keys(docs.select("doc_id", "source", "text"), workspace, seed), "sized")
    return take(sized, cutoffs(sized, workspace, weights)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, workspace: Workspace, weights: tuple[int, ...] = WEIGHTS,
          seed: int = SEED) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as :func:`mix` takes it."""
    own = [F.col(c).alias(f"_c{i}") for i, c in enumerate(docs.columns)]
    keyed = with_keys(docs.select(*own, "doc_id", "source", "text"), workspace, seed).drop("doc_id")
    sized = workspace.save(with_keys(docs.select("doc_id", "source", "text"), workspace, seed), "sized")
    rows = take(keyed, cutoffs(sized, workspace, weights)).where("copies > 0")
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return rows.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op7_quality_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed by source. Nulls, ties, repeated rows and empty tables
    as in :func:`mix`."""
    return mix(table(spark, sf_dir, "documents"), Workspace(spark, label="op7"))


OP7_SQL = rf"""
WITH RECURSIVE h AS (SELECT doc_id, source, t, row_number() OVER (PARTITION BY doc_id, source, t) - 1 AS occ,
           md5(concat_ws('|', '{SEED}', doc_id, t)) AS first FROM (SELECT doc_id, source, coalesce(text, '') AS t FROM documents)),
d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    -ln((CAST('0x' || substr(CASE WHEN occ = 0 THEN first ELSE md5(first || '|' || occ) END, 1, 13) AS BIGINT) + 0.5::DOUBLE) / {1 << 52}::DOUBLE)
    / (0.05::DOUBLE + 0.95::DOUBLE * length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) / greatest(length(t), 1)) AS key
    FROM h),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, 3 * sum(size) AS cap,
             {list(WEIGHTS)}[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM d GROUP BY source),
lv AS (SELECT cap / w AS fills, (sum(n) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
       FROM s WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, n AS source_size, target, CASE WHEN n > 0 THEN CAST(floor(target / n) AS BIGINT) ELSE 0 END AS epochs
      FROM (SELECT *, least(cap::DOUBLE, w * (SELECT level FROM lv WHERE level <= fills ORDER BY fills LIMIT 1)) AS target FROM s)),
r AS (SELECT d.*, source_size, target, epochs, target - epochs * source_size AS rest,
             sum(size) OVER (PARTITION BY d.source ORDER BY key) AS run FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
cut AS (SELECT source, max(key) FILTER (WHERE run <= rest) AS cut,
               any_value(rest) - coalesce(max(run) FILTER (WHERE run <= rest), 0) AS gap FROM r GROUP BY source),
late AS (SELECT r.source, key, sum(size) AS size, any_value(gap) AS gap FROM r JOIN cut ON r.source IS NOT DISTINCT FROM cut.source
         WHERE gap > 0 AND size > 0 AND (cut IS NULL OR key > cut) GROUP BY r.source, key),
pick AS (SELECT source, arg_min(key, abs(size - gap)) AS last FROM late WHERE size < 2 * gap GROUP BY source)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN key <= cut OR key = last THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r JOIN cut ON r.source IS NOT DISTINCT FROM cut.source LEFT JOIN pick ON r.source IS NOT DISTINCT FROM pick.source
"""

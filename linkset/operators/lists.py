"""Id lists per key, cut by position.

A list is one row unless it has more than ``per_row`` entries; then row k
holds the entries from position ``k * per_row`` on. The rows are written once.
Keys within that bound are gathered by a plain aggregate, where repeats are left
out if they are to be. The few longer ones (there are at most
``rows / per_row``) are numbered without putting a key into one task: their
rows are dealt out by ranges of (key, id), numbered inside each range, and
shifted by the counts of the key's earlier ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkset.plans.joins import over_threshold
from linkset.plans.workspace import Workspace

LIST_ROWS = 1 << 20


def _long_lists(rows: DataFrame, key: str, value: str, per_row: int) -> DataFrame:
    """``(key, value, block)`` for the rows of long lists."""
    spark = rows.sparkSession
    ws = Workspace(spark, label="lists")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written: the sampled boundaries must not change between the two reads
    dealt = ws.save(rows.repartitionByRange(parts, key, value)
                    .withColumn("_pid", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(key, "_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(key, "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    at = F.row_number().over(Window.partitionBy(key, "_pid").orderBy(value)) - 1
    return (dealt.withColumn("_at", at).join(base, [key, "_pid"])
            .select(key, value, F.floor((F.col("_base") + F.col("_at")) / F.lit(per_row)).cast("long").alias("block")))


def id_lists(rows: DataFrame, key: str, value: str, per_row: int = LIST_ROWS,
             distinct: bool = False) -> DataFrame:
    """``(key, block, ids)``: the values of each key, ascending, at most ``per_row`` a
    row; with ``distinct``, each value once."""
    def gather(part: DataFrame) -> DataFrame:
        ids = F.sort_array(F.collect_list(value))
        return part.groupBy(key, "block").agg((F.array_distinct(ids) if distinct else ids).alias("ids"))

    ws = Workspace(rows.sparkSession, label="lists")
    rows = ws.save(rows.select(key, value), "rows")
    short = rows.withColumn("block", F.lit(0).cast("long"))
    keys = over_threshold(rows, key, per_row, ws)
    if keys is None:
        return gather(short)
    far = rows.join(keys, key, "left_semi")
    return gather(short.join(keys, key, "left_anti")).unionByName(
        gather(_long_lists(far.distinct() if distinct else far, key, value, per_row)))

"""Dense integer ids for string node names.

``dense_ids`` numbers the distinct names 0..n-1 in name order without a
global single-task window:

1. distinct names, range-partitioned by name and sorted inside each partition,
   written once (the range boundaries come from a sample, so the order must
   be fixed before anything is counted);
2. the per-partition row counts (one row per partition) give each partition
   its starting offset — a table as small as the partition count;
3. each row's id is its partition's offset plus its position inside the
   partition (``monotonically_increasing_id`` keeps the position in its low
   33 bits), both captured before the write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkset.plans.joins import find_hot, join_keyed
from linkset.plans.workspace import Workspace

_LOW_BITS = (1 << 33) - 1


def node_names(edges: DataFrame) -> DataFrame:
    return (edges.select(F.col("src").alias("name"))
                 .unionByName(edges.select(F.col("dst").alias("name")))
                 .where(F.col("name").isNotNull()).distinct())


def dense_ids(names: DataFrame, *, partitions: int | None = None,
              workspace: Workspace | None = None) -> DataFrame:
    """``(name, id)`` with ids 0..n-1 following the binary order of ``name``."""
    spark = names.sparkSession
    ws = workspace or Workspace(spark, label="ids")
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (names.select("name").distinct()
                   .repartitionByRange(n_parts, "name").sortWithinPartitions("name"))
    # partition id and in-partition position are taken right after the sort,
    # in the same stage, and written with the row: later scans may pack files
    # differently, the written values do not change
    tagged = ws.save(ranged.select(
        "name",
        F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW_BITS)).alias("_pos")),
        "names")
    per_part = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: the window runs over a table bounded by the
    # partition count, and range partition ids follow name order
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return (tagged.join(F.broadcast(offsets), "_part")
                  .select("name", (F.col("_off") + F.col("_pos")).cast("long").alias("id")))


def relabel(edges: DataFrame, ids: DataFrame, hot_threshold: int | None = None) -> DataFrame:
    """S7+G8: replace both ends of string edges by their dense ids.

    A name on many edges (a hub) is a hot key of the join; such names are
    split off and joined against a broadcast of their few ids.
    """
    s = ids.select(F.col("name").alias("src"), F.col("id").alias("src_id"))
    d = ids.select(F.col("name").alias("dst"), F.col("id").alias("dst_id"))
    e = edges.select("src", "dst")
    step = join_keyed(e, s, "src", hot=find_hot(e, "src", hot_threshold))
    both = join_keyed(step, d, "dst", hot=find_hot(e, "dst", hot_threshold))
    return both.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))

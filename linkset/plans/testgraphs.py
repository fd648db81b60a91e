"""Graphs over the driver's test tables (FIXTURES §4).

Each view reads its whole table.
Order and customer ids map to even node ids, parts/nations to odd ones, so
the two sides of a bipartite graph never share an id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def order_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return (li.select((F.col("l_orderkey") * 2).alias("src"),
                      (F.col("l_partkey") * 2 + 1).alias("dst"))
              .distinct())


def part_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return (li.select((F.col("l_partkey") * 2).alias("src"),
                      (F.col("l_suppkey") * 2 + 1).alias("dst"))
              .distinct())


def order_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order linked to the customer's next order: one path per customer.

    Same rows as ``lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY
    o_orderkey)``, without putting one customer's orders in one task (a
    customer may own a third of all orders):

    1. range-partition on ``(o_custkey, o_orderkey)`` — a big customer spans a
       run of consecutive partitions — and take each row's partition id; the
       result is written once, so the sampled boundaries cannot change;
    2. ``lead`` inside each (partition, customer) piece;
    3. the last order of a piece links to the first order of the customer's
       next piece: a ``lead`` over the pieces table, one row per (partition,
       customer), so a customer's group there has at most one row per
       partition (empty partitions in between do not matter).
    """
    from linkset.plans.workspace import Workspace
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ws = Workspace(spark, label="order-chain")
    tagged = ws.save(o.repartitionByRange(parts, "o_custkey", "o_orderkey")
                      .select("o_custkey", "o_orderkey", F.spark_partition_id().alias("pid")),
                     "orders-ranged")
    w = Window.partitionBy("pid", "o_custkey").orderBy("o_orderkey")
    local = tagged.select("pid", "o_custkey", F.col("o_orderkey").alias("src"),
                          F.lead("o_orderkey").over(w).alias("dst"))
    inner = local.where(F.col("dst").isNotNull()).select("src", "dst")
    pieces = tagged.groupBy("pid", "o_custkey").agg(F.min("o_orderkey").alias("first"),
                                                   F.max("o_orderkey").alias("last"))
    wp = Window.partitionBy("o_custkey").orderBy("pid")
    across = (pieces.select(F.col("last").alias("src"), F.lead("first").over(wp).alias("dst"))
                    .where(F.col("dst").isNotNull()))
    return inner.unionByName(across)


def cust_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select((F.col("c_custkey") * 2).alias("src"),
                    (F.col("c_nationkey").cast("long") * 2 + 1).alias("dst"))


def cust_nation_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String-id form: customer name to nation name."""
    c = table(spark, sf_dir, "customer").select("c_name", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # no hint: Catalyst broadcasts the nation side only if its measured size
    # is under the broadcast threshold, else it shuffles
    return (c.join(n, c.c_nationkey == n.n_nationkey)
             .select(F.col("c_name").alias("src"), F.col("n_name").alias("dst")))


GRAPHS = {
    "order_part": order_part,
    "part_supp": part_supp,
    "order_chain": order_chain,
    "cust_nation": cust_nation,
}

# The same views in SQL for the DuckDB oracle (fixed definitions, FIXTURES §4).
GRAPH_SQL = {
    "order_part": "SELECT DISTINCT l_orderkey*2 AS src, l_partkey*2+1 AS dst "
                  "FROM lineitem",
    "part_supp": "SELECT DISTINCT l_partkey*2 AS src, l_suppkey*2+1 AS dst "
                 "FROM lineitem",
    "order_chain": "SELECT * FROM (SELECT o_orderkey AS src, lead(o_orderkey) OVER "
                   "(PARTITION BY o_custkey ORDER BY o_orderkey) AS dst FROM orders) "
                   "WHERE dst IS NOT NULL",
    "cust_nation": "SELECT c_custkey*2 AS src, CAST(c_nationkey AS BIGINT)*2+1 AS dst "
                   "FROM customer",
}

"""Merging partial results.

Parts solved apart give tables ``(node, component)``. What connects them is
small: a node that two parts put into different components joins these two.
Only that graph of components is solved; every node is then relabelled by one
join. New edges are first mapped to the components of their ends (a node that
no part knows is its own component), so a batch of edges costs a graph of the
components it touches, not of their nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkset.operators.graph import as_edges, vertices
from linkset.plans.joins import find_hot, join_keyed
from linkset.plans.solve import connected_components
from linkset.plans.workspace import Workspace, dealt


def _mapped(ends: DataFrame, known: DataFrame, end: str, hot_threshold: int | None) -> DataFrame:
    """``ends`` with the component of column ``end`` in its place."""
    keyed = known.select(F.col("node").alias(end), F.col("component").alias("_c"))
    out = join_keyed(ends, keyed, end, how="left", hot=find_hot(ends, end, hot_threshold))
    return out.withColumn(end, F.coalesce("_c", end)).drop("_c")


def merge_components(*parts: DataFrame, extra_edges: DataFrame | None = None,
                     hot_threshold: int | None = None, workspace: Workspace | None = None,
                     **kw) -> DataFrame:
    """``(node, component)`` over the union of parts (and new edges). The result
    is a table in the workspace; everything else of the merge is deleted."""
    if not parts and extra_edges is None:
        raise ValueError("nothing to merge")
    spark = (parts[0] if parts else extra_edges).sparkSession
    ws = workspace or Workspace(spark, label="merge")
    work = Workspace(spark, label="merge-work")
    size = {"n": F.count(F.lit(1))}
    rows = None
    for part in parts:
        p = part.select("node", "component")
        rows = p if rows is None else rows.unionByName(p)
    new = None if extra_edges is None else work.save(as_edges(extra_edges), "new", size)
    if rows is None:
        rows = new.limit(0).select(F.col("src").alias("node"), F.col("dst").alias("component"))
    rows = work.save(rows, "rows", size)
    # a step's rows: those of the parts, and the ends of new edges
    count = rows.metrics["n"] + (0 if new is None else 2 * new.metrics["n"])
    with dealt(spark, count):
        known, pairs = _pairs(rows, new, work, hot_threshold)
    solved = connected_components(pairs, hot_threshold=hot_threshold, workspace=work, **kw)
    keyed = solved.select(F.col("node").alias("component"), F.col("component").alias("_least"))
    with dealt(spark, count):
        out = join_keyed(known, keyed, "component", how="left",
                         hot=find_hot(known, "component", hot_threshold))
        out = ws.save(out.select("node", F.coalesce("_least", "component").alias("component")), "merged")
    work.close()
    return out


def _pairs(rows: DataFrame, new: DataFrame | None, work: Workspace,
           hot_threshold: int | None) -> tuple[DataFrame, DataFrame]:
    """Every node with its smallest component, and the graph of components."""
    # a node has a row for each part at most: dealt first, a task holds few nodes, not all of a file's
    known = rows.repartition("node").groupBy("node").agg(F.min("component").alias("component"),
                                                         F.max("component").alias("_last"))
    known = work.save(known, "known")
    # a node in more than two parts: each of its components to the smallest
    spread = known.where("component <> _last").select("node", F.col("component").alias("src"))
    pairs = (rows.join(spread, "node").where("component <> src")
             .select("src", F.col("component").alias("dst")))
    known = known.drop("_last")
    if new is not None:
        ends = _mapped(_mapped(new, known, "src", hot_threshold), known, "dst", hot_threshold)
        pairs = pairs.unionByName(ends.where("src <> dst"))
        alone = vertices(new).join(known, "node", "left_anti")
        known = known.unionByName(alone.withColumn("component", F.col("node")))
    return known, work.save(pairs.distinct(), "pairs")

"""Seeds recovered from a finished forest.

A seed is a node that is a parent and never a child. Three equivalent forms
(kept so they can be compared against each other); all three dedupe each
side map-side first, so a parent with millions of children costs one row per
task before the shuffle. A node whose only edge is a self-loop has no tree
row and is not found here — use the tracked seeds of the contraction for that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _parents(tree: DataFrame) -> DataFrame:
    return tree.select(F.col("parent").alias("node")).distinct()


def _children(tree: DataFrame) -> DataFrame:
    return tree.select(F.col("child").alias("node")).distinct()


def seeds_antijoin(tree: DataFrame) -> DataFrame:
    """Distinct parents, minus children by a left-anti join."""
    return _parents(tree).join(_children(tree), "node", "left_anti")


def seeds_except(tree: DataFrame) -> DataFrame:
    """Set difference ``parents EXCEPT children``."""
    return _parents(tree).subtract(_children(tree))


def seeds_outer(tree: DataFrame) -> DataFrame:
    """Left outer join to the children, keep rows with no match."""
    kids = _children(tree).select(F.col("node").alias("kid"), F.lit(True).alias("is_child"))
    return (_parents(tree).join(kids, F.col("node") == F.col("kid"), "left")
                          .where(F.col("is_child").isNull()).select("node"))

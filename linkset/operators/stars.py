"""Alternating large-star / small-star.

Both steps are "per node minimum, then re-point edges at it", written as a
map-side-combined ``min`` aggregate and a join back to the edges; no node's
neighbourhood is ever gathered into one row. While a table has no hot node,
the loop takes both minima by windows instead, and writes nothing between the
two stars: large-star gives a node no more rows than it has neighbours, so its
output has no hot node either.

Stop rule (corrected, SURVEY §0.2 row 1): a round is large-star followed by
small-star; stop when a round leaves the small-star output unchanged as a set.
Comparing large- and small-star outputs of the same round can stop early. While
it is written, a table's rows are counted and its row hashes are folded into a
fingerprint of 128 bits that does not depend on their order. Different
fingerprints are different sets; equal ones are confirmed by one anti join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkset.operators.graph import both_ways, distinct_edges, symmetrize, undirected
from linkset.operators.lists import LIST_ROWS, id_lists
from linkset.plans.joins import HOT_KEY_ROWS, hot_keys, join_keyed, over_threshold
from linkset.plans.workspace import Workspace


def _minima(edges: DataFrame) -> DataFrame:
    """Per ``src``: ``least(src, min(dst))`` and the row count (hot-key detection)."""
    agg = edges.groupBy("src").agg(F.min("dst").alias("_mn"), F.count(F.lit(1)).alias("deg"))
    return agg.select("src", F.least("src", "_mn").alias("mn"), "deg")


def large_star(sym: DataFrame, strategy: str = "auto", hot_threshold: int | None = None,
               minima: DataFrame | None = None, hot_rows: int | None = None) -> DataFrame:
    """L2: for each a with m = min(N(a) ∪ {a}), emit (x, m) for x ∈ N(a), x > a.

    ``minima`` and the number ``hot_rows`` of its hot nodes may be passed in."""
    mn = minima if minima is not None else _minima(sym)
    hot = hot_keys(mn, "src", "deg", hot_threshold)
    out = (join_keyed(sym.where(F.col("dst") > F.col("src")), mn.select("src", "mn"), "src",
                      strategy=strategy, hot=hot, hot_rows=hot_rows)
           .select(F.col("dst").alias("src"), F.col("mn").alias("dst")))
    return distinct_edges(out)


def small_star_init(edges: DataFrame) -> DataFrame:
    """L3: orient every edge from the larger to the smaller end."""
    return edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))


def small_star(edges: DataFrame, strategy: str = "auto",
               hot_threshold: int | None = None) -> DataFrame:
    """L4: on larger→smaller edges, for each a with m = min(N(a) ∪ {a}),
    emit (x, m) for x ∈ N(a) ∪ {a}, x ≠ m."""
    oriented = distinct_edges(small_star_init(edges))
    return _re_point(oriented, _minima(oriented), strategy, hot_threshold, None)


def _re_point(oriented: DataFrame, mn: DataFrame, strategy: str, hot_threshold: int | None,
              hot_rows: int | None) -> DataFrame:
    hot = hot_keys(mn, "src", "deg", hot_threshold)
    nbrs = (join_keyed(oriented, mn.select("src", "mn"), "src", strategy=strategy, hot=hot,
                       hot_rows=hot_rows)
            .select(F.col("dst").alias("x"), "mn"))
    own = mn.select(F.col("src").alias("x"), "mn")
    out = nbrs.unionByName(own).where(F.col("x") != F.col("mn"))
    return distinct_edges(out.select(F.col("x").alias("src"), F.col("mn").alias("dst")))


@dataclass
class StarResult:
    pairs: DataFrame        # (src=node, dst=root) for every non-root node that has an edge
    components: DataFrame   # (node, component) for every node, roots and isolated included
    rounds: int


def fingerprint() -> dict[str, Column]:
    """Size and fingerprint of a set of edges. Equal rows would cancel out: a set has none."""
    return {"rows": F.count(F.lit(1)), "one": F.bit_xor(F.xxhash64("src", "dst")),
            "two": F.bit_xor(F.xxhash64("dst", "src", F.lit(1)))}


def same_set(a: DataFrame, b: DataFrame) -> bool:
    """Exact equality of two distinct edge tables, written with :func:`fingerprint`."""
    return a.metrics == b.metrics and a.join(b, ["src", "dst"], "left_anti").isEmpty()


def _large_by_window(sym: DataFrame) -> DataFrame:
    """Large-star as a bag."""
    seen = sym.selectExpr("src", "dst", "min(dst) OVER (PARTITION BY src) AS mn").where("dst > src")
    return seen.selectExpr("dst AS src", "least(src, mn) AS dst")


def _small_by_window(large: DataFrame) -> DataFrame:
    """A large-star output has the larger end first, maybe repeated; the row of
    the smallest neighbour stands for the node itself."""
    seen = large.selectExpr("src", "dst", "min(dst) OVER (PARTITION BY src) AS mn")
    return distinct_edges(seen.selectExpr("if(dst = mn, src, dst) AS src", "mn AS dst"))


class _Loop:
    """The two half-rounds of the loop on tables of known size."""

    def __init__(self, ws: Workspace, strategy: str, threshold: int):
        self.ws, self.strategy, self.threshold = ws, strategy, threshold

    def _minima(self, edges: DataFrame) -> tuple[DataFrame, int]:
        hot = F.count(F.when(F.col("deg") > self.threshold, 1))
        mn = self.ws.save(_minima(edges), "minima", {"hot": hot})
        return mn, mn.metrics["hot"]

    def _by_window(self, edges: DataFrame, rows: int) -> bool:
        """No node of ``edges`` has more rows than a window may hold."""
        if self.strategy != "auto":
            return False
        if rows <= self.threshold:
            return True
        hot = over_threshold(edges, "src", self.threshold, self.ws)
        self.ws.release(hot)
        return hot is None

    def round(self, sym: DataFrame, rows: int, r: int) -> DataFrame:
        """Large-star, then small-star, written once or by halves."""
        if self._by_window(sym, rows):
            return self.ws.save(_small_by_window(_large_by_window(sym)), f"small{r}", fingerprint())
        large = self.large(sym, r)
        small = self.small(large, r)
        self.ws.release(large)
        return small

    def large(self, sym: DataFrame, r: int) -> DataFrame:
        mn, hot = self._minima(sym)
        out = self.ws.save(large_star(sym, self.strategy, self.threshold, mn, hot), f"large{r}", fingerprint())
        self.ws.release(mn)
        return out

    def small(self, large: DataFrame, r: int) -> DataFrame:
        if self._by_window(large, large.metrics["rows"]):
            return self.ws.save(_small_by_window(large), f"small{r}", fingerprint())
        mn, hot = self._minima(large)
        out = self.ws.save(_re_point(large, mn, self.strategy, self.threshold, hot), f"small{r}", fingerprint())
        self.ws.release(mn)
        return out


def star_components(edges: DataFrame, *, strategy: str = "auto",
                    hot_threshold: int | None = None,
                    workspace: Workspace | None = None) -> StarResult:
    """Alternate the two stars until a round changes nothing."""
    spark = edges.sparkSession
    ws = workspace or Workspace(spark, label="stars")
    loop = _Loop(ws, strategy, HOT_KEY_ROWS if hot_threshold is None else hot_threshold)
    g = ws.save(undirected(edges), "s-g0", {"rows": F.count(F.lit(1)),
                                            "loops": F.count(F.when(F.col("src") == F.col("dst"), 1))})
    loops = g.metrics["loops"]
    prev = None
    r = 0
    while True:
        r += 1
        # L1: each edge in both directions
        sym, rows = ((both_ways(g), 2 * g.metrics["rows"] - loops) if prev is None else
                     (symmetrize(prev), 2 * prev.metrics["rows"]))
        small = loop.round(sym, rows, r)
        if prev is not None and same_set(small, prev):
            ws.release(small)
            break
        ws.release(prev)
        prev = small
    pairs = prev
    # a node with an edge points at its root or is one; others have a self-loop alone
    roots = pairs.select("dst").distinct()
    comp = pairs.selectExpr("src AS node", "dst AS component").unionByName(
        roots.selectExpr("dst AS node", "dst AS component"))
    if loops:
        alone = g.where("src = dst").select(F.col("src").alias("node")).join(comp, "node", "left_anti")
        comp = comp.unionByName(alone.select("node", F.col("node").alias("component")))
    comp = ws.save(comp, "star-components")
    ws.release(g)
    return StarResult(pairs, comp, r)


def members(components: DataFrame, per_row: int = LIST_ROWS) -> DataFrame:
    """``(component, block, members ARRAY<LONG>)`` ascending; a component of
    more than ``per_row`` nodes has a row for each ``per_row`` of them."""
    return id_lists(components, "component", "node", per_row).withColumnRenamed("ids", "members")


def sizes(components: DataFrame) -> DataFrame:
    """L7 size-only form: ``(component, size)`` with a map-side partial count."""
    return components.groupBy("component").agg(F.count(F.lit(1)).cast("long").alias("size"))

"""Graph construction and inspection.

Graphs are flat edge tables ``(src LONG, dst LONG)``. Nothing here builds
vertex-sized data on the driver; only scalar counts leave the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkset.functions.columns import sorted_text
from linkset.operators.lists import LIST_ROWS, id_lists
from linkset.plans.joins import find_hot, join_keyed
from linkset.plans.lookup import asked_of
from linkset.plans.workspace import Workspace

INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def as_edges(df: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Project any pair of id columns to the canonical ``(src, dst)`` shape.

    A null ``src`` row is dropped; a null ``dst`` marks an isolated vertex and
    becomes the self-loop ``(src, src)`` (S8). Ids must be of an integral type:
    a cast from any other could make one node of two.
    """
    s, d = _ids(df, src, dst)
    return (df.where(s.isNotNull())
              .select(s.alias("src"), F.coalesce(d, s).alias("dst")))


def _ids(df: DataFrame, src: str, dst: str) -> tuple[Column, Column]:
    types = dict(df.select(F.col(src).alias("s"), F.col(dst).alias("d")).dtypes)
    wrong = {c: t for c, t in ((src, types["s"]), (dst, types["d"])) if t not in INTEGRAL and t != "void"}
    if wrong:
        raise TypeError(f"node ids must be integers, got {wrong}; give names dense ids first")
    return F.col(src).cast("long"), F.col(dst).cast("long")


def symmetrize(edges: DataFrame) -> DataFrame:
    """G1: every edge in both directions (bag semantics).

    One pass: each row is expanded into its two directions, so an expensive
    input plan (a join) runs once, where a union of two projections would run
    it twice.
    """
    return (edges.selectExpr(
        "explode(array(struct(src, dst), struct(dst AS src, src AS dst))) AS _e")
        .selectExpr("_e.src", "_e.dst"))


def directed(edges: DataFrame) -> DataFrame:
    """Keep the given orientation only."""
    return edges.select("src", "dst")


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Set semantics on ``(src, dst)``; partial dedup runs map-side."""
    return edges.select("src", "dst").dropDuplicates(["src", "dst"])


def undirected(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Every undirected edge once, smaller end first; self-loops kept.

    The rows are those of :func:`as_edges`, turned; a null is passed over by least and greatest.
    It is one projection, so that a distinct input is not made distinct twice: Catalyst
    leaves out an aggregate right below one that makes it needless.
    """
    s, d = _ids(edges, src, dst)
    return distinct_edges(edges.where(s.isNotNull()).select(F.least(s, d).alias("src"), F.greatest(s, d).alias("dst")))


def both_ways(once: DataFrame, src: str = "src", dst: str = "dst", *more: str) -> DataFrame:
    """Both directions of edges held once; a self-loop stays one row. No exchange."""
    extra = "".join(f", {c}" for c in more)
    return once.selectExpr(
        f"inline(if({src} = {dst}, array(struct({src}, {dst}{extra})), array(struct({src}, {dst}{extra}), "
        f"struct({dst} AS {src}, {src} AS {dst}{extra}))))")


def normalize(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Canonical undirected graph: symmetric, distinct, self-loops kept. Edges are
    made distinct before they are turned, so half as many rows are exchanged."""
    return both_ways(undirected(edges, src, dst))


def adjacency(edges: DataFrame, per_row: int = LIST_ROWS) -> DataFrame:
    """``(node, block, nn ARRAY<LONG>)`` — export form; the rounds never use it.

    One row per node; a hub with more than ``per_row`` neighbours has a row
    (``block`` 0, 1, ...) for each ``per_row`` of them, in ascending order.
    """
    pairs = edges.select(F.col("src").alias("node"), "dst")
    return id_lists(pairs, "node", "dst", per_row, distinct=True).withColumnRenamed("ids", "nn")


def adjacency_text(edges: DataFrame, per_row: int = LIST_ROWS) -> DataFrame:
    """S10 line form ``node<TAB>n1;n2;...``, neighbours ascending; one line per
    node, and more only for hubs beyond ``per_row`` (a reader joins them)."""
    adj = adjacency(edges, per_row)
    return adj.select("node", "block", F.concat_ws("\t", F.col("node").cast("string"),
                                                   sorted_text("nn", ";")).alias("line"))


def with_activity(adj: DataFrame, flag: bool = True) -> DataFrame:
    """Tag every row with an activity flag."""
    return adj.withColumn("active", F.lit(flag))


def star_edges(center, nodes: DataFrame, node_col: str = "node",
               center_first: bool = True, both: bool = False) -> DataFrame:
    """Connect one node to every node of a node table.

    ``center_first`` picks the orientation ``(center, n)`` or ``(n, center)``;
    ``both`` emits the two directions.
    """
    n = F.col(node_col).cast("long")
    c = F.lit(center).cast("long")
    out = nodes.select((c if center_first else n).alias("src"),
                       (n if center_first else c).alias("dst"))
    return symmetrize(out) if both else out


def vertices(edges: DataFrame) -> DataFrame:
    """Distinct node ids of either end (one pass over the input)."""
    return (edges.select(F.explode(F.array("src", "dst")).alias("node"))
                 .distinct())


def graph_counts(edges: DataFrame) -> DataFrame:
    """Edge rows, distinct directed edges, distinct vertices — one row.

    One scan: each edge becomes one row for itself and one for each of its
    ends, equal ones are counted map-side, and the counts are read off by kind.
    """
    tagged = edges.selectExpr(
        "inline(array(struct(true AS edge, src AS x, dst AS y), struct(false AS edge, src AS x, NULL AS y), "
        "struct(false AS edge, dst AS x, NULL AS y)))")
    each = tagged.groupBy("edge", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    return each.agg(F.coalesce(F.sum(F.when(F.col("edge"), F.col("n"))), F.lit(0)).cast("long").alias("edge_rows"),
                    F.count(F.when(F.col("edge"), 1)).alias("distinct_edges"),
                    F.count(F.when(~F.col("edge"), 1)).alias("vertex_count"))


def neighbours(edges: DataFrame, nodes: DataFrame, node_col: str = "node",
               hot_threshold: int | None = None, workspace: Workspace | None = None) -> DataFrame:
    """Batch neighbour lookup — ``(node, neighbour)`` for every asked node.
    Other nodes' edges are left out where they are read; of the rest, hubs'
    edges are looked up in place, the others by a shuffle."""
    ws = workspace or Workspace(edges.sparkSession, label="lookup")
    asked, near = asked_of(nodes.select(F.col(node_col).cast("long").alias("src")), "src", edges, ws)
    hot = find_hot(near, "src", hot_threshold, ws)
    return (join_keyed(near, asked, "src", how="left_semi", hot=hot)
                 .select(F.col("src").alias("node"), F.col("dst").alias("neighbour")))


def peek(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows in the order of all columns."""
    return df.orderBy(*df.columns).limit(n)


def sample_rows(df: DataFrame, n: int, seed: int = 123, key: str = "node") -> DataFrame:
    """``n`` rows drawn without replacement, for small ``n`` (a peek).

    A row's rank is a hash of the seed and its key, so a sample can be checked
    and repeated. A top-``n`` is a bounded heap per task plus one merge of
    ``n`` rows per task, never a global sort.
    """
    rank = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return df.withColumn("_r", rank).orderBy("_r", key).limit(n).drop("_r")


def disjoint_copies(edges: DataFrame, k: int, offset: int | None = None,
                    workspace: Workspace | None = None) -> DataFrame:
    """``k`` disjoint copies of a graph, copy ``i`` shifted by ``i * offset``.

    ``offset`` defaults to ``max(id) - min(id) + 1``, so copies never touch; the
    edges are then written once, and their ends are found by that write.
    """
    if offset is None:
        ws = workspace or Workspace(edges.sparkSession, label="copies")
        edges = ws.save(edges.select("src", "dst"), "edges", {
            "lo": F.min(F.least("src", "dst")), "hi": F.max(F.greatest("src", "dst"))})
        lo, hi = edges.metrics["lo"], edges.metrics["hi"]
        offset = 1 if lo is None else int(hi) - int(lo) + 1
    copy = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("copy")
    shift = F.col("copy").cast("long") * F.lit(offset).cast("long")
    return (edges.select("src", "dst", copy)
                 .select((F.col("src") + shift).alias("src"),
                         (F.col("dst") + shift).alias("dst")))

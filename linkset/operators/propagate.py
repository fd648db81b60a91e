"""Seed propagation over the forest.

The forest ``tree(parent, child)`` gives every non-root node one parent with
``parent < child``; ``seeds(node)`` are the roots. A node's component is the
seed at the top of its chain.

* :func:`propagate_layers` (P2/P3/P8/P9) — round by round, last round first, for
  the forest of a contraction; else a frontier walks down one layer per step.
* :func:`propagate_jump` (§4.3) — pointer jumping, ⌈log2 depth⌉ joins.
* :func:`propagate_naive` (P1/P4) — "join everything again until nothing is
  null", with set semantics; emits (parent, seed, child).

Each step's output is written to the workspace, so no step replays earlier
ones, and a lost executor costs one step, not the chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkset.plans.joins import HOT_KEY_ROWS, find_hot, join_keyed
from linkset.plans.lookup import asked_of
from linkset.plans.workspace import Workspace, dealt


def _labels_of_rounds(tree: DataFrame, roots: DataFrame, rounds: int, strategy: str,
                      hot: DataFrame | None, ws: Workspace) -> DataFrame:
    """Labels of a contraction's forest, last round first.

    A node that retires in round r has a parent that is a seed or retires
    later: the minimum it follows holds itself, so it stays in the graph. When
    round r is due, its parents are labelled; every tree row is read once and
    joined once, to the labels of the (much smaller) later rounds.
    """
    spark = tree.sparkSession
    out_path = ws.folder("labels")
    schema = "node BIGINT, component BIGINT, depth INT"
    for r in range(rounds, 0, -1):
        known = roots
        if r < rounds:
            known = roots.unionByName(spark.read.schema(schema + ", round INT").parquet(out_path)
                                      .drop("round"))
        keyed = known.select(F.col("node").alias("parent"), "component", "depth")
        step = join_keyed(tree.where(F.col("round") == r).select("parent", "child"), keyed, "parent",
                          strategy=strategy, hot=hot)
        (step.select(F.col("child").alias("node"), "component", (F.col("depth") + 1).alias("depth"))
         .write.mode("errorifexists").parquet(f"{out_path}/round={r}"))
    return spark.read.schema(schema + ", round INT").parquet(out_path).drop("round")


def propagate_layers(tree: DataFrame, seeds: DataFrame, *, strategy: str = "auto",
                     hot_threshold: int | None = None, include_roots: bool = True,
                     rounds: int | None = None, rows: int | None = None,
                     workspace: Workspace | None = None) -> DataFrame:
    """``(node, component, depth)``; roots have depth 0.

    ``rounds``, for the forest of a contraction, is its number of rounds: its
    rows are then joined round by round, last first, each row once. Any other
    tree goes layer by layer: the nodes labelled in one step are joined to the
    tree in the next, until a step labels none.

    ``rows`` is the number of tree rows, if it is known: a tree of no more rows
    than ``hot_threshold`` is not searched for hot parents.

    With ``include_roots=False`` only tree children are returned (the
    layered output that omits the roots).
    """
    spark = tree.sparkSession
    ws = workspace or Workspace(spark, label="propagate")
    edges = tree.select("parent", "child")
    roots = seeds.select("node", F.col("node").alias("component"), F.lit(0).alias("depth"))
    if rounds == 0:
        return roots if include_roots else roots.limit(0)
    few = rows is not None and rows <= (HOT_KEY_ROWS if hot_threshold is None else hot_threshold)
    hot = None if few else find_hot(edges, "parent", hot_threshold, ws)
    if rounds is not None:
        with dealt(spark, rows or 0):
            layers = _labels_of_rounds(tree, roots, rounds, strategy, hot, ws)
        return roots.unionByName(layers) if include_roots else layers
    out_path = ws.folder("labels")
    frontier = roots.select("node", "component")
    depth = 0
    while True:
        depth += 1
        keyed = frontier.select(F.col("node").alias("parent"), "component")
        step = (join_keyed(edges, keyed, "parent", strategy=strategy, hot=hot)
                .select(F.col("child").alias("node"), "component"))
        path = f"{out_path}/depth={depth}"
        step.write.mode("errorifexists").parquet(path)
        frontier = spark.read.schema("node BIGINT, component BIGINT").parquet(path)
        if frontier.isEmpty():
            break
    layers = spark.read.schema("node BIGINT, component BIGINT, depth INT").parquet(out_path)
    return roots.unionByName(layers) if include_roots else layers


def propagate_shrinking(tree: DataFrame, seeds: DataFrame, *, strategy: str = "auto",
                        hot_threshold: int | None = None,
                        workspace: Workspace | None = None) -> DataFrame:
    """Layered propagation that also drops resolved rows from the tree.

    Each step splits the remaining tree into the rows whose parent was just
    labelled (resolved now) and the rest (kept for later steps), so every
    tree row is joined once. Returns ``(node, component)`` for tree children.
    Costs one anti join per step; pays off when the tree is much deeper than
    the first few layers.
    """
    spark = tree.sparkSession
    ws = workspace or Workspace(spark, label="shrink")
    out_path = ws.folder("labels")
    rest = tree.select("parent", "child")
    hot = find_hot(rest, "parent", hot_threshold, ws)
    frontier = seeds.select(F.col("node").alias("parent"), F.col("node").alias("component"))
    step, prev_rest = 0, None
    while True:
        step += 1
        done = join_keyed(rest, frontier, "parent", strategy=strategy, hot=hot)
        path = f"{out_path}/step={step}"
        done.select(F.col("child").alias("node"), "component").write.parquet(path)
        labelled = spark.read.schema("node BIGINT, component BIGINT").parquet(path)
        if labelled.isEmpty():
            break
        nxt = ws.save(rest.join(labelled.select(F.col("node").alias("child")), "child",
                                "left_anti"), f"rest{step}")
        ws.release(prev_rest)
        prev_rest, rest = nxt, nxt
        frontier = labelled.select(F.col("node").alias("parent"), "component")
        if rest.isEmpty():
            break
    return spark.read.schema("node BIGINT, component BIGINT, step INT").parquet(out_path) \
        .select("node", "component")


def components_from(tree: DataFrame, seeds: DataFrame, **kw) -> DataFrame:
    """The full ``(node, component)`` table, roots included."""
    return propagate_layers(tree, seeds, **kw).select("node", "component")


def propagate_jump(tree: DataFrame, seeds: DataFrame, *, strategy: str = "auto",
                   hot_threshold: int | None = None,
                   workspace: Workspace | None = None) -> DataFrame:
    """Pointer jumping: ``anc := anc(anc)`` until every node points at a root.

    Each step halves the remaining distance to the root. A step that moves no
    row ends the loop, so a chain whose top is not in ``seeds`` stops at its
    top node instead of looping forever (SURVEY §0.2 row 13).
    """
    spark = tree.sparkSession
    ws = workspace or Workspace(spark, label="jump")
    ptr = (tree.select(F.col("child").alias("node"), F.col("parent").alias("anc"))
               .unionByName(seeds.select("node", F.col("node").alias("anc"))))
    saved = ptr = ws.save(ptr, "ptr0")
    step = 0
    while True:
        step += 1
        # hot ancestors: many nodes point at one root, so split them off
        hot = find_hot(ptr, "anc", hot_threshold, ws)
        up = ptr.select(F.col("node").alias("anc"), F.col("anc").alias("anc2"))
        nxt = (join_keyed(ptr, up, "anc", how="left", strategy=strategy, hot=hot)
               .select("node", F.coalesce("anc2", "anc").alias("anc"),
                       (F.coalesce("anc2", "anc") != F.col("anc")).alias("moved")))
        nxt = ws.save(nxt, f"ptr{step}", {"moved": F.count(F.when(F.col("moved"), 1))})
        moved = nxt.metrics["moved"]
        ws.release(saved, hot)
        saved, ptr = nxt, nxt.select("node", "anc")
        if moved == 0:
            break
    return ptr.select("node", F.col("anc").alias("component"))


def propagate_naive(tree: DataFrame, seeds: DataFrame, *, strategy: str = "auto",
                    hot_threshold: int | None = None,
                    workspace: Workspace | None = None) -> DataFrame:
    """Join the whole tree to the known labels until no child is unlabelled.

    Corrected: known labels are a set (one row per node) and unresolved rows are
    not carried along, so the loop ends after depth steps. Returns
    ``(parent, seed, child)`` for every tree row.
    """
    spark = tree.sparkSession
    ws = workspace or Workspace(spark, label="naive")
    edges = tree.select("parent", "child")
    hot = find_hot(edges, "parent", hot_threshold, ws)
    size = {"rows": F.count(F.lit(1))}
    known = ws.save(seeds.select("node", F.col("node").alias("seed")), "known0", size)
    step = 0
    while True:
        step += 1
        keyed = known.select(F.col("node").alias("parent"), "seed")
        trip = ws.save(join_keyed(edges, keyed, "parent", how="left", strategy=strategy, hot=hot),
                       f"triples{step}", {"missing": F.count(F.when(F.col("seed").isNull(), 1))})
        if trip.metrics["missing"] == 0:
            break
        newly = trip.where(F.col("seed").isNotNull()).select(
            F.col("child").alias("node"), "seed")
        nxt = ws.save(known.unionByName(newly).dropDuplicates(["node"]), f"known{step}", size)
        grew = nxt.metrics["rows"] > known.metrics["rows"]
        ws.release(known, trip)
        known = nxt
        if not grew:  # orphans: their chain has no seed; report them unlabelled
            trip = ws.save(join_keyed(edges, known.select(F.col("node").alias("parent"), "seed"),
                                      "parent", how="left", strategy=strategy, hot=hot), "triples-final")
            break
    return trip.select("parent", "seed", "child")


def _split_by_seeds(tree: DataFrame, seeds: DataFrame, how: str, hot_threshold: int | None) -> DataFrame:
    return join_keyed(tree, seeds.select(F.col("node").alias("parent")), "parent", how=how,
                      hot=find_hot(tree, "parent", hot_threshold))


def unresolved_edges(tree: DataFrame, seeds: DataFrame, hot_threshold: int | None = None) -> DataFrame:
    """Tree rows whose parent is not a seed."""
    return _split_by_seeds(tree, seeds, "left_anti", hot_threshold)


def direct_edges(tree: DataFrame, seeds: DataFrame, hot_threshold: int | None = None) -> DataFrame:
    """Tree rows whose parent is a seed."""
    return _split_by_seeds(tree, seeds, "left_semi", hot_threshold)


def root_of(nodes: DataFrame, components: DataFrame, node_col: str = "node",
            workspace: Workspace | None = None) -> DataFrame:
    """P5: component of each asked node; a node the graph does not know is its own root.
    The components of other nodes are left out where they are read."""
    asked, found = asked_of(nodes.select(F.col(node_col).cast("long").alias("node")), "node",
                            components.select("node", "component"), workspace)
    return (asked.join(found, "node", "left")
                 .select("node", F.coalesce("component", "node").alias("component")))

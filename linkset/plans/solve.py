"""``connected_components``: the one call most users need."""

from __future__ import annotations

from pyspark.sql import DataFrame

from linkset.operators.contract import contract
from linkset.operators.propagate import propagate_jump, propagate_layers
from linkset.plans.workspace import Workspace

ALGORITHMS = ("contract", "stars")
PROPAGATIONS = ("layers", "jump")


def connected_components(edges: DataFrame, *, algorithm: str = "contract",
                         propagation: str = "layers", src: str = "src", dst: str = "dst",
                         prune_strategy: str = "auto", seed_strategy: str = "auto",
                         hot_threshold: int | None = None, workspace: Workspace | None = None,
                         resume: str | None = None) -> DataFrame:
    """``(node, component)`` for every node; component = smallest id in it.

    ``edges`` is any table with two id columns; a null second id marks an
    isolated vertex. The result can be joined straight back to the input. It
    reads files under the run's workspace folder (in ``spark.checkpoint.dir``);
    pass your own ``workspace`` (it may serve any number of calls) and call
    ``workspace.close()`` once the results have been written elsewhere.

    ``resume`` names a folder for this run alone, for the contraction to go on
    in after a lost driver (see :func:`linkset.operators.contract.contract`).
    """
    if algorithm not in ALGORITHMS:
        raise ValueError(f"algorithm must be one of {ALGORITHMS}")
    e = edges.select(src, dst).toDF("src", "dst") if (src, dst) != ("src", "dst") else edges
    if resume and algorithm != "contract":
        raise ValueError("only the contraction can resume")
    ws = workspace or Workspace(edges.sparkSession, label="cc")
    if algorithm == "stars":
        from linkset.operators.stars import star_components
        return star_components(e, hot_threshold=hot_threshold, workspace=ws).components
    res = contract(e, prune_strategy=prune_strategy, seed_strategy=seed_strategy,
                   hot_threshold=hot_threshold, workspace=ws, resume=resume)
    if propagation == "jump":
        return propagate_jump(res.tree, res.seeds, strategy=prune_strategy,
                              hot_threshold=hot_threshold, workspace=ws)
    if propagation != "layers":
        raise ValueError(f"propagation must be one of {PROPAGATIONS}")
    return propagate_layers(res.tree, res.seeds, strategy=prune_strategy,
                            hot_threshold=hot_threshold, rounds=res.rounds,
                            rows=res.tree_rows, workspace=ws).select("node", "component")


def connected_components_named(edges: DataFrame, *, src: str = "src", dst: str = "dst",
                               **kw) -> DataFrame:
    """``(name, component)`` for string node names (S7 + G8 + CC).

    Names get dense ids in name order, the id graph is solved, and ids are
    mapped back. Because ids follow name order, the smallest id of a component
    is its smallest name, so ``component`` is the component's smallest name.
    """
    from pyspark.sql import functions as F

    from linkset.operators.ids import dense_ids, node_names, relabel
    from linkset.plans.joins import find_hot, join_keyed
    # a null second name marks an isolated one, as with ids
    name = F.col(src).cast("string")
    named = edges.where(name.isNotNull()).select(
        name.alias("src"), F.coalesce(F.col(dst).cast("string"), name).alias("dst"))
    ws = kw.pop("workspace", None) or Workspace(edges.sparkSession, label="cc-named")
    ids = dense_ids(node_names(named), workspace=ws)
    labels = connected_components(relabel(named, ids), workspace=ws, **kw)
    by_id = ids.select(F.col("id").alias("node"), "name")
    back = ids.select(F.col("id").alias("component"), F.col("name").alias("component_name"))
    named_nodes = labels.join(by_id, "node")      # one-to-one on node
    # a big component is a hot key of the second join: split it off
    hot = find_hot(labels, "component", kw.get("hot_threshold"), ws)
    return (join_keyed(named_nodes, back, "component", hot=hot)
            .select("name", F.col("component_name").alias("component")))

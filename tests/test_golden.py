"""Hand-made graphs with known answers (FIXTURES §2)."""

from graph_tools import union_find

from linkset.operators.contract import contract
from linkset.operators.propagate import (direct_edges, propagate_jump, propagate_layers,
                                         propagate_naive, propagate_shrinking, root_of,
                                         unresolved_edges)
from linkset.operators.seeds import seeds_antijoin, seeds_except, seeds_outer
from linkset.operators.stars import star_components
from linkset.plans.solve import connected_components
from linkset.sources.edges import edges_from_rows

G8 = [(0, 1), (1, 2), (2, 5), (5, 8), (7, 8), (3, 7), (3, 4), (3, 6)]
G11 = G8 + [(10, 11), (10, 12), (12, 13)]
G14 = G11 + [(6, 9), (9, 15), (9, 16)]
G9 = G8 + [(10, 9)]


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_g8_rounds_tree_seeds(spark):
    res = contract(edges_from_rows(spark, G8))
    assert res.rounds == 3
    tree = rows(res.tree, "parent", "child", "round")
    assert tree == sorted([(2, 8, 1), (3, 4, 1), (3, 6, 1), (3, 7, 1),
                           (0, 3, 2), (0, 5, 2), (0, 1, 3), (0, 2, 3)])
    assert rows(res.seeds, "node", "round") == [(0, 3)]


def test_g8_first_round_h_and_next_graph(spark):
    from linkset.operators.contract import local_minima, min_selection, prune, summarize
    from linkset.operators.graph import normalize
    g = normalize(edges_from_rows(spark, G8))
    h = min_selection(g, local_minima(g))
    got = {}
    for r in h.collect():
        got.setdefault(r["node"], set()).add(r["w"])
    assert got == {0: {0}, 1: {0, 1}, 2: {0, 1, 2}, 3: {3}, 4: {3}, 5: {1, 2, 5},
                   6: {3}, 7: {3, 5}, 8: {2, 3, 5}}
    nxt = prune(h, summarize(h))
    und = {tuple(sorted((r["src"], r["dst"]))) for r in nxt.collect()}
    assert und == {(0, 1), (0, 2), (1, 2), (1, 5), (2, 3), (2, 5), (3, 5)}


def test_g11_components_and_depth(spark):
    res = contract(edges_from_rows(spark, G11))
    tree = rows(res.tree, "parent", "child", "round")
    assert (10, 11, 1) in tree and (10, 13, 1) in tree and (10, 12, 2) in tree
    assert rows(res.seeds, "node", "round") == [(0, 3), (10, 2)]
    lab = propagate_layers(res.tree, res.seeds)
    comp = {r["node"]: r["component"] for r in lab.collect()}
    assert comp == union_find(G11)
    assert max(r["depth"] for r in lab.collect()) == 2


def test_g14_tree_and_depth(spark):
    res = contract(edges_from_rows(spark, G14))
    assert res.rounds == 3
    assert rows(res.tree, "parent", "child") == sorted([
        (2, 8), (3, 4), (3, 7), (6, 15), (6, 16), (10, 11), (10, 13),
        (0, 5), (2, 6), (2, 9), (10, 12), (0, 1), (0, 2), (0, 3)])
    lab = {r["node"]: (r["component"], r["depth"])
           for r in propagate_layers(res.tree, res.seeds).collect()}
    assert lab[15] == (0, 3)
    assert max(d for _, d in lab.values()) == 3


def test_g11_stars_corrected_stop(spark):
    res = star_components(edges_from_rows(spark, G11))
    assert res.rounds == 4
    assert res.pairs.count() == 11
    comp = {r["node"]: r["component"] for r in res.components.collect()}
    assert comp == union_find(G11)
    assert comp[4] == comp[6] == comp[7] == 0


def test_g9_components(spark):
    comp = {r["node"]: r["component"]
            for r in connected_components(edges_from_rows(spark, G9)).collect()}
    assert comp == union_find(G9)
    assert comp[10] == 9


def test_deep_tree_propagation_variants(spark):
    tree = spark.createDataFrame([(0, 1, 1), (1, 2, 1), (2, 3, 1), (3, 4, 1), (9, 10, 1), (10, 11, 1)],
                                 "parent BIGINT, child BIGINT, round INT")
    seeds = spark.createDataFrame([(0, 1), (9, 1)], "node BIGINT, round INT")
    want = {1: 0, 2: 0, 3: 0, 4: 0, 10: 9, 11: 9}
    lay = {r["node"]: (r["component"], r["depth"]) for r in propagate_layers(tree, seeds).collect()}
    assert {k: v[0] for k, v in lay.items() if v[1] > 0} == want
    assert sorted(v[1] for v in lay.values()) == [0, 0, 1, 1, 2, 2, 3, 4]
    jump = {r["node"]: r["component"] for r in propagate_jump(tree, seeds).collect()}
    assert jump == {**want, 0: 0, 9: 9}
    shrink = {r["node"]: r["component"] for r in propagate_shrinking(tree, seeds).collect()}
    assert shrink == want
    naive = propagate_naive(tree, seeds)
    assert naive.count() == 6  # one row per tree row: no duplicates
    bnaive = propagate_naive(tree, seeds, strategy="broadcast")
    assert {r["child"]: r["seed"] for r in bnaive.collect()} == want
    assert {r["child"]: r["seed"] for r in naive.collect()} == want
    assert rows(direct_edges(tree, seeds), "parent", "child") == [(0, 1), (9, 10)]
    assert rows(unresolved_edges(tree, seeds), "parent", "child") == [(1, 2), (2, 3), (3, 4), (10, 11)]


def test_orphan_chain_stops(spark):
    # the top of the chain is missing from seeds: loops must still end
    tree = spark.createDataFrame([(0, 1, 1), (1, 2, 1)], "parent BIGINT, child BIGINT, round INT")
    seeds = spark.createDataFrame([], "node BIGINT, round INT")
    assert propagate_layers(tree, seeds).count() == 0
    assert {r["node"]: r["component"] for r in propagate_jump(tree, seeds).collect()} == {1: 0, 2: 0}
    assert all(r["seed"] is None for r in propagate_naive(tree, seeds).collect())


def test_self_loop_seeds(spark):
    res = contract(edges_from_rows(spark, [(4, 4), (1, 2)]))
    assert rows(res.seeds, "node") == [(1,), (4,)]
    for form in (seeds_antijoin, seeds_except, seeds_outer):
        assert rows(form(res.tree), "node") == [(1,)]
    stars = {r["node"]: r["component"]
             for r in star_components(edges_from_rows(spark, [(4, 4), (1, 2)])).components.collect()}
    assert stars == {1: 1, 2: 1, 4: 4}


def test_path16(spark):
    edges = [(i, i + 1) for i in range(1, 16)]
    res = contract(edges_from_rows(spark, edges))
    assert res.rounds == 4
    lab = propagate_layers(res.tree, res.seeds).collect()
    assert max(r["depth"] for r in lab) == 4
    assert {r["component"] for r in lab} == {1}
    assert star_components(edges_from_rows(spark, edges)).rounds == 5


def test_empty_graph(spark):
    empty = edges_from_rows(spark, [])
    res = contract(empty)
    assert res.rounds == 0 and res.tree.count() == 0 and res.seeds.count() == 0
    assert connected_components(empty).count() == 0
    assert star_components(empty).components.count() == 0


def test_root_lookup_unknown_node(spark):
    comp = connected_components(edges_from_rows(spark, G9))
    asked = spark.createDataFrame([(5,), (10,), (99,)], "node BIGINT")
    got = {r["node"]: r["component"] for r in root_of(asked, comp).collect()}
    assert got == {5: 0, 10: 9, 99: 99}


def test_intermediate_graphs_are_released(spark):
    """Only tree rows, candidates and seeds stay in the workspace: every round's graph is deleted."""
    import os
    res = contract(edges_from_rows(spark, G14))
    root = res.workspace.root
    if root.startswith("file:"):
        root = root[len("file:"):]
    if not os.path.isdir(root):
        return  # not a local folder: nothing to inspect here
    kinds = {d for _, dirs, _ in os.walk(root) for d in dirs if d.startswith("kind=")}
    assert kinds == {"kind=1", "kind=2"}
    assert not [d for d in os.listdir(root) if "sent" in d or "graph" in d]
    assert res.seeds.count() == 2 and res.tree.count() == 14

"""Seeded random graphs against union-find, plus the round invariants.

Many small graphs are packed into one edge table with disjoint id ranges
(G9's idea), so one Spark run checks them all; ids include gaps, negatives,
repeats and self-loops.
"""

import random

import pytest
from graph_tools import union_find

from linkset.operators.contract import contract
from linkset.operators.graph import disjoint_copies, vertices
from linkset.operators.propagate import propagate_jump, propagate_layers
from linkset.operators.stars import star_components
from linkset.sources.edges import edges_from_rows

N_GRAPHS = 60
SPAN = 1000


def random_graphs(seed=7):
    rng = random.Random(seed)
    edges = []
    for k in range(N_GRAPHS):
        n = rng.randint(1, 60)
        ids = rng.sample(range(-SPAN // 2 + 10, SPAN // 2 - 10), n)
        m = rng.randint(0, 90)
        base = k * SPAN
        for _ in range(m):
            a, b = rng.choice(ids), rng.choice(ids)
            if rng.random() < 0.05:
                b = a                       # self-loop
            edges.append((base + a, base + b))
            if rng.random() < 0.1:
                edges.append((base + b, base + a))   # repeat, other direction
    return edges


@pytest.fixture(scope="module")
def packed(spark):
    edges = random_graphs()
    return edges, edges_from_rows(spark, edges)


@pytest.fixture(scope="module")
def contracted(packed):
    return contract(packed[1])


def test_labels_match_union_find(packed, contracted):
    edges, _ = packed
    want = union_find(edges)
    lab = propagate_layers(contracted.tree, contracted.seeds)
    got = {r["node"]: r["component"] for r in lab.collect()}
    assert got == want
    jump = {r["node"]: r["component"]
            for r in propagate_jump(contracted.tree, contracted.seeds).collect()}
    assert jump == want


def test_forest_invariants(packed, contracted):
    edges, _ = packed
    tree = [(r["parent"], r["child"], r["round"]) for r in contracted.tree.collect()]
    seeds = [(r["node"], r["round"]) for r in contracted.seeds.collect()]
    nodes = {x for e in edges for x in e}
    children = [c for _, c, _ in tree]
    assert len(children) == len(set(children))                 # one parent each
    assert all(p < c for p, c, _ in tree)                       # parent < child
    assert len(tree) + len(seeds) == len(nodes)                 # |T| + |S| = |V|
    assert set(children) | {s for s, _ in seeds} == nodes
    want = union_find(edges)
    assert sorted(s for s, _ in seeds) == sorted(set(want.values()))   # seed = component min
    # a node leaves in one round and never comes back
    out_round = {c: r for _, c, r in tree}
    for p, c, r in tree:
        assert p not in out_round or out_round[p] >= r


def test_round_log_totals(contracted):
    tree_rows = sum(r["tree_rows"] for r in contracted.log)
    seed_rows = sum(r["seeds"] for r in contracted.log)
    assert tree_rows == contracted.tree.count()
    assert seed_rows == contracted.seeds.count()
    assert [r["round"] for r in contracted.log] == list(range(1, contracted.rounds + 1))


def test_stars_agree(packed):
    edges, df = packed
    got = {r["node"]: r["component"] for r in star_components(df).components.collect()}
    assert got == union_find(edges)


def test_activity_flags_change_nothing(packed, contracted):
    act = contract(packed[1], activity=True)
    assert sorted(map(tuple, act.seeds.collect())) == sorted(map(tuple, contracted.seeds.collect()))


def test_strategies_agree(packed, contracted):
    want = sorted(map(tuple, contracted.resolved.collect()))
    for strat in ("broadcast", "shuffle"):
        res = contract(packed[1], prune_strategy=strat, seed_strategy=strat)
        assert sorted(map(tuple, res.resolved.collect())) == want


def test_hot_key_split_path(packed, contracted):
    """A threshold of 3 rows makes most nodes 'hot', so the broadcast side of
    the split join does the work; the answer must not change."""
    res = contract(packed[1], hot_threshold=3)
    assert sorted(map(tuple, res.resolved.collect())) == sorted(map(tuple, contracted.resolved.collect()))
    lab = propagate_layers(res.tree, res.seeds, hot_threshold=2)
    assert {r["node"]: r["component"] for r in lab.collect()} == union_find(packed[0])
    stars = star_components(packed[1], hot_threshold=3)
    assert ({r["node"]: r["component"] for r in stars.components.collect()}
            == union_find(packed[0]))


def test_disjoint_copies_multiply_components(spark):
    g = edges_from_rows(spark, [(0, 1), (1, 2), (5, 6)])
    copies = disjoint_copies(g, 4)
    comp = {r["node"]: r["component"]
            for r in propagate_layers(*_tree_seeds(copies)).collect()}
    assert len(set(comp.values())) == 4 * 2
    assert vertices(copies).count() == 4 * 5


def _tree_seeds(edges):
    res = contract(edges)
    return res.tree, res.seeds


def test_id_permutation_keeps_partition(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(50)]
    perm = list(range(41))
    rng.shuffle(perm)
    moved = [(perm[a], perm[b]) for a, b in edges]
    def groups(es):
        res = contract(edges_from_rows(spark, es))
        lab = propagate_layers(res.tree, res.seeds).collect()
        by = {}
        for r in lab:
            by.setdefault(r["component"], set()).add(r["node"])
        return {frozenset(s) for s in by.values()}
    assert {frozenset(perm[x] for x in s) for s in groups(edges)} == groups(moved)

"""Incremental merge over a file stream, and a graph with one dominant hub."""

import os

import pytest
from graph_tools import union_find

from linkset.functions.schema import COMPONENTS, EDGE_TEXT
from linkset.operators.contract import contract
from linkset.operators.merge import merge_components
from linkset.operators.propagate import propagate_layers
from linkset.plans.solve import connected_components
from linkset.plans.workspace import Workspace
from linkset.sources.edges import edges_from_rows
from linkset.streaming.incremental import merge_batch


def test_merge_two_batches(spark):
    a = [(1, 2), (3, 4), (10, 11)]
    b = [(2, 3), (11, 12), (20, 21)]
    ca = connected_components(edges_from_rows(spark, a))
    cb = connected_components(edges_from_rows(spark, b))
    got = {r["node"]: r["component"] for r in merge_components(ca, cb).collect()}
    assert got == union_find(a + b)


def test_stream_of_edge_batches(spark, tmp_path):
    """A job of its own storage: one folder per batch; a replayed batch and a
    restart (state only in the folders) change nothing."""
    ws = Workspace(spark, label="test-stream")
    src_dir = tmp_path / "incoming"
    src_dir.mkdir()
    batches = [[(1, 2), (5, 6)], [(2, 5), (8, 9)], [(9, 1), (30, 31)]]
    for i, batch in enumerate(batches):
        (src_dir / f"b{i}.csv").write_text("".join(f"{a},{b}\n" for a, b in batch))

    def version(i):
        if i < 0:
            return spark.createDataFrame([], COMPONENTS)
        return spark.read.schema(COMPONENTS).parquet(f"{ws.root}/v={i}")

    def fold(batch, batch_id):
        merge_batch(version(batch_id - 1), batch).write.mode("overwrite").parquet(f"{ws.root}/v={batch_id}")

    stream = (spark.readStream.schema(EDGE_TEXT).option("maxFilesPerTrigger", 1)
              .csv(str(src_dir)))
    q = (stream.writeStream.foreachBatch(fold).option("checkpointLocation", f"{ws.root}/ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination(240)
    want = union_find([e for b in batches for e in b])
    assert {r["node"]: r["component"] for r in version(len(batches) - 1).collect()} == want
    last = spark.createDataFrame(batches[-1], EDGE_TEXT)
    again = merge_batch(version(len(batches) - 1), last)
    assert {r["node"]: r["component"] for r in again.collect()} == want


def test_merge_of_many_parts_and_edges(spark):
    parts = [[(1, 2), (3, 4)], [(2, 3), (10, 11)], [(11, 1), (20, 21)], [(4, 20)]]
    new = [(21, 30), (40, 41), (50, 50), (60, None)]
    solved = [connected_components(edges_from_rows(spark, p)) for p in parts]
    extra = spark.createDataFrame(new, EDGE_TEXT)
    want = union_find([e for p in parts for e in p] + [(a, a if b is None else b) for a, b in new])
    got = merge_components(*solved, extra_edges=extra, hot_threshold=2)
    assert {r["node"]: r["component"] for r in got.collect()} == want
    only = merge_components(extra_edges=extra)
    assert {r["node"]: r["component"] for r in only.collect()} == union_find(
        [(a, a if b is None else b) for a, b in new])


def test_merge_leaves_only_its_result(spark, tmp_path):
    before = set(os.listdir(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")))
    a, b = (spark.createDataFrame(x, COMPONENTS) for x in ([(1, 1), (2, 1)], [(2, 2), (3, 2)]))
    ws = Workspace(spark, label="test-merge")
    assert merge_components(a, b, workspace=ws).count() == 3
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    left = {d for d in set(os.listdir(root)) - before if "hot" not in d}
    assert left == {os.path.basename(ws.root)}


def test_dominant_hub(spark):
    """One node holds about a third of all edge rows; the split path handles
    it (threshold lowered so the test graph counts as skewed)."""
    hub_edges = [(0, i) for i in range(1, 1501)]
    chains = [(2000 + i, 2001 + i) for i in range(0, 3000, 1)]
    edges = hub_edges + chains
    df = edges_from_rows(spark, edges)
    res = contract(df, hot_threshold=200)
    lab = propagate_layers(res.tree, res.seeds, hot_threshold=200, rounds=res.rounds)
    got = {r["node"]: r["component"] for r in lab.collect()}
    assert got == union_find(edges)
    plain = contract(df)
    assert sorted(map(tuple, res.resolved.collect())) == sorted(map(tuple, plain.resolved.collect()))


def test_named_components_with_hot_names(spark):
    from linkset.plans.solve import connected_components_named
    rows = [(f"c{i:04d}", "hub") for i in range(300)] + [("x", "y"), ("y", "z")]
    df = spark.createDataFrame(rows, "src STRING, dst STRING")
    got = {r["name"]: r["component"]
           for r in connected_components_named(df, hot_threshold=50).collect()}
    assert got["hub"] == "c0000" and got["c0299"] == "c0000"
    assert got["z"] == "x" and len(got) == 304


def test_isolated_names_are_kept(spark):
    from linkset.plans.solve import connected_components_named
    df = spark.createDataFrame([("a", "b"), ("c", None), (None, "d")], "src STRING, dst STRING")
    got = {r["name"]: r["component"] for r in connected_components_named(df).collect()}
    assert got == {"a": "a", "b": "a", "c": "c"}


def test_unreadable_round_is_an_error(spark, monkeypatch):
    """A storage error must not look like an empty graph."""
    ws = Workspace(spark, label="test-io")
    real = ws.adopt

    def lose(df, path):
        ws.delete(path)
        return real(df, path)
    monkeypatch.setattr(ws, "adopt", lose)
    with pytest.raises(Exception):
        contract(edges_from_rows(spark, [(1, 2), (2, 5), (5, 8), (7, 8), (3, 7), (3, 4), (3, 6)]), workspace=ws)


def test_one_workspace_serves_many_calls(spark):
    ws = Workspace(spark, label="test-reuse")
    for edges in ([(1, 2)], [(3, 4), (4, 5)], []):
        df = spark.createDataFrame(edges, EDGE_TEXT)
        got = connected_components(df, workspace=ws)
        assert {r["node"]: r["component"] for r in got.collect()} == union_find(edges)
        stars = connected_components(df, algorithm="stars", workspace=ws)
        assert {r["node"]: r["component"] for r in stars.collect()} == union_find(edges)


def test_inactive_start_blocks_the_seed_of_its_component_only(spark):
    g = spark.createDataFrame([(1, 2, False), (2, 1, False), (5, 6, True), (6, 5, True)],
                              "src BIGINT, dst BIGINT, active BOOLEAN")
    res = contract(g, normalized=True, activity=True)
    assert [r["node"] for r in res.seeds.collect()] == [5]


def test_hubs_beyond_the_broadcast_bound(spark):
    from linkset.plans.joins import find_hot, join_keyed
    big = spark.createDataFrame([(i % 7, i) for i in range(700)], "k BIGINT, v BIGINT")
    keyed = spark.createDataFrame([(i, i * 10) for i in range(5)], "k BIGINT, w BIGINT")
    hot = find_hot(big, "k", 10)
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(str, big.join(keyed, "k", how).collect()))
        assert sorted(map(str, join_keyed(big, keyed, "k", how, hot=hot).collect())) == want
        assert sorted(map(str, join_keyed(big, keyed, "k", how, hot=hot, max_broadcast_bytes=100).collect())) == want

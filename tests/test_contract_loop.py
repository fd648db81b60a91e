"""The loop of the contraction: one pass a round, counts from the writes, lost drivers, idle nodes."""

import random
import uuid

import pytest
from graph_tools import union_find

from linkset.operators import contract as C
from linkset.operators.graph import normalize
from linkset.operators.stars import star_components
from linkset.plans.session import checkpoint_dir
from linkset.plans.solve import connected_components
from linkset.plans.workspace import Workspace
from linkset.sources.edges import edges_from_rows


def path_graph(n=150, seed=5):
    """One path through shuffled ids: many rounds."""
    ids = list(range(n))
    random.Random(seed).shuffle(ids)
    return list(zip(ids, ids[1:], strict=False))


def found(res):
    return sorted(map(tuple, res.resolved.collect())), res.log


class Lost(Exception):
    pass


@pytest.mark.parametrize("where", ["before a round", "before a commit", "before the seeds"])
def test_goes_on_after_a_lost_driver(spark, monkeypatch, where):
    edges = edges_from_rows(spark, path_graph())
    want = found(C.contract(edges))
    assert len(want[1]) >= 4
    folder = f"{checkpoint_dir(spark)}/resume-{uuid.uuid4().hex}"
    with monkeypatch.context() as m:
        if where == "before a round":
            real = C._Rounds.step
            m.setattr(C._Rounds, "step", lambda self, g, r: real(self, g, r) if r < 3 else _lose())
        elif where == "before the seeds":
            m.setattr(C, "_seeds", lambda *a: _lose())
        else:
            commit = Workspace.commit

            def one(self, number, record):
                if number == 3:
                    _lose()
                commit(self, number, record)
            m.setattr(Workspace, "commit", one)
        with pytest.raises(Lost):
            C.contract(edges, resume=folder)
    ran = []
    real = C._Rounds.step
    monkeypatch.setattr(C._Rounds, "step", lambda self, g, r: (ran.append(r), real(self, g, r))[1])
    nothing = edges_from_rows(spark, [])        # the input is not read again
    assert found(C.contract(nothing, resume=folder)) == want
    assert ran == ([] if where == "before the seeds" else list(range(3, len(want[1]) + 1)))
    assert found(C.contract(nothing, resume=folder)) == want and len(ran) == max(0, len(want[1]) - 2) * bool(ran)
    with pytest.raises(ValueError):
        C.contract(edges, resume=folder, activity=True)


def _lose():
    raise Lost


def test_resume_of_a_whole_solve(spark, monkeypatch):
    pairs = path_graph(60) + [(1000, 1001), (2000, 2000)]
    folder = f"{checkpoint_dir(spark)}/resume-{uuid.uuid4().hex}"
    got = connected_components(edges_from_rows(spark, pairs), resume=folder)
    assert {r["node"]: r["component"] for r in got.collect()} == union_find(pairs)
    again = connected_components(edges_from_rows(spark, []), resume=folder)
    assert {r["node"]: r["component"] for r in again.collect()} == union_find(pairs)
    with pytest.raises(ValueError):
        connected_components(edges_from_rows(spark, pairs), resume=folder, algorithm="stars")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_round_reads_once_and_exchanges_three_times(spark):
    ws = Workspace(spark, label="test-plan")
    rounds = C._Rounds(ws, "auto", False, C.HOT_KEY_ROWS)
    g = rounds.opened(rounds.first(normalize(edges_from_rows(spark, path_graph()))))
    plan = _plan(rounds.rows(g))
    assert plan.count("Exchange") == 3 and plan.count("FileScan") == 1 and "Join" not in plan
    # by joins, with H and the per-node tables written between
    joined = C._Rounds(ws, "shuffle", False, C.HOT_KEY_ROWS)
    assert _plan(joined.rows(g)).count("Exchange") >= 3 and len(joined.used) == 3
    ws.close()


def _jobs(spark, run):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        out = run()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_rounds_run_few_jobs(spark):
    """A round is one write: a job for each exchange and one for the result."""
    edges = edges_from_rows(spark, path_graph())
    res, jobs = _jobs(spark, lambda: C.contract(edges))
    assert jobs <= 4 * res.rounds + 8


def test_hot_nodes_change_nothing(spark):
    pairs = path_graph(40) + [(5, 1000 + i) for i in range(60)] + [(1003, 3000 + i) for i in range(40)]
    edges = edges_from_rows(spark, pairs)
    want = found(C.contract(edges))
    for threshold in (2, 20):
        assert found(C.contract(edges, hot_threshold=threshold)) == want
    assert found(C.contract(edges, hot_threshold=3, prune_strategy="shuffle", seed_strategy="broadcast")) == want


@pytest.mark.parametrize("strategy", ["auto", "shuffle"])
@pytest.mark.parametrize("threshold", [None, 4])
def test_idle_nodes_take_the_seed_of_their_component(spark, strategy, threshold):
    rng = random.Random(3)
    pairs, idle = [], set()
    for c in range(25):
        nodes = rng.sample(range(100 * c, 100 * c + 100), rng.randint(2, 30))
        pairs += [(a, rng.choice(nodes[:i])) for i, a in enumerate(nodes) if i]
        if c % 3 == 0:
            idle.add(rng.choice(nodes))
    label = union_find(pairs)
    lost = {label[i] for i in idle}
    both = {p for a, b in pairs for p in ((a, b), (b, a))}
    g = spark.createDataFrame([(a, b, a not in idle) for a, b in both], "src BIGINT, dst BIGINT, active BOOLEAN")
    res = C.contract(g, normalized=True, activity=True, prune_strategy=strategy, hot_threshold=threshold)
    assert {r["node"] for r in res.seeds.collect()} == set(label.values()) - lost
    plain = C.contract(edges_from_rows(spark, pairs))
    assert sorted(map(tuple, res.tree.collect())) == sorted(map(tuple, plain.tree.collect()))


def test_stars_stop_when_a_round_changes_nothing(spark, monkeypatch):
    """One anti join, in the last round; equal fingerprints are looked at, others are not."""
    from linkset.operators import stars
    asked = []
    real = stars.same_set
    monkeypatch.setattr(stars, "same_set", lambda a, b: (asked.append(a.metrics == b.metrics), real(a, b))[1])
    pairs = path_graph(100)
    res = star_components(edges_from_rows(spark, pairs))
    assert {r["node"]: r["component"] for r in res.components.collect()} == union_find(pairs)
    assert asked == [False] * (len(asked) - 1) + [True] and len(asked) == res.rounds - 1
    by_join = star_components(edges_from_rows(spark, pairs), hot_threshold=2)
    assert by_join.rounds == res.rounds
    assert sorted(map(tuple, by_join.pairs.collect())) == sorted(map(tuple, res.pairs.collect()))


def test_equal_fingerprints_are_confirmed(spark):
    from linkset.operators import stars
    ws = Workspace(spark, label="test-set")
    a, b = (ws.save(spark.createDataFrame(x, "src BIGINT, dst BIGINT"), "s", stars.fingerprint())
            for x in ([(1, 2), (3, 4)], [(3, 4), (1, 2)]))
    assert stars.same_set(a, b)
    c = ws.save(spark.createDataFrame([(1, 2), (4, 3)], "src BIGINT, dst BIGINT"), "s", stars.fingerprint())
    assert a.metrics != c.metrics and not stars.same_set(a, c)
    c.metrics = a.metrics       # as if all 128 bits had met by chance
    assert not stars.same_set(a, c)


def test_commits_are_read_in_order(spark):
    folder = f"{checkpoint_dir(spark)}/commits-{uuid.uuid4().hex}"
    ws = Workspace.at(spark, folder)
    assert ws.commits() == []
    for i in range(12):
        ws.commit(i, {"round": i, "name": "é"})
    assert [r["round"] for r in Workspace.at(spark, folder).commits()] == list(range(12))
    assert Workspace.at(spark, folder).folder("x") != Workspace.at(spark, folder).folder("x")
    ws.close()
    assert Workspace.at(spark, folder).commits() == []

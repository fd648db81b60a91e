"""What is large is made, exchanged and written once: edges, star rounds, lists, a round's tables."""

import random
import re

from graph_tools import union_find

from linkset.operators import contract as C
from linkset.operators import propagate as P
from linkset.operators.graph import adjacency, normalize, undirected
from linkset.operators.lists import id_lists
from linkset.operators.merge import merge_components
from linkset.operators.stars import star_components
from linkset.plans import catalog, workspace
from linkset.plans.joins import HOT_BUCKETS, find_hot
from linkset.plans.solve import connected_components
from linkset.plans.workspace import Workspace, dealt
from linkset.sources.edges import edges_from_rows

PAIRS = [(1, 2), (2, 1), (1, 2), (2, 5), (5, 8), (8, 7), (3, 7), (3, 4), (6, 3), (4, 4), (30, 30)]
ONCE = {(min(p), max(p)) for p in PAIRS}
BOTH = ONCE | {(b, a) for a, b in ONCE}


def rows(df):
    return sorted(map(tuple, df.collect()))


def saved_names(monkeypatch):
    names = []
    real = Workspace.save
    monkeypatch.setattr(Workspace, "save", lambda self, df, name, *a, **k: (names.append(name), real(self, df, name, *a, **k))[1])
    return names


def test_edges_are_distinct_before_they_are_turned(spark):
    g = normalize(edges_from_rows(spark, PAIRS))
    assert rows(g) == sorted(BOTH)
    plan = normalize(spark.range(9).selectExpr("id AS src", "id + 1 AS dst"))._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("Exchange", 1)
    assert "Generate" in above and "Generate" not in below, plan


def test_the_graph_of_a_round_is_held_once(spark):
    ws = Workspace(spark, label="test-once")
    rounds = C._Rounds(ws, "auto", False, C.HOT_KEY_ROWS)
    record = rounds.first(undirected(edges_from_rows(spark, PAIRS)), once=True)
    assert record["rows"] == len(BOTH) and rows(spark.read.parquet(record["path"])) == sorted(ONCE)
    g = rounds.opened(record)
    assert g.rows == len(BOTH) and rows(g.edges) == sorted(BOTH)
    made = rounds.step(g, 1)
    held = rows(spark.read.parquet(f"{made['path']}/kind={C.EDGE}").select("a", "b"))
    assert held and all(a < b for a, b in held)
    assert made["counts"]["edges"] == 2 * len(held) == rounds.opened(made).rows
    ws.close()


def test_hot_keys_are_found_through_their_buckets(spark, monkeypatch):
    limit = HOT_BUCKETS
    big = spark.range(limit + 5000).selectExpr(f"if(id < {limit + 1}, 7, id) AS k")
    assert rows(find_hot(big, "k", limit)) == [(7,)]
    names = saved_names(monkeypatch)
    assert find_hot(big, "k", limit + 1) is None or rows(find_hot(big, "k", limit + 1)) == []
    assert find_hot(spark.range(1000).withColumnRenamed("id", "k"), "k", limit) is None
    assert names[-1] == "full-buckets"      # keys were not counted one by one
    assert rows(find_hot(spark.range(40).selectExpr("id % 3 AS k"), "k", 13)) == [(0,)]


def test_a_star_round_is_one_write(spark, monkeypatch):
    rng = random.Random(4)
    pairs = [(rng.randint(-20, 40), rng.randint(-20, 40)) for _ in range(50)] + [(90, 90)]
    names = saved_names(monkeypatch)
    res = star_components(edges_from_rows(spark, pairs))
    assert names == ["s-g0", *(f"small{r}" for r in range(1, res.rounds + 1)), "star-components"]
    assert rows(res.components) == sorted(union_find(pairs).items())
    hubs = star_components(edges_from_rows(spark, pairs), hot_threshold=3)
    assert rows(hubs.components) == rows(res.components) and hubs.rounds == res.rounds


def test_lists_leave_repeats_out_if_told(spark):
    pairs = [(k, v) for k in (1, 2) for v in range(7 if k == 1 else 2)] * 3
    df = spark.createDataFrame(pairs, "k BIGINT, v BIGINT")
    assert rows(id_lists(df, "k", "v", 4, distinct=True)) == [
        (1, 0, [0, 1, 2, 3]), (1, 1, [4, 5, 6]), (2, 0, [0, 1])]
    assert rows(id_lists(df, "k", "v", 100)) == [(1, 0, sorted(list(range(7)) * 3)), (2, 0, [0, 0, 0, 1, 1, 1])]
    both = adjacency(edges_from_rows(spark, [(5, 1), (5, 1), (5, 0)]))
    assert rows(both) == [(5, 0, [0, 1])]


def small_tables(spark, folder):
    li = spark.createDataFrame([(o, o % 4 + p) for o in range(12) for p in range(2)], "l_orderkey BIGINT, l_partkey BIGINT")
    li.write.parquet(f"{folder}/lineitem.parquet")
    spark.range(14).withColumnRenamed("id", "o_orderkey").write.parquet(f"{folder}/orders.parquet")
    return [(2 * r.l_orderkey, 2 * r.l_partkey + 1) for r in li.collect()]


def test_queries_of_a_round_and_of_roots(spark, tmp_path, monkeypatch):
    pairs = small_tables(spark, str(tmp_path))
    labels = union_find(pairs)
    asked = []
    real = P._labels_of_rounds
    monkeypatch.setattr(P, "_labels_of_rounds", lambda *a: (asked.append(a[2]), real(*a))[1])
    got = rows(catalog.QUERIES["root_lookup"](spark, str(tmp_path)))
    assert got == sorted((2 * o, labels.get(2 * o, 2 * o)) for o in range(14)) and len(asked) == 1
    names = saved_names(monkeypatch)
    nxt = rows(catalog.QUERIES["prune_next_graph"](spark, str(tmp_path)))
    assert names == ["graph", "minima", "sent", "nodes"]
    res = C.contract(edges_from_rows(spark, pairs))
    assert len(nxt) == (res.graph_log[1]["edges"] if res.rounds > 1 else 0)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_distinct_input_is_made_distinct_once(spark):
    pairs = [(1, 2), (2, 1), (1, 2), (5, None), (5, 5), (None, 7), (9, 3), (None, None)]
    df = spark.createDataFrame(pairs, "a BIGINT, b INT")
    assert rows(undirected(df, "a", "b")) == rows(undirected(df.distinct(), "a", "b")) == [(1, 2), (3, 9), (5, 5)]
    given = spark.range(9).selectExpr("id * 2 AS src", "id % 3 * 2 + 1 AS dst").distinct()
    assert plan_of(undirected(given)).count("Exchange") == 1


def test_rows_of_a_round_are_sorted_by_one_column(spark):
    ws = Workspace(spark, label="test-sort")
    rounds = C._Rounds(ws, "auto", False, C.HOT_KEY_ROWS)
    plan = plan_of(rounds.rows(rounds.opened(rounds.first(undirected(edges_from_rows(spark, PAIRS)), once=True))))
    sorts = re.findall(r"Sort \[([^\]]*)\]", plan)
    assert len(sorts) == 2 and not any("," in s for s in sorts), plan
    ws.close()


def test_equal_rows_of_h_lead_to_one_row(spark):
    # every node above 2 sends both minima to its neighbours, many times over
    pairs = [(a, b) for a in (1, 2) for b in range(3, 40)] + [(60, 60), (70, 71)]
    for threshold in (None, 3):
        res = C.contract(edges_from_rows(spark, pairs), hot_threshold=threshold)
        children = [r["child"] for r in res.tree.collect()]
        assert len(children) == len(set(children)) == res.tree_rows == len(union_find(pairs)) - 3
        assert sorted(r["node"] for r in res.seeds.collect()) == [1, 60, 70]


def partitions_at(monkeypatch):
    seen = []
    real = Workspace.save

    def save(self, df, name, *a, **k):
        conf = self.spark.conf
        seen.append((name, int(conf.get("spark.sql.shuffle.partitions")),
                     conf.get("spark.sql.adaptive.coalescePartitions.enabled")))
        return real(self, df, name, *a, **k)
    monkeypatch.setattr(Workspace, "save", save)
    return seen


def test_large_tables_are_dealt_by_their_rows(spark, monkeypatch):
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    own = [spark.conf.get(k) for k in keys]
    cores = spark.sparkContext.defaultParallelism
    pairs = [(i, i + 1) for i in range(0, 60, 3)] + [(i, i + 2) for i in range(0, 60, 5)]
    want = sorted(union_find(pairs).items())
    monkeypatch.setattr(workspace, "ROWS_PER_TASK", 4)
    seen = partitions_at(monkeypatch)
    half = len(pairs) // 2
    got = merge_components(*(connected_components(edges_from_rows(spark, p)) for p in (pairs[:half], pairs[half:])))
    assert rows(got) == want and [spark.conf.get(k) for k in keys] == own
    for name, parts, joined in seen:
        if name in ("known", "pairs", "merged"):
            assert parts % cores == 0 and parts >= 40 // 4 and joined == "false", seen
    assert any(name == "round-1" and parts % cores == 0 and joined == "false" for name, parts, joined in seen), seen
    assert next(x for x in seen if x[0] == "graph")[1:] == (int(own[0]), own[1])


def test_small_tables_are_left_to_the_session(spark, monkeypatch):
    own = spark.conf.get("spark.sql.shuffle.partitions")
    seen = partitions_at(monkeypatch)
    connected_components(edges_from_rows(spark, PAIRS))
    assert {parts for _, parts, _ in seen} == {int(own)}
    try:
        with dealt(spark, workspace.ROWS_PER_TASK * 1000):
            assert int(spark.conf.get("spark.sql.shuffle.partitions")) >= 1000
            raise KeyError
    except KeyError:
        pass
    assert spark.conf.get("spark.sql.shuffle.partitions") == own

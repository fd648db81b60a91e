"""Filtered lookups, broadcasts by size, counts in one scan, and what readers reject."""

import random
from datetime import date

import pytest

from linkset.operators.graph import graph_counts, neighbours
from linkset.operators.propagate import root_of
from linkset.plans import lookup
from linkset.plans.joins import checked_broadcast, join_keyed, row_bytes, table_bytes
from linkset.plans.workspace import Workspace
from linkset.sources.edges import edges_from_rdd, read_edges, read_edges_whitespace, read_string_edges, write_edges


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def edges(spark):
    ws = Workspace(spark, label="test-lookup")
    rows = [(i % 3000, (i * 7) % 5000) for i in range(20_000)]
    yield ws.save(spark.createDataFrame(rows, "src BIGINT, dst BIGINT"), "edges")
    ws.close()


def test_neighbours_are_filtered_where_they_are_read(spark, edges):
    asked = spark.createDataFrame([(i,) for i in (5, 5, 17, 2999, 4000, None)], "node INT")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = neighbours(edges, asked)
        plan = _plan(out)
        got = sorted(map(tuple, out.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == sorted((r.src, r.dst) for r in edges.collect() if r.src in (5, 17, 2999))
    side = plan[plan.index("Exchange"):]
    assert "Filter" in side and "subquery" in side      # below the exchange


def test_filter_holds_what_it_was_made_from(spark):
    rng = random.Random(1)
    ids = [rng.randint(-1 << 62, 1 << 62) for _ in range(3000)] + [0, -1, (1 << 63) - 1, -(1 << 63)]
    frame = spark.createDataFrame([(i,) for i in ids], "id BIGINT")
    bits = lookup.bloom_bits(len(ids))
    words = lookup.bloom_filter(frame, "id", bits).scalar()
    assert frame.where(lookup.might_hold(words, "id", bits)).count() == len(ids)
    other = spark.range(100_000, 200_000)
    assert other.where(lookup.might_hold(words, "id", bits)).count() < 3000


def test_filter_sizes():
    assert lookup.bloom_bits(0) == 64 and lookup.bloom_bits(1) == 64
    assert lookup.bloom_bits(1000) == 16384
    assert lookup.bloom_bits(lookup.MAX_BITS) is None


@pytest.mark.parametrize("most", [None, 64])
def test_roots_with_and_without_a_filter(spark, monkeypatch, most):
    if most:
        monkeypatch.setattr(lookup, "MAX_BITS", most)
    comp = spark.createDataFrame([(i, i % 10) for i in range(5000)], "node BIGINT, component BIGINT")
    asked = spark.createDataFrame([(i,) for i in range(4990, 5010)], "node BIGINT")
    got = {r["node"]: r["component"] for r in root_of(asked, comp).collect()}
    assert got == {i: i % 10 if i < 5000 else i for i in range(4990, 5010)}
    nobody = root_of(asked.limit(0), comp)
    assert nobody.count() == 0


def test_wide_sides_are_shuffled(spark):
    """Few rows, many bytes: what counts is the size."""
    big = spark.createDataFrame([(i % 50, i) for i in range(500)], "k BIGINT, v BIGINT")
    narrow = spark.range(50).selectExpr("id AS k", "id AS name")
    wide = spark.range(50).selectExpr("id AS k", "repeat('name', 20000) AS name")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        for side, kind in ((narrow, "BroadcastHashJoin"), (wide, "SortMergeJoin")):
            out = join_keyed(big, side, "k", strategy="broadcast", max_broadcast_bytes=1 << 20)
            assert kind in _plan(out)
            assert out.count() == 500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert checked_broadcast(wide, 1 << 20) is None and checked_broadcast(narrow, 1 << 20) is not None


def test_row_sizes(spark):
    df = spark.createDataFrame(
        [(1, "é" * 10, bytearray(7), [1, 2, 3], ["ab"], (1, "x"), date(2020, 1, 1)), (None,) * 7],
        "`a b` INT, s STRING, y BINARY, n ARRAY<BIGINT>, t ARRAY<STRING>, r STRUCT<p: INT, q: STRING>, d DATE")
    size = [r[0] for r in df.select(row_bytes(df.schema)).collect()]
    assert size[1] == 16 + 8 * 7
    assert size[0] == size[1] + 20 + 7 + 24 + len('["ab"]') + len('{"p":1,"q":"x"}')
    assert table_bytes(df) == sum(size) and table_bytes(df.limit(0)) == 0


def test_counts_take_one_scan(spark, edges):
    out = graph_counts(edges)
    assert _plan(out).count("FileScan") == 1
    rows = edges.collect()
    assert tuple(out.first()) == (len(rows), len(set(map(tuple, rows))), len({x for r in rows for x in r}))
    assert tuple(graph_counts(edges.limit(0)).first()) == (0, 0, 0)
    odd = spark.createDataFrame([(None, 1), (1, None), (1, 1), (1, 1)], "src BIGINT, dst BIGINT")
    assert graph_counts(odd).first()["edge_rows"] == 4


def test_rdd_pairs_travel_in_batches(spark):
    pairs = [(i, i * i) for i in range(1000)] + [(-5, None), (1 << 62, -(1 << 62))]
    df = edges_from_rdd(spark, spark.sparkContext.parallelize(pairs, 3), batch=64)
    assert df.schema.simpleString() == "struct<src:bigint,dst:bigint>"
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, pairs))
    assert "MapInArrow" in _plan(df)
    # one row for each batch is what the Python side hands over
    few = df._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD[src#" in few and "alone#" in few
    assert edges_from_rdd(spark, spark.sparkContext.parallelize([], 2)).count() == 0
    with pytest.raises(Exception):
        edges_from_rdd(spark, spark.sparkContext.parallelize([(1, "x")])).collect()


BAD = "1,2\nx,3\n\n4,\n7\n,8\n# no line\n99999999999999999999,1\n 5 , 6 , z\n"


def test_rejected_lines_are_a_table(spark, tmp_path):
    (tmp_path / "one.csv").write_text(BAD)
    (tmp_path / "two.csv").write_text("8,9\nnope\n")
    found = read_edges(spark, str(tmp_path), on_bad="keep")
    assert sorted(map(tuple, found.edges.collect())) == [(1, 2), (5, 6), (7, 7), (8, 9)]
    got = sorted((r.file.rsplit("/", 1)[1], r.line, r.reason) for r in found.rejected.collect())
    assert got == [("one.csv", ",8", "first field is no id"), ("one.csv", "4,", "second field is no id"),
                   ("one.csv", "99999999999999999999,1", "first field is no id"),
                   ("one.csv", "x,3", "first field is no id"), ("two.csv", "nope", "first field is no id")]
    white = read_edges_whitespace(spark, str(tmp_path / "two.csv"), on_bad="keep")
    assert {r.line for r in white.rejected.collect()} == {"8,9", "nope"} and white.edges.count() == 0
    with pytest.raises(ValueError):
        read_edges(spark, str(tmp_path), on_bad="skip")


def test_names_are_what_stands_between_separators(spark, tmp_path):
    path = tmp_path / "names.csv"
    path.write_text('"a,b\n"q,r",s\n a , b \nback\\,slash\nalone\nend,\n# c,d\n')
    got = sorted(map(repr, map(tuple, read_string_edges(spark, str(path)).collect())))
    assert got == sorted(map(repr, [('"a', "b"), ('"q', 'r"'), (" a ", " b "), ("back\\", "slash"), ("alone", None),
                                    ("end", None), ("# c", "d")]))
    assert read_string_edges(spark, str(path), isolated=False, comment="#").count() == 4
    path.write_text("a,b\n,e\n")
    with pytest.raises(Exception, match="first name is empty"):
        read_string_edges(spark, str(path)).collect()
    found = read_string_edges(spark, str(path), on_bad="keep")
    assert [tuple(r) for r in found.edges.collect()] == [("a", "b")]
    assert [r.line for r in found.rejected.collect()] == [",e"]
    assert read_string_edges(spark, str(path), on_bad="drop").count() == 1


def test_names_written_and_read_back(spark):
    ws = Workspace(spark, label="test-names")
    e = spark.createDataFrame([("x", "y"), ("é z", "w")], "src STRING, dst STRING")
    write_edges(e, f"{ws.root}/names")
    assert sorted(map(tuple, read_string_edges(spark, f"{ws.root}/names").collect())) == [("x", "y"), ("é z", "w")]

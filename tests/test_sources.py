"""Readers and writers."""

import pytest

from linkset.operators.graph import adjacency, adjacency_text, as_edges, disjoint_copies, normalize
from linkset.operators.ids import dense_ids, node_names, relabel
from linkset.plans.workspace import Workspace
from linkset.sources.edges import (read_edges, read_edges_whitespace, read_string_edges,
                                   write_adjacency_text, write_edges)


def _write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_ragged_and_isolated_lines(spark, tmp_path):
    path = _write(tmp_path, "e.csv", "1,2,9\n2,3\n7\n# comment\n5,6,x,y\n")
    got = sorted(map(tuple, read_edges(spark, path).collect()))
    assert got == [(1, 2), (2, 3), (5, 6), (7, 7)]
    assert sorted(map(tuple, read_edges(spark, path, isolated=False).collect())) == [
        (1, 2), (2, 3), (5, 6)]


def test_whitespace_reader(spark, tmp_path):
    path = _write(tmp_path, "e.txt", "  1 \t 2\n3\t4  extra\n\n8\n\t5\t6\n\t\n")
    got = sorted(map(tuple, read_edges_whitespace(spark, path).collect()))
    assert got == [(1, 2), (3, 4), (5, 6), (8, 8)]


@pytest.mark.parametrize("sep,text", [
    (",", "1, 2\n 3 ,4 , 9\n 5\n-6,+7\n"), ("tab", " 1\t2 \n3 \t 4\t9\n5\t\n-6\t7\n"),
    ("space", "1  2\n 3 4 9\n5 \n-6 7\n"), ("|", "1|2\n3 | 4|9\n5\n-6|7\n")])
def test_blanks_around_ids_do_not_matter(spark, tmp_path, sep, text):
    got = sorted(map(tuple, read_edges(spark, _write(tmp_path, "p.txt", text), sep).collect()))
    assert got == [(-6, 7), (1, 2), (3, 4), (5, 5)]


@pytest.mark.parametrize("line", ["5,abc", "1.0,9", "8 bad", ",3", "4,", "99999999999999999999,1", "x"])
def test_bad_lines(spark, tmp_path, line):
    path = _write(tmp_path, "b.csv", f"1,2\n{line}\n3,4\n")
    with pytest.raises(Exception, match="not an edge line"):
        read_edges(spark, path).collect()
    got = sorted(map(tuple, read_edges(spark, path, on_bad="drop").collect()))
    assert got == [(1, 2), (3, 4)]


def test_ids_must_be_integers(spark):
    for kind in ("double", "string", "decimal(10,2)"):
        with pytest.raises(TypeError):
            as_edges(spark.createDataFrame([(1, 2)], "src INT, dst INT").selectExpr(
                f"CAST(src AS {kind}) AS src", "dst"))
    assert as_edges(spark.createDataFrame([(1, None)], "src INT, dst SMALLINT")).first() == (1, 1)


def test_lists_are_cut_by_position(spark):
    far = [5 << 20, 6 << 20, 9 << 20, 1 << 50]
    e = spark.createDataFrame([(7, x) for x in far] + [(8, 1)] + [(9, x * 1000) for x in range(25)],
                              "src BIGINT, dst BIGINT")
    one = {(r.node, r.block): r.nn for r in adjacency(e).collect()}
    assert one == {(7, 0): far, (8, 0): [1], (9, 0): [x * 1000 for x in range(25)]}
    cut = {(r.node, r.block): r.nn for r in adjacency(e, per_row=10).collect()}
    assert cut == {(7, 0): far, (8, 0): [1], (9, 0): [x * 1000 for x in range(10)],
                   (9, 1): [x * 1000 for x in range(10, 20)], (9, 2): [x * 1000 for x in range(20, 25)]}


def test_copies_never_touch(spark):
    e = spark.createDataFrame([(-5, 1), (3, 1)], "src BIGINT, dst BIGINT")
    copies = disjoint_copies(e, 3).collect()
    assert len({x for r in copies for x in r}) == 9


def test_write_and_read_back(spark):
    ws = Workspace(spark, label="test-io")
    e = spark.createDataFrame([(1, 2), (3, 4)], "src BIGINT, dst BIGINT")
    for fmt, sep in (("csv", ","), ("csv", "\t"), ("csv", " ")):
        path = f"{ws.root}/{fmt}-{ord(sep)}"
        write_edges(e, path, fmt, sep)
        assert sorted(map(tuple, read_edges(spark, path, sep).collect())) == [(1, 2), (3, 4)]
    write_edges(e, f"{ws.root}/pq", "parquet")
    assert spark.read.parquet(f"{ws.root}/pq").count() == 2


def test_adjacency_text_sink(spark):
    ws = Workspace(spark, label="test-adj")
    e = normalize(spark.createDataFrame([(1, 3), (1, 2)], "src BIGINT, dst BIGINT"))
    path = f"{ws.root}/adj"
    write_adjacency_text(adjacency_text(e), path)
    lines = sorted(r["value"] for r in spark.read.text(path).collect())
    assert lines == ["1\t2;3", "2\t1", "3\t1"]


def test_dense_ids_and_relabel(spark, tmp_path):
    path = _write(tmp_path, "s.csv", "bob,alice\ncarol,bob\nzed,yan\n")
    e = read_string_edges(spark, path)
    ids = {r["name"]: r["id"] for r in dense_ids(node_names(e), partitions=3).collect()}
    assert ids == {n: i for i, n in enumerate(sorted(["alice", "bob", "carol", "yan", "zed"]))}
    rel = sorted(map(tuple, relabel(e, dense_ids(node_names(e))).collect()))
    assert rel == sorted([(ids["bob"], ids["alice"]), (ids["carol"], ids["bob"]),
                          (ids["zed"], ids["yan"])])

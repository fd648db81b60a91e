"""Each registered query on the smallest tables; those with SQL, against it."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
TABLES = ("documents", "embeddings", "pages", "labels", "benchmark")


def test_one_query_per_operator():
    assert [int(n[2:].split("_")[0]) for n in NAMES] == list(range(1, 14))
    assert "pipeline" in entry.queries()


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    df = entry.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    whole = {"op1": "pages", "op3": "embeddings"}.get(name.split("_")[0], "documents")
    if not name.startswith("op11_"):        # 20 rows an item, at most
        assert len(got) == con.execute(f"SELECT count(*) FROM {whole}").fetchall()[0][0]
    if name not in entry.oracle_sql():
        return
    res = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    order = [cols.index(c) for c in df.columns]
    rnd = lambda v: round(v, 6) if isinstance(v, float) else v
    want = [tuple(rnd(r[i]) for i in order) for r in res.fetchall()]
    assert sorted((tuple(map(rnd, r)) for r in got), key=repr) == sorted(want, key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() < 3 * before and {"doc_id", "text", "bucket", "batch", "slot"} <= set(out.columns)

"""Each stage of the pipeline, and the whole, against brute force on a small corpus."""

import random
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from linkset.llm import mixing, packing, pii, quality
from llm_brute import base_pii, base_quality, simhash_components, simhash_print

COLUMNS = corpus_pipeline.DOC_COLUMNS
STAGES = dict(corpus_pipeline.STAGES)


def corpus():
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    rows = []
    for i in range(60):
        rows.append((i, text(rng.randint(40, 120)), rng.choice(["en", "de"]), rng.choice(["web", "news", "books"])))
    for i in range(60, 75):         # near copies: a word more at the end
        rows.append((i, rows[i - 60][1] + " end", "en", "web"))
    rows += [(80 + i, rows[3][1], "en", "news") for i in range(4)]
    rows += [(90, "too short", "en", "web"), (91, "x y z w v " * 40, "en", "web"), (92, "", "en", "web"), (93, None, "en", None)]
    for i in range(94, 104):
        rows.append((i, text(30) + f" write to user{i}@mail.example.org or call +49 30 12345{i:03d} " + text(30), "en", "web"))
    rows += [(104, text(50) + " 10.0.0.1 and 4111 1111 1111 1111 " + text(20), "de", "books")]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def stages(spark):
    """What every stage got and what it returned, rows as tuples."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(corpus(), schema)
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, "")
        rows = [r.asDict() for r in made.collect()]
        out[name] = ([r.asDict() for r in docs.collect()], rows, made.columns)
        if name != corpus_pipeline.STAGES[-1][0]:
            docs = spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], schema)
    return out


def key(r):
    return tuple(r[c] for c in COLUMNS)


def sql(query, rows):
    import pyarrow as pa
    documents = pa.table({c: [r[c] for r in rows] for c in COLUMNS}, pa.schema(
        [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]))
    con = duckdb.connect()
    con.register("documents", documents)
    res = con.execute(query)
    names = [d[0] for d in res.description]
    return [dict(zip(names, r, strict=True)) for r in res.fetchall()]


def test_all_but_the_last_return_documents(stages):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name][2] == COLUMNS


def test_quality_rules(stages):
    before, after, _ = stages["quality_rules"]
    kept = {r["doc_id"] for r in sql(quality.OP5_SQL, before) if r["kept"]}
    assert Counter(map(key, after)) == Counter(key(r) for r in before if r["doc_id"] in kept)
    left = {r["doc_id"] for r in after}
    assert not any(base_quality(r["text"])[-1] and r["doc_id"] in left for r in before)
    assert {90, 91, 92, 93}.isdisjoint(left) and len(after) > 60        # the junk, and little else


def test_near_duplicates(stages):
    before, after, _ = stages["simhash_near_dedup"]
    before = sorted(before, key=lambda r: r["doc_id"])
    group = simhash_components([simhash_print(r["text"]) for r in before])
    assert sorted(map(key, after)) == sorted(key(before[g]) for g in sorted(set(group)))
    assert len(after) < len(before) - 3


def test_private_data(spark, ws, stages):
    before, after, _ = stages["pii"]
    docs = spark.createDataFrame([(r["doc_id"], r["text"]) for r in before], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.find_pii(docs, ws).collect()}
    text = {r["doc_id"]: r["text"] for r in after}
    assert len(after) == len(before)
    masked = 0
    for r in before:
        own = [(int(a), int(z), k) for k, a, z in (s.split(":") for s in spans[r["doc_id"]].split(",") if s)]
        for a, k, z, kind in base_pii(r["text"]):
            assert (a, z, kind) in own
        want, at = [], 0
        for a, z, k in own:
            if a >= at:
                want += [r["text"][at:a], f"[{k.upper()}]"]
            at = max(at, z)
        want = "".join(want) + r["text"][at:]
        assert text[r["doc_id"]] == want
        masked += want != r["text"]
    assert masked == sum(bool(spans[r["doc_id"]]) for r in before) >= 11
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_source_mix(stages):
    before, after, _ = stages["source_mix"]
    copies = {r["doc_id"]: r["taken"] // r["size"] for r in sql(mixing.OP7_SQL, before) if r["size"]}
    assert Counter(map(key, after)) == Counter({key(r): copies[r["doc_id"]] for r in before if copies[r["doc_id"]]})


def test_length_batches(stages):
    before, after, _ = stages["length_batches"]
    assert Counter((r["doc_id"], r["text"]) for r in after) == Counter((r["doc_id"], r["text"]) for r in before)
    assert all(r["length"] == len(r["text"].split()) and 0 <= r["padding"] == r["bucket_len"] - r["length"] for r in after)
    lengths = sorted(r["length"] for r in after)
    values = sorted(set(lengths))
    cost = lambda i, j: sum(values[j] - x for x in lengths if values[i] <= x <= values[j])
    m = len(values)
    best = [cost(0, j) for j in range(m)]
    for _ in range(1, packing.BUCKETS):
        best = [min([best[j]] + [best[i - 1] + cost(i, j) for i in range(1, j + 1)]) for j in range(m)]
    assert sum(r["padding"] for r in after) == best[-1]
    batches = Counter((r["bucket"], r["batch"]) for r in after)
    rooms = {(r["bucket"], r["batch"]): max(1, packing.TOKEN_BUDGET // max(1, r["bucket_len"])) for r in after}
    assert all(n <= rooms[b] for b, n in batches.items())
    assert len({(r["bucket"], r["batch"], r["slot"]) for r in after}) == len(after)


def test_run_is_the_stages_in_a_row(spark, ws, stages):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long")
    docs.selectExpr("*", "'x' AS _h", "1 AS key", "'y' AS bucket").write.parquet(f"{ws.root}/documents.parquet")
    got = corpus_pipeline.run(spark, ws.root)
    rows = [r.asDict() for r in got.collect()]
    want = stages["length_batches"][1]
    same = lambda rs: Counter((r["doc_id"], r["text"], r["length"], r["bucket"], r["bucket_len"]) for r in rs)
    assert same(rows) == same(want) and corpus_pipeline.ORACLE_SQL is None


def test_nulls_repeats_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    plain = corpus()[0]
    odd = [plain, plain, (None, plain[1], None, None, None), (None, None, None, None, None), (None, None, None, None, None),
           (5, "", "", "", 0), (5, "w " * 30_000, "en", "web", 60_000)]
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(odd, schema).selectExpr("*", "1 AS _h", "'k' AS _k", "2 AS n", "3 AS size")
        out = stage(spark, docs, "")
        rows = out.collect()
        if name in ("pii", "length_batches"):
            assert len(rows) == len(odd)
        elif name == "simhash_near_dedup":      # one text, one empty text, one very long one
            assert sorted(len(r.text or "") for r in rows) == sorted([0, len(plain[1]), 60_000])
        assert stage(spark, docs.limit(0), "").count() == 0, name

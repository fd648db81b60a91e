import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from linkset.llm import files, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(rows, items, k):
    docs = [(i, Counter(terms(t))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, total = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    asked = {}
    for key, t in items:
        asked.setdefault(key, []).extend(terms(t))
    out = []
    for key, query in asked.items():
        ranked = []
        for i, c, n in docs:
            m = 75 + 25 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in query if c[t])
            if s > 0:
                ranked.append((-s, i is not None, i or 0))
        out += [(repr(key), r, repr(i if known else None), -s)
                for r, (s, known, i) in enumerate(sorted(ranked)[:k], 1)]
    return sorted(out)


def corpus(seed, n):
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(8)]
    rare = [f"R{i}é" for i in range(80)] + ["naïve", "日本", "x"]
    text = lambda k: rng.choice([" ", "-", "\n", ", "]).join(
        rng.choice(common if rng.random() < 0.6 else rare) for _ in range(k))
    rows = [(i, text(rng.randint(0, 60))) for i in range(n)]
    rows += [(None, text(20)), (None, rows[3][1]), (7, rows[7][1]), (7, text(9)), (n, None), (n + 1, ""),
             (n + 2, "!?\x00"), (n + 3, "c0 " * 100_000), (-5, "C1 c2")]
    rows += [(n + 10 + i, rows[5][1]) for i in range(40)]      # ties
    rng.shuffle(rows)
    items = [(i, text(rng.randint(1, 30))) for i in range(12)]
    return rows, items + [(3, "R1é R1é c1"), (None, "c1 R2é"), (None, "R3é"), (50, None), (51, " "), (52, "unknown"),
                          (53, "c0"), (54, rows[0][1])]


@pytest.mark.parametrize("shard,block,share,terms_a_block", [
    (16 << 20, 512, 4, 1 << 18), (3000, 16, 4, 1 << 18), (9000, 8, 1, 40), (2000, 4, 10 ** 9, 1 << 18)])
def test_matches_brute_force(spark, ws, docs, monkeypatch, shard, block, share, terms_a_block):
    for name, v in (("SHARD_BYTES", shard), ("BLOCK_DOCS", block), ("SHORT_SHARE", share), ("POSTINGS", 37),
                    ("QUERY_TERMS", terms_a_block)):
        monkeypatch.setattr(search, name, v)
    rows, items = corpus(block, 300)
    index = search.build_index(docs(rows), f"{ws.root}/postings", ws)
    queries = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS rank", "1 AS score")
    got = search.search(index, queries, ws, k=7).collect()
    assert sorted((repr(r.item_id), r["rank"], repr(r.doc_id), r.score) for r in got) == brute(rows, items, 7)


def shard_of(tmp_path, ids, texts, batch_rows):
    """What one shard's writer puts into its files and its dictionary."""
    writer = search.ShardWriter(f"file://{tmp_path}")
    whole = pa.record_batch([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    for i in range(0, len(ids), batch_rows):
        writer.add(*whole.slice(i, batch_rows).columns)
    entries = [r for b in writer.flush() for r in b.to_pylist()]
    uri, = {r.pop("uri") for r in entries}
    held = [pa.ipc.open_file(files.open_random(f"{uri}.{part}")).read_all().to_pydict() for part in ("docs", "postings")]
    return entries, *held


@pytest.mark.parametrize("piece", [1, 40, 700, 1 << 20])
def test_pieces_of_any_size_give_the_same_shard(tmp_path, monkeypatch, piece):
    rows, _ = corpus(3, 60)
    ids, texts = zip(*((i, t or "") for i, t in rows), strict=True)
    monkeypatch.setattr(search, "PIECE_BYTES", piece)
    monkeypatch.setattr(search, "POSTINGS", 50)
    entries, docs, postings = shard_of(tmp_path, ids, texts, 17)
    order = sorted(range(len(ids)), key=lambda i: search.NO_ID if ids[i] is None else ids[i])
    counts = [Counter(terms(texts[i])) for i in order]
    assert docs == {"doc_id": [ids[i] for i in order], "n": [c.total() for c in counts]}
    assert entries[-1] == {"term": None, "df": sum(map(bool, counts)), "at": sum(c.total() for c in counts)}
    assert {e["term"] for e in entries[:-1]} == {t for c in counts for t in c} and len(set(map(str, entries))) == len(entries)
    for e in entries[:-1]:
        there = slice(e["at"], e["at"] + e["df"])
        want = [(d, c[e["term"]]) for d, c in enumerate(counts) if c[e["term"]]]
        assert list(zip(postings["doc"][there], postings["tf"][there], strict=True)) == want


def test_a_writer_holds_counts_not_texts(tmp_path):
    """A shard's writer keeps no batch and no string of each term, and numbers few terms at a time (F1)."""
    text, n = "ab c d " * 5000, 200                                 # 7 MB, 3 million terms
    before = pa.total_allocated_bytes()
    writer = search.ShardWriter(f"file://{tmp_path}")
    tracemalloc.start()
    for i in range(0, n, 50):
        writer.add(pa.array(range(i, i + 50), pa.int64()), pa.array([text] * 50, pa.string()))
    assert pa.total_allocated_bytes() - before < 1 << 20
    assert [r for b in writer.flush() for r in b.select(["term", "df", "at"]).to_pylist()] == [
        {"term": t, "df": n, "at": n * i} for i, t in enumerate(["ab", "c", "d"])] + [
        {"term": None, "df": n, "at": n * 15_000}]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 << 20


@pytest.mark.parametrize("seed", range(8))
def test_skipping_changes_nothing(seed):
    """Blocks and candidates that are skipped could not have been among the best."""
    rng = np.random.default_rng(seed)
    n, k = 2000, int(rng.integers(1, 30))
    shard = object.__new__(search.Shard)
    shard.ids = pa.array(range(n))
    shard.cuts = np.append(np.arange(0, n, 64), n)
    full = np.zeros(n, np.int64)
    shard.lists, query = {}, []
    for t in range(int(rng.integers(1, 14))):
        size = int(rng.choice([3, 40, 500, 1900]))
        doc = np.sort(rng.choice(n, size, replace=False))
        score = rng.integers(0, 50, size) * int(rng.choice([1, 20]))
        shard.lists[str(t)] = search.Postings(doc, score, shard.cuts)
        q = int(rng.integers(1, 3))
        query.append((str(t), q))
        full[doc] += q * score
    place, score = shard.best([*query, ("none", 1)], k)
    want = [i for i in np.lexsort((np.arange(n), -full)) if full[i] > 0][:k]
    assert place.tolist() == want and score.tolist() == full[want].tolist()


def test_terms_are_those_of_the_pattern():
    texts = ["", "A", "aB-cD é\x00ß_9{}", "\x7fx\x0b", "日本 語", "[\\]^_`abc~"]
    flat, first = search.split_terms(pa.array(["skip", *texts]).slice(1))
    got = flat.to_pylist()
    assert [got[a:z] for a, z in zip(first[:-1], first[1:], strict=True)] == [terms(t) for t in texts]


def test_empty_tables(spark, ws, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a")], "item_id long, text string")
    empty = search.build_index(docs([]), f"{ws.root}/e", ws)
    assert search.search(empty, some, ws).count() == 0
    blank = search.build_index(docs([(1, None), (2, " ")]), f"{ws.root}/b", ws)
    assert search.search(blank, some, ws).count() == 0
    one = search.build_index(docs([(1, "a")]), f"{ws.root}/o", ws)
    out = search.search(one, none, ws)
    assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0

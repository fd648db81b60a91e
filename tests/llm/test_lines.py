import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from linkset.llm import lines

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_chars, min_docs):
    key = lambda line: line.strip(BLANK).translate(LOWER)
    rank = lambda i: float("-inf") if i is None else i
    where = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            where[key(line)].add(rank(i))
    out = []
    for i, t in rows:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if len(key(x)) < min_chars or len(where[key(x)]) < min_docs
                or rank(i) == max(where[key(x)])]
        out.append((repr(i), len(all_), len(all_) - len(kept), "\n".join(kept)))
    return sorted(out)


def corpus(seed, n=60):
    rng = random.Random(seed)
    pool = ["Shared line %d é %s" % (i, "x" * (i % 7)) for i in range(12)] + ["", " ", " ", " wide"]
    vary = lambda s: rng.choice(["", " ", "\t\x0b"]) + rng.choice([s, s.upper(), s.lower()]) + rng.choice(["", "\r", " \x0c"])
    out = [None, "", "\n", "one", "\n\n" + pool[0]]
    for i in range(n):
        own = [f"line {i} {j} of its own" for j in range(rng.randint(0, 4))]
        got = own + [vary(rng.choice(pool)) for _ in range(rng.randint(0, 9))]
        rng.shuffle(got)
        out.append("\n".join(got))
    return out + [out[7], out[7], "\n".join([pool[1]] * 500), "é" * 200_000 + "\n" + pool[2]]


@pytest.mark.parametrize("many_ranges", [False, True])
@pytest.mark.parametrize("min_chars,min_docs", [(40, 5), (8, 5), (1, 2), (8, 1)])
def test_matches_brute_force(spark, ws, docs, min_chars, min_docs, many_ranges):
    texts = corpus(min_chars)
    rows = list(enumerate(texts)) + [(None, texts[8]), (None, texts[8]), (None, texts[9]), (3, texts[10]), (3, texts[10])]
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions",
                                           "spark.sql.adaptive.coalescePartitions.enabled")}
    if many_ranges:     # a key spans several ranges
        for k, v in zip(held, ("61", "false"), strict=True):
            spark.conf.set(k, v)
    try:
        got = lines.without_repeated_lines(docs(rows), ws, min_chars, min_docs).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert sorted((repr(r.doc_id), r.n_lines, r.n_dropped, r.kept) for r in got) == brute(rows, min_chars, min_docs)


@pytest.mark.parametrize("seed", range(6))
def test_any_cut_of_the_stream(seed):
    """Ranges and batches may end anywhere, also inside a key or a document."""
    rng = random.Random(seed)
    rows = sorted((rng.choice([1, 2, 2, 2, 3, 4]), rng.randint(0, 1), -rng.randint(0, 9), 0, p) for p in range(300))
    min_docs = rng.choice([1, 3, 5, 9])
    docs_of = defaultdict(set)
    for hi, lo, d, _, _ in rows:
        docs_of[hi, lo].add(-d)
    want = sorted((-d, p) for hi, lo, d, _, p in rows
                  if len(docs_of[hi, lo]) >= min_docs and -d != max(docs_of[hi, lo]))

    def cut(x, n):
        at = sorted(rng.sample(range(1, len(x)), min(n, len(x) - 1)))
        return [x[a:b] for a, b in zip([0, *at], [*at, len(x)], strict=True)]

    drop, open_, ends = [], [], defaultdict(set)
    for part in cut(rows, rng.choice([1, 3, 40])):
        batches = []
        for b in cut(part, rng.choice([1, 5])):
            hi, lo, d, h, p = (np.array(c, np.int64) for c in zip(*b, strict=True))
            batches.append(pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (hi, lo, -d, h, p.astype(np.int32), np.zeros(len(p), np.int32))],
                names=lines.LINE))
        for out in lines.first_occurrences(iter(batches), min_docs):
            for r in out.to_pylist():
                if r["kind"] == "drop":
                    drop.append((r["doc"], r["pos"]))
                elif r["kind"] == "open":
                    open_.append(r)
                else:
                    ends[r["hi"], r["lo"]].add(r["doc"])
    for r in open_:
        e = ends[r["hi"], r["lo"]]
        if len(e) >= min_docs and r["doc"] != max(e):
            drop.append((r["doc"], r["pos"]))
    assert sorted(drop) == want


def test_bitmaps_without_texts(spark, ws, docs):
    """Only documents that lose lines have a bitmap, a small one."""
    line = "a line that many of the documents of this table hold"
    text = "\n".join([line] + [f"own {i}" for i in range(5000)])
    rows = [(i, text if i == 0 else line) for i in range(6)]
    maps = {r.doc: r for r in lines.keep_bitmaps(lines.keyed(docs(rows)), ws).collect()}
    assert sorted(maps) == [0, 1, 2, 3, 4]
    assert maps[0].n_lines == 5001 and maps[0].n_dropped == 1 and len(maps[0].keep) < 40
    kept = lines.kept_lines(text.encode(), bytes(maps[0].keep))
    assert hashlib.sha256(b"\n".join(kept)).hexdigest() == hashlib.sha256(text.split("\n", 1)[1].encode()).hexdigest()


def test_empty_table(ws, docs):
    out = lines.without_repeated_lines(docs([]), ws)
    assert out.columns == ["doc_id", "n_lines", "n_dropped", "kept"] and out.count() == 0

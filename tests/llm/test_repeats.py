import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from linkset.llm import repeats


def brute(texts, window):
    docs = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in docs for i in range(len(w) - window + 1))
    out = []
    for w in docs:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def corpus(seed, window):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)] + ["é", "😀"]
    text = lambda n: rng.choices(words, k=n)
    shared = [text(rng.randint(window - 2, 3 * window)) for _ in range(4)]
    out = [None, "", " ", "one", " ".join(["same"] * 200), "\x0b lead and \x0c trail \t"]
    for _ in range(60):
        w = text(rng.randint(0, 120))
        if rng.random() < 0.6:
            p = rng.choice(shared)
            a = rng.randint(0, 3)
            w[rng.randint(0, len(w)):0] = p[a:len(p) - rng.randint(0, 3)]
        out.append(rng.choice([" ", "\n", " \t"]).join(w))
    return out + [out[10], out[10]]


@pytest.mark.parametrize("window,gram", [(35, 8), (10, 4), (8, 8)])
@pytest.mark.parametrize("hot", [False, True])
def test_matches_brute_force(spark, ws, docs, window, gram, hot, monkeypatch):
    if hot:      # every anchor that is seen more than eight times is dealt by window
        monkeypatch.setattr(repeats, "HOT_SHARE", 10 ** 9)
        monkeypatch.setattr(repeats, "BATCH", 7)
    texts = corpus(window, window)
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[6])]
    got = repeats.without_repeats(docs(rows), ws, window, gram).collect()
    want = brute([t for _, t in rows], window)
    assert sorted((repr(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == sorted(
        (repr(i), *w) for (i, _), w in zip(rows, want, strict=True))


def test_equal_windows_have_equal_anchors():
    rng = random.Random(0)
    words = [f"{rng.random()}" for _ in range(300)]
    one, two = " ".join(words), " ".join(["x", "y", *words[50:150], "z"])
    h, first = repeats.word_hashes(pa.array([one, two]))
    start, wins, run, anchor, doc = repeats.anchored(h, first, 35, 8)
    of = np.repeat(anchor, np.diff(np.concatenate([run, [len(start)]])))
    by = {}
    for w, a in zip(wins.tolist(), of.tolist(), strict=True):
        by.setdefault(w, set()).add(a)
    assert all(len(v) == 1 for v in by.values()) and len(by) == 266 + 69 - 66
    assert len(run) < len(start) / 8


def test_gram_hashes():
    h = np.random.default_rng(0).integers(0, 2 ** 63, 50, dtype=np.uint64)
    for n in (1, 2, 3, 7, 8, 35, 50):
        want = [sum(int(h[i + j]) * pow(repeats.BASE, j, 1 << 64) for j in range(n)) % (1 << 64)
                for i in range(50 - n + 1)]
        assert repeats.gram_hashes(h, n).tolist() == want


def seeded(texts, window, gram):
    """Batches of one text each, as they meet in a task."""
    for i, t in enumerate(texts):
        h, first = repeats.word_hashes(pa.array([t or ""]))
        start, wins, run, anchor, _ = repeats.anchored(h, first, window, gram)
        if len(run):
            cuts = np.concatenate([run, [len(start)]])
            yield repeats._rows(anchor.view(np.int64), np.full(len(run), i), start[run],
                                np.zeros_like(run), repeats._binary(wins, cuts))


@pytest.mark.parametrize("group", [1, 50, 1 << 22])
def test_all_chunks_are_compared(group):
    """Window hashes in many chunks, in groups of any size: no repeat is left in."""
    texts = corpus(3, 10)
    known = repeats._rows(np.array([5]), np.array([10 ** 6]), np.array([2]), np.array([30]),
                          repeats._binary(np.zeros(0, np.uint64), np.zeros(2, np.int64)))
    gone = {i: set() for i in range(len(texts))} | {10 ** 6: set()}
    for b in repeats.common_spans(iter([known, *seeded(texts, 10, 4), known.slice(0, 0)]), 10, group):
        for r in b.to_pylist():
            gone[r["k"]] |= set(range(r["at"], r["upto"]))
    assert gone.pop(10 ** 6) == set(range(2, 30))
    assert [len(g) for g in gone.values()] == [n for _, n, _ in brute(texts, 10)]


def test_empty(spark, ws, docs):
    assert repeats.without_repeats(docs([]), ws).count() == 0


def test_equal_rows_have_the_spans_of_one(spark, ws, docs):
    text = " ".join(f"w{i}" for i in range(300))
    one = ws.save(docs([(1, text)] * 40 + [(2, "x " + text)], extra=False).selectExpr("xxhash64(doc_id, text) AS k", "text"), "d")
    found = repeats.repeated_spans(one, ws).collect()
    assert sorted(tuple(x) for r in found for x in r.spans) == [(0, 300)] * 40 + [(1, 301)]

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest

from linkset.llm import packing


def padding(lengths, bounds):
    return sum(min(b for b in bounds if b >= x) - x for x in lengths)


@pytest.mark.parametrize("seed", range(4))
def test_bounds_are_optimal(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 2, 5, 9, 14, 20, 33, 40]) for _ in range(60)]
    cells = [(v, lengths.count(v), v * lengths.count(v)) for v in sorted(set(lengths))]
    for k in (1, 2, 3, 5, 20):
        values = [c[0] for c in cells]
        best = min(padding(lengths, (*c, values[-1])) for n in range(min(k, len(values)))
                   for c in itertools.combinations(values[:-1], n))
        got = packing.best_bounds(cells, k)
        assert len(got) <= k and got == sorted(set(got)) and padding(lengths, got) == best


@pytest.mark.parametrize("seed,buckets", [(1, 16), (2, 5), (3, 40)])
def test_long_lengths_waste_the_least(seed, buckets):
    """Against the plain quadratic programme, on lengths far beyond a few hundred."""
    rng = np.random.default_rng(seed)
    values, counts = np.unique(rng.lognormal(6, 1.5, 900).astype(np.int64), return_counts=True)
    cells = [(int(v), int(n), int(v * n)) for v, n in zip(values, counts, strict=True)]
    docs, size = (np.concatenate([[0], np.cumsum(x)]) for x in (counts, values * counts))
    m = len(values)
    cost = lambda i, j: values[j] * (docs[j + 1] - docs[i]) - (size[j + 1] - size[i])
    best = [cost(0, j) for j in range(m)]
    for _ in range(1, buckets):
        best = [min([best[j]] + [best[i - 1] + cost(i, j) for i in range(1, j + 1)]) for j in range(m)]
    lengths = np.repeat(values, counts).tolist()
    got = packing.best_bounds(cells, buckets)
    assert len(got) <= buckets and padding(lengths, got) == best[-1]


def test_batches(spark, ws, docs):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * min(5000, int(rng.paretovariate(0.8) * 5)))) for i in range(700)]
    rows += [(None, None), (5, ""), (6, "dup dup"), (6, "dup dup"), (7, "w " * 9000)]
    got = packing.pack(docs(rows), ws, ["doc_id"], budget=4096).collect()
    assert len(got) == len(rows)
    assert sorted(r.length for r in got) == sorted(len((t or "").split()) for _, t in rows)
    batches = defaultdict(list)
    for r in got:
        assert r.padding == r.bucket_len - r.length >= 0
        batches[r.bucket, r.batch].append(r)
    last = {b: max(k for x, k in batches if x == b) for b, _ in batches}
    for (b, k), rs in batches.items():
        room = max(1, 4096 // max(1, rs[0].bucket_len))
        assert sorted(r.slot for r in rs) == list(range(len(rs))) and len(rs) <= room
        assert k == last[b] or len(rs) == room
    assert len({r.bucket for r in got}) <= packing.BUCKETS
    bounds = packing.length_bounds(spark.createDataFrame([(len((t or "").split()),) for _, t in rows], "length long"))
    assert {r.bucket_len for r in got} == set(bounds)


def test_empty(spark, ws, docs):
    assert packing.pack(docs([]), ws, ["doc_id"]).count() == 0

import contextlib
import math
import os
import threading

import numpy as np
import pytest

from linkset.llm import covertree

SCHEMA = "vec_id long, embedding array<float>, label int, k long, n long, links string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, None, 1, 2, "x") for i, v in rows], SCHEMA)


def brute(rows, cosine):
    def usable(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    vs = [np.array(v, dtype=np.float32).astype(float) if usable(v) else None for _, v in rows]
    n = len(rows)
    up = list(range(n))
    links = [0] * n

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in range(n):
        for j in range(i):
            a, b = vs[i], vs[j]
            if a is not None and b is not None and len(a) == len(b) and \
                    a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= cosine:
                links[i] += 1
                links[j] += 1
                up[max(find(i), find(j))] = min(find(i), find(j))
    comp = [find(i) for i in range(n)]
    least = {c: min((i for (i, _), d in zip(rows, comp, strict=True) if d == c and i is not None), default=None)
             for c in comp}
    return sorted((repr(i), k, least[c]) for (i, _), k, c in zip(rows, links, comp, strict=True))


def vectors(seed, dim=16):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for _ in range(20):
        c = rng.normal(size=dim)
        for _ in range(rng.integers(1, 25)):
            rows.append((i * 7 % 1009, (c + rng.normal(size=dim) * rng.choice([0.02, 0.1, 0.2])).tolist()))
            i += 1
    rows += [(2000 + j, rows[3][1]) for j in range(40)]
    rows += [(3000, None), (3001, []), (3002, [0.0] * dim), (3003, [math.nan] * dim), (3004, [math.inf] + [1.0] * (dim - 1)),
             (3005, [None] * dim), (3006, [1.0, 2.0]), (3007, [2.0, 4.0]), (None, rows[3][1]), (None, [5.0, 1.0]),
             (3008, [x * 3 for x in rows[5][1]]), (rows[0][0], rows[0][1])]
    return rows


@pytest.mark.parametrize("block,sample", [(2048, 2048), (16, 64), (40, 8)])
@pytest.mark.parametrize("cosine", [0.95, 0.6])
def test_matches_all_pairs(spark, ws, block, sample, cosine):
    rows = vectors(block)
    got = covertree.similar_vectors(table(spark, rows), ws, cosine, block, sample).collect()
    assert sorted((repr(r.vec_id), r.n_links, r.component_id) for r in got) == brute(rows, cosine)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_tree_levels_cover_and_nest():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    tree = covertree.CoverTree(unit)
    u = unit[tree.order]
    assert sorted(tree.order.tolist()) == list(range(300))
    for l, lev in enumerate(tree.levels):
        for c, lo, hi, r in zip(lev["centre"], lev["lo"], lev["hi"], lev["radius"], strict=True):
            d = np.sqrt(np.maximum(0, 2 - 2 * u[lo:hi] @ u[c]))
            assert lo <= c < hi and d.max() <= r + 1e-7
            assert l == 0 or r <= 2.0 ** (1 - l) + 1e-7
        if l + 1 < len(tree.levels):
            below = tree.levels[l + 1]
            for i in range(len(lev["lo"])):
                kids = slice(lev["kid"][i], lev["kid"][i + 1])
                assert below["lo"][kids][0] == lev["lo"][i] and below["hi"][kids][-1] == lev["hi"][i]
                assert lev["centre"][i] in below["centre"][kids]


def test_walk_prunes(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(50, 32)) * 0.02 + rng.normal(size=32) for _ in range(20)])
    b = covertree.block_of(np.arange(1000), np.ones(1000, np.int64), x)
    i, j = covertree.walk(b["levels"], b["unit"], b["levels"], b["unit"], math.sqrt(0.1), True)
    last = b["levels"][-1]
    held = ((last["hi"] - last["lo"])[i] * (last["hi"] - last["lo"])[j]).sum()
    assert held < 1000 * 1000 / 8


def test_empty(spark, ws):
    assert covertree.similar_vectors(table(spark, []), ws).count() == 0
    assert covertree.similar_vectors(table(spark, [(1, None)]), ws).count() == 1


def mixed(seed, n=700, dim=40):
    """Vectors without clusters, tight and loose near copies, in any order."""
    rng = np.random.default_rng(seed)
    a, b, c = rng.normal(size=(3, dim))
    x = np.concatenate([rng.normal(size=(n // 2, dim)), a + rng.normal(size=(n // 4, dim)) * 0.01,
                        b + rng.normal(size=(n // 8, dim)) * 0.2, c + rng.normal(size=(n // 8, dim)) * 0.24])
    return rng.permutation(x.astype(np.float32).astype(float)) * rng.uniform(0.1, 9, (len(x), 1)).astype(np.float32)


def classes(edges, n):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in edges:
        up[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("block", [2048, 100])
@pytest.mark.parametrize("cosine", [0.95, 0.3, -0.5])
def test_shelves_have_all_links(tmp_path, block, cosine):
    x = mixed(5)
    n, unit = np.random.default_rng(6).integers(1, 4, len(x)), x / np.linalg.norm(x, axis=1)[:, None]
    link = unit @ unit.T >= cosine
    np.fill_diagonal(link, False)
    half, axes = len(x) // 2, covertree.directions(unit, cosine)
    parts = [np.arange(half), np.arange(half, len(x))]
    for i, rows in enumerate(parts):
        covertree.write_shelf(f"file://{tmp_path}/{i}", rows, n[rows], x[rows], block, "<f8")
    one, two = (covertree.Shelf(f"file://{tmp_path}/{i}", x.shape[1], "<f8", axes) for i in (0, 1))
    assert sorted([*one.k, *two.k]) == list(range(len(x)))
    found, edges = np.zeros(len(x), np.int64), []
    for a, b in ((one, one), (one, two), (two, two)):
        k, count, src, dst = covertree.shelf_links(a, b, cosine)
        assert len(src) < len(set(a.k) | set(b.k))
        found[k] += count
        edges += zip(src.tolist(), dst.tolist(), strict=True)
    assert found.tolist() == (link @ n).tolist()
    assert classes(edges, len(x)) == classes(np.argwhere(link).tolist(), len(x))


def test_narrow_vectors_bound_products():
    x = mixed(7)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    even = np.random.default_rng(8).normal(size=(600, 64))
    assert covertree.directions(even / np.linalg.norm(even, axis=1)[:, None], 0.95).shape[1] < 32
    z = covertree.narrow(unit, np.linalg.qr(np.random.default_rng(9).normal(size=(40, 11)))[0])
    assert z.shape[1] == 12 and (z @ z.T >= unit @ unit.T - covertree.ROUNDED).all()


def test_blocks_hold_all_and_stay_small():
    for x in (mixed(10), np.repeat(mixed(11)[:1], 300, axis=0), np.eye(40)):
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        parts = covertree.cut(unit, 64)
        assert max(map(len, parts)) <= 64 and sorted(np.concatenate(parts).tolist()) == list(range(len(x)))


class Watched:
    """Most bytes of shuffle files that were there at once."""

    def __init__(self, spark):
        manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        self.folders, self.most, self.over = [d.getPath() for d in manager.localDirs()], 0, threading.Event()

    def look(self):
        total = 0
        for top in self.folders:
            for at, _, names in os.walk(top):
                for name in names:
                    if name.startswith("shuffle"):
                        with contextlib.suppress(OSError):
                            total += os.path.getsize(os.path.join(at, name))
        return total

    def __enter__(self):
        def run():
            while not self.over.wait(0.05):
                self.most = max(self.most, self.look() - first)
        first, self.thread = self.look(), threading.Thread(target=run)
        self.thread.start()
        return self

    def __exit__(self, *_):
        self.over.set()
        self.thread.join()


def test_pairs_of_blocks_do_not_carry_vectors(spark, ws):
    """Without clusters all pairs of blocks are due; what is shuffled for them must stay small."""
    x = np.random.default_rng(12).normal(size=(3000, 64)).astype(np.float32)
    rows = table(spark, [(i, v) for i, v in enumerate(x.tolist())])
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
        with Watched(spark) as seen:
            got = covertree.similar_vectors(rows, ws, block=64, sample=64).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert len(got) == 3000 and not any(r.n_links for r in got)
    assert 0 < seen.most < 8 * x.nbytes


def test_vectors_are_written_once(spark, ws):
    x = mixed(13).astype(np.float32)
    points = table(spark, [(i, v) for i, v in enumerate(x.tolist())]).selectExpr(
        "vec_id AS k", "embedding", "1L AS n")
    some = points.limit(64).collect()
    plan = covertree.Plan(some, len(x), 0.95, 32, 64)
    made = covertree.shelves(points, plan, len(x), ws.folder("blocks"), 32, ws).collect()
    held = [covertree.Shelf(r.uri, r.dim, "<f4", None) for r in made]
    assert sorted(k for s in held for k in s.k.tolist()) == list(range(len(x)))
    assert sum(r.points for r in made) == len(x) and all(len(s.k) <= 1.5 * 16 * 32 for s in held)
    assert max(len(s.block(i)["x"]) for s in held for i in range(len(s.radius))) <= 32

import random
import re

import numpy as np
import pytest
import xxhash

from linkset.llm import simhash


def slow(text):
    t = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(s))


def components(fps, bits=2):
    n = len(fps)
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in range(n):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                up[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("text", ["", None, "a", "A b", "ÄÖ a\x1cb c d e", "x " * 500, "one two three four"])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == slow(text)


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
@pytest.mark.parametrize("hot", [False, True])
def test_links_have_the_components_of_all_pairs(spark, ws, bits, hot, monkeypatch):
    rng = random.Random(bits)
    if hot:
        monkeypatch.setattr(simhash, "SMALL", 4)
    fps = set()
    for _ in range(60):
        f = rng.getrandbits(64) & (0x000000FFFFFFFFFF if hot else 2 ** 64 - 1)
        for _ in range(rng.randint(1, 25)):
            fps.add(f)
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
    fps = sorted(fps)
    rows = [(int(np.uint64(f).view(np.int64)),) for f in fps]
    prints = ws.save(spark.createDataFrame(rows, "fp long"), "fp")
    got = {(int(np.int64(r.src).view(np.uint64)), int(np.int64(r.dst).view(np.uint64)))
           for r in simhash.links(prints, bits).collect()}
    assert all(bin(a ^ b).count("1") or a == b for a, b in got)
    at = {f: i for i, f in enumerate(fps)}
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in got:
        up[max(find(at[a]), find(at[b]))] = min(find(at[a]), find(at[b]))
    assert [find(i) for i in range(len(fps))] == components(fps, bits)


def test_groups_and_kept_rows(spark, ws, docs):
    rng = random.Random(9)
    words = ["w%d" % i for i in range(300)]
    rows = []
    for i in range(25):
        w = rng.choices(words, k=400)
        rows.append((i * 10 + 3, " ".join(w)))
        for j in range(rng.randint(0, 3)):
            v = list(w)
            v[rng.randrange(400)] = "changed"
            rows.append((i * 10 + 5 + j, " ".join(v)))
    rows += [(None, None), (9999, ""), (None, rows[0][1]), (2, " "), (rows[1][0], rows[1][1]), (8888, "tiny")]
    got = simhash.simhash_groups(docs(rows), ws).collect()
    assert len(got) == len(rows)
    fps = [slow(t) for _, t in rows]
    comp = components(fps)
    least = {c: min((i for (i, _), d in zip(rows, comp, strict=True) if d == c and i is not None), default=None)
             for c in comp}
    want = sorted((i or -1, f"{f:016x}", least[c]) for (i, _), f, c in zip(rows, fps, comp, strict=True))
    assert sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in got) == want
    df = docs(rows)
    kept = simhash.keep_one(df, ws)
    assert kept.columns == df.columns
    out = kept.collect()
    assert len(out) == len(set(comp)) and {r.doc_id for r in out} == set(least.values())


def test_empty(spark, ws, docs):
    assert simhash.simhash_groups(docs([]), ws).count() == 0
    assert simhash.keep_one(docs([]), ws).count() == 0

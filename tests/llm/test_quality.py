import random
import re

from linkset.llm import quality

W = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    t = text or ""
    w = W.findall(t)
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    hit = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            hit |= set(range(i, i + 5))
    seen, dup = set(), 0
    for line in t.split("\n"):
        if W.search(line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit),
            len(w) < 10 or 100 * len(hit) > 20 * len(w))


def texts():
    rng = random.Random(3)
    words = [rng.choice("abcdefgh") * rng.randint(1, 9) + rng.choice("xyzé") for _ in range(400)]
    out = [" ".join(rng.choices(words, k=rng.randint(12, 200))) for _ in range(150)]
    phrase = " ".join(words[:9])
    out += [None, "", " \n\t ", "a b c d e", phrase + " " + phrase, "x\ny\nx\n \n\nx", " one\x1ctwo",
            "a a a a a a a a a a a a", "### $$$ " * 30 + "|", " ".join(words) * 40]
    return out


def test_measures_match_brute_force(spark, ws, docs):
    rows = [(i, t, "en", "s") for i, t in enumerate(texts())]
    got = {r.doc_id: r for r in quality.quality_rules(docs(rows), ws).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                r.base_failed) == base(t), t
        assert not (r.base_failed and r.kept)


def test_thresholds_follow_the_group(spark, ws, docs):
    """What is usual in one source is not in another."""
    rng = random.Random(5)
    plain = lambda: " ".join(rng.choice("abcdefghijkl") * 4 + str(rng.random()) for _ in range(60))
    loud = lambda: " ".join(w + "#%" for w in plain().split())
    rows = [(i, plain(), "en", "news") for i in range(150)]
    rows += [(1000 + i, loud(), "en", "code") for i in range(150)]
    rows += [(5000, loud(), "en", "news"), (5001, loud(), "en", "code"), (5002, loud(), None, None)]
    kept = {r.doc_id: r.kept for r in quality.quality_rules(docs(rows), ws).collect()}
    assert all(kept[i] for i in range(150)) and all(kept[1000 + i] for i in range(150))
    assert not kept[5000] and kept[5001]


def test_keep_good_returns_rows_unchanged(spark, ws, docs):
    rng = random.Random(6)
    good = " ".join(str(rng.random()) for _ in range(40))
    rows = [(None, good, None, "s", 5), (1, good, "en", "s", 6), (1, good, "en", "s", 6), (2, None), (3, "")]
    df = docs(rows)
    out = quality.keep_good(df, ws)
    assert out.columns == df.columns
    assert sorted((r.doc_id or -1, r.n_chars) for r in out.collect()) == [(-1, 5), (1, 6), (1, 6)]


def test_empty_table(spark, ws, docs):
    assert quality.quality_rules(docs([]), ws).count() == 0
    assert quality.keep_good(docs([]), ws).count() == 0


def test_buckets_are_monotone_and_tight(spark):
    from pyspark.sql import functions as F
    df = spark.range(0, 70000).withColumn("bucket", quality.bucket_of(F.col("id")))
    df = df.withColumn("edge", quality.edge_of(F.col("bucket")))
    rows = df.orderBy("id").collect()
    assert all(a.bucket <= b.bucket for a, b in zip(rows, rows[1:], strict=False))
    assert all(r.id <= r.edge <= r.id * 33 / 32 + 1 for r in rows)


def test_merged_sketches_equal_the_sketch_of_all(spark, ws, docs):
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts())]
    m = ws.save(quality.measure(docs(rows)), "m")
    one = quality.sketches(m.withColumn("lang", m.lang), ["lang"])
    two = quality.merge(quality.sketches(m, ["lang", "source"]), ["lang"])
    key = lambda d: sorted(map(tuple, d.select("lang", "measure", "bucket", "n").collect()))
    assert key(one) == key(two)

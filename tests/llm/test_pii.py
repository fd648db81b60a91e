import hashlib
import random
import re

from pyspark.sql import functions as F

from linkset.llm import pii

FORMS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
         ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base(text):
    out = []
    for k, (kind, form) in enumerate(FORMS):
        for m in re.finditer(form, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(p) < 256 for p in m.group().split(".")) if kind == "ip" else 0,
                  "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def written(spans):
    return ",".join(f"{kind}:{a}:{z}" for a, _, z, kind in spans)


TEXTS = [
    None, "", "no data here", "a@b.c", "x a@b.c_d@e.f y", "..@..a@b-.c.d.", "é😀 bob@mail.example.com, ü",
    "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3", "12345678.1.2.3.4", "4111 1111 1111 1111",
    "4111-1111-1111-1111 x 4111111111111112", "41111111111111110000000", "+1 (988) 555-2485 or +49.30.1234567",
    "+1234567890123456789 +1 2", "+4111111111111111", "a@b.c" * 50, "7" * 5000, "@" * 300, "a" * 3000 + "@x",
    "+" * 100 + "1 2 3", "1.1.1.1@2.2.2.2", "\n+1 (988) 555-2485\tz@z.zz\x0b10.0.0.1",
]


def test_base_spans_match_brute_force(spark, ws, docs):
    rng = random.Random(4)
    pieces = ["a@b.c", "1.2.3.4", "4111 1111 1111 1111", "+1 (988) 555-2485", "foo", "é", ".", "@", "+", "9", "-", " ", "255"]
    texts = TEXTS + ["".join(rng.choices(pieces, k=rng.randint(1, 40))) for _ in range(300)]
    got = {r.doc_id: r for r in pii.find_pii(docs(list(enumerate(texts))), ws).collect()}
    for i, t in enumerate(texts):
        spans = base(t)
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(
            sum(s[1] == k for s in spans) for k in range(4)), t
        assert r.base_sha256 == hashlib.sha256(written(spans).encode()).hexdigest(), t
        assert set(filter(None, written(spans).split(","))) <= set(r.spans.split(","))


def test_contexts_find_what_forms_miss(spark, ws, docs):
    """Emails follow "write to"; a broken one there is found, in no other place."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows = [(i, f"{word()} {word()} please write to {word()}.{i}@mail.com about {word()} {word()}") for i in range(40)]
    rows += [(100, "you may write to bob42@localhost, today or later"),
             (101, "we saw bob43@localhost in the logs"),
             (102, "room 12 of 5 floors, write 7 times")]
    got = {r.doc_id: r.spans for r in pii.find_pii(docs(rows), ws).collect()}
    start = rows[40][1].index("bob42")
    assert got[100] == f"email:{start}:{start + len('bob42@localhost')}"
    assert got[101] == got[102] == ""
    out = {r.doc_id: r.text for r in pii.masked(docs(rows), ws).collect()}
    assert out[100] == "you may write to [EMAIL], today or later" and out[101] == rows[41][1]


def chain(rng, sep=" "):
    """Emails follow "write to"; broken ones there also follow "mirror of", and
    others follow "mirror of" only."""
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows = [f"{word()} {word()} please write{sep}to {word()}.{i}@mail.com about {word()} {word()}" for i in range(80)]
    rows += [f"{word()} may write{sep}to bob{i}@localhost {word()} {word()}" for i in range(6)]
    rows += [f"{word()} the mirror{sep}of bob{i}@localhost {word()} {word()}" for i in range(6)]
    rows += [f"{word()} the mirror{sep}of eve{word()}@intranet {word()} {word()}", f"{word()} saw eve@intranet {word()}"]
    return list(enumerate(rows))


def test_believed_instances_support_new_patterns(spark, ws, docs):
    """No seed follows "mirror of": its instances are believed after round one."""
    rows = chain(random.Random(2))
    got = {r.doc_id: r.spans for r in pii.find_pii(docs(rows), ws).collect()}
    for i, t in rows[80:-1]:
        m = re.search(r"\w+@\w+", t)
        assert got[i] == f"email:{m.start()}:{m.end()}", t
    assert got[rows[-1][0]] == ""


def test_generation_after_generation(spark, ws, docs):
    """Each place is known by what the place before it shares with it: far more
    generations than a few rounds reach; what shares nothing stays."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows = [f"{word()} {word()} please write to {word()}.{i}@mail.com about {word()} {word()}" for i in range(80)]
    places = ["write to", "mirror of", "seen by", "asked for", "paid with", "read at", "kept in"]
    for g, n in enumerate((12, 9, 7, 5, 4, 3)):         # in each place, more are known than not
        for i in range(n):
            rows += [f"{word()} {places[g]} gen{g}x{i}@localhost {word()} {word()}",
                     f"{word()} {places[g + 1]} gen{g}x{i}@localhost {word()} {word()}"]
    rows += [f"{word()} never {word()} lone{i}@localhost {word()} {word()}" for i in range(6)]
    got = {r.doc_id: r.spans for r in pii.find_pii(docs(list(enumerate(rows))), ws).collect()}
    for i, t in enumerate(rows[80:-6], 80):
        m = re.search(r"\w+@\w+", t)
        assert got[i] == f"email:{m.start()}:{m.end()}", t
    assert not any(got[i] for i in range(len(rows) - 6, len(rows)))


def test_contexts_have_whole_words(spark, ws, docs):
    """Two words, however long they and the blanks are, and at either end."""
    long = ["x" * 200 + "1", "é" * 3000, "z" * 40000]
    for w1, w2, sep in (("a", "b", " " * 500), (long[0], long[1], " "), (long[2], long[0], "\n" * 2000), ("c", "d", " ")):
        for out in ("", "far ", f"far {w2} "):
            t = f"{out}{w1}{sep}{w2}{sep}q@r.st{sep}{w2}{sep}{w1} {out}"
            rows = docs([(1, t)]).withColumn("s", F.struct(
                F.lit(t.index("q@")).alias("start"), F.lit(t.index("q@") + 6).alias("end")))
            got = rows.select(pii._patterns(F.col("text"), F.col("s")).alias("p")).first().p
            a, b = (w if len(w) <= 120 else " " + hashlib.sha256(w.encode()).hexdigest() for w in (w1, w2))
            assert got == [f"{a} {b} _", f"{b} _ {b}", f"_ {b} {a}"]


def test_long_blanks_do_not_hide_a_chain(spark, ws, docs):
    rows = chain(random.Random(3), " " * 150)
    got = {r.doc_id: r.spans for r in pii.find_pii(docs(rows), ws).collect()}
    assert all(got[i] for i, _ in rows[80:-1]) and got[rows[-1][0]] == ""


def test_masked_rows(spark, ws, docs):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "z@z.zz"), (1, "z@z.zz"), (1, "z@z.zz")]
    df = docs(rows)
    out = pii.masked(df, ws)
    assert out.columns == df.columns

    def mask(t):
        if t is None:
            return None
        res, at = "", 0
        for a, _, z, kind in base(t):
            if a >= at:
                res += t[at:a] + f"[{kind.upper()}]"
            at = max(at, z)
        return res + t[at:]
    want = sorted((repr(i), repr(mask(t))) for i, t in rows)
    assert sorted((repr(r.doc_id), repr(r.text)) for r in out.collect()) == want
    assert all(r.n_chars == len(r.text or "") for r in out.collect())


def test_empty(spark, ws, docs):
    assert pii.find_pii(docs([]), ws).count() == 0
    assert pii.masked(docs([]), ws).count() == 0

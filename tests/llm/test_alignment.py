import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from linkset.llm import alignment

public_tokenizers = pytest.importorskip("public_tokenizers")


def read(name):
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def models():
    return ("byte_level", read("byte_bpe_50k.json")), ("pieces", read("piece_bpe_32k.model"))


def brute(rows, models):
    """Token by token, as the words of the contract go."""
    import sentencepiece
    from tokenizers import Tokenizer
    one = Tokenizer.from_str(models[0][1].decode())
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_proto=models[1][1])
    letters = alignment.byte_letters()
    docs = []
    for i, t in rows:
        text = " " + (t or "")
        a = one.encode(text, add_special_tokens=False).ids
        b = two.encode(t or "")
        a_bytes = [bytes(letters[c] for c in one.id_to_token(x)) for x in a]
        b_bytes = [bytes([int(two.id_to_piece(x)[3:5], 16)]) if two.is_byte(x)
                   else two.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if not t or b"".join(a_bytes) != text.encode() or b"".join(b_bytes) != text.encode():
            docs.append((i, [], [], []))
            continue
        ends = [set(np.cumsum([len(x) for x in y]).tolist()) for y in (a_bytes, b_bytes)]
        groups, x, y = [], 0, 0
        cuts = sorted(ends[0] & ends[1])
        a_end, b_end = 0, 0
        for cut in cuts:
            g = ([], [])
            while a_end < cut:
                g[0].append(a[x])
                a_end += len(a_bytes[x])
                x += 1
            while b_end < cut:
                g[1].append(b[y])
                b_end += len(b_bytes[y])
                y += 1
            groups.append(g)
        docs.append((i, a, b, groups))
    held = Counter()
    links = []
    for _, _, _, groups in docs:
        links.append(Counter((p, q) for xs, ys in groups for p in xs for q in ys))
        held.update(set(links[-1]))
    best = defaultdict(int)
    for (p, _), n in held.items():
        best[p] = max(best[p], n)
    out = []
    for (i, a, b, groups), found in zip(docs, links, strict=True):
        text = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        out.append((repr(i), len(a), len(b), len(groups), sum(found.values()),
                    sum(n for pq, n in found.items() if held[pq] == best[pq[0]]),
                    sum(n * held[pq] for pq, n in found.items()),
                    hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out)


def corpus(seed, n=80):
    rng = random.Random(seed)
    words = ["the", "token", "naïve", "日本語", "Ελληνικά", "don't", "12345", "x=y", "😀", "  ", "\n\n", "\t", "ﬁ",
             "supercalifragilistic", "<|endoftext|>", "<s>", "▁", "é", "\x00", "　", "\r\n", "ABC"]
    plain = ["alpha", "beta,", "gamma.", "Delta", "of", "the", "and", "—", "über", "straße", "мир"]
    out = [None, "", " ", "  a", "a  b ", "▁", "日本", "\n", "<|endoftext|>", "<0x41>", "ﬁ"]
    for _ in range(n):
        out.append(rng.choice([" ", "", "-"]).join(rng.choice(words if rng.random() < 0.2 else plain)
                                                   for _ in range(rng.randint(1, 40))))
    return out + [out[20], out[20], " ".join(rng.choice(plain) for _ in range(30_000))]


@pytest.mark.parametrize("block,slice_,pairs", [(16 << 20, 1 << 20, 1 << 22), (2000, 300, 50), (1, 1, 3)])
def test_matches_brute_force(spark, ws, docs, models, monkeypatch, block, slice_, pairs):
    for name, v in (("BLOCK_BYTES", block), ("SLICE_BYTES", slice_), ("PAIRS", pairs)):
        monkeypatch.setattr(alignment, name, v)
    texts = corpus(block)
    rows = [*enumerate(texts), (None, texts[30]), (None, texts[30]), (3, texts[31])]
    got = alignment.aligned(docs(rows), ws, *models).collect()
    assert sorted((repr(r[0]), *r[1:]) for r in got) == brute(rows, models)


@pytest.mark.parametrize("seed", range(20))
def test_gallop_finds_places(seed):
    rng = np.random.default_rng(seed)
    long = np.sort(rng.choice(5000, int(rng.integers(1, 900)), replace=False))
    short = np.sort(rng.integers(0, long[-1] + 1, int(rng.integers(1, 300))))
    at = rng.integers(0, len(long), len(short))
    assert alignment.gallop(short, long, at).tolist() == np.searchsorted(long, short).tolist()


@pytest.mark.parametrize("seed", range(10))
def test_common_ends_of_many_documents(seed):
    rng = random.Random(seed)
    a, b, n_a, n_b, want, base = [], [], [], [], [], 0
    for _ in range(30):
        size = rng.choice([0, 1, 5, 200])
        if size:
            x, y = (sorted({*rng.sample(range(1, size + 1), rng.randint(0, size)), size}) for _ in range(2))
        else:
            x, y = [], []
        want += [(len(a) + x.index(e), len(b) + y.index(e)) for e in x if e in y]
        a += [base + e for e in x]
        b += [base + e for e in y]
        n_a.append(len(x))
        n_b.append(len(y))
        base += size
    got = alignment.common_ends(*(np.array(v, np.int64) for v in (a, b, n_a, n_b)))
    assert list(zip(*(g.tolist() for g in got), strict=True)) == want


def test_empty_table(ws, docs, models):
    out = alignment.aligned(docs([]), ws, *models)
    assert out.count() == 0 and out.columns == [c.split()[0] for c in alignment.ALIGNED.split(", ")]


def test_chunks_lay_out_the_text():
    import pyarrow as pa
    rng = random.Random(4)
    texts = ["", " ", "a", " a", "a ", "a  b", "a b c", "x  y z", "\n q r", "é 日本 　 語 w"]
    texts += ["".join(rng.choice(["a", "é", " ", " ", "\n", " ", "."]) for _ in range(rng.randint(0, 40)))
              for _ in range(300)]
    values, number, first = alignment.chunks_of(pa.array(["skip", *texts]).slice(1))
    got = [" ".join(values[i] for i in number[x:y]) for x, y in zip(first[:-1], first[1:], strict=True)]
    assert got == texts and len(set(values)) == len(values)
    for v in values:        # no cut is left out, none is made beside white space
        assert not any(v[i] == " " and i and i + 1 < len(v) and not v[i - 1].isspace() and not v[i + 1].isspace()
                       for i in range(len(v)))


@pytest.mark.parametrize("apart", [True, False])
def test_chunks_have_the_tokens_of_whole_texts(models, monkeypatch, apart):
    import pyarrow as pa
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 2000)     # forgotten now and then
    sides = [alignment._loaded(*m) for m in models]
    chunks = alignment.Chunks(*sides)
    assert chunks.apart
    chunks.apart = apart
    texts = [t or "" for t in corpus(9, 200)]
    for i in range(0, len(texts), 20):
        part = texts[i:i + 20]
        whole = [side.encode(part) for side in sides]
        fit = [bool(t) and all(side.tokens.join(np.array(w[j], np.int64)).tobytes() == b" " + t.encode()
                               for side, w in zip(sides, whole, strict=True)) for j, t in enumerate(part)]
        for (ids, n), w in zip(chunks.encode(pa.array(part)), whole, strict=True):
            assert n.tolist() == [len(x) if f else 0 for x, f in zip(w, fit, strict=True)]
            assert ids.tolist() == [y for x, f in zip(w, fit, strict=True) if f for y in x]

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from linkset.llm import toxicity


def corpus(n=900, seed=0):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        w = rng.choices(words, k=rng.randint(5, 120))
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(["Idiot", "scum,", "trash!", "MORON"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, toxic))
    return rows, labels


def test_held_out_accuracy_and_spans(spark, ws, docs):
    rows, labels = corpus()
    df = docs(rows)
    lab = spark.createDataFrame([*labels, (None, 1, 1), (0, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(*toxicity.training_sample(df, lab, train_docs=400))
    got = {r.doc_id: r for r in toxicity.score_documents(df, model).collect()}
    held = [(i, t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 100
    assert sum(got[i].predicted == t for i, t in held) >= 0.95 * len(held)
    text = dict(rows)
    found = [text[i][int(a):int(z)] for i, r in got.items() for a, z in
             (s.split(":") for s in r.spans.split(",") if s)]
    bad = sum(any(w.lower().strip(",!") in ("idiot", "scum", "trash", "moron") for w in f.split()) for f in found)
    assert found and bad >= 0.9 * len(found)


def test_sample_never_holds_the_test_fold(spark, docs):
    rows, labels = corpus(200)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    texts, _ = toxicity.training_sample(docs(rows), lab, train_docs=50)
    held = {t for i, t in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert texts and not held & set(texts) and len(texts) <= 100


def test_marginals_match_enumeration():
    rng = np.random.default_rng(3)
    emit = rng.normal(size=(2, 5))
    mask = np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0]], bool)
    change = rng.normal(size=(2, 2))
    p, pairs = toxicity.forward_backward(emit, mask, change, pairs=True)
    total = np.zeros((2, 2))
    for r, n in ((0, 5), (1, 3)):
        z, on, tr = 0.0, np.zeros(n), np.zeros((2, 2))
        for bits in range(2 ** n):
            s = [bits >> i & 1 for i in range(n)]
            w = np.exp(sum(emit[r, i] * s[i] for i in range(n)) + sum(change[a, b] for a, b in zip(s, s[1:], strict=False)))
            z += w
            on += w * np.array(s)
            for a, b in zip(s, s[1:], strict=False):
                tr[a, b] += w
        assert np.allclose(p[r, :n], on / z)
        total += tr / z
    assert np.allclose(pairs, total)


def test_edges(spark, ws, docs):
    rows = [(1, None), (2, ""), (None, "idiot " * 3), (3, "x"), (3, "x"), (4, "word " * 30000), (5, " \t")]
    for label in (0, 1):
        model = toxicity.train(["a b"], [label])
        got = toxicity.score_documents(docs(rows), model).collect()
        assert len(got) == len(rows) and all(r.predicted == label and 0 <= r.score <= 1 for r in got)
    assert toxicity.score_documents(docs([]), toxicity.train([], [])).count() == 0
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.training_sample(docs(rows), lab) == ([], [])


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 200])
def test_chains_cover_each_word_once(n):
    flat, first = toxicity.tokens(pa.array([" ".join(["w"] * n), "", "a b"]))
    c = toxicity.Chains.of(first)
    assert len(c.at) == len(set(c.at.tolist())) == n + 2 == c.mask.sum()


def slow_marginals(emit, change):
    """Forward and backward over one whole chain, cell by cell."""
    a = np.exp(change)
    obs = np.stack([1 / (1 + np.exp(emit)), 1 / (1 + np.exp(-emit))], axis=1)
    fwd, back = [obs[0] / obs[0].sum()], [np.ones(2)]
    for o in obs[1:]:
        f = (fwd[-1] @ a) * o
        fwd.append(f / f.sum())
    for o in obs[:0:-1]:
        b = a @ (o * back[-1])
        back.append(b / b.sum())
    post = np.array(fwd) * np.array(back[::-1])
    return post[:, 1] / post.sum(1)


@pytest.mark.parametrize("chain", [2, 7, 64])
def test_a_document_is_one_chain(monkeypatch, chain):
    monkeypatch.setattr(toxicity, "CHAIN", chain)
    rng = np.random.default_rng(chain)
    sizes = [0, 1, 63, 64, 65, 500, 0, 128, 3, 1000]
    first = np.concatenate([[0], np.cumsum(sizes)])
    emit = rng.normal(0, 2, first[-1])
    change = np.array([[1.5, -1.0], [-2.0, 1.2]])
    chains = toxicity.Chains.of(first)
    laid = chains.lay(emit)
    before, after = toxicity.messages(laid, chains.mask, change, chains.rows)
    got = toxicity.forward_backward(laid, chains.mask, change, before=before, after=after).reshape(-1)[chains.at]
    want = np.concatenate([slow_marginals(emit[a:z], change) for a, z in zip(first[:-1], first[1:], strict=True) if z > a])
    assert np.allclose(got, want, atol=1e-9)


def test_a_toxic_run_goes_on_over_any_word():
    """Beside a certain word, the one after it is likelier, also over a row's end."""
    model = toxicity.Model(["bad"], np.array([[0.0, 9.0], [0.0, 0.0], [0.0, 0.0]]), -2.0,
                           np.array([[0.0, -3.0], [-3.0, 3.0]]), np.array([-1.0, 2.0, 1.0]))
    for at in (10, 62, 63, 64, 127):
        text = " ".join("bad" if i == at else f"w{i}" for i in range(200))
        p, _ = model.marginals(pa.array([text]))
        assert abs(p[at + 1] - model.marginals(pa.array([" ".join(text.split()[max(0, at - 8):at + 9])]))[0][min(at, 8) + 1]) < 1e-3

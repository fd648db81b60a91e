"""Toxic spans and document scores by a linear-chain conditional random field.

Labels are per document; labelled tokens come from them: a word is toxic in a
toxic document if it stands in many more different contexts there than in
clean documents (contexts, so that copies of one document count once). The
two-state field has weights for a word, for the words beside it, and for
state changes. It is fitted on a bounded, documented sample: at most
TRAIN_DOCS labelled documents per class of at most TRAIN_CHARS characters, cut
into pieces of CHAIN words; of the pieces without a toxic word, at most
CLEAN_PIECES, or twice those with one if that is more, evenly over the sample.

Scoring runs in Arrow batches over all texts, in full: a document is one chain.
For speed its words are laid in rows of CHAIN; each row's transfer matrix
carries the forward and the backward message on to the next, and then all rows of
a batch are filled in at once. The marginals of a document become its score
through a logistic fit on the same sample, and words with a marginal of one
half or more, next to each other, its spans.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkset.llm.common import arrow_limits, table, text_of

TRAIN_DOCS = 2500
TRAIN_CHARS = 12_000
CHAIN = 64
CLEAN_PIECES = 2000
MIN_CONTEXTS = 5        # different contexts of a toxic word
RATIO = 8.0             # times more of them in toxic than in clean documents
VOCABULARY = 60_000
EPOCHS = 60
BATCH = 1000
EDGES = ".,;:!?\"'()[]{}<>*#|-_"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words without outer punctuation, and the first word of each text."""
    split = pc.ascii_split_whitespace(texts)
    flat = split.flatten()
    first = split.offsets.to_numpy() - split.offsets[0].as_py()
    real = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))]).astype(np.int64)
    return pc.utf8_trim(pc.utf8_lower(flat.filter(real)), EDGES), before[first]


@dataclass
class Chains:
    """Words of documents laid into rows of CHAIN; ``at`` is each word's cell,
    ``rows`` each document's number of rows."""
    at: np.ndarray
    mask: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, first: np.ndarray) -> Chains:
        n = np.diff(first)
        rows = -(-n // CHAIN)
        row0 = np.cumsum(rows) - rows
        at = np.arange(first[-1]) - np.repeat(first[:-1], n) + np.repeat(row0 * CHAIN, n)
        mask = np.zeros((int(rows.sum()), CHAIN), bool)
        mask.reshape(-1)[at] = True
        return cls(at, mask, rows)

    def lay(self, values: np.ndarray, fill: float = 0.0) -> np.ndarray:
        out = np.full(self.mask.shape, fill, values.dtype)
        out.reshape(-1)[self.at] = values
        return out


def _observed(emit: np.ndarray) -> np.ndarray:
    on = 1 / (1 + np.exp(-np.clip(emit, -30, 30)))
    return np.stack([1 - on, on])                      # state, row, cell


def messages(emit: np.ndarray, mask: np.ndarray, change: np.ndarray, rows: np.ndarray):
    """What each row gets from the rows of its document before and after it: a
    factor for its first cell, and the backward message at its last."""
    m, n = emit.shape
    a, obs = np.exp(change - change.max()), _observed(emit)
    move = np.zeros((2, 2, m))                         # from the row's first state to its last
    move[0, 0], move[1, 1] = obs[0, :, 0] + 1e-300, obs[1, :, 0] + 1e-300
    for t in range(1, n):
        on = mask[:, t]
        if not on.any():
            break
        nxt = np.einsum("ijm,jk->ikm", move, a) * obs[None, :, :, t]
        move = np.where(on, nxt / nxt.sum((0, 1)), move)
    before, after = np.ones((2, m)), np.ones((2, m))
    order = np.argsort(-rows, kind="stable")
    first = (np.cumsum(rows) - rows)[order]
    per = rows[order]
    for c in range(int(per.max(initial=0)) - 1):
        r = first[:np.searchsorted(-per, -(c + 1))] + c           # documents with a row after this one
        out = a.T @ np.einsum("im,ijm->jm", before[:, r], move[:, :, r])
        before[:, r + 1] = out / out.sum(0)
    last = first + per - 1
    for c in range(int(per.max(initial=0)) - 1):
        r = last[:np.searchsorted(-per, -(c + 1))] - c
        out = a @ np.einsum("ijm,jm->im", move[:, :, r], after[:, r])
        after[:, r - 1] = out / out.sum(0)
    return before, after


def forward_backward(emit: np.ndarray, mask: np.ndarray, change: np.ndarray, pairs: bool = False,
                     before: np.ndarray | float = 1.0, after: np.ndarray | float = 1.0):
    """Marginals of state 1 per cell; with ``pairs``, also the expected state
    changes. ``emit`` is the log odds of state 1, ``change`` 2x2 in logs;
    ``before`` and ``after`` come from :func:`messages` if rows go on."""
    m, n = emit.shape
    a = np.exp(change - change.max())
    obs = _observed(emit)
    fwd = np.empty((n, 2, m))
    cur = obs[:, :, 0] * before + 1e-300
    fwd[0] = cur / cur.sum(0)
    for t in range(1, n):
        nxt = (a.T @ fwd[t - 1]) * obs[:, :, t]
        nxt = np.where(mask[:, t], nxt + 1e-300, fwd[t - 1])
        fwd[t] = nxt / nxt.sum(0)
    back = np.ones((2, m)) * after
    prob = np.empty((m, n))
    total = np.zeros((2, 2))
    for t in range(n - 1, -1, -1):
        post = fwd[t] * back
        prob[:, t] = post[1] / post.sum(0)
        if t:
            into = a @ (obs[:, :, t] * back)
            if pairs:
                joint = fwd[t - 1][:, None, :] * a[:, :, None] * (obs[:, :, t] * back)[None]
                joint /= joint.sum((0, 1))
                total += joint[:, :, mask[:, t]].sum(2)
            back = np.where(mask[:, t], into / into.sum(0), back)
    return (prob, total) if pairs else prob


def _beside(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words before and after, 0 at the ends of a document."""
    prev, nxt = np.concatenate([[0], ids[:-1]]), np.concatenate([ids[1:], [0]])
    starts = first[:-1][np.diff(first) > 0]
    prev[starts], nxt[first[1:][np.diff(first) > 0] - 1] = 0, 0
    return prev, nxt


@dataclass
class Model:
    words: list[str]              # word i + 1 has id i + 1; 0 is any other word
    weight: np.ndarray            # 3 x (words + 1): the word, before it, after it
    bias: float
    change: np.ndarray
    fit: np.ndarray               # logistic weights of the document features

    def ids(self, flat: pa.Array) -> np.ndarray:
        found = pc.index_in(flat, value_set=pa.array(self.words, pa.string()))
        return pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1

    def emissions(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        prev, nxt = _beside(ids, first)
        return self.bias + self.weight[0][ids] + self.weight[1][prev] + self.weight[2][nxt]

    def marginals(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        flat, first = tokens(texts)
        if not len(flat):
            return np.zeros(0), first
        chains = Chains.of(first)
        emit = chains.lay(self.emissions(self.ids(flat), first))
        before, after = messages(emit, chains.mask, self.change, chains.rows)
        p = forward_backward(emit, chains.mask, self.change, before=before, after=after)
        return p.reshape(-1)[chains.at], first

    def scores(self, p: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features(p, first) @ self.fit, -30, 30)))


def features(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per document: 1, the largest marginal, the log of the expected toxic
    words that are likelier toxic than not."""
    n = len(first) - 1
    top, likely = np.zeros(n), np.zeros(n)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        top[some] = np.maximum.reduceat(p, first[:-1][some])
        likely[some] = np.add.reduceat(np.where(p >= 0.5, p, 0.0), first[:-1][some])
    return np.stack([np.ones(n), top, np.log1p(likely)], axis=1)


def _adam(params: list[np.ndarray], gradient, steps: int, rate: float) -> None:
    m = [np.zeros_like(x) for x in params]
    v = [np.zeros_like(x) for x in params]
    for t in range(1, steps + 1):
        for x, g, mi, vi in zip(params, gradient(), m, v, strict=True):
            mi += 0.1 * (g - mi)
            vi += 0.001 * (g * g - vi)
            x -= rate * (mi / (1 - 0.9 ** t)) / (np.sqrt(vi / (1 - 0.999 ** t)) + 1e-8)


def label_tokens(flat: list[str], first: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """1 for each word that is toxic in its (toxic) document."""
    seen: tuple[dict, dict] = (defaultdict(set), defaultdict(set))
    wanted: set | None = None          # clean documents: only words that toxic ones vary
    for k in (1, 0):
        for d in np.flatnonzero(toxic == k).tolist():
            w = flat[first[d]:first[d + 1]]
            for a, b, c in zip(["", *w[:-1]], w, [*w[1:], ""], strict=True):
                if wanted is None or b in wanted:
                    seen[k][b].add(hash((a, c)))
        wanted = {w for w, ctx in seen[1].items() if len(ctx) >= MIN_CONTEXTS}
    per = [max(1, int((np.diff(first) * (toxic == k)).sum())) for k in (0, 1)]
    bad = {w for w, ctx in seen[1].items() if w and len(ctx) >= MIN_CONTEXTS
           and (len(ctx) / per[1]) >= RATIO * ((len(seen[0].get(w, ())) + 0.25) / per[0])}
    in_toxic = np.repeat(toxic.astype(bool), np.diff(first))
    return np.fromiter((w in bad for w in flat), bool, len(flat)) & in_toxic


def train(texts: list[str], toxic: list[int]) -> Model:
    """Fits the field and the document score; with one class only, a constant."""
    y = np.array(toxic, dtype=np.int64)
    if len(set(toxic)) < 2:
        constant = 30.0 if toxic and toxic[0] else -30.0
        return Model([], np.zeros((3, 1)), -5.0, np.zeros((2, 2)), np.array([constant, 0.0, 0.0]))
    flat, first = tokens(pa.array(texts, pa.string()))
    words = flat.to_pylist()
    state = label_tokens(words, first, y)
    counts = pc.value_counts(flat)
    order = np.argsort(-counts.field(1).to_numpy(), kind="stable")[:VOCABULARY]
    vocabulary = [w for w in counts.field(0).take(pa.array(order)).to_pylist() if w]
    model = Model(vocabulary, np.zeros((3, len(vocabulary) + 1)), -3.0, np.zeros((2, 2)), np.zeros(3))
    ids = model.ids(flat)
    chains = Chains.of(first)
    lay = [chains.lay(x) for x in (ids, *_beside(ids, first), state.astype(np.int64))]
    rows = np.flatnonzero(lay[3].any(1))
    rest = np.setdiff1d(np.arange(len(lay[0])), rows)
    rest = rest[np.linspace(0, len(rest) - 1, min(len(rest), max(CLEAN_PIECES, 2 * len(rows)))).astype(int)] if len(rest) else rest
    rows = np.sort(np.concatenate([rows, rest]))
    feats, gold, mask = [x[rows] for x in lay[:3]], lay[3][rows], chains.mask[rows]
    seen = np.zeros((2, 2))
    both = mask[:, 1:]
    np.add.at(seen, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    bias, size = np.array([model.bias]), model.weight.shape[1]

    def gradient():
        emit = bias[0] + sum(model.weight[k][feats[k]] for k in range(3))
        p, pairs = forward_backward(emit, mask, model.change, pairs=True)
        off = np.where(mask, p - gold, 0.0)
        n = mask.sum() / 1000
        w = np.stack([np.bincount(f.reshape(-1), off.reshape(-1), size) for f in feats])
        w[:, 0] = 0.0                                   # other words carry no weight
        return [w / n + 1e-3 * model.weight, np.array([off.sum() / n]),
                (pairs - seen) / n + 1e-3 * model.change]

    _adam([model.weight, bias, model.change], gradient, EPOCHS, 0.2)
    model.bias = float(bias[0])
    p, first = model.marginals(pa.array(texts, pa.string()))
    x = features(p, first)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))

    def logistic():
        off = weight * (1 / (1 + np.exp(-np.clip(x @ model.fit, -30, 30))) - y)
        return [x.T @ off + 1e-4 * model.fit]

    _adam([model.fit], logistic, 800, 0.05)
    return model


def training_sample(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS,
                    train_chars: int = TRAIN_CHARS) -> tuple[list[str], list[int]]:
    """Different texts and labels of at most ``train_docs`` documents per class,
    from the rows with ``crc32(doc_id) % 5 != 0``, by the hash of their id."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    known = (labels.where((fold != 0) & F.col("toxic").isin(0, 1)).groupBy("doc_id")
             .agg(F.max("toxic").alias("toxic")))
    short = docs.select("doc_id", text_of("text").alias("text")).where(F.length("text") <= train_chars)
    picks = None
    for k in (0, 1):
        some = (known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs))
        picks = some if picks is None else picks.unionByName(some)
    got = short.join(F.broadcast(picks), "doc_id").select("text", "toxic").distinct().collect()
    rows = sorted((r.text, r.toxic) for r in got)
    return [r[0] for r in rows], [r[1] for r in rows]


def word_offsets(text: str, chosen: np.ndarray) -> str:
    """``start:end`` of runs of chosen words, in code points, comma-joined."""
    spans: list[list[int]] = []
    last = -2
    for i, m in enumerate(_WORD.finditer(text)):
        if i < len(chosen) and chosen[i]:
            if spans and last == i - 1:
                spans[-1][1] = m.end()
            else:
                spans.append([m.start(), m.end()])
            last = i
    return ",".join(f"{a}:{b}" for a, b in spans)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id score predicted spans`` for every row. Null text is empty; an
    empty text gets the score of a text without toxic words; null ids are
    kept; repeated rows score alike; an empty table gives no rows."""
    spark = docs.sparkSession
    arrow_limits(spark)
    shared = spark.sparkContext.broadcast(vars(model))       # at most VOCABULARY words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(**shared.value)
        for whole in batches:
            for i in range(0, whole.num_rows, BATCH):
                b = whole.slice(i, BATCH)
                p, first = m.marginals(b.column(1))
                s = m.scores(p, first)
                spans = [""] * b.num_rows
                hit = p >= 0.5
                for d in np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(hit)])[first])).tolist():
                    spans[d] = word_offsets(b.column(1)[d].as_py(), hit[first[d]:first[d + 1]])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(spans, pa.string())],
                    names=["doc_id", "score", "predicted", "spans"])

    rows = docs.select(F.col("doc_id").cast("long"), text_of("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int, spans string")


def op6_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by a field learnt from the labels outside the held-out
    fold. Nulls, empty and long texts, repeated rows as in :func:`score_documents`."""
    docs = table(spark, sf_dir, "documents")
    model = train(*training_sample(docs, table(spark, sf_dir, "labels")))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return score_documents(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"),
                                               "score", "predicted", "spans")

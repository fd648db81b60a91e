"""Exact repeated passages across and within documents, by seed and extend.

Seeds: of the GRAM-word grams inside a window of ``window`` words, the one
with the smallest hash (the leftmost of equal ones) is the window's anchor.
It depends on the window's words alone, so equal windows have the same anchor
at the same place. Neighbouring windows mostly share theirs: a document has
one anchor occurrence for about every ``(window - GRAM) / 2`` words.

Extend: occurrences of an anchor meet in one task, each with the hashes of its
extensions: all the windows it anchors, from the one that reaches furthest left to
the one that reaches furthest right. A window that two occurrences of the
anchor have in common is a repeat; overlapping repeats join into maximal ones,
which are taken out. Comparing all extensions of an anchor at once, by
sorting, finds what comparing all pairs of its occurrences would.

Words are 64-bit hashes, a match needs the anchor's and the window's hash. An
anchor with more than 1/HOT_SHARE of the occurrences in a sample of documents
is dealt out by window instead, and of a window that repeats within an Arrow
batch only the first goes on. The sample decides on that alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkset.llm.common import HOT_SHARE, arrow_limits, table, text_of
from linkset.plans.workspace import Workspace

WINDOW = 35
GRAM = 8
SAMPLE_DOCS = 4000
BASE = 0x9E3779B97F4A7C15          # any odd number
BATCH = 1000                       # documents looked at together
GROUP = 1 << 22                    # windows compared together, or all of one anchor


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the first word of each text (and the end)."""
    split = pc.ascii_split_whitespace(texts)
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    real = np.fromiter(map(bool, words), dtype=bool, count=len(words))    # blank ends give ""
    idx = coded.indices.to_numpy()
    keep = real[idx]
    before = np.concatenate([[0], np.cumsum(keep)])
    return each[idx][keep], before[split.offsets.to_numpy() - split.offsets[0].as_py()]


def gram_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of every run of ``size`` words, by doubling."""
    out, done, step, run = None, 0, 1, h
    left = size
    while True:
        if left & 1:
            shifted = run[done:] * np.uint64(pow(BASE, done, 1 << 64))
            out = shifted if out is None else out[:len(shifted)] + shifted
            done += step
        left >>= 1
        if not left:
            return out
        run = run[:len(run) - step] + run[step:] * np.uint64(pow(BASE, step, 1 << 64))
        step *= 2


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def anchored(h: np.ndarray, first: np.ndarray, window: int, gram: int):
    """Windows of all documents: start, hash, and where a new anchor begins.

    Returns ``start, wins, run, anchor, doc``: arrays over windows (start, wins)
    and over anchor occurrences (run: index of its first window, then anchor
    hash and document).
    """
    none = np.zeros(0, np.int64)
    size = np.diff(first)
    room = np.repeat(first[1:], size) - np.arange(len(h)) if len(h) else none
    start = np.flatnonzero(room >= window)
    if not len(start):
        return none, none.astype(np.uint64), none, none.astype(np.uint64), none
    wins = _mixed(gram_hashes(h, window))[start]
    g = _mixed(gram_hashes(h, gram))
    span = window - gram + 1
    view = np.lib.stride_tricks.sliding_window_view(g, span)
    at = np.empty(len(start), np.int64)
    for i in range(0, len(start), 1 << 18):
        s = start[i:i + (1 << 18)]
        lo, hi = s[0], s[-1] + 1
        at[i:i + len(s)] = view[lo:hi].argmin(axis=1)[s - lo] + s
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)])
    run = np.flatnonzero(new)
    doc = np.searchsorted(first, start[run], side="right") - 1
    return start, wins, run, g[at[run]], doc


def _spans(hit: np.ndarray, row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last hit of each stretch of hits with neighbouring starts in one row."""
    i = np.flatnonzero(hit)
    if not len(i):
        return i, i
    gap = (row[i[1:]] != row[i[:-1]]) | (start[i[1:]] != start[i[:-1]] + 1)
    return i[np.concatenate([[True], gap])], i[np.concatenate([gap, [True]])]


def _binary(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary values of 8 bytes per item, one for each stretch between cuts."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [
        None, pa.py_buffer((cuts * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


FOUND = pa.schema([("anchor", pa.int64()), ("k", pa.int64()), ("at", pa.int32()), ("upto", pa.int32()),
                   ("wins", pa.binary())])


def _rows(anchor, k, at, upto, wins) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(k), pa.array(at.astype(np.int32)),
                                       pa.array(upto.astype(np.int32)), wins], schema=FOUND)


def seeds(docs: DataFrame, window: int, gram: int, hot: np.ndarray) -> DataFrame:
    """Anchor occurrences of ``docs`` (k, text): ``anchor k at upto wins``, where
    ``wins`` holds the hashes of the windows from word ``at`` on. Rows with an
    ``upto`` are repeats known already: the words from ``at`` up to there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, BATCH):
                b = whole.slice(i, BATCH)
                h, first = word_hashes(b.column(1))
                start, wins, runs, anchor, doc = anchored(h, first, window, gram)
                if not len(runs):
                    continue
                key = b.column(0).to_numpy()[doc]
                own = start[runs] - first[doc]
                cuts = np.concatenate([runs, [len(start)]])
                cold = ~np.isin(anchor, hot)
                n = np.diff(cuts)
                of = np.repeat(np.arange(len(runs)), n)
                if cold.all():
                    yield _rows(anchor.view(np.int64), key, own, np.zeros_like(own), _binary(wins, cuts))
                    continue
                c = np.flatnonzero(cold)
                yield _rows(anchor[c].view(np.int64), key[c], own[c], np.zeros_like(c),
                            _binary(wins[cold[of]], np.concatenate([[0], np.cumsum(n[c])])))
                # windows of hot anchors, one by one; of equal ones only the first
                w = np.flatnonzero(~cold[of])
                _, one, times = np.unique(wins[w], return_index=True, return_counts=True)
                ship = w[one]
                yield _rows(wins[ship].view(np.int64), key[of[ship]], start[ship] - first[doc[of[ship]]],
                            np.zeros_like(ship), _binary(wins[ship], np.arange(len(ship) + 1)))
                again = np.zeros(len(start), bool)
                again[w] = np.isin(wins[w], wins[w[one[times > 1]]])
                a, z = _spans(again, doc[of], start)
                if len(a):
                    base = first[doc[of[a]]]
                    yield _rows(wins[a].view(np.int64), key[of[a]], start[a] - base,
                                start[z] + window - base, _binary(wins[:0], np.zeros(len(a) + 1, np.int64)))

    return docs.mapInArrow(run, "anchor long, k long, at int, upto int, wins binary")


def _windows(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of window hashes in each value of a batch's ``wins``, and all hashes."""
    width = np.int64 if pa.types.is_large_binary(col.type) else np.int32
    _, cuts, data = col.buffers()
    ends = np.frombuffer(cuts, width)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    if ends[0] == ends[-1]:
        return np.diff(ends), np.zeros(0, np.uint64)
    return np.diff(ends) // 8, np.frombuffer(data, np.uint8)[ends[0]:ends[-1]].view(np.uint64)


def _groups(anchor: np.ndarray, n: np.ndarray, group: int) -> Iterator[np.ndarray]:
    """Rows with all rows of their anchors, about ``group`` windows at a time."""
    rows = np.argsort(anchor, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], anchor[rows[1:]] != anchor[rows[:-1]]]))
    done = np.concatenate([[0], np.cumsum(n[rows])])
    i = 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(done[first], done[first[i]] + group, side="right")) - 1)
        j = j if done[-1] - done[first[i]] > group else len(first)
        yield rows[first[i]:first[j] if j < len(first) else len(rows)]
        i = j


def common_spans(batches: Iterator[pa.RecordBatch], window: int, group: int) -> Iterator[pa.RecordBatch]:
    """``k at upto`` of what :func:`seeds` found for the anchors of one task. Window
    hashes may be more than one Arrow array can hold."""
    parts = []
    for b in batches:
        if b.num_rows:
            upto = b.column("upto").to_numpy()
            if upto.any():
                yield b.filter(pa.array(upto > 0)).select(["k", "at", "upto"])
            parts.append((*(b.column(c).to_numpy() for c in ("anchor", "k", "at")), *_windows(b.column("wins"))))
    if not parts:
        return
    anchor, k, at, n, w = map(np.concatenate, zip(*parts, strict=True))
    del parts
    assert len(n) == len(anchor) and n.sum() == len(w)
    open_ = np.flatnonzero(n)                     # repeats known already have no windows
    first = np.cumsum(n) - n
    for rows in _groups(anchor[open_], n[open_], group):
        rows = open_[rows]
        size = n[rows]
        row = np.repeat(rows, size)
        step = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        h, of = w[first[row] + step], anchor[row]
        order = np.argsort(h, kind="stable")
        same = (h[order[1:]] == h[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
        hit = np.zeros(len(h), bool)
        hit[order[1:]] = same
        hit[order[:-1]] |= same
        start = at[row].astype(np.int64) + step
        a, z = _spans(hit, row, start)
        if len(a):
            yield pa.RecordBatch.from_arrays([
                pa.array(k[row[a]]), pa.array(start[a].astype(np.int32)),
                pa.array((start[z] + window).astype(np.int32))], names=["k", "at", "upto"])


def extend(found: DataFrame, window: int) -> DataFrame:
    """``k at upto``: words that repeated windows cover, from all :func:`seeds`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from common_spans(batches, window, GROUP)

    return found.repartition("anchor").mapInArrow(run, "k long, at int, upto int")


def hot_anchors(docs: DataFrame, workspace: Workspace, window: int, gram: int,
                sample_docs: int = SAMPLE_DOCS) -> np.ndarray:
    """Anchors with more than 1/HOT_SHARE of the occurrences in a sample of
    about ``sample_docs`` documents; at most HOT_SHARE come to the driver."""
    part = max(1, docs.count() // sample_docs)
    few = docs.where(F.pmod(F.xxhash64("k"), F.lit(part)) == 0)
    found = seeds(few, window, gram, np.zeros(0, np.uint64))
    counts = workspace.save(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")), "sample")
    limit = (counts.agg(F.sum("n")).first()[0] or 0) / HOT_SHARE
    rows = counts.where(F.col("n") > max(8, limit)).select("anchor").collect()
    return np.array([r.anchor for r in rows], dtype=np.int64).view(np.uint64)


def _cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, list[bytes]]:
    words = text.split()
    gone = np.zeros(len(words), bool)
    for a, z in spans:
        gone[a:z] = True
    return len(words), [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if spans else words


def repeated_spans(docs: DataFrame, workspace: Workspace, window: int = WINDOW,
                   gram: int = GRAM) -> DataFrame:
    """``docs`` (with its key ``k``) plus ``spans``: the maximal repeats of each
    document, as arrays of (at, upto) word positions, null where there are none."""
    arrow_limits(docs.sparkSession)
    narrow = docs.select("k", text_of("text").alias("text"))
    spans = extend(seeds(narrow, window, gram, hot_anchors(narrow, workspace, window, gram)), window)
    # rows that repeat in full share k, and find the same spans each
    spans = workspace.save(spans.distinct(), "spans")
    # overlapping and neighbouring spans of one text become one
    order = Window.partitionBy("k").orderBy("at", "upto")
    before = F.max("upto").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("at") > before), 1).otherwise(0)
    spans = spans.withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(
        Window.unboundedPreceding, Window.currentRow)))
    spans = spans.groupBy("k", "run").agg(F.min("at").alias("at"), F.max("upto").alias("upto"))
    per = spans.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("at", "upto"))).alias("spans"))
    return docs.join(per, "k", "left")


def without_repeats(docs: DataFrame, workspace: Workspace, window: int = WINDOW,
                    gram: int = GRAM) -> DataFrame:
    """``doc_id n_words n_removed kept`` with the kept words joined by one space.

    A null or empty text keeps no words; rows that repeat in full are documents
    of their own and repeat each other; null ids are kept; an empty table gives
    no rows; extra columns are ignored.
    """
    keyed = docs.select(F.col("doc_id").cast("long"), text_of("text").alias("text"))
    keyed = keyed.withColumn("k", F.xxhash64("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, kept = [], []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                size, words = _cut(text, [(s["at"], s["upto"]) for s in spans or ()])
                n.append((size, size - len(words)))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([x[i] for x in n], pa.int64()) for i in (0, 1)),
                 pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"])

    found = repeated_spans(keyed, workspace, window, gram)
    return found.select("doc_id", F.col("text").cast("binary"), "spans").mapInArrow(
        run, "doc_id long, n_words long, n_removed long, kept string")


def op9_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without windows of 35 words that start twice. Nulls, empty
    and long texts, repeated rows as in :func:`without_repeats`."""
    out = without_repeats(table(spark, sf_dir, "documents"), Workspace(spark, label="op9"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH w AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS word, len(ws) AS n
           FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)),
win AS (SELECT doc_id, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i
               ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS s FROM w QUALIFY i + 34 <= n),
dup AS (SELECT doc_id, i FROM win WHERE s IN (SELECT s FROM win GROUP BY s HAVING count(*) > 1)),
mark AS (SELECT w.doc_id, w.i, word, max(d.i) OVER (PARTITION BY w.doc_id ORDER BY w.i
                ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
         FROM w LEFT JOIN dup d ON d.doc_id = w.doc_id AND d.i = w.i)
SELECT d.doc_id, count(m.i) AS n_words, count(m.i) FILTER (WHERE gone) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY m.i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM documents d LEFT JOIN mark m USING (doc_id) GROUP BY d.doc_id
"""

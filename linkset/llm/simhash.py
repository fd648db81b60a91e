"""SimHash near-duplicates by a self-join of binary tries.

A document's fingerprint has a bit set where more than half of the 64-bit
hashes of its word shingles have it. Two fingerprints that differ in at most
``max_bits`` bits agree in full on one of ``max_bits + 1`` disjoint parts, so
the distinct fingerprints go into that many binary tries, each with another
part of the bits first. Below a node of such a part, the trie is joined with
itself: pairs of nodes are walked down together, differing bits are counted,
and a pair is dropped once its count exceeds the budget.

Copies share a fingerprint and are grouped before. Tries are dealt over tasks
by (part, value of the part); a value that holds more than 1/HOT_SHARE of the
fingerprints is dealt again by pairs of its next SPLIT bits. A task sends on a
forest of its links, not all of them.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkset.llm.common import (
    HOT_SHARE,
    Forest,
    arrow_limits,
    attach,
    class_labels,
    table,
    text_of,
)
from linkset.plans.workspace import Workspace

SHINGLE = 3
MAX_BITS = 2
SEED = 42
SPLIT = 6
SMALL = 64        # node pairs with at most so many leaf pairs are compared at once


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of a UTF-8 text; 0 if it has no words."""
    w = text.lower().split()          # on bytes: A-Z only, ASCII white space only
    if not w:
        return 0
    if len(w) < shingle:
        grams = [b" ".join(w)]
    else:
        grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False))
    n = max(1, len(w) - shingle + 1)
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    h = np.fromiter(map(digest, grams), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 14):
        part = h[i:i + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id fp`` (the fingerprint's bits as a long) and ``h``, a hash of the text."""
    arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(2).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))],
                                             names=["doc_id", "h", "fp"])

    t = text_of("text")
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(t).alias("h"),
                       t.cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, h long, fp long")


def _first_set(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """First place in each sorted range whose value has the bit (values agree above it)."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        on = open_ & ((v[np.minimum(mid, len(v) - 1)] & bit) != 0)
        hi = np.where(on, mid, hi)
        lo = np.where(open_ & ~on, mid + 1, lo)
    return lo


def _leaf_pairs(alo, ahi, blo, bhi):
    """Index pairs of the ranges' products, all at once."""
    na, nb = ahi - alo, bhi - blo
    size = na * nb
    which = np.repeat(np.arange(len(size)), size)
    k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return alo[which] + k // nb[which], blo[which] + k % nb[which]


def trie_pairs(v: np.ndarray, ranges: np.ndarray, start_bit: int,
               max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Walks pairs of trie nodes down together; yields index pairs within the budget.

    ``v`` holds unsigned values, sorted within each range; ``ranges`` has rows
    (a_from, a_to, b_from, b_to) of node pairs whose nodes agree inside a range
    on the first ``start_bit`` bits. The same range twice is a self-join.
    """
    # differing bits of the prefixes so far
    keep = (ranges[:, 1] > ranges[:, 0]) & (ranges[:, 3] > ranges[:, 2])
    alo, ahi, blo, bhi = ranges[keep].T
    top = np.uint64(0) if not start_bit else np.uint64(((1 << start_bit) - 1) << (64 - start_bit))
    diff = np.bitwise_count((v[alo] ^ v[blo]) & top).astype(np.int64) if len(alo) else alo
    for depth in range(start_bit, 65):
        ok = diff <= max_bits
        alo, ahi, blo, bhi, diff = (x[ok] for x in (alo, ahi, blo, bhi, diff))
        if not len(alo):
            return
        small = ((ahi - alo) * (bhi - blo) <= SMALL) | (depth == 64)
        if small.any():
            i, j = _leaf_pairs(alo[small], ahi[small], blo[small], bhi[small])
            near = (np.bitwise_count(v[i] ^ v[j]) <= max_bits) & (i != j)
            yield i[near], j[near]
            alo, ahi, blo, bhi, diff = (x[~small] for x in (alo, ahi, blo, bhi, diff))
        if depth == 64 or not len(alo):
            return
        bit = np.uint64(1 << (63 - depth))
        am, bm = _first_set(v, alo, ahi, bit), _first_set(v, blo, bhi, bit)
        mirror = (alo == blo) & (ahi == bhi)      # a self-join needs only one mixed pair
        parts = [(alo, am, blo, bm, diff), (am, ahi, bm, bhi, diff), (alo, am, bm, bhi, diff + 1),
                 tuple(x[~mirror] for x in (am, ahi, blo, bm, diff + 1))]
        alo, ahi, blo, bhi, diff = (np.concatenate(x) for x in zip(*parts, strict=True))
        full = (ahi > alo) & (bhi > blo)
        alo, ahi, blo, bhi, diff = (x[full] for x in (alo, ahi, blo, bhi, diff))


def _tasks(keys: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Ranges of node pairs in rows sorted by (key, side); side 2 joins itself."""
    cut = np.flatnonzero((keys[1:] != keys[:-1]) | (side[1:] != side[:-1])) + 1
    lo = np.concatenate([[0], cut])
    hi = np.concatenate([cut, [len(keys)]])
    own = side[lo] == 2
    selfs = np.stack([lo[own], hi[own], lo[own], hi[own]], axis=1)
    two = np.flatnonzero((side[lo[:-1]] == 0) & (keys[lo[:-1]] == keys[lo[1:]])) if len(lo) > 1 else lo[:0]
    pairs = np.stack([lo[two], hi[two], lo[two + 1], hi[two + 1]], axis=1)
    return np.concatenate([selfs, pairs])


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``src dst`` between distinct fingerprints (column ``fp``, a written
    table) whose components are those of all pairs within ``max_bits`` bits."""
    parts = max_bits + 1
    width = 64 // parts
    lead = lambda r: width if r < parts - 1 else 64 - width * (parts - 1)
    turned = F.explode(F.array(*[F.struct(
        F.lit(r).alias("r"),
        (F.expr(f"shiftleft(fp, {r * width}) | shiftrightunsigned(fp, {64 - r * width})") if r
         else F.col("fp")).alias("v")) for r in range(parts)]))
    rows = prints.select(turned.alias("t")).select("t.*")
    bits = F.coalesce(*[F.when(F.col("r") == r, F.lit(64 - lead(r))) for r in range(parts)])
    rows = rows.withColumn("lead", F.call_function("shiftrightunsigned", F.col("v"), bits))
    total = prints.count() * parts
    hot = (rows.groupBy("r", "lead").agg(F.count(F.lit(1)).alias("n"))
           .where(F.col("n") > max(1000, total / HOT_SHARE)).drop("n").withColumn("hot", F.lit(True)))
    rows = rows.join(F.broadcast(hot), ["r", "lead"], "left")   # at most HOT_SHARE rows
    # below a hot node: the SPLIT next bits of both nodes of a pair, smaller first
    mine = F.call_function("shiftrightunsigned", F.col("v"), bits - SPLIT).bitwiseAND(F.lit((1 << SPLIT) - 1))
    flips = [sum(1 << b for b in c) for k in range(max_bits + 1)
             for c in itertools.combinations(range(SPLIT), k)]
    other = F.explode(F.when(F.col("hot"), F.array(*[mine.bitwiseXOR(F.lit(f)) for f in flips]))
                      .otherwise(F.array(F.lit(-1).cast("long"))))
    rows = rows.withColumn("other", other).withColumn("mine", F.when(F.col("hot"), mine).otherwise(-1))
    unit = F.xxhash64("r", "lead", F.least("mine", "other"), F.greatest("mine", "other"))
    side = F.when(F.col("mine") == F.col("other"), 2).otherwise((F.col("mine") > F.col("other")).cast("int"))
    rows = rows.select(unit.alias("unit"), side.alias("side"), "r", "v")
    rows = rows.repartition("unit").sortWithinPartitions("unit", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        if not cols:
            return
        unit, side, r, v = (np.concatenate(c) for c in zip(*cols, strict=True))
        v = v.view(np.uint64)
        order = np.lexsort((v, side, unit))
        unit, side, r, v = unit[order], side[order], r[order], v[order]
        forest = Forest()
        ranges = _tasks(unit, side)
        for i, j in trie_pairs(v, ranges[(ranges[:, 0] != ranges[:, 2]) | (ranges[:, 1] - ranges[:, 0] > 1)],
                               min(width, 64 - width * (parts - 1)), max_bits):
            back = (r[i] * width).astype(np.uint64)
            away = (np.uint64(64) - back) & np.uint64(63)
            turn = lambda x: np.where(back == 0, x, (x >> back) | (x << away)).astype(np.uint64).view(np.int64)  # noqa: B023,E731
            for a, b in zip(turn(v[i]).tolist(), turn(v[j]).tolist(), strict=True):
                forest.link(a, b)
        edges = forest.edges()
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)],
                                         names=["src", "dst"])

    return rows.mapInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, workspace: Workspace, shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> tuple[DataFrame, DataFrame]:
    """The fingerprint rows of all documents, and the labels of their classes."""
    members = workspace.save(fingerprints(docs, shingle), "fingerprints")
    found = workspace.save(links(workspace.save(members.select("fp").distinct(), "prints"), max_bits),
                           "links")
    return members, class_labels(members, "fp", "doc_id", found, workspace)


def simhash_groups(docs: DataFrame, workspace: Workspace, shingle: int = SHINGLE,
                   max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id fingerprint component_id`` for every row.

    A null or empty text has fingerprint zero and links like any other; null
    ids never become a component's id (a component of null ids has null);
    repeated rows stay; an empty table gives no rows.
    """
    members, labels = near_duplicates(docs, workspace, shingle, max_bits)
    rows = attach(members, labels, ["fp"], "n", ["doc_id", "h"])
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                       "component_id")


def keep_one(docs: DataFrame, workspace: Workspace, shingle: int = SHINGLE,
             max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs``, one of each group: that with the smallest id (null
    after all others), then the smallest hash of its text."""
    members, labels = near_duplicates(docs, workspace, shingle, max_bits)
    rows = attach(members, labels, ["fp"], "n", ["doc_id", "h"])
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")).alias("f")
    keep = rows.groupBy("component").agg(first).select(
        F.xxhash64("f.doc_id", "f.h").alias("_k"), F.col("f.h").alias("_h"))
    h = F.xxhash64(text_of("text"))
    marked = docs.withColumns({"_h": h}).withColumn("_k", F.xxhash64(F.col("doc_id").cast("long"), "_h"))
    return (marked.join(keep, ["_k", "_h"], "left_semi").dropDuplicates(["_k", "_h"])
            .select(*docs.columns))


def op10_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents. Nulls, empty texts, repeated rows and empty tables as in
    :func:`simhash_groups`; texts of any length are read whole."""
    return simhash_groups(table(spark, sf_dir, "documents"), Workspace(spark, label="op10"))

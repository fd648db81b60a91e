"""Length buckets that waste the least padding, and token-budget batches.

The lengths of all documents go into one histogram, a cell for each length.
It goes to the driver: documents of D different lengths have D * D / 2 words
at least, so even 100 TB have a few million cells at most, and usually some ten thousand. There, dynamic
programming picks the at most ``buckets`` upper bounds with the least total
padding. The best start of the last bucket grows with its end, so each layer
is halved: the middle end looks at all starts, the ends on its left and right
only at those on its start's left and right. Rows are then numbered inside their bucket
and cut into batches whose padded size stays within the token budget.

No task gets a whole bucket: rows are dealt over about ``sqrt(rows)`` parts of
every bucket, numbered there, and shifted by the counts of the parts before.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from linkset.llm.common import n_words, table, text_of
from linkset.plans.workspace import Workspace

BUCKETS = 16
TOKEN_BUDGET = 32768


def _layer(best: np.ndarray, top: np.ndarray, docs: np.ndarray, size: np.ndarray):
    """One bucket more: for each end j the least of ``best[i - 1]`` and a last
    bucket of the lengths i..j, and that i. All halves of a depth at once."""
    m = len(top)
    out, arg = np.empty(m), np.empty(m, np.int64)
    lo, hi = np.array([1]), np.array([m])                  # ends lo..hi-1 are open
    first, last = np.array([1]), np.array([m - 1])         # their starts lie in first..last
    out[0], arg[0] = np.inf, 0
    while len(lo):
        mid = (lo + hi) // 2
        upto = np.minimum(last, mid)
        n = upto - first + 1
        i = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        j = np.repeat(mid, n)
        cost = best[i - 1] + top[j] * (docs[j + 1] - docs[i]) - (size[j + 1] - size[i])
        at = np.cumsum(n) - n
        least = np.minimum.reduceat(cost, at)
        where = np.flatnonzero(cost == np.repeat(least, n))
        found = i[where[np.searchsorted(where, at)]]
        out[mid], arg[mid] = least, found
        lo, hi, first, last = (np.concatenate(x) for x in (
            (lo, mid + 1), (mid, hi), (first, found), (found, last)))
        some = lo < hi
        lo, hi, first, last = lo[some], hi[some], first[some], last[some]
    return out, arg


def best_bounds(cells: list[tuple[int, int, int]], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least padding.

    ``cells`` are (length, documents, sum of lengths) by length. The cost of a
    bucket over cells i..j is ``length_j * documents - lengths``.
    """
    if not cells:
        return []
    top = np.array([c[0] for c in cells], dtype=np.float64)
    docs = np.concatenate([[0.0], np.cumsum([c[1] for c in cells], dtype=np.float64)])
    size = np.concatenate([[0.0], np.cumsum([c[2] for c in cells], dtype=np.float64)])
    m = len(cells)
    best = top * docs[1:] - size[1:]              # one bucket over cells 0..j
    layers, totals = [np.zeros(m, np.int64)], [best[-1]]
    for _ in range(1, min(buckets, m)):
        best, arg = _layer(best, top, docs, size)
        layers.append(arg)
        totals.append(best[-1])
    level, j, bounds = int(np.argmin(totals)), m - 1, []
    while level >= 0:
        bounds.append(int(top[j]))
        j = int(layers[level][j]) - 1
        level -= 1
    return bounds[::-1]


def length_bounds(lengths: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Bounds for a table with a ``length`` column; collects one row per length."""
    cells = lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n")).orderBy("length").toArrow()
    top, n = (cells.column(c).to_pylist() for c in ("length", "n"))
    return best_bounds([(t, k, t * k) for t, k in zip(top, n, strict=True)], buckets)


def pack(docs: DataFrame, workspace: Workspace, carry: list[str], length: Column | None = None,
         buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """The columns ``carry`` of every row plus ``length bucket bucket_len batch
    slot padding``.

    ``batch`` numbers the batches of a bucket from 0, ``slot`` the rows of a
    batch. A batch holds ``max(1, budget // bucket_len)`` rows, so a document
    over the budget is a batch of its own and the last batch of a bucket may
    be short. A null text has length 0; repeated rows are rows of their own;
    null ids are kept; an empty table gives no rows. Which batch of its bucket
    a row gets depends on the order of the table, and on nothing else.
    """
    length = n_words(text_of("text")) if length is None else length
    own = [F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)]
    rows = workspace.save(docs.select(*own, length.cast("long").alias("length"),
                                      F.monotonically_increasing_id().alias("_rid")), "lengths")
    bounds = length_bounds(rows, buckets)
    total = rows.count()
    parts = max(1, math.isqrt(total))
    at = sum(((F.col("length") > F.lit(b)).cast("int") for b in bounds[:-1]), F.lit(0))
    rows = rows.withColumns({"bucket": at, "_part": F.pmod(F.xxhash64("_rid"), F.lit(parts))})
    rows = rows.withColumn("bucket_len", F.element_at(
        F.array(*[F.lit(b).cast("long") for b in (bounds or [0])]), F.col("bucket") + 1))
    counts = rows.groupBy("bucket", "_part").agg(F.count(F.lit(1)).alias("_n"))
    prior = Window.partitionBy("bucket").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("bucket", "_part",
                           F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias("_base"))
    number = F.row_number().over(Window.partitionBy("bucket", "_part").orderBy("_rid")) - 1
    seq = rows.withColumn("_seq", number).join(counts, ["bucket", "_part"])
    seq = seq.withColumns({"_seq": F.col("_seq") + F.col("_base"),
                           "_room": F.expr(f"greatest(1L, {budget}L div greatest(bucket_len, 1L))")})
    return seq.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], "length", "bucket",
                      "bucket_len", F.expr("_seq div _room").alias("batch"),
                      F.expr("_seq % _room").alias("slot"),
                      (F.col("bucket_len") - F.col("length")).alias("padding"))


def op8_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in length buckets and batches. Nulls, long texts, repeated
    rows and empty tables as in :func:`pack`; of equal lengths, any may come first."""
    return pack(table(spark, sf_dir, "documents"), Workspace(spark, label="op8"), ["doc_id"])

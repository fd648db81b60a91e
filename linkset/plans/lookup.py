"""Lookups of some ids in a big table that prune before they shuffle.

The asked ids are folded into a Bloom filter, an array of 64-bit words made by
one aggregate, and every row of the big table is tested against it where it is read:
only asked ids, and a few that look like them, reach the exchange of the join
that follows. The filter is a scalar subquery, so the plan is one job. Its
size follows the number of asked ids; beyond MAX_BITS there is no filter, and
the join alone decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkset.plans.workspace import Workspace

HASHES = 5
BITS_PER_ID = 10            # with five hashes, about one other id in a hundred passes
MAX_BITS = 1 << 25          # 4 MB


def _places(key: str | Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) for i in range(HASHES)]


def bloom_bits(n: int) -> int | None:
    """Bits for ``n`` ids, a power of two; None if that is too many."""
    bits = max(64, 1 << (n * BITS_PER_ID - 1).bit_length()) if n else 64
    return bits if bits <= MAX_BITS else None


def bloom_filter(ids: DataFrame, key: str, bits: int) -> DataFrame:
    """One row: ``words``, an array of ``bits / 64`` longs."""
    place = F.explode(F.array(*_places(key, bits))).alias("p")
    words = ids.select(place).groupBy(F.shiftright("p", 6).alias("id")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("bits"))
    dense = ids.sparkSession.range(bits // 64).join(words, "id", "left").agg(
        F.sort_array(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("w"))
    return dense.select(F.col("w.bits").alias("words"))


def might_hold(words: Column, key: str, bits: int) -> Column:
    """False only for ids that the filter was not made from."""
    test = F.lit(True)
    for p in _places(key, bits):
        word = F.get(words, F.shiftright(p, 6).cast("int"))
        test = test & (F.bit_get(word, p.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return test


def asked_of(ids: DataFrame, key: str, table: DataFrame,
             workspace: Workspace | None = None) -> tuple[DataFrame, DataFrame]:
    """The distinct ``ids``, written, and ``table`` without most rows of other ids."""
    ws = workspace or Workspace(ids.sparkSession, label="lookup")
    asked = ws.save(ids.distinct(), "asked", {"rows": F.count(F.lit(1))})
    bits = bloom_bits(asked.metrics["rows"])
    if bits is None:
        return asked, table
    return asked, table.where(might_hold(bloom_filter(asked, key, bits).scalar(), key, bits))

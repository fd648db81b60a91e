"""Join strategies for "many rows per key" ⋈ "one row per key".

Every join in the graph operators has this shape: an edge-like table, where a
hub node may own a third of all rows, against a per-node table (a minimum, a
label). Three ways to run it:

* ``broadcast`` — ship the per-node side to every task, but only after
  measuring it: beyond ``max_broadcast_bytes`` we fall back to a shuffle join.
* ``shuffle``   — sort-merge join on the key (hint ``merge``).
* ``auto``      — no hint; Catalyst/AQE choose from runtime sizes.

Independently of the strategy, callers pass the *hot keys* (keys with more
than ``HOT_KEY_ROWS`` rows on the big side, known from an aggregate they have
already computed). Hot keys are split off: their big-side rows join a
broadcast of the matching per-node rows in place (no shuffle of the hub's
rows at all), and only the cold rest goes through the shuffle join. The hot
set is bounded by ``rows / HOT_KEY_ROWS``, and what is broadcast for it is
measured first. AQE skew-join splitting stays on as a second line.

A size is measured in bytes, not rows: a per-node side may carry wide columns
(names, texts, lists). :func:`table_bytes` adds up what the rows hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkset.plans.workspace import Workspace

HOT_BUCKETS = 1 << 16                   # groups of keys that are counted before keys are
HOT_KEY_ROWS = 1 << 20                  # rows of one key beyond which the key is split off
MAX_BROADCAST_BYTES = 128 << 20         # never broadcast more than this
STRATEGIES = ("auto", "broadcast", "shuffle")


def hot_keys(counts: DataFrame, key: str, count_col: str,
             threshold: int | None = None) -> DataFrame:
    """Keys whose row count (already aggregated in ``counts``) exceeds the threshold."""
    limit = HOT_KEY_ROWS if threshold is None else threshold
    return counts.where(F.col(count_col) > F.lit(limit)).select(key)


def over_threshold(big: DataFrame, key: str, limit: int, workspace: Workspace) -> DataFrame | None:
    """Keys of ``big`` with more than ``limit`` rows, written, or None when there are none.

    Rows are counted by ``HOT_BUCKETS`` hashes of their keys first, which takes no
    exchange to speak of: a key of more than ``limit`` rows is in a bucket of
    more, and only the keys of such buckets are counted one by one.
    """
    if limit >= HOT_BUCKETS:        # else most buckets of a large table would be over it
        place = F.pmod(F.xxhash64(key), F.lit(HOT_BUCKETS))
        per_bucket = big.groupBy(place.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
        full = workspace.save(hot_keys(per_bucket, "_bucket", "_n", limit), "full-buckets", {"n": F.count(F.lit(1))})
        found = full.metrics["n"]
        if not found:
            workspace.release(full)
            return None
        big = big.withColumn("_bucket", place).join(F.broadcast(full), "_bucket", "left_semi").drop("_bucket")
    per_key = big.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = workspace.save(hot_keys(per_key, key, "_n", limit), "hot-keys", {"n": F.count(F.lit(1))})
    if hot.metrics["n"]:
        return hot
    workspace.release(hot)
    return None


def find_hot(big: DataFrame, key: str, threshold: int | None = None,
             workspace: Workspace | None = None) -> DataFrame | None:
    """Keys of ``big`` with more than ``threshold`` rows, or None when there are none.

    The (at most ``rows / threshold``) hot keys are written once, into
    ``workspace`` if the caller has one.
    """
    ws = workspace or Workspace(big.sparkSession, label="hot")
    return over_threshold(big, key, HOT_KEY_ROWS if threshold is None else threshold, ws)


FIXED_BYTES = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}


def row_bytes(schema: T.StructType) -> Column:
    """Bytes that a row holds in memory: a word for each column, and what its
    values of variable length have (nested ones as their JSON)."""
    size = F.lit(16 + 8 * len(schema.fields)).cast("long")
    for f in schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            more = F.octet_length(c)
        elif isinstance(f.dataType, T.ArrayType) and not isinstance(
                f.dataType.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
            more = F.when(c.isNotNull(), 8 * F.size(c))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            more = F.octet_length(F.to_json(c))
        else:
            continue
        size = size + F.coalesce(more, F.lit(0)).cast("long")
    return size


def table_bytes(df: DataFrame) -> int:
    """What all rows of ``df`` hold, measured in one pass."""
    return int(df.agg(F.sum(row_bytes(df.schema))).first()[0] or 0)


def checked_broadcast(df: DataFrame, max_bytes: int | None = None) -> DataFrame | None:
    """``df`` to be broadcast, or None if it holds more than ``max_bytes``."""
    limit = MAX_BROADCAST_BYTES if max_bytes is None else max_bytes
    return F.broadcast(df) if table_bytes(df) <= limit else None


SALTS = 32


def _salted(big: DataFrame, keyed: DataFrame, key: str, how: str) -> DataFrame:
    """Too many hot keys to broadcast: every key of ``keyed`` in SALTS copies,
    every row of ``big`` at one of them."""
    rest = [c for c in big.columns if c != key] or [key]
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*rest), F.lit(SALTS)).cast("int"))
    right = keyed.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def join_keyed(big: DataFrame, keyed: DataFrame, key: str, how: str = "inner",
               strategy: str = "auto", hot: DataFrame | None = None,
               hot_rows: int | None = None,
               max_broadcast_bytes: int | None = None) -> DataFrame:
    """``big ⋈ keyed`` on ``key`` where ``keyed`` has at most one row per key.

    ``hot_rows=0`` says that ``hot`` is known to be empty. Otherwise what hot
    keys have in ``keyed`` is measured; beyond ``max_broadcast_bytes`` the join
    is salted.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}, got {strategy!r}")
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how!r}")
    if strategy == "broadcast":
        small = checked_broadcast(keyed, max_broadcast_bytes)
        if small is not None:
            return big.join(small, key, how)
        strategy = "shuffle"
    right = keyed.hint("merge") if strategy == "shuffle" else keyed
    held = 0 if hot is None or hot_rows == 0 else table_bytes(hot)
    if held == 0:
        return big.join(right, key, how)
    limit = MAX_BROADCAST_BYTES if max_broadcast_bytes is None else max_broadcast_bytes
    hot_b = F.broadcast(hot)
    keyed_hot = checked_broadcast(keyed.join(hot_b, key, "left_semi"), limit) if held <= limit else None
    if keyed_hot is None:
        return _salted(big, right, key, how)
    part_hot = big.join(hot_b, key, "left_semi").join(keyed_hot, key, how)
    cold_big = big.join(hot_b, key, "left_anti")
    cold_keyed = keyed.join(hot_b, key, "left_anti")
    if strategy == "shuffle":
        cold_keyed = cold_keyed.hint("merge")
    return part_hot.unionByName(cold_big.join(cold_keyed, key, how))

"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkset.plans.solve import connected_components
from linkset.plans.workspace import Workspace

#: White space as the contracts of the operators define it, and words between it.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: A key that owns more than 1/HOT_SHARE of all rows is hot. There can be at
#: most HOT_SHARE such keys, whatever the input's size, so a table with one
#: row per hot key may be broadcast.
HOT_SHARE = 1000

#: A table that was counted and has no more rows than this may be broadcast.
SMALL_ROWS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The text, with null read as empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c, F.lit(""))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``let x = value in body(x)``: the value is computed once per row, also
    where the body refers to it from inside another lambda."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text, in order, as an array of strings."""
    return F.array_remove(F.split(text, SPACE, -1), "")


def n_words(text: Column) -> Column:
    """Number of words, as a long."""
    return F.size(words(text)).cast("long")


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], n: str,
           spread: Sequence[str], small_rows: int = SMALL_ROWS) -> DataFrame:
    """``left`` left-joined (nulls equal) with ``right``, which has one row per
    key and, in column ``n``, the number of ``left`` rows of that key.

    A ``right`` of at most ``small_rows`` rows is broadcast. Else hot keys (see HOT_SHARE) are joined in place against a broadcast of their
    at most HOT_SHARE rows, all other keys by a shuffle. Rows that were served
    in place travel through that shuffle under a key of their own, made from
    the ``spread`` columns, so that no task gets a hot key's rows. ``n`` is
    dropped. ``right`` is read three times: pass a written table.
    """
    values = [c for c in right.columns if c not in keys and c != n]
    rows, total = right.agg(F.count(F.lit(1)), F.sum(n)).first()
    limit = (total or 0) / HOT_SHARE

    def side(frame: DataFrame, tag: str) -> DataFrame:
        return frame.select(*[F.col(k).alias(f"_{tag}k{i}") for i, k in enumerate(keys)],
                            F.struct(*values).alias(f"_{tag}v"))

    def match(tag: str) -> Column:
        cond = F.lit(True)
        for i, k in enumerate(keys):
            cond = cond & F.col(f"_l{i}").eqNullSafe(F.col(f"_{tag}k{i}"))
        return cond

    if rows <= small_rows:
        l = left.select("*", *[F.col(k).alias(f"_l{i}") for i, k in enumerate(keys)])
        l = l.join(F.broadcast(side(right, "h")), match("h"), "left")
        return l.select(*left.columns, *[F.col("_hv")[v].alias(v) for v in values])
    hot = side(right.where(F.col(n) > limit), "h")
    cold = side(right.where(F.col(n) <= limit), "c").withColumn("_salt_r", F.lit(0).cast("long"))
    names = left.columns
    l = left.select("*", *[F.col(k).alias(f"_l{i}") for i, k in enumerate(keys)])
    l = l.join(F.broadcast(hot), match("h"), "left")
    l = l.withColumn("_salt", F.when(F.col("_hv").isNotNull(),
                                     F.xxhash64(*spread).bitwiseOR(F.lit(1)))
                     .otherwise(F.lit(0).cast("long")))
    l = l.join(cold, match("c") & (F.col("_salt") == F.col("_salt_r")), "left")
    return l.select(*names, *[F.coalesce(F.col("_hv")[v], F.col("_cv")[v]).alias(v) for v in values])


def arrow_limits(spark: SparkSession) -> None:
    """Bounds the Arrow batches that Python tasks get, unless the session
    already says otherwise: rows of text vary from none to megabytes."""
    for key, value in (("spark.sql.execution.arrow.maxBytesPerBatch", 32 << 20),
                       ("spark.sql.execution.arrow.maxRecordsPerBatch", 4000)):
        if spark.sparkContext.getConf().get(key, None) is None:
            spark.conf.set(key, str(value))


def class_labels(members: DataFrame, key: str, id_col: str, links: DataFrame,
                 workspace: Workspace) -> DataFrame:
    """One row per class of equal items: ``key component component_id n``.

    ``members`` has one row per item, ``key`` (a long, never null) names its
    class, ``links(src, dst)`` joins classes. ``component`` labels the linked
    classes, ``component_id`` is the smallest id in them (null if all of them
    are null), ``n`` the number of items. Both inputs must be written tables.
    """
    sizes = workspace.save(members.groupBy(key).agg(F.min(id_col).alias("_id"),
                                                    F.count(F.lit(1)).alias("n")), "classes")
    if links.isEmpty():
        return sizes.select(key, F.col(key).alias("component"), F.col("_id").alias("component_id"), "n")
    solved = workspace.save(connected_components(links), "components")
    linked = workspace.save(sizes.join(solved.withColumnRenamed("node", key), key, "left")
                            .withColumn("component", F.coalesce("component", key)), "linked")
    least = workspace.save(linked.groupBy("component").agg(
        F.min("_id").alias("component_id"), F.count(F.lit(1)).alias("_m")), "least")
    return workspace.save(attach(linked, least, ["component"], "_m", [key]).select(
        key, "component", "component_id", "n"), "labels")


class Forest:
    """Union-find over the links of one task; ``edges`` is a forest with the
    same components, so a task never sends on all links of a dense group."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while (nxt := up.get(root, root)) != root:
            root = nxt
        while up.get(x, x) != root:
            up[x], x = root, up[x]
        return root

    def link(self, a, b) -> None:
        ra, rb = self.find(a), self.find(b)
        self.up.setdefault(ra, ra)
        self.up.setdefault(rb, rb)
        if ra != rb:
            self.up[max(ra, rb)] = min(ra, rb)

    def edges(self) -> list[tuple]:
        return [(x, r) for x in self.up if (r := self.find(x)) != x]

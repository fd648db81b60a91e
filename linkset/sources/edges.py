"""Edge readers and writers.

Text edge files, of ids or of names, are read as lines and parsed by one set of
column expressions; lines that are no edges are an error, dropped, or kept as a table.
Any Hadoop URI works (``hdfs://``, ``s3a://``, ``file://``: S6).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkset.functions.schema import EDGE_TEXT, EDGES
from linkset.operators.graph import as_edges

SEPARATORS = {"comma": ",", "tab": "\t", "space": " "}
BATCH = 1 << 16             # pairs of an RDD that travel together

_TRIM = r"^\s+|\s+$"
_INTEGER = r"^[+-]?[0-9]+$"
#: How a line of ids is cut into fields; a run of blanks counts as one.
_CUTS = {",": ",", "\t": "\t", " ": " +"}


class EdgeLines(NamedTuple):
    """What ``on_bad="keep"`` returns: the edges, and ``(file, line, reason)`` of
    every line that is none."""

    edges: DataFrame
    rejected: DataFrame


def _literal(sep: str) -> str:
    return "\\Q" + sep + "\\E"


def _fields(spark: SparkSession, path: str, cut: str, comment: str | None, trim: bool) -> DataFrame:
    """``file line n f0 f1`` of text lines: the number of fields and the first two.
    Empty lines and comments are skipped."""
    tidy = (lambda c: F.regexp_replace(c, _TRIM, "")) if trim else (lambda c: c)
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"),
                                        tidy(F.col("value")).alias("tidy")).where(F.trim("tidy") != "")
    if comment:
        rows = rows.where(~F.startswith("tidy", F.lit(comment)))
    field = F.split("tidy", cut, -1)
    return rows.select("file", "line", F.size(field).alias("n"),
                       *[tidy(F.get(field, F.lit(i))).alias(f"f{i}") for i in (0, 1)])


def _judged(rows: DataFrame, on_bad: str, isolated: bool) -> DataFrame | EdgeLines:
    """Edges of rows ``file line n src dst reason``; a row with a reason is bad."""
    if on_bad not in ("fail", "drop", "keep"):
        raise ValueError(f"on_bad must be 'fail', 'drop' or 'keep', got {on_bad!r}")
    if on_bad == "fail":
        kind = dict(rows.dtypes)["src"]
        bad = F.raise_error(F.concat(F.lit("not an edge line ("), F.col("reason"), F.lit("): "), F.col("line")))
        good = rows.withColumn("src", F.when(F.col("reason").isNull(), F.col("src")).otherwise(bad.cast(kind)))
    else:
        good = rows.where("reason IS NULL")
    if not isolated:
        good = good.where("n > 1")
    edges = good.select("src", "dst")
    if dict(rows.dtypes)["src"] == "bigint":
        edges = as_edges(edges)
    if on_bad != "keep":
        return edges
    return EdgeLines(edges, rows.where("reason IS NOT NULL").select("file", "line", "reason"))


def _ids(spark: SparkSession, path: str, cut: str, comment: str | None, isolated: bool,
         on_bad: str) -> DataFrame | EdgeLines:
    """``(src, dst)``: the first two fields, trimmed and read as integers. One
    field is an isolated vertex; any other line without two integers is bad."""
    rows = _fields(spark, path, cut, comment, trim=True)
    number = lambda c: F.when(F.col(c).rlike(_INTEGER), F.col(c).try_cast("long"))
    rows = rows.withColumns({"src": number("f0"), "dst": number("f1")})
    reason = (F.when(F.col("src").isNull(), "first field is no id")
              .when((F.col("n") > 1) & F.col("dst").isNull(), "second field is no id"))
    return _judged(rows.withColumn("reason", reason), on_bad, isolated)


def read_edges(spark: SparkSession, path: str, sep: str = ",", *, comment: str | None = "#",
               isolated: bool = True, on_bad: str = "fail") -> DataFrame | EdgeLines:
    """``(src, dst)`` from delimited text; blanks around ids and
    fields after the second do not matter. A line with a single id is an
    isolated vertex and becomes ``(id, id)`` when ``isolated`` (else it is left
    out). A line that has no two integers is an error; with ``on_bad="drop"`` it is
    left out, with ``"keep"`` the result is :class:`EdgeLines`, which has
    such lines as a table of their own.
    """
    sep = SEPARATORS.get(sep, sep)
    return _ids(spark, path, _CUTS.get(sep) or _literal(sep), comment, isolated, on_bad)


def read_edges_whitespace(spark: SparkSession, path: str, *, comment: str | None = "#",
                          isolated: bool = True, on_bad: str = "fail") -> DataFrame | EdgeLines:
    """Any run of white space separates fields; otherwise as :func:`read_edges`."""
    return _ids(spark, path, r"\s+", comment, isolated, on_bad)


def read_string_edges(spark: SparkSession, path: str, sep: str = ",", *, comment: str | None = None,
                      isolated: bool = True, on_bad: str = "fail") -> DataFrame | EdgeLines:
    """Ids kept as text ``(src STRING, dst STRING)``, exactly as they stand
    between separators: quotes, blanks and backslashes are part of a name. A
    line with one name, or an empty second one, is an isolated vertex
    (``dst`` null); one with an empty first name is bad.
    """
    sep = SEPARATORS.get(sep, sep)
    rows = _fields(spark, path, _literal(sep), comment, trim=False)
    rows = rows.withColumns({"src": F.nullif("f0", F.lit("")), "dst": F.nullif("f1", F.lit(""))})
    rows = rows.withColumn("n", F.when(F.col("dst").isNull(), 1).otherwise(F.col("n")))
    return _judged(rows.withColumn("reason", F.when(F.col("src").isNull(), "first name is empty")), on_bad, isolated)


def edges_from_rows(spark: SparkSession, rows) -> DataFrame:
    """A small in-memory edge list, e.g. a hand-made test graph."""
    return spark.createDataFrame([(int(a), int(b)) for a, b in rows], EDGES)


def edges_from_rdd(spark: SparkSession, rdd: RDD, batch: int = BATCH) -> DataFrame:
    """An RDD of integer pairs with the fixed edge schema (distributed, no
    collect). Each partition packs its pairs into arrays, ``batch`` at a time;
    what is serialised is one row per array, and Arrow unpacks them. A null
    second id is kept (an isolated vertex); a pair of anything else fails."""
    def packed(pairs: Iterable) -> Iterator[tuple]:
        pairs = iter(pairs)
        while rows := list(itertools.islice(pairs, batch)):
            src, dst = zip(*rows, strict=True)
            alone = np.array([d is None for d in dst], bool)
            yield tuple(bytearray(x) for x in (
                np.array(src, np.int64).tobytes(), np.array([0 if d is None else d for d in dst], np.int64).tobytes(),
                alone.tobytes() if alone.any() else b""))

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for src, dst, alone in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(src, np.int64)),
                     pa.array(np.frombuffer(dst, np.int64), mask=np.frombuffer(alone, bool) if alone else None)],
                    names=["src", "dst"])

    return spark.createDataFrame(rdd.mapPartitions(packed), "src BINARY, dst BINARY, alone BINARY",
                                 verifySchema=False).mapInArrow(unpacked, EDGE_TEXT)


def write_edges(edges: DataFrame, path: str, fmt: str = "csv", sep: str = ",",
                mode: str = "errorifexists") -> None:
    """Edges as delimited text (one ``src<sep>dst`` line) or Parquet."""
    writer = edges.write.mode(mode)
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt == "csv":
        writer.option("sep", SEPARATORS.get(sep, sep)).option("header", "false").csv(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def write_adjacency_text(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write ``node<TAB>n1;n2;...`` lines (see ``graph.adjacency_text``)."""
    lines.select("line").write.mode(mode).text(path)

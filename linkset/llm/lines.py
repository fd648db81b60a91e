"""Line dedup: lines that many documents hold stay in one of them.

The key of a line is the line without white space at its ends, A-Z in lower
case. Keys are 128-bit hashes. Rows ``(key, document, position)`` are dealt
out by ranges of all of that and sorted inside each range: a key that is in a
third of all lines simply spans many ranges. A task streams its range. Rows
of a key come with the largest document first, so its first occurrences are
those of the document that keeps the line, and all other rows go once
``min_docs`` documents have passed. A key at an end of a range may go on in the
next: such rows are put off until the ends of all ranges (at most
``2 * min_docs`` rows each) have been put together.

What is returned are bitmaps, one bit for each line of a document, set where
the line stays, compressed; texts are not moved. A document without a bitmap
keeps all its lines. :func:`apply_bitmaps` cuts the texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkset.llm.common import arrow_limits, table, text_of
from linkset.plans.workspace import Workspace

MIN_CHARS = 40
MIN_DOCS = 5
NO_ID = -(1 << 63)          # stands for a null id: smaller than all others

#: Rows of one line of one document, as they are sorted.
LINE = ["hi", "lo", "doc", "h", "pos", "n_lines"]
LINE_TYPES = "hi long, lo long, doc long, h long, pos int, n_lines int"
DECIDED = pa.schema([("kind", pa.string()), *[(c, pa.int64()) for c in LINE[:4]],
                     *[(c, pa.int32()) for c in LINE[4:]]])
_CONTINUED = bytes(range(0x80, 0xC0))


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z in lower case."""
    return line.strip().lower()         # of bytes: white space and letters of ASCII only


def _chars(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.translate(None, _CONTINUED))


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id doc h text``; a document is known by its id and its text's hash."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    return rows.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"),
                       F.xxhash64("text").alias("h"), "text")


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """The lines of :func:`keyed` documents whose keys have ``min_chars`` code points."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, at, pos, size = [], [], [], []
            for i, text in enumerate(b.column(2).cast(pa.binary()).to_pylist()):
                lines = text.split(b"\n")
                for p, line in enumerate(lines):
                    if len(line) >= min_chars and _chars(key := line_key(line)) >= min_chars:
                        digests.append(xxhash.xxh3_128_digest(key))
                        at.append(i)
                        pos.append(p)
                        size.append(len(lines))
            pair = np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).view(np.int64)
            which = np.array(at, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pair[0::2]), pa.array(pair[1::2]),
                 *(pa.array(b.column(c).to_numpy()[which]) for c in (0, 1)),
                 pa.array(pos, pa.int32()), pa.array(size, pa.int32())], names=LINE)

    return docs.select("doc", "h", "text").mapInArrow(run, LINE_TYPES)


class _Stream:
    """The rows of one sorted range, batch by batch."""

    def __init__(self, min_docs: int):
        self.min_docs = min_docs
        self.head = self.key = None     # the range's first key, and the key of the open run
        self.docs: list[int] = []       # first documents of the open run, min_docs at most
        self.held: list[list[np.ndarray]] = []      # its rows while nothing is decided

    def _out(self, kind: str, cols: list[np.ndarray], pick=slice(None)) -> Iterator[pa.RecordBatch]:
        cols = [c[pick] for c in cols]
        if len(cols[0]):
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind] * len(cols[0])), *map(pa.array, cols)], schema=DECIDED)

    def _ends(self) -> Iterator[pa.RecordBatch]:
        """First documents of the open run, which may go on in another range."""
        n, (hi, lo) = len(self.docs), self.key
        yield from self._out("end", [np.array(x, t) for x, t in (
            ([hi] * n, np.int64), ([lo] * n, np.int64), (self.docs, np.int64), ([0] * n, np.int64),
            ([0] * n, np.int32), ([0] * n, np.int32))])

    def _open(self, cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """More rows of the open run."""
        doc = cols[2]
        for d in doc[np.concatenate([[True], doc[1:] != doc[:-1]])][:self.min_docs + 1].tolist():
            if len(self.docs) < self.min_docs and (not self.docs or self.docs[-1] != d):
                self.docs.append(d)
        if self.key == self.head:       # it may have begun in another range
            yield from self._out("open", cols)
            return
        self.held.append(cols)
        if len(self.docs) == self.min_docs:
            for c in self.held:
                yield from self._out("drop", c, c[2] != self.docs[0])
            self.held = []

    def _turn(self, key: tuple[int, int] | None) -> Iterator[pa.RecordBatch]:
        """The open run ends, by another key or (None) with the range."""
        if self.key is not None and (self.key == self.head or key is None):
            yield from self._ends()
            for c in self.held:
                yield from self._out("open", c)
        self.key, self.docs, self.held = key, [], []
        if self.head is None:
            self.head = key

    def take(self, cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        hi, lo, doc = cols[:3]
        other = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        first = np.flatnonzero(np.concatenate([[True], other]))
        upto = np.concatenate([first[1:], [len(hi)]])

        def by_hand(run: int) -> Iterator[pa.RecordBatch]:
            key = (int(hi[first[run]]), int(lo[first[run]]))
            if key != self.key:
                yield from self._turn(key)
            yield from self._open([c[first[run]:upto[run]] for c in cols])

        yield from by_hand(0)
        if len(first) > 2:              # whole runs, at once
            a, z = first[1], first[-1]
            starts = first[1:-1] - a
            new_doc = np.concatenate([[True], (doc[a + 1:z] != doc[a:z - 1]) | other[a:z - 1]])
            size = np.diff(np.concatenate([starts, [z - a]]))
            many = np.add.reduceat(new_doc.astype(np.int64), starts) >= self.min_docs
            gone = np.repeat(many, size) & (doc[a:z] != np.repeat(doc[a:z][starts], size))
            yield from self._out("drop", [c[a:z] for c in cols], gone)
        if len(first) > 1:
            yield from by_hand(len(first) - 1)

    def close(self) -> Iterator[pa.RecordBatch]:
        yield from self._turn(None)


def first_occurrences(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Streams one sorted range: rows that go (``drop``), rows of keys at its ends
    (``open``) and the first documents of these keys (``end``)."""
    stream = _Stream(min_docs)
    for b in batches:
        if b.num_rows:
            yield from stream.take([b.column(c).to_numpy() for c in LINE])
    yield from stream.close()


def dropped_lines(lines: DataFrame, workspace: Workspace, min_docs: int) -> DataFrame:
    """``doc h pos n_lines`` of the lines that go; ``lines`` must be written."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from first_occurrences(batches, min_docs)

    # equal rows (repeated rows of the input) still have an order of their own
    order = ["hi", "lo", F.col("doc").desc(), "h", "pos", "row"]
    ranges = (lines.withColumn("row", F.monotonically_increasing_id())
              .repartitionByRange(*order).sortWithinPartitions(*order).select(*LINE))
    found = workspace.save(ranges.mapInArrow(run, f"kind string, {LINE_TYPES}"), "decided")
    ends = found.where("kind = 'end'").groupBy("hi", "lo").agg(
        F.countDistinct("doc").alias("docs"), F.max("doc").alias("keeper"))
    # two keys a range at most
    ends = F.broadcast(workspace.save(ends.where(F.col("docs") >= min_docs), "ends"))
    late = found.where("kind = 'open'").join(ends, ["hi", "lo"]).where("doc <> keeper")
    rest = ["doc", "h", "pos", "n_lines"]
    return found.where("kind = 'drop'").select(*rest).unionByName(late.select(*rest))


def keep_bitmaps(docs: DataFrame, workspace: Workspace, min_chars: int = MIN_CHARS,
                 min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc h n_lines n_dropped keep`` for :func:`keyed` documents that lose lines:
    ``keep`` is a zlib-compressed bitmap, lowest bit first, set for lines that stay."""
    arrow_limits(docs.sparkSession)
    lines = workspace.save(line_rows(docs, min_chars), "lines")
    gone = dropped_lines(lines, workspace, min_docs)
    # words of 64 lines: summed before the shuffle, and repeated rows fall together
    words = gone.groupBy("doc", "h", "n_lines", F.shiftright("pos", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("bits"))
    per = words.groupBy("doc", "h", "n_lines").agg(
        F.collect_list(F.struct("word", "bits")).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dropped, keep = [], []
            for n, found in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                bits = np.zeros((n + 63) // 64, "<i8")
                bits[[w["word"] for w in found]] = [w["bits"] for w in found]
                gone = np.unpackbits(bits.view(np.uint8), bitorder="little")[:n]
                dropped.append(int(gone.sum()))
                keep.append(zlib.compress(np.packbits(1 - gone, bitorder="little").tobytes()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(dropped, pa.int32()),
                                              pa.array(keep, pa.binary())],
                                             names=["doc", "h", "n_lines", "n_dropped", "keep"])

    out = workspace.save(per.mapInArrow(run, "doc long, h long, n_lines int, n_dropped int, keep binary"),
                         "bitmaps")
    workspace.release(lines)
    return out


def kept_lines(text: bytes, keep: bytes | None) -> list[bytes]:
    lines = text.split(b"\n")
    if keep is None:
        return lines
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines), bitorder="little")
    return [line for line, stays in zip(lines, bits.tolist(), strict=True) if stays]


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``doc_id n_lines n_dropped kept`` of :func:`keyed` documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, kept = [], [], []
            for text, keep in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                lines = kept_lines(text, keep)
                n.append(text.count(b"\n") + 1)
                gone.append(n[-1] - len(lines))
                kept.append(b"\n".join(lines))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"])

    both = docs.join(bitmaps.select("doc", "h", "keep"), ["doc", "h"], "left")
    return both.select("doc_id", "text", "keep").mapInArrow(
        run, "doc_id long, n_lines long, n_dropped long, kept string")


def without_repeated_lines(docs: DataFrame, workspace: Workspace, min_chars: int = MIN_CHARS,
                           min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id n_lines n_dropped kept`` of every row of ``docs``.

    A null or empty text is one empty line. Rows with one id count as one
    document (a null id is one, smaller than all others), each row keeps its
    own text. A document that holds a line several times keeps or loses all of
    them. An empty table gives no rows; other columns are ignored.
    """
    rows = keyed(docs)
    return apply_bitmaps(rows, keep_bitmaps(rows, workspace, min_chars, min_docs))


def op13_line_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of at least 40 characters in at least 5 documents stay in the largest
    doc_id alone. Nulls, ties, repeated rows, empty and long texts as in
    :func:`without_repeated_lines`."""
    out = without_repeated_lines(table(spark, sf_dir, "documents"), Workspace(spark, label="op13"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
many AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40
         GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, i, line, coalesce(k.doc_id <> keeper, false) AS gone FROM k LEFT JOIN many USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

"""Token ids in Arrow files of equal-length sequences.

Documents are ordered by id, tokenized, and laid end to end; each file holds a
run of that stream as record batches with two fixed-size-list columns: ``ids``
(SEQUENCE of them per row) and ``mask`` (true where a token is).
Only the last row of a file is padded. Any sequence, or any document through
the index, is then a slice of a mapped buffer: row r of a file is row
``r % BATCH_ROWS`` of batch ``r // BATCH_ROWS``, nothing is decoded or copied.

Tokenizing dominates, and words repeat: a task encodes each distinct word of a
batch once, keeps it for later batches, and gathers the ids of a document from
there. That is exact for tokenizers that drop white space before they look for
tokens; :class:`Reading` tells from the tokenizer's file whether it does (if not, whole
texts are encoded), and whether it lowers letters and parts them from full stops.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tokenizers
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from linkset.llm import files
from linkset.llm.common import arrow_limits, attach, table, text_of
from linkset.plans.workspace import Workspace

SEQUENCE = 2048
BATCH_ROWS = 256
END_ID = 2
CACHE_WORDS = 2_000_000
SLICE = 1000            # documents encoded together

def schema_of(vocabulary: int) -> pa.Schema:
    """Ids take the smallest unsigned type that holds the vocabulary; masks are bits."""
    kind = pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()
    return pa.schema([("ids", pa.list_(kind, SEQUENCE)), ("mask", pa.list_(pa.bool_(), SEQUENCE))])


def _hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of the stretches start .. start + size, one after another."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)


class Reading:
    """What a tokenizer does to a text before its model sees it."""

    def __init__(self, spec: dict):
        def steps(part: dict | None, inner: str) -> list[dict]:
            if not part:
                return []
            return [s for p in part[inner] for s in steps(p, inner)] if part["type"] == "Sequence" else [part]

        lowers = steps(spec.get("normalizer"), "normalizers")
        cuts = steps(spec.get("pre_tokenizer"), "pretokenizers")
        kept = [regex.compile(c["pattern"]["Regex"]) for c in cuts if c["type"] == "Split"
                and c["behavior"] == "Removed" and c["invert"] and "Regex" in c["pattern"]]
        self.lowers = any(n["type"] == "Lowercase" for n in lowers)
        #: no token has white space, or letters from both sides of it
        self.by_word = any(c["type"] in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer") for c in cuts) or any(
            not p.search(" \t\n\x0b\x0c\r") for p in kept)
        #: words of letters, and full stops and commas behind them, are parted
        self.by_letter = any(p.findall("aZ\xe9.,") == ["aZ\xe9", ".,"] for p in kept)


class WordTable:
    """Ids of words met so far, by the words' 64-bit hashes, sorted."""

    def __init__(self, model: str):
        self.tokenizer = Tokenizer.from_str(model)
        self.reading = Reading(json.loads(model))
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.store = np.zeros(1 << 14, np.uint32)
        self.used = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 if new."""
        if not len(self.keys):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, at, -1)

    def _add(self, h: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        while self.used + len(flat) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        self.store[self.used:self.used + len(flat)] = flat
        start = self.used + np.cumsum(size) - size
        self.used += len(flat)
        order = np.argsort(h)
        at = np.searchsorted(self.keys, h[order])
        self.keys = np.insert(self.keys, at, h[order])
        self.start = np.insert(self.start, at, start[order])
        self.size = np.insert(self.size, at, size[order])

    def learn(self, words: list[str], h: np.ndarray) -> None:
        """Encodes new words. A word of Latin letters with full stops or commas
        behind is its letters and these, if the tokenizer parts them."""
        parts = [_parted(w, self.reading) for w in words]
        units = list(dict.fromkeys(u for part in parts for u in part))
        hu = _hashes(units)
        new = np.flatnonzero(self.find(hu) < 0)
        got = [e.ids for e in self.tokenizer.encode_batch_fast(
            [units[i] for i in new.tolist()], add_special_tokens=False)]
        self._add(hu[new], np.fromiter((i for ids in got for i in ids), np.uint32),
                  np.fromiter(map(len, got), np.int32, count=len(got)))
        rest = np.flatnonzero(self.find(h) < 0)
        row = dict(zip(units, self.find(hu).tolist(), strict=True))
        head, tail = (np.array([row[parts[i][k]] for i in rest.tolist()], np.int64) for k in (0, 1))
        both = np.stack([head, tail], axis=1).reshape(-1)
        flat = self.store[_spread(self.start[both], self.size[both])]
        self._add(h[rest], flat, self.size[head] + self.size[tail])


def _parted(word: str, reading: Reading) -> tuple[str, str]:
    if not reading.by_letter or "<|" in word or not word or max(word) > "\xff":
        return word, ""
    low = word.lower() if reading.lowers else word
    core = low.rstrip(".,")
    return (core, low[len(core):]) if core[-1:].isalpha() else (low, "")


class WordEncoder:
    """Encodes texts word by word, remembering words it has seen."""

    def __init__(self, model: str):
        # Python workers serve many tasks: what one has learnt helps the next
        tables = tokenizers.__dict__.setdefault("_linkset_word_tables", {})
        key = hashlib.sha1(model.encode()).digest()
        if key not in tables:
            tables[key] = WordTable(model)
        self.table = tables[key]
        self.tokenizer = self.table.tokenizer

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the number of ids of each text."""
        table = self.table
        if not table.reading.by_word:
            got = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            n = np.fromiter(map(len, got), np.int64, count=len(got))
            return np.fromiter((i for ids in got for i in ids), np.uint32, count=int(n.sum())), n
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(table.keys) > CACHE_WORDS:
            table.clear()
        h = _hashes(words)
        new = np.flatnonzero(table.find(h) < 0)
        if len(new):
            table.learn([words[i] for i in new.tolist()], h[new])
        entry = table.find(h)[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        n = table.size[entry].astype(np.int64)
        ids = table.store[_spread(table.start[entry], n)]
        bounds = np.concatenate([[0], np.cumsum(n)])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return ids, np.diff(bounds)


class SequenceWriter:
    """One file: ids go in piece by piece, whole batches go out."""

    def __init__(self, uri: str, schema: pa.Schema):
        self.uri, self.length, self.pending, self.held = uri, 0, [], 0
        self.schema, self.kind = schema, schema.field("ids").type.value_type.to_pandas_dtype()
        self.sink = files.open_out(uri)
        self.writer = pa.ipc.new_file(self.sink, schema)

    def append(self, ids: np.ndarray) -> None:
        self.pending.append(ids.astype(self.kind))
        self.held += len(ids)
        self.length += len(ids)
        if self.held >= SEQUENCE * BATCH_ROWS:
            flat = np.concatenate(self.pending)
            whole = len(flat) - len(flat) % (SEQUENCE * BATCH_ROWS)
            for i in range(0, whole, SEQUENCE * BATCH_ROWS):
                self._batch(flat[i:i + SEQUENCE * BATCH_ROWS])
            self.pending, self.held = [flat[whole:]], len(flat) - whole

    def _batch(self, ids: np.ndarray) -> None:
        pad = -len(ids) % SEQUENCE
        mask = np.concatenate([np.ones(len(ids), bool), np.zeros(pad, bool)])
        ids = np.concatenate([ids, np.zeros(pad, self.kind)])
        self.writer.write_batch(pa.RecordBatch.from_arrays(
            [pa.FixedSizeListArray.from_arrays(pa.array(x), SEQUENCE) for x in (ids, mask)], schema=self.schema))

    def close(self) -> None:
        if self.held:
            self._batch(np.concatenate(self.pending))
        self.writer.close()
        self.sink.close()


class SequenceReader:
    """Random access to a file: views of its buffers, by place in its stream."""

    def __init__(self, uri: str):
        self.file = pa.ipc.open_file(files.open_random(uri))
        self.number, self.flat = -1, None

    def _batch(self, k: int) -> np.ndarray:
        if k != self.number:
            self.number, self.flat = k, self.file.get_batch(k).column(0).flatten().to_numpy()
        return self.flat

    def pieces(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids of places start .. start + n, as one view per batch."""
        per = SEQUENCE * BATCH_ROWS
        while n > 0:
            at = start % per
            piece = self._batch(start // per)[at:at + n]
            yield piece
            start, n = start + len(piece), n - len(piece)


def write_tokens(docs: DataFrame, folder: str, model: str, workspace: Workspace,
                 end_id: int = END_ID) -> DataFrame:
    """Writes the stream of all documents; returns the written index ``doc_id
    uri at start n_tokens``: a document is at place ``at`` of its file and at
    ``start`` of the whole stream. Equal ids are ordered by their texts' hash."""
    spark = docs.sparkSession
    arrow_limits(spark)
    shared = spark.sparkContext.broadcast(model)       # one tokenizer file, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out = None, None
        part = TaskContext.get().partitionId()
        for b in batches:
            if out is None:
                encoder = WordEncoder(shared.value)
                size = max(encoder.tokenizer.get_vocab_size(), end_id + 1)
                out = SequenceWriter(files.new_name(folder, ".arrow"), schema_of(size))
            for i in range(0, b.num_rows, SLICE):
                s = b.slice(i, SLICE)
                ids, n = encoder.encode(s.column(1))
                # an end id after each document
                full = np.insert(ids, np.cumsum(n), np.uint32(end_id))
                at = out.length + np.cumsum(n + 1) - (n + 1)
                out.append(full)
                yield pa.RecordBatch.from_arrays(
                    [s.column(0), pa.array([part] * s.num_rows, pa.int32()),
                     pa.array([out.uri] * s.num_rows, pa.string()), pa.array(at), pa.array(n + 1)],
                    names=["doc_id", "part", "uri", "at", "n_tokens"])
        if out is not None:
            out.close()

    rows = docs.select(F.col("doc_id").cast("long"), text_of("text").alias("text"))
    h = F.xxhash64("text")
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), h).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), h)
    index = workspace.save(rows.mapInArrow(run, "doc_id long, part int, uri string, at long, n_tokens long"),
                           "index")
    sizes = index.groupBy("part").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)     # a row per file
    bases = workspace.save(sizes.select("part", "n", F.coalesce(
        F.sum("tokens").over(before), F.lit(0)).alias("base")), "bases")
    placed = attach(index, bases, ["part"], "n", ["doc_id", "at"])
    return placed.select("doc_id", "uri", "at", (F.col("at") + F.col("base")).alias("start"), "n_tokens")


def read_tokens(index: DataFrame) -> DataFrame:
    """``doc_id start n_tokens ids_crc32`` of the index's documents, from the files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, reader = None, None
        for b in batches:
            crcs = []
            for u, at, n in zip(*(b.column(c).to_pylist() for c in (1, 2, 4)), strict=True):
                if u != uri:
                    uri, reader = u, SequenceReader(u)
                crc = 0
                for piece in reader.pieces(at, n):
                    crc = zlib.crc32(piece.astype("<u4", copy=False), crc)
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), b.column(4), pa.array(crcs, pa.int64())],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return index.select("doc_id", "uri", "at", "start", "n_tokens").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_arrow_tokens(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Null text is empty (its end id alone); null ids come first; repeated rows
    are documents of their own; an empty table gives no rows. ``tokenizer`` is
    the path of a tokenizer file."""
    if tokenizer is None:
        import public_tokenizers
        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    with open(tokenizer, encoding="utf-8") as f:
        model = f.read()
    ws = Workspace(spark, label="op4")
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), f"{ws.root}/tokens", model, ws))

"""Ranked lexical search: an inverted index, and hybrid TAAT-DAAT top-k over it.

Index: documents are cut into shards of about SHARD_BYTES of text, whose terms
are counted PIECE_BYTES of text at a time; no text is kept. A shard's
posting lists lie one after another in an Arrow file in the shared folder,
``(document, tf)`` by document, documents in ascending id; its dictionary is
part of a table ``(uri, term, df, at)`` that Spark joins with the terms of the
queries. Document frequencies are sums over that table.

Search: a task has one shard and a block of queries. For each query the
shortest lists are summed term at a time into accumulators, and the
accumulators then count as one more list, with bounds like the others. The
long lists and that one are walked document at a time, in blocks of documents:
a block whose summed list bounds stay below the k-th best score is skipped; in
the others, lists that cannot lift a document over it only complete
candidates that the rest has found, and a candidate is given up as soon as
the bounds of the lists to come cannot save it. Bounds decide what is skipped,
never what is found: results are exact. The best k of all shards are merged.

Scores are integers, see :func:`weights` and :class:`Shard`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkset.llm import files
from linkset.llm.common import arrow_limits, table, text_of
from linkset.plans.workspace import Workspace

TOP = 20
SHARD_BYTES = 16 << 20      # of text; a shard has one document at least
PIECE_BYTES = 1 << 20       # of text that is cut into terms at once; a piece has one document at least
POSTINGS = 1 << 16          # of a record batch
BLOCK_DOCS = 512            # walked together
SHORT_SHARE = 4             # short lists have 1/SHORT_SHARE as many postings as the shard has documents
QUERY_TERMS = 1 << 18       # of a block of queries
NO_ID = -(1 << 63)          # orders null ids before all others

#: What each byte of a text becomes: letters, digits and all beyond ASCII stay,
#: A-Z in lower case, anything else parts terms.
_KEEP = np.arange(256, dtype=np.uint8)
_KEEP[:128] = [b if bytes([b]).isalnum() else 32 for b in bytes(range(128)).lower()]


def split_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts, one after another, and the first term of each text (and the end)."""
    texts = pa.concat_arrays([texts.cast(pa.string())])        # from an offset of its own
    _, cuts, data = texts.buffers()
    if data is None or not len(texts):
        return pa.array([], pa.string()), np.zeros(len(texts) + 1, np.int64)
    plain = pa.py_buffer(_KEEP[np.frombuffer(data, np.uint8)])
    split = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(texts), cuts, plain))
    flat = split.flatten()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)   # blank ends give ""
    before = np.concatenate([[0], np.cumsum(real)])
    return flat.filter(pa.array(real)), before[split.offsets.to_numpy() - split.offsets[0].as_py()]


def _cuts(size: np.ndarray, room: int) -> list[int]:
    """Where rows of these sizes are cut into pieces of ``room`` at most, or of one row."""
    ends, cuts = np.cumsum(size, dtype=np.int64), [0]
    while (a := cuts[-1]) < len(size):
        held = int(ends[a - 1]) if a else 0
        cuts.append(max(a + 1, int(np.searchsorted(ends, held + room, side="right"))))
    return cuts


def _smallest(values: np.ndarray) -> np.ndarray:
    top = int(values.max()) if len(values) else 0
    return values.astype(np.uint16 if top < 1 << 16 else np.uint32)


ENTRY = "uri string, term string, df long, at long"


class ShardWriter:
    """Collects documents until they make a shard. Of their texts it holds what
    each document has of each term, and the terms of each piece once."""

    def __init__(self, folder: str):
        self.folder = folder
        self.clear()

    def clear(self) -> None:
        self.terms, self.counts, self.sizes, self.ids, self.rows, self.held = [], [], [], [], 0, 0

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        cuts = _cuts(pc.binary_length(texts).to_numpy(), PIECE_BYTES)
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            self._count(texts.slice(a, z - a))
        self.ids.append(ids.take(pa.array(np.arange(len(ids)))))       # a slice would keep its whole batch
        self.held += texts.nbytes

    def _count(self, texts: pa.Array) -> None:
        """Row, code in the piece's terms and tf: documents are whole, so a pair comes once."""
        terms, first = split_terms(texts)
        coded = terms.dictionary_encode()
        size, n = np.diff(first), max(len(coded.dictionary), 1)
        both, tf = np.unique(np.repeat(np.arange(len(size)), size) * n + coded.indices.to_numpy(), return_counts=True)
        row, code = np.divmod(both, n)
        self.terms.append(coded.dictionary)
        self.counts.append((_smallest(row + self.rows), _smallest(code), _smallest(tf)))
        self.sizes.append(size)
        self.rows += len(size)

    def flush(self) -> Iterator[pa.RecordBatch]:
        """Writes the shard, yields its dictionary. The entry without a term has
        the number of documents with a term, and of all terms."""
        if not self.rows:
            return
        ids = pa.concat_arrays(self.ids)
        size = np.concatenate(self.sizes)
        order = np.argsort(pc.fill_null(ids, NO_ID).to_numpy(), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        coded = pa.concat_arrays(self.terms).dictionary_encode()
        renamed = np.split(coded.indices.to_numpy().astype(np.int64), np.cumsum([len(t) for t in self.terms])[:-1])
        ends = np.cumsum([0, *(len(tf) for _, _, tf in self.counts)])
        both = np.empty(ends[-1], np.int64)
        for a, z, new, (row, code, _) in zip(ends[:-1], ends[1:], renamed, self.counts, strict=True):
            both[a:z] = new[code] * len(order) + place[row]
        tf = np.concatenate([tf for _, _, tf in self.counts])
        self.terms, self.counts = [], []
        by = np.argsort(both)
        tf, both = tf[by], both[by]
        del by
        code, doc = np.divmod(both, len(order))
        del both
        df = np.bincount(code, minlength=len(coded.dictionary))
        del code
        uri = files.new_name(self.folder, "")
        self._write(f"{uri}.docs", {"doc_id": ids.take(pa.array(order)), "n": pa.array(size[order])}, len(order))
        self._write(f"{uri}.postings", {"doc": pa.array(_smallest(doc)), "tf": pa.array(_smallest(tf))}, POSTINGS)
        terms = pa.concat_arrays([coded.dictionary, pa.array([None], pa.string())])
        at = np.concatenate([np.cumsum(df) - df, [size.sum()]])
        df = np.concatenate([df, [np.count_nonzero(size)]])
        for i in range(0, len(df), POSTINGS):
            some = slice(i, i + POSTINGS)
            yield pa.RecordBatch.from_arrays(
                [pa.array([uri] * len(df[some]), pa.string()), terms.slice(i, POSTINGS), pa.array(df[some]),
                 pa.array(at[some])], names=["uri", "term", "df", "at"])
        self.clear()

    def _write(self, uri: str, columns: dict[str, pa.Array], rows: int) -> None:
        whole = pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])
        with files.open_out(uri) as sink, pa.ipc.new_file(sink, whole.schema) as out:
            for i in range(0, whole.num_rows, rows):
                out.write_batch(whole.slice(i, rows))


def build_index(docs: DataFrame, folder: str, workspace: Workspace) -> DataFrame:
    """Indexes all of ``docs`` (doc_id, text); returns the written dictionary."""
    arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = ShardWriter(folder)
        for b in batches:
            size = pc.binary_length(b.column(1)).to_numpy()
            cuts = _cuts(size, SHARD_BYTES)     # a shard at most, or one document
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                part = b.slice(a, z - a)
                if shard.held + size[a:z].sum() > SHARD_BYTES:
                    yield from shard.flush()
                shard.add(part.column(0), part.column(1))
        yield from shard.flush()

    rows = docs.select(F.col("doc_id").cast("long"), text_of("text").alias("text"))
    return workspace.save(rows.mapInArrow(run, ENTRY), "dictionary")


class Postings:
    """One list of a shard under its weight."""

    def __init__(self, doc: np.ndarray, score: np.ndarray, cuts: np.ndarray | None):
        self.doc, self.score = doc, score
        if cuts is not None:
            self.bounded(cuts)

    def bounded(self, cuts: np.ndarray) -> Postings:
        """Where each block of documents begins, and the block's largest score."""
        self.first = np.searchsorted(self.doc, cuts)
        self.top = np.zeros(len(cuts) - 1, np.int64)
        there = np.flatnonzero(self.first[1:] > self.first[:-1])
        if len(there):
            self.top[there] = np.maximum.reduceat(self.score, self.first[there])
        return self


class Shard:
    """The lists of one shard. A document of n terms, in a corpus of N documents
    with L terms, has m = 100 - 25 + 25 n N div L; a term of weight w adds
    w * (1000000000 tf div (1000 tf + 12 m)) to its score."""

    def __init__(self, uri: str, n_docs: int, n_terms: int):
        docs = pa.ipc.open_file(files.open_random(f"{uri}.docs")).read_all()
        self.ids = docs.column("doc_id").combine_chunks()
        size = docs.column("n").to_numpy()
        share = 25 * n_docs
        if share * int(size.max(initial=0)) < 1 << 63:
            self.m = 75 + size * share // max(n_terms, 1)
        else:
            self.m = np.array([75 + n * share // n_terms for n in size.tolist()], np.int64)
        self.file = pa.ipc.open_file(files.open_random(f"{uri}.postings"))
        self.cuts = np.append(np.arange(0, len(size), BLOCK_DOCS), len(size))
        self.lists: dict[str, Postings] = {}
        self.held = (-1, None)

    def _pieces(self, at: int, n: int) -> Iterator[pa.RecordBatch]:
        while n > 0:
            k, i = divmod(at, POSTINGS)
            if self.held[0] != k:
                self.held = (k, self.file.get_batch(k))
            piece = self.held[1].slice(i, n)
            yield piece
            at, n = at + piece.num_rows, n - piece.num_rows

    def load(self, term: str, at: int, df: int, weight: int) -> None:
        pieces = list(self._pieces(at, df))
        doc, tf = (np.concatenate([p.column(c).to_numpy() for p in pieces]).astype(np.int64) for c in (0, 1))
        score = weight * (1_000_000_000 * tf // (1000 * tf + 12 * self.m[doc]))
        self.lists[term] = Postings(doc, score, self.cuts)

    def best(self, query: list[tuple[str, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best documents, best first, then by id."""
        lists = sorted(((self.lists[t], q) for t, q in query if t in self.lists), key=lambda x: len(x[0].doc))
        room = len(self.ids) // SHORT_SHARE
        n_short = int(np.searchsorted(np.cumsum([len(x.doc) for x, _ in lists]), room, side="right"))
        walked = [(x.doc, q * x.score if q > 1 else x.score, x.first, q * x.top) for x, q in lists[n_short:]]
        least = 1                   # what a document must reach
        if n_short:                 # term at a time
            total = np.zeros(len(self.ids), np.int64)
            for x, q in lists[:n_short]:
                total[x.doc] += q * x.score
            doc = np.flatnonzero(total)
            acc = Postings(doc, total[doc], self.cuts)
            if len(doc) >= k:       # the rest only adds to these
                least = max(1, int(np.partition(acc.score, -k)[-k]))
            walked.append((acc.doc, acc.score, acc.first, acc.top))
        got, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not walked:
            return got, score
        bounds = np.stack([w[3] for w in walked])
        whole = bounds.sum(axis=0)
        for b in np.flatnonzero(whole >= least).tolist():      # document at a time
            if whole[b] < least:
                continue
            place, points = self._walk(walked, bounds[:, b], b, least)
            if not len(place):
                continue
            got, score = np.concatenate([got, place]), np.concatenate([score, points])
            if len(got) >= k:       # later documents have larger ids: equal scores come too late
                keep = np.lexsort((got, -score))[:k]
                got, score = got[keep], score[keep]
                least = max(least, int(score[-1]) + 1)
        order = np.lexsort((got, -score))[:k]
        return got[order], score[order]

    def _walk(self, walked: list, tops: np.ndarray, b: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of block ``b`` that reach ``least``, with their scores."""
        base, n = self.cuts[b], self.cuts[b + 1] - self.cuts[b]
        order = np.argsort(tops, kind="stable")
        reach = np.cumsum(tops[order])
        weak = int(np.searchsorted(reach, least))       # these alone reach less
        total = np.zeros(n, np.int64)
        for i in order[weak:].tolist():
            doc, score, first, _ = walked[i]
            a, z = first[b], first[b + 1]
            total[doc[a:z] - base] += score[a:z]
        place = np.flatnonzero(total)
        points = total[place]
        for j in range(weak - 1, -1, -1):               # largest bound first
            alive = points + reach[j] >= least
            place, points = place[alive], points[alive]
            if not len(place):
                break
            doc, score, first, _ = walked[order[j]]
            a, z = first[b], first[b + 1]
            if a < z:
                at = np.minimum(np.searchsorted(doc[a:z], place + base), z - a - 1) + a
                points = points + np.where(doc[at] == place + base, score[at], 0)
        alive = points >= least
        return place[alive] + base, points[alive]


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """``item term q``: the terms of each query and how often they come."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms, first = split_terms(b.column(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), np.diff(first)))), terms],
                names=["item", "term"])

    kind = dict(queries.dtypes)[key]
    rows = queries.select(F.col(key).alias("item"), text_of(text).alias("text"))
    return rows.mapInArrow(run, f"item {kind}, term string").groupBy("item", "term").agg(
        F.count(F.lit(1)).alias("q"))


def weights(entries: DataFrame, n_docs: int) -> DataFrame:
    """``term w``: floor(1000 ln((2 N + 2) / (2 df + 1))) from the shards' df."""
    df = entries.groupBy("term").agg(F.sum("df").alias("df"))
    idf = F.log(F.lit(2.0 * n_docs + 2.0) / (F.lit(2.0) * F.col("df") + F.lit(1.0)))
    return df.select("term", F.floor(F.lit(1000.0) * idf).cast("long").alias("w"))


def _searched(entries: DataFrame, queries: list[tuple], kind: str, n_shards: int, n_docs: int, n_terms: int,
              k: int) -> DataFrame:
    """``item doc_id score``: each shard's best for one block of queries."""
    shared = entries.sparkSession.sparkContext.broadcast(queries)      # QUERY_TERMS terms and one query at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted: dict = {}
        for item, term, q in shared.value:
            wanted.setdefault(item, []).append((term, q))
        uri, shard = None, None

        def found() -> Iterator[pa.RecordBatch]:
            for item, query in wanted.items():
                place, score = shard.best(query, k)
                if len(place):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item] * len(place), kind), shard.ids.take(pa.array(place)), pa.array(score)],
                        names=["item", "doc_id", "score"])

        for b in batches:
            for u, term, df, at, w in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if u != uri:
                    if shard is not None:
                        yield from found()
                    uri, shard = u, Shard(u, n_docs, n_terms)
                shard.load(term, at, df, w)
        if shard is not None:
            yield from found()

    # a shard is little to read and much to do: as many tasks as keep two shards apart
    dealt = entries.repartition(max(1, min(4 * n_shards, 20_000)), "uri").sortWithinPartitions("uri", "at")
    return dealt.select("uri", "term", "df", "at", "w").mapInArrow(
        run, f"item {'string' if kind == pa.string() else 'long'}, doc_id long, score long")


def search(index: DataFrame, queries: DataFrame, workspace: Workspace, key: str = "item_id",
           text: str = "text", k: int = TOP) -> DataFrame:
    """``key rank doc_id score``: the ``k`` best documents of each query with a
    score above 0, equal scores by ascending doc_id (null first).

    Queries with one ``key`` (null is one) are one query with all their terms;
    a query without terms, or without a document, has no rows. ``index`` is
    what :func:`build_index` returned: repeated documents are ranked each, a
    null or empty text never.
    """
    spark = index.sparkSession
    integral = dict(queries.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    kind = pa.int64() if integral else pa.string()
    asked = queries.withColumn(key, F.col(key).cast("long" if integral else "string"))
    wanted = workspace.save(query_terms(asked, key, text), "queries")
    n_docs, n_terms, n_shards = index.where("term IS NULL").agg(
        F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("at"), F.lit(0)), F.count(F.lit(1))).first()
    hits = index.where("term IS NOT NULL").join(wanted.select("term").distinct(), "term", "left_semi")
    hits = workspace.save(hits, "entries")
    hits = workspace.save(hits.join(weights(hits, n_docs), "term"), "weighted")
    blocks = max(1, math.ceil(wanted.count() / QUERY_TERMS))
    found = []
    for i in range(blocks):         # the query set, block by block
        block = wanted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i)
        rows = [tuple(r) for r in block.sort("item", "term").collect()]
        entries = hits if blocks == 1 else hits.join(block.select("term").distinct(), "term", "left_semi")
        found.append(workspace.save(_searched(entries, rows, kind, n_shards, n_docs, n_terms, k), f"best{i}"))
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        F.col("item").alias(key), "rank", "doc_id", "score")


def op11_hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all documents for each benchmark item. Nulls, ties,
    repeated rows and empty texts as in :func:`search`; empty tables give no
    rows; texts of any length are indexed whole."""
    ws = Workspace(spark, label="op11")
    index = build_index(table(spark, sf_dir, "documents"), f"{ws.root}/postings", ws)
    return search(index, table(spark, sf_dir, "benchmark"), ws)


OP11_SQL = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
f AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY doc_id, term),
size AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM f GROUP BY doc_id),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM size),
m AS (SELECT doc_id, 100 - 25 + ((25 * n * docs) // terms) AS m FROM size, total),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w
      FROM f, total GROUP BY term, docs),
q AS (SELECT item_id, unnest(regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, f.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
      FROM q JOIN f USING (term) JOIN w USING (term) JOIN m ON m.doc_id = f.doc_id GROUP BY item_id, f.doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
       doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20
"""

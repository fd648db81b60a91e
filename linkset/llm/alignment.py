"""Two tokenizers' tokens of the same texts, aligned by bytes.

A document's tokens end at byte offsets, an ascending list for each tokenizer.
The offsets where both end are found by galloping: from its rank's share of
the longer list, each end of the shorter one doubles its steps until it has
passed its place and halves them back to it. Common ends cut both
token lists into groups, the differences of their ranks are the groups' token ranges,
and all pairs of one group are linked.

How often documents hold a pair of ids linked is counted over the corpus. A
task aligns blocks of documents; a block's file in the shared folder has each
document's distinct pairs as ranks in the block's own list of pairs, and
that list goes to Spark: ``(block, rank, pair, documents)``. Summed by pair and joined
back, it returns to the block as plain arrays by rank. So neither texts nor tokens are shuffled, and no
text is tokenized twice.

Tokenizing would cost most. Where neither tokenizer has a token that goes on
over a space between two characters that are none (their files
tell), a text is cut there, and a worker tokenizes each different
chunk once; else it gets whole texts. The tokens are the same.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from linkset.llm import files
from linkset.llm.common import arrow_limits, table, text_of
from linkset.plans.workspace import Workspace

BLOCK_BYTES = 16 << 20      # of text; a block has one document at least
SLICE_BYTES = 1 << 20       # of text, aligned at once; one document at least
PAIRS = 1 << 22             # linked pairs looked at at once
CHUNK_BYTES = 64 << 20      # of chunks that a worker remembers

STATS = ["n_a", "n_b", "n_groups", "n_links"]
HELD = "block long, rank int, pair long, documents long"
ALIGNED = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
           "groups_sha256 string")


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of the stretches start .. start + size, one after another."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)


class Strings:
    """A fixed list of byte strings that can be joined by their numbers."""

    def __init__(self, values: list[bytes]):
        self.size = np.array([len(v) for v in values], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(values), np.uint8)

    def join(self, which: np.ndarray) -> np.ndarray:
        return self.data[_spread(self.start[which], self.size[which])]


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: visible bytes
    of Latin-1 are themselves, the others follow from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteLevel:
    """A byte-level tokenizer from its JSON; it gets each text with a space before it."""

    def __init__(self, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark has a task for each core
        self.tokenizer = Tokenizer.from_str(model.decode())
        self.tokenizer.encode_special_tokens = True
        letters = byte_letters()
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.tokens = Strings([bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
                               for t in names])
        self.apart = self._apart(json.loads(model))

    @staticmethod
    def _apart(spec: dict) -> bool:
        """Whether its own pattern parts texts at such spaces, and nothing comes before it."""
        first = spec.get("pre_tokenizer") or {}
        return (first.get("type") == "ByteLevel" and first.get("use_regex", True)
                and not first.get("add_prefix_space") and not spec.get("normalizer")
                and spec["model"].get("type") == "BPE" and not spec["model"].get("dropout")
                and all(t["special"] for t in spec.get("added_tokens", [])))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts],
                                                                add_special_tokens=False)]


class Pieces:
    """A sentencepiece model that puts a space before each text itself."""

    def __init__(self, model: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.tokens = Strings([self._bytes(i, n) for i, n in enumerate(names)])
        self.apart = not any("▁" in n.lstrip("▁") for n in names)

    def _bytes(self, i: int, name: str) -> bytes:
        if self.model.is_control(i) or self.model.is_unknown(i):
            return b""
        return bytes([int(name[3:5], 16)]) if self.model.is_byte(i) else name.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


KINDS = {"byte_level": ByteLevel, "pieces": Pieces}


def _loaded(kind: str, model: bytes):
    """A worker serves many tasks: it keeps what it has loaded."""
    kept = tokenizers.__dict__.setdefault("_linkset_aligned", {})
    key = (kind, hashlib.sha1(model).digest())
    if key not in kept:
        kept[key] = KINDS[kind](model)
    return kept[key]


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, ids), np.int64, count=len(ids))
    return np.fromiter(itertools.chain.from_iterable(ids), np.int64, count=int(n.sum())), n


def chunks_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The texts cut before each space that stands between two characters that
    are not white space: the different chunks (without that space, as the
    first of a text has none), the number of each chunk in order, and the
    first chunk of each text (and the end)."""
    split = pc.split_pattern(texts, " ")
    coded = split.flatten().dictionary_encode()
    values, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    first = split.offsets.to_numpy() - split.offsets[0].as_py()
    head = np.array([bool(v) and not v[0].isspace() for v in values], bool)
    tail = np.array([bool(v) and not v[-1].isspace() for v in values], bool)
    begins = np.ones(len(which), bool)
    begins[1:] = tail[which[:-1]] & head[which[1:]]
    begins[first[:-1]] = True
    at = np.flatnonzero(begins)
    upto = np.append(at[1:], len(which))
    number, more = which[at].astype(np.int64), {}
    for g in np.flatnonzero(upto - at > 1).tolist():        # runs of white space, and what is around them
        joined = " ".join([values[i] for i in which[at[g]:upto[g]].tolist()])
        number[g] = more.setdefault(joined, len(values) + len(more))
    used, number = np.unique(number, return_inverse=True)
    every = [*values, *more]
    return [every[i] for i in used.tolist()], number, np.searchsorted(at, first)


class Chunks:
    """The ids of both tokenizers for chunks met so far."""

    def __init__(self, a, b):
        self.sides = (a, b)
        self.apart = a.apart and b.apart
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.held = 0
        self.ok = np.zeros(0, bool)
        self.ids = [np.zeros(0, np.int64) for _ in range(2)]
        self.size = [np.zeros(0, np.int64) for _ in range(2)]

    def rows(self, chunks: list[str]) -> np.ndarray:
        if self.held > CHUNK_BYTES:
            self.clear()
        new = [c for c in chunks if c not in self.row]
        if new:
            self._learn(new)
        return np.fromiter(map(self.row.__getitem__, chunks), np.int64, count=len(chunks))

    def _learn(self, new: list[str]) -> None:
        self.row.update(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
        want = [b" " + c.encode() for c in new]
        self.held += sum(map(len, want)) + 64 * len(want)
        ok = np.ones(len(new), bool)
        for k, side in enumerate(self.sides):
            ids, n = _flat(side.encode(new))
            got = side.tokens.join(ids)
            upto = np.concatenate([[0], np.cumsum(side.tokens.size[ids])])[np.concatenate([[0], np.cumsum(n)])]
            # one that a tokenizer alters has no tokens
            ok &= np.array([got[x:y].tobytes() == w for x, y, w in zip(upto, upto[1:], want, strict=False)], bool)
            self.ids[k] = np.concatenate([self.ids[k], ids])
            self.size[k] = np.concatenate([self.size[k], n])
        self.ok = np.concatenate([self.ok, ok])

    def encode(self, texts: pa.Array):
        """Ids and their number in each text, for both sides; a text that either
        tokenizer alters, and an empty one, has none."""
        if self.apart:
            values, number, first = chunks_of(texts)
        else:
            self.clear()
            values, number = np.unique(np.array(texts.to_pylist(), object), return_inverse=True)
            values, first = values.tolist(), np.arange(len(texts) + 1)
        row = self.rows(values)[number]
        per = np.diff(first)
        doc = np.repeat(np.arange(len(texts)), per)
        good = pc.binary_length(texts).to_numpy() > 0
        good[doc[~self.ok[row]]] = False
        row, doc = row[good[doc]], doc[good[doc]]
        out = []
        for ids, size in zip(self.ids, self.size, strict=True):
            start = np.cumsum(size) - size
            n = np.zeros(len(texts), np.int64)
            np.add.at(n, doc, size[row])
            out.append((ids[_spread(start[row], size[row])], n))
        return out


def gallop(short: np.ndarray, long: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each of ``short`` the first place of ``long`` (ascending, its last not
    below any of ``short``) that is not below it, searched from place ``at``."""
    last = len(long) - 1
    right = long[at] < short
    lo, hi = np.where(right, at, -1), np.where(right, last, at)     # long[lo] < short <= long[hi]
    todo, step = np.arange(len(short)), 1
    while len(todo):                    # doubling
        to_right = right[todo]
        probe = np.clip(np.where(to_right, lo[todo], hi[todo]) + np.where(to_right, step, -step), 0, last)
        less = long[probe] < short[todo]
        lo[todo[less]] = probe[less]
        hi[todo[~less]] = probe[~less]
        todo = todo[(less == to_right) & (hi[todo] - lo[todo] > 1) & (probe != np.where(to_right, last, 0))]
        step *= 2
    todo = np.flatnonzero(hi - lo > 1)
    while len(todo):                    # halving
        mid = (lo[todo] + hi[todo]) >> 1
        less = long[mid] < short[todo]
        lo[todo[less]] = mid[less]
        hi[todo[~less]] = mid[~less]
        todo = todo[hi[todo] - lo[todo] > 1]
    return hi


def common_ends(a_end: np.ndarray, b_end: np.ndarray, n_a: np.ndarray, n_b: np.ndarray):
    """Ranks in both lists of the ends they share. The lists are those of several
    documents, laid end to end: ``n_a`` and ``n_b`` entries each."""
    a_first, b_first = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    swap = n_a > n_b                    # B drives where it is the shorter
    n_short = np.where(swap, n_b, n_a)
    n_long = np.where(swap, n_a, n_b)
    both = np.concatenate([a_end, b_end])
    drive = _spread(np.where(swap, len(a_end) + b_first, a_first), n_short)
    other = _spread(np.where(swap, a_first, len(a_end) + b_first), n_long)
    rank = np.arange(len(drive)) - np.repeat(np.cumsum(n_short) - n_short, n_short)
    ratio = np.divide(n_long, n_short, out=np.zeros(len(n_a)), where=n_short > 0)
    guess = np.repeat(np.cumsum(n_long) - n_long, n_short) + (rank * np.repeat(ratio, n_short)).astype(np.int64)
    if not len(drive):
        return drive, drive
    hit = gallop(both[drive], both[other], guess)
    same = both[other[hit]] == both[drive]
    x, y = drive[same], other[hit[same]]
    return np.minimum(x, y), np.maximum(x, y) - len(a_end)


class Aligned:
    """The alignment of a slice of texts."""

    def __init__(self, texts: pa.Array, chunks: Chunks):
        self.n = len(texts)
        a, b = chunks.sides
        (self.a, self.n_a), (self.b, self.n_b) = chunks.encode(texts)
        a_at, b_at = common_ends(np.cumsum(a.tokens.size[self.a]), np.cumsum(b.tokens.size[self.b]),
                                 self.n_a, self.n_b)
        self.size_a, self.size_b = (np.diff(np.concatenate([[-1], at])) for at in (a_at, b_at))
        doc = np.repeat(np.arange(self.n), self.n_a)
        self.doc = doc[a_at] if len(a_at) else doc              # of each group
        self.n_groups = np.bincount(self.doc, minlength=self.n)
        self.n_links = np.zeros(self.n, np.int64)
        np.add.at(self.n_links, self.doc, self.size_a * self.size_b)

    def pairs(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct ``a * width + b`` of each document, with its document and how
        often it is linked there."""
        a_at, b_at = np.cumsum(self.size_a) - self.size_a, np.cumsum(self.size_b) - self.size_b
        links = self.size_a * self.size_b
        big = links > PAIRS
        parts = []
        small = np.flatnonzero(~big)
        load = np.cumsum(links[small])
        cuts = np.searchsorted(load, np.arange(0, load[-1], PAIRS), side="right") if len(small) else []
        for g in np.split(small, cuts):
            n = links[g]
            of = np.repeat(np.arange(len(g)), n)
            t = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            wide = self.size_b[g][of]
            code = self.a[a_at[g][of] + t // wide] * width + self.b[b_at[g][of] + t % wide]
            parts.append(self._summed(self.doc[g][of], code, None))
        for g in np.flatnonzero(big).tolist():      # by distinct ids, some of A's at a time
            xs, nx = np.unique(self.a[a_at[g]:a_at[g] + self.size_a[g]], return_counts=True)
            ys, ny = np.unique(self.b[b_at[g]:b_at[g] + self.size_b[g]], return_counts=True)
            rows = max(1, PAIRS // len(ys))
            for i in range(0, len(xs), rows):
                code = (xs[i:i + rows, None] * width + ys).reshape(-1)
                parts.append((np.full(len(code), self.doc[g]), code,
                              (nx[i:i + rows, None] * ny).reshape(-1)))
        return parts[0] if len(parts) == 1 else self._summed(*map(np.concatenate, zip(*parts, strict=True)))

    @staticmethod
    def _summed(doc: np.ndarray, code: np.ndarray, times: np.ndarray | None):
        """Equal (doc, code) together, in order; without ``times`` each counts once."""
        width = int(code.max(initial=0)) + 1
        key = doc * width + code                # a slice has few documents: this fits
        if times is None:
            key.sort()
        else:
            order = np.argsort(key, kind="stable")
            key, times = key[order], times[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[:len(key)])
        if times is None:
            times = np.diff(np.append(first, len(key)))
        elif len(first):
            times = np.add.reduceat(times, first)
        return key[first] // width, key[first] % width, times

    def digests(self, numbers: Strings) -> list[str]:
        """Of ``a1,a2|b1;a3|b2,b3``: all groups of a document with their ids."""
        a_last, b_last = np.cumsum(self.size_a) - 1, np.cumsum(self.size_b) - 1
        a_put = np.arange(len(self.a)) + np.repeat(b_last + 1 - self.size_b, self.size_a)
        b_put = np.arange(len(self.b)) + np.repeat(a_last + 1, self.size_b)
        a_item, b_item = 3 * self.a, 3 * self.b
        a_item[a_last] += 1
        b_item[b_last] += 2
        item = np.empty(len(a_put) + len(b_put), np.int64)
        item[a_put], item[b_put] = a_item, b_item
        flat = numbers.join(item)
        ends = np.concatenate([[0], np.cumsum(numbers.size[item])])[
            np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])]
        return [hashlib.sha256(flat[x:y - 1]).hexdigest() if y > x else ""
                for x, y in itertools.pairwise(ends.tolist())]


def _numbers(n: int) -> Strings:
    """Item 3 i + s is number i with a comma, a bar or a semicolon behind it."""
    return Strings([str(i).encode() + s for i in range(n) for s in (b",", b"|", b";")])


def _uri(folder: str, block: int) -> str:
    return f"{folder}/{block:016x}.arrow"


BLOCK = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in STATS], ("groups_sha256", pa.string()),
                   ("pairs", pa.list_(pa.uint32())), ("times", pa.list_(pa.int64()))])


class BlockWriter:
    """Collects aligned slices until they make a block."""

    def __init__(self, folder: str, width: int):
        self.folder, self.width = folder, width
        self.clear()

    def clear(self) -> None:
        self.held, self.docs, self.rows = 0, 0, []

    def add(self, ids: pa.Array, found: Aligned, digests: list[str], size: int) -> None:
        doc, code, times = found.pairs(self.width)
        stats = [pa.array(getattr(found, c).astype(np.int64)) for c in STATS]
        self.rows.append((ids, *stats, pa.array(digests, pa.string()), doc + self.docs, code, times))
        self.docs += found.n
        self.held += size

    def flush(self) -> Iterator[pa.RecordBatch]:
        """Writes the block, yields its pairs by rank. Rank -1 stands for the block itself."""
        if not self.docs:
            return
        plain = [pa.concat_arrays(c) for c in list(zip(*self.rows, strict=True))[:6]]
        doc, code, times = (np.concatenate(c) for c in list(zip(*self.rows, strict=True))[6:])
        pairs, rank, held = np.unique(code, return_inverse=True, return_counts=True)
        # ranks ascend within a document: their differences are small and pack well
        cuts = np.searchsorted(doc, np.arange(self.docs + 1))
        step = np.diff(rank, prepend=0)
        starts = cuts[:-1][cuts[:-1] < cuts[1:]]
        step[starts] = rank[starts]
        lists = [pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(x))
                 for x in (step.astype(np.uint32), times)]
        block = uuid.uuid4().int >> 65
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        with files.open_out(_uri(self.folder, block)) as sink, pa.ipc.new_file(sink, BLOCK, options=options) as out:
            out.write_batch(pa.RecordBatch.from_arrays([*plain, *lists], schema=BLOCK))
        n = len(pairs) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, block)), pa.array(np.arange(-1, n - 1, dtype=np.int32)),
             pa.array(np.concatenate([[-1], pairs])), pa.array(np.concatenate([[0], held]))],
            names=["block", "rank", "pair", "documents"])
        self.clear()


def align(docs: DataFrame, folder: str, a: tuple[str, bytes], b: tuple[str, bytes], width: int) -> DataFrame:
    """Aligns ``docs`` (doc_id, text) and writes them in blocks; yields each block's
    ``(block, rank, pair, documents)``. ``a`` and ``b`` are kinds and contents
    of tokenizer files, ``width`` is more than any id of ``b``."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((a, b))          # two tokenizer files, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = (_loaded(*x) for x in shared.value)
        chunks = tokenizers.__dict__["_linkset_aligned"].setdefault((id(one), id(two)), Chunks(one, two))
        numbers = _numbers(max(len(one.tokens.size), len(two.tokens.size)))
        block = BlockWriter(folder, width)
        for batch in batches:
            size = pc.binary_length(batch.column(1)).to_numpy()
            done = 0
            while done < batch.num_rows:
                room = int(np.searchsorted(np.cumsum(size[done:]), SLICE_BYTES, side="right"))
                piece = batch.slice(done, max(1, room))
                load = int(size[done:done + piece.num_rows].sum())
                if block.held + load > BLOCK_BYTES:
                    yield from block.flush()
                found = Aligned(piece.column(1), chunks)
                block.add(piece.column(0), found, found.digests(numbers), load)
                done += piece.num_rows
        yield from block.flush()

    return docs.select("doc_id", "text").mapInArrow(run, HELD)


def pair_counts(held: DataFrame, workspace: Workspace, width: int) -> DataFrame:
    """``pair total best``: documents that hold the pair linked, and whether no
    pair of its A id is held by more."""
    totals = workspace.save(held.where("rank >= 0").groupBy("pair").agg(F.sum("documents").alias("total")),
                            "totals")
    a = F.expr(f"pair div {width}")
    highest = totals.groupBy(a.alias("a")).agg(F.max("total").alias("highest"))      # a row for each id of A
    return totals.withColumn("a", a).join(F.broadcast(highest), "a").select(
        "pair", "total", (F.col("total") == F.col("highest")).alias("best"))


def judged(held: DataFrame, counts: DataFrame, folder: str) -> DataFrame:
    """Each block's documents, with the counts of their links."""
    def documents(block: int, rank: np.ndarray, total: np.ndarray, best: np.ndarray) -> Iterator[pa.RecordBatch]:
        real = rank >= 0
        by_rank, is_best = (np.zeros(int(rank.max()) + 1, np.int64) for _ in range(2))
        by_rank[rank[real]], is_best[rank[real]] = total[real], best[real]
        source = pa.ipc.open_file(files.open_random(_uri(folder, block)))
        for i in range(source.num_record_batches):
            b = source.get_batch(i)
            cuts = b.column("pairs").offsets.to_numpy().astype(np.int64)
            step = b.column("pairs").flatten().to_numpy().astype(np.int64)
            times = b.column("times").flatten().to_numpy()
            run = np.cumsum(step)
            n = np.diff(cuts)
            before = np.concatenate([[0], run])[cuts[:-1]]
            at = run - np.repeat(before, n)
            sums = (np.concatenate([[0], np.cumsum(x)]) for x in (times * is_best[at], times * by_rank[at]))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], *(pa.array(np.diff(s[cuts])) for s in sums), b.column("groups_sha256")],
                names=["doc_id", *STATS, "n_best", "count_sum", "groups_sha256"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        now = None
        for b in batches:
            cols = [b.column(0).to_numpy(), b.column(1).to_numpy(),
                    *(pc.fill_null(b.column(i).cast(pa.int64()), 0).to_numpy() for i in (2, 3))]
            first = np.flatnonzero(np.concatenate([[True], cols[0][1:] != cols[0][:-1]])[:b.num_rows])
            for x, y in zip(first, [*first[1:], b.num_rows], strict=True):
                if now is not None and cols[0][x] != now:
                    yield from documents(int(now), *map(np.concatenate, zip(*parts, strict=True)))
                    parts = []
                now = cols[0][x]
                parts.append([c[x:y] for c in cols[1:]])
        if now is not None:
            yield from documents(int(now), *map(np.concatenate, zip(*parts, strict=True)))

    told = held.where("rank >= 0").join(counts, "pair").select("block", "rank", "total", "best")
    none = held.where("rank < 0").select("block", "rank", F.lit(None).cast("long").alias("total"),
                                         F.lit(None).cast("boolean").alias("best"))
    return told.unionByName(none).repartition("block").sortWithinPartitions("block", "rank").mapInArrow(run, ALIGNED)


def aligned(docs: DataFrame, workspace: Workspace, a: tuple[str, bytes], b: tuple[str, bytes]) -> DataFrame:
    """``doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256`` of every row.

    A null or empty text, and one that either tokenizer does not give back
    byte for byte, has no tokens: zeros and ''. Every row is a document of
    its own, also with a null or repeated id; pairs with equal counts are all
    best; an empty table gives no rows; other columns are ignored.
    """
    arrow_limits(docs.sparkSession)
    folder = f"{workspace.root}/aligned"
    width = len(_loaded(*b).tokens.size)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    held = workspace.save(align(rows, folder, a, b, width), "held")
    return judged(held, pair_counts(held, workspace, width), folder)


def op12_galloping_alignment(spark: SparkSession, sf_dir: str, byte_level: str | None = None,
                             pieces: str | None = None) -> DataFrame:
    """All documents by two public tokenizers; ``byte_level`` and ``pieces`` are the
    paths of their files. Nulls, empty and very long texts, ties and repeated
    rows as in :func:`aligned`."""
    import public_tokenizers
    models = []
    for kind, path in (("byte_level", byte_level or public_tokenizers.path("byte_bpe_50k.json")),
                       ("pieces", pieces or public_tokenizers.path("piece_bpe_32k.model"))):
        with open(path, "rb") as f:
            models.append((kind, f.read()))
    return aligned(table(spark, sf_dir, "documents"), Workspace(spark, label="op12"), *models)

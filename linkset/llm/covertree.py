"""All pairs of vectors with a cosine at or above a threshold, by cover trees.

On unit vectors a cosine threshold is a distance: ``sqrt(2 - 2 * cosine)``.
Vectors hang in trees whose levels have halving radii: a node's points lie
within its covering radius, its children cover them with half the level's
radius. Two nodes whose centres are further apart than the threshold plus both
covering radii have no pair between them, and the walk over node pairs drops
them with everything below.

The top of the tree is fitted on a bounded sample (SAMPLE vectors); every
vector then hangs below its nearest top leaf. The vectors of neighbouring
leaves (or a share of a large one) are cut by a tree into blocks of at most BLOCK
vectors, each with a centre, a covering radius and a tree of its own. Some
blocks lie in a file in the shared folder, a shelf: every vector is written
once, and tasks are dealt pairs of shelves by name. The walk over shelves
and blocks uses their centres and radii, the walk over two blocks' trees ends
at their last level. Where that has to compare most nodes, a few directions and
the length of the rest of each vector bound the dot products (Cauchy-Schwarz).
Exact dot products in double precision decide about what the walks leave over.
Equal vectors are one point with a count. A task sends on how many links each
point has, and a forest of them, never the pairs.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkset.llm import files
from linkset.llm.common import arrow_limits, attach, class_labels, table
from linkset.plans.workspace import Workspace

COSINE = 0.95
SAMPLE = 2048
BLOCK = 2048
LEVELS = 5             # radii 2, 1, 1/2, 1/4, 1/8, then the points
SLACK = 1e-9           # for rounding in bounds; pairs are decided exactly
SHELF = 16             # blocks of a file, about
SHELF_BYTES = 8 << 20  # of a shelf's vectors in single precision, or one block
SHELVES = 32           # a small table has about so many, so that their pairs keep all cores busy
PAIRS = 1 << 26        # pairs of vectors that a task gets, about
ROWS, TILE = 2048, 64  # nodes of either side that are compared at once: the products stay in the cache
LESS = 8               # a level of a stored tree has so many times fewer nodes than the next
NARROW = (7, 11, 15, 19, 23, 31, 47)   # directions, with the rest's length a multiple of four
PASS = 5e-5            # share of a sample's pairs that the directions may leave over
ROUNDED = 1e-5         # for rounding in single precision
GATHER = 1 << 20       # numbers of either side that are gathered at once


def _covered(unit: np.ndarray, points: np.ndarray, radius: float) -> Iterator[np.ndarray]:
    """Cuts the points into parts, each within ``radius`` of its first point;
    the first part has the first point."""
    if len(points) == 1:
        yield points
        return
    u, left = unit[points], np.ones(len(points), bool)
    for s in range(0, len(points), 512):
        if not left[s:s + 512].any():
            continue
        near = 2.0 - 2.0 * (u[s:s + 512] @ u.T) <= radius * radius
        np.fill_diagonal(near[:, s:], True)
        alone = np.count_nonzero(near, axis=1) == 1
        for r in range(len(near)):
            if not left[s + r]:
                continue
            if alone[r]:
                left[s + r] = False
                yield points[s + r:s + r + 1]
                continue
            inside = near[r] & left
            left &= ~inside
            yield points[inside]


class CoverTree:
    """Nested levels over unit vectors. ``order`` sorts the points so that each
    node holds a range of them; level l has arrays ``centre`` (a point),
    ``lo``, ``hi`` (its range), ``radius`` (covering) and ``kid`` (its first
    child in level l + 1; the last entry ends the last node's children)."""

    def __init__(self, unit: np.ndarray, levels: int = LEVELS):
        n = len(unit)
        groups = [(0, np.arange(n))] if n else []
        tree: list[list[tuple[int, np.ndarray]]] = [groups]
        kids: list[list[int]] = []
        for level in range(1, levels):
            nxt, first = [], [0]
            for _, points in tree[-1]:
                nxt += [(int(part[0]), part) for part in _covered(unit, points, 2.0 ** (1 - level))]
                first.append(len(nxt))
            tree.append(nxt)
            kids.append(first)
        self.order = np.concatenate([p for _, p in tree[-1]]) if n else np.zeros(0, np.int64)
        place = np.empty(n, np.int64)
        place[self.order] = np.arange(n)
        self.levels = []
        for k, nodes in enumerate(tree):
            centre = np.array([c for c, _ in nodes], dtype=np.int64)
            size = np.array([len(p) for _, p in nodes], dtype=np.int64)
            hi = np.cumsum(size)
            owner = np.repeat(np.arange(len(nodes)), size)
            dots = np.einsum("ij,ij->i", unit[self.order], unit[centre[owner]]) if n else np.zeros(0)
            radius = np.zeros(len(nodes))
            np.maximum.at(radius, owner, np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dots)))
            self.levels.append({"centre": place[centre], "lo": hi - size, "hi": hi, "radius": radius,
                                "kid": np.array(kids[k] if k < len(kids) else [], dtype=np.int64)})


def thin(levels: list[dict]) -> list[dict]:
    """The root, the last level, and those between that have LESS times fewer
    nodes than the next one that is kept."""
    kept = levels[-1:]
    for level in levels[-2:0:-1]:
        if LESS * len(level["lo"]) <= len(kept[0]["lo"]):
            kept.insert(0, level)
    return _nested([*levels[:len(levels) > 1], *kept])


def _nested(levels: list[dict]) -> list[dict]:
    kids = [np.append(np.searchsorted(below["lo"], level["lo"]), len(below["lo"]))
            for level, below in zip(levels[:-1], levels[1:], strict=True)]
    return [{**level, "kid": kid} for level, kid in zip(levels, [*kids, np.zeros(0, np.int64)], strict=True)]


def _apart(x: np.ndarray, y: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of the unit vectors x[p] and y[q]."""
    room, d = max(1, GATHER // x.shape[1]), np.empty(len(p))
    for s in range(0, len(p), room):
        d[s:s + room] = np.einsum("ij,ij->i", x[p[s:s + room]], y[q[s:s + room]])
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * d))


def _children(i: np.ndarray, j: np.ndarray, ka: np.ndarray, kb: np.ndarray):
    """All pairs of children of node pairs (i, j)."""
    na, nb = ka[i + 1] - ka[i], kb[j + 1] - kb[j]
    size = na * nb
    of = np.repeat(np.arange(len(i)), size)
    k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return ka[i][of] + k // nb[of], kb[j][of] + k % nb[of]


def directions(unit: np.ndarray, cosine: float) -> np.ndarray | None:
    """So many main directions of a sample that few of its pairs seem to have
    that cosine; None if that takes nearly all."""
    _, axes = np.linalg.eigh(unit.T @ unit)
    some = unit[::max(1, len(unit) // 512)]
    reach = some @ some.T
    for k in NARROW:
        if 2 * k > unit.shape[1]:
            return None
        z = narrow(some, axes[:, ::-1][:, :k])
        if np.count_nonzero((z @ z.T >= cosine - ROUNDED) & (reach < cosine)) <= PASS * reach.size:
            return np.ascontiguousarray(axes[:, ::-1][:, :k])
    return None


def narrow(unit: np.ndarray, axes: np.ndarray | None) -> np.ndarray:
    """Vectors whose dot products are at least those of the unit vectors: what
    they have along the axes, and the length of the rest."""
    if axes is None:
        return unit.astype(np.float32)
    along = unit @ axes
    rest = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", along, along)))
    return np.concatenate([along, rest[:, None]], axis=1).astype(np.float32)


def _by_radius(level: dict, unit: np.ndarray, axes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The nodes by radius, and their centres' narrow vectors in that order."""
    order = np.argsort(level["radius"], kind="stable")
    return order, narrow(unit[level["centre"][order]], axes)


def _tiles(radius: np.ndarray, room: int) -> list[tuple[int, int]]:
    """Ranges of at most ``room`` of these nodes; those that are a point are apart from the others."""
    points = int(np.searchsorted(radius, ROUNDED, side="right"))
    return [(s, min(s + room, z)) for a, z in ((0, points), (points, len(radius))) for s in range(a, z, room)]


def _all_nodes(la: dict, x: np.ndarray, za: tuple, lb: dict, y: np.ndarray, zb: tuple, reach: float, own: bool):
    """Of all pairs of these nodes, those that may hold a pair within reach, and
    the distance of their centres. Nodes are taken by radius, so that those
    compared at once have much the same bound."""
    (oa, u), (ob, v) = za, zb
    ra, rb = la["radius"][oa], lb["radius"][ob]
    tiles = [(s, e, t, z) for s, e in _tiles(ra, ROWS) for t, z in _tiles(rb, max(TILE, ROWS * TILE // (8 * (e - s))))
             if not own or z > s]
    ends = np.cumsum([0, *((e - s) * (z - t) for s, e, t, z in tiles)])
    products, passed = np.empty(np.diff(ends).max(initial=0), np.float32), np.empty(ends[-1], bool)
    for at, (s, e, t, z) in zip(ends.tolist(), tiles, strict=False):
        bound = reach + ra[e - 1] + rb[z - 1]
        n = (e - s) * (z - t)
        np.matmul(u[s:e], v[t:z].T, out=products[:n].reshape(e - s, z - t))
        np.greater_equal(products[:n], np.float32(1.0 - bound * bound / 2.0 - ROUNDED), out=passed[at:at + n])
    hits = _set(passed)
    size, count = np.diff(ends), np.diff(np.searchsorted(hits, ends))
    found, full = [], (count > 0) & (16 * count >= size)
    for k in np.flatnonzero(full).tolist():
        s, e, t, z = tiles[k]
        p, q = oa[s:e], ob[t:z]
        d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x[la["centre"][p]] @ y[lb["centre"][q]].T)))
        i, j = np.nonzero(d <= reach + ra[s:e, None] + rb[t:z] + SLACK)
        if own:
            i, j = i[i + s <= j + t], j[i + s <= j + t]
        found.append((p[i], q[j], d[i, j]))
    of = np.repeat(np.arange(len(tiles)), count)
    hits, of = hits[~full[of]], of[~full[of]]
    if len(hits):
        first = np.array(tiles)[of]
        i, j = np.divmod(hits - ends[of], first[:, 3] - first[:, 2])
        i, j = i + first[:, 0], j + first[:, 2]
        if own:
            i, j = i[i <= j], j[i <= j]
        i, j = oa[i], ob[j]
        d = _apart(x, y, la["centre"][i], lb["centre"][j])
        ok = d <= reach + la["radius"][i] + lb["radius"][j] + SLACK
        found.append((i[ok], j[ok], d[ok]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    i, j, d = (np.concatenate(f) for f in zip(*found, strict=True))
    return (np.minimum(i, j), np.maximum(i, j), d) if own else (i, j, d)


def _set(flags: np.ndarray) -> np.ndarray:
    """Where the flags are set: few are, so eight are looked at together."""
    whole = len(flags) // 8 * 8
    words = np.flatnonzero(flags[:whole].view(np.uint64) != 0)
    word, bit = np.nonzero(flags[:whole].reshape(-1, 8)[words])
    return np.concatenate([words[word] * 8 + bit, np.flatnonzero(flags[whole:]) + whole])


def near_nodes(a: list[dict], x: np.ndarray, b: list[dict], y: np.ndarray, reach: float, own: bool,
               za: tuple | None = None, zb: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dual traversal: pairs of nodes of the last level that may hold a pair
    within ``reach``, and the distance of their centres. ``x`` and ``y`` are
    the unit points in the trees' order; with ``own`` the trees are the same
    and only pairs i <= j are returned. Where the first level below the roots
    drops little, all pairs of the last level are compared at once."""
    none = np.zeros(0, np.int64)
    if not len(x) or not len(y):
        return none, none, np.zeros(0)
    p, q = min(1, len(a) - 1), min(1, len(b) - 1)
    if len(a) > 2 or len(b) > 2:
        i, j, d = _all_nodes(a[p], x, _by_radius(a[p], x, None), b[q], y, _by_radius(b[q], y, None), reach, own)
        size = (a[p]["hi"] - a[p]["lo"])[i] * (b[q]["hi"] - b[q]["lo"])[j]
        if 64 * size.sum() <= len(x) * len(y):
            while p < len(a) - 1 or q < len(b) - 1:
                ka, kb = (t[l]["kid"] if l < len(t) - 1 else np.arange(len(t[l]["lo"]) + 1) for t, l in ((a, p), (b, q)))
                i, j = _children(i, j, ka, kb)
                p, q = min(p + 1, len(a) - 1), min(q + 1, len(b) - 1)
                if own:
                    i, j = i[i <= j], j[i <= j]
                d = _apart(x, y, a[p]["centre"][i], b[q]["centre"][j])
                ok = d <= reach + a[p]["radius"][i] + b[q]["radius"][j] + SLACK
                i, j, d = i[ok], j[ok], d[ok]
            return i, j, d
    return _all_nodes(a[-1], x, za or _by_radius(a[-1], x, None), b[-1], y, zb or _by_radius(b[-1], y, None), reach, own)


def walk(a: list[dict], x: np.ndarray, b: list[dict], y: np.ndarray, reach: float,
         own: bool) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of nodes of :func:`near_nodes`."""
    return near_nodes(a, x, b, y, reach, own)[:2]


def _decided(one: dict, two: dict, lo: np.ndarray, hi: np.ndarray, to: np.ndarray, end: np.ndarray, cosine: float,
             own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of points of one's ranges [lo, hi) and two's [to, end), decided one by one."""
    room = max(1, GATHER // one["x"].shape[1])

    def decide(p: np.ndarray, q: np.ndarray):
        cos = np.einsum("ij,ij->i", one["x"][p], two["x"][q]) / (one["norm"][p] * two["norm"][q])
        ok = cos >= cosine
        if own:
            ok &= p < q
        return p[ok], q[ok]

    size = (hi - lo) * (end - to)
    for big in np.flatnonzero(size > 4096):
        b, z = to[big], end[big]
        for s in range(lo[big], hi[big], 512):
            e = min(s + 512, hi[big])
            cos = (one["x"][s:e] @ two["x"][b:z].T) / (one["norm"][s:e, None] * two["norm"][None, b:z])
            p, q = np.nonzero(cos >= cosine - 1e-12)
            # same pair in another order of summing: rounding must not depend on it
            edge = np.abs(cos[p, q] - cosine) < 1e-12
            p, q = p + s, q + b
            if edge.any():
                ep, eq = decide(p[edge], q[edge])
                p, q = np.concatenate([p[~edge], ep]), np.concatenate([q[~edge], eq])
            if own:
                p, q = p[p < q], q[p < q]
            yield p, q
    few = np.flatnonzero(size <= 4096)
    if len(few):
        ends = np.cumsum(size[few])
        for part in np.split(few, np.searchsorted(ends, np.arange(room, ends[-1], room))):
            if len(part):
                n, nb = size[part], (end - to)[part]
                of = np.repeat(np.arange(len(part)), n)
                k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield decide(lo[part][of] + k // nb[of], to[part][of] + k % nb[of])


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The members of ranges, and the range of each."""
    of = np.repeat(np.arange(len(lo)), hi - lo)
    return np.arange(len(of)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[of], of


def block_links(one: dict, two: dict, cosine: float, own: bool, ca: np.ndarray,
                cb: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Adds to ``ca`` and ``cb`` the links that the points of the two blocks have
    with each other, copies counted; with ``own`` the blocks (and counts) are
    the same. Yields links (p, q) that join the same points as all of them.
    Two nodes without a pair out of reach have links between all their points."""
    reach = math.sqrt(max(0.0, 2.0 - 2.0 * cosine))
    i, j, d = near_nodes(one["levels"], one["unit"], two["levels"], two["unit"], reach, own, one["z"], two["z"])
    if not len(i):
        return
    la, lb = one["levels"][-1], two["levels"][-1]
    alone = own & (i == j) & (la["hi"] - la["lo"] == 1)[i]
    i, j, d = i[~alone], j[~alone], d[~alone]
    sure = np.where(own & (i == j), 0.0, d) + la["radius"][i] + lb["radius"][j] <= reach - SLACK
    doubt = ~sure
    for p, q in _decided(one, two, la["lo"][i[doubt]], la["hi"][i[doubt]], lb["lo"][j[doubt]], lb["hi"][j[doubt]],
                         cosine, own):
        np.add.at(ca, p, two["n"][q])
        np.add.at(cb, q, one["n"][p])
        yield p, q
    i, j = i[sure], j[sure]
    if not len(i):
        return
    na, nb = np.add.reduceat(one["n"], la["lo"]), np.add.reduceat(two["n"], lb["lo"])
    to_a, to_b = np.zeros(len(na), np.int64), np.zeros(len(nb), np.int64)
    np.add.at(to_a, i, nb[j])
    same = i[i == j] if own else i[:0]
    np.add.at(to_b, j[i != j] if own else j, na[i[i != j] if own else i])
    ca += np.repeat(to_a, la["hi"] - la["lo"])
    cb += np.repeat(to_b, lb["hi"] - lb["lo"])
    p, _ = _spread(la["lo"][same], la["hi"][same])
    ca[p] -= one["n"][p]
    for s in range(0, len(i), 1 << 16):
        a, b = i[s:s + (1 << 16)], j[s:s + (1 << 16)]
        p, of = _spread(la["lo"][a], la["hi"][a])
        q = lb["lo"][b][of]
        yield p[p != q] if own else p, q[p != q] if own else q
        q, of = _spread(lb["lo"][b] + 1, lb["hi"][b])
        yield la["lo"][a][of], q


class Labels:
    """Joins of numbered points: each has the least number of those it is joined with."""

    def __init__(self, n: int):
        self.of = np.arange(n)
        self.held: list = []

    def add(self, p: np.ndarray, q: np.ndarray) -> None:
        self.held.append((p, q))
        if sum(len(p) for p, _ in self.held) > 1 << 17:
            self.join()

    def join(self) -> np.ndarray:
        if self.held:
            p, q = (np.concatenate(x) for x in zip(*self.held, strict=True))
            self.held = []
            while True:
                a, b = self.of[p], self.of[q]
                apart = a != b
                if not apart.any():
                    break
                p, q, a, b = p[apart], q[apart], a[apart], b[apart]
                np.minimum.at(self.of, np.maximum(a, b), np.minimum(a, b))
                while not np.array_equal(up := self.of[self.of], self.of):
                    self.of = up
        return self.of


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and lengths; a vector whose length is too small or large for a double has none."""
    with np.errstate(all="ignore"):
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        unit = x / norm[:, None]
    unit[~np.isfinite(unit).all(axis=1)] = 0.0
    return unit, norm


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def block_of(k: np.ndarray, n: np.ndarray, x: np.ndarray) -> dict:
    """A block's points, copies and tree, in the tree's order."""
    unit, norm = _units(x)
    tree = CoverTree(unit)
    o = tree.order
    return {"k": k[o], "n": n[o], "x": x[o], "unit": unit[o], "norm": norm[o], "levels": thin(tree.levels)}


def centre_of(unit: np.ndarray) -> tuple[np.ndarray, float]:
    """A unit vector amid these, and its covering radius."""
    mean = unit.sum(axis=0)
    length = math.sqrt(mean @ mean)
    centre = mean / length if length > 1e-6 * len(unit) else unit[0]
    return centre, math.sqrt(max(0.0, 2.0 - 2.0 * float((unit @ centre).min())))


def cut(unit: np.ndarray, block: int) -> list[np.ndarray]:
    """The rows in parts of at most ``block``, near ones together."""
    done, due = [], [np.arange(len(unit))]
    while due:
        rows = due.pop()
        if len(rows) <= block:
            if done and len(done[-1]) + len(rows) <= block:
                done[-1] = np.concatenate([done[-1], rows])
            else:
                done.append(rows)
            continue
        centres = spread_centres(unit[rows[::-(-len(rows) // SAMPLE)]], 2 * -(-len(rows) // block))
        nearest = (unit[rows] @ centres.T).argmax(1)
        parts = [rows[nearest == c] for c in range(len(centres))]
        if max(map(len, parts)) == len(rows):
            parts = [rows[s:s + block] for s in range(0, len(rows), block)]
        due += [p for p in parts[::-1] if len(p)]
    return done


def spread_centres(unit: np.ndarray, most: int) -> np.ndarray:
    """At most so many centres: those of the first level of a tree that has as many, evenly taken."""
    tree = CoverTree(unit, levels=12)
    level = next((x for x in tree.levels if len(x["lo"]) >= most), tree.levels[-1])
    n = len(level["lo"])
    return unit[tree.order][level["centre"][np.unique(np.linspace(0, n - 1, min(most, n)).astype(np.int64))]]


def _packed(block: dict, kind: str) -> dict[str, bytes | float]:
    levels = [{"centre": x["centre"].astype(np.int32), "hi": x["hi"].astype(np.int32),
               "radius": np.nextafter(x["radius"].astype(np.float32), np.float32(np.inf))} for x in block["levels"]]
    centre, radius = centre_of(block["unit"])
    return {"centre": centre.tobytes(), "radius": radius, "rows": len(block["k"]), "k": block["k"].tobytes(),
            "n": block["n"].tobytes(), "x": block["x"].astype(kind).tobytes(), "tree": pickle.dumps(levels)}


KEPT = pa.schema([("centre", pa.binary()), ("radius", pa.float64()), ("rows", pa.int64()), ("k", pa.binary()),
                  ("n", pa.binary()), ("x", pa.large_binary()), ("tree", pa.binary())])


def write_shelf(uri: str, k: np.ndarray, n: np.ndarray, x: np.ndarray, block: int, kind: str) -> tuple[bytes, float]:
    """A file with these points, cut into blocks; returns their centre and radius."""
    unit, _ = _units(x)
    with files.open_out(uri) as sink, pa.ipc.new_file(sink, KEPT) as out:
        for rows in cut(unit, block):
            made = _packed(block_of(k[rows], n[rows], x[rows]), kind)
            out.write_batch(pa.RecordBatch.from_pylist([made], KEPT))
    centre, radius = centre_of(unit)
    return centre.tobytes(), radius


class Shelf:
    """A file of blocks, which are read when they are asked for."""

    def __init__(self, uri: str, dim: int, kind: str, axes: np.ndarray | None):
        self.file, self.dim, self.kind, self.axes = pa.ipc.open_file(files.open_random(uri)), dim, kind, axes
        heads = [self.file.get_batch(i) for i in range(self.file.num_record_batches)]
        self.centre = np.stack([np.frombuffer(h.column("centre")[0].as_buffer()) for h in heads])
        self.radius = np.array([h.column("radius")[0].as_py() for h in heads])
        self.first = np.cumsum([0, *(h.column("rows")[0].as_py() for h in heads)])
        self.k = np.concatenate([np.frombuffer(h.column("k")[0].as_buffer(), np.int64) for h in heads])
        self.blocks: dict[int, dict] = {}

    def block(self, i: int) -> dict:
        if i not in self.blocks:
            row = self.file.get_batch(i)
            of = lambda name, kind: np.frombuffer(row.column(name)[0].as_buffer(), kind)
            x = of("x", self.kind).reshape(-1, self.dim).astype(np.float64)
            unit, norm = _units(x)
            levels = []
            for kept in pickle.loads(row.column("tree")[0].as_buffer()):
                hi = kept["hi"].astype(np.int64)
                levels.append({"centre": kept["centre"].astype(np.int64), "lo": np.append(0, hi[:-1]), "hi": hi,
                               "radius": kept["radius"].astype(np.float64)})
            self.blocks[i] = {"n": of("n", np.int64), "x": x, "unit": unit, "norm": norm, "levels": _nested(levels),
                              "z": _by_radius(levels[-1], unit, self.axes)}
        return self.blocks[i]


def shelf_links(one: Shelf, two: Shelf, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys and links of the points of two shelves (or of one with itself), and
    a forest (src, dst) that joins the same points as all links."""
    own, reach = one is two, math.sqrt(max(0.0, 2.0 - 2.0 * cosine))
    ca = np.zeros(len(one.k), np.int64)
    cb, base = (ca, 0) if own else (np.zeros(len(two.k), np.int64), len(one.k))
    far = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (one.centre @ two.centre.T))) > (
        reach + one.radius[:, None] + two.radius[None] + SLACK)
    labels = Labels(base + len(two.k))
    for i, j in zip(*np.nonzero(~far), strict=True):
        if own and i > j:
            continue
        a, b = one.first[i], two.first[j]
        for p, q in block_links(one.block(i), two.block(j), cosine, own and i == j,
                                ca[a:one.first[i + 1]], cb[b:two.first[j + 1]]):
            labels.add(p + a, q + (b + base))
    up = labels.join()
    k = one.k if own else np.concatenate([one.k, two.k])
    count = ca if own else np.concatenate([ca, cb])
    child = np.flatnonzero(up != np.arange(len(up)))
    return k[count > 0], count[count > 0], k[child], k[up[child]]


def usable(column: str) -> Column:
    """Not null, not empty, no null or non-finite component, not zero."""
    bad = F.exists(column, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(column) > 0) & ~bad & F.exists(column, lambda v: v != 0), F.lit(False))


class Plan:
    """Where points go, from a sample of them: the nearest of a dimension's
    ``centres`` has ``first`` and ``cuts``, the pieces it is cut into by key.
    Neighbouring centres share a piece. ``axes`` are the directions for
    :func:`narrow`. A dimension that the sample has not met is a piece."""

    def __init__(self, rows: list, total: int, cosine: float, block: int, sample: int):
        by_dim: dict[int, list] = {}
        for r in rows:
            by_dim.setdefault(len(r.embedding), []).append(r.embedding)
        self.dims, self.axes, self.pieces = {}, {}, 0
        for dim, vectors in sorted(by_dim.items()):
            unit, _ = _units(np.array(vectors, dtype=np.float64))
            share = total / len(rows)
            centres = spread_centres(unit, max(1, min(sample, math.ceil(share * len(unit) / block))))
            held = np.bincount((unit @ centres.T).argmax(1), minlength=len(centres)) * share
            room = self.room(dim, total, block)
            first, cuts, filled = [], [], room
            for size in held.tolist():
                if size > room or filled + size > room:
                    self.pieces, filled = self.pieces + max(1, math.ceil(size / room)), 0.0
                first.append(self.pieces - max(1, math.ceil(size / room)))
                cuts.append(max(1, math.ceil(size / room)))
                filled = room if size > room else filled + size
            self.dims[dim] = centres.astype(np.float32), np.array(first, np.int32), np.array(cuts, np.int64)
            self.axes[dim] = directions(unit, cosine)

    @staticmethod
    def room(dim: int, total: int, block: int) -> int:
        """Points of a shelf."""
        return max(block, min(SHELF * block, SHELF_BYTES // (4 * dim), math.ceil(total / SHELVES)))


def _hang(points: DataFrame, plan: Plan) -> DataFrame:
    """Adds ``dim piece``."""
    dims_of = plan.dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(0).to_numpy()
            dims = pc.list_value_length(b.column(1)).to_numpy()
            piece = -dims
            for dim in np.unique(dims).tolist():
                if dim in dims_of:
                    rows = np.flatnonzero(dims == dim)
                    centres, first, cuts = dims_of[dim]
                    unit, _ = _units(_matrix(b.column(1).take(pa.array(rows))))
                    leaf = (unit.astype(np.float32) @ centres.T).argmax(1)
                    piece[rows] = first[leaf] + key[rows] % cuts[leaf]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(dims, pa.int32()), pa.array(piece, pa.int32())],
                                             names=["k", "embedding", "n", "dim", "piece"])

    kind = points.schema["embedding"].dataType.simpleString()
    return points.select("k", "embedding", "n").mapInArrow(
        run, f"k long, embedding {kind}, n long, dim int, piece int")


def shelves(points: DataFrame, plan: Plan, total: int, folder: str, block: int, workspace: Workspace) -> DataFrame:
    """Writes all points to shelves; returns their written table ``uri dim points centre radius``."""
    kind = _kind(points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, of = [], 0, None

        def flush() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            k, n = whole.column("k").to_numpy(), whole.column("n").to_numpy()
            uri, dim = files.new_name(folder, ".shelf"), of[1]
            centre, radius = write_shelf(uri, k, n, _matrix(whole.column("embedding").combine_chunks()), block, kind)
            return pa.RecordBatch.from_arrays(
                [pa.array([uri]), pa.array([dim], pa.int32()), pa.array([len(k)], pa.int64()), pa.array([centre]),
                 pa.array([radius])], names=["uri", "dim", "points", "centre", "radius"])

        for b in batches:
            piece, dims = b.column("piece").to_numpy(), b.column("dim").to_numpy()
            new = np.flatnonzero((piece[1:] != piece[:-1]) | (dims[1:] != dims[:-1])) + 1
            for a, z in zip([0, *new.tolist()], [*new.tolist(), b.num_rows], strict=True):
                at = (int(piece[a]), int(dims[a])) if z > a else of
                if held and (at != of or 2 * (rows + z - a) > 3 * Plan.room(of[1], total, block)):
                    yield flush()
                    held, rows = [], 0
                held.append(b.slice(a, z - a).select(["k", "n", "embedding"]))
                rows, of = rows + z - a, at
        if rows:
            yield flush()

    dealt = _hang(points, plan).repartition(max(1, min(plan.pieces, 20_000)), "piece")
    dealt = dealt.sortWithinPartitions("piece", "dim", "k")
    return workspace.save(dealt.mapInArrow(
        run, "uri string, dim int, points long, centre binary, radius double"), "shelves")


def _kind(points: DataFrame) -> str:
    """How the vectors are stored: without loss, singles as singles."""
    return "<f4" if points.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"


def shelf_pairs(shared, n: int, reach: float, spark: SparkSession) -> DataFrame:
    """``a b``: the places of shelves of one dimension that may hold a pair; ``a <= b``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims = np.array([s[1] for s in shared.value])
        radius = np.array([s[3] for s in shared.value])
        centres = {dim: np.stack([np.frombuffer(s[2]) for s in shared.value if s[1] == dim])
                   for dim in np.unique(dims).tolist()}
        place = {dim: np.flatnonzero(dims == dim) for dim in centres}
        for batch in batches:
            for a in batch.column(0).to_pylist():
                dim = int(dims[a])
                c, at = centres[dim], place[dim]
                d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (c @ c[np.searchsorted(at, a)])))
                b = at[(at >= a) & ~(d > reach + radius[a] + radius[at] + SLACK)]
                yield pa.RecordBatch.from_arrays([pa.array([a] * len(b), pa.int64()), pa.array(b, pa.int64())],
                                                 names=["a", "b"])

    return spark.range(0, n, 1, max(1, min(n // 64, 1000))).mapInArrow(run, "a long, b long")


def links(points: DataFrame, some: list, total: int, workspace: Workspace, cosine: float = COSINE,
          block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """From the ``total`` distinct vectors ``k embedding n``, of which ``some``
    are a sample: the written rows ``k links`` (linked other vectors, copies counted, one row
    per pair of shelves) and ``k dst`` (a forest with the components of all links)."""
    plan, spark, kind = Plan(some, total, cosine, block, sample), points.sparkSession, _kind(points)
    folder = workspace.folder("blocks")
    made = shelves(points, plan, total, folder, block, workspace)
    shared = spark.sparkContext.broadcast([(r.uri, r.dim, bytes(r.centre), r.radius)
                                           for r in made.select("uri", "dim", "centre", "radius").sort("dim", "uri").collect()])
    axes, n = plan.axes, len(shared.value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_now: dict[int, Shelf] = {}

        def shelf(at: int, other: int) -> Shelf:
            for old in [x for x in open_now if x not in (at, other)]:
                del open_now[old]
            if at not in open_now:
                uri, dim = shared.value[at][:2]
                open_now[at] = Shelf(uri, dim, kind, axes.get(dim))
            return open_now[at]

        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                k, count, src, dst = shelf_links(shelf(a, b), shelf(b, a), cosine)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([k, src])),
                    pa.concat_arrays([pa.array(count), pa.nulls(len(src), pa.int64())]),
                    pa.concat_arrays([pa.nulls(len(k), pa.int64()), pa.array(dst)])], names=["k", "links", "dst"])

    tasks = max(1, min(n * (n + 1) // 2, math.ceil(total * total / 2 / PAIRS), 20_000))
    pairs = shelf_pairs(shared, n, math.sqrt(max(0.0, 2.0 - 2.0 * cosine)), spark)
    pairs = pairs.repartition(tasks, "a", "b").sortWithinPartitions("a", "b")
    found = workspace.save(pairs.mapInArrow(run, "k long, links long, dst long"), "links")
    workspace.delete(folder)
    return found


def similar_vectors(vectors: DataFrame, workspace: Workspace, cosine: float = COSINE, block: int = BLOCK,
                    sample: int = SAMPLE) -> DataFrame:
    """``vec_id n_links component_id kept`` for every row.

    Vectors that are null, empty or zero, or hold null or non-finite
    components, link with nothing; vectors of different lengths do not link.
    Null ids are compared like others but never name a component; repeated
    rows are vectors of their own; an empty table gives no rows. Classes of
    equal vectors are told apart by a 64-bit hash.
    """
    arrow_limits(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding").withColumn("ok", usable("embedding"))
    rows = rows.withColumn("k", F.when(F.col("ok"), F.xxhash64("embedding")))
    members = workspace.save(rows.where("ok").select("vec_id", "k"), "members")
    keys = members.select("k").distinct()
    some = rows.where("ok").join(F.broadcast(keys.orderBy("k").limit(sample)), "k", "left_semi")
    some = some.groupBy("k").agg(F.first("embedding").alias("embedding")).sort("k").collect()
    points = rows.where("ok").groupBy("k").agg(F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("n"))
    found = links(points, some, keys.count(), workspace, cosine, block, sample)
    labels = class_labels(members, "k", "vec_id",
                          workspace.save(found.where("dst is not null").select(
                              F.col("k").alias("src"), "dst"), "edges"), workspace)
    counts = found.where("links is not null").groupBy("k").agg(F.sum("links").alias("links"))
    labels = workspace.save(labels.join(counts, "k", "left").select(
        "k", "component_id", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "classes")
    linked = attach(members, labels, ["k"], "n", ["vec_id"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                            F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings. Unusable vectors, null ids, repeated rows and empty tables
    as in :func:`similar_vectors`."""
    return similar_vectors(table(spark, sf_dir, "embeddings"), Workspace(spark, label="op3"))


OP3_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
l AS (SELECT a.vec_id AS s, b.vec_id AS t FROM e a JOIN e b ON a.vec_id <> b.vec_id
      AND list_cosine_similarity(a.v, b.v) >= 0.95),
c(node, label) USING KEY (node) AS (
    SELECT vec_id, vec_id FROM e
    UNION
    SELECT l.t, min(c.label) FROM c JOIN l ON l.s = c.node JOIN recurring.c AS o ON o.node = l.t
    WHERE c.label < o.label GROUP BY l.t)
SELECT node AS vec_id, (SELECT count(*) FROM l WHERE l.s = node) AS n_links,
       label AS component_id, node = label AS kept FROM c
"""

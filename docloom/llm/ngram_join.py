"""Jaccard self-join of shingle sets through count-vector R-trees.

A document's set holds its distinct word shingles (64-bit hashes). Equal sets are one class. Shingles
are hashed into groups, about one for every two of a set's shingles; the counts of the groups are the set's point, and the overlap of two
sets is at most the sum of the coordinate-wise minima of their points - of two R-tree nodes, of the
minima of their upper corners.

One tree over all points would not fit a machine, so points are dealt into tiles, each with a tree of
its own. Two linked sets differ in at most D shingles, D fixed by their size class; of more than D
hash groups one at least must then hold the same shingles in both. A set is therefore entered in one
tile for each group of its size class (and of the class below, if a partner may lie there), keyed by
the group's content. No link is lost; a tile holds sets that agree on about six to nine shingles.

1. Each tile offers every member its most central member (whose tiles are fullest); of these a set takes the commonest,
   which is verified if their points allow a link. Sets linked to one centre, or to one over two steps, get one label: groups of
   near copies, however large, are told apart no more, in linear work.
2. Tiles whose members still have different labels are searched by an R-tree for pairs of
   different labels; tiles over TILE_ROWS rows are cut into pairs of blocks.
   A tile is given coarser points, whose coordinates count about a dozen shingles each, and the first EARLY tiles of each set:
   a pair that shares some of these is told by one of them only, not by every tile that it shares.
3. Pairs that pass are bounded by their full points; survivors are verified against the whole sets; components come from all links.

Defined results: no words or no text: n_shingles 0, linked with nothing, its own component; fewer
words than a shingle: the whole sequence is the one shingle; repeated rows and equal texts are one
class, whatever their ids; a null id takes part in its class and bridges like any other, but never names a component (a component of
null ids only has a null component_id, and a group of its own); very long texts are taken whole, one at a time; further columns of the
input, whatever their names, play no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, let_go, map_texts, runs, stored, utf8
from .components import labels

#: Coordinates of a point, as powers of two, from short texts to long ones; those of a point in a tree; counts of a tile that are held at once.
LEAST_BITS, MOST_BITS = 5, 16
GROUPS = 128
#: Groups of a long text's point that are one in the points that tiles are given.
COARSER = 8
MOST_CELLS = 1 << 24
#: Tiles of a set, the first of its size class, that decide where a pair is told.
EARLY = 8
#: Rows of a tile that one task searches at once; larger tiles are cut into pairs of blocks.
TILE_ROWS = 2048
#: Points of an R-tree leaf, and children of a node; pairs that are compared at once.
FANOUT, PAIRS = 32, 1 << 12
#: Ids that may be broadcast to select texts (about 32 MB); more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Shared tiles that may be broadcast to select their members (about 100 MB); more are joined by a shuffle.
BROADCAST_TILES = 2_000_000
SLICE = 1 << 20
U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
MULTIPLIERS = tuple(U64(m) for m in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> U64(32))) * MULTIPLIERS[0]
    x = (x ^ (x >> U64(29))) * MULTIPLIERS[3]
    return x ^ (x >> U64(32))


class _Powers:
    """BASE ** i and its inverse modulo 2 ** 64, as far as asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = pow(BASE, -1, 1 << 64)
            self.up = np.cumprod(np.append(U64(1), np.full(n - 1, BASE, U64)))
            self.down = np.cumprod(np.append(U64(1), np.full(n - 1, inverse, U64)))
        return self.up, self.down


POWERS = _Powers()


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each row and their number at the end), A-Z lower-cased; white space is 0x20 and 0x09-0x0D."""
    if len(data) == 0:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    row_starts = offsets[:-1][np.diff(offsets) > 0]
    begins[row_starts] = solid[row_starts]
    stops = solid.copy()
    stops[:-1] &= ~solid[1:]
    row_ends = offsets[1:][np.diff(offsets) > 0] - 1
    stops[row_ends] = solid[row_ends]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    up, down = POWERS.upto(len(data) + 1)
    total = np.concatenate((np.zeros(1, U64), np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)])))
    hashes = (total[end] - total[start]) * down[start]
    return mix(hashes + (end - start).astype(U64) * MULTIPLIERS[4]), np.searchsorted(start, offsets)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, first = word_hashes(*utf8(texts))
    joined = np.zeros(max(0, len(words) - size + 1), U64)
    for k in range(size):
        joined += words[k : k + len(joined)] * MULTIPLIERS[k % 5] ^ U64(k)
    joined = mix(joined)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(joined[a : b - size + 1]))
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(words[a:b].tobytes(), seed=b - a)], U64))
        else:
            out.append(np.zeros(0, U64))
    return out


def resolution(n: int) -> int:
    """Groups of a set of n shingles: about one for every two, a power of two."""
    return 1 << min(MOST_BITS, max(LEAST_BITS, (n // 2).bit_length()))


def point(shingles: np.ndarray) -> np.ndarray:
    """Counts of the shingles by group. Groups are leading bits of the hash, so finer groups fold into coarser ones."""
    groups = resolution(len(shingles))
    return np.bincount((shingles >> U64(64 - groups.bit_length() + 1)).astype(np.int64), minlength=groups)


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """A point, or rows of points, in fewer groups."""
    return counts if counts.shape[-1] == groups else counts.reshape(*counts.shape[:-1], groups, -1).sum(axis=-1)


def pack_point(counts: np.ndarray) -> bytes:
    """The counts in 1, 2 or 4 bytes each, after a byte that tells which."""
    width = next(w for w in (1, 2, 4) if counts.max(initial=0) < 1 << 8 * w)
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def unpack_point(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<u{packed[0]}", offset=1).astype(np.int32)


def unpack_points(rows: list[bytes]) -> np.ndarray:
    """Points in their coarsest common groups; in fewer still where all of them would take too much memory (the bound stays a bound)."""
    counts = [unpack_point(r) for r in rows]
    groups = min([*map(len, counts), 1 << max(LEAST_BITS, (MOST_CELLS // len(rows)).bit_length() - 1)])
    return np.array([folded(c, groups) for c in counts])


def unpack_matrices(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Packed points by their number of groups: (rows, their points)."""
    data, offsets = utf8(column)
    lengths, out = np.diff(offsets), {}
    widths = data[offsets[:-1]] if len(lengths) else np.zeros(0, np.uint8)
    for length, width in set(zip(lengths.tolist(), widths.tolist(), strict=True)):
        rows = np.flatnonzero((lengths == length) & (widths == width))
        counts = np.ascontiguousarray(data[offsets[rows][:, None] + np.arange(1, length)]).view(f"<u{width}").astype(np.int32)
        out.setdefault(counts.shape[1], []).append((rows, counts))
    return {g: tuple(np.concatenate(x) for x in zip(*parts, strict=True)) for g, parts in out.items()}


class Threshold:
    """similarity = num/den as exact integers, and the size classes that follow from it."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.ladder = [max(1, -(-num // (den - num)) - 1)]  # so few shingles that only equal sets can link

    def linked(self, overlap: int, a: int, b: int) -> bool:
        return self.den * overlap >= self.num * (a + b - overlap)

    def least_overlap(self, total: np.ndarray) -> np.ndarray:
        """Of sets whose sizes sum to ``total``: linked means an overlap of num / (num + den) of the sum at least."""
        return -(-total * self.num // (self.num + self.den))

    def classes(self, n: int) -> list[tuple[int, int, int]]:
        """(class, D, hash groups) of the classes that a set of n shingles is entered in; none if only equal sets can link with it.

        Two sets meet in the class of the smaller one, which tells D: they differ in (den - num) / num of
        it at most. So a set is entered in its own class, and in the one below if a partner may lie there."""
        while self.ladder[-1] < n:
            top = self.ladder[-1]
            self.ladder.append(max(top + 1, top + top // 2, -(-top * self.den // self.num)))
        k = int(np.searchsorted(self.ladder, n))
        out = []
        for c in (k, k - 1):
            if c > 0 and (c == k or -(-n * self.num // self.den) <= self.ladder[c]):
                most = self.ladder[c] * (self.den - self.num) // self.num
                out.append((c, most, most + 3 + most // 50))
        return out


def tile_keys(shingles: np.ndarray, at: Threshold) -> list[np.ndarray]:
    """The tiles of one set, for each class that it is entered in.

    A class has a few groups more than D + 1, so that a set with few empty groups is sure to share a
    group that is not empty; only a set with more of them is entered in tiles of empty groups too."""
    keys = []
    for c, most, groups in at.classes(len(shingles)):
        hashed = mix(shingles ^ U64(c * 0x2545F4914F6CDD1D & (1 << 64) - 1))
        group = ((hashed >> U64(32)) * U64(groups) >> U64(32)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        group = group[order]
        starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        total = np.zeros(groups, U64)
        total[group[starts]] = np.add.reduceat(mix(hashed * MULTIPLIERS[2])[order], starts)
        place = mix(np.arange(groups, dtype=U64) + U64(c << 32))
        named = mix(total + place) & ~U64(1) | U64(c & 1)  # the last bit tells a class from the one below
        keys.append(named if len(starts) <= most else named[group[starts]])
    return keys


def entries(docs: DataFrame, id_col: str, text_col: str, size: int, at: Threshold, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, what is kept, n_shingles, class_id (hash of the set; null if empty), point, the same in fewer groups (coarse), tiles of its class and of the class below."""

    def work(texts: pa.Array) -> list[pa.Array]:
        sets = shingle_sets(texts, size)
        ids = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None for s in sets]
        keys = [[*tile_keys(s, at), *[np.zeros(0, U64)] * 2][:2] for s in sets]
        tiles = []
        for own in zip(*keys, strict=True):
            ends = np.concatenate(([0], np.cumsum([len(k) for k in own]))).astype(np.int32)
            tiles.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(own).view(np.int64))))
        points = [point(x) for x in sets]
        coarse = [pack_point(folded(x, max(min(GROUPS, len(x)), len(x) // COARSER))) for x in points]
        return [pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.int64()), pa.array([pack_point(x) for x in points], pa.binary()), pa.array(coarse, pa.binary()), *tiles]

    longs = T.ArrayType(T.LongType())
    kinds = {"n_shingles": T.LongType(), "class_id": T.LongType(), "point": T.BinaryType(), "coarse": T.BinaryType(), "tiles": longs, "below": longs}
    return map_texts(docs, text_col, [id_col, *keep], [T.StructField(k, t) for k, t in kinds.items()], work, limit=SLICE)


class CountTree:
    """An R-tree, packed from the bottom, over points that share a tile."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.order = self._packed(values, np.arange(len(values)))
        self.values, self.sizes = values[self.order].astype(np.int32), sizes[self.order]
        self.levels = [(self.values, self.sizes)]
        while len(self.levels[-1][0]) > FANOUT:
            upper, least = self.levels[-1]
            starts = np.arange(0, len(upper), FANOUT)
            self.levels.append((np.maximum.reduceat(upper, starts), np.minimum.reduceat(least, starts)))

    def _packed(self, values: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Rows so ordered that neighbours share a leaf: halved along the coordinate that spreads most."""
        if len(rows) <= FANOUT:
            return rows
        along = values[rows][:, int(np.argmax(np.ptp(values[rows], axis=0)))]
        rows = rows[np.argsort(along, kind="stable")]
        half = -(-len(rows) // (2 * FANOUT)) * FANOUT
        return np.concatenate((self._packed(values, rows[:half]), self._packed(values, rows[half:])))

    def join(self, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray], at: Threshold) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows that ``wanted`` lets through and whose overlap may reach the threshold: pairs of nodes whose bound falls short are left with all below them."""
        top = len(self.levels) - 1
        x, y = np.triu_indices(len(self.levels[top][0]))
        for depth in range(top, 0, -1):
            near = self._near(depth, x, y, at)
            below = len(self.levels[depth - 1][0])
            if depth == 1:
                step = max(1, PAIRS // FANOUT**2)
                for k in range(0, len(near), step):
                    part = near[k : k + step]
                    yield from self._rows(*self._children(x[part], y[part], below), wanted, at)
                return
            x, y = self._children(x[near], y[near], below)
        yield from self._rows(x, y, wanted, at)

    def _near(self, depth: int, x: np.ndarray, y: np.ndarray, at: Threshold) -> np.ndarray:
        upper, least = self.levels[depth]
        bound = np.concatenate([np.zeros(0, np.int64), *(np.minimum(upper[x[k : k + PAIRS]], upper[y[k : k + PAIRS]]).sum(axis=1) for k in range(0, len(x), PAIRS))])
        return np.flatnonzero(bound >= at.least_overlap(least[x] + least[y]))

    def _children(self, x: np.ndarray, y: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        i, j = (k.ravel() for k in np.meshgrid(np.arange(FANOUT), np.arange(FANOUT), indexing="ij"))
        x, y = (x[:, None] * FANOUT + i).ravel(), (y[:, None] * FANOUT + j).ravel()
        there = (x <= y) & (y < count)  # the later node may hold fewer
        return x[there], y[there]

    def _rows(self, x: np.ndarray, y: np.ndarray, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray], at: Threshold) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        keep = x < y
        x, y = x[keep], y[keep]
        keep = wanted(self.order[x], self.order[y])
        x, y = x[keep], y[keep]
        keep = self._near(0, x, y, at)
        if len(keep):
            yield self.order[x[keep]], self.order[y[keep]]


def told_here(tile: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Whether a pair is told by this tile: by the first early tile that stands at one place in both; if there is none, by each that they share.

    Both are in that tile too, with the same labels, so it leaves out no pair that another would tell."""
    same = (first == second) & (first != 0)
    return ~same.any(axis=1) | (first[np.arange(len(tile)), same.argmax(axis=1)] == tile)


def tile_pairs(tile: int, ids: np.ndarray, labels: np.ndarray, sizes: np.ndarray, values: np.ndarray, early: np.ndarray, side: np.ndarray, at: Threshold) -> np.ndarray:
    """Pairs (of ids, the lesser first) of a tile with different labels that pass the bound, found by its R-tree joined with itself; of a cut tile, pairs across the two blocks."""
    cut = bool(side.any())

    def wanted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = labels[x] != labels[y]
        if cut:
            out &= side[x] != side[y]
        out[out] = told_here(np.full(int(out.sum()), tile), early[x[out]], early[y[out]])
        return out

    found = [np.zeros((0, 2), np.int64)]
    for x, y in CountTree(folded(values, min(GROUPS, values.shape[1])), sizes).join(wanted, at):
        if values.shape[1] > GROUPS:
            near = np.minimum(values[x], values[y]).sum(axis=1) >= at.least_overlap(sizes[x] + sizes[y])
            x, y = x[near], y[near]
        found.append(np.sort(np.stack((ids[x], ids[y]), axis=1), axis=1))
    return np.concatenate(found)


def leaf_pairs(starts: np.ndarray, rows: int, tiles: np.ndarray, ids: np.ndarray, labels: np.ndarray, sizes: np.ndarray, early: np.ndarray, apart: np.ndarray, side: np.ndarray, matrices: dict, at: Threshold) -> np.ndarray:
    """As ``tile_pairs``, for all tiles of one number of rows that is no more than a leaf holds."""
    first, second = np.triu_indices(rows, 1)
    x, y = (starts[:, None] + first).ravel(), (starts[:, None] + second).ravel()
    wanted = (labels[x] != labels[y]) & (~apart[x] | (side[x] != side[y]))
    x, y = x[wanted], y[wanted]
    wanted = told_here(tiles[x], early[x], early[y])
    x, y = x[wanted], y[wanted]
    x, y = np.where(ids[x] < ids[y], x, y), np.where(ids[x] < ids[y], y, x)
    groups = np.zeros(len(ids), np.int64)
    place = np.zeros(len(ids), np.int64)
    for g, (of, _) in matrices.items():
        groups[of], place[of] = g, np.arange(len(of))
    most = np.zeros(len(x), np.int64)
    for g, h in {*zip(groups[x].tolist(), groups[y].tolist(), strict=True)}:
        hit, low = np.flatnonzero((groups[x] == g) & (groups[y] == h)), min(g, h)
        a, b = folded(matrices[g][1], low), folded(matrices[h][1], low)
        for k in range(0, len(hit), PAIRS):
            part = hit[k : k + PAIRS]
            most[part] = np.minimum(a[place[x[part]]], b[place[y[part]]]).sum(axis=1)
    passed = most >= at.least_overlap(sizes[x] + sizes[y])
    return np.stack((ids[x[passed]], ids[y[passed]]), axis=1)


def _early(column: pa.Array) -> np.ndarray:
    """(rows, EARLY) tiles of an array column, with zeros where a set has fewer."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), EARLY), np.int64)
    out[np.arange(EARLY) < lengths[:, None]] = column.flatten().to_numpy()
    return out


def _search_tiles(at: Threshold):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in runs(batches, ("tile", "i", "j")):
            tiles, ids, labels, sizes, side, i, j = (table.column(c).to_numpy() for c in ("tile", "class_id", "label", "n_shingles", "side", "i", "j"))
            early, bounds = _early(table.column("early")), np.array(bounds)
            starts, lengths, found = bounds[:-1], np.diff(bounds), []
            leaf = lengths <= FANOUT
            matrices = unpack_matrices(table.column("coarse"))
            for rows in np.unique(lengths[leaf & (lengths > 1)]).tolist():
                found.append(leaf_pairs(starts[lengths == rows], rows, tiles, ids, labels, sizes, early, i != j, side, matrices, at))
            for a, n in zip(starts[~leaf].tolist(), lengths[~leaf].tolist(), strict=True):
                own = slice(a, a + n)
                found.append(tile_pairs(int(tiles[a]), ids[own], labels[own], sizes[own], unpack_points(table.column("coarse").slice(a, n).to_pylist()), early[own], side[own], at))
            if sum(map(len, found)):
                a, b = np.unique(np.concatenate(found), axis=0).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def bounded(pairs: DataFrame, points_of: DataFrame, at: Threshold) -> DataFrame:
    """The pairs (a, b of class ids) whose points allow a link: the bound of a tree's leaf, for pairs that are given."""
    side = lambda k: points_of.select(F.col("class_id").alias(k), F.col("n_shingles").alias(f"n{k}"), F.col("point").alias(f"p{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = (unpack_points(list(p)) for p in zip(batch.column("pa").to_pylist(), batch.column("pb").to_pylist(), strict=True))
            most = np.array([np.minimum(x, y).sum() for x, y in both], dtype=np.int64)
            passed = most >= at.least_overlap(batch.column("na").to_numpy() + batch.column("nb").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(passed, pa.bool_()))

    return both.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, representatives: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, at: Threshold) -> DataFrame:
    """The pairs (a, b of class ids) that are linked by their whole sets, which are made anew from the texts of their representatives."""
    involved = checkpoint(pairs.select(F.explode(F.array("a", "b")).alias("class_id")).distinct().join(representatives, "class_id").select(id_col).distinct())
    few = involved.count() <= BROADCAST_IDS
    source = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    wanted = involved.select(F.col(id_col).alias("__wanted"))
    chosen = source.join(F.broadcast(wanted) if few else wanted, F.col("__id").eqNullSafe(F.col("__wanted")), "left_semi")

    def work(texts: pa.Array) -> list[pa.Array]:
        sets = shingle_sets(texts, size)
        ids = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None for s in sets]
        return [pa.array(ids, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]

    sets = map_texts(chosen, "__text", ["__id"], [T.StructField("class_id", T.LongType()), T.StructField("shingles", T.BinaryType())], work, limit=SLICE)
    sets = checkpoint(sets.where("class_id is not null").dropDuplicates(["class_id"]).select("class_id", "shingles"))
    both = pairs.join(sets.select(F.col("class_id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("class_id").alias("b"), F.col("shingles").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                where = np.minimum(np.searchsorted(y, x), len(y) - 1)
                hit.append(at.linked(int((y[where] == x).sum()), len(x), len(y)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 80, den: int = 100, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: the id, what is kept, n_shingles, class_id, group (a class of its component; null without words) and component_id (the least id that links reach, its own included).

    Sets link when den * overlap >= num * union."""
    at = Threshold(num, den)
    spark = docs.sparkSession
    rows = stored(entries(docs, id_col, text_col, shingle, at, keep).withColumn("__row", F.monotonically_increasing_id()))
    whole = rows.where("class_id is not null")
    classes = checkpoint(whole.groupBy("class_id").agg(F.min(id_col).alias(id_col), F.min("__row").alias("__first"), F.count("*").alias("copies")))
    copied = classes.where("copies > 1").select("class_id", "__first")
    if copied.count() <= BROADCAST_IDS:
        copied = F.broadcast(copied)
    single = whole.join(copied, "class_id", "left").where(F.col("__first").isNull() | (F.col("__first") == F.col("__row")))  # a row for each class
    points_of = single.select("class_id", "n_shingles", "point")
    tiles = single.select("class_id", F.explode(F.concat("tiles", "below")).alias("tile"))
    shared = checkpoint(tiles.groupBy("tile").agg(F.count("*").alias("crowd")).where("crowd > 1"))
    if shared.count() <= BROADCAST_TILES:
        shared = F.broadcast(shared)
    members = stored(tiles.join(shared, "tile").select("tile", "crowd", "class_id"))
    let_go(spark)
    central = members.groupBy("class_id").agg(F.sum("crowd").alias("weight"))  # the middle of a family shares most with most
    weighed = members.join(central, "class_id").select("tile", "class_id", "weight")
    pivots = weighed.groupBy("tile").agg(F.max_by("class_id", F.struct("weight", "class_id")).alias("pivot"))
    offers = members.join(pivots, "tile").where("class_id <> pivot").groupBy(F.col("class_id").alias("a"), F.col("pivot").alias("b")).count()
    offers = offers.groupBy("a").agg(F.max_by("b", F.struct("count", "b")).alias("b"))
    first = checkpoint(verified(checkpoint(bounded(offers, points_of, at)), classes, docs, id_col, text_col, shingle, at))
    # the centre of the centre, where it has one; of two that are each other's, the lesser: labels only spare work, links are complete without them
    beyond = first.alias("own").join(first.select(F.col("a").alias("__a"), F.col("b").alias("__b")), F.col("b") == F.col("__a"), "left")
    near = beyond.select(F.col("a").alias("class_id"), F.when(F.col("__b") == F.col("a"), F.least("a", "b")).otherwise(F.coalesce("__b", "b")).alias("label"))
    let_go(spark)
    labelled = stored(members.join(near, "class_id", "left").select("tile", "class_id", F.coalesce("label", "class_id").alias("label")))
    mixed = labelled.groupBy("tile").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("rows")).where("low < high")
    blocks = F.ceil(F.col("rows") / TILE_ROWS).cast("int")
    search = labelled.join(mixed.select("tile", blocks.alias("blocks")), "tile").withColumn("own", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
    search = search.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    search = search.select("tile", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), (F.col("own") > F.col("with")).cast("int").alias("side"), "class_id", "label")
    search = search.join(single.select("class_id", "n_shingles", "coarse", F.slice("tiles", 1, EARLY).alias("own_early"), F.slice("below", 1, EARLY).alias("below_early")), "class_id")
    early = F.when(F.col("tile").bitwiseAND(1) == F.get("below_early", F.lit(0)).bitwiseAND(1), F.col("below_early")).otherwise(F.col("own_early"))
    search = search.select("tile", "i", "j", "side", "class_id", "label", "n_shingles", "coarse", early.alias("early"))
    search = search.repartition("tile", "i", "j").sortWithinPartitions("tile", "i", "j")
    pairs = checkpoint(search.mapInArrow(_search_tiles(at), "a long, b long").distinct())
    let_go(spark)
    more = verified(checkpoint(bounded(pairs, points_of, at)), classes, docs, id_col, text_col, shingle, at)
    let_go(spark)
    merged = labels(first.unionAll(more), "a", "b").select(F.col("node").alias("class_id"), F.col("label").alias("group"))
    named = classes.join(merged, "class_id", "left").withColumn("group", F.coalesce("group", "class_id"))
    lowest = named.groupBy("group").agg(F.min(id_col).alias("component_id"))
    named = named.join(lowest, "group").select("class_id", "group", "component_id")
    out = rows.select(id_col, *keep, "n_shingles", "class_id").join(named, "class_id", "left")
    return out.select(id_col, *keep, "n_shingles", "class_id", "group", F.coalesce("component_id", id_col).alias("component_id"))

"""Packing documents into windows of tokens by non-negative least squares over a histogram of lengths.

A document's ids, closed by one more id, are cut into full windows and a rest. The histogram of the rests has fewer bins than a
window has tokens, however many documents there are. All combinations of up to DEPTH lengths that fill a window exactly are enumerated;
non-negative least squares finds how often each is to be used so that together they use up the histogram; the counts are rounded so
that their running sum keeps up with the exact one. What is left is packed greedily, longest first: a window takes the longest rest that
still fits, and, when none fits, a piece cut from the longest one. The last window is cut into powers of two, so nothing is padded.

The driver sees the histogram and makes a plan: ranges of the documents of a length (numbered in order of
partition and place in it) and the windows that they go to, of a size that the enumeration bounds and the documents do not. Texts
are turned into ids once and written to the shared folder, with each document's number among those of its length in its
task; a second narrow stage adds what the tasks before hold, looks the documents up in the plan and cuts their ids.

Ids are those of a byte-level BPE tokenizer file. Words between single spaces are independent of each other there, so a slice of texts is cut at
spaces, each distinct word is encoded once from the same vocabulary's ranks, and the ids are laid out again; texts with other spacing,
special tokens or very long words go whole through the tokenizer itself.

Defined results: a null or empty text is its closing id alone; rows that repeat an id are documents of their own; very long texts are cut
like others (a task holds one at a time); an empty table gives no rows; kept columns that clash with added ones are left out. Which of several
documents of one length goes to which window follows from how the table is read; how many tokens are padded does not.
"""

from __future__ import annotations

import os
import uuid
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import SPACE_FIRST_PATTERN, read_ranks
from .common import packed, shared_folder, slices, utf8

WINDOW, DEPTH = 1024, 3
#: Steps of the least-squares solver; it ends earlier when a step gains less than this share.
MOST_STEPS, GAIN = 400, 1e-5
#: Bytes of text that a task encodes at once, and bytes of a word that the tokenizer encodes by itself.
SLICE, LONG_WORD = 16 << 20, 512
#: Rows of (partition, length) that may be sent to every task (24 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
# What Unicode or a tokenizer may take for white space.
SPACES = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
UNUSUAL = f" [{SPACES}]|[{SPACES}] | $"


class _Encoder:
    """Of a worker: the tokenizer, and a second one from the same vocabulary's ranks, which is quicker for many short words."""

    def __init__(self, tokenizer: str, ranks: tuple[bytes, ...]) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(tokenizer)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.quick = tiktoken.Encoding("ranks", pat_str=SPACE_FIRST_PATTERN, mergeable_ranks={r: i for i, r in enumerate(ranks)}, special_tokens={})
        self.bytes_of = np.array([len(r) for r in ranks], np.int64)

    def by_tokenizer(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, each after a space, and where those of each begin and end."""
        sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        short = pa.array(sizes <= LONG_WORD)
        text = " ".join(words.filter(short).to_pylist())
        ids = self.quick.encode_to_numpy(f" {text}", disallowed_special=()) if short.true_count else np.zeros(0, np.uint32)
        upto, ends = np.cumsum(self.bytes_of[ids]), np.cumsum(sizes[short.to_numpy(zero_copy_only=False)] + 1)
        at = np.searchsorted(upto, ends)
        if len(ends) and not np.array_equal(upto[at], ends):
            raise AssertionError("ids span two words")
        lengths = np.zeros(len(words), np.int64)
        lengths[sizes <= LONG_WORD] = np.diff(at + 1, prepend=0)
        if short.false_count == 0:
            return ids, np.append(0, np.cumsum(lengths))
        long = self.by_tokenizer([f" {w}" for w in words.filter(pc.invert(short)).to_pylist()])
        lengths[sizes > LONG_WORD] = [len(x) for x in long]
        bounds = np.append(0, np.cumsum(lengths))
        out = np.empty(bounds[-1], np.uint32)
        out[np.repeat(sizes <= LONG_WORD, lengths)] = ids
        out[np.repeat(sizes > LONG_WORD, lengths)] = np.concatenate(long)
        return out, bounds

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, each closed by ``end``, and the n + 1 bounds of the texts."""
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = pc.match_substring_regex(texts, UNUSUAL)
        for special in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, special))
        split = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
        words, bounds = split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
        first = np.zeros(len(words), bool)
        first[bounds[:-1]] = True
        # the first word of a text follows no space
        ahead = self.by_tokenizer(words.filter(pa.array(first)).to_pylist())
        coded = words.filter(pa.array(~first)).dictionary_encode()
        ids, starts = self.words(coded.dictionary)
        code = coded.indices.to_numpy().astype(np.int64)
        size = np.empty(len(words), np.int64)
        size[first], size[~first] = [len(a) for a in ahead], (starts[1:] - starts[:-1])[code]
        source = np.empty(len(words), np.int64)  # ids of the words, then those of the first words
        ahead_starts = len(ids) + np.cumsum([0, *(len(a) for a in ahead)])
        source[first], source[~first] = ahead_starts[:-1], starts[:-1][code]
        pool = np.concatenate([ids, *ahead, [end]]).astype(np.uint32)
        total = np.append(0, np.cumsum(size))
        # the whole slice: usual texts from the pool, the others as the tokenizer gave them
        is_odd = odd.to_numpy(zero_copy_only=False)
        others = self.by_tokenizer(texts.filter(odd).to_pylist())
        lengths = np.empty(len(texts), np.int64)
        lengths[~is_odd], lengths[is_odd] = total[bounds[1:]] - total[bounds[:-1]], [len(o) for o in others]
        out_bounds = np.append(0, np.cumsum(lengths + 1))
        out = np.empty(out_bounds[-1], np.uint32)
        usual = np.repeat(~is_odd, lengths + 1)
        usual[out_bounds[1:] - 1] = False
        step = np.ones(total[-1], np.int64)  # the places in the pool by their differences: one running sum lays all words out
        some = size > 0
        begin, src, n = total[:-1][some], source[some], size[some]
        if len(begin):
            step[begin] = src - np.append(0, src[:-1] + n[:-1] - 1)
        out[usual] = pool[np.cumsum(step)]
        rest = np.repeat(is_odd, lengths + 1)
        rest[out_bounds[1:] - 1] = False
        if others:
            out[rest] = np.concatenate(others)
        out[out_bounds[1:] - 1] = end
        return out, out_bounds


@lru_cache(maxsize=2)
def _encoder(tokenizer: str, ranks: tuple[bytes, ...]) -> _Encoder:
    return _Encoder(tokenizer, ranks)


def encoded(docs: DataFrame, tokenizer: str, ranks: tuple[bytes, ...], end: int, window: int, kind: type, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` and ids (little-endian, of type ``kind``), doc_tokens, part (the task) and, counted in it, the full windows and the rests of this length before."""
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer, ranks))
    source = docs.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{text_col}`").cast("string").alias("__text"))
    added = T.StructType.fromDDL("__ids binary, doc_tokens long, __part int, __windows long, __own long")
    schema = T.StructType([*[source.schema[k] for k in keep], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = _encoder(*shared.value), TaskContext.get().partitionId()
        windows, met = 0, np.zeros(window, np.int64)
        for batch in slices(batches, "__text", SLICE):
            ids, bounds = encoder.encode(batch.column("__text"), end)
            tokens = np.diff(bounds)
            full, rest = tokens // window, tokens % window
            order = np.argsort(rest, kind="stable")  # the place of each row among those of its rest in this slice
            first = np.searchsorted(rest[order], np.arange(window))
            own = np.empty(len(rest), np.int64)
            own[order] = np.arange(len(rest)) - first[rest[order]]
            own += met[rest]
            met += np.bincount(rest, minlength=window)
            before = windows + np.cumsum(full) - full
            windows += int(full.sum())
            out = [packed(ids.astype(kind), bounds), pa.array(tokens), pa.array(np.full(len(tokens), part, np.int32)), pa.array(before), pa.array(own)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], *out], names=[f.name for f in schema.fields])

    return source.mapInArrow(run, schema)


def combinations(lengths: list[int], window: int = WINDOW) -> np.ndarray:
    """All combinations of up to three of the lengths (repeats too) that sum to the window: three columns, falling, 0 where there is none."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    there[0] = True  # no further length
    largest = np.array(sorted((x for x in lengths if x > 0), reverse=True), np.int64)
    out = [np.zeros((0, 3), np.int64)]
    for a in largest.tolist():
        left = window - a
        b = np.arange(min(a, left), (left - 1) // 2, -1)
        b = b[(b * 2 >= left) & there[b] & there[left - b]]
        b = b[(b > 0) | (left == 0)]
        out.append(np.stack([np.full(len(b), a), b, left - b], axis=1))
    return np.concatenate(out)


def repeat_counts(combos: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """How often each combination is to be used: x >= 0 of least squares |A x - histogram|, by accelerated projected gradients; A has a column for each combination."""
    x = np.zeros(len(combos))
    if not len(combos):
        return x
    size = len(histogram)
    used = lambda v: np.bincount(combos.ravel(), np.repeat(v, combos.shape[1]), size)
    back = lambda r: r[combos].sum(axis=1)
    target = histogram.astype(float)
    mask = np.arange(size) > 0
    v = np.ones(len(combos))
    for _ in range(20):  # the largest singular value, by power iteration
        v = back(used(v) * mask)
        largest = np.linalg.norm(v)
        v /= largest
    step, y, t, last = 1 / (1.05 * largest), x, 1.0, np.inf
    for k in range(MOST_STEPS):
        gap = (used(y) - target) * mask
        new = np.maximum(y - step * back(gap), 0)
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / after * (new - x), new, after
        if k % 20 == 19:
            error = float(np.linalg.norm((used(x) - target) * mask))
            if error >= last * (1 - GAIN):
                break
            last = error
    return x


def rounded(combos: np.ndarray, counts: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Whole counts whose running sum keeps up with the exact one, as far as the histogram goes."""
    whole = np.diff(np.floor(np.cumsum(counts) + 0.5), prepend=0).astype(np.int64)
    left = histogram.astype(np.int64).copy()
    for k in np.flatnonzero(whole).tolist():
        parts = [p for p in combos[k].tolist() if p]
        whole[k] = min(whole[k], *(int(left[p]) // parts.count(p) for p in parts))
        for p in parts:
            left[p] -= whole[k]
    return whole


@dataclass
class Plan:
    """Where the rests go: document ``rank`` (from ``first`` on, below ``last``) of those whose rest is ``length`` puts its ids from ``start`` on, ``size`` of them, at ``offset`` of sequence ``sequence + rank - first``."""

    window: int
    sequences: int = 0
    rows: list[tuple[int, int, int, int, int, int, int]] = field(default_factory=list)  # length, start, first, last, size, sequence, offset
    left: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)  # by size: (length, start, first, last)
    count: dict[int, int] = field(default_factory=dict)
    sizes: list[int] = field(default_factory=list)  # sizes of which there are some, rising

    def add(self, size: int, piece: tuple[int, int, int, int]) -> None:
        if size not in self.count:
            insort(self.sizes, size)
        self.count[size] = self.count.get(size, 0) + piece[3] - piece[2]
        self.left.setdefault(size, []).append(piece)

    def take(self, size: int, n: int, upto: int, sequence: int, offset: int) -> None:
        """Put ``n`` pieces of a size, or of each its first ``upto`` tokens, into ``n`` sequences from ``sequence`` on; what is cut off is left for others."""
        self.count[size] -= n
        pieces = self.left[size]
        while n:
            length, start, first, last = pieces.pop()
            own = min(n, last - first)
            if first + own < last:
                pieces.append((length, start, first + own, last))
            self.rows.append((length, start, first, first + own, upto, sequence, offset))
            if upto < size:
                self.add(size - upto, (length, start + upto, first, first + own))
            sequence, n = sequence + own, n - own
        if not self.count[size]:
            del self.count[size], self.left[size]
            self.sizes.remove(size)

    def fill(self, parts: list[tuple[int, int]], n: int) -> None:
        """Make ``n`` sequences of (size, tokens to take) each."""
        offset = 0
        for size, upto in parts:
            self.take(size, n, upto, self.sequences, offset)
            offset += upto
        self.sequences += n

    def greedy(self) -> None:
        """Pack what is left, longest first; a window that nothing fits any more gets a piece cut from the longest."""
        while self.sizes:
            parts: list[tuple[int, int]] = []
            used: dict[int, int] = {}
            space = self.window
            while space:
                at = bisect_right(self.sizes, space) - 1
                while at >= 0 and self.count[self.sizes[at]] <= used.get(self.sizes[at], 0):
                    at -= 1
                if at < 0:
                    at = len(self.sizes) - 1
                    while at >= 0 and self.count[self.sizes[at]] <= used.get(self.sizes[at], 0):
                        at -= 1
                if at < 0:
                    break
                size = self.sizes[at]
                used[size] = used.get(size, 0) + 1
                parts.append((size, min(size, space)))
                space -= min(size, space)
            if space:
                self.last(parts)
            else:
                self.fill(parts, min(self.count[s] // k for s, k in used.items()))

    def last(self, parts: list[tuple[int, int]]) -> None:
        """The last rests, which fill no window, in sequences of powers of two."""
        total = sum(size for size, _ in parts)
        space, offset = 0, 0
        for size, _ in parts:
            while size:
                if not space:
                    space, offset = 1 << (total.bit_length() - 1), 0
                    self.sequences += 1
                upto = min(size, space)
                self.take(size, 1, upto, self.sequences - 1, offset)
                size, space, offset, total = size - upto, space - upto, offset + upto, total - upto


def plan(histogram: np.ndarray, window: int = WINDOW) -> Plan:
    """The plan of rests, of which there are ``histogram[length]`` of each length from 1 on, below the window."""
    out = Plan(window)
    for length in np.flatnonzero(histogram[1:window]) + 1:
        out.add(int(length), (int(length), 0, 0, int(histogram[length])))
    combos = combinations([s for s in out.sizes], window)
    for combo, n in zip(combos.tolist(), rounded(combos, repeat_counts(combos, histogram), histogram).tolist(), strict=True):
        if n:
            out.fill([(p, p) for p in combo if p], n)
    out.greedy()
    return out


def _cutting(shared, window: int, kind: type, keep: list[str], names: list[str]):
    """Cut the ids of documents whose ``rank`` and ``full_rank`` are known into pieces, by the plan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, size, sequence, offset, sequences = shared.value
        for batch in slices(batches, "__ids", SLICE):
            column = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: B023, E731
            tokens, rank, full_rank = column("doc_tokens"), column("rank"), column("full_rank")
            full, rest = tokens // window, tokens % window
            row = np.repeat(np.arange(len(tokens)), full)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(full) - full, full)
            found = [np.stack([row, nth * window, np.full(len(row), window), sequences + full_rank[row] + nth, np.zeros(len(row), np.int64)])]
            here, start = np.flatnonzero(rest), np.zeros(int((rest > 0).sum()), np.int64)
            while len(here):
                at = np.searchsorted(key, _key(rest[here], start, rank[here], window), side="right") - 1
                first = key[at] & _RANKS
                found.append(np.stack([here, full[here] * window + start, size[at], sequence[at] + rank[here] - first, offset[at]]))
                start = start + size[at]
                more = start < rest[here]
                here, start = here[more], start[more]
            pieces = np.concatenate(found, axis=1)
            pieces = pieces[:, np.lexsort((pieces[1], pieces[0]))]
            data, _ = utf8(batch.column("__ids"))
            ids = packed(np.frombuffer(data.tobytes(), kind).astype(np.uint32), np.append(0, np.cumsum(pieces[2])))
            own = pa.array(pieces[0])
            out = [*[batch.column(k).take(own) for k in keep], pa.array(pieces[1]), pa.array(pieces[2]), ids, pa.array(tokens[pieces[0]]), pa.array(pieces[3]), pa.array(pieces[4])]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return run


_RANKS = (1 << 40) - 1


def _key(length: np.ndarray, start: np.ndarray, rank: np.ndarray, window: int) -> np.ndarray:
    return ((length * (window + 1) + start) << 40) + rank


def _kind(tokenizer: str, end: int) -> type:
    """What the ids are stored as: 16 bits where all of them fit."""
    from tokenizers import Tokenizer

    ids = Tokenizer.from_str(tokenizer).get_vocab(with_added_tokens=True).values()
    return np.uint16 if max(end, *ids) < 1 << 16 else np.uint32


def pack(docs: DataFrame, tokenizer_file: str, rank_file: str, end: int = 0, window: int = WINDOW, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Of every piece: ``keep``, start (the document's ids before it), length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id and offset (in the sequence).

    The ids are written to the shared folder once and read from there; the pieces refer to that copy, which stays."""
    spark = docs.sparkSession
    added = {"start", "length", "ids", "doc_tokens", "sequence_id", "offset", "__ids", "__part", "__windows", "__own", "rank", "full_rank", "rest", "__text"}
    kept = [c for c in keep if c.lower() not in added]
    root = f"{shared_folder(spark)}/packing-{uuid.uuid4().hex}"
    with open(tokenizer_file, encoding="utf-8") as f:
        tokenizer = f.read()
    kind = _kind(tokenizer, end)
    encoded(docs, tokenizer, tuple(read_ranks(rank_file)), end, window, kind, text_col, kept).write.option("compression", "zstd").parquet(root)
    tokens = spark.read.parquet(root).withColumn("rest", (F.col("doc_tokens") % window).cast("int"))
    each = tokens.groupBy("__part", "rest").agg(F.count("*").alias("rows"), F.sum(F.floor(F.col("doc_tokens") / window)).alias("windows"))
    windows = each.groupBy("__part").agg(F.sum("windows").alias("rows")).select("__part", F.lit(window).alias("rest"), "rows")
    before = Window.partitionBy("rest").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = each.select("__part", "rest", "rows").unionAll(windows)
    held = {r["rest"]: r["rows"] for r in counts.groupBy("rest").agg(F.sum("rows").alias("rows")).collect()}  # a row for each length of a window
    histogram = np.zeros(window + 1, np.int64)
    for length, n in held.items():
        histogram[length] = n
    made = plan(np.append(0, histogram[1:window]), window)
    rows = np.array(made.rows, np.int64).reshape(-1, 7)
    key = _key(rows[:, 0], rows[:, 1], rows[:, 2], window)
    order = np.argsort(key)
    shared = spark.sparkContext.broadcast((key[order], rows[order, 4], rows[order, 5], rows[order, 6], made.sequences))
    places = counts.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    rests = places.where(F.col("rest") < window).select("__part", "rest", F.col("before").alias("__rests"))
    fulls = places.where(F.col("rest") == window).select("__part", F.col("before").alias("__fulls"))
    both = rests.join(fulls, "__part")
    few = each.count() <= BROADCAST_ROWS
    ranked = tokens.join(F.broadcast(both) if few else both, ["__part", "rest"])
    ranked = ranked.select(*[F.col(f"`{k}`") for k in kept], "__ids", "doc_tokens", (F.col("__own") + F.col("__rests")).alias("rank"), (F.col("__windows") + F.col("__fulls")).alias("full_rank"))
    schema = T.StructType([*[tokens.schema[k] for k in kept], *T.StructType.fromDDL("start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")])
    return ranked.mapInArrow(_cutting(shared, window, kind, kept, [f.name for f in schema.fields]), schema)

"""Periodic runs of words by online dyadic square catching.

Words are appended to a stream. On level k every completed block of 2**(k-1) words (one word at least) holds a catcher for
the periods from 2**k on, below 2**(k+1): with each appended word it compares its block with the latest words of that length, by
fingerprints. A block that comes again p words later lies in the left half of a square of period p; catches of
neighbouring blocks at one distance are one stretch, which is compared outwards word by word. All squares of a stretch merge
into one run, and a run that a shorter period has already explains what its multiples catch.

Documents follow one another in a stream, each closed by a word of its own, so that no square spans two of them. Words are appended
many at a time; a level keeps no more fingerprints than its catchers still need.

Defined results: a null or empty text has no words and no runs; equal texts have equal runs; very long texts are taken whole
(a task holds one at a time, with 8 bytes a word and the fingerprints); repeated rows are rows of their own; an empty table gives no rows; of
several runs with the greatest exponent the first is told, of these that of least period; kept columns that clash with added ones are left out.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts

LEAST_EXPONENT, LEAST_LENGTH = 4, 6
#: Words that are appended at once.
STEP = 1 << 20
#: Runs that are looked at, back from where a stretch begins, for one that explains it.
LOOK_BACK = 4
# Odd multipliers of the fingerprints; any would do.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], dtype=np.uint64)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fingerprints of two windows that follow each other."""
    out = a * MIX[0] + b * MIX[1]
    out ^= out >> np.uint64(29)
    out *= MIX[2]
    return out


class _Level:
    """The catchers of one level: periods from ``low`` on, below ``2 * low``, on blocks of ``block`` words."""

    def __init__(self, low: int) -> None:
        self.low, self.block = low, max(1, low // 2)
        self.prints, self.at = np.zeros(0, np.uint64), 0  # fingerprints of the windows from position ``at`` on
        self.next = 0  # the first block that has not seen all its words
        self.open = np.zeros((3, 0), np.int64)  # stretches that may go on: distance - low, first and last block

    @property
    def end(self) -> int:
        return self.at + len(self.prints)

    def advance(self, new: np.ndarray) -> np.ndarray:
        """Take the fingerprints of the next windows; returns the stretches that have ended."""
        self.prints = np.concatenate([self.prints, new])
        start = self.next * self.block
        rows = max(0, (self.end - start - 2 * self.low) // self.block + 1)
        if rows == 0:
            return self.open[:, :0]
        prints = np.ascontiguousarray(self.prints[start - self.at :])
        step = prints.strides[0]
        seen = np.lib.stride_tricks.as_strided(prints[self.low :], (rows, self.low), (self.block * step, step))
        caught = np.flatnonzero(seen == prints[: rows * self.block : self.block, None])
        distance, block = caught % self.low, caught // self.low + self.next
        order = np.lexsort((block, distance))
        distance, block = distance[order], block[order]
        first = np.ones(len(caught), bool)
        first[1:] = (distance[1:] != distance[:-1]) | (block[1:] != block[:-1] + 1)
        last = np.append(first[1:], True)[: len(caught)]
        found = np.stack([distance[first], block[first], block[last]]).astype(np.int64)
        if self.open.shape[1]:  # all of them end at the block before; there is one for a distance at most
            goes_on = np.flatnonzero(found[1] == self.next)
            where = np.searchsorted(self.open[0], found[0, goes_on])
            held = (where < self.open.shape[1]) & (self.open[0, np.minimum(where, self.open.shape[1] - 1)] == found[0, goes_on])
            found[1, goes_on[held]] = self.open[1, where[held]]
            found = np.concatenate([found, np.delete(self.open, where[held], axis=1)], axis=1)
        self.next += rows
        unfinished = found[2] == self.next - 1
        self.open = found[:, unfinished]
        self.open = self.open[:, np.argsort(self.open[0])]
        return found[:, ~unfinished]

    def forget(self, before: int) -> None:
        """Fingerprints that neither this level's catchers nor the next level needs any more go."""
        keep = min(before, self.next * self.block)
        if keep > self.at:
            self.prints, self.at = self.prints[keep - self.at :], keep


class Catchers:
    """Runs of a stream of word numbers (0 or more) with exponent ``least_exponent`` (2 or more) and ``least_length`` at least, of periods up to ``longest``."""

    def __init__(self, longest: int, least_exponent: int = LEAST_EXPONENT, least_length: int = LEAST_LENGTH) -> None:
        if least_exponent < 2:
            raise ValueError("a run holds a square")
        self.exponent, self.length = least_exponent, least_length
        self.levels = [_Level(1 << k) for k in range(max(1, longest).bit_length())]
        self.words = np.zeros(0, np.int64)
        self.runs = np.zeros((3, 0), np.int64)  # start, length, period; by start

    def append(self, words: np.ndarray) -> None:
        """The catchers see the next words; runs that they end are added."""
        self.words = np.concatenate([self.words, words])
        new = _mixed(words.astype(np.uint64) + MIX[2], MIX[:1])
        for k, level in enumerate(self.levels):
            if k > 0:
                below = self.levels[k - 1]
                if level.block == below.block:
                    new = below.prints[level.end - below.at :]
                else:
                    half, upto = below.block, below.end - below.block
                    here = below.prints[level.end - below.at : max(upto, level.end) - below.at]
                    new = _mixed(here, below.prints[level.end - below.at + half :][: len(here)])
            self._merge(level, level.advance(new))
        for k, level in enumerate(self.levels):
            level.forget(self.levels[k + 1].end if k + 1 < len(self.levels) else level.end)

    def finish(self) -> np.ndarray:
        """(start, length, period) of all runs, by start and period; nothing can be appended after."""
        self.append(-1 - np.arange(4 * self.levels[-1].low, dtype=np.int64) - (1 << 62))
        order = np.lexsort((self.runs[2], self.runs[1], self.runs[0]))
        runs = self.runs[:, order]
        again = np.zeros(runs.shape[1], bool)
        again[1:] = (runs[0, 1:] == runs[0, :-1]) & (runs[1, 1:] == runs[1, :-1])  # the same words: the least period counts
        runs = runs[:, ~again]
        return runs[:, np.lexsort((runs[2], runs[0]))]

    def _merge(self, level: _Level, found: np.ndarray) -> None:
        """Make runs of a level's stretches: leave out what is too short or known, compare the others outwards."""
        period = found[0] + level.low
        equal = np.maximum(self.length, self.exponent * period) - period  # words that must equal those a period on
        found = found[:, (found[2] - found[1] + 3) * level.block - 2 >= equal]
        period, start, end = found[0] + level.low, found[1] * level.block, (found[2] + 1) * level.block
        known = np.zeros(len(period), bool)
        at = np.searchsorted(self.runs[0], start, side="right") - 1
        for back in range(min(LOOK_BACK, self.runs.shape[1])):
            run = self.runs[:, np.maximum(at - back, 0)]
            known |= (at >= back) & (run[0] <= start) & (end + period <= run[0] + run[1]) & (period % run[2] == 0)
        new = []
        for p, a, b in zip(period[~known].tolist(), start[~known].tolist(), end[~known].tolist(), strict=True):
            a, b = max(0, a - level.block + 1), min(b + level.block - 1, len(self.words) - p)
            same = np.concatenate([[False], self.words[a:b] == self.words[a + p : b + p], [False]])
            turns = np.flatnonzero(same[1:] != same[:-1])
            for i, j in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
                if j - i + p >= max(self.length, self.exponent * p):
                    new.append((a + i, j - i + p, p))
        if new:
            runs = np.concatenate([self.runs, np.array(sorted(set(new)), np.int64).T], axis=1)
            self.runs = runs[:, np.argsort(runs[0], kind="stable")]


def find_runs(words: np.ndarray, bounds: np.ndarray, least_exponent: int = LEAST_EXPONENT, least_length: int = LEAST_LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Of documents whose word numbers lie end to end, bounded by ``bounds``: (document) and (start, length, period) of every run, by document, start and period."""
    sizes = np.diff(bounds)
    n = len(sizes)
    stream = np.empty(len(words) + n, np.int64)
    closed = bounds[1:] + np.arange(n)
    own = np.ones(len(stream), bool)
    own[closed] = False
    stream[closed] = -1 - np.arange(n)
    stream[own] = words
    catchers = Catchers(int(sizes.max(initial=0)) // least_exponent, least_exponent, least_length)
    for a in range(0, len(stream), STEP):
        catchers.append(stream[a : a + STEP])
    runs = catchers.finish()
    starts = bounds[:-1] + np.arange(n)
    document = np.searchsorted(starts, runs[0], side="right") - 1
    runs[0] -= starts[document]
    return document, runs


def _strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period; ties go to the least start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _work(least_exponent: int, least_length: int):
    def work(texts: pa.Array) -> list[pa.Array]:
        split = [t.split() for t in texts.cast(pa.large_binary()).fill_null(b"").to_pylist()]  # bytes are split at \x20 and \x09-\x0D alone
        number = defaultdict(count().__next__)
        sizes = [len(s) for s in split]
        words = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64, sum(sizes))
        document, runs = find_runs(words, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), least_exponent, least_length)
        cut = np.searchsorted(document, np.arange(len(split) + 1))
        rows = list(zip(*runs.tolist(), strict=True))
        out = []
        for k, own in enumerate(split):
            found = rows[cut[k] : cut[k + 1]]
            if found:
                kept = np.ones(len(own), bool)
                for start, length, period in found:
                    kept[start + period : start + length] = False
                own = [own[i] for i in np.flatnonzero(kept).tolist()]
            out.append(([{"start": s, "length": n, "period": p} for s, n, p in found], _strongest(found), b" ".join(own)))
        best = [b or (None, None, None) for _, b, _ in out]
        listed = [hashlib.sha256("".join(f"{r['start']},{r['length']},{r['period']}\n" for r in found).encode()).hexdigest() for found, _, _ in out]
        one = [pa.array([b[i] for b in best], pa.int64()) for i in range(3)]
        exponent = pa.array([None if b[0] is None else 1000 * b[1] // b[2] for b in best], pa.int64())
        found = pa.array([f for f, _, _ in out], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])))
        collapsed = pa.array([c for _, _, c in out], pa.binary()).cast(pa.string())
        return [found, *one, exponent, pa.array(listed, pa.string()), collapsed]

    return work


RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def runs_of(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), least_exponent: int = LEAST_EXPONENT, least_length: int = LEAST_LENGTH) -> DataFrame:
    """``keep`` and, of the words of each text: runs (all of them, by start and period), start, length, period and exponent_milli of the
    strongest, runs_sha256 (of the runs as lines), collapsed (the text with each run's first period only, words joined by one space)."""
    long = [T.StructField(c, T.LongType()) for c in ("start", "length", "period", "exponent_milli")]
    added = [T.StructField("runs", T.ArrayType(RUN)), *long, T.StructField("runs_sha256", T.StringType()), T.StructField("collapsed", T.StringType())]
    return map_texts(docs, text_col, list(keep), added, _work(least_exponent, least_length))


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, of which about a tenth, chosen by the id's crc32, end in a period that is repeated three to ten times; its place and length follow from the crc32 too."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    marked = docs.withColumn("__g", F.when(h % 10 == 0, F.floor(h / 10)))
    marked = marked.withColumn("__words", F.when(F.col("__g").isNotNull(), F.regexp_extract_all(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    n, g = F.size("__words"), F.col("__g")
    marked = marked.withColumn("__a", F.when(n > 0, (g % n).cast("int")))
    marked = marked.withColumn("__p", (1 + F.floor((n - F.col("__a")) / (3 + g % 8))).cast("int"))
    times = F.ceil((n - F.col("__a")) / F.col("__p")).cast("int")
    cycle = F.slice("__words", F.col("__a") + 1, F.col("__p"))
    again = F.slice(F.flatten(F.array_repeat(cycle, times)), F.lit(1), n - F.col("__a"))
    planted = F.array_join(F.concat(F.slice("__words", F.lit(1), F.col("__a")), again), " ")
    return marked.withColumn(text_col, F.when(F.col("__a").isNotNull(), planted).otherwise(F.col(text_col))).drop("__g", "__words", "__a", "__p")

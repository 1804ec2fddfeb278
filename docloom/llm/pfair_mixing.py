"""Mixing sources to target weights by Pfair scheduling.

A source's rows are cut into blocks. Block j of a source of weight w (its share of the phase's weights) is released at
floor(j / w) and due at ceil((j + 1) / w), in whole numbers without rounding of the weights; in every slot the released block
that is due first is taken, so at any time of a phase a source is less than one block from its share. What is placed
before a slot says all that follows, so the driver only counts (a step for each block, none kept), and tasks place the
blocks from its counts, SEGMENT slots at a time.

No row is dropped or repeated: when a source runs out, the others go on with their weights scaled up (a
new phase), counted from the slot after its last block.

Rows are numbered within a source without bringing a source into one task: in each hashed bucket by
itself, plus the sizes of the buckets before it. Rows without an id are hashed by all that they hold, so they spread as others do.

Defined results: a null source is a source of its own; sources without a given weight get the least
given one; repeated rows are placed each for itself (rows of one id share a bucket); null ids are placed like others; texts
play no part, however long; columns named block, slot, place, release or deadline are replaced, all others kept; ties of deadlines go
to the source of lesser name; an empty table gives no rows; more than MOST_SOURCES sources are an error (group them first).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import without

BLOCK_ROWS = 32
#: Slots that a task places at once, blocks to a piece of the plan, and the most blocks whose plan is broadcast.
SEGMENT, PIECE, BROADCAST_BLOCKS = 20_000, 256, 1 << 20
MOST_SOURCES = 256
#: Without given weights a source's weight is its number of rows to this power.
TEMPER = 0.5
#: Rows of a bucket, about, and the fewest and most buckets of a source.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 2000, 256, 1 << 16


def frame_shares(weights: list[float], frame: int) -> list[int]:
    """Slots of a frame for each weight, one at least, by largest remainder."""
    total = sum(weights)
    exact = [w / total * frame for w in weights]
    shares = [max(1, math.floor(e)) for e in exact]
    order = sorted(range(len(weights)), key=lambda i: (shares[i] - exact[i], i))
    at = 0
    while sum(shares) < frame:
        shares[order[at % len(order)]] += 1
        at += 1
    while sum(shares) > frame:
        largest = max(range(len(shares)), key=lambda i: (shares[i], -i))
        shares[largest] -= 1
    return shares


def windows(share: int, frame: int) -> list[tuple[int, int]]:
    """(release, deadline) of each of the blocks that a source has in a frame."""
    return [(j * frame // share, -(-(j + 1) * frame // share)) for j in range(share)]


def whole(weights: list[float]) -> list[int]:
    """The weights as whole numbers in exactly their proportions."""
    exact = [Fraction(w) for w in weights]
    scale = math.lcm(*(e.denominator for e in exact))
    out = [int(e * scale) for e in exact]
    return [w // math.gcd(*out) for w in out]


def schedule(weights: list[int], done: list[int], slot: int) -> Iterator[tuple[int, int, int, int]]:
    """(source, block, release, deadline) of each slot from ``slot`` on, without end, after ``done`` blocks of each source."""
    total = sum(weights)
    ready: list[tuple[int, int, int, int]] = []
    waiting = [(j * total // w, -(-(j + 1) * total // w), s, j) for s, (w, j) in enumerate(zip(weights, done, strict=True))]
    heapq.heapify(waiting)
    while True:
        while waiting and waiting[0][0] <= slot:
            release, deadline, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, s, j, release))
        deadline, s, j, release = heapq.heappop(ready)
        if slot >= deadline:
            raise AssertionError("a block missed its deadline")
        yield s, j, release, deadline
        j += 1
        heapq.heappush(waiting, (j * total // weights[s], -(-(j + 1) * total // weights[s]), s, j))
        slot += 1


def frame_pattern(shares: list[int], frame: int) -> list[list[int]]:
    """The slots of a frame that each source's blocks get, at weights that are whole slots."""
    slots: list[list[int]] = [[] for _ in shares]
    for slot, (s, *_) in zip(range(frame), schedule(shares, [0] * len(shares), 0), strict=False):
        slots[s].append(slot)
    return slots


@dataclass(frozen=True)
class Segment:
    """Slots of a phase: its start, its sources' weights and blocks placed before it; the segment's first slot (from the start), number of slots, and blocks done."""

    sources: list[int]
    weights: list[int]
    before: list[int]
    start: int
    slot: int
    count: int
    done: list[int]


@dataclass(frozen=True)
class Part:
    """Blocks first to last - 1 of a source, in slots from start on, with their windows from the phase's start on."""

    source: str | None
    first: int
    last: int
    start: int
    frame: int
    slots: list[int]
    windows: list[tuple[int, int]]
    phase: int


def segments(blocks: list[int], weights: list[float], most: int = SEGMENT) -> Iterator[Segment]:
    """The segments that place all blocks, phase by phase; a phase ends with the last block of a source."""
    left, placed, start = list(blocks), [0] * len(blocks), 0
    while any(left):
        sources = [s for s, n in enumerate(left) if n]
        exact, before = whole([weights[s] for s in sources]), [placed[s] for s in sources]
        done, at, slot = [0] * len(sources), [0] * len(sources), 0
        first = 0
        for s, *_ in schedule(exact, done, 0):
            at[s] += 1
            slot += 1
            over = before[s] + at[s] == blocks[sources[s]]
            if over or slot - first == most:
                yield Segment(sources, exact, before, start, first, slot - first, done)
                first, done = slot, list(at)
            if over:
                break
        start += slot
        for s, n in zip(sources, at, strict=True):
            placed[s] += n
            left[s] -= n


def parts(segment: Segment) -> Iterator[Part]:
    """A segment's parts, one for each source that has blocks in it; sources by number."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in segment.sources]
    for slot, (s, _, release, deadline) in zip(range(segment.count), schedule(segment.weights, segment.done, segment.slot), strict=False):
        found[s].append((slot, release, deadline))
    for s, own in enumerate(found):
        if own:
            first = segment.before[s] + segment.done[s]
            yield Part(segment.sources[s], first, first + len(own), segment.start + segment.slot, segment.count, [o[0] for o in own], [o[1:] for o in own], segment.start)


def plan(blocks: dict[str | None, int], weights: dict[str | None, float], most: int = SEGMENT) -> list[Part]:
    """The parts that place all blocks, on the driver."""
    sources = sorted(blocks, key=lambda s: (s is not None, s or ""))
    placed = [p for g in segments([blocks[s] for s in sources], [weights[s] for s in sources], most) for p in parts(g)]
    return [Part(sources[p.source], p.first, p.last, p.start, p.frame, p.slots, p.windows, p.phase) for p in placed]


def _placing(size: int):
    """Of segments, the pieces of the plan, of ``size`` blocks: (source's number, piece, first block, and slots, releases and deadlines from it on)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                numbers = {c: [int(v) for v in row[c]] for c in ("sources", "weights", "before", "done")}
                out = []
                for p in parts(Segment(start=row["start"], slot=row["slot"], count=row["count"], **numbers)):
                    cuts = [p.first, *range((p.first // size + 1) * size, p.last, size), p.last]
                    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                        own = range(a - p.first, b - p.first)
                        out.append((p.source, a // size, a, [p.start + p.slots[i] for i in own], [p.phase + p.windows[i][0] for i in own], [p.phase + p.windows[i][1] for i in own]))
                kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["n", "piece", "first", "slots", "releases", "deadlines"])

    return run


def tempered(counts: dict[str | None, int], power: float = TEMPER) -> dict[str | None, float]:
    """Weights in proportion to a power of the sources' sizes."""
    return {s: float(n) ** power for s, n in counts.items()}


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows with block, slot, place (within the block), release and deadline; rows in order of slot and place are the mixture."""
    spark = docs.sparkSession
    rest = without(docs, "block", "slot", "place", "release", "deadline")
    counts = {r[0]: r[1] for r in rest.groupBy(source_col).count().limit(MOST_SOURCES + 1).collect()}  # MOST_SOURCES + 1 rows at most
    if len(counts) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; group them into fewer")
    given = weights or tempered(counts)
    if any(w <= 0 or not math.isfinite(w) for w in given.values()):
        raise ValueError("weights have to be positive")
    target = {s: given.get(s, min(given.values())) for s in counts}
    names = sorted(counts, key=lambda s: (s is not None, s or ""))
    blocks = [-(-counts[s] // block_rows) for s in names]
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, sum(counts.values()) // BUCKET_ROWS))
    named = F.broadcast(spark.createDataFrame(list(enumerate(names)), T.StructType([T.StructField("n", T.IntegerType()), T.StructField("named", rest.schema[source_col].dataType)])))
    # a document as one value, so that no column of it clashes with those below; its source as a number, so that the joins need no exchange of it
    document = rest.select(F.struct(*[F.col(f"`{c}`") for c in rest.columns]).alias("document"))
    own_id, content = F.col("document").getField(id_col), F.xxhash64("document")
    hashed = document.join(named, F.col("document").getField(source_col).eqNullSafe(F.col("named"))).drop("named")
    hashed = hashed.withColumn("bucket", F.pmod(F.xxhash64(own_id, F.when(own_id.isNull(), content), F.lit(29)), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("n").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = hashed.groupBy("n", "bucket").count().select("n", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    ranked = hashed.withColumn("own", F.row_number().over(Window.partitionBy("n", "bucket").orderBy(F.xxhash64(own_id, F.lit(31)), own_id, content)) - 1)
    ranked = ranked.join(sizes, ["n", "bucket"]).withColumn("own", F.col("own") + F.col("before"))
    ranked = ranked.select("document", "n", F.floor(F.col("own") / block_rows).alias("block"), (F.col("own") % block_rows).cast("int").alias("place"))
    text = lambda values: [str(v) for v in values]  # noqa: E731  # exact weights may be longer than a long
    rows = [(text(g.sources), text(g.weights), text(g.before), text(g.done), g.start, g.slot, g.count) for g in segments(blocks, [target[s] for s in names])]
    kept = ("sources", "weights", "before", "done")
    schema = T.StructType([*[T.StructField(c, T.ArrayType(T.StringType())) for c in kept], *[T.StructField(c, T.LongType()) for c in ("start", "slot", "count")]])
    pieces = spark.createDataFrame(rows, schema).mapInArrow(_placing(PIECE), "n int, piece long, first long, slots array<long>, releases array<long>, deadlines array<long>")
    pieces = pieces.withColumnRenamed("n", "of")
    here = F.col("block") - F.col("first")
    within = (F.col("n") == F.col("of")) & (F.floor(F.col("block") / PIECE) == F.col("piece")) & (here >= 0) & (here < F.size("slots"))
    placed = ranked.join(F.broadcast(pieces) if sum(blocks) <= BROADCAST_BLOCKS else pieces, within)
    at = lambda column: F.get(column, here.cast("int")).alias(column[:-1])
    return placed.select("document.*", "block", at("slots"), "place", at("releases"), at("deadlines"))


def in_order(mixed: DataFrame) -> DataFrame:
    """The mixture's rows in its order: by ranges of slots, sorted within each."""
    return mixed.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place")

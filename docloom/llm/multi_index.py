"""Near-duplicate vectors by an inverted multi-index.

Each half of the unit vectors has a codebook (k-means on at most SAMPLE distinct vectors, chosen by
hash); a pair of codewords is a cell of the product grid, and every vector lies in one cell. A vector
visits cells in the order of its distance to them, nearest first (multi-sequence order). How many it
visits follows from a calibration: QUERIES vectors are compared with all by brute force, each by its own
share of links met. Queries near each other are one stratum, so a large group counts once. More queries are drawn
(MOST_QUERIES at most) until ENOUGH strata have links; where links are rarer still, pairs made at cosines from the
least to 1 stand in for them. Visits are enough when the mean over the strata, and all but the lowest LOW of
them, reach TARGET; while they do not, twice as many are tried, up to the whole grid. What meets in a cell is
compared exactly, in double precision. The grid grows with the number of vectors, so a cell holds about PER_CELL
of them; its codebooks learn from at most CROWD of the sample's vectors near one another.

A pair that meets in one direction only is counted for both. Equal vectors are one class with a size, so copies
are never compared. Cells of more than BLOCK vectors at home are cut into blocks, and what
visits a cell into parties of about PARTY, each searched by itself.

Defined results: a vector that is null, zero, or holds a null or a component that is not finite links
with nothing (n_links 0, its own component); vectors of one length link with each other, whatever length that is; repeated rows count as further
vectors; ties play no part, as all links are kept; an empty table gives no rows; a null id never names a component; further columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, hashed_low, runs
from .components import components

SAMPLE, QUERIES, TARGET = 16_384, 512, 0.995
PER_CELL, MOST_WORDS, ROUNDS = 8, 1024, 10
#: Visits of a vector: at least, and the most that the calibration tries first.
LEAST_VISITS, FIRST_VISITS = 4, 256
#: Strata with links that a calibration needs, the queries it may draw for them, and the share of strata that may lie below the target.
ENOUGH, MOST_QUERIES, LOW = 100, 4096, 0.05
CROWD = 8
#: Hosts of a block and, about, guests of a party.
BLOCK, PARTY = 1024, 4096


def unit(rows: list[bytes] | pa.Array, kind: str) -> np.ndarray:
    """(rows, width) unit vectors in double precision of packed ones."""
    values = np.frombuffer(b"".join(r if isinstance(r, bytes) else r.as_buffer() for r in rows), dtype=kind).reshape(len(rows), -1).astype(np.float64)
    largest = np.abs(values).max(axis=1, keepdims=True)
    values /= largest
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * (x @ words.T) + (words * words).sum(axis=1), 0)


def codebook(x: np.ndarray, size: int, seed: int) -> np.ndarray:
    """k-means; a codeword that loses its points stays where it is."""
    rng = np.random.default_rng(seed)
    words = x[np.sort(rng.choice(len(x), min(size, len(x)), replace=False))].copy()
    for _ in range(ROUNDS):
        near = distances(x, words).argmin(axis=1)
        counts = np.bincount(near, minlength=len(words))
        sums = np.zeros_like(words)
        np.add.at(sums, near, x)
        words[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return words


class Grid:
    """The two codebooks and the order in which a vector visits cells."""

    def __init__(self, sample: np.ndarray, size: int) -> None:
        half = sample.shape[1] // 2
        self.half, self.words = half, (codebook(sample[:, :half], size, 1), codebook(sample[:, half:], size, 2))
        self.cells = len(self.words[0]) * len(self.words[1])

    def visits(self, x: np.ndarray, count: int) -> np.ndarray:
        """(rows, count) cells by distance, nearest first; -1 where the grid has fewer.

        Of the n nearest cells, the one at the i-th and j-th codeword of the halves has (i + 1)(j + 1) <= n."""
        left, right = distances(x[:, : self.half], self.words[0]), distances(x[:, self.half :], self.words[1])
        first, second = (np.argsort(d, axis=1, kind="stable")[:, :count] for d in (left, right))
        left, right = np.take_along_axis(left, first, 1), np.take_along_axis(right, second, 1)
        i, j = np.meshgrid(np.arange(left.shape[1]), np.arange(right.shape[1]), indexing="ij")
        i, j = i[(i + 1) * (j + 1) <= count], j[(i + 1) * (j + 1) <= count]
        out = np.full((len(x), count), -1, dtype=np.int64)
        many = max(1, (1 << 22) // len(i))
        for a in range(0, len(x), many):
            rows = slice(a, a + many)
            total = left[rows][:, i] + right[rows][:, j]
            order = np.argsort(total, axis=1, kind="stable")[:, :count]
            cells = first[rows][:, i] * len(self.words[1]) + second[rows][:, j]
            out[rows, : order.shape[1]] = np.take_along_axis(cells, order, 1)
        return out


def _thinned(x: np.ndarray, least: float) -> np.ndarray:
    """The vectors that fewer than CROWD earlier ones are near."""
    keep = np.ones(len(x), bool)
    for a in range(0, len(x), 512):
        near = x[a : a + 512] @ x[: a + 512].T >= least
        keep[a : a + 512] = np.tril(near, a - 1).sum(axis=1) < CROWD
    return x[keep]


def _strata(x: np.ndarray, least: float) -> np.ndarray:
    """For each vector the number of its stratum: that of the first earlier vector near it, or a new one."""
    lead = np.arange(len(x))
    for i in range(1, len(x)):
        near = x[:i] @ x[i] >= least
        if near.any():
            lead[i] = lead[near.argmax()]
    return lead


def _ladder(count: int) -> np.ndarray:
    """The numbers of visits that are told apart, up to ``count``: four to a doubling."""
    steps = np.unique(np.round(2.0 ** (np.arange(0, 4 * np.log2(max(count, 1)) + 4) / 4)).astype(np.int64))
    return np.unique(np.append(steps[steps < count], count))


def _met(classes: DataFrame, grid: Grid, queries: np.ndarray, kind: str, least: float, count: int) -> np.ndarray:
    """(queries, steps of the ladder + 1) links by the step that meets them, by brute force against all vectors; the last are not met."""
    steps, order = _ladder(count), grid.visits(queries, count)
    query, rank = np.nonzero(order >= 0)
    keys = query * grid.cells + order[query, rank]
    sort = np.argsort(keys)
    keys, step = keys[sort], np.searchsorted(steps, rank[sort] + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros((len(queries), len(steps) + 1), np.int64)
        for batch in batches:
            x = unit(batch.column("vector"), kind)
            for a in range(0, len(x), 1024):
                part = x[a : a + 1024]
                row, query = np.nonzero((cos := part @ queries.T) >= least)
                apart = cos[row, query] < 1 - 1e-12  # not the query itself
                row, query = row[apart], query[apart]
                if len(row):
                    wanted = query * grid.cells + grid.visits(part, 1)[row, 0]
                    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                    np.add.at(met, (query, np.where(keys[at] == wanted, step[at], len(steps))), 1)
        query, at = np.nonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(at, pa.int64()), pa.array(met[query, at], pa.int64())], names=["query", "step", "n"])

    met = np.zeros((len(queries), len(steps) + 1), np.int64)
    for r in classes.select("vector").mapInArrow(run, "query long, step long, n long").groupBy("query", "step").agg(F.sum("n").alias("n")).collect():  # a few dozen rows a query at most
        met[r["query"], r["step"]] = r["n"]
    return met


def _made(grid: Grid, sample: np.ndarray, least: float, count: int, pairs: int) -> np.ndarray:
    """As ``_met``, of pairs made from the sample: a vector, and one at a cosine between the least and 1 in the direction of another."""
    rng = np.random.default_rng(5)
    x, other = sample[rng.integers(0, len(sample), pairs)], sample[rng.integers(0, len(sample), pairs)]
    across = other + rng.normal(scale=1e-3, size=x.shape)
    across -= (across * x).sum(axis=1, keepdims=True) * x
    across /= np.linalg.norm(across, axis=1, keepdims=True)
    cos = np.linspace(least, 1, pairs, endpoint=False)[:, None]
    steps, hit = _ladder(count), grid.visits(x, count) == grid.visits(cos * x + np.sqrt(1 - cos * cos) * across, 1)
    met = np.zeros((pairs, len(steps) + 1), np.int64)
    met[np.arange(pairs), np.where(hit.any(axis=1), np.searchsorted(steps, hit.argmax(axis=1) + 1), len(steps))] = 1
    return met


def _enough(met: np.ndarray, strata: np.ndarray) -> int | None:
    """The first step at which the strata reach TARGET, each by its queries' mean share of links met; None if none does."""
    share = np.cumsum(met, axis=1)[:, :-1] / met.sum(axis=1, keepdims=True)
    _, place = np.unique(strata, return_inverse=True)
    means = np.zeros((place.max() + 1, share.shape[1]))
    np.add.at(means, place, share)
    means /= np.bincount(place)[:, None]
    good = (means.mean(axis=0) >= TARGET) & (np.quantile(means, LOW, axis=0, method="lower") >= TARGET)
    return int(good.argmax()) if good.any() else None


def _calibrated(classes: DataFrame, grid: Grid, sample: np.ndarray, kind: str, least: float) -> int:
    """Visits that meet TARGET of the links in the strata of the queries."""
    count = min(FIRST_VISITS, grid.cells)
    drawn, met = 0, np.zeros((0, len(_ladder(count)) + 1), np.int64)
    while drawn < min(len(sample), MOST_QUERIES):
        more = max(QUERIES, drawn)
        met = np.concatenate((met, _met(classes, grid, sample[drawn : drawn + more], kind, least, count)))
        drawn = min(drawn + more, len(sample))
        linked = np.flatnonzero(met.sum(axis=1))
        strata = _strata(sample[linked], least)
        if len(np.unique(strata)) >= ENOUGH:
            break
    lacking = max(ENOUGH - len(np.unique(strata)), 0)
    met = met[linked]
    while True:
        whole, groups = met, strata
        if lacking:
            whole = np.concatenate((met, _made(grid, sample, least, count, lacking)))
            groups = np.concatenate((strata, len(sample) + np.arange(lacking)))
        step = _enough(whole, groups)
        if step is not None:
            return min(max(int(_ladder(count)[step]), LEAST_VISITS), grid.cells)
        if count >= grid.cells:
            return grid.cells
        count = min(2 * count, grid.cells)
        if len(linked):
            met = _met(classes, grid, sample[linked], kind, least, count)


def _roots(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that links reach, of each index below count."""
    root = np.arange(count)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _meet(kind: str, least: float):
    """Of each block of a cell: (class, links of it found here, least class it reaches here)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in runs(batches, ("cell", "block", "guests")):
            ids, own, sizes, cells, member = (table.column(c).to_numpy() for c in ("class_id", "own", "size", "cell", "member"))
            x, plans = unit(table.column("vector").to_pylist(), kind), table.column("plan")
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for start, end in zip(bounds[:-1], bounds[1:], strict=True):
                hosts, guests = start + np.flatnonzero(member[start:end] != 1), start + np.flatnonzero(member[start:end] != 2)
                if len(hosts) == 0 or len(guests) == 0 or end - start < 2:
                    continue
                for a in range(0, len(guests), 1024):
                    part = guests[a : a + 1024]
                    g, h = np.nonzero(x[part] @ x[hosts].T >= least)
                    g, h = part[g], hosts[h]
                    g, h = g[ids[g] != ids[h]], h[ids[g] != ids[h]]
                    if len(g) == 0:
                        continue
                    there, hosting = np.unique(own[g]), np.unique(h)
                    meets = np.array([np.isin(there, plans[int(host)].values.to_numpy()) for host in hosting])
                    both = meets[np.searchsorted(hosting, h), np.searchsorted(there, own[g])]  # the host will meet the guest in the guest's own cell
                    seen, place = np.unique(np.concatenate((g, h)), return_inverse=True)
                    found = np.bincount(place[: len(g)], weights=sizes[h], minlength=len(seen)) + np.bincount(place[len(g) :], weights=np.where(both, 0, sizes[g]), minlength=len(seen))
                    root = _roots(len(seen), place[: len(g)], place[len(g) :])
                    out.append((ids[seen], found.astype(np.int64), ids[seen[root]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], names=["class_id", "found", "root"])

    return run


def _sound(column: str) -> Column:
    """Whether a vector can link: not null, no component null or non-finite, not all of them zero."""
    return F.coalesce(F.expr(f"forall(`{column}`, v -> v is not null and not isnan(v) and abs(v) < double('infinity')) and exists(`{column}`, v -> v <> 0)"), F.lit(False))


def _classes(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame, str]:
    """Rows with the class of their vector (null if it links with nothing), the classes with packed vectors, and the numbers' kind."""
    kind = "<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "<f8"
    whole = vectors.select(F.col(f"`{id_col}`"), F.col(f"`{vector_col}`").cast("array<float>" if kind == "<f4" else "array<double>").alias("vector"))
    whole = whole.withColumn("vector", F.when(_sound("vector"), F.col("vector")))
    widths = whole.where("vector is not null").groupBy(F.size("vector").alias("n")).count()
    widest = widths.orderBy(F.desc("count"), F.desc("n")).first()
    width = widest["n"] if widest else 0
    rows = whole.withColumn("vector", F.when(F.size("vector") == width, F.col("vector")))
    if width == 1:  # halves need two numbers; a zero changes no cosine
        rows = rows.withColumn("vector", F.expr(f"array_append(vector, cast(0 as {'float' if kind == '<f4' else 'double'}))"))
    classes = rows.where("vector is not null").groupBy("vector").agg(F.count("*").alias("size"), F.min(id_col).alias("least_id"))
    classes = classes.select(F.xxhash64("vector").alias("class_id"), "size", "least_id", "vector")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column("class_id"), batch.column("size"), batch.column("least_id"), pa.array([v.tobytes() for v in values], pa.binary())], names=["class_id", "size", "least_id", "vector"])

    id_type = dict(classes.dtypes)["least_id"]
    packed = classes.mapInArrow(pack, f"class_id long, size long, least_id {id_type}, vector binary")
    rows = rows.select(id_col, F.when(F.col("vector").isNotNull(), F.xxhash64("vector")).alias("class_id"))
    return rows, checkpoint(packed), kind


def link(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9) -> DataFrame:
    """Of every row id, n_links, component_id and kept (the id names its component); further columns are not kept.

    Vectors of one length link with each other; each length has an index of its own."""
    lengths = [r["n"] for r in vectors.where(_sound(vector_col)).groupBy(F.size(f"`{vector_col}`").alias("n")).count().orderBy("n").collect()]  # a row for each length
    if len(lengths) < 2:
        return _linked(vectors, id_col, vector_col, least)
    length = F.when(_sound(vector_col), F.size(f"`{vector_col}`"))
    out = _linked(vectors.where(length.isNull()), id_col, vector_col, least)
    for n in lengths:
        out = out.unionByName(_linked(vectors.where(length == n), id_col, vector_col, least))
    return out


def _linked(vectors: DataFrame, id_col: str, vector_col: str, least: float) -> DataFrame:
    """The same for vectors of one length."""
    rows, classes, kind = _classes(vectors, id_col, vector_col)
    count = classes.count()
    if count < 2:
        found = classes.select("class_id", F.lit(0).cast("long").alias("found"), F.col("class_id").alias("root"))
    else:
        chosen = [r["vector"] for r in classes.where(hashed_low(["class_id"], 7, 4.0 * SAMPLE / count)).orderBy(F.xxhash64("class_id", F.lit(7)), "class_id").limit(SAMPLE).select("vector").collect()]  # SAMPLE rows at most
        sample = unit([bytes(v) for v in chosen], kind)
        size = int(np.clip(round((count / PER_CELL) ** 0.5), 1, MOST_WORDS))
        grid = Grid(_thinned(sample, least), size)
        visits = _calibrated(classes, grid, sample, kind, least)
        calls = _visits(classes, grid, kind, visits).join(F.broadcast(_loads(classes, grid, kind, visits)), "cell")  # a row at most for each cell of the grid
        own_block = F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int")
        calls = calls.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        hosted = (F.col("cell") == F.col("own")) & (F.col("block") == own_block)
        # In a cut cell, hosts (2) go to every party of guests (1) of their block; elsewhere a row at home is both (0).
        cut = (F.col("blocks") > 1) | (F.col("parties") > 1)
        party = F.pmod(F.xxhash64("class_id", F.lit(3)), F.col("parties")).cast("int")
        guests = calls.withColumn("guests", party).withColumn("member", F.when(hosted & ~cut, 0).otherwise(1))
        hosts = calls.where(hosted & cut).withColumn("guests", F.explode(F.sequence(F.lit(0), F.col("parties") - 1))).withColumn("member", F.lit(2))
        columns = ["cell", "block", "guests", "member", "class_id", "size", "own", "vector", "plan"]
        met = guests.select(*columns).unionAll(hosts.select(*columns)).withColumn("plan", F.when(F.col("member") != 1, F.col("plan")))
        met = met.repartition("cell", "block", "guests").sortWithinPartitions("cell", "block", "guests")
        found = checkpoint(met.mapInArrow(_meet(kind, least), "class_id long, found long, root long"))
    totals = found.groupBy("class_id").agg(F.sum("found").alias("found"))
    merged = components(found, "class_id", "root").withColumnRenamed("node", "class_id")
    named = classes.select("class_id", "size", "least_id").join(totals, "class_id", "left").join(merged, "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    lowest = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = named.join(lowest, "component").select("class_id", "component_id", (F.col("size") - 1 + F.coalesce("found", F.lit(0))).alias("n_links"))
    out = rows.join(named, "class_id", "left").select(id_col, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", id_col).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def _loads(classes: DataFrame, grid: Grid, kind: str, count: int) -> DataFrame:
    """Of the cells that are home to a vector: blocks of hosts and parties of guests. Nothing is met in other cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            many = max(1, (1 << 18) // count)
            for a in range(0, whole.num_rows, many):
                plan = grid.visits(unit(whole.slice(a, many).column("vector"), kind), count)
                cells, calls = np.unique(plan[plan >= 0], return_counts=True)
                hosts = np.zeros(len(cells), np.int64)
                np.add.at(hosts, np.searchsorted(cells, plan[:, 0]), 1)
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(hosts), pa.array(calls.astype(np.int64))], names=["cell", "hosts", "calls"])

    loads = classes.select("vector").mapInArrow(run, "cell long, hosts long, calls long").groupBy("cell").agg(F.sum("hosts").alias("hosts"), F.sum("calls").alias("calls")).where("hosts > 0")
    return loads.select("cell", F.ceil(F.col("hosts") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("calls") / PARTY).cast("int").alias("parties"))


def _visits(classes: DataFrame, grid: Grid, kind: str, count: int) -> DataFrame:
    """A row for each visit; all the visits planned go along as ``plan``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            many = max(1, (1 << 18) // count)
            for a in range(0, whole.num_rows, many):
                batch = whole.slice(a, many)
                plan = grid.visits(unit(batch.column("vector"), kind), count)
                row, at = np.nonzero(plan >= 0)
                ends = np.concatenate(([0], np.cumsum((plan >= 0).sum(axis=1)))).astype(np.int32)
                plans = pa.ListArray.from_arrays(pa.array(ends), pa.array(plan[plan >= 0]))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(plan[row, at]), pa.array(plan[row, 0]), *(batch.column(c).take(take) for c in ("class_id", "size", "vector")), plans.take(take)],
                    names=["cell", "own", "class_id", "size", "vector", "plan"],
                )

    return classes.select("class_id", "size", "vector").mapInArrow(run, "cell long, own long, class_id long, size long, vector binary, plan array<long>")


def recall(vectors: DataFrame, linked: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, every: int = 100) -> float:
    """The share of true links met, of the ids that ``every`` divides, by brute force in blocks against all rows."""
    rows, classes, kind = _classes(vectors, id_col, vector_col)
    asked = rows.where(F.col(id_col) % every == 0).join(classes.select("class_id", "vector"), "class_id").select("vector").distinct()
    queries = [bytes(r["vector"]) for r in asked.collect()]
    if not queries:
        return 1.0
    x = unit(queries, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, row = np.nonzero(x @ unit(batch.column("vector"), kind).T >= least)
            yield pa.RecordBatch.from_arrays([pa.array([queries[i] for i in q], pa.binary()), pa.array(batch.column("size").to_numpy()[row])], names=["vector", "size"])

    true = classes.mapInArrow(run, "vector binary, size long").groupBy("vector").agg((F.sum("size") - 1).alias("true"))
    both = rows.where(F.col(id_col) % every == 0).join(classes.select("class_id", "vector"), "class_id").join(true, "vector").join(linked.select(id_col, "n_links"), id_col)
    total = both.agg(F.sum("true").alias("t"), F.sum("n_links").alias("f")).first()
    return 1.0 if not total["t"] else total["f"] / total["t"]

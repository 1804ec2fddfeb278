"""Ranked lexical search on an index that is stratified by document length.

Documents with the same length normaliser m are a stratum. Within it a term's postings lie by falling frequency tf, so one
impact is computed for each (term, m, tf), not for each posting. What the largest tf of each term can give bounds the score
of a whole stratum; a query visits the strata in order of that bound and ends where it falls below the score of the k-th hit.

The index is a table of blocks: a stratum, or, if it is large, parts of it (BLOCK rows at most), so a
length that a third of all documents share is spread over many tasks. Rows are dealt by ranges of (m, row), without an exchange
by any key. A search first visits, for each query, the PROBES blocks of greatest bound; the k-th score there is a threshold that no task
has to look below. Every block whose bound reaches it is visited then.

Scores are whole numbers: the weight of a term is floor(1000 * ln((2N + 2) / (2 df + 1))), the normaliser m is
100 - 25 + (25 n N) div L, and a term that occurs tf times gives weight * ((1000000000 tf) div (1000 tf + 12 m)).

Defined results: a null text has no terms and is no document of N; queries without terms have no hits; a term that a query
repeats counts as often; equal scores go by ascending id, null ids last, rows that repeat an id each for itself; very long texts are counted
whole; an empty table gives no hits; further columns are left out, whatever their names; ids are whole numbers.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, remove, shared_folder, slices

#: Hits of a query, rows of a block, blocks that a query probes for its threshold.
TOP, BLOCK, PROBES = 20, 4096, 8
#: Queries times terms (8 bytes each) that the tasks hold at once; more queries are answered in turn, each time from all documents.
CELLS = 8_000_000
# Letters and digits of ASCII and all other characters are terms; only A-Z are lower-cased.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
NO_ID = np.iinfo(np.int64).max


def terms(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def weight(df: np.ndarray, documents: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)


def impact(tf: np.ndarray, m) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


@dataclass(frozen=True)
class Queries:
    """Queries as a sparse matrix: query k holds the terms ``term[cut[k]:cut[k + 1]]``, each ``times`` times; ``terms`` are numbered in order."""

    items: list
    terms: list[bytes]
    cut: np.ndarray
    term: np.ndarray
    times: np.ndarray

    @staticmethod
    def of(rows: list[tuple[object, str | None]]) -> Queries:
        found = [Counter(terms((text or "").encode())) for _, text in rows]
        vocabulary = sorted(set().union(*found))
        number = {t: i for i, t in enumerate(vocabulary)}
        cut = np.concatenate([[0], np.cumsum([len(f) for f in found], dtype=np.int64)])
        term = np.array([number[t] for f in found for t in f], np.int64)
        times = np.array([n for f in found for n in f.values()], np.int64)
        return Queries([item for item, _ in rows], vocabulary, cut, term, times)

    @staticmethod
    def in_turn(rows: Iterator[tuple[object, str | None]], cells: int = 0) -> Iterator[Queries]:
        """The queries, so many at once that a table of them and their terms has ``cells`` cells (one query at least)."""
        held, vocabulary = [], set()
        for row in rows:
            more = vocabulary | set(terms((row[1] or "").encode()))
            if held and (len(held) + 1) * len(more) > (cells or CELLS):
                yield Queries.of(held)
                held, more = [], set(terms((row[1] or "").encode()))
            held.append(row)
            vocabulary = more
        if held:
            yield Queries.of(held)


@dataclass(frozen=True)
class Weighted:
    """What the tasks get: the queries' terms with their weights, as a list for each query (``cut``, ``term``, ``weight``) and as a table (term, query)."""

    cut: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    table: np.ndarray

    @staticmethod
    def of(queries: Queries, weights: np.ndarray) -> Weighted:
        """Each query's terms in order, with ``times`` times the term's weight."""
        query = np.repeat(np.arange(len(queries.items)), np.diff(queries.cut))
        order = np.lexsort((queries.term, query))
        term, own = queries.term[order], (queries.times * weights[queries.term])[order]
        table = np.zeros((len(queries.terms), len(queries.items)))
        table[term, query] = own
        return Weighted(queries.cut, term, own, table)


def counted(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, term, tf) of each text: number of all its terms, and the terms of the vocabulary that it holds, with their frequencies. One narrow stage."""
    number = {t: i for i, t in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sizes, held = [], []
            for text in batch.column("text").cast(pa.large_binary()).fill_null(b"").to_pylist():
                words = terms(text)
                own = Counter(words)
                sizes.append(len(words))
                held.append([(number[t], own[t]) for t in number.keys() & own.keys()])
            cut = np.concatenate([[0], np.cumsum([len(h) for h in held])]).astype(np.int32)
            both = np.array([x for h in held for x in h], np.int32).reshape(-1, 2)
            lists = [pa.ListArray.from_arrays(cut, pa.array(np.ascontiguousarray(both[:, i]))) for i in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "term", "tf"])

    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n long, term array<int>, tf array<int>")


BLOCKS = "block long, m long, docs array<long>, term array<int>, tf array<int>, upto array<int>, places array<short>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows that come sorted by m: the ids, and for each term, by falling tf, the places of the documents in ``places`` up to ``upto``."""
    from pyspark import TaskContext

    first, made = TaskContext.get().partitionId() << 32, 0
    held: list[pa.RecordBatch] = []

    def block(rows: pa.Table) -> pa.RecordBatch:
        nonlocal made
        cut = [c.to_pylist() for c in (rows.column("term"), rows.column("tf"))]
        place = np.repeat(np.arange(rows.num_rows), [len(t) for t in cut[0]])
        term, tf = (np.array([x for row in c for x in row], np.int64) for c in cut)
        order = np.lexsort((place, -tf, term))
        place, term, tf = place[order], term[order], tf[order]
        last = np.flatnonzero(np.append((term[1:] != term[:-1]) | (tf[1:] != tf[:-1]), True)[: len(term)])
        out = [[first + made], [rows.column("m")[0].as_py()], [rows.column("doc_id").to_pylist()], [term[last]], [tf[last]], [last + 1], [place]]
        made += 1
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 3, pa.list_(pa.int16())]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=[c.split()[0] for c in BLOCKS.split(", ")])

    def whole(rows: pa.Table, ended: bool) -> Iterator[pa.Table]:
        """Blocks of the rows; the last ones are held back until it is known whether their stratum goes on."""
        m = rows.column("m").to_numpy()
        cuts = [0, *(np.flatnonzero(m[1:] != m[:-1]) + 1).tolist(), len(m)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            for c in range(a, b, BLOCK):
                if b == len(m) and not ended and b - c < BLOCK:
                    held[:] = rows.slice(c, b - c).to_batches()
                else:
                    yield rows.slice(c, min(BLOCK, b - c))

    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([*held, batch])
            held.clear()
            yield from map(block, whole(rows, False))
    if held:
        yield from map(block, whole(pa.Table.from_batches(held), True))


def index(rows: DataFrame, documents: int, length: int) -> DataFrame:
    """The blocks of counted rows (with a number in ``row``), given the number of documents with a term and of all terms."""
    m = F.expr(f"75 + (25 * n * {documents}L) div {length}L").alias("m")
    dealt = rows.where("n > 0").select("doc_id", m, "term", "tf", "row")
    return dealt.repartitionByRange("m", "row").sortWithinPartitions("m", "row").drop("row").mapInArrow(_blocks, BLOCKS)


class _Block:
    """A block as arrays: its terms, the first posting of each, and for every posting the place of its document and its impact."""

    def __init__(self, batch: pa.RecordBatch, at: int) -> None:
        of = lambda name: batch.column(name)[at].values
        self.number, m = batch.column("block")[at].as_py(), batch.column("m")[at].as_py()
        self.docs = of("docs").fill_null(NO_ID).to_numpy(zero_copy_only=False)
        term, upto = of("term").to_numpy(), of("upto").to_numpy().astype(np.int64)
        begins = np.flatnonzero(np.append(True, term[1:] != term[:-1])[: len(term)])
        once = impact(of("tf").to_numpy().astype(np.int64), m)  # one for each tf of a term
        self.terms, self.most = term[begins], once[begins]
        self.starts = np.append(np.append(0, upto)[begins], upto[-1:])
        self.places, self.impacts = of("places").to_numpy().astype(np.int64), np.repeat(once, np.diff(upto, prepend=0))

    def bounds(self, queries: Weighted) -> np.ndarray:
        """What a document of the block can score at most, for each query: every term at its largest tf."""
        return self.most.astype(float) @ queries.table[self.terms] * (1 + 1e-9)

    def scores(self, queries: Weighted, query: int) -> np.ndarray:
        own = slice(queries.cut[query], queries.cut[query + 1])
        term, weight = queries.term[own], queries.weight[own]
        at = np.searchsorted(self.terms, term)
        held = at < len(self.terms)
        held[held] = self.terms[at[held]] == term[held]
        first, size = self.starts[at[held]], self.starts[at[held] + 1] - self.starts[at[held]]
        posting = np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
        out = np.zeros(len(self.docs), np.int64)
        np.add.at(out, self.places[posting], np.repeat(weight[held], size) * self.impacts[posting])
        return out


def _best(scores: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best hits above 0 of one query, ties by ascending id."""
    hit = np.flatnonzero(scores > 0)
    if len(hit) > k:
        hit = hit[scores[hit] >= np.partition(scores[hit], len(hit) - k)[len(hit) - k]]
    hit = hit[np.lexsort((docs[hit], -scores[hit]))[:k]]
    return scores[hit], docs[hit]


def _probing(shared, most: int):
    """Of a task's blocks: (query, block, bound) of the greatest bounds of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        number = np.zeros((0, len(queries.cut) - 1), np.int64)
        bound = np.zeros(number.shape)
        for batch in batches:
            blocks = [_Block(batch, i) for i in range(batch.num_rows)]
            if blocks:
                number = np.concatenate([number, np.repeat([[b.number] for b in blocks], number.shape[1], axis=1)])
                bound = np.concatenate([bound, [b.bounds(queries) for b in blocks]])
                order = np.argsort(-bound, axis=0, kind="stable")[:most]
                number, bound = np.take_along_axis(number, order, axis=0), np.take_along_axis(bound, order, axis=0)
        query = np.tile(np.arange(number.shape[1]), len(number))
        some = bound.ravel() > 0
        yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in (query, number.ravel(), bound.ravel())], names=["query", "block", "bound"])

    return run


def _visiting(shared, k: int, floor: np.ndarray):
    """Of a task's blocks: (query, doc_id, score) of the k best hits of each query, or of those in the column ``asked`` of a block.

    Blocks are visited in order of their bounds; one whose bound is below the query's ``floor``, or its k-th score so far, is not visited."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, least = shared.value, floor.copy()
        none = np.zeros(0, np.int64)
        best = [(none, none) for _ in range(len(least))]
        for batch in batches:
            asked = "asked" in batch.schema.names
            blocks = [_Block(batch, i) for i in range(batch.num_rows)]
            bounds = [b.bounds(queries) for b in blocks]
            for at in sorted(range(len(blocks)), key=lambda i: -bounds[i].max()):
                among = np.unique(batch.column("asked")[at].values.to_numpy()) if asked else np.arange(len(least))
                for q in among[(bounds[at][among] >= least[among]) & (bounds[at][among] > 0)].tolist():
                    s, d = (np.concatenate(x) for x in zip(best[q], _best(blocks[at].scores(queries, q), blocks[at].docs, k), strict=True))
                    order = np.lexsort((d, -s))[:k]
                    best[q] = s[order], d[order]
                    if len(order) == k:
                        least[q] = max(least[q], best[q][0][-1])
        query = np.repeat(np.arange(len(best)), [len(s) for s, _ in best])
        score, doc = (np.concatenate([b[i] for b in best]) if best else none for i in range(2))
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(doc, mask=doc == NO_ID), pa.array(score)], names=["query", "doc_id", "score"])

    return run


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def visit(blocks: DataFrame, queries: Weighted, k: int = TOP, probes: int = PROBES) -> DataFrame:
    """(query, doc_id, score, rank) of the k best hits of every query in the blocks of an index."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast(queries)
    hits = "query long, doc_id long, score long"
    first = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
    chosen = blocks.mapInArrow(_probing(shared, probes), "query long, block long, bound double").withColumn("at", F.row_number().over(first)).where(F.col("at") <= probes)
    asked = F.broadcast(chosen.groupBy("block").agg(F.collect_list("query").alias("asked")))  # ``probes`` entries a query at most
    floor = np.zeros(len(queries.cut) - 1, np.int64)
    probed = _ranked(blocks.join(asked, "block").mapInArrow(_visiting(shared, k, floor), hits), k)
    for row in probed.where(F.col("rank") == k).select("query", "score").collect():  # a row for each query
        floor[row["query"]] = row["score"]
    return _ranked(blocks.mapInArrow(_visiting(shared, k, floor), hits), k)


def _answered(spark: SparkSession, queries: Queries, docs: DataFrame, k: int, id_col: str, text_col: str, root: str) -> DataFrame:
    counted(docs, queries.terms, id_col, text_col).withColumn("row", F.monotonically_increasing_id()).write.parquet(f"{root}/counted")
    rows = spark.read.parquet(f"{root}/counted")
    documents, length = rows.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
    df = np.zeros(len(queries.terms), np.int64)
    for term, n in rows.select(F.explode("term").alias("t")).groupBy("t").count().collect():  # the queries' terms at most
        df[term] = n
    index(rows, documents, length).write.parquet(f"{root}/blocks")
    return checkpoint(visit(spark.read.parquet(f"{root}/blocks"), Weighted.of(queries, weight(df, documents)), k))  # k rows a query at most


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents of every item.

    The index holds every document, with the postings of the terms that the items ask for. Each item is a query of its own, also where items repeat an id."""
    spark = docs.sparkSession
    asked = items.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{query_col}`").cast("string").alias("query"))
    out = spark.createDataFrame([], T.StructType([asked.schema["item_id"], *T.StructType.fromDDL("rank int, doc_id long, score long")]))
    for queries in Queries.in_turn(((r[0], r[1]) for r in asked.toLocalIterator())):
        root = f"{shared_folder(spark)}/search-{uuid.uuid4().hex}"
        found = _answered(spark, queries, docs, k, id_col, text_col, root)
        remove(spark, root)
        named = spark.createDataFrame(list(enumerate(queries.items)), T.StructType([T.StructField("query", T.LongType()), asked.schema["item_id"]]))
        out = out.unionAll(found.join(F.broadcast(named), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return out

"""Helpers that the training-data operators share: checkpoints, Arrow batches, column checks."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint, shared_folder

__all__ = ["SLICE_BYTES", "checkpoint", "crc32_of_id", "held_out", "hashed_low", "let_go", "map_texts", "packed", "remove", "runs", "shared_folder", "slices", "stored", "utf8", "with_fields", "without"]

#: Text bytes that a task works on at once; an Arrow batch of long texts is cut into slices of about this size.
SLICE_BYTES = 8 << 20


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of our own, wherever it lies, when what it holds is used up."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a compressed copy of columns in the shared folder: less disk than a checkpoint, and what reads a few columns reads no more."""
    folder = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.parquet(folder)


def let_go(spark: SparkSession) -> None:
    """Have the shuffle files of what is used up removed now: Spark's cleaner does so when the driver collects its garbage, which by itself may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def crc32_of_id(id_col: str):
    """crc32 of the id written as text; it decides which rows may teach a model."""
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def held_out(id_col: str):
    """True for the third of the ids that no model learns from; a null id is never held out."""
    return F.coalesce(crc32_of_id(id_col) % 3 == 1, F.lit(False))


def hashed_low(keys: list[str], seed: int, share):
    """True for about ``share`` (a number or a column, up to 1) of the keys: those whose hash lies lowest."""
    place = F.xxhash64(*keys, F.lit(seed)).cast("double") / 2.0**64 + 0.5
    return place < share


def without(df: DataFrame, *names: str) -> DataFrame:
    """The frame less the columns that an operator is about to add, however they are cased."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def with_fields(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    return T.StructType([*schema.fields, *fields])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, end to end, and the n + 1 offsets of its rows; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def packed(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column of the slices of ``values`` that ``offsets`` (in items) bound."""
    values = np.ascontiguousarray(values)
    ends = offsets.astype(np.int64) * values.dtype.itemsize
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(values.tobytes())])
    return column.cast(pa.binary())


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of each hold about ``limit`` bytes (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part, start = np.cumsum(sizes, dtype=np.int64) // limit, 0
        for end in [*(np.flatnonzero(np.diff(part)) + 1), len(sizes)]:
            if end > start:
                yield batch.slice(start, end - start)
            start = end


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Of rows that are sorted by ``keys``: tables of whole runs of equal keys, and the runs' bounds."""
    held: list[pa.RecordBatch] = []
    ended = False
    while not ended:
        batch = next(batches, None)
        ended = batch is None
        if not ended:
            held.append(batch)
        if sum(b.num_rows for b in held) == 0:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        columns = [table.column(c).to_numpy() for c in keys]
        bounds = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1).tolist(), table.num_rows]
        if not ended:  # the last run may go on in the next batch
            bounds.pop()
        held = table.slice(bounds[-1]).to_batches()
        if len(bounds) > 1:
            yield table.slice(0, bounds[-1]), bounds


def map_texts(
    df: DataFrame, text_col: str, keep: list[str], added: list[T.StructField], work: Callable[[pa.Array], list[pa.Array]], limit: int = SLICE_BYTES, after: Callable[[], None] | None = None
) -> DataFrame:
    """``keep`` and the columns ``added``, which ``work`` makes from a slice of the text column; ``after`` is called when a task ends.

    A kept column whose name an added one takes is left out."""
    names = {f.name.lower() for f in added}
    keep = [k for k in keep if k.lower() not in names]
    source = df.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{text_col}`").cast("string").alias("__text"))
    schema = T.StructType([*[source.schema[k] for k in keep], *added])
    out = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for part in slices(batches, "__text", limit):
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keep], *work(part.column("__text"))], names=out)
        finally:
            if after is not None:
                after()

    return source.mapInArrow(run, schema)

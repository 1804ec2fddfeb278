"""Scans in an order that crosses tasks.

Rows are dealt by ranges of (keys, order), so a key with a third of all rows is spread over many tasks. The copy is
checkpointed with the partition that each row is in; a first pass tells of each partition, in one small row, what its rows do to the state of its last key; the driver adds these
up partition by partition, and a second pass scans every partition from the state that the ones before it leave."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint

#: Rows that a task of a scan sorts at once, if not told otherwise: the tasks grow in number, not in size.
ROWS = 250_000
#: The partition that a row was dealt to. A task's own number tells it no more where the scan is one side of a union.
PART = "__part"


class Rule(Protocol):
    """What a scan does. Rows are tuples of the scan's input columns, in order; a state is any value that can be pickled."""

    def start(self) -> Any:
        """The state before a key's first row."""

    def effect(self, effect: Any, rows: list[tuple]) -> Any:
        """What an effect (None: of no rows) and then these rows do to a state that is not known yet."""

    def after(self, state: Any, effect: Any) -> Any:
        """The state after an effect."""

    def run(self, state: Any, rows: list[tuple]) -> tuple[Any, list[tuple | None]]:
        """The state after the rows of one key, and for each row its output (None: no row)."""


def _batches(batches: Iterator[pa.RecordBatch], keys: list[str], inputs: list[str]) -> Iterator[tuple[pa.RecordBatch, list[tuple], list[int], tuple, tuple]]:
    """Batches with the rule's rows as tuples, the bounds of runs of equal keys, and the first and the last key."""
    for batch in batches:
        if batch.num_rows:
            coded = [batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for k in keys]
            changes = np.flatnonzero(np.any([c[1:] != c[:-1] for c in coded], axis=0)) + 1
            rows = list(zip(*[batch.column(c).to_pylist() for c in inputs], strict=True))
            first, last = (tuple(batch.column(k)[at].as_py() for k in keys) for at in (0, batch.num_rows - 1))
            yield batch, rows, [0, *changes.tolist(), len(rows)], first, last


def _summary(rule: Rule, keys: list[str], inputs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = effect = part = None
        single = True
        for batch, rows, cuts, here, there in _batches(batches, keys, inputs):
            if first is None:
                first, part = here, batch.column(PART)[0].as_py()
            elif here != last:
                effect, single = None, False
            if len(cuts) > 2:
                effect, single = None, False
            effect, last = rule.effect(effect, rows[cuts[-2] :]), there
        if first is not None:
            out = [part, pickle.dumps(first), pickle.dumps(last), single, pickle.dumps(effect)]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in out], names=["part", "first", "last", "single", "effect"])

    return run


def _scan(rule: Rule, keys: list[str], inputs: list[str], kept: int, carried: dict[int, bytes], names: list[str], kinds: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = last = None
        for batch, rows, cuts, here, there in _batches(batches, keys, inputs):
            if last is None:
                state = pickle.loads(carried[part]) if (part := batch.column(PART)[0].as_py()) in carried else rule.start()
            out = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a > 0 or last is not None and here != last:
                    state = rule.start()
                state, found = rule.run(state, rows[a:b])
                out += found
            last = there
            taken = [i for i, f in enumerate(out) if f is not None]
            own = batch if len(taken) == len(out) else batch.take(pa.array(taken, pa.int64()))
            columns = list(zip(*(f for f in out if f is not None), strict=True)) if taken else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*own.columns[:kept], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=names)

    return run


def carried_scan(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], keep: list[str], added: str, rule: Rule, partitions: int | None = None) -> DataFrame:
    """The columns of ``keys`` and ``keep`` with the columns ``added`` (DDL) that the rule makes of each row, scanned by ``order`` within each key.

    The rule sees tuples of the ``inputs`` alone; a row for which it gives None is left out."""
    from pyspark.sql.pandas.types import to_arrow_type

    out = list(dict.fromkeys([*keys, *keep]))
    columns = list(dict.fromkeys([*out, *order, *inputs]))
    rows = checkpoint(df.select(*columns))  # dealing by ranges reads them twice, for the bounds and for the rows
    partitions = partitions or max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / ROWS))
    dealt = checkpoint(rows.repartitionByRange(partitions, *keys, *order).sortWithinPartitions(*keys, *order).withColumn(PART, F.spark_partition_id()))
    found = dealt.select(*dict.fromkeys([*keys, *inputs, PART])).mapInArrow(_summary(rule, keys, inputs), "part long, first binary, last binary, single boolean, effect binary")
    carried: dict[int, bytes] = {}
    before, state = None, None
    for part in sorted(found.collect(), key=lambda r: r["part"]):  # a row for each partition
        goes_on = before is not None and before == pickle.loads(part["first"])
        if goes_on:
            carried[part["part"]] = pickle.dumps(state)
        start = state if goes_on and part["single"] else rule.start()
        before, state = pickle.loads(part["last"]), rule.after(start, pickle.loads(part["effect"]))
    new = T.StructType.fromDDL(added)
    schema = T.StructType([*[rows.schema[c] for c in out], *new.fields])
    return dealt.mapInArrow(_scan(rule, keys, inputs, len(out), carried, schema.names, [to_arrow_type(f.dataType) for f in new.fields]), schema)

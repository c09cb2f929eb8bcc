"""Suppression of repeats in a stream: rows wait in state until the watermark has passed them and are walked in time order.

Rows are packed into Arrow blocks of one group before they are shuffled, and wait in blocks: state and timers cost by the block, whatever the size of Arrow's batches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

#: Bytes of rows in a block, and in what a task packs at a time.
BLOCK, GATHERED = 1 << 15, 1 << 25


def _micros(rows: pa.Table, ts: str) -> np.ndarray:
    return rows[ts].cast(pa.int64()).to_numpy()


def _block_rows(rows: pa.Table) -> int:
    return max(1, BLOCK * rows.num_rows // max(1, rows.nbytes))


def _blocks(rows: pa.Table) -> list[bytes]:
    return [b.serialize().to_pybytes() for b in rows.combine_chunks().to_batches(max_chunksize=_block_rows(rows))]


def _rows(blocks: list[Any], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(b), schema) for b in blocks], schema)


def _packed(rows: pa.Table, by: str, ts: str, value: str) -> pa.RecordBatch:
    """Blocks with their group and first time. Rows without a time or a value can't be walked, and are an error."""
    for name in (ts, value):
        if pc.any(pc.is_null(rows[name], nan_is_null=True)).as_py():
            raise ValueError(f"{name} is null or not a number")
    codes = rows[by].combine_chunks().dictionary_encode("encode").indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    rows, codes, step = rows.take(order).combine_chunks(), codes[order], _block_rows(rows)
    times, edges = _micros(rows, ts), [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
    cuts = [(a, min(a + step, hi)) for lo, hi in zip(edges, edges[1:]) for a in range(lo, hi, step)]
    whole = rows.to_batches()[0]
    return pa.RecordBatch.from_arrays(
        [
            whole.column(rows.schema.get_field_index(by)).take(pa.array([a for a, _ in cuts], pa.int64())),
            pa.array([times[a:b].min() for a, b in cuts], pa.int64()),
            pa.array([whole.slice(a, b - a).serialize().to_pybytes() for a, b in cuts], pa.binary()),
        ],
        ["key", "first", "block"],
    )


def _pack(batches: Iterator[pa.RecordBatch], schema: pa.Schema, by: str, ts: str, value: str) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.nbytes
        if size >= GATHERED:
            yield _packed(pa.Table.from_batches(held).cast(schema), by, ts, value)
            held, size = [], 0
    if held:
        yield _packed(pa.Table.from_batches(held).cast(schema), by, ts, value)


def _unpack(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in batch.column(0):
            yield pa.ipc.read_record_batch(block.as_buffer(), schema)


class Repeats(StatefulProcessor):
    """State of a group: blocks of the rows that wait, the last value kept and the time it has been walked to. A timer at the earliest waiting time lets those go
    that the watermark has passed."""

    def __init__(self, schema: pa.Schema, ts: str, value: str, least_change: float, order: str) -> None:
        self.schema, self.ts, self.value, self.least_change, self.order = schema, ts, value, least_change, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "block binary")
        self.walked = handle.getValueState("walked", "last double, until long")

    def _wake_at(self, micros: int) -> None:
        """Sets the timer to the time of a row that waits, unless it is earlier already."""
        due, timers = micros // 1000 + 1, list(self.handle.listTimers())
        if timers and min(timers) <= due:
            return
        for t in timers:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(due)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            self.waiting.appendList([(bytes(b),) for b in pdf["block"]])
            least = int(pdf["first"].min())
            first = least if first is None else min(first, least)
        if first is not None:
            self._wake_at(first)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        last, until = self.walked.get() if self.walked.exists() else (None, None)
        rows = _rows([b for (b,) in self.waiting.get()], self.schema)
        micros = _micros(rows, self.ts)
        ripe = micros < now * 1000
        late = micros < until * 1000 if until is not None else np.zeros(len(micros), bool)
        rest, rows = rows.filter(pa.array(~ripe)), rows.filter(pa.array(ripe & ~late))
        rows = rows.take(pc.sort_indices(rows.select(sorted({self.ts, self.order})), [(k, "ascending") for k in dict.fromkeys((self.ts, self.order))]))
        values, kept = rows[self.value].cast(pa.float64()).to_numpy(), []
        for at in range(0, len(values), BLOCK):
            for i, v in enumerate(values[at : at + BLOCK].tolist(), at):
                if last is None or abs(v - last) >= self.least_change:
                    last = v
                    kept.append(i)
        self.walked.update((last, now))
        self.waiting.clear()
        for t in list(self.handle.listTimers()):  # the one that has run out is among them
            self.handle.deleteTimer(t)
        if rest.num_rows:
            self.waiting.put([(b,) for b in _blocks(rest)])
            self._wake_at(int(micros[~ripe].min()))
        rows = rows.take(pa.array(kept, pa.int64()))
        some = _block_rows(rows) * 64
        for at in range(0, len(kept), some):
            yield pd.DataFrame({"block": _blocks(rows.slice(at, some))})

    def close(self) -> None:
        pass


def suppress_repeats(stream: DataFrame, by: str, ts: str, value: str, least_change: float, order: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Rows whose value differs by least_change from the last kept row of the group, in the order of the time ts, equal times in that of order.

    Rows may come in any order within late: each waits until the watermark has passed it. So state is the last kept value and the rows of the last stretch of
    late. A row that comes later still is dropped if its group has been walked past its time. Times and values are not null. A task holds what waits of one group,
    as columns. Needs the RocksDB state store, which use_rocksdb sets.
    """
    arrow = stream.sparkSession.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema]).toArrow().schema
    blocks = StructType([StructField("key", stream.schema[by].dataType), StructField("first", LongType()), StructField("block", BinaryType())])
    packed = stream.withWatermark(ts, late).mapInArrow(partial(_pack, schema=arrow, by=by, ts=ts, value=value), blocks)
    kept = packed.groupBy("key").transformWithStateInPandas(Repeats(arrow, ts, value, least_change, order or ts), "block binary", "Append", "EventTime")
    return kept.mapInArrow(partial(_unpack, schema=arrow), stream.schema)


def use_rocksdb(spark: Any) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

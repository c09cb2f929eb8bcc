"""Components of points near each other in the plane, found square by square.

Every point goes once to the task of its square, and to those of the squares that its neighbours may lie in; pairs are formed there and never leave
the task. Only components that reach into another square, and squares of very many points, go on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import chain, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from curbline.operators.components import connected_components, join_labels
from curbline.plans.session import cut

#: Cells a side of a square. A cell is as wide as the distance.
CELLS = 64
#: A square's points are held by its task up to this number; the pairs of a larger one are joined by cells and go on in rounds.
MOST = 500_000
#: Rows a task takes at once, but for a square that is larger, and pairs it looks at at once.
CHUNK, PIECE = 100_000, 2_000_000
DONE, OPEN, LEFT, ACROSS = range(4)
_WIDE = CELLS + 4  # a square's cells, one more on each side, and an empty one beyond


def cell_pairs(flat: DataFrame, eps_m: float, by: str) -> DataFrame:
    """(a, b), a < b: points (idx, x, y) at most eps_m apart. One side is filed under its own cell and four of those around it, so that two cells meet once."""
    cell = lambda c: F.floor(F.col(c) / eps_m)
    ahead = F.array(*(F.struct((cell("x") + i).alias("cx"), (cell("y") + j).alias("cy"), F.lit(i == j == 0).alias("own")) for i, j in ((0, 0), (1, -1), (1, 0), (1, 1), (0, 1))))
    a = flat.select(by, F.col("idx").alias("i"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.explode(ahead).alias("c")).select(by, "i", "ax", "ay", "c.cx", "c.cy", "c.own")
    b = flat.select(by, F.col("idx").alias("j"), F.col("x").alias("bx"), F.col("y").alias("by"), cell("x").alias("cx"), cell("y").alias("cy"))
    d2 = F.pow(F.col("ax") - F.col("bx"), F.lit(2.0)) + F.pow(F.col("ay") - F.col("by"), F.lit(2.0))
    pairs = a.join(b, [by, "cx", "cy"]).where("not own or i < j").where(d2 <= eps_m * eps_m)
    return pairs.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))


def near_components(flat: DataFrame, eps_m: float, by: str, keep: tuple[str, ...], small: int = 0, most: int = MOST) -> DataFrame:
    """(by, keep, component) of points (idx, x, y), none of them null: the smallest idx that steps of at most eps_m inside the group reach. flat is read
    again where squares hold more than most points."""
    cell = lambda c: F.floor(F.col(c) / eps_m)
    to = F.array_distinct(F.array(*(F.struct(F.floor((F.col("cx") + i) / CELLS).alias("sx"), F.floor((F.col("cy") + j) / CELLS).alias("sy")) for i, j in product((-1, 1), repeat=2))))
    placed = flat.select(by, *keep, F.col("idx").cast("long").alias("idx"), "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    sent = placed.withColumn("_to", F.explode(to)).select(*placed.columns, "_to.sx", "_to.sy").repartition(by, "sx", "sy").sortWithinPartitions(by, "sx", "sy")
    shape = StructType([flat.schema[c] for c in (by, *keep)]).add("u", LongType()).add("v", LongType()).add("kind", IntegerType())
    for f in shape.fields:
        f.nullable = True
    solved = cut(sent.mapInArrow(partial(_squares, by=by, keep=keep, eps2=eps_m * eps_m, most=most), shape))
    named = lambda df, c: df.select(by, *keep, c.alias("component"))
    done = named(solved.where(f"kind = {DONE}"), F.col("v"))
    if not solved.where(f"kind <> {DONE}").take(1):
        return done
    edges = solved.where(f"kind in ({OPEN}, {ACROSS})").select("u", "v")
    left = solved.where(f"kind = {LEFT}").select(F.col("u").alias("idx"))
    if left.take(1):
        edges = edges.unionByName(cell_pairs(flat.join(left, "idx", "left_semi"), eps_m, by).toDF("u", "v"))
    found = connected_components(edges, "u", "v", small)
    unfinished = solved.where(f"kind in ({OPEN}, {LEFT})").join(found, F.col("u") == F.col("node"), "left")
    return done.unionByName(named(unfinished, F.coalesce("component", "u")))


def _squares(batches: Iterator[pa.RecordBatch], by: str, keep: tuple[str, ...], eps2: float, most: int) -> Iterator[pa.RecordBatch]:
    """Points come one square after another. Every point of a square gives (by, keep, idx, least idx of its component in the square, kind): DONE, OPEN where
    the component has a pair with a point of another square, LEFT where the square holds more than most. Such a pair is ACROSS: (least idx, that point's)."""
    key, names = (by, "sx", "sy"), (by, *keep)
    held, over = None, None
    for batch in chain(batches, (None,)):
        if batch is not None:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            held = table
            if table.num_rows < min(CHUNK, most):
                continue
        elif held is None or not held.num_rows:
            return
        table, held = held.combine_chunks(), None
        starts = _starts(table, key)
        if over is not None and all(table[c][0] == over[c] for c in key):  # more of a square that was left
            end = starts[1] if len(starts) > 1 else table.num_rows
            yield from _left(table.slice(0, end), names)
            table, starts = table.slice(end), starts[1:] - end
        if not table.num_rows:
            continue
        if batch is not None:
            table, held = table.slice(0, starts[-1]), table.slice(starts[-1])
            starts = starts[:-1]
            if held.num_rows > most:
                over, gone, held = {c: held[c][0] for c in key}, held, None
                yield from _left(gone, names)
        if table.num_rows:
            yield from _solved(table, starts, names, eps2)


def _starts(table: pa.Table, key: tuple[str, ...]) -> np.ndarray:
    """Where squares begin."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in key:
        values = table[c].combine_chunks()
        new[1:] |= pc.not_equal(values.slice(1), values.slice(0, len(values) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _own(table: pa.Table) -> np.ndarray:
    return np.logical_and(*(table[f"c{a}"].to_numpy() // CELLS == table[f"s{a}"].to_numpy() for a in "xy"))


def _rows(table: pa.Table, names: tuple[str, ...], u: np.ndarray, v: np.ndarray, kind: np.ndarray) -> Iterator[pa.RecordBatch]:
    given = {c: table[c] for c in names} | {"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "kind": pa.array(kind, pa.int32())}
    yield from pa.table(given).to_batches()


def _left(table: pa.Table, names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    table = table.filter(pa.array(_own(table)))
    ids = table["idx"].to_numpy()
    yield from _rows(table, names, ids, ids, np.full(len(ids), LEFT))


def _solved(table: pa.Table, starts: np.ndarray, names: tuple[str, ...], eps2: float) -> Iterator[pa.RecordBatch]:
    n = table.num_rows
    square = np.zeros(n, "int64")
    square[starts[1:]] = 1
    at = [table[f"c{a}"].to_numpy() - table[f"s{a}"].to_numpy() * CELLS + 2 for a in "xy"]
    cell = (np.cumsum(square) * _WIDE + at[0]) * _WIDE + at[1]
    order = np.argsort(cell, kind="stable")
    table = table.take(pa.array(order))
    ids, own = table["idx"].to_numpy(), _own(table)
    label, crossing = np.arange(n), []
    for a, b in _near(cell[order], table["x"].to_numpy(), table["y"].to_numpy(), eps2):
        inside = own[a] & own[b]
        join_labels(label, a[inside], b[inside])
        a, b = np.where(own[a], a, b), np.where(own[a], b, a)
        across = own[a] & ~own[b]
        crossing.append(np.unique(label[a[across]] * n + b[across]))
    crossing = np.concatenate(crossing) if crossing else np.zeros(0, "int64")
    crossing = np.unique(label[crossing // n] * n + crossing % n)
    least = np.full(n, np.iinfo("int64").max)
    np.minimum.at(least, label[own], ids[own])
    reaches = np.zeros(n, bool)
    reaches[crossing // n] = True
    yield from _rows(table.filter(pa.array(own)), names, ids[own], least[label[own]], np.where(reaches[label[own]], OPEN, DONE))
    if len(crossing):
        empty = pa.table({c: pa.nulls(len(crossing), table[c].type) for c in names})
        yield from _rows(empty, names, least[crossing // n], ids[crossing % n], np.full(len(crossing), ACROSS))


def _near(cell: np.ndarray, x: np.ndarray, y: np.ndarray, eps2: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of points, sorted by cell, whose squared distance is at most eps2, in pieces. Two cells meet once."""
    n = len(cell)
    cells, first, inverse, sizes = np.unique(cell, return_index=True, return_inverse=True, return_counts=True)
    for dx, dy in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1)):
        if dx == dy == 0:
            low, many = np.arange(n) + 1, (first + sizes)[inverse] - np.arange(n) - 1
        else:
            there = np.minimum(np.searchsorted(cells, cells + dx * _WIDE + dy), len(cells) - 1)
            met = cells[there] == cells + dx * _WIDE + dy
            low, many = first[there][inverse], np.where(met, sizes[there], 0)[inverse]
        ends = np.cumsum(many)
        i = 0
        while i < n:
            before = ends[i] - many[i]
            k = max(int(np.searchsorted(ends, before + PIECE, "right")), i + 1)
            a = np.repeat(np.arange(i, k), many[i:k])
            b = np.arange(len(a)) + np.repeat(low[i:k] - (ends[i:k] - many[i:k] - before), many[i:k])
            close = (x[a] - x[b]) ** 2 + (y[a] - y[b]) ** 2 <= eps2
            yield a[close], b[close]
            i = k

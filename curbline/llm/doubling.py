"""Exact removal of repeated 100-byte strings by prefix doubling over every position: the plain form of what substring does over sampled ones.

Positions are ranked by their first 8 bytes, then by pairs of ranks at growing offsets: 16, 32, 64 and 100 bytes. Spark sorts the pairs by ranges; a
position's new rank is the number of the first row of its pair. Positions whose pair is theirs alone are unique and drop out, as does every
position that needs them. Nothing is hashed. Each round sorts all positions that are left, some 40 bytes for every byte of text in the first, so this form
is for small tables: see the README for figures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbline.llm import substring as S
from curbline.plans.session import cut

START = 8
OFFSETS = (8, 16, 32, 36)  # 8 + 8, 16 + 16, 32 + 32, 64 + 36 = LENGTH


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, tie, text) -> (doc, low, rank): the first START bytes as a number, a piece of a text at a time."""
    step = 1 << 18
    for batch in batches:
        for doc, tie, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            data = np.frombuffer(text.as_py() or b"", np.uint8)
            if len(data) < S.LENGTH:
                continue
            for at in range(0, len(data) - START + 1, step):
                part = np.ascontiguousarray(data[at : at + step + START - 1])
                rank = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(part, START)).view(">i8")[:, 0].astype(np.int64)
                low = (tie << 32) + at + np.arange(len(rank))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rank), doc, np.int64)), pa.array(low), pa.array(rank)], names=["doc", "low", "rank"])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a partition in the order of (a, b): its number, rows, first and last pair, rows before its last pair begins."""
    n, first, last, begin = 0, None, None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        pair = np.stack([np.asarray(batch.column(i)) for i in (0, 1)], axis=1)
        new = np.flatnonzero((pair[1:] != pair[:-1]).any(axis=1)) + 1
        first = tuple(pair[0].tolist()) if first is None else first
        if len(new):
            begin = n + int(new[-1])
        elif last != tuple(pair[0].tolist()):
            begin = n
        last, n = tuple(pair[-1].tolist()), n + batch.num_rows
    if n:
        yield pa.RecordBatch.from_pylist([{"p": TaskContext.get().partitionId(), "n": n, "fa": first[0], "fb": first[1], "la": last[0], "lb": last[1], "begin": begin}])


def rerank(pairs: DataFrame) -> DataFrame:
    """(doc, low, rank, lone) of rows (a, b, doc, low): rank is the number of the first row with the same a and b in their order, the one of the least
    (doc, low); lone marks pairs of one row."""
    kept = cut(pairs.select("a", "b", "doc", "low").repartitionByRange("a", "b", "doc", "low").sortWithinPartitions("a", "b", "doc", "low"))
    edges = sorted(kept.mapInArrow(_edges, "p long, n long, fa long, fb long, la long, lb long, begin long").collect())  # a row a partition
    plan, at, rank = {}, 0, -1  # partition -> rows before it, the rank of the pair it begins with, whether that began before, whether its last pair goes on
    for i, e in enumerate(edges):
        goes_on = i > 0 and (edges[i - 1].la, edges[i - 1].lb) == (e.fa, e.fb)
        rank = rank if goes_on else at
        follows = i + 1 < len(edges) and (edges[i + 1].fa, edges[i + 1].fb) == (e.la, e.lb)
        plan[e.p] = (at, rank, goes_on, follows)
        rank = rank if (e.la, e.lb) == (e.fa, e.fb) else at + e.begin
        at += e.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done, current = None, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            start, rank0, before, follows = plan[TaskContext.get().partitionId()]
            a, b, doc, low = (np.asarray(c) for c in batch.columns)
            prior = current[0] if current else None
            first_new = not before if prior is None else (a[0], b[0]) != prior
            new = np.r_[first_new, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
            ranks = np.where(new, start + done + np.arange(len(a)), -1)
            ranks[0] = ranks[0] if first_new else (rank0 if current is None else current[1])
            ranks = np.maximum.accumulate(ranks)
            if held is not None:  # whether the row before these was alone is known only now
                yield _out(held[0], held[1], held[2], held[3] & new[:1])
            lone = new & np.r_[new[1:], True]
            yield _out(doc[:-1], low[:-1], ranks[:-1], lone[:-1])
            held = (doc[-1:], low[-1:], ranks[-1:], new[-1:])
            current, done = ((a[-1], b[-1]), int(ranks[-1])), done + len(a)
        if held is not None:
            yield _out(held[0], held[1], held[2], held[3] & ~np.array([plan[TaskContext.get().partitionId()][3]]))

    return kept.mapInArrow(run, "doc long, low long, rank long, lone boolean")


def _out(doc: np.ndarray, low: np.ndarray, rank: np.ndarray, lone: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(low), pa.array(rank), pa.array(lone)], names=["doc", "low", "rank", "lone"])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As substring.remove_repeats, to the same results."""
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).alias("doc_id"), S._key(F.col(doc_id)).alias("doc"), S._tie(F.col(doc_id), body).alias("tie"), body.alias("text"))
    left = rows.select("doc", "tie", "text").dropDuplicates(["doc", "tie"]).mapInArrow(_positions, "doc long, low long, rank long")
    for offset in OFFSETS:
        ahead = left.select("doc", (F.col("low") - offset).alias("low"), F.col("rank").alias("b"))
        ranked = rerank(left.withColumnRenamed("rank", "a").join(ahead, ["doc", "low"]))
        left = cut(ranked.where("not lone").select("doc", "low", "rank"))
    firsts = left.groupBy("rank").agg(F.min(F.struct("doc", "low")).alias("first"))
    again = left.join(firsts, "rank").where(F.struct("doc", "low") != F.col("first"))
    cover = again.groupBy("doc", F.shiftright("low", 32).alias("tie")).agg(F.collect_list(F.struct("low", F.lit(0).alias("span"))).alias("cover"))  # of one text
    whole = rows.join(cover, ["doc", "tie"], "left").select("doc_id", "tie", "text", "cover")
    return whole.mapInArrow(S._finish, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {S.RESULT}, kept binary")

"""Exact removal of repeated 100-byte strings by prefix doubling over sampled suffixes.

A suffix array of every position would sort the whole corpus some seven times. Winnowing (Schleimer, Wilkerson and Aiken, 2003)
names positions enough: each window of LENGTH bytes picks, by content alone, the GRAM-byte string in it with the least hash, so equal windows
pick the same string at the same place. The suffixes at picked positions, the anchors, are then ranked at growing lengths:

1. rank by the first GRAM bytes; an anchor alone in its rank is unique and drops out;
2. rerank by the text of all windows that picked the anchor, up to LENGTH bytes to its right and nearly as far to its left. The first anchor
   of a class keeps its windows; every other anchor's windows all start earlier elsewhere;
3. where a rank of step 1 holds several classes, the first anchors of its classes may still share some windows (a passage that ends
   in mid-window). Their windows are ranked by the LENGTH - 7 bytes that 8 neighbours share, then by the text of all 8, and only
   where that leaves several classes one by one by LENGTH bytes.

Anchors are about 3 in 100 positions. Spark deals them out by rank and sorts them; those not first of their class in their own batch are
settled there and not dealt by rank, which bounds what a text with a third of all rows can bring to one task. A rank that holds very many classes, as a line
that most documents share and that ends in mid-window, is dealt by class. Ranks and classes are 64-bit hashes rather than sorted positions.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbline.plans.session import checkpoint_dir, cut, shuffles_freed

LENGTH, GRAM, SYMBOL = 100, 32, 8
WINDOW = LENGTH - GRAM + 1
#: Bytes hashed at a time. Short documents share a block; a long one is cut, its parts overlapping by LENGTH - 1 bytes.
SEGMENT = 1 << 19

_U = np.uint64


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, for one block."""
    base = 0x9E3779B97F4A7C15 | 1
    inverse = pow(base, -1, 1 << 64)
    n = 2 * SEGMENT + 4 * LENGTH
    up, down = (np.cumprod(np.full(n, b, np.uint64)) for b in (base, inverse))
    return np.r_[_U(1), up[:-1]], np.r_[_U(1), down[:-1]]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


class Block:
    """Prefix hashes of some bytes: the hash of any substring of SYMBOL bytes or more in constant time.

    The polynomial is over the mixed values of every SYMBOL neighbouring bytes, not over bytes: alternating runs of two letters, which cancel in any
    polynomial modulo a power of two, have nothing in common there.
    """

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = _tables()
        wide = np.zeros(len(data) + SYMBOL, np.uint64)
        wide[: len(data)] = data
        symbols = wide[: len(data)].copy()
        for k in range(1, SYMBOL):
            symbols |= wide[k : k + len(data)] << _U(8 * k)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_mix(symbols + _U(0x632BE59BD9B4E019)) * up[: len(data)], out=self.prefix[1:])

    def hash(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        end = start + length - (SYMBOL - 1)
        return _mix((self.prefix[end] - self.prefix[start]) * self.down[start] + (np.atleast_1d(length).astype(np.uint64) + _U(1)) * _U(0xD1B54A32D192ED03))


def _picked(grams: np.ndarray) -> np.ndarray:
    """For each window of WINDOW grams the position of its leftmost least one."""
    n, w = len(grams), WINDOW
    rows = -(-n // w)
    key = np.full((rows + 1) * w, 0xFFFFFFFFFFFFFFFF, np.uint64)
    key[:n] = grams
    key = (key & _U(0xFFFFFFFFFFFFFF80)).reshape(-1, w) | np.arange(w, dtype=np.uint64)
    ahead = np.minimum.accumulate(key, axis=1).ravel()
    behind = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    p = np.arange(n - w + 1)
    left, right = behind[p], ahead[p + w - 1]
    first = (p % w == 0) | ((left >> _U(7)) <= (right >> _U(7)))
    return np.where(first, p // w * w + (left & _U(127)).astype(np.int64), (p + w - 1) // w * w + (right & _U(127)).astype(np.int64))


def block_anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """The anchors of the documents [starts, ends) laid out in data: document number, first window, last window (both from the
    document's start), rank of the first GRAM bytes, class of the windows' text, and the
    anchor's distance from the first window."""
    if len(data) < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64))
    block = Block(data)
    grams = block.hash(np.arange(len(data) - GRAM + 1), GRAM)
    at = _picked(grams)
    size = np.maximum(ends - starts - LENGTH + 1, 0)
    doc = np.repeat(np.arange(len(starts)), size)
    p = np.arange(len(doc)) + np.repeat(starts - np.cumsum(size) + size, size)
    at = at[p]
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]) if len(p) else np.zeros(0, np.int64)
    last = np.r_[new[1:], len(p)] - 1 if len(p) else new
    low, high, anchor = p[new], p[last], at[new]
    kind = block.hash(low, high - low + LENGTH) + _mix((anchor - low).astype(np.uint64) + _U(1))
    own = starts[doc[new]]
    return doc[new], low - own, high - own, grams[anchor], kind, anchor - low


def _pieces(texts: list[bytes], segment: int = SEGMENT) -> Iterator[tuple[np.ndarray, list[tuple[int, int]], np.ndarray, np.ndarray]]:
    """Blocks of at most about segment bytes: data, (text number, offset of the piece in its text), starts and ends in data."""
    parts, spans, used = [], [], 0
    for i, text in enumerate(texts):
        for off in range(0, max(len(text) - LENGTH + 1, 1), segment):
            part = text[off : off + segment + LENGTH - 1]
            if used and used + len(part) > segment:
                yield _laid(parts, spans)
                parts, spans, used = [], [], 0
            parts.append(part)
            spans.append((i, off))
            used += len(part)
    if parts:
        yield _laid(parts, spans)


def _laid(parts: list[bytes], spans: list[tuple[int, int]]):
    ends = np.cumsum([len(x) for x in parts])
    return np.frombuffer(b"".join(parts), np.uint8), spans, ends - np.array([len(x) for x in parts]), ends


#: late marks anchors that already have an equal one before them in their batch; deal is what rows are dealt by.
ANCHOR = "deal long, late int, gram long, kind long, doc long, low long, span int, lead int"
#: part marks first anchors of one class among several of a rank; all other marked anchors lose their windows.
MARK = "doc long, low long, span int, lead int, gram long, part boolean"
BLOCK = 8


def _batch(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def _anchor_rows(batches: Iterator[pa.RecordBatch], segment: int = SEGMENT, heavy: tuple[int, ...] = ()) -> Iterator[pa.RecordBatch]:
    """(doc, tie, text) -> anchors. low orders windows within a doc: the text's tie above the position."""
    for batch in batches:
        docs, ties = np.asarray(batch.column(0)), np.asarray(batch.column(1)) << 32
        found = []
        for data, spans, starts, ends in _pieces([x.as_py() or b"" for x in batch.column(2)], segment):
            doc, low, high, gram, kind, lead = block_anchors(data, starts, ends)
            number, off = (np.array(c)[doc] for c in zip(*spans, strict=True))
            found.append((gram.view(np.int64), kind.view(np.int64), docs[number], ties[number] + low + off, (high - low).astype(np.int32), lead.astype(np.int32)))
        if not found:
            continue
        yield _settled(found, heavy)


#: A rank with over a HEAVY-th of the anchors of one in SAMPLE documents is dealt by class, so there are fewer than HEAVY of them.
HEAVY, SAMPLE = 1000, 64


def _settled(found: list[tuple[np.ndarray, ...]], heavy: tuple[int, ...] = ()) -> pa.RecordBatch:
    """Rows (gram, kind, doc, low, span, lead) of one batch with what they are dealt by. Those not first of their class in the batch
    need not meet the others: only where they start matters, and they are dealt by that. A row of the very same place counts once."""
    gram, kind, doc, low, span, lead = (np.concatenate(c) for c in zip(*found, strict=True))
    by = np.lexsort((low, doc, kind, gram))
    gram, kind, doc, low, span, lead = (c[by] for c in (gram, kind, doc, low, span, lead))
    same = np.r_[False, (gram[1:] == gram[:-1]) & (kind[1:] == kind[:-1])][: len(by)]
    again = same & np.r_[False, (doc[1:] == doc[:-1]) & (low[1:] == low[:-1])][: len(by)]
    deal = np.where(same, doc * 1_000_003 + low, gram)
    if heavy:  # a rank of very many classes is dealt by class
        many = ~same & np.isin(gram, np.array(heavy, np.int64))
        deal[many] = _mix(gram[many].view(np.uint64) + _mix(kind[many].view(np.uint64))).view(np.int64)
    gram, kind, lead = (np.where(same, 0, c).astype(c.dtype) for c in (gram, kind, lead))
    columns = {"deal": deal, "late": same.astype(np.int32), "gram": gram, "kind": kind, "doc": doc, "low": low, "span": span.astype(np.int32), "lead": lead.astype(np.int32)}
    return _batch({k: v[~again] for k, v in columns.items()})


def _mark_rows(batches: Iterator[pa.RecordBatch], heavy: tuple[int, ...] = ()) -> Iterator[pa.RecordBatch]:
    """Anchors in the order of late, gram, kind, doc, low -> marked anchors. What is kept between batches is one anchor. The first anchors of heavy ranks, whose
    other classes lie elsewhere, are marked as if there were any; if not, the next round finds them alone."""
    dealt_by_class = np.array(heavy, np.int64)
    last, pending = None, None  # the last (gram, kind, doc, low); the first anchor of a rank that has one class so far
    for batch in batches:
        if not batch.num_rows:
            continue
        x = {f: np.asarray(batch.column(i)) for i, f in enumerate(batch.schema.names)}
        late, gram, kind, doc, low = (x[f] for f in ("late", "gram", "kind", "doc", "low"))
        fresh = np.flatnonzero(late == 0)
        out = [{f: x[f][late == 1] for f in ("doc", "low", "span", "lead", "gram")} | {"part": np.zeros(int((late == 1).sum()), bool)}]
        if len(fresh):
            g, k, d, w = gram[fresh], kind[fresh], doc[fresh], low[fresh]
            before = np.array(last, np.int64) if last else np.array([~g[0], 0, 0, 0], np.int64)
            new_rank = np.r_[g[0] != before[0], g[1:] != g[:-1]]
            new_kind = new_rank | np.r_[k[0] != before[1], k[1:] != k[:-1]]
            moved = new_kind | np.r_[(d[0] != before[2]) | (w[0] != before[3]), (d[1:] != d[:-1]) | (w[1:] != w[:-1])]
            firsts = np.flatnonzero(new_kind)
            rank = np.cumsum(new_rank)
            kinds = np.bincount(rank[firsts], minlength=int(rank[-1]) + 1)
            if last and not new_rank[0]:
                kinds[0] += 1
                if kinds[0] > 1 and pending is not None:
                    out.append(pending)
                    pending = None
            elif new_rank[0]:
                pending = None
            row = lambda at: {f: x[f][fresh[at]] for f in ("doc", "low", "span", "lead", "gram")}
            parts = firsts[(kinds[rank[firsts]] > 1) | np.isin(g[firsts], dealt_by_class)]
            out.append(row(parts) | {"part": np.ones(len(parts), bool)})
            rest = np.flatnonzero(~new_kind & moved)
            out.append(row(rest) | {"part": np.zeros(len(rest), bool)})
            if kinds[-1] == 1 and len(firsts) and rank[firsts[-1]] == rank[-1] and not np.isin(g[-1], dealt_by_class):
                pending = row(firsts[-1:]) | {"part": np.ones(1, bool)}
            elif kinds[-1] > 1:
                pending = None
            last = (g[-1], k[-1], d[-1], w[-1])
        yield _batch({f: np.concatenate([o[f] for o in out]) for f in out[0]})


def _of_text(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(doc, tie above the position, bytes, {low, span, lead, gram} as arrays) of rows (doc_id, doc, tie, text, parts)."""
    for i in range(batch.num_rows):
        doc, tie = batch.column(1)[i].as_py(), batch.column(2)[i].as_py() << 32
        parts = batch.column(4)[i].values.flatten()
        low, span, lead, gram = (np.asarray(c).astype(np.int64) for c in parts)
        yield doc, tie, np.frombuffer(batch.column(3)[i].as_py(), np.uint8), low - tie, span, lead, gram


def _hashed(text: np.ndarray, start: np.ndarray, length: np.ndarray, segment: int) -> np.ndarray:
    """Hashes of substrings of a text of any length, a segment at a time."""
    out = np.zeros(len(start), np.uint64)
    for s in np.unique(start // segment):
        at = np.flatnonzero(start // segment == s)
        off = int(s) * segment
        out[at] = Block(text[off : off + segment + 3 * LENGTH]).hash(start[at] - off, length[at])
    return out


def _block_rows(batches: Iterator[pa.RecordBatch], segment: int = SEGMENT, heavy: tuple[int, ...] = ()) -> Iterator[pa.RecordBatch]:
    """Of first anchors, runs of BLOCK windows at the same places before the anchor: gram is the rank of the text that all windows of the
    place share, kind the class of the text of the windows there are."""
    for batch in batches:
        found = []
        for doc, tie, text, low, span, lead, gram in _of_text(batch):
            b0, b1 = (lead - span) // BLOCK, lead // BLOCK
            n = b1 - b0 + 1
            at = np.repeat(np.arange(len(low)), n)
            b = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + b0[at]
            anchor = (low + lead)[at]
            start = anchor - np.minimum(lead[at], BLOCK * b + BLOCK - 1)
            stop = anchor - np.maximum((lead - span)[at], BLOCK * b)
            core = _mix(_hashed(text, anchor - BLOCK * b, np.full(len(b), LENGTH - BLOCK + 1), segment) + _mix(gram[at].view(np.uint64) + b.astype(np.uint64)))
            full = _hashed(text, start, stop - start + LENGTH, segment) + _mix((anchor - start).astype(np.uint64))
            found.append((core.view(np.int64), full.view(np.int64), np.full(len(b), doc, np.int64), start + tie, stop - start, np.zeros(len(b), np.int64)))
        if found:
            yield _settled(found, heavy)


def _window_rows(batches: Iterator[pa.RecordBatch], segment: int = SEGMENT, heavy: tuple[int, ...] = ()) -> Iterator[pa.RecordBatch]:
    """Of the runs left, each window. Its rank is made of the run's and of its own text, so that a rank has one class."""
    for batch in batches:
        found = []
        for doc, tie, text, low, span, _, core in _of_text(batch):
            at = np.repeat(np.arange(len(low)), span + 1)
            p = low[at] + np.arange(len(at)) - np.repeat(np.cumsum(span + 1) - span - 1, span + 1)
            own = _hashed(text, p, np.full(len(p), LENGTH), segment)
            rank = _mix(own + _mix(core[at].view(np.uint64)))
            zero = np.zeros(len(p), np.int64)
            found.append((rank.view(np.int64), own.view(np.int64), np.full(len(p), doc, np.int64), p + tie, zero, zero))
        if found:
            yield _settled(found, heavy)


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tie, text, cover as array of (low, span)) -> the result of each row."""
    for batch in batches:
        rows = []
        for tie, text, cover in zip(np.asarray(batch.column(1)) << 32, batch.column(2), batch.column(3), strict=True):
            text, cover = text.as_py(), cover.as_py() or []
            spans = sorted((x["low"] - tie, x["low"] - tie + x["span"] + LENGTH) for x in cover)
            kept, at, n_spans = [], 0, 0
            for a, b in spans:
                if a > at or not n_spans:
                    kept.append(text[at:a])
                    n_spans += 1
                at = max(at, b)
            kept.append(text[at:])
            left = b"".join(kept)
            rows.append((len(text), len(text) - len(left), n_spans, hashlib.sha256(left).hexdigest(), left))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, types, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _tie(doc_id: Column, text: Column) -> Column:
    """Tells texts that repeat a doc_id apart and orders them, and puts null ids after the largest id; below 2^31."""
    return F.crc32(text).bitwiseAND(F.lit(0x3FFFFFFF).cast("long")) + F.when(doc_id.isNull(), F.lit(1 << 30).cast("long")).otherwise(F.lit(0).cast("long"))


def _key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit((1 << 63) - 1))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row: bytes in any LENGTH-byte string that starts earlier, in a
    smaller doc_id or before in the same text, are removed; kept is what remains, as bytes.

    Null texts count as empty, texts below LENGTH bytes keep everything. Null doc_ids come after all others. Different texts of one
    doc_id come in the order of a checksum of theirs; rows that repeat id and text are one document and get the same result. An empty
    table gives an empty result; further columns are not looked at. segment, at most SEGMENT, is the number of bytes hashed at a time. Equality is
    that of 64-bit hashes of a rank's bytes and of all its windows' text: of two anchors of one rank with different text, one pair in 2^64 is taken for equal.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).alias("doc_id"), _key(F.col(doc_id)).alias("doc"), _tie(F.col(doc_id), body).alias("tie"), body.alias("text"))
    spark, tie, name = docs.sparkSession, F.shiftright("low", 32), uuid.uuid4().hex

    def ranked(texts: DataFrame, make, step: str) -> DataFrame:
        """The marked rows of one round, as a table in the shared folder; the shuffle that sorted them can go then. Which ranks are heavy is asked of a
        sample of the texts: it decides only where rows are dealt, not what is marked in the end."""
        table = f"{checkpoint_dir(spark)}/repeats-{name}/{step}"
        some = texts.where(F.pmod(F.xxhash64("doc"), F.lit(SAMPLE)) == 0)
        with shuffles_freed(spark):
            sizes = cut(some.mapInArrow(partial(make, segment=segment), ANCHOR).where("late = 0").groupBy("gram").agg(F.count("*").alias("n")))
            whole = sizes.agg(F.sum("n")).first()[0] or 0
            heavy = tuple(r.gram for r in sizes.where((F.col("n") * HEAVY > whole) & (F.col("n") > 8)).select("gram").collect())  # fewer than HEAVY
            found = texts.mapInArrow(partial(make, segment=segment, heavy=heavy), ANCHOR)
            found.repartition("deal").sortWithinPartitions("late", "gram", "kind", "doc", "low").mapInArrow(partial(_mark_rows, heavy=heavy), MARK).write.parquet(table)
        return spark.read.schema(MARK).parquet(table)

    def with_text(parts: DataFrame) -> DataFrame:
        """(doc_id, doc, tie, text, parts) of the texts that have parts."""
        lists = parts.groupBy("doc", tie.alias("tie")).agg(F.collect_list(F.struct("low", "span", "lead", "gram")).alias("parts"))  # of one text
        return rows.join(lists, ["doc", "tie"]).select("doc_id", "doc", "tie", "text", "parts")

    marks = [ranked(rows.select("doc", "tie", "text"), _anchor_rows, "anchors")]
    marks.append(ranked(with_text(marks[0].where("part")), _block_rows, "blocks"))
    marks.append(ranked(with_text(marks[1].where("part")), _window_rows, "windows"))

    cover = marks[0].unionByName(marks[1]).unionByName(marks[2]).where("not part").select("doc", "low", "span")
    cover = cover.groupBy("doc", tie.alias("tie")).agg(F.collect_list(F.struct("low", "span")).alias("cover"))  # of one text
    whole = rows.join(cover, ["doc", "tie"], "left").select("doc_id", "tie", "text", "cover")
    return whole.mapInArrow(_finish, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {RESULT}, kept binary")


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c0 AS (SELECT doc_id, o, substr(h, CAST(2 * o + 1 AS BIGINT), 8190) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(strlen(h) // 2 - 99, 0), 3996)) AS o FROM d)),
w AS (SELECT doc_id, o + q AS p, hash(substr(s, CAST(2 * q + 1 AS BIGINT), 200)) AS k, md5_number_lower(substr(s, CAST(2 * q + 1 AS BIGINT), 200)) AS m FROM (SELECT doc_id, o, s, unnest(range(0, least(strlen(s) // 2 - 99, 3996))) AS q FROM c0)),
g AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k, m ORDER BY doc_id, p) AS n FROM w),
r AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM g WHERE n > 1),
s AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM r),
c AS (SELECT doc_id, k, min(p) AS a, max(p) + 100 AS b FROM s GROUP BY doc_id, k),
t AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM c),
u AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS top, list(struct_pack(a := a, z := z) ORDER BY a) AS l FROM t GROUP BY doc_id)
SELECT d.doc_id, CAST(strlen(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
 sha256(unhex(CASE WHEN l IS NULL THEN h ELSE array_to_string(list_transform(l, lambda x: substr(h, CAST(2 * x.z + 1 AS BIGINT), CAST(2 * (x.a - x.z) AS BIGINT))), '') || substr(h, CAST(2 * top + 1 AS BIGINT)) END)) AS kept_sha256
FROM d LEFT JOIN u USING (doc_id)
"""

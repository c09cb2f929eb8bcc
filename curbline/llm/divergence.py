"""Source divergence audit: how far the term distributions of a language's sources lie apart, by systolic rotation.

Each group (language and source) has a vector of shares over the language's kept terms. Vectors are cut into segments of at most about SEGMENT terms and
compressed: the terms that occur, as distances, and their shares; all other terms have one share. Groups are dealt into blocks of BLOCK, which stay in their
partition, while the compressed vectors of the peers go round: in each round of a round-robin tournament (the circle method) every block meets one other, one
of the two as a visitor, and a meeting gives both directions. The sums of the segments are added at the end.

A language's terms are ranked where the vectors are made: each segment of a group keeps a heap of its best, and only those are sorted.

Memory is bounded by BLOCK vectors of a segment on either side, however many terms, sources and rows there are. All arithmetic is of integers.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbline.plans.session import cut

TERMS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS = 30
UNIT, PRIOR = 1_000_000_000, 5
TOP = 50
SEGMENT, BLOCK = 65_536, 8
#: Rounds whose meetings are one job.
TOGETHER = 8
#: Counts a task holds before it puts them out, each as one number: occurrences, and above this many bits documents.
HELD, BITS = 500_000, 40

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shares(counts: np.ndarray, whole: int) -> np.ndarray:
    """1 + floor(UNIT * (counts + PRIOR) / whole), by long division, so that nothing overflows."""
    digits, rest = np.divmod(counts.astype(np.int64) + PRIOR, np.int64(whole))
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, np.int64(whole))
        digits = digits * 1000 + more
    return digits + 1


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text as bytes) to (lang, source, term, n, docs): summed over a task's rows, and put out whenever there are HELD of them. A group gets
    a row of the empty term, so that groups without terms are known."""

    def put(held: dict[tuple[str, str], dict[str, int]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), own in held.items():
            both = np.fromiter(own.values(), np.int64, len(own))
            group = [pa.array([x], pa.string()).take(pa.array(np.zeros(len(own), np.int32))) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*group, pa.array(list(own), pa.string()), pa.array(both & ((1 << BITS) - 1)), pa.array(both >> BITS)], ["lang", "source", "term", "n", "docs"])

    find, held, size = re.compile(TERMS).findall, {}, 0
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = held.setdefault((lang, source), {"": 0})
            before, get = len(own), own.get
            for term, n in Counter(find(text.translate(_LOWER).decode())).items():
                own[term] = get(term, 0) + n + (1 << BITS)
            size += len(own) - before
            if size > HELD:
                yield from put(held)
                held, size = {}, 0
    yield from put(held)


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, with a row of the empty term for every group."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(plain(lang).alias("lang"), plain(source).alias("source"), plain(text).cast("binary").alias("text"))
    found = rows.mapInArrow(_tally, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _compress(size: int, terms: np.ndarray, own: np.ndarray, rest: int) -> bytes:
    """A vector of size shares: own at terms (rising), rest elsewhere."""
    head = np.array([size, rest], np.uint32)
    return zlib.compress(head.tobytes() + np.diff(terms, prepend=0).astype(np.uint32).tobytes() + own.astype(np.uint32).tobytes(), 1)


def _dense(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(packed), np.uint32)
    n = (len(raw) - 2) // 2
    out = np.full(int(raw[0]), raw[1], np.int64)
    out[np.cumsum(raw[2 : 2 + n])] = raw[2 + n :]
    return out


def _vectors(top: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Segments of groups (terms, counts and the language's counts as lists) to their packed vectors and heaps."""

    def one(r) -> tuple[bytes, list[dict[str, int]]]:
        lists = [np.zeros(0, np.int64) if x is None else np.asarray(x, np.int64) for x in (r.idx, r.n, r.all_n)]
        terms, n, of = (x[np.argsort(lists[0])] for x in lists)
        own = shares(n, r.whole)
        gain = own - shares(of, r.lang_whole)
        heap = heapq.nsmallest(top, ((-g, t) for g, t in zip(gain.tolist(), terms.tolist(), strict=True) if g > 0))  # segments number their terms in their order
        return _compress(r.size, terms, own, int(shares(np.zeros(1, np.int64), r.whole)[0])), [{"idx": t, "value": -g} for g, t in heap]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            made = [one(r) for r in pdf.itertuples(index=False)]
            yield pdf.drop(columns=["idx", "n", "all_n", "size", "whole", "lang_whole"]).assign(packed=[m[0] for m in made], best=[m[1] for m in made])

    return run


def _meet(residents: pd.DataFrame, visitors: pd.DataFrame) -> pd.DataFrame:
    """Every resident against every visitor, both directions."""
    if not len(residents) or not len(visitors):
        return pd.DataFrame({"lang": [], "source": [], "item": [], "value": []}).astype({"lang": str, "source": str, "item": str, "value": "int64"})
    held = [(r.source, _dense(r.packed)) for r in residents.itertuples()]
    rows = []
    for v in visitors.itertuples():
        other = _dense(v.packed)
        for name, own in held:
            gap = int(np.abs(own - other).sum())
            rows += [(name, v.source, gap), (v.source, name, gap)]
    out = pd.DataFrame(rows, columns=["source", "item", "value"])
    out.insert(0, "lang", residents["lang"].iloc[0])
    return out


def _home(residents: pd.DataFrame) -> pd.DataFrame:
    """The groups of one block against each other."""
    parts = [_meet(residents.iloc[k : k + 1], residents.iloc[k + 1 :]) for k in range(len(residents))]
    return pd.concat(parts, ignore_index=True)


def partner(block: Column, players: Column, turn: int) -> Column:
    """Whom a block meets in a round of the circle method: players is even and at least 2, rounds are 0 to players - 2. The last player stands still."""
    last = players - 1
    at = F.pmod(F.lit(turn).cast("long") - block, last)
    # the player who would meet itself meets the last one: 2 i = turn modulo the odd number last, so i = turn * (last + 1) / 2
    idle = F.pmod(F.lit(turn).cast("long") * F.floor((last + 1) / 2), last)
    return F.when(block == last, idle).when(at == block, last).otherwise(at)


def rotate(vectors: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all pairs of groups of a language, both ways, from the packed segments (lang, seg, source, block, n_blocks, packed)."""
    key, out = ["lang", "seg", "block"], "lang string, source string, item string, value long"
    parts = [cut(vectors.groupBy(*key).applyInPandas(_home, out).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))]
    players = F.col("n_blocks") + F.col("n_blocks") % 2
    most = vectors.agg(F.max(players)).first()[0] or 0
    for begin in range(0, most - 1, TOGETHER):
        meetings = None
        for turn in range(begin, min(begin + TOGETHER, most - 1)):
            met = vectors.where(F.lit(turn) < players - 1).withColumn("peer", partner(F.col("block"), players, turn))
            residents = met.where("block < peer")
            visitors = met.where("block > peer").select(*(F.col(c).alias(f"to_{k}") for c, k in (("lang", "lang"), ("seg", "seg"), ("peer", "block"))), *(F.col(c).alias(c) for c in ("source", "packed")))
            one = residents.groupBy(*key).cogroup(visitors.groupBy(*(f"to_{k}" for k in key))).applyInPandas(lambda a, b: _meet(a, b), out)
            meetings = one if meetings is None else meetings.unionByName(one)
        parts.append(cut(meetings.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, segment: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): for every group the distance of each other source of its language (part pair), and the terms it uses more than
    the language does (part term, at most top of them).

    Null texts, languages and sources are read as ''. Every row counts, repeats too. Equal values rank by item. A language without kept terms has distances 0
    and no terms; one with a single source has no pairs. An empty table gives an empty result; further columns are not looked at.
    """
    counts = cut(term_counts(docs, text, lang, source))
    known = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n")).where(F.col("docs") >= min_docs)
    sizes = known.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("lang_n"))
    kept = known.join(sizes, "lang").withColumn("n_segs", F.ceil(F.col("v") / segment).cast("long")).withColumn("seg", F.pmod(F.xxhash64("term"), F.col("n_segs")))
    inside = Window.partitionBy("lang", "seg").orderBy("term")  # about segment terms
    kept = cut(kept.select("lang", "term", "all_n", "v", "lang_n", "n_segs", "seg", (F.row_number().over(inside) - 1).cast("long").alias("idx")))
    shape = kept.groupBy("lang", "seg").agg(F.count("*").alias("size"), F.first("v").alias("v"), F.first("lang_n").alias("lang_n"))

    used = cut(counts.join(kept.select("lang", "term", "all_n", "seg", "idx"), ["lang", "term"]).select("lang", "source", "seg", "idx", "n", "all_n"))
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = counts.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").fillna(0, ["group_n"])
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # of a language's sources, a row each
    groups = groups.withColumn("block", F.floor(number / block).cast("long")).withColumn("n_blocks", F.ceil(F.count("*").over(Window.partitionBy("lang")) / block).cast("long"))
    groups = cut(groups)
    lists = used.groupBy("lang", "source", "seg").agg(F.collect_list(F.struct("idx", "n", "all_n")).alias("found"))  # at most a segment's terms
    rows = groups.join(shape, "lang").join(lists, ["lang", "source", "seg"], "left")
    rows = rows.select("lang", "seg", "source", "block", "n_blocks", "size", (F.col("group_n") + PRIOR * F.col("v")).alias("whole"), (F.col("lang_n") + PRIOR * F.col("v")).alias("lang_whole"), "found.idx", "found.n", "found.all_n")
    made = rows.mapInPandas(_vectors(top), "lang string, seg long, source string, block long, n_blocks long, packed binary, best array<struct<idx: long, value: long>>")
    vectors = cut(made.repartition("lang", "seg", "block"))

    far = rotate(vectors.drop("best"))
    bare = groups.join(sizes.select("lang"), "lang", "left_anti").select("lang", "source")
    apart = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    best = vectors.select("lang", "seg", "source", F.explode("best").alias("x")).select("lang", "seg", "source", F.col("x.idx").alias("idx"), F.col("x.value").alias("value"))
    terms = best.join(kept.select("lang", "seg", "idx", "term"), ["lang", "seg", "idx"]).select("lang", "source", F.col("term").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(far.unionByName(apart), "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= top))


_SHARE = "1 + CAST(({unit} * (CAST({n} AS HUGEINT) + {prior})) // (CAST({whole} AS HUGEINT) + {prior} * v) AS BIGINT)"


def _share(n: str, whole: str) -> str:
    return _SHARE.format(unit=UNIT, prior=PRIOR, n=n, whole=whole)


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
o AS MATERIALIZED (SELECT r, lang, source, unnest(regexp_extract_all(text, '{TERMS}')) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS all_n FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}),
s AS (SELECT lang, count(*) AS v, sum(all_n) AS lang_n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM o GROUP BY ALL),
f AS (SELECT g.lang, g.source, k.term, all_n, v, lang_n, coalesce(n, 0) AS n FROM g JOIN k USING (lang) JOIN s USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS MATERIALIZED (SELECT lang, source, term, n, {_share("n", "sum(n) OVER (PARTITION BY lang, source)")} AS p, {_share("all_n", "lang_n")} AS q FROM f),
a AS (SELECT x.lang, x.source, y.source AS item, coalesce((SELECT 1), 1) AS one FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source),
e AS (SELECT x.lang, x.source, y.source AS item, CAST(sum(abs(x.p - y.p)) AS BIGINT) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, a.item, coalesce(value, 0) AS value FROM a LEFT JOIN e ON a.lang = e.lang AND a.source = e.source AND a.item = e.item
 UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u) WHERE part = 'pair' OR rank <= {TOP}
"""

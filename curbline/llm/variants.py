"""Spelling variants: words one edit apart, found by Aho-Corasick automata over half words.

A word is cut into two segments. If another word differs by exactly one inserted, deleted or replaced code point, the edit leaves one of the segments
whole: the first at the other word's start, or the second at its end. So an automaton of all segments, run over every word, finds each near word.

Words are dealt into shards of one length and at most about SHARD words; a shard's automaton holds both segments of each of them. Every word is sent to the
shards of its own length and of one less and one more, BLOCK words at a time, so that no task holds more than a shard and a block, however many words
share a length. A match counts if its offset is the start or the end and the lengths fit; its words are then verified, many at a time, as rows of code points.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import pairwise

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbline.plans.session import cut

RUNS = "[A-Za-zÀ-ÿ]+"
#: A run whose checksum this divides loses one code point.
EVERY = 199
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A near word is a word's form if it occurs this many times as often.
DOMINANCE = 5
SHARD = BLOCK = 20_000
#: Words a task holds before it puts their counts out, and candidate pairs that are verified at once.
HELD, PAIRS = 200_000, 2_000_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def damaged_run(doc_id: str, run: str) -> str:
    """run without the code point that the checksum of id and run names, if it names one."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % EVERY:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def _tally(least_length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of words: rows of (id, text as bytes) to rows of (word, n), several for a word where a task has very many words."""

    def put(held: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, held = re.compile(RUNS).findall, Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                own = Counter(find(text.as_py().translate(_LOWER).decode()))
                start = zlib.crc32(f"{doc_id.as_py()}:".encode())
                for word, n in own.items():
                    h = zlib.crc32(word.encode(), start)
                    if not h % EVERY:
                        k = h % len(word)
                        word = word[:k] + word[k + 1 :]
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) > HELD:
                    yield put(held)
                    held = Counter()
        if held:
            yield put(held)

    return run


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    rows = docs.where(F.col(text).isNotNull()).select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.col(text).cast("string").cast("binary").alias("text"))
    counts = rows.mapInArrow(_tally(LEAST_LENGTH), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _letters(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of a and b, words of one length or of b's one longer, differ by exactly one edit."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    n = a.shape[1]
    ahead = np.logical_and.accumulate(a == b[:, :n], 1).sum(1)
    behind = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], 1).sum(1)
    return ahead + behind >= n


class Shard:
    """The automaton of the segments of words of one length."""

    def __init__(self, words: list[str]) -> None:
        self.length = len(words[0])
        self.half = self.length // 2
        self.letters = _letters(words, self.length)
        ids: dict[str, int] = {}
        heads = np.array([ids.setdefault(w[: self.half], len(ids)) for w in words])
        tails = np.array([ids.setdefault(w[self.half :], len(ids)) for w in words])
        self.sizes = np.array([len(s) for s in ids], np.int64)
        #: for each segment where its words stand in the order, once as first and once as second segment
        self.order = [np.argsort(x, kind="stable") for x in (heads, tails)]
        self.start = [np.searchsorted(x[o], np.arange(len(ids) + 1)) for x, o in zip((heads, tails), self.order, strict=True)]
        self.automaton = ahocorasick.Automaton()
        for segment, k in ids.items():
            self.automaton.add_word(segment, k)
        self.automaton.make_automaton()

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(i, j), without repeats: words[i], which are all of one length, is one edit from word j of the shard."""
        width = len(words[0])
        if abs(width - self.length) > 1:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hits = np.fromiter((x for hit in self.automaton.iter("\n".join(words)) for x in hit), np.int64).reshape(-1, 2)
        at, segment = divmod(hits[:, 0], width + 1)[1], hits[:, 1]
        asked = hits[:, 0] // (width + 1)
        fits = (at - self.sizes[segment] + 1 == 0, at == width - 1)
        i, j = [], []
        letters = _letters(words, width)
        for side in (0, 1):
            who, what = asked[fits[side]], segment[fits[side]]
            first, last = self.start[side][what], self.start[side][what + 1]
            some = last > first
            who, first, count = who[some], first[some], (last - first)[some]
            ends = np.cumsum(count)
            cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(PAIRS, ends[-1] if len(ends) else 0, PAIRS)), len(count)])
            for a, b in pairwise(cuts):
                n = count[a:b]
                left = np.repeat(who[a:b], n)
                right = self.order[side][np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[a:b], n)]
                x, y = letters[left], self.letters[right]
                ok = _one_edit(x, y) if width <= self.length else _one_edit(y, x)
                i.append(left[ok])
                j.append(right[ok])
        both = np.unique(np.stack([np.concatenate([*i, np.zeros(0, np.int64)]), np.concatenate([*j, np.zeros(0, np.int64)])], 1), axis=0)
        return both[:, 0].astype(np.int64), both[:, 1].astype(np.int64)


def _meet(asked: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
    """Of one block of words and one shard: each word that has near words there, how many, and the most frequent one (of equals the first)."""
    out = pd.DataFrame({"word": pd.Series(dtype=str), "n_near": pd.Series(dtype="int64"), "near_n": pd.Series(dtype="int64"), "near": pd.Series(dtype=str)})
    if not len(asked) or not len(shard):
        return out
    shard = shard.sort_values("word", kind="stable").sort_values("n", ascending=False, kind="stable").reset_index(drop=True)  # so that the least j is the best
    words = asked["word"].tolist()
    i, j = Shard(shard["word"].tolist()).near(words)
    if not len(i):
        return out
    first = np.r_[True, i[1:] != i[:-1]]  # pairs are sorted by i, then j
    at = np.flatnonzero(first)
    best = shard.iloc[j[at]]
    return pd.DataFrame({"word": [words[k] for k in i[at]], "n_near": np.diff(np.r_[at, len(i)]), "near_n": best["n"].to_numpy(), "near": best["word"].to_numpy()})


def near_words(words: DataFrame, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(word, n_near, near_n, near) of the words (word, n), which are distinct, that have near words: their number and the most frequent, of equals the
    first in code-point order, with its count."""
    sized = words.select("word", "n", F.length("word").alias("len"))
    counts = sized.groupBy("len").agg(F.count("*").alias("size"))  # a row a length
    parts = lambda size, of: F.ceil(size / F.lit(of)).cast("long")
    dealt = sized.join(counts, "len").withColumn("part", F.pmod(F.xxhash64("word"), parts(F.col("size"), shard))).withColumn("block", F.pmod(F.xxhash64("word", F.lit(1)), parts(F.col("size"), block)))
    asked = dealt.select("word", F.col("len").alias("own"), "block", F.explode(F.array(*(F.col("len") + k for k in (-1, 0, 1)))).alias("len")).join(counts, "len")
    asked = asked.select("word", "own", "block", "len", F.explode(F.sequence(F.lit(0).cast("long"), parts(F.col("size"), shard) - 1)).alias("part"))
    # a shard goes to every block of the three lengths that ask it
    blocks = counts.select(F.col("len").alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), parts(F.col("size"), block) - 1)).alias("block"))
    shards = dealt.select(F.col("word").alias("word"), F.col("n").alias("n"), F.col("len").alias("len"), F.col("part").alias("part"), F.explode(F.array(*(F.col("len") + k for k in (-1, 0, 1)))).alias("own")).join(blocks, "own")
    key = ["len", "part", "own", "block"]
    shards = shards.select(F.col("word").alias("word"), F.col("n").alias("n"), *(F.col(k).alias(f"to_{k}") for k in key))
    met = asked.groupBy(*key).cogroup(shards.groupBy(*(f"to_{k}" for k in key))).applyInPandas(lambda a, b: _meet(a, b), "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), "near"))
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("near_n"), F.col("b.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form): the end of each word's chain. A form is several times as frequent as its word, so chains are as long as the
    logarithm of the largest count at most and have no circles; every round doubles the steps taken."""
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("by"), F.col("root").alias("far"))
        further = cut(at.join(ahead, F.col("root") == F.col("by"), "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        at = further.select("word", "root")
        if not further.where("moved").take(1):
            return at


def group_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of docs.

    Null and empty texts have no words; ids may be null (read as empty) or repeat, each row counts. Equal counts go to the first near word in code-point order. An
    empty table gives an empty result; further columns are not looked at, whatever their names.
    """
    words = cut(word_counts(docs, doc_id, text))
    near = near_words(words, shard, block)
    rows = words.join(near, "word", "left")
    has = F.col("near_n") >= DOMINANCE * F.col("n")
    rows = cut(rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("near")).alias("form"), F.when(has, F.col("near_n")).alias("form_n")))
    ends = roots(rows.where(F.col("form").isNotNull()))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: CRC-32 with its table made by the usual eight shifts.
ORACLE = rf"""
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END, i)) AS tab),
d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents WHERE text IS NOT NULL),
o AS MATERIALIZED (SELECT doc_id, run, count(*) AS c, encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run) AS b FROM d GROUP BY doc_id, run),
h AS (SELECT run, c, xor(list_reduce(list_transform(range(octet_length(b)), lambda i: CAST(('0x' || substr(hex(b), CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT)),
 lambda a, x: xor(a >> 8, tab[CAST(xor(a & 255, x) AS BIGINT) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM o, t),
r AS (SELECT CASE WHEN h % {EVERY} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h),
w AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM r WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(c) >= {LEAST_COUNT}),
x AS MATERIALIZED (SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS s FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM w)),
p AS (SELECT a.word AS a, b.word AS b FROM x a JOIN x b ON a.s = b.s AND a.k = b.k AND a.word <> b.word UNION SELECT x.word, w.word FROM x JOIN w ON x.s = w.word UNION SELECT w.word, x.word FROM x JOIN w ON x.s = w.word),
m AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-n, b)) AS near, max(n) AS near_n FROM (SELECT DISTINCT a, b FROM p) JOIN w ON b = w.word GROUP BY a),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {DOMINANCE} * w.n THEN near END AS form, CASE WHEN near_n >= {DOMINANCE} * w.n THEN near_n END AS form_n FROM w LEFT JOIN m USING (word)),
g AS (WITH RECURSIVE g(word, root, step) AS (SELECT word, word, 0 FROM f UNION ALL SELECT g.word, f.form, step + 1 FROM g JOIN f ON g.root = f.word WHERE f.form IS NOT NULL) SELECT word, arg_max(root, step) AS root FROM g GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN g USING (word)
"""

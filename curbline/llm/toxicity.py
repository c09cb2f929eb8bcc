"""Toxic passages by maximal-scoring segments.

Weights are log-odds between labelled toxic and clean rows under an informative Dirichlet prior (Monroe et al.,
2008), of words and of the stems (prefixes) of words: a word whose own log-odds are not significant weighs as its longest
significant stem, so that inflections never seen in training count too, and otherwise nothing. Counts are of rows that hold
a word, so one row that repeats it many times is one. The prior's mass is PRIOR times the counts it is read from: a word that
only toxic rows use keeps a prior count in clean rows in proportion to how often it was seen, whatever the corpus' size. Every
token pays a constant drift, so that random text has a negative expected score. One linear scan (Ruzzo and Tompa, 1999) finds all maximal-scoring segments of a
text. A segment's significance is its extreme-value (Karlin-Altschul) expectation E = K n exp(-lambda S): lambda solves
the moment equation of the clean score distribution, K is calibrated on the clean training rows. The significant
segments' -ln E are summed over the document, and a logistic curve fitted on the training rows turns the sum into a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbline.plans.session import cut

TOKEN = re.compile(r"[^\W\d_]+")

#: Labelled rows the model learns from, at most about this many; all documents count as long as there are fewer.
TRAIN_ROWS = 20_000
#: Mass of the prior as a share of all counts, least count of a word or stem, least |z| and least size of its log-odds.
#: Chosen on training rows alone (fitted on three fifths of them by id, compared on another fifth), never on held-out ones.
PRIOR, LEAST, Z, ODDS = 0.1, 5, 3.5, 1.0
DRIFT, CAP = 0.15, 8.0
#: Lengths of stems in characters.
STEM = range(4, 13)
#: A segment counts if its expectation in clean text is below this.
SIGNIFICANT = 0.5


def tokens_of(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def units(token: str) -> Iterator[str]:
    """What a token is looked up as, in order: the whole word, then its stems from the longest."""
    yield "=" + token
    for k in range(min(STEM[-1], len(token)), STEM[0] - 1, -1):
        yield token[:k]


def _units(token: Column) -> Column:
    """units() as an array column."""
    longest = F.least(F.lit(STEM[-1]), F.length(token))
    stems = F.when(longest >= STEM[0], F.sequence(F.lit(STEM[0]), longest)).otherwise(F.array().cast("array<int>"))
    return F.concat(F.array(F.concat(F.lit("="), token)), F.transform(stems, lambda k: F.substring(token, F.lit(1), k)))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) in order; linear in the length."""
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    prefix = np.concatenate(([0.0], np.cumsum(scores)))
    # start, end, total before it, total after it, and the last segment before it with a lower total before it: those between are passed over at once
    held: list[tuple[int, int, float, float, int]] = []
    for i in positive.tolist():
        start, end, low, high, j = i, i + 1, prefix[i], prefix[i + 1], len(held) - 1
        while True:
            while j >= 0 and held[j][2] >= low:
                j = held[j][4]
            if j < 0 or held[j][3] >= high:
                held.append((start, end, low, high, j))
                break
            start, _, low, _, further = held[j]
            del held[j:]
            j = further
    return [(a, b, float(high - low)) for a, b, low, high, _ in held]


@dataclass
class Model:
    weights: dict[str, float]
    drift: float
    lam: float
    k: float
    intercept: float = -4.0
    slope: float = 1.0
    _seen: dict[str, float] = field(default_factory=dict, repr=False)

    def weight(self, token: str) -> float:
        found = self._seen.get(token)
        if found is None:
            found = next((self.weights[u] for u in units(token) if u in self.weights), 0.0)
            if len(self._seen) > 200_000:
                self._seen.clear()
            if len(token) <= 32:
                self._seen[token] = found
        return found

    def scores(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.weight, tokens), float, len(tokens)) - self.drift

    def segments(self, tokens: list[str]) -> list[tuple[int, int, float, float]]:
        """Significant segments as (first token, token after the last, score, E)."""
        if not tokens or not self.weights:
            return []
        scores = self.scores(tokens)
        found = [(a, b, s, self.k * len(tokens) * math.exp(-self.lam * s)) for a, b, s in maximal_segments(scores)]
        return [x for x in found if x[3] < SIGNIFICANT]

    def evidence(self, tokens: list[str]) -> float:
        return sum(-math.log(max(x[3], 1e-12) / SIGNIFICANT) for x in self.segments(tokens))

    def score(self, tokens: list[str]) -> float:
        x = self.intercept + self.slope * math.log1p(self.evidence(tokens))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def _lambda(weights: list[float], shares: list[float], drift: float) -> float:
    """The positive root of sum p exp(lambda s) = 1; tokens without a weight score -drift."""
    rest = max(1e-9, 1 - sum(shares))
    f = lambda t: sum(p * math.exp(t * (w - drift)) for w, p in zip(weights, shares, strict=True)) + rest * math.exp(-t * drift) - 1
    low, high = 1e-6, 1e-6
    while f(high) < 0 and high < 20:
        low, high = high, high * 1.5
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Intercept and slope by Newton steps; the ridge keeps separable data finite."""
    design, beta = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    penalty = np.diag([1e-3, ridge * 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + penalty, design.T @ (y - p) - penalty @ beta)
        beta += step
        if abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, holdout_mod: int, holdout: int, most: int) -> DataFrame:
    """(text, y) of labelled rows outside the held-out share: all, or about most of them by a hash of the id.

    Repeated label rows of one id count once, as toxic if any says so; labels other than 0 and 1 are left out.
    """
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("y"))
    known = known.where(F.col("id").isNotNull() & (F.crc32(F.col("id").cast("string")) % holdout_mod != holdout))
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * most / n))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    # ids and labels of the training rows are bounded by most, whatever the corpus: texts stay where they are
    return rows.join(F.broadcast(known), "id").select("text", "y")


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
          holdout_mod: int = 5, holdout: int = 0, most: int = TRAIN_ROWS) -> Model:
    """Fits weights, extreme-value constants and the logistic curve. Without both labels the score is the label's share."""
    rows = training_rows(docs, labels, doc_id, text, label, holdout_mod, holdout, most)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, list[int]] = {}
            for x, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for token in set(tokens_of(x.as_py())):
                    held.setdefault(token, [0, 0])[y] += 1
            clean, toxic = zip(*held.values(), strict=True) if held else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(clean, pa.int64()), pa.array(toxic, pa.int64())], names=["token", "y0", "y1"])

    both = F.sum("y0").alias("y0"), F.sum("y1").alias("y1")
    counts = cut(rows.mapInArrow(count, "token string, y0 long, y1 long").groupBy("token").agg(*both))
    sums = counts.agg(F.sum("y0").alias("n0"), F.sum("y1").alias("n1")).first()
    n0, n1 = float(sums["n0"] or 0), float(sums["n1"] or 0)
    if not n0 or not n1:
        share = rows.agg(F.avg("y")).first()[0] or 0.0
        edge = min(max(share, 1e-3), 1 - 1e-3)
        return Model({}, DRIFT, 1.0, 1.0, math.log(edge / (1 - edge)), 0.0)
    held = counts.select(F.explode(_units(F.col("token"))).alias("unit"), "y0", "y1").groupBy("unit").agg(*both)
    mass = PRIOR * (n0 + n1)
    prior = F.lit(PRIOR) * (F.col("y0") + F.col("y1"))
    a, b = F.col("y1") + prior, F.col("y0") + prior
    odds = F.log(a / F.greatest(n1 + mass - a, F.lit(0.5))) - F.log(b / F.greatest(n0 + mass - b, F.lit(0.5)))
    told = held.where(F.col("y0") + F.col("y1") >= LEAST).select("unit", odds.alias("odds"), (odds / F.sqrt(1 / a + 1 / b)).alias("z"))
    kept = told.where((F.abs("z") >= Z) & (F.abs("odds") >= ODDS)).collect()  # bounded by the training rows
    model = Model({r.unit: max(-CAP, min(CAP, r.odds)) for r in kept}, DRIFT, 1.0, 0.1)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [round(model.weight(t), 2) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(weights, pa.float64()), *batch.columns[1:]], names=["w", "y0", "y1"])

    # how often clean rows draw each weight, by the same prior; a row a rounded weight
    drawn = counts.mapInArrow(weigh, "w double, y0 long, y1 long").groupBy("w").agg((F.sum("y0") + F.lit(PRIOR) * F.sum(F.col("y0") + F.col("y1"))).alias("p")).collect()
    model.lam = _lambda([r.w for r in drawn if r.w], [r.p / (n0 + mass) for r in drawn if r.w], DRIFT)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, scores = [], []
            for x in batch.column(0):
                tokens = tokens_of(x.as_py())
                lengths.append(len(tokens))
                scores.append([s for _, _, s in maximal_segments(model.scores(tokens))])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(lengths, pa.int64()), pa.array(scores, pa.list_(pa.float64()))], names=["y", "n", "s"])

    seen = cut(rows.mapInArrow(measure, "y int, n long, s array<double>"))
    clean = seen.where("y = 0")
    total, pieces = clean.agg(F.sum("n")).first()[0] or 0, clean.select(F.explode("s").alias("s"))
    middle = pieces.agg(F.percentile("s", 0.5)).first()[0] or 0.0
    above = pieces.where(F.col("s") >= middle).count() + 1
    model.k = min(1.0, above / (max(total, 1) * math.exp(-model.lam * middle)))
    expected = lambda s: F.greatest(F.lit(model.k) * F.col("n") * F.exp(F.lit(-model.lam) * s), F.lit(1e-12))
    evidence = F.aggregate("s", F.lit(0.0), lambda t, s: t + F.greatest(F.lit(0.0), -F.log(expected(s) / SIGNIFICANT)))
    points = np.array([(r.x, r.y) for r in seen.select(F.log1p(evidence).alias("x"), "y").collect()], float)  # two numbers a training row
    model.intercept, model.slope = _logistic(points[:, 0], points[:, 1])
    return model


def score_documents(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", holdout_mod: int = 5, holdout: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted, n_segments and segments (token ranges, scores, expectations) of every row.

    Null and empty texts have no segment and get the score of no evidence. Rows are scored one by one: repeated rows and null ids
    stay (a null id is not held out), an empty table gives an empty result, other columns are not looked at.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    segment = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("e", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, segments = [], []
            for x in batch.column(1):
                tokens = tokens_of(x.as_py())
                found = model.segments(tokens)
                scores.append(model.score(tokens) if found else blank)
                segments.append([{"start": a, "end": b, "score": s, "e": e} for a, b, s, e in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(segments, pa.list_(segment))], names=["doc_id", "score", "segments"])

    blank = model.score([])
    scored = rows.mapInArrow(run, f"doc_id {id_type}, score double, segments array<struct<start:long,end:long,score:double,e:double>>")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % holdout_mod == holdout, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("segments").alias("n_segments"), "segments")

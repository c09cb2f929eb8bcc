"""Exact top-k by inner product with M-tree best-first search.

With M the largest norm, the vectors (x, sqrt(M^2 - |x|^2)) and the query (q, 0) have squared distance
|q|^2 + M^2 - 2 q.x, so the largest inner products are the nearest neighbours of a metric space, searched with an M-tree (Ciaccia,
Patella and Zezula, 1997). Its root level has a routing vector for every SUBTREE vectors, at most ROOTS, sampled from them; a vector
belongs to the nearest. Below that a cell is cut into subtrees of SUBTREE vectors by their stored distance to the routing vector, so a subtree is a ring
with a least and a greatest parent distance; below that there are pages, each with a routing vector, its covering radius and the distance of its every
entry to the routing vector and of that to the subtree's root. Equal vectors lie in one ring each of as many subtrees as they fill.

A query visits subtrees in the order of the least distance their ring allows: first its best one, then FIRST more, then all the rest, and
each time only those that may still hold a nearer vector than its k-th so far. Inside a subtree it visits pages best-first by d(q, p) - r, and inside a page
computes only entries whose stored distance passes |d(q, p) - d(p, x)| <= the k-th distance so far. A task gets one subtree and at most about BLOCK of the
queries that visit it; a subtree is copied only for as many blocks as there are.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curbline.operators.ordered import numbered
from curbline.plans.session import cut

#: ROOTS bounds what is broadcast of the root level: that many vectors.
ROOTS, SUBTREE, PAGE, BLOCK, FIRST = 4096, 4096, 256, 1024, 4


#: Distances that a task computes at once: rows of a step times routing vectors.
CELLS = 4_000_000


def _slack(top: float) -> float:
    """More than any computed distance can be off: squares up to some times top are subtracted, so that a small distance carries the square root of their
    rounding error."""
    return 1e-6 * (1 + float(np.sqrt(top)))


def scaled(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id long, v array<long>) of the usable rows, one an id: the least vector, if rows repeat an id.

    Left out: null ids, null or empty vectors, and vectors holding null or non-finite components.
    """
    x = F.col(embedding).cast("array<double>")
    usable = F.size(x).__gt__(0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    kept = rows.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).where(usable)
    kept = kept.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))
    return kept.groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    """Rows as float64, which holds these integers exactly; shorter vectors end in zeros."""
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _lift(x: np.ndarray, top: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0.0))])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T, 0.0))


def _steps(n: int, pivots: np.ndarray) -> Iterator[slice]:
    """Slices of n rows whose distances to the pivots are at most CELLS."""
    step = max(1, CELLS // len(pivots))
    return (slice(i, i + step) for i in range(0, n, step))


class Rings:
    """The subtrees as rings around the cells' routing vectors, sorted by cell: a cell's widest bounds tell whether its rings are looked at."""

    def __init__(self, cell_of: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.cell_of, self.low, self.high = cell_of, low, high
        self.begin = np.flatnonzero(np.r_[True, cell_of[1:] != cell_of[:-1]])
        self.size = np.diff(np.r_[self.begin, len(cell_of)])
        self.cells = cell_of[self.begin]
        self.cell_low, self.cell_high = np.minimum.reduceat(low, self.begin), np.maximum.reduceat(high, self.begin)

    def near(self, d: np.ndarray, bound: float, seen: np.ndarray, most: int | None) -> np.ndarray:
        """Of a query at distances d from the routing vectors the rings, nearest first, that may hold something within bound, but for those seen."""
        least = lambda at, low, high: np.maximum(np.maximum(at - high, low - at), 0.0)
        held = np.flatnonzero(least(d[self.cells], self.cell_low, self.cell_high) <= bound)
        n = self.size[held]
        rings = np.arange(n.sum()) + np.repeat(self.begin[held] - np.cumsum(n) + n, n)
        far = least(d[self.cell_of[rings]], self.low[rings], self.high[rings])
        ok = far <= bound
        if len(seen):
            ok &= ~np.isin(rings, seen)
        rings, far = rings[ok], far[ok]
        return rings[np.argsort(far, kind="stable")][:most].astype("int32")


class MTree:
    """One subtree: pages of entries under routing vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, top: float, root: np.ndarray, page: int = PAGE) -> None:
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        lifted = _lift(x, top)
        routing = lifted[np.unique(np.linspace(0, len(ids) - 1, -(-len(ids) // page)).astype(int))]
        own = np.concatenate([_distances(lifted[i : i + 1024], routing).argmin(axis=1) for i in range(0, len(ids), 1024)])
        self.pages = []
        for r in np.unique(own):
            held = np.flatnonzero(own == r)
            for part in np.array_split(held, -(-len(held) // page)):  # equal vectors overflow into further pages
                d = _distances(lifted[part], routing[r : r + 1])[:, 0]
                by = np.argsort(d, kind="stable")
                self.pages.append((ids[part][by], x[part][by], d[by]))
        self.routing = np.stack([routing[r] for r in np.unique(own) for _ in range(-(-int((own == r).sum()) // page))])
        self.radius = np.array([p[2].max() for p in self.pages])
        self.to_root = _distances(self.routing, root[None, :])[:, 0]

    def search(self, q: np.ndarray, q_id: int, top: float, to_root: float, k: int, bound: float) -> list[tuple[int, int]]:
        """The best (score, vec_id) here, by score and then smaller id; none farther than bound."""
        best: list[tuple[int, int]] = []
        slack = _slack(top)
        q2, bound = float(q @ q) + top, bound + slack
        # stored distances first: only pages that pass them get a distance of their own
        near = np.flatnonzero(np.abs(to_root - self.to_root) - self.radius <= bound)
        if not len(near):
            return best
        lifted = np.append(q, 0.0)
        diff = self.routing[near] - lifted
        d = np.sqrt((diff * diff).sum(axis=1))
        for low, at, dp in sorted(zip((d - self.radius[near]).tolist(), near.tolist(), d.tolist(), strict=True)):
            if low > bound:
                break
            ids, x, stored = self.pages[at]
            a, b = np.searchsorted(stored, [dp - bound, dp + bound + slack]) if bound < np.inf else (0, len(ids))
            if a >= b:
                continue
            scores = x[a:b] @ q
            if len(best) == k:
                keep = np.flatnonzero(scores >= best[-1][0])
            else:
                keep = np.arange(b - a)
            if len(keep) > k + 1:
                least = np.partition(scores[keep], -(k + 1))[-(k + 1)]
                keep = keep[scores[keep] >= least]
            if len(keep):
                found = [(int(s), int(i)) for s, i in zip(scores[keep], ids[a:b][keep], strict=True) if i != q_id]
                best = sorted([*best, *found], key=lambda t: (-t[0], t[1]))[:k]
                if len(best) == k:
                    bound = min(bound, np.sqrt(max(q2 - 2 * best[-1][0], 0.0)) + slack)
        return best


def top_k(rows: DataFrame, every: int = 50, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding",
          roots: int = ROOTS, subtree: int = SUBTREE, page: int = PAGE, block: int = BLOCK, first: int = FIRST) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other vectors of every query, the rows whose id is divisible by every.

    Equal scores go to the smaller id. A query with fewer than k other vectors gets them all; an empty table gives nothing. Vectors
    of different lengths are compared as if the shorter ended in zeros. Other columns, whatever their names, are not looked at.
    """
    spark = rows.sparkSession
    vectors = cut(scaled(rows, vec_id, embedding))
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda a, c: a + c * c)
    stats = vectors.agg(F.count("*").alias("n"), F.max(norm).alias("top"), F.max(F.size("v")).alias("dim"), F.count_if(F.col("vec_id") % every == 0).alias("queries")).first()
    if not stats.n or not stats.queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n, top, dim, slack = stats.n, float(stats.top), stats.dim, _slack(float(stats.top))
    picked = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(roots, n // subtree))).toPandas()  # at most ROOTS
    pivots = np.unique(_lift(_matrix(picked["v"], dim), top), axis=0)

    def to_cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for rows in _steps(len(pdf), pivots):
                part = pdf.iloc[rows]
                d = _distances(_lift(_matrix(part["v"], dim), top), pivots)
                yield part.assign(cell=d.argmin(axis=1).astype("int32"), far=d.min(axis=1))

    placed = numbered(vectors.mapInPandas(to_cells, "vec_id long, v array<long>, cell int, far double"), ("cell", "far", "vec_id"), "number")
    starts = placed.groupBy("cell").agg(F.min("number").alias("begin"))  # at most ROOTS rows
    part = F.floor((F.col("number") - F.col("begin")) / subtree).cast("int")
    dealt = placed.join(F.broadcast(starts), "cell").select("vec_id", "v", "cell", part.alias("part"), "far")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        cell = int(pdf["cell"].iloc[0])
        own = MTree(pdf["vec_id"].to_numpy(np.int64), _matrix(pdf["v"], dim), top, pivots[cell], page)
        return pd.DataFrame({"cell": [cell], "part": [int(pdf["part"].iloc[0])], "low": [pdf["far"].min()], "high": [pdf["far"].max()], "tree": [pickle.dumps(own)]})

    trees = cut(dealt.groupBy("cell", "part").applyInPandas(build, "cell int, part int, low double, high double, tree binary"))
    rings = trees.select("cell", "part", "low", "high").orderBy("cell", "part").toPandas()  # three numbers for every SUBTREE vectors
    cell_of = rings["cell"].to_numpy()
    shape = Rings(cell_of, rings["low"].to_numpy(), rings["high"].to_numpy())
    index = spark.createDataFrame([(int(c), int(p), i) for i, (c, p) in enumerate(zip(rings["cell"], rings["part"], strict=True))], "cell int, part int, node int")
    trees = trees.join(F.broadcast(index), ["cell", "part"]).select("node", "tree")

    def plan(most: int | None):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                todo = []
                for rows in _steps(len(pdf), pivots):
                    part = pdf.iloc[rows]
                    d = _distances(np.column_stack([_matrix(part["v"], dim), np.zeros(len(part))]), pivots)
                    todo += [shape.near(d[i], min(bound + slack, np.finfo(float).max), np.asarray(seen, np.int64), most) for i, (bound, seen) in enumerate(zip(part["bound"], part["seen"], strict=True))]
                yield pdf.assign(todo=todo)

        return run

    def look(key: tuple, queries: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or found.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        own, root, rows = pickle.loads(found["tree"].iloc[0]), pivots[cell_of[int(key[0])]], []
        q = _matrix(queries["v"], dim)
        to_root = _distances(np.column_stack([q, np.zeros(len(q))]), root[None, :])[:, 0]
        for i, (q_id, bound) in enumerate(zip(queries["query_id"].tolist(), queries["bound"].tolist(), strict=True)):
            rows += [(q_id, v, s) for s, v in own.search(q[i], q_id, top, to_root[i], k, bound)]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    def visit(planned: DataFrame) -> DataFrame:
        sent = planned.select("query_id", "v", "bound", F.explode("todo").alias("node"))
        blocks = sent.groupBy("node").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))  # at most a row a subtree
        sent = sent.join(F.broadcast(blocks), "node").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
        wanted = blocks.select(F.col("node").alias("at"), F.col("blocks").alias("n"))
        copies = trees.join(F.broadcast(wanted), F.col("node") == F.col("at")).select(F.col("at").alias("tree_node"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("tree_block"), "tree")
        return sent.groupBy("node", "block").cogroup(copies.groupBy("tree_node", "tree_block")).applyInPandas(look, "query_id long, vec_id long, score long")

    q2 = F.aggregate("v", F.lit(0).cast("long"), lambda a, c: a + c * c)
    state = placed.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v", F.lit(float("inf")).alias("bound"), F.array().cast("array<int>").alias("seen"))
    order, best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"), None
    for most in (1, first, None):
        planned = cut(state.mapInPandas(plan(most), "query_id long, v array<long>, bound double, seen array<int>, todo array<int>"))
        found = visit(planned)
        found = found if best is None else best.select("query_id", "vec_id", "score").unionByName(found)
        best = cut(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        kth = best.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
        bound = F.when(F.col("kth").isNotNull(), F.sqrt(F.greatest(q2 + top - 2 * F.col("kth"), F.lit(0.0)))).otherwise(float("inf"))
        state = planned.join(kth, "query_id", "left").select("query_id", "v", bound.alias("bound"), F.concat("seen", "todo").alias("seen"))
    return best.select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(256 * x) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""

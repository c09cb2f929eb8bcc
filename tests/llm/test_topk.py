import math
import tracemalloc

import numpy as np
import pytest

from curbline.llm import topk
from curbline.llm.topk import top_k


def brute(rows, every=50, k=5):
    vs = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in vs:
        if q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(vs[q], vs[c])), c) for c in vs if c != q)[:k]
            out += [(q, r + 1, c, -x) for r, (x, c) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"subtree": 64, "page": 8, "block": 3, "first": 2}, {"roots": 1, "subtree": 100, "page": 4}])
def test_against_all_pairs(spark, options):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 12))
    rows = [(i, (centres[i % 6] + 0.3 * rng.normal(size=12)).tolist()) for i in range(700)]
    rows += [(2000 + i, rows[0][1]) for i in range(150)]  # one very common vector
    rows += [(3000, None), (3050, [1.0, None] + [0.0] * 10), (3100, [float("nan")] * 12), (None, [1.0] * 12), (3150, [float("inf")] * 12), (50, rows[50][1]), (3200, [])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, cell int")
    assert sorted(tuple(r) for r in top_k(frame, **options).collect()) == brute(rows)


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    few = [(0, [1.0, 2.0]), (7, [0.5, 0.5]), (50, [0.0, 0.0])]
    assert sorted(tuple(r) for r in top_k(spark.createDataFrame(few, schema)).collect()) == brute(few)
    assert top_k(spark.createDataFrame([(0, [1.0])], schema)).count() == 0
    assert top_k(spark.createDataFrame([], schema)).count() == 0


def test_clusters_far_apart(spark):
    """Rings of far clusters cannot hold a nearer vector; results are whole all the same."""
    rng = np.random.default_rng(2)
    rows = []
    for c in range(8):
        centre = np.zeros(8)
        centre[c] = 40.0
        rows += [(1000 * c + i, (centre + rng.normal(size=8) * 0.1).tolist()) for i in range(200)]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, node int, bound int")
    assert sorted(tuple(r) for r in top_k(frame, every=25, subtree=50, page=10).collect()) == brute(rows, 25)


def test_planning_is_bounded(monkeypatch):
    """10 000 queries against 24 000 rings of 4 096 cells; and rings as by computing all of them."""
    rng = np.random.default_rng(3)
    pivots = rng.normal(size=(4096, 16))
    cells = np.sort(np.r_[np.arange(4096), rng.integers(0, 4096, 19_904)])
    low = np.abs(rng.normal(size=24_000)) * 3
    rings = topk.Rings(cells, low, low + 0.1)
    queries = rng.normal(size=(10_000, 16))
    tracemalloc.start()
    found = []
    for rows in topk._steps(len(queries), pivots):
        d = topk._distances(queries[rows], pivots)
        found += [rings.near(x, 0.5 if i % 2 else np.inf, np.array([5, 7]) if i % 3 else np.zeros(0, np.int64), 5) for i, x in enumerate(d[:200])]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500e6 and len(found) > 1000
    d = topk._distances(queries[:50], pivots)
    for i, x in enumerate(d):
        bound, seen = (0.4, np.array([3, 900])) if i % 2 else (np.inf, np.zeros(0, np.int64))
        least = np.maximum(np.maximum(x[cells] - (low + 0.1), low - x[cells]), 0.0)
        least[seen] = np.inf
        near = np.flatnonzero(least <= min(bound, np.finfo(float).max))
        assert (rings.near(x, min(bound, np.finfo(float).max), seen, 9) == near[np.argsort(least[near], kind="stable")][:9]).all()

import math
from collections import defaultdict

import numpy as np
import pytest

from curbline.plans import curation, tracks
from tests.test_operators import plain_greedy

CLASSES = ("view", "click", "signup", "purchase", "error")


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Crowded images of all classes, and user 9 with truth (even events) only."""
    rng, d = np.random.default_rng(5), str(tmp_path_factory.mktemp("plans"))
    rows = [(i, int(rng.integers(1, 4)), CLASSES[int(rng.integers(0, 3))], float(rng.integers(1, 400))) for i in range(600)]
    rows += [(i, 9, CLASSES[3 + i % 4 // 2], 50.0) for i in range(600, 630, 2)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{d}/events.parquet")
    return d, rows


def boxes_of(rows):
    """(image, class): the predictions (idx, conf, box) and the truths (idx, box), as views.BOXES has them."""
    groups = defaultdict(lambda: ([], []))
    for i, user, cls, value in rows:
        x1, y1 = ((i * 31) % 50) / 100, ((i * 17) % 50) / 100
        box = (x1, y1, x1 + 0.05 + ((i * 7) % 40) / 100, y1 + 0.05 + ((i * 11) % 40) / 100)
        preds, truth = groups[user * 100 + i % 3, cls]
        preds.append((i, min(value / 500, 1.0), box)) if i % 2 else truth.append((i, box))
    return groups


def plain_ap50(rows):
    """As the reference: all-point area, one greedy match a truth within its class."""
    scored, n_gt = defaultdict(list), defaultdict(int)
    for (_, cls), (preds, truth) in boxes_of(rows).items():
        held = plain_greedy(preds, truth)
        scored[cls] += [(-conf, i, i in held) for i, conf, _ in preds]
        n_gt[cls] += len(truth)
    out = {}
    for cls, n in n_gt.items():
        tp, points = 0, []
        for k, (_, _, hit) in enumerate(sorted(scored[cls]), 1):
            tp += hit
            points.append((hit, tp / k))
        out[cls] = sum(max(p for _, p in points[k:]) for k, (hit, _) in enumerate(points) if hit) / n
    return out, n_gt


def test_ap50_is_of_greedy_matches(spark, events):
    d, rows = events
    want, n_gt = plain_ap50(rows)
    got = {r.cls: r for r in curation.ap50(spark, d).collect()}
    assert set(got) == set(want) and all(got[c].n_gt == n_gt[c] and math.isclose(got[c].ap50, want[c], abs_tol=1e-6) for c in want)
    coarse = {r.coarse: r for r in curation.coarse_mean_ap(spark, d).collect()}
    assert math.isclose(coarse["seen"].mean_ap50, (want["view"] + want["click"]) / 2, abs_tol=1e-6) and coarse["seen"].n_classes == 2


def test_recall_is_of_greedy_matches_and_all_truth(spark, events):
    d, rows = events
    n_gt, held = defaultdict(int), defaultdict(int)
    size = lambda b: (b[2] - b[0]) * (b[3] - b[1]) / 4
    large = lambda b: size(b) >= 0.02
    n_large = defaultdict(int)
    for (_, cls), (preds, truth) in boxes_of(rows).items():
        taken = set(plain_greedy(preds, truth).values())
        n_gt[cls] += len(truth)
        n_large[cls] += sum(large(b) for _, b in truth)
        held[cls] += sum(large(b) for j, b in truth if j in taken)
    got = {r.cls: r for r in curation.recall_by_bucket(spark, d).collect()}
    assert {c: r.n_gt for c, r in got.items()} == dict(n_gt)
    for c, r in got.items():
        assert math.isclose(r.recall_large, held[c] / n_large[c], abs_tol=1e-6)


def test_truth_of_images_without_predictions_is_uncovered(spark, events):
    d, rows = events
    got = {r.gt: r.iou for r in curation.uncovered_truth(spark, d).collect()}
    alone = {i for i, user, _, _ in rows if user == 9}
    assert alone <= set(got) and all(got[i] == 0 for i in alone)
    assert not alone & {r.gt for r in curation.best_iou_mismatch(spark, d).collect()}


def test_review_queue_is_whole(spark, monkeypatch):
    rows = [(i, "class_mismatch" if i % 3 == 0 else None, i % 7 / 10, i % 5 > 0) for i in range(100)]
    found = spark.createDataFrame(rows, "cluster_id long, discrepancy_type string, confidence double, needs_review boolean")
    monkeypatch.setattr(tracks, "_reconciled", lambda spark, d: found)
    want = sorted((r for r in rows if r[3]), key=lambda r: (r[1] is None, r[2], r[0]))
    assert [tuple(r) for r in tracks.review_queue(spark, "").collect()] == [r[:2] for r in want]

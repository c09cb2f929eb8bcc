import itertools
import math

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from curbline.functions import box as B
from curbline.functions import classify, geo
from curbline.functions import text as T
from curbline.operators import clusters, components, curate, evaluate, quality, reconcile, review, sample, temporal
from curbline.operators.components import _part_forests, components_by_parts, connected_components


def one(spark, **columns):
    return [tuple(r) for r in spark.range(1).select(*(c.alias(k) for k, c in columns.items())).collect()][0]


def test_interpolation_cases(spark):
    fixes = spark.createDataFrame([("v", 1000.0, 38.123456, -81.234567, 245.0), ("v", 2000.0, 38.123478, -81.234589, 245.0), ("v", 3000.0, 38.1235, -81.234611, None)], "video_id string, ts_ms double, lat double, lon double, alt double")
    asked = [1500.0, 6000.0, 5000.0, 5001.0, -1000.0, -1001.0, 2000.0, 2500.0]
    frames = spark.createDataFrame([("v", t) for t in asked] + [("w", 1.0)], "video_id string, ts_ms double")
    got = {(r.video_id, r.ts_ms): r for r in temporal.interpolate_track(frames, fixes).collect()}
    assert abs(got["v", 1500.0].lat - 38.123467) < 1e-9 and got["v", 1500.0].alt == 245.0
    assert [got["v", t].lat for t in asked[1:6]] == [None, 38.1235, None, 38.123456, None]
    assert got["v", 2000.0].lat == 38.123478 and got["v", 2500.0].alt is None and got["w", 1.0].lat is None


def test_sessions(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 5000), ("a", 10001), ("b", 7)], "video string, ts long")
    got = temporal.global_session_ids(temporal.gap_sessions(rows, "video", "ts", 5000), "video").orderBy("video", "ts").collect()
    assert [r.cluster_id for r in got] == ["a_c0", "a_c0", "a_c1", "b_c2"]


def test_frame_grid_and_repeats(spark):
    videos = spark.createDataFrame([("v", 1000.0)], "video_id string, duration_ms double")
    assert [r.ts_ms for r in temporal.frame_grid(videos, 2).orderBy("frame_no").collect()] == [0.0, 500.0, 1000.0]
    rows = spark.createDataFrame([("v", i, v) for i, v in enumerate([1.0, 1.2, 1.4, 1.6, 5.0, 5.1])], "video string, ts int, value double")
    assert [r.ts for r in temporal.suppress_repeats(rows, "video", "ts", "value", 0.5).orderBy("ts").collect()] == [0, 3, 4]
    losses = spark.createDataFrame([("r", i, v) for i, v in enumerate([3.0, 2.0, 2.0, 2.0, 1.0])], "run string, step int, loss double")
    assert temporal.early_stop(losses, "run", "step", "loss", patience=2).first().stop_step == 3


def test_nearest_frame_prefers_exact_then_before(spark):
    frames = spark.createDataFrame([("v", 999), ("v", 1001), ("v", 5000)], "v string, ft long")
    asked = spark.createDataFrame([("v", 1000), ("v", 5300), ("v", 5301), ("v", 5000)], "v string, ts long")
    assert {r.ts: r.ft for r in temporal.nearest_frame(asked, frames, "v", "ts", "ft").collect()} == {1000: 999, 5300: 5000, 5000: 5000}


def test_scalars(spark):
    d = one(spark, d=geo.haversine_m(F.lit(38.0), F.lit(-81.0), F.lit(39.0), F.lit(-81.0)))[0]
    assert 110000 < d < 112000
    box = lambda *v: B.box(*(F.lit(float(x)) for x in v))
    assert abs(one(spark, i=B.iou(box(0, 0, 0.5, 0.5), box(0.25, 0.25, 0.75, 0.75)))[0] - 1 / 7) < 1e-12
    assert one(spark, **{n: B.size_bucket(F.lit(a)) for n, a in zip("abcd", (0.0009, 0.001, 0.005, 0.02))}) == ("tiny", "small", "medium", "large")
    codes = ["R1-1", "R2-1", "R10-6", "W1-2", "W10-1", "D10-3", "M1-4", "D1-1", "OTR"]
    want = ("StopSigns", "SpeedLimits", "TrafficLights", "Curves", "Curves", "MileMarkers", "HighwaySymbols", "Informational", "Informational")
    assert one(spark, **{f"c{i}": classify.normalize_sign_class(F.lit(c), F.lit("")) for i, c in enumerate(codes)}) == want
    assert one(spark, a=classify.normalize_sign_class(F.lit("W10-1"), F.lit("WARNING"), True), b=classify.normalize_sign_class(F.lit(None).cast("string"), F.lit("GUIDE-ROUTE SIGN")), c=classify.normalize_sign_class(F.lit("R1-2"), F.lit("Regulatory"))) == ("Warnings", "HighwaySymbols", "Regulatory")
    assert one(spark, a=T.coordinate(F.lit("39.28 N")), b=T.coordinate(F.lit("80.96 W")), c=T.coordinate(F.lit("-80.96")), d=T.leading_number(F.lit("273.3 m"))) == (39.28, -80.96, -80.96, 273.3)
    name = F.lit("010d0e11__foo%5Ccandidates%5C30055_000114.txt")
    assert one(spark, a=T.label_stem(name), b=T.label_path(name)["folder"], c=T.label_path(name)["stem"]) == ("30055_000114", "foo", "candidates\\30055_000114")
    assert one(spark, **{f"x{i}": f(F.lit(s)) for i, (f, s) in enumerate(itertools.product((T.stem_video, T.stem_number), ("13892_5000", "abc", "a_b")))}) == ("13892", "abc", "a", 5000, None, None)
    assert one(spark, a=T.url_filename(F.lit("https://example.com/o/a%20b+c.mp4?x=1")), b=T.path_slug(F.lit("a/b\\c")), c=T.frame_id(F.lit("/frame/12/x")), d=T.inventory_class(F.lit("(inventory Curves)"))) == ("a b+c.mp4", "a__b__c", 12, "Curves")
    fine = [("regulatory--stop--g1", 0), ("regulatory--stop-here-on-red--g1", 4), ("warning--x", 2), ("regulatory--minimum-speed-limit-30", 3)]
    assert one(spark, **{f"f{i}": classify.by_prefix(F.lit(n), classify.COARSE_RULES, classify.COARSE_DEFAULT) for i, (n, _) in enumerate(fine)}) == tuple(c for _, c in fine)
    assert one(spark, n=F.size(B.grid_cells(F.lit(100), F.lit(50), 40)))[0] == 6


@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
@settings(max_examples=8, deadline=None)
def test_components_are_an_equivalence(spark, edges):
    root = list(range(26))
    for a, b in edges:
        ra, rb = root[a], root[b]
        root = [min(ra, rb) if r in (ra, rb) else r for r in root]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root[x] for x in touched}


def _dets(spark, rows):
    return spark.createDataFrame([(i, v, c, conf, 38.0 + m / 111320, -81.0, 1000 * i) for i, (v, c, conf, m) in enumerate(rows)], "det_idx long, video_id long, class_name string, confidence double, lat double, lon double, frame_ts long")


def test_clusters_chain_and_merge(spark):
    d = _dets(spark, [(1, "A", 0.9, 0), (1, "A", 0.9, 14), (1, "A", 0.9, 28), (1, "A", 0.9, 60), (2, "A", 0.9, 0), (2, "A", 0.9, 18), (3, "A", 0.9, 0), (3, "B", 0.9, 18)])
    comp = clusters.dbscan(d)
    assert [r.component for r in comp.orderBy("det_idx").collect()] == [0, 0, 0, 3, 4, 5, 6, 7]
    assert [r.cluster for r in clusters.merge_close(comp).orderBy("det_idx").collect()] == [0, 0, 0, 3, 4, 4, 6, 7]


def test_cluster_reasons(spark):
    d = _dets(spark, [(1, "A", 0.9, 0), (1, "B", 0.8, 1), (1, "B", 0.7, 2), (1, "A", 0.1, 3)]).withColumn("c", F.lit(0))
    r = clusters.aggregate_clusters(d, "c").first()
    assert (r.sign_class, r.class_vote_pct, r.confidence) == ("A", 0.5, 0.8) and "Split class vote (A 50% / B 50%)" in r.review_reason
    r = clusters.aggregate_clusters(_dets(spark, [(1, "A", 0.4, 0)]).withColumn("c", F.lit(0)), "c").first()
    assert r.review_reason == "Single sighting; Low confidence (0.40)" and r.needs_review


def test_reconcile_cases(spark):
    schema = "cluster_id long, sign_class string, confidence double, sighting_count long, needs_review boolean, review_reason string, lat_median double, lon_median double"
    at = 38.123456
    c = spark.createDataFrame([(1, "StopSigns", 0.9, 3, False, None, at, -81.234567)], schema)
    inv = lambda *rows: spark.createDataFrame([(i, n, k, la, lo) for i, (n, k, la, lo) in enumerate(rows)], "inv_ord int, inv_id string, inv_class string, inv_lat double, inv_lon double")
    base = ("INV-001", "StopSigns", at, -81.234567)
    got = reconcile.reconcile(c, inv(base, ("INV-002", "Warnings", 38.9, -81.9))).collect()
    assert [(r.inventory_match, r.inventory_distance_m, r.discrepancy_type) for r in got] == [("INV-001", 0.0, None)]
    for metres, n in ((40, 2), (70, 1)):
        assert reconcile.reconcile(c, inv(base, ("INV-003", "StopSigns", at + metres / 111194.9, -81.234567))).count() == n
    got = reconcile.reconcile(c.limit(0), inv(base)).collect()
    assert [(r.cluster_id, r.discrepancy_type) for r in got] == [(1, "in_inventory_not_detected")]
    got = reconcile.reconcile(c, inv(("X", "Curves", at, -81.234567))).first()
    assert got.discrepancy_type == "class_mismatch" and "detected StopSigns, inventory Curves" in got.review_reason


def plain_greedy(preds, truth, t=0.5):
    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        i = max(w, 0) * max(h, 0)
        return i / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i) if i else 0

    out, used = {}, set()
    for i, conf, b in sorted(preds, key=lambda p: (-p[1], p[0])):
        best = max(((iou(b, g), -j) for j, g in truth if j not in used), default=(0, 0))
        if best[0] > t:
            out[i] = -best[1]
            used.add(-best[1])
    return out


def test_greedy_match(spark):
    rng = np.random.default_rng(2)
    boxes = [tuple(float(v) for v in (x, y, x + 0.3, y + 0.3)) for x, y in rng.random((40, 2)) * 0.3]
    preds = [(i, float(round(rng.random(), 1)), b) for i, b in enumerate(boxes[:25])]
    truth = list(enumerate(boxes[25:]))
    box = "box struct<x1:double,y1:double,x2:double,y2:double>"
    p = spark.createDataFrame([(1, "c", i, conf, b) for i, conf, b in preds], f"image int, cls string, idx long, conf double, {box}")
    g = spark.createDataFrame([(1, "c", i, b) for i, b in truth], f"image int, cls string, idx long, {box}")
    assert {r.idx: r.gt_idx for r in evaluate.greedy_match(p, g).collect() if r.gt_idx is not None} == plain_greedy(preds, truth)


def test_average_precision(spark):
    scored = spark.createDataFrame([("a", 1, 0.9, True), ("a", 2, 0.8, False), ("a", 3, 0.7, True), ("c", 4, 0.5, False)], "cls string, idx int, conf double, is_tp boolean")
    counts = spark.createDataFrame([("a", 2), ("b", 3), ("c", 0)], "cls string, n_gt long")
    got = {r.cls: r.ap50 for r in evaluate.average_precision(scored, counts).collect()}
    assert abs(got["a"] - 0.8333333333) < 1e-9 and got["b"] == 0 and math.isnan(got["c"])


def test_gate(spark):
    gate = lambda *rows: evaluate.recall_gate(spark.createDataFrame(rows, "recall double, n long")).first().exit_code
    assert (gate((0.7, 5), (0.6, 5)), gate((0.7, 5), (0.7, 5)), gate((0.7, 0), (0.7, 0))) == (1, 0, 2)


def test_budgets_and_caps(spark):
    assert sample.class_budgets({"deer": 0.28, "ped": 0.28, "rail": 0.28, "curve": 0.16}, 10) == {"deer": 2, "ped": 3, "rail": 3, "curve": 2}
    rows = spark.createDataFrame([(i, f"c{i % 3}", float(100 - i)) for i in range(30)], "id long, county string, s double")
    got = sample.select_for_classes(rows, {"x": F.col("s"), "y": -F.col("s")}, {"x": 4, "y": 4}, "id", "county", 2).collect()
    per = {}
    for r in got:
        per[r.county] = per.get(r.county, 0) + 1
    assert len({r.id for r in got}) == len(got) == 6 and max(per.values()) == 2 and sum(r.target_class == "x" for r in got) == 4
    split = sample.random_split(rows, "id", 0.85)
    assert split.where("split = 'train'").count() == 25 and split.count() == 30
    assert {r.id for r in sample.random_split(rows.repartition(7), "id", 0.85).where("split = 'val'").collect()} == {r.id for r in split.where("split = 'val'").collect()}


def test_remap_and_quality(spark):
    mapping = spark.createDataFrame(list(classify.RAW_TO_CLASS.items()), "raw int, new int")
    lines = spark.createDataFrame([(2,), (4,), (18,), (99,)], "class_idx int")
    assert sorted(r.new_class for r in curate.remap(lines, mapping).collect()) == [2, 6]
    rows = spark.createDataFrame([("a", 5, "0", 0.5, 0.5, 0.1, 0.1), ("a", 4, "0", 0.5, 0.5, 0.1, None), ("b", 5, "x", 0.5, 1.5, 0.1, 0.1)], "stem string, n_fields int, class_text string, cx double, cy double, w double, h double")
    stems = spark.createDataFrame([("a",), ("b",), ("c",)], "stem string")
    rep = quality.label_checks(rows, stems, stems.where("stem <> 'b'"), 9, strict=True)
    got = {r.check: r.n for r in rep.collect()}
    assert got == {"wrong_field_count": 1, "class_not_integer": 1, "class_out_of_range": 0, "coordinate_out_of_range": 1, "empty_label": 1, "label_without_image": 1}
    assert quality.verdict(rep).first().status == "FAIL" and quality.recommended_n(1e6, 10.5e6, 100) == 8


def test_review_cases(spark):
    ev = [(1, 1, "decide", "approved", None), (2, 1, "correct", "X", "Regulatory"), (3, 1, "decide", "no_sign", None), (5, 1, "correct", "X", "A"), (5, 2, "decide", "approved", None), (6, 1, "note", "hm", None), (7, 1, "decide", "approved", None), (7, 2, "clear", None, None)]
    state = review.fold(spark.createDataFrame(ev, "cluster_id long, seq long, action string, value string, original string"))
    got = {r.cluster_id: r for r in state.collect()}
    assert set(got) == {1, 2, 3, 5, 6} and got[2].original_class == "Informational/Regulatory" and got[5].corrected_class is None and got[6].reviewed_at == 1
    c = spark.createDataFrame([(i, "Old", True, "why") for i in (1, 2, 3, 4)], "cluster_id long, sign_class string, needs_review boolean, review_reason string")
    out = {r.cluster_id: r for r in review.apply_reviews(c, state).collect()}
    assert set(out) == {1, 2, 4} and not out[1].needs_review and (out[2].sign_class, out[2].original_class, out[2].corrected) == ("X", "Old", True) and out[4].review_reason == "why"
    assert review.mark_reviewed(c, 4).where("needs_review").count() == 3


def test_components_by_parts_are_components(spark):
    rng = np.random.default_rng(5)
    part = rng.integers(0, 6, 300)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2)) if part[a] == part[b] or rng.random() < 0.2]
    rows = spark.createDataFrame([(a, b, int(part[a]), int(part[b])) for a, b in edges], "a long, b long, pa long, pb long")
    want = sorted(map(tuple, connected_components(rows).collect()))
    for most in (1_000_000, 5, 0):
        assert sorted(map(tuple, components_by_parts(rows, "a", "b", "pa", "pb", most=most).collect())) == want
    inside = [(a, b) for a, b in edges if part[a] == part[b]]
    rows = rows.where("pa = pb")
    assert sorted(map(tuple, components_by_parts(rows, "a", "b", "pa", "pb").collect())) == sorted(map(tuple, connected_components(rows).collect())) and len(inside) > 20
    assert components_by_parts(rows.limit(0), "a", "b", "pa", "pb").count() == 0


def test_part_forests_over_batches():
    rows = pd.DataFrame([(1, 1, 2, False), (1, 3, 2, False), (1, 4, 5, False), (2, 10, 11, False), (2, 11, 20, True), (3, 20, 11, True), (3, 21, 22, False)], columns=["p", "u", "v", "crosses"])
    for size in (1, 2, 7):
        got = pd.concat(list(_part_forests((rows[i : i + size] for i in range(0, 7, size)), 100)))
        stars = {(u, v) for u, v, o in got.itertuples(index=False) if not o}
        assert stars == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (21, 21), (22, 21)}
        assert {(u, v) for u, v, o in got.itertuples(index=False) if o} == {(11, 10), (11, 20), (20, 11)}


def test_graphs_of_videos_need_no_rounds(spark, monkeypatch):
    def rounds(edges, *_, **__):
        raise AssertionError(f"{edges.count()} edges of single videos go on in rounds")

    monkeypatch.setattr(components, "connected_components", rounds)
    monkeypatch.setattr(clusters, "connected_components", rounds)
    d = _dets(spark, [(1, "A", 0.9, 0), (1, "A", 0.9, 14), (2, "A", 0.9, 0), (2, "A", 0.9, 18), (3, "A", 0.9, 0), (3, "B", 0.9, 18)])
    assert [r.cluster for r in clusters.merge_close(clusters.dbscan(d)).orderBy("det_idx").collect()] == [0, 0, 2, 2, 4, 5]


def test_clusters_reach_over_squares(spark):
    steps = [(1, "A", 0.9, 14 * i) for i in range(300)] + [(1, "A", 0.9, 14 * 300 + 2)] + [(2, "A", 0.9, 14 * i) for i in range(5)]
    got = [r.component for r in clusters.dbscan(_dets(spark, steps)).orderBy("det_idx").collect()]
    assert got == [0] * 300 + [300] + [301] * 5


def test_members_of_clusters_are_shuffled_once(spark):
    d = _dets(spark, [(1, "A", 0.9, 0), (1, "B", 0.8, 1)]).withColumn("c", F.col("det_idx") % 2)
    plan = clusters.aggregate_clusters(d, "c")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1

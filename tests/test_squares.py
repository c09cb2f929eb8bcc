"""Components by squares against brute force."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from curbline.operators import clusters, reconcile, squares
from curbline.operators.components import connected_components


def _points(seed: int, n: int = 400):
    """Points of two videos around the corners of four squares of cells 1 wide, some on a line that runs through, one crowd."""
    rng = np.random.default_rng(seed)
    xy = np.concatenate([rng.uniform(-12, 12, (n, 2)), [(0.9 * i - 70, 0.3) for i in range(160)], rng.normal(-64, 0.4, (40, 2))])
    return [(int(v), int(i), float(x), float(y)) for i, (v, (x, y)) in enumerate(zip(rng.integers(0, 2, len(xy)), xy, strict=True))]


def _brute(points):
    ids = {i: i for _, i, _, _ in points}

    def root(a):
        while ids[a] != a:
            a = ids[a]
        return a

    for v, i, x, y in points:
        for w, j, a, b in points:
            if i < j and v == w and (x - a) ** 2 + (y - b) ** 2 <= 1:
                ids[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("most", [500_000, 30, 0])
def test_squares_against_all_pairs(spark, most):
    points = _points(3)
    flat = spark.createDataFrame(points, "video_id long, idx long, x double, y double").withColumn("tag", F.col("idx").cast("string"))
    got = squares.near_components(flat, 1.0, "video_id", ("tag",), most=most).collect()
    assert {int(r.tag): r.component for r in got} == _brute(points) and len(got) == len(points)


@pytest.mark.parametrize(("size", "chunk", "piece"), [(1, 1, 1), (7, 20, 5), (1000, 100_000, 3), (1000, 100_000, 2_000_000)])
def test_squares_over_batches(monkeypatch, size, chunk, piece):
    """However rows are cut into batches, chunks and pieces, stars inside squares are the same; names may be strings."""
    monkeypatch.setattr(squares, "CHUNK", chunk)
    monkeypatch.setattr(squares, "PIECE", piece)
    rows = [("a", 1, 1, 0.5, 0.5, 0, 0, 0, 0), ("a", 2, 2, 1.4, 0.5, 1, 0, 0, 0), ("a", 3, 3, 60.0, 3.5, 60, 3, 0, 0), ("b", 4, 4, 0.5, 0.5, 0, 0, 0, 0), ("b", 5, 5, 63.5, 0.5, 63, 0, 0, 0), ("b", 6, 6, 64.2, 0.5, 64, 0, 0, 0), ("b", 5, 5, 63.5, 0.5, 63, 0, 1, 0), ("b", 6, 6, 64.2, 0.5, 64, 0, 1, 0)]
    table = pa.table(dict(zip(("by", "tag", "idx", "x", "y", "cx", "cy", "sx", "sy"), map(list, zip(*rows, strict=True)), strict=True)))
    out = pa.Table.from_batches(list(squares._squares(iter(table.to_batches(size)), "by", ("tag",), 1.0, 500_000))).to_pylist()
    assert sorted((r["u"], r["v"], r["kind"]) for r in out) == [(1, 1, 0), (2, 1, 0), (3, 3, 0), (4, 4, 0), (5, 5, 1), (5, 6, 3), (6, 5, 3), (6, 6, 1)]
    assert {r["tag"] for r in out if r["kind"] != 3} == {1, 2, 3, 4, 5, 6}


def test_no_pair_of_a_video_is_shuffled(spark, monkeypatch):
    """A crowd of 900 places in one cell makes 404 550 pairs; none of them leaves its task."""

    def joined(*_):
        raise AssertionError("pairs are joined")

    monkeypatch.setattr(clusters, "cell_pairs", joined)
    monkeypatch.setattr(squares, "cell_pairs", joined)
    d = spark.range(900).selectExpr("id AS det_idx", "1L AS video_id", "'A' AS class_name", "0.5D AS confidence", "38 + 1e-7 * id AS lat", "-81.0D AS lon", "id AS frame_ts")
    assert clusters.dbscan(d).select("component").distinct().collect() == [(0,)]


def _members(spark):
    """Components 18 m apart of one class, which merge, and others, which don't."""
    rows = [(1, "A", 0.9, 0), (1, "A", 0.8, 18), (1, "B", 0.7, 18), (1, "A", 0.95, 18), (1, "C", 0.2, 100), (1, None, 0.2, 100), (2, "A", None, 0), (2, "B", 0.4, 1), (2, "B", 0.4, 1), (3, "A", 0.6, 0), (3, "A", 0.6, 17), (3, "A", 0.6, 34)]
    d = spark.createDataFrame([(i, v, c, conf, 38.0 + m / 111320, -81.0, 1000 * i) for i, (v, c, conf, m) in enumerate(rows)], "det_idx long, video_id long, class_name string, confidence double, lat double, lon double, frame_ts long")
    return clusters.dbscan(d)


def test_members_are_gathered_once(spark, monkeypatch):
    comp = _members(spark)
    want = clusters.aggregate_clusters(clusters.merge_close(comp), "cluster", "member_order").orderBy("cluster").collect()
    seen, profiles = [], clusters._profiles
    monkeypatch.setattr(clusters, "_profiles", lambda members, *a, **k: seen.append(members.count()) or profiles(members, *a, **k))
    assert clusters.merged_clusters(comp).orderBy("cluster").collect() == want and [r.sighting_count for r in want] == [4, 2, 3, 3]
    assert seen == [12, 7]
    monkeypatch.setattr(clusters, "FEW_MERGED", 0)
    assert clusters.merged_clusters(comp).orderBy("cluster").collect() == want


def test_the_inventory_is_kept(spark, tmp_path):
    """The corridor's signs are kept; the plan of what is returned reads no file."""
    spark.sql("SELECT 7L AS inv_ord, 'S7' AS inv_id, 'Curves' AS inv_class, 38.0D AS inv_lat, -81.0D AS inv_lon").write.parquet(str(tmp_path / "inv"))
    c = clusters.merged_clusters(_members(spark)).withColumnRenamed("cluster", "cluster_id")
    out = reconcile.reconcile(c, spark.read.parquet(str(tmp_path / "inv")))
    assert "parquet" not in out._jdf.queryExecution().optimizedPlan().toString().lower() and out.where("inventory_match = 'S7'").count() > 0


def test_rounds_give_the_same(spark):
    points = _points(4, 60)
    flat = spark.createDataFrame(points, "video_id long, idx long, x double, y double")
    found = {r.node: r.component for r in connected_components(squares.cell_pairs(flat, 1.0, "video_id")).collect()}
    assert {i: found.get(i, i) for _, i, _, _ in points} == _brute(points)

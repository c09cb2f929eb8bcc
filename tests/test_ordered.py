import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from curbline.operators import ordered, quality, skew, temporal
from curbline.operators.ordered import best_after, numbered, running
from curbline.sources import gps, sinks

ROWS = [(("a", "a", "a", "b", None)[i % 5], (i * 37) % 101, i) for i in range(400)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "g string, v int, id int").repartition(7)


def test_numbers(rows):
    got = {r.id: r.n for r in numbered(rows, (F.desc("v"), "id"), "n").collect()}
    want = sorted(ROWS, key=lambda r: (-r[1], r[2]))
    assert got == {r[2]: i + 1 for i, r in enumerate(want)}
    assert numbered(rows.limit(0), ("id",), "n").count() == 0


def test_running_sums(rows):
    got = {r.id: (r.n, r.s) for r in running(rows, ("g",), ("v", "id"), {"n": F.lit(1), "s": F.col("v")}).collect()}
    want = {}
    for g in ("a", "b", None):
        own = sorted((r for r in ROWS if r[0] == g), key=lambda r: r[1:])
        want |= {r[2]: (i + 1, s) for i, (r, s) in enumerate(zip(own, itertools.accumulate(r[1] for r in own)))}
    assert got == want


def test_best_after(rows):
    got = {r.id: r.m for r in best_after(rows, ("g",), ("id",), "v", "m").collect()}
    assert got == {r[2]: max(x[1] for x in ROWS if x[0] == r[0] and x[2] >= r[2]) for r in ROWS}


def test_no_frame_runs_to_the_end(rows, spark):
    """Spark scans such a frame anew for every row, which is quadratic in the rows of a range or a track."""
    frames = rows.select(F.lit("v").alias("video_id"), F.col("id").cast("double").alias("ts_ms"))
    fixes = frames.select("*", *(F.col("ts_ms").alias(c) for c in ("lat", "lon", "alt")))
    made = [best_after(rows, ("g",), ("id",), "v", "m"), ordered.carried(rows, ("g",), ("id",), "v", "m", ahead=True, own=False), temporal.interpolate_track(frames, fixes)]
    assert not [df for df in made if "unboundedfollowing" in df._jdf.queryExecution().toString().lower()]


@pytest.mark.parametrize("share", [2, 1000])
def test_join_uneven(spark, rows, share):
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"))
    got = sorted((r.id, r.n) for r in skew.join_uneven(rows, sizes, "g", "n", 400, share).collect())
    assert got == sorted((r[2], 240 if r[0] == "a" else 80) for r in ROWS if r[0])


@pytest.mark.parametrize("header", ["GPSLatitude,GPSLongitude,GPSAltitude,GPSDateTime,Sample_Time", "gps_latitude, GPS_Longitude ,gps_altitude,gps_timestamp,sample_time"])
def test_metadata_headers(spark, tmp_path, header):
    path = tmp_path / "m.csv"
    path.write_text(header + "\n39.28 N,80.96 W,273.3 m Above Sea Level,2024:01:01 00:00:00,1.5 s\n-1.5,2.5,,,2 s\n0,0,1 m,,3 s\n")
    got = sorted((r.ts_ms, r.lat, r.lon, r.alt) for r in gps.read_sidecar(spark, str(path)).collect())
    assert got == [(1500.0, 39.28, -80.96, 273.3), (2000.0, -1.5, 2.5, None)]


def test_report_without_a_known_list_is_an_error(spark):
    with pytest.raises(Exception, match="items, discrepancies or reviews"):
        sinks.report_rows(spark.createDataFrame([('{"x": 1}',)], "value string")).collect()


def test_preflight_links_and_strictness(spark):
    splits = spark.createDataFrame([("c", "train", 2), ("c", "val", 2)], "config string, split string, nc int")
    lines = spark.createDataFrame([("c", "train", "a", 5, "5", 0.5, 0.5, 0.1, 0.1)], "config string, split string, stem string, n_fields int, class_text string, cx double, cy double, w double, h double")
    stems = spark.createDataFrame([("c", "train", "a", False), ("c", "val", "b", False)], "config string, split string, stem string, broken boolean")
    images = spark.createDataFrame([("c", "train", "a", True), ("c", "val", "b", False), ("c", "val", "x", False)], stems.schema)
    got = {r.split: r for r in quality.preflight(splits, lines, stems, images).collect()}
    assert (got["train"].status, got["train"].worst_class, got["train"].broken_images, got["val"].status, got["val"].images_alone, got["val"].empty_labels) == ("FAIL", 5, 1, "PASS", 1, 1)
    assert {r.split: r.status for r in quality.preflight(splits, lines, stems, images, strict=True).collect()} == {"train": "FAIL", "val": "FAIL"}


def test_preflight_groups_stems_once(spark):
    splits = spark.createDataFrame([("c", "train", 2), ("c", "val", 2)], "config string, split string, nc int")
    line = ("c", "train", "a", 5, "1", 0.5, 0.5, 0.1, 0.1)
    lines = spark.createDataFrame([line, (*line[:3], 4, *line[4:]), ("d", *line[1:])], "config string, split string, stem string, n_fields int, class_text string, cx double, cy double, w double, h double")
    stems = spark.createDataFrame([("c", "train", x, None) for x in ("a", "b", "b", None)] + [("d", "train", "z", True)], "config string, split string, stem string, broken boolean")
    images = spark.createDataFrame([("c", "train", x, x == "y") for x in ("a", "y", "y", None)], stems.schema)
    report = quality.preflight(splits, lines, stems, images)
    plan = report._jdf.queryExecution().executedPlan().toString()
    got = {r.split: r for r in report.collect()}
    t = got["train"]
    assert (t.n_images, t.broken_images, t.n_labels, t.broken_labels, t.boxes, t.bad_fields, t.bad_class, t.worst_class) == (4, 2, 4, 0, 1, 1, 0, -1)
    assert (t.empty_labels, t.labels_alone, t.images_alone, t.status, got["val"].status, len(got)) == (3, 2, 2, "FAIL", "FAIL", 2)
    assert len(re.findall(r"Exchange hashpartitioning\(config#\d+, split#\d+, stem#", plan)) == 1


def long_video(spark, n=4000):
    """One video with nine tenths of the rows."""
    rng = random.Random(3)
    return spark.createDataFrame([("big" if i % 10 else f"v{i % 50}", i // 3, i, rng.random(), rng.random() if rng.random() < 0.3 else None) for i in range(n)], "v string, ts long, id long, x double, y double")


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_carried_values(spark, many_ranges):
    rows = long_video(spark)
    last, after = {}, {}
    want = {}
    data = sorted(rows.collect(), key=lambda r: (r.v, r.ts, r.id))
    for r in data:
        want[r.id] = [last.get(r.v)]
        last[r.v] = r.y if r.y is not None else last.get(r.v)
        want[r.id].append(last.get(r.v))
    for r in reversed(data):
        want[r.id].append(after.get(r.v))
        after[r.v] = r.y if r.y is not None else after.get(r.v)
    by, order = ("v",), ("ts", "id")
    got = ordered.carried(rows, by, order, "y", "before", own=False)
    got = ordered.carried(ordered.carried(got, by, order, "y", "at"), by, order, "y", "after", ahead=True, own=False)
    assert {r.id: [r.before, r["at"], r.after] for r in got.collect()} == want


def test_scans_by_ranges_are_as_by_group(spark, many_ranges):
    rows = long_video(spark)
    assert ordered.by_length(rows, ("v",), 10_000)[1] is None and ordered.by_length(rows, ("v",), 300)[1].select("v").distinct().count() == 1
    same = lambda f: sorted(map(str, f(300).collect())) == sorted(map(str, f(10**9).collect()))
    assert same(lambda most: temporal.gap_sessions(rows, "v", "ts", 0.5, ("id",), most))
    assert same(lambda most: temporal.suppress_repeats(rows, "v", "id", "x", 0.4, most))
    whole = rows.withColumn("cents", (F.col("x") * 100).cast("long"))
    assert same(lambda most: temporal.running_budget(whole, "cents", ("id",), 20_000, ("v",), most)) and same(lambda most: temporal.running_budget(whole, "cents", ("id",), 20_000, (), most))
    frames, fixes = rows.where("id % 3 > 0").select("v", F.col("ts").alias("t"), "id"), rows.where("id % 3 = 0").groupBy("v", F.col("ts").alias("t")).agg(F.min("x").alias("lat"), F.max("y").alias("lon"))
    assert same(lambda most: temporal.interpolate_track(frames, fixes, "v", "t", ("lat", "lon"), 20, most))


def test_no_task_holds_a_long_video(spark, many_ranges):
    rows = long_video(spark, 20_000)
    sizes = ordered.ranges(rows, ("v", "ts", "id")).groupBy("_p").count().collect()
    assert len(sizes) > 2 and max(r["count"] for r in sizes) < 20_000 * 0.5

import numpy as np
import pytest
from pyspark.sql import functions as F

from curbline.functions.box import iou
from curbline.operators import evaluate
from curbline.operators.overlap import overlapping

SCHEMA = "idx long, image string, cls string, conf double, box struct<x1: double, y1: double, x2: double, y2: double>"


def random_boxes(rng, n, images=3, span=4.0):
    out = []
    for i in range(n):
        w, h = 2.0 ** rng.uniform(-6, 2, 2) if i % 5 else (0.5, 0.25)
        x, y = np.round(rng.uniform(-span, span, 2) * 4) / 4 if i % 3 else rng.uniform(-span, span, 2)
        out.append((i, f"m{int(rng.integers(images))}", "ab"[i % 2], float(np.round(rng.random(), 2)), (float(x), float(y), float(x + w), float(y + h))))
    out += [(n, "m0", "a", 0.5, (1.0, 1.0, 1.0, 2.0)), (n + 1, "m0", "a", 0.5, None), (n + 2, "alone", "a", 0.5, (0.0, 0.0, 1.0, 1.0)), (n + 3, None, "a", 0.5, (0.0, 0.0, 1.0, 1.0))]
    return out


def shared(a, b):
    return a and b and min(a[2], b[2]) > max(a[0], b[0]) and min(a[3], b[3]) > max(a[1], b[1])


def other(df):
    return df.select("image", F.col("idx").alias("j"), F.col("box").alias("other_box"))


@pytest.mark.parametrize("seed", [1, 2])
def test_every_overlap_once(spark, seed):
    rng = np.random.default_rng(seed)
    a, b = random_boxes(rng, 150), random_boxes(rng, 120)
    got = sorted((r.idx, r.j) for r in overlapping(spark.createDataFrame(a, SCHEMA).select("image", "idx", "box"), other(spark.createDataFrame(b, SCHEMA)), ("image",)).select("idx", "j").collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] and x[1] == y[1] and x[4] and shared(x[4], y[4])) and len(got) > 100
    none = spark.createDataFrame([], SCHEMA)
    assert overlapping(none.select("image", "idx", "box"), other(none), ("image",)).count() == 0


def one_image(spark, n, seed):
    """n boxes of a crowded image, in conf order of their hash."""
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(seed + k)), F.lit(1_000_003)) / 1_000_003.0
    side = n**0.5
    at = spark.range(n, numPartitions=8).select("id", (u(0) * side).alias("x"), (u(1) * side).alias("y"), (0.3 + u(2)).alias("w"), u(3).alias("conf"))
    box = F.struct(F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("w")).alias("y2"))
    return at.select(F.col("id").alias("idx"), F.lit("one").alias("image"), F.lit("a").alias("cls"), "conf", box.alias("box"))


def test_pairs_follow_the_overlaps(spark):
    """One image of 50 000 boxes: the join forms a few times as many pairs as overlap, of 625 million."""
    rows = one_image(spark, 50_000, 0)
    met = overlapping(rows.where("idx % 2 = 0").select("image", "idx", "box"), other(rows.where("idx % 2 = 1")), ("image",))
    n = met.count()
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in met._jdf.queryExecution().toString() and "Join Inner" in plan
    # without the conditions on the boxes themselves the join's rows are the pairs that are formed
    from curbline.operators import overlap

    levels = sorted(r[0] for r in rows.select(overlap._level(F.col("box")).alias("l")).distinct().collect())
    a = overlap._filed(rows.where("idx % 2 = 0").select("image", "idx", "box"), "box", levels, 0).select("_f", "_cx", "_cy")
    b = overlap._filed(other(rows.where("idx % 2 = 1")), "other_box", levels, 1).select("_f", "_cx", "_cy")
    formed = a.join(b, ["_f", "_cx", "_cy"]).count()
    assert 10_000 < n < formed < 12 * n


def test_best_overlap_keeps_rows_without_any(spark):
    rng = np.random.default_rng(8)
    a, b = random_boxes(rng, 60), random_boxes(rng, 50, images=2)
    asked = spark.createDataFrame(a, SCHEMA).select("image", F.col("idx").alias("gt"), "box")
    others = spark.createDataFrame(b, SCHEMA).select("image", F.col("idx").alias("other_idx"), F.col("cls").alias("of"), F.col("box").alias("other_box"))
    got = {r.gt: (r.other_idx, r.of, r.iou) for r in evaluate.best_overlap(asked, others, "image", keep=("of",)).collect()}
    pairs = asked.join(others, "image", "left").withColumn("iou", F.when(F.col("other_box").isNull() | F.col("box").isNull(), 0.0).otherwise(iou(F.col("box"), F.col("other_box"))))
    want = {}
    for r in pairs.collect():
        if r.gt not in want or (r.iou, -r.other_idx) > (want[r.gt][2], -want[r.gt][0]):
            want[r.gt] = (r.other_idx, r.of, r.iou)
    assert got == want and len(got) == len(a)


def test_rounds_of_one_crowded_image(spark):
    """100 000 boxes of one image and class, against the walk by falling confidence."""
    preds, truth = one_image(spark, 60_000, 10), one_image(spark, 40_000, 20).drop("conf")
    held, rounds = evaluate.match_rounds(preds, truth, 0.3)
    got = {r.p: r.g for r in held.collect()}
    pairs = overlapping(preds.select("image", "idx", "conf", "box"), truth.select("image", F.col("idx").alias("g"), F.col("box").alias("o")), ("image",), "box", "o")
    rows = pairs.withColumn("iou", iou(F.col("box"), F.col("o"))).where("iou > 0.3").select("idx", "conf", "g", "iou").collect()
    want, taken = {}, set()
    for r in sorted(rows, key=lambda r: (-r.conf, r.idx, -r.iou, r.g)):
        if r.idx not in want and r.g not in taken:
            want[r.idx] = r.g
            taken.add(r.g)
    assert got == want and len(got) > 3000 and 1 < rounds < 15

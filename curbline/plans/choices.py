"""Queries over the smaller choices of curation: filters, partitions, tallies, lookups, orders and samples, with the SQL that says what each computes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbline.functions import box as B
from curbline.functions import geo
from curbline.functions.classify import COUNTY_AFFINITY, ROAD_AFFINITY, RURAL_COUNTIES, URBAN_COUNTIES, affinity, county_type
from curbline.operators import curate, quality, review, sample, temporal
from curbline.plans import views
from curbline.plans.curation import BX, LL, MF, ORDER42
from curbline.plans.tracks import DET

# Fixtures: the tables' segments and nations stand for road types and counties.
_ROADS = ["County Route", "WV Route", "Municipal Non-State", "Interstate", "US Route"]
_COUNTIES = ["Tucker", "Kanawha", "Barbour", "Mingo", "Wood"]


def _videos(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda names, k: F.element_at(F.array(*(F.lit(n) for n in names)), (F.col("video_id") % k + 1).cast("int"))
    return views.manifest(spark, d).select("video_id", pick(_ROADS, 5).alias("road"), F.element_at(F.array(*(F.lit(c) for c in _COUNTIES)), (F.floor(F.col("video_id") / 5) % 5 + 1).cast("int")).alias("county"), "size")


def class_affinity(spark: SparkSession, d: str) -> DataFrame:
    """Each video's score for each target class: road, kind of county, and a bonus for counties not covered yet."""
    v = _videos(spark, d).withColumn("kind", county_type(F.col("county")))
    new = F.col("county").isin("Tucker", "Wood")
    return v.select("video_id", "kind", *(F.round(affinity(F.col("road"), F.col("kind"), c, new), 6).alias(c) for c in ROAD_AFFINITY))


def without_municipal(spark: SparkSession, d: str) -> DataFrame:
    return curate.without_road(_videos(spark, d), "road").select("video_id", "road")


def confident_boxes(spark: SparkSession, d: str) -> DataFrame:
    return curate.confident(views.boxes(spark, d), 0.1).select("idx", "conf")


def squarish_boxes(spark: SparkSession, d: str) -> DataFrame:
    rows = views.label_lines(spark, d).withColumn("h", F.when(F.col("line_no") == 7, 0.0).otherwise(F.col("h")))
    return curate.squarish(rows).select("stem", "line_no", "class_idx")


def sharp_parts(spark: SparkSession, d: str) -> DataFrame:
    rows = views.boxes(spark, d).select("idx", F.col("pred").alias("is_candidate"), (F.col("conf") > 0.05).alias("is_sharp"))
    return curate.sharp_parts(rows).select("idx", "part")


def annotation_hours(spark: SparkSession, d: str) -> DataFrame:
    return curate.annotation_hours(views.boxes(spark, d).where("conf > 0.05")).select("n", F.round("hours", 6).alias("hours"))


def dedupe_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = views.boxes(spark, d).select("cls", (F.col("image") % 300).alias("cluster"))
    return curate.dedupe_summary(rows, 3).select("cls", "frames", "instances", "kept", F.round("frames_per_instance", 6).alias("frames_per_instance"))


def method_counts(spark: SparkSession, d: str) -> DataFrame:
    return curate.method_counts(views.boxes(spark, d).select(F.col("cls").alias("bucket"), F.when(F.col("pred"), "model").otherwise("heuristic").alias("method")))


def split_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Stems that two splits share; a sound split has none."""
    rows = views.label_lines(spark, d)
    return curate.shared_keys(rows.where("stem_no % 5 < 3"), rows.where("stem_no % 7 > 4 and stem_no % 5 > 1"), "stem")


def split_disjoint(spark: SparkSession, d: str) -> DataFrame:
    s = sample.random_split(views.manifest(spark, d), "video_id", 0.85)
    return curate.shared_keys(s.where("split = 'train'"), s.where("split = 'val'"), "video_id").agg(F.count("*").alias("shared"))


def candidates_and_background(spark: SparkSession, d: str) -> DataFrame:
    rows = views.boxes(spark, d)
    keep = lambda where, why: rows.where(where).select("idx", "image", F.lit(why).alias("candidate_reason"))
    return keep("pred and conf > 0.1", "detections").unionByName(keep("not pred and conf < 0.01", "background"))


def mixed_sample(spark: SparkSession, d: str) -> DataFrame:
    """85 parts of candidates to 15 of background, each spread over counties by what they have already."""
    m = views.manifest(spark, d)
    existing = m.where("video_id % 9 = 0").groupBy("county").agg(F.count("*").alias("n"))
    out = sample.mixed_sample(m.where("video_id % 2 = 0"), m.where("video_id % 2 = 1"), existing, 200, "county", "video_id", F.lit(1.0))
    return out.select("video_id", "county", "part")


def random_images(spark: SparkSession, d: str) -> DataFrame:
    return sample.random_n(views.manifest(spark, d).select("video_id"), "video_id", 100)


def tiered_pick(spark: SparkSession, d: str) -> DataFrame:
    """The first 40 of each road type: priority counties first, then counties not covered, by chance among equals."""
    v = _videos(spark, d)
    order = (F.when(F.col("county") == "Tucker", 0).otherwise(1), F.when(F.col("county") == "Wood", 0).otherwise(1), F.md5(F.concat(F.lit("42|"), F.col("video_id"))), "video_id")
    return curate.top_per_group(v, ("road",), order, 40).select("road", "video_id", "rank")


def tiered_order(spark: SparkSession, d: str) -> DataFrame:
    """The same order over all videos, as numbers."""
    v = _videos(spark, d)
    first = curate.tiered(v, (F.col("county") == "Tucker", F.col("county") == "Wood"), "video_id").limit(50)
    return first.select("video_id", "county")


def top_class(spark: SparkSession, d: str) -> DataFrame:
    return curate.top_class(views.boxes(spark, d), "image")


def metadata_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Frames with their video's road type and county, Unknown where the manifest lacks the video."""
    m = views.manifest(spark, d).where("video_id % 3 = 0").select(F.col("video_id").alias("user_id"), "road_type", "county")
    frames = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id")
    return curate.with_lookup(frames, m, "user_id", {"road_type": "Unknown", "county": ""}).select("event_id", "road_type", "county")


def cluster_lookup(spark: SparkSession, d: str) -> DataFrame:
    info = views.label_lines(spark, d).where("stem_no % 2 = 0").groupBy("stem").agg(F.when(F.min("line_no") == 1, "False").otherwise("True").alias("keep"), F.lit("val").alias("split"))
    return curate.with_lookup(views.label_lines(spark, d).select("stem").distinct(), info, "stem", {"keep": "True", "split": "train"})


def _items(spark: SparkSession, d: str) -> DataFrame:
    return views.boxes(spark, d).select(F.col("idx").alias("id"), F.when(F.col("idx") % 4 > 0, F.col("conf")).alias("confidence"), F.when(F.col("idx") % 3 == 0, "keep").alias("resolution"), F.when(F.col("idx") % 5 == 0, "resolved").alias("status"))


def pending_items(spark: SparkSession, d: str) -> DataFrame:
    return curate.pending(_items(spark, d)).select("id", "confidence")


def review_markers(spark: SparkSession, d: str) -> DataFrame:
    c = views.boxes(spark, d).select(F.col("idx").alias("cluster_id"), F.element_at(F.array(F.lit("in_inventory_not_detected"), F.lit("class_mismatch"), F.lit(None).cast("string")), (F.col("idx") % 3 + 1).cast("int")).alias("discrepancy_type"), (F.col("idx") % 2 == 0).alias("needs_review"), (F.col("idx") % 150).alias("sighting_count"))
    return review.marker(c).select("cluster_id", "color", F.round("radius", 6).alias("radius"))


def mark_reviewed(spark: SparkSession, d: str) -> DataFrame:
    c = views.boxes(spark, d).select(F.col("idx").alias("cluster_id"), F.lit(True).alias("needs_review"), F.lit("Single sighting").alias("review_reason"))
    return review.mark_reviewed(c, 77)


def frame_scores(spark: SparkSession, d: str) -> DataFrame:
    lap = F.when(F.col("idx") % 4 > 0, F.col("conf") * 100)
    return views.boxes(spark, d).select("idx", F.round(curate.frame_score(lap, (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))), 6).alias("score"))


def even_rounding(spark: SparkSession, d: str) -> DataFrame:
    return views.label_lines(spark, d).select("stem", "line_no", "class_idx", geo.round_even(F.col("class_idx") / 2.0, 0).alias("even"), F.round(F.col("class_idx") / 2.0).alias("up"))


def repeat_suppression(spark: SparkSession, d: str) -> DataFrame:
    """Frames that differ enough from the last one kept: the state is the last kept row."""
    rows = views.detections(spark, d).select("video_id", "det_idx", "confidence")
    return temporal.suppress_repeats(rows, "video_id", "det_idx", "confidence", 0.2).select("video_id", "det_idx")


def early_stop(spark: SparkSession, d: str) -> DataFrame:
    rows = views.detections(spark, d).select((F.col("video_id") % 50).alias("run"), F.col("det_idx").alias("step"), F.col("confidence").alias("loss"))
    return temporal.early_stop(rows, "run", "step", "loss", 0.01, 2000)


def merge_checks(spark: SparkSession, d: str) -> DataFrame:
    """The checks of a merged data set of 22 classes by round, strictly."""
    lines = views.label_lines(spark, d).select("stem", F.lit(5).alias("n_fields"), F.col("class_idx").cast("string").alias("class_text"), "cx", "cy", "w", "h", (F.col("stem_no") % 4).alias("round"))
    return quality.label_checks(lines, lines, lines, 22, strict=True, by=("round",))


def merge_verdict(spark: SparkSession, d: str) -> DataFrame:
    lines = views.label_lines(spark, d).select("stem", F.lit(5).alias("n_fields"), F.col("class_idx").cast("string").alias("class_text"), "cx", "cy", "w", "h", "stem_no")
    stems = lines.select("stem").distinct()
    return quality.verdict(quality.label_checks(lines, stems, lines.where("stem_no % 5 <> 0").select("stem").distinct(), 22, strict=True))


def expected_counts(spark: SparkSession, d: str) -> DataFrame:
    found = views.boxes(spark, d).groupBy(F.col("cls").alias("dataset")).agg(F.count("*").alias("n"))
    return quality.expected_counts(found, spark.createDataFrame([("view", 2000), ("click", 2), ("none", 0)], "dataset string, expected int"))


def bad_examples(spark: SparkSession, d: str) -> DataFrame:
    return quality.examples(views.label_lines(spark, d), F.col("class_idx") > 21, 5).select("stem", "line_no", "class_idx")


def pixel_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Pixel corners to normalised centres and back."""
    c = B.pixels_to_centre(F.col("x1") * 640, F.col("y1") * 480, F.col("x2") * 640, F.col("y2") * 480, F.lit(640.0), F.lit(480.0))
    rows = views.boxes(spark, d).withColumn("c", c).withColumn("b", B.from_centre(F.col("c.cx"), F.col("c.cy"), F.col("c.w"), F.col("c.h")))
    return rows.select("idx", F.round("c.cx", 6).alias("cx"), F.round("c.h", 6).alias("h"), F.round("b.x1", 6).alias("x1"), F.round("b.y2", 6).alias("y2"))


QUERIES = {f.__name__: f for f in (
    class_affinity, without_municipal, confident_boxes, squarish_boxes, sharp_parts, annotation_hours, dedupe_summary, method_counts, split_overlap, split_disjoint, candidates_and_background, mixed_sample, random_images,
    tiered_pick, tiered_order, top_class, metadata_lookup, cluster_lookup, pending_items, review_markers, mark_reviewed, frame_scores, even_rounding, repeat_suppression, early_stop, merge_checks, merge_verdict, expected_counts, bad_examples, pixel_boxes,
)}


def _list(names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


_VD = f"{MF}, vd AS (SELECT video_id, {_list(_ROADS)}[video_id % 5 + 1] AS road, {_list(_COUNTIES)}[video_id // 5 % 5 + 1] AS county, size FROM mf), vk AS (SELECT *, CASE WHEN county IN (SELECT unnest({_list(RURAL_COUNTIES)})) THEN 'rural' WHEN county IN (SELECT unnest({_list(URBAN_COUNTIES)})) THEN 'urban' ELSE 'other' END AS kind FROM vd)"


def _case(column: str, values: dict[str, float]) -> str:
    return f"CASE {column} {' '.join(f'''WHEN '{k}' THEN {v}e0''' for k, v in values.items())} ELSE 1e0 END"


_AFF = ", ".join(f"round({_case('road', ROAD_AFFINITY[c])} * {_case('kind', COUNTY_AFFINITY[c])} * CASE WHEN county IN ('Tucker', 'Wood') AND road = 'County Route' THEN 2e0 ELSE 1e0 END, 6) AS \"{c}\"" for c in ROAD_AFFINITY)


def _budget_sql(name: str, where: str, n: int) -> str:
    return f"""{name}g AS (SELECT county, count(*) AS available, 1e0 / (1 + coalesce(max(e.n), 0)) AS weight FROM mf LEFT JOIN e USING (county) WHERE {where} GROUP BY county),
{name}b AS (SELECT *, CAST(least(greatest(1, round_even({n} * weight / sum(weight) OVER (), 0)), available) AS BIGINT) AS b FROM {name}g),
{name}w AS (SELECT *, b + greatest(0, least(available - b, {n} - sum(b) OVER () - coalesce(sum(available - b) OVER (ORDER BY weight DESC, county ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS budget FROM {name}b),
{name}r AS (SELECT video_id, county, row_number() OVER (PARTITION BY county ORDER BY {ORDER42.format(k='video_id')}) AS r FROM mf WHERE {where})"""


ORACLES = {
    "class_affinity": f"WITH {_VD} SELECT video_id, kind, {_AFF} FROM vk",
    "without_municipal": f"WITH {_VD} SELECT video_id, road FROM vd WHERE road <> 'Municipal Non-State'",
    "confident_boxes": f"WITH {BX} SELECT idx, conf FROM bx WHERE conf >= 0.1",
    "squarish_boxes": f"WITH {LL} SELECT stem, line_no, class_idx FROM ll WHERE line_no <> 7 AND w / h > 0.5 AND w / h < 2",
    "sharp_parts": f"WITH {BX} SELECT idx, CASE WHEN pred AND conf > 0.05 THEN 'candidate' WHEN pred THEN 'blurred_candidate' ELSE 'background' END AS part FROM bx WHERE pred OR conf > 0.05",
    "annotation_hours": f"WITH {BX} SELECT count(*) AS n, round(count(*) / 380, 6) AS hours FROM bx WHERE conf > 0.05",
    "dedupe_summary": f"WITH {BX}, k AS (SELECT cls, image % 300 AS c, count(*) AS n FROM bx GROUP BY 1, 2) SELECT cls, CAST(sum(n) AS BIGINT) AS frames, count(*) AS instances, CAST(sum(least(n, 3)) AS BIGINT) AS kept, round(sum(n) / count(*), 6) AS frames_per_instance FROM k GROUP BY 1",
    "method_counts": f"WITH {BX} SELECT cls AS bucket, CASE WHEN pred THEN 'model' ELSE 'heuristic' END AS method, count(*) AS n FROM bx GROUP BY 1, 2",
    "split_overlap": f"WITH {LL} SELECT DISTINCT stem FROM ll WHERE stem_no % 5 < 3 AND stem_no % 7 > 4 AND stem_no % 5 > 1",
    "split_disjoint": "SELECT CAST(0 AS BIGINT) AS shared",
    "candidates_and_background": f"WITH {BX} SELECT idx, image, CASE WHEN pred THEN 'detections' ELSE 'background' END AS candidate_reason FROM bx WHERE (pred AND conf > 0.1) OR (NOT pred AND conf < 0.01)",
    "mixed_sample": f"WITH {MF}, e AS (SELECT county, count(*) AS n FROM mf WHERE video_id % 9 = 0 GROUP BY 1), {_budget_sql('c', 'video_id % 2 = 0', 170)}, {_budget_sql('d', 'video_id % 2 = 1', 30)} SELECT video_id, county, 'candidate' AS part FROM cr JOIN cw USING (county) WHERE r <= budget UNION ALL SELECT video_id, county, 'background' FROM dr JOIN dw USING (county) WHERE r <= budget",
    "random_images": f"WITH {MF} SELECT video_id FROM mf ORDER BY {ORDER42.format(k='video_id')} LIMIT 100",
    "tiered_pick": f"WITH {_VD}, r AS (SELECT road, video_id, CAST(row_number() OVER (PARTITION BY road ORDER BY county <> 'Tucker', county <> 'Wood', {ORDER42.format(k='video_id')}) AS INTEGER) AS rank FROM vd) SELECT * FROM r WHERE rank <= 40",
    "tiered_order": f"WITH {_VD} SELECT video_id, county FROM vd ORDER BY county <> 'Tucker', county <> 'Wood', {ORDER42.format(k='video_id')} LIMIT 50",
    "top_class": f"WITH {BX}, k AS (SELECT image, cls, count(*) AS n, row_number() OVER (PARTITION BY image ORDER BY count(*) DESC, cls) AS r FROM bx GROUP BY 1, 2) SELECT image, cls, n FROM k WHERE r = 1",
    "metadata_lookup": f"WITH {MF} SELECT event_id, coalesce(road_type, 'Unknown') AS road_type, coalesce(county, '') AS county FROM events LEFT JOIN (SELECT * FROM mf WHERE video_id % 3 = 0) ON user_id = video_id",
    "cluster_lookup": f"WITH {LL} SELECT stem, CASE WHEN stem_no % 2 = 0 AND min(line_no) = 1 THEN 'False' ELSE 'True' END AS keep, CASE WHEN stem_no % 2 = 0 THEN 'val' ELSE 'train' END AS split FROM ll GROUP BY stem, stem_no",
    "pending_items": f"WITH {BX} SELECT idx AS id, CASE WHEN idx % 4 > 0 THEN conf END AS confidence FROM bx WHERE idx % 3 <> 0 AND idx % 5 <> 0",
    "review_markers": f"WITH {BX} SELECT idx AS cluster_id, CASE idx % 3 WHEN 0 THEN 'gray' WHEN 1 THEN 'red' ELSE CASE WHEN idx % 2 = 0 THEN 'orange' ELSE 'green' END END AS color, round(least(14e0, 5 + sqrt(idx % 150)), 6) AS radius FROM bx",
    "mark_reviewed": f"WITH {BX} SELECT idx AS cluster_id, idx <> 77 AS needs_review, CASE WHEN idx <> 77 THEN 'Single sighting' END AS review_reason FROM bx",
    "frame_scores": f"WITH {BX} SELECT idx, round(CASE WHEN idx % 4 > 0 THEN conf * 100 * sqrt((x2 - x1) * (y2 - y1)) ELSE (x2 - x1) * (y2 - y1) END, 6) AS score FROM bx",
    "even_rounding": f"WITH {LL} SELECT stem, line_no, class_idx, round_even(class_idx / 2e0, 0) AS even, round(class_idx / 2e0) AS up FROM ll",
    "repeat_suppression": f"""WITH RECURSIVE {DET}, q AS MATERIALIZED (SELECT video_id, det_idx, confidence, row_number() OVER (PARTITION BY video_id ORDER BY det_idx) AS r FROM d),
w AS (SELECT video_id, det_idx, confidence AS last, r, true AS kept FROM q WHERE r = 1 UNION ALL SELECT q.video_id, q.det_idx, CASE WHEN abs(q.confidence - w.last) >= 0.2 THEN q.confidence ELSE w.last END, q.r, abs(q.confidence - w.last) >= 0.2 FROM w JOIN q ON q.video_id = w.video_id AND q.r = w.r + 1) SELECT video_id, det_idx FROM w WHERE kept""",
    "early_stop": f"""WITH {DET}, m AS (SELECT video_id % 50 AS run, det_idx AS step, confidence AS loss FROM d), b AS (SELECT *, coalesce(loss < min(loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 0.01, true) AS better FROM m),
l AS (SELECT *, max(step) FILTER (better) OVER (PARTITION BY run ORDER BY step) AS last FROM b) SELECT run, coalesce(min(step) FILTER (step - last >= 2000), max(step)) AS stop_step FROM l GROUP BY 1""",
    "merge_checks": f"""WITH {LL}, a AS (SELECT stem_no % 4 AS round, count(*) FILTER (class_idx NOT BETWEEN 0 AND 21) AS c, count(*) FILTER (NOT (cx BETWEEN 0 AND 1 AND cy BETWEEN 0 AND 1 AND w BETWEEN 0 AND 1 AND h BETWEEN 0 AND 1)) AS o FROM ll GROUP BY 1)
SELECT round, 'wrong_field_count' AS "check", 'error' AS severity, CAST(0 AS BIGINT) AS n FROM a UNION ALL SELECT round, 'class_not_integer', 'error', 0 FROM a UNION ALL SELECT round, 'class_out_of_range', 'error', c FROM a UNION ALL SELECT round, 'coordinate_out_of_range', 'error', o FROM a""",
    "merge_verdict": f"WITH {LL}, e AS (SELECT count(*) FILTER (class_idx > 21) + count(*) FILTER (NOT (cx BETWEEN 0 AND 1 AND cy BETWEEN 0 AND 1 AND w BETWEEN 0 AND 1 AND h BETWEEN 0 AND 1)) + count(DISTINCT stem) FILTER (stem_no % 5 = 0) AS n FROM ll) SELECT n AS errors, CAST(0 AS BIGINT) AS warnings, CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM e",
    "expected_counts": f"WITH {BX} SELECT dataset, expected, count(bx.idx) AS n, count(bx.idx) = expected AS ok FROM (VALUES ('view', 2000), ('click', 2), ('none', 0)) AS t(dataset, expected) LEFT JOIN bx ON cls = dataset GROUP BY 1, 2",
    "bad_examples": f"WITH {LL} SELECT stem, line_no, class_idx FROM ll WHERE class_idx > 21 ORDER BY stem, line_no LIMIT 5",
    "pixel_boxes": f"WITH {BX} SELECT idx, round((x1 + x2) / 2, 6) AS cx, round(y2 - y1, 6) AS h, round(x1, 6) AS x1, round(y2, 6) AS y2 FROM bx",
}

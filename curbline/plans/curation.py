"""Queries over boxes, label files, manifests and reviews, with the SQL that says what each computes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbline.functions import box as B
from curbline.functions import text as T
from curbline.functions.classify import RAW_TO_CLASS
from curbline.operators import curate, evaluate, quality, review, sample
from curbline.operators.overlap import overlapping
from curbline.plans import views
from curbline.plans.tracks import INV

BX = f"bx AS ({views.BOXES})"
LL = f"ll AS ({views.LABEL_LINES.replace('AS STRING', 'AS VARCHAR').replace('CAST(l_quantity AS INT)', 'CAST(l_quantity AS INTEGER)')})"
MF = f"mf AS ({views.MANIFEST})"
RE = f"ev AS ({views.REVIEW_EVENTS})"
AREA = "greatest(0e0, least(p.x2, g.x2) - greatest(p.x1, g.x1)) * greatest(0e0, least(p.y2, g.y2) - greatest(p.y1, g.y1))"
IOU = f"({AREA}) / ((p.x2 - p.x1) * (p.y2 - p.y1) + (g.x2 - g.x1) * (g.y2 - g.y1) - ({AREA}))"
BUCKET = "CASE WHEN {a} < 0.001 THEN 'tiny' WHEN {a} < 0.005 THEN 'small' WHEN {a} < 0.02 THEN 'medium' ELSE 'large' END"
ORDER42 = "md5('42|' || CAST({k} AS VARCHAR)), {k}"


def _box() -> Column:
    return B.box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = views.boxes(spark, d).withColumn("box", _box())
    return rows.where("pred").drop("pred"), rows.where("not pred").drop("pred")


def iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    p, g = _sides(spark, d)
    j = overlapping(p.select("image", F.col("idx").alias("p"), "box"), g.select("image", F.col("idx").alias("g"), F.col("box").alias("gbox")), ("image",), "box", "gbox")
    return j.withColumn("iou", B.iou(F.col("box"), F.col("gbox"))).where("iou > 0.3").select("p", "g", F.round("iou", 6).alias("iou"))


def best_iou_mismatch(spark: SparkSession, d: str) -> DataFrame:
    p, g = _sides(spark, d)
    asked = g.select("image", F.col("idx").alias("gt"), F.col("cls").alias("annotated_class"), "box")
    others = p.select("image", F.col("idx").alias("other_idx"), F.col("cls").alias("predicted_class"), F.col("box").alias("other_box"))
    best = evaluate.best_overlap(asked, others, "image", keep=("predicted_class",))
    return best.where("iou >= 0.5 and predicted_class <> annotated_class").select("gt", "annotated_class", "predicted_class", "other_idx", F.round("iou", 6).alias("iou"))


def uncovered_truth(spark: SparkSession, d: str) -> DataFrame:
    p, g = _sides(spark, d)
    asked = g.select("image", F.col("idx").alias("gt"), "box")
    others = p.select("image", F.col("idx").alias("other_idx"), F.col("box").alias("other_box"))
    return evaluate.best_overlap(asked, others, "image", eps=1e-6).where("iou < 0.5").select("gt", F.round("iou", 6).alias("iou"))


def _matched(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p, g = _sides(spark, d)
    return evaluate.greedy_match(p, g), g


def greedy_match(spark: SparkSession, d: str) -> DataFrame:
    m, _ = _matched(spark, d)
    return m.select("idx", "image", "cls", "gt_idx")


def _average_precision(spark: SparkSession, d: str) -> DataFrame:
    m, g = _matched(spark, d)
    return evaluate.average_precision(m.withColumn("is_tp", F.col("gt_idx").isNotNull()), g.groupBy("cls").agg(F.count("*").alias("n_gt")))


def ap50(spark: SparkSession, d: str) -> DataFrame:
    """Average precision a class: a prediction is true if greedy_match gives it a truth."""
    return _average_precision(spark, d).select("cls", "n_gt", F.round("ap50", 6).alias("ap50"))


TRUE = f"""{BX}, pr AS (SELECT g.idx AS gt, g.cls, p.idx, p.cls AS pcls, {IOU} AS iou FROM bx g JOIN bx p ON g.image = p.image AND NOT g.pred AND p.pred),
bo AS (SELECT *, row_number() OVER (PARTITION BY gt ORDER BY iou DESC, idx) AS k FROM pr)"""
# greedy matching: each image and class walks its predictions by falling confidence, taking the best truth that is still free
GREEDY = f"""{BX}, cd AS (SELECT p.image, p.cls, p.idx, p.conf, list(g.idx ORDER BY {IOU} DESC, g.idx) AS gs FROM bx p JOIN bx g ON p.image = g.image AND p.cls = g.cls AND p.pred AND NOT g.pred WHERE {IOU} > 0.5 GROUP BY ALL),
kd AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY image, cls ORDER BY conf DESC, idx) AS r FROM cd),
wk AS (SELECT image, cls, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS idx, CAST(NULL AS BIGINT) AS g, CAST([] AS BIGINT[]) AS taken FROM kd WHERE r = 1
 UNION ALL SELECT image, cls, r, idx, g, CASE WHEN g IS NULL THEN taken ELSE list_append(taken, g) END FROM (SELECT kd.image, kd.cls, kd.r, kd.idx, wk.taken, CAST(list_filter(kd.gs, lambda x: NOT list_contains(wk.taken, x))[1] AS BIGINT) AS g FROM wk JOIN kd ON kd.image = wk.image AND kd.cls = wk.cls AND kd.r = wk.r + 1)),
gm AS MATERIALIZED (SELECT bx.idx, bx.image, bx.cls, bx.conf, wk.g AS gt_idx FROM bx LEFT JOIN wk ON wk.idx = bx.idx WHERE bx.pred)"""


def recall_by_bucket(spark: SparkSession, d: str) -> DataFrame:
    """Recall by class and size of the truth boxes that greedy_match gives to a prediction, over all truth."""
    m, g = _matched(spark, d)
    held = m.where("gt_idx is not null").select(F.col("gt_idx").alias("idx"), F.lit(True).alias("held"))
    truth = g.withColumn("bucket", B.size_bucket(B.area(F.col("box")) / 4)).join(held, "idx", "left")
    out = evaluate.recall_matrix(truth.withColumn("matched", F.coalesce("held", F.lit(False))))
    return out.select("cls", "n_gt", *(F.round(c, 6).alias(c) for c in out.columns if c.startswith("recall")))


def _recalls(spark: SparkSession, d: str) -> DataFrame:
    p, _ = _sides(spark, d)
    return p.groupBy("cls").agg(F.avg("conf").alias("recall"), F.count("*").alias("n"))


def weighted_recall(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.weighted_recall(_recalls(spark, d)).select(F.round("weighted_recall", 6).alias("weighted_recall"))


def recall_gate(spark: SparkSession, d: str) -> DataFrame:
    g = evaluate.recall_gate(_recalls(spark, d), 0.1)
    return g.select("n_below", F.round("weighted_recall", 6).alias("weighted_recall"), "exit_code")


def coarse_mean_ap(spark: SparkSession, d: str) -> DataFrame:
    mapping = spark.createDataFrame([("view", "seen"), ("click", "seen"), ("signup", "done"), ("purchase", "done"), ("error", None)], "cls string, coarse string")
    return evaluate.coarse_mean(_average_precision(spark, d), mapping).select("coarse", F.round("mean_ap50", 6).alias("mean_ap50"), "n_classes")


def confidence_report(spark: SparkSession, d: str) -> DataFrame:
    p, g = _sides(spark, d)
    r = evaluate.confidence_report(p, views.boxes(spark, d).select("image").distinct())
    return r.select("cls", "n", F.round("mean_conf", 6).alias("mean_conf"))


def class_remap_drop(spark: SparkSession, d: str) -> DataFrame:
    mapping = spark.createDataFrame([(k, v) for k, v in RAW_TO_CLASS.items()], "raw int, new int")
    return curate.remap(views.label_lines(spark, d), mapping).select("stem", "line_no", "class_idx", "new_class")


def pair_orphans(spark: SparkSession, d: str) -> DataFrame:
    lines = views.label_lines(spark, d)
    return curate.pair_orphans(lines.where("stem_no % 3 <> 0").select("stem"), lines.where("stem_no % 4 <> 0").select("stem"), "stem")


def first_wins_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = views.label_lines(spark, d).select((F.col("stem_no") % 1000).alias("key"), (F.col("stem_no") % 5).alias("round"), "stem", "line_no")
    return curate.first_wins(rows, "key", ("round", "stem", "line_no"))


def topk_per_bucket(spark: SparkSession, d: str) -> DataFrame:
    return curate.top_per_group(views.boxes(spark, d), ("cls",), (F.desc("conf"), "idx"), 10).select("cls", "idx", "rank")


def best_hit_per_frame(spark: SparkSession, d: str) -> DataFrame:
    hits = views.boxes(spark, d).select(F.col("image").alias("frame"), F.col("cls").alias("bucket"), F.round("conf", 1).alias("score"), F.col("cls").alias("predicted_class"), F.when(F.col("pred"), "model").otherwise("heuristic").alias("method"), F.col("idx").alias("ord"))
    return curate.best_hits(hits)


def dominant_class(spark: SparkSession, d: str) -> DataFrame:
    lines = views.label_lines(spark, d)
    return curate.dominant_class(lines.where("line_no > 1"), lines, "stem")


def frame_targets(spark: SparkSession, d: str) -> DataFrame:
    out = curate.frame_targets(views.label_lines(spark, d))
    return out.select("stem", "targeted_classes", F.round("max_area", 6).alias("max_area"))


def class_support(spark: SparkSession, d: str) -> DataFrame:
    return curate.class_support(views.label_lines(spark, d).select(F.col("class_idx").alias("cls")), spark.range(30).select(F.col("id").cast("int").alias("cls")), few=2500)


def close_range(spark: SparkSession, d: str) -> DataFrame:
    return views.label_lines(spark, d).where("class_idx in (3, 4, 5, 6) and (w > 0.08 or h > 0.08)").select("stem", "line_no", "class_idx")


def diamond_hits(spark: SparkSession, d: str) -> DataFrame:
    f = views.boxes(spark, d).select(F.col("idx").alias("frame"), (F.col("x1") / 2).alias("yd"), (F.col("y1") / 2).alias("deer"), F.col("y1").alias("rail"), (F.col("x2") / 3).alias("curve"))
    return curate.yellow_diamond_hits(f).select("frame", "bucket", F.round("score", 6).alias("score"), "method")


def dq_report(spark: SparkSession, d: str) -> DataFrame:
    lines = views.label_lines(spark, d).select("stem", F.when(F.col("line_no") == 7, 4).otherwise(5).alias("n_fields"), F.when(F.col("class_idx") == 3, "x").otherwise(F.col("class_idx").cast("string")).alias("class_text"), "cx", "cy", "w", (F.col("h") * 2).alias("h"), "line_no", "stem_no")
    return quality.label_checks(lines.where("line_no > 1 or stem_no % 7 > 0"), lines.select("stem").distinct(), lines.where("stem_no % 5 <> 0").select("stem").distinct(), 22)


def storage_audit(spark: SparkSession, d: str) -> DataFrame:
    files = views.manifest(spark, d).select(F.col("county").alias("folder"), F.round(F.abs("size") * 1000).cast("long").alias("bytes"))
    return quality.storage(files, "folder", flag_gb=0.25)


def coco_annotations(spark: SparkSession, d: str) -> DataFrame:
    lines = views.label_lines(spark, d).where("class_idx < 22")
    c = B.coco_box(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), F.lit(640.0), F.lit(480.0))
    return lines.withColumn("b", c).select("stem", "line_no", (F.col("class_idx") + 1).alias("category_id"), *(F.col(f"b.{k}").alias(f"bbox_{k}") for k in "xywh"), F.round(F.col("b.w") * F.col("b.h"), 2).alias("area")).where("bbox_w > 0 and bbox_h > 0")


def ls_percent(spark: SparkSession, d: str) -> DataFrame:
    rows = views.boxes(spark, d).withColumn("b", B.percent_box(_box()))
    return rows.select("idx", *(F.round(f"b.{k}", 4).alias(k) for k in ("x", "y", "width", "height")))


def random_split(spark: SparkSession, d: str) -> DataFrame:
    return sample.random_split(views.manifest(spark, d), "video_id", 0.85).select("video_id", "split")


def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return sample.stratified_split(views.manifest(spark, d), "video_id", "road_type").select("video_id", "road_type", "split")


def cluster_split(spark: SparkSession, d: str) -> DataFrame:
    return sample.cluster_split(views.manifest(spark, d), "county").select("video_id", "county", "split")


def equal_stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return sample.equal_stratified_sample(views.label_lines(spark, d).where("class_idx < 4"), "stem", "class_idx", 200)


def quota_sample(spark: SparkSession, d: str) -> DataFrame:
    q = {"BUILDING": 30, "MACHINERY": 12, "AUTOMOBILE": 7}
    out = sample.quota_sample(views.manifest(spark, d), "video_id", "road_type", "county", F.col("video_id") % 2 == 0, q)
    return out.select("road_type", "video_id", "pick")


def proportional_budget(spark: SparkSession, d: str) -> DataFrame:
    m = views.manifest(spark, d)
    existing = m.where("video_id % 9 = 0").groupBy("county").agg(F.count("*").alias("n"))
    out = sample.proportional_budget(m, "county", F.when(F.col("road_type") == "BUILDING", 1.5).otherwise(1.0), existing, 500)
    return out.select("county", "available", F.round("weight", 6).alias("weight"), "budget")


def even_background(spark: SparkSession, d: str) -> DataFrame:
    return sample.even_background(views.manifest(spark, d), 300, "county", "video_id").select("video_id")


def negatives(spark: SparkSession, d: str) -> DataFrame:
    rows = views.boxes(spark, d)
    return sample.negatives(rows.where("not pred"), rows.where("pred and conf > 0.5"), "image", "idx", 1).select("image", "idx")


def greedy_county_cap(spark: SparkSession, d: str) -> DataFrame:
    return sample.county_capped(views.manifest(spark, d), F.col("size"), "video_id", "county", 60, 3).select("video_id", "county", "score")


def affinity_score(spark: SparkSession, d: str) -> DataFrame:
    m = views.manifest(spark, d)
    road = F.when(F.col("road_type") == "BUILDING", 3.0).when(F.col("road_type") == "MACHINERY", 0.5).otherwise(1.0)
    kind = F.when(F.col("county").isin("FRANCE", "GERMANY", "PERU"), 1.6).when(F.col("county").isin("CHINA", "INDIA"), 0.6).otherwise(1.0)
    return m.select("video_id", F.round(road * kind, 6).alias("score"))


def antijoin_exclusions(spark: SparkSession, d: str) -> DataFrame:
    m = views.manifest(spark, d)
    return curate.exclude(m, [m.where("size < 0"), m.where("video_id % 5 = 0")], "video_id").select("video_id")


def weighted_draw(spark: SparkSession, d: str) -> DataFrame:
    return sample.weighted_choice(views.manifest(spark, d), "video_id", {"a": 5.0, "b": 3.0, "c": 2.0}).select("video_id", "choice")


def review_fold(spark: SparkSession, d: str) -> DataFrame:
    return review.fold(views.review_events(spark, d))


def review_apply(spark: SparkSession, d: str) -> DataFrame:
    clusters = views.inventory(spark, d).select(F.col("inv_id").alias("cluster_id"), F.col("inv_class").alias("sign_class"), (F.col("inv_id") % 2 == 0).alias("needs_review"), F.when(F.col("inv_id") % 2 == 0, "Single sighting").alias("review_reason"))
    return review.apply_reviews(clusters, review_fold(spark, d))


def review_tally(spark: SparkSession, d: str) -> DataFrame:
    return review.tally(review_fold(spark, d))


def wrong_class_summary(spark: SparkSession, d: str) -> DataFrame:
    return review.wrong_class_summary(review_fold(spark, d))


def url_filename(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", T.url_filename(F.col("url")).alias("filename"), T.path_slug(F.col("url")).alias("slug"))


def parse_stem(spark: SparkSession, d: str) -> DataFrame:
    s = views.label_lines(spark, d).select("stem").distinct()
    return s.select("stem", T.stem_video(F.col("stem")).alias("video"), T.stem_number(F.col("stem")).alias("number"))


def set_ops_diag(spark: SparkSession, d: str) -> DataFrame:
    m = views.manifest(spark, d)
    a, b = m.where("video_id % 2 = 0").select("county", "road_type"), m.where("size > 5000").select("county", "road_type")
    return a.intersect(b).withColumn("op", F.lit("both")).unionByName(a.subtract(b).withColumn("op", F.lit("left"))).unionByName(b.subtract(a).withColumn("op", F.lit("right")))


def county_counts(spark: SparkSession, d: str) -> DataFrame:
    return views.manifest(spark, d).groupBy("county").agg(F.count("*").alias("n"), F.countDistinct("road_type").alias("road_types")).orderBy(F.desc("n"), "county").limit(20)


def road_type_budget(spark: SparkSession, d: str) -> DataFrame:
    return sample.road_type_budget(views.manifest(spark, d), 6000, "BUILDING", least=1)


def frames_by_road_type(spark: SparkSession, d: str) -> DataFrame:
    frames = views.manifest(spark, d).select("road_type", F.col("county").alias("video_id"), F.col("video_id").alias("filename"))
    return sample.frames_by_road_type(frames, sample.road_type_budget(frames, 400, "BUILDING", least=1), least=1).select("road_type", "filename")


QUERIES = {f.__name__: f for f in (
    iou_pairs, best_iou_mismatch, uncovered_truth, greedy_match, ap50, recall_by_bucket, weighted_recall, recall_gate, coarse_mean_ap, confidence_report, class_remap_drop, pair_orphans, first_wins_dedupe, topk_per_bucket, best_hit_per_frame,
    dominant_class, frame_targets, class_support, close_range, diamond_hits, dq_report, storage_audit, coco_annotations, ls_percent, random_split, stratified_split, cluster_split, equal_stratified_sample, quota_sample, proportional_budget, even_background,
    negatives, greedy_county_cap, affinity_score, antijoin_exclusions, weighted_draw, review_fold, review_apply, review_tally, wrong_class_summary, url_filename, parse_stem, set_ops_diag, county_counts, road_type_budget, frames_by_road_type,
)}

_AP = f"WITH RECURSIVE {GREEDY}, cu AS (SELECT *, gt_idx IS NOT NULL AS tp, count(gt_idx) OVER w AS t, count(*) OVER w AS n FROM gm WINDOW w AS (PARTITION BY cls ORDER BY conf DESC, idx ROWS UNBOUNDED PRECEDING)), en AS (SELECT cls, tp, max(t / n) OVER (PARTITION BY cls ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS e FROM cu), ng AS (SELECT cls, count(*) AS n_gt FROM bx WHERE NOT pred GROUP BY 1), ap AS (SELECT cls, n_gt, coalesce(sum(e) FILTER (tp), 0) / n_gt AS ap FROM ng LEFT JOIN en USING (cls) GROUP BY 1, 2)"
_FOLD = f"""{RE}, lc AS (SELECT *, max(seq) FILTER (action = 'clear') OVER (PARTITION BY cluster_id) AS c FROM ev), lv AS (SELECT * FROM lc WHERE (c IS NULL OR seq > c) AND action <> 'clear'),
fo AS (SELECT cluster_id, arg_max(CASE WHEN action = 'correct' THEN 'wrong_class' ELSE value END, seq) FILTER (action IN ('decide', 'correct')) AS decision, max(seq) FILTER (action = 'correct') AS f, max(seq) FILTER (action = 'decide' AND value <> 'wrong_class') AS u,
 arg_max(value, seq) FILTER (action = 'correct') AS cc, arg_max(CASE WHEN original IN ('Regulatory', 'Informational') THEN 'Informational/Regulatory' ELSE original END, seq) FILTER (action = 'correct') AS oc, arg_max(nullif(value, ''), seq) FILTER (action = 'note') AS note,
 max(seq) FILTER (action IN ('decide', 'correct')) AS dt, min(seq) FILTER (action = 'note') AS nt FROM lv GROUP BY 1),
fd AS (SELECT cluster_id, decision, CASE WHEN f > u OR (u IS NULL AND f IS NOT NULL) THEN cc END AS corrected_class, CASE WHEN f > u OR (u IS NULL AND f IS NOT NULL) THEN oc END AS original_class, note, coalesce(dt, nt) AS reviewed_at FROM fo)"""
_MAP = ", ".join(f"({k}, {'NULL' if v is None else v})" for k, v in RAW_TO_CLASS.items())

ORACLES = {
    "iou_pairs": f"WITH {BX} SELECT p.idx AS p, g.idx AS g, round({IOU}, 6) AS iou FROM bx p JOIN bx g ON p.image = g.image AND p.pred AND NOT g.pred WHERE {IOU} > 0.3",
    "best_iou_mismatch": f"WITH {TRUE} SELECT gt, cls AS annotated_class, pcls AS predicted_class, idx AS other_idx, round(iou, 6) AS iou FROM bo WHERE k = 1 AND iou >= 0.5 AND cls <> pcls",
    "uncovered_truth": f"WITH {BX}, o AS (SELECT g.idx AS gt, coalesce(max({AREA} / ((p.x2 - p.x1) * (p.y2 - p.y1) + (g.x2 - g.x1) * (g.y2 - g.y1) - ({AREA}) + 1e-6)), 0) AS iou FROM bx g LEFT JOIN bx p ON g.image = p.image AND p.pred WHERE NOT g.pred GROUP BY g.idx) SELECT gt, round(iou, 6) AS iou FROM o WHERE iou < 0.5",
    "ap50": f"{_AP} SELECT cls, n_gt, round(ap, 6) AS ap50 FROM ap",
    "greedy_match": f"WITH RECURSIVE {GREEDY} SELECT idx, image, cls, gt_idx FROM gm",
    "recall_by_bucket": f"WITH RECURSIVE {GREEDY}, b1 AS (SELECT g.cls, m.idx IS NOT NULL AS hit, {BUCKET.format(a='((g.x2 - g.x1) * (g.y2 - g.y1) / 4)')} AS bucket FROM bx g LEFT JOIN gm m ON m.gt_idx = g.idx WHERE NOT g.pred) SELECT cls, count(*) AS n_gt, {', '.join(f'''round(count(*) FILTER (hit AND bucket = '{b}') / nullif(count(*) FILTER (bucket = '{b}'), 0), 6) AS recall_{b}''' for b in ('tiny', 'small', 'medium', 'large'))}, round(count(*) FILTER (hit AND bucket IN ('medium', 'large')) / nullif(count(*) FILTER (bucket IN ('medium', 'large')), 0), 6) AS recall_medium_large FROM b1 GROUP BY cls",
    "weighted_recall": f"WITH {BX} SELECT round(avg(conf), 6) AS weighted_recall FROM bx WHERE pred",
    "recall_gate": f"WITH {BX}, r AS (SELECT cls, avg(conf) AS r FROM bx WHERE pred GROUP BY 1), w AS (SELECT avg(conf) AS w FROM bx WHERE pred) SELECT count(*) FILTER (r < 0.1) AS n_below, round(max(w), 6) AS weighted_recall, CASE WHEN count(*) FILTER (r < 0.1) > 0 THEN 1 WHEN max(w) < 0.1 THEN 2 ELSE 0 END AS exit_code FROM r, w",
    "coarse_mean_ap": f"{_AP} SELECT coarse, round(avg(ap), 6) AS mean_ap50, count(*) AS n_classes FROM ap JOIN (VALUES ('view', 'seen'), ('click', 'seen'), ('signup', 'done'), ('purchase', 'done')) AS t(cls, coarse) USING (cls) GROUP BY 1",
    "confidence_report": f"WITH {BX} SELECT cls, count(*) AS n, round(avg(conf), 6) AS mean_conf FROM bx WHERE pred GROUP BY 1 UNION ALL SELECT NULL, count(*) FILTER (p = 0), round(count(*) FILTER (p = 0) * 100.0 / count(*), 6) FROM (SELECT image, count(*) FILTER (pred) AS p FROM bx GROUP BY 1)",
    "class_remap_drop": f"WITH {LL} SELECT stem, line_no, class_idx, new_class FROM ll JOIN (VALUES {_MAP}) AS t(class_idx, new_class) USING (class_idx) WHERE new_class IS NOT NULL",
    "pair_orphans": f"WITH {LL}, s AS (SELECT stem, bool_or(stem_no % 3 <> 0) AS a, bool_or(stem_no % 4 <> 0) AS b FROM ll GROUP BY 1) SELECT stem, CASE WHEN a THEN 'left_only' ELSE 'right_only' END AS side FROM s WHERE a <> b",
    "first_wins_dedupe": f"WITH {LL}, k AS (SELECT stem_no % 1000 AS key, stem_no % 5 AS round, stem, line_no, row_number() OVER (PARTITION BY stem_no % 1000 ORDER BY stem_no % 5, stem, line_no) AS n FROM ll) SELECT key, round, stem, line_no FROM k WHERE n = 1",
    "topk_per_bucket": f"WITH {BX}, k AS (SELECT cls, idx, CAST(row_number() OVER (PARTITION BY cls ORDER BY conf DESC, idx) AS INTEGER) AS rank FROM bx) SELECT * FROM k WHERE rank <= 10",
    "best_hit_per_frame": f"WITH {BX}, k AS (SELECT image AS frame, cls AS bucket, round(conf, 1) AS score, cls AS predicted_class, CASE WHEN pred THEN 'model' ELSE 'heuristic' END AS method, row_number() OVER (PARTITION BY image, cls ORDER BY round(conf, 1) DESC, pred DESC, idx) AS n FROM bx) SELECT frame, bucket, score, predicted_class, method FROM k WHERE n = 1",
    "dominant_class": f"WITH {LL}, v AS (SELECT stem, class_idx, count(*) AS n, min(line_no) AS f FROM ll WHERE line_no > 1 GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY n DESC, f, class_idx) AS r FROM v) SELECT s.stem, coalesce(class_idx, -1) AS dominant FROM (SELECT DISTINCT stem FROM ll) s LEFT JOIN (SELECT stem, class_idx FROM k WHERE r = 1) t ON s.stem = t.stem",
    "frame_targets": f"WITH {LL} SELECT stem, coalesce(array_to_string(list_sort(list_distinct(list(class_idx) FILTER (class_idx IN (1, 3, 10, 11)))), '|'), '') AS targeted_classes, round(coalesce(max(w * h) FILTER (class_idx IN (1, 3, 10, 11)), 0), 6) AS max_area FROM ll GROUP BY 1",
    "class_support": f"WITH {LL} SELECT c.cls, count(class_idx) AS n, count(class_idx) < 2500 AS few FROM (SELECT CAST(range AS INTEGER) AS cls FROM range(30)) c LEFT JOIN ll ON cls = class_idx GROUP BY 1",
    "close_range": f"WITH {LL} SELECT stem, line_no, class_idx FROM ll WHERE class_idx IN (3, 4, 5, 6) AND (w > 0.08 OR h > 0.08)",
    "diamond_hits": f"WITH {BX}, f AS (SELECT idx AS frame, x1 / 2 AS yd, y1 / 2 AS deer, y1 AS rail, x2 / 3 AS curve FROM bx WHERE x1 / 2 >= 0.05), h AS (SELECT frame, 'deerCrossing' AS bucket, yd * (0.5 + deer) AS score, 'deer_pictogram_heuristic' AS method FROM f WHERE deer >= 0.12 UNION ALL SELECT frame, 'railroadCrossing', yd * (0.5 + rail), 'railroad_pattern_heuristic' FROM f WHERE rail >= 0.25 UNION ALL SELECT frame, 'curve', yd * curve, 'curve_arrow_heuristic' FROM f WHERE curve >= 0.22 UNION ALL SELECT frame, 'possible_yellow_diamond', yd, 'yellow_diamond_heuristic' FROM f WHERE deer < 0.12 AND rail < 0.25 AND curve < 0.22) SELECT frame, bucket, round(score, 6) AS score, method FROM h",
    "dq_report": f"WITH {LL}, l AS (SELECT * FROM ll WHERE line_no > 1 OR stem_no % 7 > 0), im AS (SELECT DISTINCT stem FROM ll WHERE stem_no % 5 <> 0), st AS (SELECT DISTINCT stem FROM ll) SELECT 'wrong_field_count' AS \"check\", 'error' AS severity, count(*) FILTER (line_no = 7) AS n FROM l UNION ALL SELECT 'class_not_integer', 'error', count(*) FILTER (line_no <> 7 AND class_idx = 3) FROM l UNION ALL SELECT 'class_out_of_range', 'error', count(*) FILTER (line_no <> 7 AND class_idx > 21) FROM l UNION ALL SELECT 'coordinate_out_of_range', 'error', count(*) FILTER (line_no <> 7 AND (cx > 1 OR cy > 1 OR w > 1 OR h * 2 > 1)) FROM l UNION ALL SELECT 'empty_label', 'warning', count(*) FROM st WHERE stem NOT IN (SELECT stem FROM l) HAVING count(*) > 0 UNION ALL SELECT 'label_without_image', 'warning', count(*) FROM st WHERE stem NOT IN (SELECT stem FROM im) HAVING count(*) > 0",
    "storage_audit": f"WITH {MF}, s AS (SELECT county AS folder, CAST(sum(CAST(round(abs(size) * 1000) AS BIGINT)) AS BIGINT) AS bytes, count(*) AS files FROM mf GROUP BY 1) SELECT folder, bytes, files, round(bytes / 1e9, 3) AS gb, round(bytes / 1e9 * 0.023e0, 4) AS usd_month, bytes / 1e9 > 0.25 AS over FROM s",
    "coco_annotations": f"WITH {LL}, b AS (SELECT stem, line_no, class_idx + 1 AS category_id, greatest(0e0, least((cx - w / 2) * 640e0, 640e0)) AS x1, greatest(0e0, least((cy - h / 2) * 480e0, 480e0)) AS y1, greatest(0e0, least((cx + w / 2) * 640e0, 640e0)) AS x2, greatest(0e0, least((cy + h / 2) * 480e0, 480e0)) AS y2 FROM ll WHERE class_idx < 22), c AS (SELECT stem, line_no, category_id, round(x1, 2) AS bbox_x, round(y1, 2) AS bbox_y, round(x2 - x1, 2) AS bbox_w, round(y2 - y1, 2) AS bbox_h FROM b) SELECT *, round(bbox_w * bbox_h, 2) AS area FROM c WHERE bbox_w > 0 AND bbox_h > 0",
    "ls_percent": f"WITH {BX} SELECT idx, round(x1 * 100, 4) AS x, round(y1 * 100, 4) AS y, round((x2 - x1) * 100, 4) AS width, round((y2 - y1) * 100, 4) AS height FROM bx",
    "random_split": f"WITH {MF} SELECT video_id, CASE WHEN row_number() OVER (ORDER BY {ORDER42.format(k='video_id')}) <= floor(count(*) OVER () * 0.85) THEN 'train' ELSE 'val' END AS split FROM mf",
    "stratified_split": f"WITH {MF} SELECT video_id, road_type, CASE WHEN row_number() OVER (PARTITION BY road_type ORDER BY {ORDER42.format(k='video_id')}) <= greatest(1, floor(count(*) OVER (PARTITION BY road_type) * 0.8)) THEN 'train' ELSE 'val' END AS split FROM mf",
    "cluster_split": f"WITH {MF}, c AS (SELECT county, row_number() OVER (ORDER BY {ORDER42.format(k='county')}) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT county FROM mf)) SELECT video_id, county, CASE WHEN r <= greatest(1, round_even(n * 0.2, 0)) THEN 'val' ELSE 'train' END AS split FROM mf JOIN c USING (county)",
    "equal_stratified_sample": f"WITH {LL}, k AS (SELECT DISTINCT stem, class_idx FROM ll WHERE class_idx < 4), r AS (SELECT stem, row_number() OVER (PARTITION BY class_idx ORDER BY {ORDER42.format(k='stem')}) <= 50 AS early FROM k), e AS (SELECT stem, bool_or(early) AS early FROM r GROUP BY 1) SELECT stem FROM e ORDER BY early DESC, {ORDER42.format(k='stem')} LIMIT 200",
    "quota_sample": f"WITH {MF}, q AS (SELECT * FROM mf JOIN (VALUES ('BUILDING', 30), ('MACHINERY', 12), ('AUTOMOBILE', 7)) AS t(road_type, quota) USING (road_type)), r AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY road_type, county ORDER BY video_id % 2, video_id) = 1 THEN 0 ELSE 1 END AS rep FROM q), p AS (SELECT road_type, video_id, quota, CAST(row_number() OVER (PARTITION BY road_type ORDER BY rep, {ORDER42.format(k='video_id')}) AS INTEGER) AS pick FROM r) SELECT road_type, video_id, pick FROM p WHERE pick <= quota",
    "proportional_budget": f"WITH {MF}, g AS (SELECT county, count(*) AS available, avg(CASE WHEN road_type = 'BUILDING' THEN 1.5e0 ELSE 1e0 END) / (1 + count(*) FILTER (video_id % 9 = 0)) AS weight FROM mf GROUP BY 1), b AS (SELECT *, CAST(least(greatest(1, round_even(500 * weight / sum(weight) OVER (), 0)), available) AS BIGINT) AS b FROM g), t AS (SELECT *, 500 - sum(b) OVER () - coalesce(sum(available - b) OVER (ORDER BY weight DESC, county ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM b) SELECT county, available, round(weight, 6) AS weight, CAST(b + greatest(0, least(available - b, l)) AS BIGINT) AS budget FROM t",
    "even_background": f"WITH {MF}, r AS (SELECT video_id, row_number() OVER (PARTITION BY county ORDER BY {ORDER42.format(k='video_id')}) > (SELECT greatest(1, 300 // count(DISTINCT county)) FROM mf) AS late FROM mf) SELECT video_id FROM r ORDER BY late, {ORDER42.format(k='video_id')} LIMIT 300",
    "negatives": f"WITH {BX}, n AS (SELECT image, count(*) AS n FROM bx WHERE pred AND conf > 0.5 GROUP BY 1), r AS (SELECT image, idx, row_number() OVER (PARTITION BY image ORDER BY {ORDER42.format(k='idx')}) AS r FROM bx WHERE NOT pred) SELECT image, idx FROM r JOIN n USING (image) WHERE r <= n",
    "greedy_county_cap": f"WITH {MF}, r AS (SELECT *, row_number() OVER (PARTITION BY county ORDER BY size DESC, video_id) AS r FROM mf) SELECT video_id, county, size AS score FROM r WHERE r <= 3 ORDER BY size DESC, video_id LIMIT 60",
    "affinity_score": f"WITH {MF} SELECT video_id, round(CASE road_type WHEN 'BUILDING' THEN 3e0 WHEN 'MACHINERY' THEN 0.5e0 ELSE 1e0 END * CASE WHEN county IN ('FRANCE', 'GERMANY', 'PERU') THEN 1.6e0 WHEN county IN ('CHINA', 'INDIA') THEN 0.6e0 ELSE 1e0 END, 6) AS score FROM mf",
    "antijoin_exclusions": f"WITH {MF} SELECT video_id FROM mf WHERE size >= 0 AND video_id % 5 <> 0",
    "weighted_draw": f"WITH {MF}, u AS (SELECT video_id, CAST('0x' || substr(md5('42|' || CAST(video_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296e0 * 10 AS u FROM mf) SELECT video_id, CASE WHEN u < 5 THEN 'a' WHEN u < 8 THEN 'b' ELSE 'c' END AS choice FROM u",
    "review_fold": f"WITH {_FOLD} SELECT * FROM fd",
    "review_apply": f"WITH {_FOLD}, {INV} SELECT inv_id AS cluster_id, CASE WHEN decision = 'wrong_class' AND corrected_class IS NOT NULL THEN corrected_class ELSE inv_class END AS sign_class, CASE WHEN decision = 'wrong_class' AND corrected_class IS NOT NULL THEN inv_class END AS original_class, coalesce(decision = 'wrong_class' AND corrected_class IS NOT NULL, false) AS corrected, CASE WHEN decision IN ('approved', 'correct') THEN false ELSE inv_id % 2 = 0 END AS needs_review, CASE WHEN decision IN ('approved', 'correct') THEN NULL WHEN inv_id % 2 = 0 THEN 'Single sighting' END AS review_reason FROM inv LEFT JOIN fd ON inv_id = cluster_id WHERE decision IS NULL OR decision <> 'no_sign'",
    "review_tally": f"WITH {_FOLD} SELECT count(*) FILTER (decision IN ('approved', 'correct')) AS approved, count(*) FILTER (decision = 'wrong_class') AS wrong_class, count(*) FILTER (decision = 'no_sign') AS no_sign, count(decision) AS reviewed, round(count(decision) * 100.0 / count(*), 2) AS pct FROM fd",
    "wrong_class_summary": f"WITH {_FOLD} SELECT original_class, corrected_class, count(*) AS n FROM fd WHERE decision = 'wrong_class' AND corrected_class IS NOT NULL GROUP BY 1, 2",
    "url_filename": "SELECT page_id, split_part(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z]+://[^/]*', ''), '/', -1) AS filename, regexp_replace(url, '[/\\\\]', '__', 'g') AS slug FROM pages",
    "parse_stem": f"WITH {LL} SELECT DISTINCT stem, split_part(stem, '_', 1) AS video, TRY_CAST(split_part(stem, '_', 2) AS BIGINT) AS number FROM ll",
    "set_ops_diag": f"WITH {MF}, a AS (SELECT county, road_type FROM mf WHERE video_id % 2 = 0), b AS (SELECT county, road_type FROM mf WHERE size > 5000) SELECT *, 'both' AS op FROM (FROM a INTERSECT FROM b) UNION ALL SELECT *, 'left' FROM (FROM a EXCEPT FROM b) UNION ALL SELECT *, 'right' FROM (FROM b EXCEPT FROM a)",
    "county_counts": f"WITH {MF} SELECT county, count(*) AS n, count(DISTINCT road_type) AS road_types FROM mf GROUP BY 1 ORDER BY n DESC, county LIMIT 20",
    "road_type_budget": f"WITH {MF}, o AS (SELECT road_type, count(*) AS n FROM mf WHERE road_type <> 'BUILDING' GROUP BY 1) SELECT road_type, CAST(greatest(n, round_even(3600 * n / sum(n) OVER (), 0)) AS BIGINT) AS budget FROM o UNION ALL SELECT 'BUILDING', 2400",
    "frames_by_road_type": f"""WITH {MF}, b AS (SELECT road_type, count(*) AS c FROM mf GROUP BY 1), o AS (SELECT road_type, CASE WHEN road_type = 'BUILDING' THEN 160 ELSE CAST(greatest(c, round_even(240 * c / (sum(c) FILTER (road_type <> 'BUILDING') OVER ()), 0)) AS BIGINT) END AS budget FROM b),
v AS (SELECT road_type, county, count(*) AS n FROM mf GROUP BY 1, 2), t AS (SELECT *, least(n, greatest(1, budget // count(*) OVER (PARTITION BY road_type))) AS take FROM v JOIN o USING (road_type)),
w AS (SELECT *, take + greatest(0, least(n - take, budget - sum(take) OVER (PARTITION BY road_type) - coalesce(sum(n - take) OVER (PARTITION BY road_type ORDER BY n DESC, county ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS want FROM t),
r AS (SELECT mf.*, row_number() OVER (PARTITION BY road_type, county ORDER BY {ORDER42.format(k='video_id')}) AS r FROM mf) SELECT road_type, video_id AS filename FROM r JOIN w USING (road_type, county) WHERE r <= want""",
}

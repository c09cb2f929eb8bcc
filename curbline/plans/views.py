"""The engine's inputs as views of the driver's tables: the same arithmetic, once as SQL, read by both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbline.functions.classify import normalize_sign_class

# {ms} is the engine's milliseconds of events.ts.
DETECTIONS = """SELECT event_id AS det_idx, user_id AS video_id,
 CASE event_type WHEN 'view' THEN 'StopSigns' WHEN 'signup' THEN 'SpeedLimits' WHEN 'error' THEN 'Regulatory' WHEN 'click' THEN 'Informational' ELSE 'Curves' END AS class_name,
 least(value / 100e0, 1e0) AS confidence,
 38.3e0 + 4e-4 * ((event_id * 7919) % 7) + 2e-5 * (event_id % 5) + CASE WHEN event_id % 4 = 0 THEN 15e-5 ELSE 0e0 END AS lat,
 -81.6e0 + 4e-4 * ((event_id * 104729) % 7) + 2e-5 * (event_id % 3) AS lon, {ms} AS frame_ts FROM events"""

INVENTORY = """SELECT p_partkey AS inv_ord, p_partkey AS inv_id,
 CASE p_size % 9 WHEN 0 THEN 'R1-1' WHEN 1 THEN 'R2-1' WHEN 2 THEN 'r10-6 ' WHEN 3 THEN 'W1-2' WHEN 4 THEN 'D10-3' WHEN 5 THEN 'M1-4' WHEN 6 THEN 'D1-1' WHEN 7 THEN 'OTR' ELSE '' END AS code,
 CASE p_size % 4 WHEN 0 THEN 'Guide-Route Sign' WHEN 1 THEN 'warning' WHEN 2 THEN 'REGULATORY' ELSE '' END AS category,
 38.3e0 + 4e-4 * (p_partkey % 7) + 2.3e-5 * (p_partkey % 11) + CASE WHEN p_partkey % 10 = 0 THEN 1e0 ELSE 0e0 END AS inv_lat,
 -81.6e0 + 4e-4 * (p_partkey % 5) + 3.1e-5 * (p_partkey % 13) AS inv_lon FROM part"""

#: Boxes of an image (user and day), predictions from odd events, truth from even ones.
BOXES = """SELECT event_id AS idx, user_id * 100 + (event_id % 3) AS image, event_type AS cls, least(value / 500e0, 1e0) AS conf, event_id % 2 = 1 AS pred,
 ((event_id * 31) % 50) / 100e0 AS x1, ((event_id * 17) % 50) / 100e0 AS y1,
 ((event_id * 31) % 50) / 100e0 + 0.05e0 + ((event_id * 7) % 40) / 100e0 AS x2, ((event_id * 17) % 50) / 100e0 + 0.05e0 + ((event_id * 11) % 40) / 100e0 AS y2 FROM events"""

MANIFEST = """SELECT c_custkey AS video_id, c_mktsegment AS road_type, n_name AS county, c_name AS name, c_acctbal AS size FROM customer JOIN nation ON c_nationkey = n_nationkey"""

LABEL_LINES = """SELECT l_orderkey AS stem_no, concat('v', CAST(l_suppkey % 20 AS STRING), '_', CAST(l_orderkey AS STRING)) AS stem, l_linenumber AS line_no,
 CAST(l_quantity AS INT) % 24 AS class_idx, l_discount * 5 + 0.2e0 AS cx, l_tax * 5 + 0.3e0 AS cy, l_quantity / 100e0 AS w, l_quantity / 80e0 AS h FROM lineitem"""

REVIEW_EVENTS = """SELECT conv_id AS cluster_id, turn AS seq,
 CASE WHEN role = 'system' THEN 'clear' WHEN length(text) % 3 = 0 THEN 'note' WHEN length(text) % 3 = 1 THEN 'decide' ELSE 'correct' END AS action,
 CASE WHEN length(text) % 3 = 0 THEN substring(text, 1, 12) WHEN length(text) % 3 = 1 THEN CASE length(text) % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'no_sign' WHEN 2 THEN 'wrong_class' ELSE 'correct' END ELSE 'Curves' END AS value,
 CASE WHEN turn % 2 = 0 THEN 'Regulatory' ELSE 'StopSigns' END AS original FROM conversations"""

SPARK_MS = "unix_millis(CAST(ts AS TIMESTAMP))"
DUCK_MS = "(epoch_us(ts) // 1000)"


def view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """The view's rows, of the tables under sf_dir."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    query = sql.replace("{ms}", SPARK_MS)
    for t in tables:
        query = query.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(query, **frames)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, DETECTIONS, "events")


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, INVENTORY, "part").withColumn("inv_class", normalize_sign_class(F.col("code"), F.col("category")))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, BOXES, "events")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, MANIFEST, "customer", "nation")


def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, LABEL_LINES, "lineitem")


def review_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, REVIEW_EVENTS, "conversations")

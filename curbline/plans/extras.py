"""Further queries: SQL functions, synthetic routes, counts and event windows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbline.functions import sql as functions_sql
from curbline.functions.text import frame_id
from curbline.operators import curate
from curbline.plans import views
from curbline.plans.tracks import DET, INV, _hav
from curbline.sources import synthetic


def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    functions_sql.register(spark)
    return spark.sql(
        "SELECT inv_id, sign_class(code, category) AS sign_class, collapse_class(sign_class(code, category)) AS display_class, round(haversine_m(inv_lat, inv_lon, 38.3D, -81.6D), 3) AS dist_m, size_bucket(inv_lat - 38.3D) AS bucket FROM {inv}",
        inv=views.inventory(spark, d),
    )


def road_priority(spark: SparkSession, d: str) -> DataFrame:
    rows = curate.by_road_priority(views.manifest(spark, d), "road_type", {"BUILDING": 0, "MACHINERY": 1, "AUTOMOBILE": 2})
    return rows.select("video_id", "road_type", "priority")


def candidate_counts(spark: SparkSession, d: str) -> DataFrame:
    return curate.candidate_counts(views.boxes(spark, d), "image", "cls", ["view", "click", "signup"])


def recover_cluster_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = views.manifest(spark, d).select("video_id", F.when(F.col("video_id") % 3 == 0, F.concat(F.lit("/frame/"), F.col("video_id"), F.lit("/x"))).otherwise("/none").alias("url"))
    return curate.recover_ids(rows, frame_id(F.col("url")), "video_id").select("video_id", "cluster_id")


def located_frames(spark: SparkSession, d: str) -> DataFrame:
    return curate.drop_unlocated(views.detections(spark, d).withColumn("lat", F.when(F.col("det_idx") % 4 > 0, F.col("lat")))).select("det_idx")


def polyline_points(spark: SparkSession, d: str) -> DataFrame:
    line = spark.createDataFrame([(1, 0, 38.0, -81.0), (1, 1, 38.0, -80.9), (1, 2, 38.2, -80.9)], "line_id int, ord int, lat double, lon double")
    points = views.manifest(spark, d).select("video_id", F.lit(1).alias("line_id"), ((F.col("video_id") % 101) / 100.0).alias("fraction"))
    return synthetic.along_line(points, line).select("video_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows in batch: the shape of the streaming form."""
    rows = views.detections(spark, d)
    return rows.groupBy(F.floor(F.col("frame_ts") / 3_600_000).alias("hour"), "class_name").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 6).alias("confidence"))


def latest_sighting(spark: SparkSession, d: str) -> DataFrame:
    return views.detections(spark, d).groupBy("video_id", "class_name").agg(F.max_by("det_idx", F.struct("frame_ts", "det_idx")).alias("det_idx"), F.max("frame_ts").alias("frame_ts"))


QUERIES = {f.__name__: f for f in (sql_functions, road_priority, candidate_counts, recover_cluster_ids, located_frames, polyline_points, event_windows, latest_sighting)}

_MF = f"mf AS ({views.MANIFEST})"
_L1, _L2 = _hav("38.0e0", "-81.0e0", "38.0e0", "-80.9e0"), _hav("38.0e0", "-80.9e0", "38.2e0", "-80.9e0")
ORACLES = {
    "sql_functions": f"WITH {INV} SELECT inv_id, inv_class AS sign_class, CASE WHEN inv_class IN ('Regulatory', 'Informational') THEN 'Informational/Regulatory' ELSE inv_class END AS display_class, round({_hav('inv_lat', 'inv_lon', '38.3e0', '-81.6e0')}, 3) AS dist_m, CASE WHEN inv_lat - 38.3e0 < 0.001 THEN 'tiny' WHEN inv_lat - 38.3e0 < 0.005 THEN 'small' WHEN inv_lat - 38.3e0 < 0.02 THEN 'medium' ELSE 'large' END AS bucket FROM inv",
    "road_priority": f"WITH {_MF} SELECT video_id, road_type, CASE road_type WHEN 'MACHINERY' THEN 1 WHEN 'AUTOMOBILE' THEN 2 ELSE 3 END AS priority FROM mf WHERE road_type <> 'BUILDING'",
    "candidate_counts": f"WITH bx AS ({views.BOXES}) SELECT image, count(*) FILTER (cls = 'view') AS view, count(*) FILTER (cls = 'click') AS click, count(*) FILTER (cls = 'signup') AS signup FROM bx GROUP BY 1",
    "recover_cluster_ids": f"WITH {_MF}, m AS (SELECT max(video_id) AS top FROM mf WHERE video_id % 3 = 0) SELECT video_id, CASE WHEN video_id % 3 = 0 THEN video_id ELSE top + row_number() OVER (PARTITION BY video_id % 3 = 0 ORDER BY video_id) END AS cluster_id FROM mf, m",
    "located_frames": f"WITH {DET} SELECT det_idx FROM d WHERE det_idx % 4 > 0",
    "polyline_points": f"WITH {_MF}, l AS (SELECT {_L1} AS a, {_L2} AS b), p AS (SELECT video_id, (video_id % 101) / 100.0 * (a + b) AS pos, a, b FROM mf, l) SELECT video_id, round(CASE WHEN pos < a THEN 38e0 ELSE 38e0 + 0.2e0 * (pos - a) / b END, 6) AS lat, round(CASE WHEN pos < a THEN -81e0 + 0.1e0 * pos / a ELSE -80.9e0 END, 6) AS lon FROM p",
    "event_windows": f"WITH {DET} SELECT CAST(floor(frame_ts / 3600000) AS BIGINT) AS hour, class_name, count(*) AS n, round(sum(confidence), 6) AS confidence FROM d GROUP BY 1, 2",
    "latest_sighting": f"WITH {DET} SELECT video_id, class_name, arg_max(det_idx, struct_pack(a := frame_ts, b := det_idx)) AS det_idx, max(frame_ts) AS frame_ts FROM d GROUP BY 1, 2",
}

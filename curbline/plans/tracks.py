"""Queries over detections, tracks, clusters and the inventory, with the SQL that says what each computes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curbline.functions import geo
from curbline.functions.classify import CODE_RULES, by_prefix, collapse
from curbline.operators import clusters as C
from curbline.operators import reconcile as R
from curbline.operators import review as V
from curbline.operators import spatial, temporal
from curbline.plans import views
from curbline.plans.session import cut

DET = f"d AS ({views.DETECTIONS.replace('{ms}', views.DUCK_MS)})"
INV_CLASS = """CASE WHEN u LIKE 'R1-1%' THEN 'StopSigns' WHEN u LIKE 'R2%' THEN 'SpeedLimits' WHEN u LIKE 'R10%' THEN 'TrafficLights' WHEN u LIKE 'W1%' THEN 'Curves' WHEN u LIKE 'D10%' THEN 'MileMarkers'
 WHEN u LIKE 'M%' THEN 'HighwaySymbols' WHEN u LIKE 'D1%' THEN 'Informational' WHEN u LIKE 'OT%' THEN 'Informational' WHEN c LIKE 'GUIDE%' AND c LIKE '%ROUTE SIGN%' THEN 'HighwaySymbols' WHEN c LIKE 'GUIDE%' THEN 'Informational'
 WHEN c IN ('WARNING', 'SCHOOL') THEN 'Warnings' ELSE 'Regulatory' END"""
INV = f"inv AS (SELECT *, {INV_CLASS} AS inv_class FROM (SELECT *, upper(trim(code)) AS u, upper(trim(category)) AS c FROM ({views.INVENTORY})))"
COMP = f"""{DET}, pts AS (SELECT *, lon * 111320e0 * cos(radians(avg(lat) OVER (PARTITION BY video_id))) AS x, lat * 111320e0 AS y FROM d),
e AS MATERIALIZED (SELECT a.det_idx AS a, b.det_idx AS b FROM pts a JOIN pts b ON a.video_id = b.video_id AND a.det_idx <> b.det_idx AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 225),
r(node, reach) AS (SELECT det_idx, det_idx FROM pts UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a),
comp AS MATERIALIZED (SELECT node AS det_idx, min(reach) AS component FROM r GROUP BY node),
m AS (SELECT d.*, component FROM d JOIN comp USING (det_idx))"""
HAV = "2 * 6371000e0 * asin(sqrt(least(1e0, pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2))))"


def _hav(a: str, c: str, b: str, d: str) -> str:
    return HAV.format(a=a, b=b, c=c, d=d)


def _aggregate_sql(members: str, group: str, order: str) -> str:
    return f"""v AS (SELECT {group}, class_name, count(*) AS n, min({order}) AS first FROM {members} GROUP BY 1, 2),
rv AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY n DESC, first) AS k, sum(n) OVER (PARTITION BY {group}) AS total FROM v),
tv AS (SELECT {group}, max(class_name) FILTER (k = 1) AS top_class, max(n) FILTER (k = 1) AS top_n, max(class_name) FILTER (k = 2) AS second_class, max(n) FILTER (k = 2) AS second_n, CAST(max(total) AS BIGINT) AS total FROM rv GROUP BY 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY confidence DESC, {order}) AS k FROM {members}),
st AS (SELECT {group}, avg(confidence) FILTER (k <= 3) AS conf, quantile_cont(lat, 0.5) FILTER (k <= 5) AS la, quantile_cont(lon, 0.5) FILTER (k <= 5) AS lo, stddev_pop(lat) AS sla, stddev_pop(lon) AS slo, count(*) AS n,
 min(frame_ts) AS first_seen_ts, max(frame_ts) FILTER (k = 1) AS best_frame_ts, max(det_idx) FILTER (k = 1) AS best_det FROM rk GROUP BY 1),
cl AS MATERIALIZED (SELECT {group}, top_class AS sign_class, round(conf, 6) AS confidence, n AS sighting_count,
 nullif(concat_ws('; ', CASE WHEN n = 1 THEN 'Single sighting' END, CASE WHEN conf < 0.5 THEN 'Low confidence (' || CAST(round(CAST(conf AS DECIMAL(18, 9)), 2) AS VARCHAR) || ')' END,
  CASE WHEN top_n / total < 0.70 AND second_class IS NOT NULL THEN 'Split class vote (' || top_class || ' ' || CAST(CAST(round(CAST(top_n * 100.0 / total AS DECIMAL(18, 9)), 0) AS INT) AS VARCHAR) || '% / ' || second_class || ' ' || CAST(CAST(round(CAST(second_n * 100.0 / total AS DECIMAL(18, 9)), 0) AS INT) AS VARCHAR) || '%)' END), '') AS review_reason,
 round(top_n / total, 6) AS class_vote_pct, first_seen_ts, best_frame_ts, best_det, round(la, 8) AS lat_median, round(lo, 8) AS lon_median, round(sla, 8) AS lat_std, round(slo, 8) AS lon_std FROM st JOIN tv USING ({group}))"""


def _components(spark: SparkSession, d: str) -> DataFrame:
    return C.dbscan(views.detections(spark, d))


def dbscan_components(spark: SparkSession, d: str) -> DataFrame:
    return _components(spark, d).select("det_idx", "video_id", "component")


def class_vote(spark: SparkSession, d: str) -> DataFrame:
    return C.class_votes(_components(spark, d), "component", "det_idx")


def cluster_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return C.aggregate_clusters(_components(spark, d), "component")


def _merged(spark: SparkSession, d: str) -> DataFrame:
    return C.merge_close(_components(spark, d))


MERGE = f"""WITH RECURSIVE {COMP}, v0 AS (SELECT component, class_name, count(*) AS n, min(det_idx) AS first FROM m GROUP BY 1, 2),
t0 AS (SELECT component, class_name AS top_class FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY n DESC, first) AS k FROM v0) WHERE k = 1),
c0 AS (SELECT component, min(video_id) AS video_id, quantile_cont(lat, 0.5) AS la, quantile_cont(lon, 0.5) AS lo FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY confidence DESC, det_idx) AS k FROM m) WHERE k <= 5 GROUP BY 1),
h AS MATERIALIZED (SELECT * FROM c0 JOIN t0 USING (component)),
e2 AS MATERIALIZED (SELECT a.component AS a, b.component AS b FROM h a JOIN h b ON a.video_id = b.video_id AND a.top_class = b.top_class AND a.component <> b.component AND {_hav('a.la', 'a.lo', 'b.la', 'b.lo')} <= 20),
r2(node, reach) AS (SELECT component, component FROM h UNION SELECT r2.node, e2.b FROM r2 JOIN e2 ON r2.reach = e2.a),
g AS MATERIALIZED (SELECT node AS component, min(reach) AS cluster FROM r2 GROUP BY 1),
mm AS (SELECT m.*, cluster, struct_pack(component := m.component, det_idx := det_idx) AS member_order FROM m JOIN g USING (component))"""


def merge_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d).select("det_idx", "component", "cluster")


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of all detections of events at once, as of one drive."""
    return C.merged_clusters(_components(spark, d)).withColumnRenamed("cluster", "cluster_id")


def merged_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d).drop("needs_review")


def cluster_summary_rollup(spark: SparkSession, d: str) -> DataFrame:
    return C.summary(_clusters(spark, d))


CLUSTERS = f"{MERGE}, {_aggregate_sql('mm', 'cluster', 'member_order')}"


def normalize_class(spark: SparkSession, d: str) -> DataFrame:
    return views.inventory(spark, d).select("inv_id", "inv_class", collapse(F.col("inv_class")).alias("display_class"))


def prefix_rules(spark: SparkSession, d: str) -> DataFrame:
    return views.inventory(spark, d).select("inv_id", by_prefix(F.upper(F.trim("code")), CODE_RULES, "Other").alias("rule_class"))


def corridor_filter(spark: SparkSession, d: str) -> DataFrame:
    points = views.detections(spark, d).select(F.col("lat").alias("lat_median"), F.col("lon").alias("lon_median"))
    return R.in_corridor(views.inventory(spark, d), points).select("inv_id", "inv_lat", "inv_lon")


def nearest_inventory(spark: SparkSession, d: str) -> DataFrame:
    dets = views.detections(spark, d).select("det_idx", "lat", "lon")
    found = spatial.nearest(dets, views.inventory(spark, d), 25.0, "det_idx", "inv_ord", right_at=("inv_lat", "inv_lon"))
    return found.select("det_idx", "inv_ord", F.round("dist_m", 4).alias("dist_m"))


def missing_inventory(spark: SparkSession, d: str) -> DataFrame:
    clusters, inv = cut(_clusters(spark, d)), views.inventory(spark, d)
    nearby = cut(R.in_corridor(inv, clusters).repartition("inv_ord"))
    return R.missing(clusters, nearby, R.match(clusters, nearby)).select("inv_id", "inv_class")


def reconcile(spark: SparkSession, d: str) -> DataFrame:
    out = R.reconcile(_clusters(spark, d), views.inventory(spark, d))
    return out.select("cluster_id", "sign_class", "inventory_match", "inventory_distance_m", "inventory_class", "discrepancy_type", "needs_review", "review_reason")


_NEAR = f"""box AS MATERIALIZED (SELECT min(lat_median) - 60 / 111000e0 AS a, max(lat_median) + 60 / 111000e0 AS b, min(lon_median) - 60 / (111000e0 * cos(radians(avg(lat_median)))) AS c, max(lon_median) + 60 / (111000e0 * cos(radians(avg(lat_median)))) AS e FROM cl),
near AS MATERIALIZED (SELECT inv.* FROM inv, box WHERE inv_lat BETWEEN box.a AND box.b AND inv_lon BETWEEN box.c AND box.e),
pair AS MATERIALIZED (SELECT cluster AS cluster_id, inv_ord, inv_id, inv_class, {_hav('lat_median', 'lon_median', 'inv_lat', 'inv_lon')} AS dist FROM (SELECT *, unnest([-1, 0, 1]) + CAST(floor(lat_median * 1000) AS BIGINT) AS bin FROM cl) c JOIN (SELECT *, CAST(floor(inv_lat * 1000) AS BIGINT) AS bin FROM near) n ON c.bin = n.bin),
mt AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY dist, inv_ord) AS k FROM pair WHERE dist <= 25) WHERE k = 1),
gone AS (SELECT * FROM near WHERE inv_class <> 'Warnings' AND inv_ord NOT IN (SELECT inv_ord FROM mt) AND inv_ord IN (SELECT inv_ord FROM pair WHERE dist <= 60))"""
_RECONCILED = f"""{CLUSTERS}, {INV}, {_NEAR},
co AS (SELECT cluster AS cluster_id, cl.*, mt.inv_id, mt.inv_class, mt.dist, CASE WHEN sign_class IN ('Regulatory', 'Informational') THEN 'Informational/Regulatory' ELSE sign_class END AS s1, CASE WHEN inv_class IN ('Regulatory', 'Informational') THEN 'Informational/Regulatory' ELSE inv_class END AS s2 FROM cl LEFT JOIN mt ON cluster = cluster_id),
rc AS (SELECT cluster_id, sign_class, CAST(inv_id AS VARCHAR) AS inventory_match, round(dist, 2) AS inventory_distance_m, inv_class AS inventory_class,
 CASE WHEN inv_id IS NULL THEN 'detected_not_in_inventory' WHEN s1 <> s2 THEN 'class_mismatch' END AS discrepancy_type, (review_reason IS NOT NULL OR inv_id IS NULL OR s1 <> s2) AS needs_review,
 nullif(concat_ws('; ', review_reason, CASE WHEN inv_id IS NULL THEN 'Not in inventory' WHEN s1 <> s2 THEN 'Class mismatch (detected ' || sign_class || ', inventory ' || inv_class || ')' END), '') AS review_reason FROM co
 UNION ALL SELECT (SELECT max(cluster) FROM cl) + row_number() OVER (ORDER BY inv_ord), inv_class, CAST(inv_id AS VARCHAR), NULL, inv_class, 'in_inventory_not_detected', true, 'In inventory but not detected' FROM gone)"""


def haversine_pairs(spark: SparkSession, d: str) -> DataFrame:
    a = views.detections(spark, d).select(F.col("det_idx").alias("a"), "video_id", "lat", "lon")
    b = views.detections(spark, d).select(F.col("det_idx").alias("b"), "video_id", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    return spatial.within(a, b, 60.0, ("video_id",)).where("a < b").select("a", "b", F.round("dist_m", 4).alias("dist_m"))


def _tracks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    dets = views.detections(spark, d)
    fixes = dets.where("det_idx % 3 = 0").groupBy("video_id", F.col("frame_ts").alias("ts_ms")).agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"), F.min("confidence").alias("alt"))
    return dets.where("det_idx % 3 <> 0").select("video_id", F.col("frame_ts").alias("ts_ms"), "det_idx"), fixes


def asof_interpolate(spark: SparkSession, d: str) -> DataFrame:
    frames, fixes = _tracks(spark, d)
    out = temporal.interpolate_track(frames, fixes, tolerance_ms=3_600_000)
    return out.select("det_idx", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("alt", 6).alias("alt"))


def gap_sessions(spark: SparkSession, d: str) -> DataFrame:
    return temporal.gap_sessions(views.detections(spark, d), "video_id", "frame_ts", 7_200_000, ("det_idx",)).select("det_idx", "video_id", "session")


def global_cluster_ids(spark: SparkSession, d: str) -> DataFrame:
    return temporal.global_session_ids(gap_sessions(spark, d), "video_id").select("det_idx", "cluster_id")


SESS = f"{DET}, w AS (SELECT *, CASE WHEN frame_ts - lag(frame_ts) OVER (PARTITION BY video_id ORDER BY frame_ts, det_idx) > 7200000 THEN 1 ELSE 0 END AS new FROM d), ss AS (SELECT det_idx, video_id, frame_ts, confidence, class_name, CAST(sum(new) OVER (PARTITION BY video_id ORDER BY frame_ts, det_idx) AS BIGINT) AS session FROM w)"


def session_topk_keep(spark: SparkSession, d: str) -> DataFrame:
    s = temporal.gap_sessions(views.detections(spark, d), "video_id", "frame_ts", 7_200_000, ("det_idx",))
    w = Window.partitionBy("class_name", "video_id", "session").orderBy(F.desc("confidence"), "det_idx")
    return s.withColumn("rank", F.row_number().over(w)).where("rank <= 2").select("det_idx", "class_name", "session", "rank")


def nearest_ts_frame(spark: SparkSession, d: str) -> DataFrame:
    dets = views.detections(spark, d)
    asked = dets.where("det_idx % 7 = 0").select("det_idx", "video_id", F.col("frame_ts").alias("ts"))
    return temporal.nearest_frame(asked, dets.where("det_idx % 7 <> 0"), "video_id", "ts", "frame_ts", 600_000).select("det_idx", "frame_ts")


def running_budget(spark: SparkSession, d: str) -> DataFrame:
    taken = temporal.running_budget(views.manifest(spark, d).withColumn("cents", F.round(F.abs("size") * 100).cast("long")), "cents", ("video_id",), 5_000_000, ("county",))
    return taken.select("video_id", "used_before")


def plane_coordinates(spark: SparkSession, d: str) -> DataFrame:
    dets = views.detections(spark, d)
    mean = F.avg("lat").over(Window.partitionBy("video_id"))
    return dets.select("det_idx", F.round(geo.plane_x(F.col("lon"), mean), 4).alias("x"), F.round(geo.plane_y(F.col("lat")), 4).alias("y"))


def _reconciled(spark: SparkSession, d: str) -> DataFrame:
    return R.reconcile(_clusters(spark, d), views.inventory(spark, d))


def discrepancy_report(spark: SparkSession, d: str) -> DataFrame:
    return V.discrepancies(_reconciled(spark, d)).select("id", "type", "cluster_id", "sign_class", "status")


def report_totals(spark: SparkSession, d: str) -> DataFrame:
    r = _reconciled(spark, d)
    return r.agg(F.sum("sighting_count").alias("total_detections"), F.count("*").alias("total_clusters"), F.count_if("needs_review").alias("needs_review"), F.count("discrepancy_type").alias("discrepancies"))


def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """All that is to be reviewed."""
    return V.queue(_reconciled(spark, d)).select("cluster_id", "discrepancy_type")


def next_nearest(spark: SparkSession, d: str) -> DataFrame:
    return V.next_nearest(_clusters(spark, d), 38.3011, -81.5987).select("cluster_id", F.round("d2", 10).alias("d2"))


QUERIES = {f.__name__: f for f in (
    dbscan_components, class_vote, cluster_aggregate, merge_clusters, merged_clusters, cluster_summary_rollup, normalize_class, prefix_rules, corridor_filter, nearest_inventory, missing_inventory, reconcile,
    haversine_pairs, asof_interpolate, gap_sessions, global_cluster_ids, session_topk_keep, nearest_ts_frame, running_budget, plane_coordinates, discrepancy_report, report_totals, review_queue, next_nearest,
)}

ORACLES = {
    "dbscan_components": f"WITH RECURSIVE {COMP} SELECT det_idx, video_id, component FROM m",
    "class_vote": f"WITH RECURSIVE {COMP}, {_aggregate_sql('m', 'component', 'det_idx')} SELECT component, top_class, top_n, second_class, second_n, total FROM tv",
    "cluster_aggregate": f"WITH RECURSIVE {COMP}, {_aggregate_sql('m', 'component', 'det_idx')} SELECT *, review_reason IS NOT NULL AS needs_review FROM cl",
    "merge_clusters": f"{MERGE} SELECT det_idx, component, cluster FROM mm",
    "merged_clusters": f"{CLUSTERS} SELECT * RENAME (cluster AS cluster_id) FROM cl",
    "cluster_summary_rollup": f"{CLUSTERS} SELECT sign_class, count(*) AS clusters, CAST(sum(sighting_count) AS BIGINT) AS sightings, count(review_reason) AS needs_review FROM cl GROUP BY ROLLUP (sign_class)",
    "normalize_class": f"WITH {INV} SELECT inv_id, inv_class, CASE WHEN inv_class IN ('Regulatory', 'Informational') THEN 'Informational/Regulatory' ELSE inv_class END AS display_class FROM inv",
    "prefix_rules": f"WITH {INV} SELECT inv_id, CASE WHEN u LIKE 'R1-1%' THEN 'StopSigns' WHEN u LIKE 'R2%' THEN 'SpeedLimits' WHEN u LIKE 'R10%' THEN 'TrafficLights' WHEN u LIKE 'W1%' THEN 'Curves' WHEN u LIKE 'D10%' THEN 'MileMarkers' WHEN u LIKE 'M%' THEN 'HighwaySymbols' WHEN u LIKE 'D1%' OR u LIKE 'OT%' THEN 'Informational' ELSE 'Other' END AS rule_class FROM inv",
    "corridor_filter": f"WITH {DET}, {INV}, b AS (SELECT min(lat) - 60 / 111000e0 AS a, max(lat) + 60 / 111000e0 AS b, min(lon) - 60 / (111000e0 * cos(radians(avg(lat)))) AS c, max(lon) + 60 / (111000e0 * cos(radians(avg(lat)))) AS e FROM d) SELECT inv_id, inv_lat, inv_lon FROM inv, b WHERE inv_lat BETWEEN b.a AND b.b AND inv_lon BETWEEN b.c AND b.e",
    "nearest_inventory": f"WITH {DET}, {INV}, p AS (SELECT det_idx, inv_ord, {_hav('lat', 'lon', 'inv_lat', 'inv_lon')} AS dist FROM d JOIN inv ON abs(lat - inv_lat) < 0.0004), k AS (SELECT *, row_number() OVER (PARTITION BY det_idx ORDER BY dist, inv_ord) AS n FROM p WHERE dist <= 25) SELECT det_idx, inv_ord, round(dist, 4) AS dist_m FROM k WHERE n = 1",
    "missing_inventory": f"{CLUSTERS}, {INV}, {_NEAR} SELECT inv_id, inv_class FROM gone",
    "reconcile": f"{_RECONCILED} SELECT * FROM rc",
    "haversine_pairs": f"WITH {DET}, p AS (SELECT a.det_idx AS a, b.det_idx AS b, {_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS dist FROM d a JOIN d b ON a.video_id = b.video_id AND a.det_idx < b.det_idx) SELECT a, b, round(dist, 4) AS dist_m FROM p WHERE dist <= 60",
    "asof_interpolate": f"""WITH {DET}, f AS (SELECT video_id, frame_ts AS t, min(lat) AS lat, min(lon) AS lon, min(confidence) AS alt FROM d WHERE det_idx % 3 = 0 GROUP BY 1, 2), q AS (SELECT det_idx, video_id, frame_ts AS t FROM d WHERE det_idx % 3 <> 0),
lo AS (SELECT q.det_idx, q.video_id, q.t, f.t AS t0, f.lat AS a0, f.lon AS o0, f.alt AS z0 FROM q ASOF LEFT JOIN f ON q.video_id = f.video_id AND q.t >= f.t),
hi AS (SELECT lo.*, f.t AS t1, f.lat AS a1, f.lon AS o1, f.alt AS z1 FROM lo ASOF LEFT JOIN f ON lo.video_id = f.video_id AND lo.t < f.t)
SELECT det_idx, {', '.join(f"round(CASE WHEN t0 IS NULL THEN CASE WHEN t1 - t <= 3600000 THEN {v}1 END WHEN t1 IS NULL THEN CASE WHEN t - t0 <= 3600000 THEN {v}0 END WHEN t = t0 THEN {v}0 ELSE {v}0 + ({v}1 - {v}0) * ((t - t0) / (t1 - t0)) END, 6) AS {n}" for v, n in (('a', 'lat'), ('o', 'lon'), ('z', 'alt')))} FROM hi""",
    "gap_sessions": f"WITH {SESS} SELECT det_idx, video_id, session FROM ss",
    "global_cluster_ids": f"WITH {SESS}, n AS (SELECT video_id, max(session) + 1 AS n FROM ss GROUP BY 1), o AS (SELECT video_id, coalesce(sum(n) OVER (ORDER BY CAST(video_id AS VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM n) SELECT det_idx, video_id || '_c' || CAST(CAST(off + session AS BIGINT) AS VARCHAR) AS cluster_id FROM ss JOIN o USING (video_id)",
    "session_topk_keep": f"WITH {SESS}, k AS (SELECT *, CAST(row_number() OVER (PARTITION BY class_name, video_id, session ORDER BY confidence DESC, det_idx) AS INTEGER) AS rank FROM ss) SELECT det_idx, class_name, session, rank FROM k WHERE rank <= 2",
    "nearest_ts_frame": f"WITH {DET}, p AS (SELECT a.det_idx, b.frame_ts, b.frame_ts - a.frame_ts AS x FROM d a JOIN d b ON a.video_id = b.video_id AND a.det_idx % 7 = 0 AND b.det_idx % 7 <> 0 AND abs(b.frame_ts - a.frame_ts) <= 600000), k AS (SELECT *, row_number() OVER (PARTITION BY det_idx ORDER BY CASE x WHEN 0 THEN 0 WHEN -1 THEN 1 WHEN 1 THEN 2 ELSE 3 END, abs(x), frame_ts) AS n FROM p) SELECT det_idx, frame_ts FROM k WHERE n = 1",
    "running_budget": f"WITH m AS ({views.MANIFEST}), c AS (SELECT video_id, county, CAST(round(abs(size) * 100) AS BIGINT) AS cents FROM m), u AS (SELECT video_id, CAST(coalesce(sum(cents) OVER (PARTITION BY county ORDER BY video_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used_before FROM c) SELECT * FROM u WHERE used_before < 5000000",
    "plane_coordinates": f"WITH {DET} SELECT det_idx, round(lon * 111320e0 * cos(radians(avg(lat) OVER (PARTITION BY video_id))), 4) AS x, round(lat * 111320e0, 4) AS y FROM d",
    "discrepancy_report": f"{_RECONCILED} SELECT format('disc_{{:03d}}', row_number() OVER (ORDER BY cluster_id)) AS id, discrepancy_type AS type, cluster_id, sign_class, 'pending' AS status FROM rc WHERE discrepancy_type IS NOT NULL",
    "report_totals": f"{_RECONCILED} SELECT (SELECT CAST(sum(sighting_count) AS BIGINT) FROM cl) AS total_detections, count(*) AS total_clusters, count(*) FILTER (needs_review) AS needs_review, count(discrepancy_type) AS discrepancies FROM rc",
    "review_queue": f"{_RECONCILED} SELECT cluster_id, discrepancy_type FROM rc LEFT JOIN (SELECT cluster AS c, confidence FROM cl) ON c = cluster_id WHERE needs_review ORDER BY CASE WHEN discrepancy_type IS NOT NULL THEN 0 ELSE 1 END, CASE WHEN discrepancy_type = 'in_inventory_not_detected' THEN 0 ELSE confidence END, cluster_id",
    "next_nearest": f"{CLUSTERS} SELECT cluster AS cluster_id, round(pow(lat_median - 38.3011, 2) + pow(lon_median + 81.5987, 2), 10) AS d2 FROM cl WHERE review_reason IS NOT NULL ORDER BY pow(lat_median - 38.3011, 2) + pow(lon_median + 81.5987, 2), cluster LIMIT 1",
}

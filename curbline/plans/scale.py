"""Queries through the forms that long groups take (scans by ranges, counting by hash ranges, components in rounds), and the sources and sinks that keep whole
documents and split whole archives, with the SQL that says what each computes."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbline.operators import clusters, quality, sample, temporal
from curbline.plans import curation, tracks, views
from curbline.plans.files import _scratch
from curbline.plans.tracks import DET
from curbline.sources import annotations, archives, documents, gps, sinks, synthetic

MF = f"mf AS ({views.MANIFEST})"


@contextmanager
def _many_ranges(spark: SparkSession) -> Iterator[None]:
    """Ranges of a few rows stay as many as they are, so that small tables cross their borders too."""
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)


def asof_by_ranges(spark: SparkSession, d: str) -> DataFrame:
    """asof_interpolate with every track scanned by ranges."""
    frames, fixes = tracks._tracks(spark, d)
    with _many_ranges(spark):
        out = temporal.interpolate_track(frames, fixes, tolerance_ms=3_600_000, most=0)
    return out.select("det_idx", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("alt", 6).alias("alt"))


def sessions_by_ranges(spark: SparkSession, d: str) -> DataFrame:
    """gap_sessions with every video scanned by ranges."""
    with _many_ranges(spark):
        return temporal.gap_sessions(views.detections(spark, d), "video_id", "frame_ts", 7_200_000, ("det_idx",), 0).select("det_idx", "video_id", "session")


def repeats_by_ranges(spark: SparkSession, d: str) -> DataFrame:
    """repeat_suppression over one video that has all rows, walked by ranges from guessed states."""
    rows = views.detections(spark, d).select(F.lit(1).alias("video_id"), "det_idx", "confidence")
    with _many_ranges(spark):
        return temporal.suppress_repeats(rows, "video_id", "det_idx", "confidence", 0.2, 0).select("det_idx")


def budget_by_ranges(spark: SparkSession, d: str) -> DataFrame:
    """One running budget over all rows, without a task that sees them all."""
    rows = views.manifest(spark, d).withColumn("cents", F.round(F.abs("size") * 100).cast("long"))
    with _many_ranges(spark):
        return temporal.running_budget(rows, "cents", ("video_id",), 100_000_000, (), 0).select("video_id", "used_before")


def dbscan_in_rounds(spark: SparkSession, d: str) -> DataFrame:
    """dbscan_components with the graph contracted in rounds, as large graphs are."""
    return clusters.dbscan(views.detections(spark, d), small=0).select("det_idx", "video_id", "component")


def equal_sample_by_counting(spark: SparkSession, d: str) -> DataFrame:
    return sample.equal_stratified_sample(views.label_lines(spark, d).where("class_idx < 4"), "stem", "class_idx", 200, long=0)


def quota_by_counting(spark: SparkSession, d: str) -> DataFrame:
    q = {"BUILDING": 30, "MACHINERY": 12, "AUTOMOBILE": 7}
    return sample.quota_sample(views.manifest(spark, d), "video_id", "road_type", "county", F.col("video_id") % 2 == 0, q, long=0).select("road_type", "video_id", "pick")


def background_by_counting(spark: SparkSession, d: str) -> DataFrame:
    return sample.even_background(views.manifest(spark, d), 300, "county", "video_id", long=0).select("video_id")


def budget_sample(spark: SparkSession, d: str) -> DataFrame:
    """Of every county a budget of its own, by counting."""
    m = views.manifest(spark, d)
    budgets = m.groupBy("county").agg((F.count("*") / 3).cast("long").alias("budget"))
    return sample.sample_by_budget(m, budgets, "county", "video_id", long=0).select("video_id", "county")


def class_county_caps(spark: SparkSession, d: str) -> DataFrame:
    """Caps a county that three classes share, in order."""
    scores = {"deer": F.col("size"), "rail": F.col("video_id") % 97, "curve": -F.col("size")}
    out = sample.select_for_classes(views.manifest(spark, d), scores, {"deer": 40, "rail": 30, "curve": 20}, "video_id", "county", 3)
    return out.select("video_id", "county", "target_class", F.round("score", 6).alias("score"))


def class_budgets(spark: SparkSession, d: str) -> DataFrame:
    """Budgets by the classes' shares of the boxes; what rounding leaves over goes to the largest."""
    counts = views.boxes(spark, d).groupBy("cls").agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("whole"))
    return sample.budgets_by_share(counts.join(F.broadcast(whole), F.lit(True)), "cls", F.col("n") / F.col("whole"), 77)


#: Keys that may lie in one zip file: it is made in a task's memory.
ZIP_KEYS = 100_000


def archive_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Zip files written to the shared folder, by the tasks that make them, and read by ranges of their entries, several tasks a file. An archive of
    very many entries lies there as files of one name in several folders."""
    path = _scratch(spark, "zips")
    rows = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), (F.col("c_nationkey") % 3).alias("part"), F.floor(F.col("c_custkey") / ZIP_KEYS).alias("shard"))

    def zipped(pdf: pd.DataFrame) -> pd.DataFrame:
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            z.writestr("classes.txt", "a")
            for k, name in zip(pdf["key"], pdf["name"], strict=True):
                z.writestr(f"labels/s{k}.txt", name)
                z.writestr(f"old/s{k}.txt", "later")
                if k % 2 == 0:
                    z.writestr(f"images\\s{k}.JPG", "picture")
                z.writestr(f"notes/s{k}.md", "no")
        fs, at = archives._open(f"{path}/{pdf['shard'].iloc[0]}")
        fs.create_dir(at)
        with fs.open_output_stream(f"{at}/n{pdf['part'].iloc[0]}.zip") as out:
            out.write(held.getbuffer())
        return pd.DataFrame({"entries": [len(z.namelist())]})

    made = rows.groupBy("part", "shard").applyInPandas(zipped, "entries long").agg(F.sum("entries")).first()[0]
    if not made:
        archives._open(path)[0].create_dir(archives._open(path)[1])
    found = archives.read_archives(spark, path, range_bytes=2_000)
    return found.select("archive", "kind", "stem", F.col("content").cast("string").alias("content"))


def report_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose entries get a new status: fields nobody knows of stay, and a missing note is told from a null one."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    note = F.element_at(F.array(F.lit(""), F.lit(',"note":null'), F.lit(',"note":"say \\"so\\""')), (F.col("c_custkey") % 3 + 1).cast("int"))
    item = F.concat(F.lit('{"id":"'), "c_custkey", F.lit('","status":"pending","extra":{"deep":['), F.col("c_custkey"), F.lit(',"x"]}'), note, F.lit("}"))
    docs = c.groupBy(F.col("c_nationkey").alias("doc")).agg(F.concat(F.lit('{"head":1,"items":['), F.array_join(F.array_sort(F.collect_list(item)), ","), F.lit("]}")).alias("value"))
    rows = documents.entries(docs, "doc")
    rows = rows.withColumn("entry", documents.with_fields(F.col("entry"), {"status": F.concat(F.lit("done "), "id")}))
    again = documents.entries(documents.rewritten(rows, "doc"), "doc")
    e = F.col("entry")
    return again.select("doc", "id", documents.field(e, "status", "string").alias("status"), F.to_json(F.element_at(e, "extra")).alias("extra"), documents.state(e, "note").alias("note_state"), documents.field(e, "note", "string").alias("note"))


def track_strategies(spark: SparkSession, d: str) -> DataFrame:
    """Videos with a GPX stream, a metadata table, or both: the first that has two fixes or more counts."""
    path = _scratch(spark, "videos")
    rows = spark.read.parquet(f"{d}/customer.parquet").selectExpr("c_nationkey AS video", "c_custkey AS k", "row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i")
    point = "concat('<trkpt lat=\"38.', lpad(CAST(i AS STRING), 6, '0'), '5\" lon=\"-81.5\"><time>2024-03-01T', lpad(CAST(i DIV 3600 AS STRING), 2, '0'), ':', lpad(CAST(i DIV 60 % 60 AS STRING), 2, '0'), ':', lpad(CAST(i % 60 AS STRING), 2, '0'), 'Z</time></trkpt>')"
    stream = rows.where("video % 3 <> 1 OR i = 0").groupBy("video").agg(F.array_join(F.array_sort(F.collect_list(F.expr(point))), "\n").alias("points"))
    text = stream.selectExpr("video", "concat('<?xml version=\"1.0\"?>\n<gpx><trk><trkseg>\n', points, '\n</trkseg></trk></gpx>') AS value")
    text.repartition("video").write.partitionBy("video").text(f"{path}/gpx")
    table = rows.where("video % 4 > 0").selectExpr("video", "concat(CAST(i AS STRING), '.5 s') AS sample_time", "concat('39.', lpad(CAST(i AS STRING), 6, '0'), '5') AS gps_latitude", "'-80.5' AS gps_longitude")
    table.repartition("video").write.partitionBy("video").csv(f"{path}/csv", header=True)
    key = F.regexp_extract(F.col("_metadata.file_path"), r"video=(\d+)/", 1)
    files = rows.select(F.col("video").cast("string").alias("file")).distinct()
    found = gps.choose_tracks(files, [gps.read_gpx(spark, f"{path}/gpx/*/*.txt", key), gps.read_metadata_csv(spark, f"{path}/csv/*/*.csv", key)], strict=False)
    return found.groupBy("file", "strategy").agg(F.count("*").alias("fixes"), F.round(F.min("lat"), 7).alias("lat"), F.max("ts_ms").alias("ts_ms"))


def route_with_jitter(spark: SparkSession, d: str) -> DataFrame:
    """Detections along a route of three points a county, jittered by their hash."""
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("line_id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("ord"))
    line = n.select("line_id", "ord", (38.0 + F.col("line_id") * 0.01 + F.when(F.col("ord") == 2, 0.2).otherwise(0.0)).alias("lat"), (-81.0 + F.when(F.col("ord") > 0, 0.1).otherwise(0.0)).alias("lon"))
    out = synthetic.route(line, 20, ["StopSigns", "Curves", "Warnings"])
    return out.select("line_id", "id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "class_name", F.round("confidence", 6).alias("confidence"))


def reannotation_csv(spark: SparkSession, d: str) -> DataFrame:
    """The list of signs to annotate again, with quotes, commas and line ends in its notes, read back."""
    path = _scratch(spark, "again")
    note = F.element_at(F.array(F.lit('a "quoted" word'), F.lit("one, two"), F.lit("first\nsecond"), F.lit(None).cast("string")), (F.col("inv_id") % 4 + 1).cast("int"))
    wrong = views.inventory(spark, d).select(F.col("inv_id").alias("cluster_id"), F.col("inv_class").alias("sign_class"), F.round("inv_lat", 6).alias("lat"), F.round("inv_lon", 6).alias("lon"), note.alias("note"))
    sinks.write_csv(sinks.reannotation(wrong, 'drive "1".mp4'), path)
    back = spark.read.csv(path, header=True, escape='"', multiLine=True)
    return back.select(F.col("cluster_id").cast("long").alias("cluster_id"), "predicted_class", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.coalesce("note", F.lit("")).alias("note"), "video_source")


def recommended_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many files of each county fit a budget."""
    rows = views.manifest(spark, d).select("county", F.round(F.abs("size") * 1000).cast("long").alias("bytes"))
    return quality.recommended_sizes(rows, "county", "bytes", 2e8, 1e7).select("county", "files", F.round("mean_bytes", 3).alias("mean_bytes"), "over", "recommended")


def dataset_yaml(spark: SparkSession, d: str) -> DataFrame:
    """A dataset file for each region, its nations as classes, written and read back."""
    path = _scratch(spark, "datasets")
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_regionkey").alias("region"), F.concat("n_name", F.lit("'s")).alias("name"), F.col("n_nationkey").alias("ord"))
    sinks.dataset_yamls(n, "region", "name", "ord").repartition("region").write.partitionBy("region").text(path)
    texts = spark.read.text(f"{path}/*/*.txt", wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"region=(\d+)/", 1).cast("int").alias("file"), "value")
    return annotations.read_datasets(texts.withColumn("file", F.col("file").cast("string")))


def prefix_yaml(spark: SparkSession, d: str) -> DataFrame:
    """Ordered prefix rules of each region's nations, written and read back."""
    path = _scratch(spark, "rules")
    rule = F.format_string("  - {prefix: '%s', class: %d}", F.substring("n_name", 1, 4), "n_nationkey")
    n = spark.read.parquet(f"{d}/nation.parquet").groupBy(F.col("n_regionkey").alias("region")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", rule.alias("r")))).alias("rs"))
    n.select("region", F.concat(F.lit("rules:\n"), F.array_join(F.transform("rs", lambda x: x["r"]), "\n")).alias("value")).repartition("region").write.partitionBy("region").text(path)
    texts = spark.read.text(f"{path}/*/*.txt", wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"region=(\d+)/", 1).alias("file"), "value")
    return annotations.read_rules(texts)


QUERIES = {f.__name__: f for f in (
    asof_by_ranges, sessions_by_ranges, repeats_by_ranges, budget_by_ranges, dbscan_in_rounds, equal_sample_by_counting, quota_by_counting, background_by_counting, budget_sample, class_county_caps, class_budgets, archive_ranges,
    report_round_trip, track_strategies, route_with_jitter, reannotation_csv, recommended_sizes, dataset_yaml, prefix_yaml,
)}

_PICKED = """{name} AS (SELECT video_id, county, '{cls}' AS target_class, score FROM (SELECT *, row_number() OVER (PARTITION BY county ORDER BY score DESC, video_id) AS r FROM (SELECT video_id, county, CAST({score} AS DOUBLE) AS score FROM mf WHERE video_id NOT IN (SELECT video_id FROM {before}))) x
 WHERE r <= 3 - (SELECT count(*) FROM {before} b WHERE b.county = x.county) ORDER BY score DESC, video_id LIMIT {budget}), {name}_all AS (SELECT * FROM {before} UNION ALL SELECT * FROM {name})"""
_HAV = tracks._hav
_U = "CAST('0x' || substr(md5('{seed}|' || line_id || '/' || id), 1, 8) AS BIGINT) / 4294967296e0"


def _unit(seed: str) -> str:
    return _U.format(seed=seed)


ORACLES = {
    "asof_by_ranges": tracks.ORACLES["asof_interpolate"],
    "sessions_by_ranges": tracks.ORACLES["gap_sessions"],
    "repeats_by_ranges": f"""WITH RECURSIVE {DET}, q AS MATERIALIZED (SELECT det_idx, confidence, row_number() OVER (ORDER BY det_idx) AS r FROM d),
w AS (SELECT det_idx, confidence AS last, r, true AS kept FROM q WHERE r = 1 UNION ALL SELECT q.det_idx, CASE WHEN abs(q.confidence - w.last) >= 0.2 THEN q.confidence ELSE w.last END, q.r, abs(q.confidence - w.last) >= 0.2 FROM w JOIN q ON q.r = w.r + 1) SELECT det_idx FROM w WHERE kept""",
    "budget_by_ranges": f"WITH {MF}, c AS (SELECT video_id, CAST(round(abs(size) * 100) AS BIGINT) AS cents FROM mf), u AS (SELECT video_id, CAST(coalesce(sum(cents) OVER (ORDER BY video_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used_before FROM c) SELECT * FROM u WHERE used_before < 100000000",
    "dbscan_in_rounds": tracks.ORACLES["dbscan_components"],
    "equal_sample_by_counting": curation.ORACLES["equal_stratified_sample"],
    "quota_by_counting": curation.ORACLES["quota_sample"],
    "background_by_counting": curation.ORACLES["even_background"],
    "budget_sample": f"WITH {MF}, r AS (SELECT video_id, county, row_number() OVER (PARTITION BY county ORDER BY {curation.ORDER42.format(k='video_id')}) AS r, count(*) OVER (PARTITION BY county) // 3 AS b FROM mf) SELECT video_id, county FROM r WHERE r <= b",
    "class_county_caps": f"WITH {MF}, none AS (SELECT CAST(NULL AS BIGINT) AS video_id, '' AS county, '' AS target_class, 0e0 AS score WHERE false), "
    + ", ".join(_PICKED.format(name=n, cls=n, score=s, before=b, budget=k) for n, s, b, k in (("deer", "size", "none", 40), ("rail", "video_id % 97", "deer_all", 30), ("curve", "-size", "rail_all", 20)))
    + " SELECT video_id, county, target_class, round(score, 6) AS score FROM curve_all",
    "class_budgets": f"WITH bx AS ({views.BOXES}), c AS (SELECT cls, CAST(greatest(1, round_even(77 * (count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)), 0)) AS BIGINT) AS b FROM bx GROUP BY cls) SELECT cls, CAST(b + CASE WHEN row_number() OVER (ORDER BY b DESC, cls) = 1 THEN 77 - sum(b) OVER () ELSE 0 END AS BIGINT) AS budget FROM c",
    "archive_ranges": "SELECT 'n' || CAST(c_nationkey % 3 AS VARCHAR) || '.zip' AS archive, 'label' AS kind, 's' || CAST(c_custkey AS VARCHAR) AS stem, c_name AS content FROM customer UNION ALL SELECT 'n' || CAST(c_nationkey % 3 AS VARCHAR) || '.zip', 'image', 's' || CAST(c_custkey AS VARCHAR), 'picture' FROM customer WHERE c_custkey % 2 = 0",
    "report_round_trip": """SELECT c_nationkey AS doc, CAST(c_custkey AS VARCHAR) AS id, 'done ' || CAST(c_custkey AS VARCHAR) AS status, '{"deep":[' || CAST(c_custkey AS VARCHAR) || ',"x"]}' AS extra,
 CASE c_custkey % 3 WHEN 0 THEN 'missing' WHEN 1 THEN 'null' ELSE 'value' END AS note_state, CASE WHEN c_custkey % 3 = 2 THEN 'say "so"' END AS note FROM customer""",
    "track_strategies": """WITH r AS (SELECT c_nationkey AS video, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i FROM customer),
g AS (SELECT video, count(*) AS fixes, min(i) AS lo, max(i) AS hi FROM r WHERE video % 3 <> 1 OR i = 0 GROUP BY video HAVING count(*) >= 2), m AS (SELECT video, count(*) AS fixes, min(i) AS lo, max(i) AS hi FROM r WHERE video % 4 > 0 GROUP BY video HAVING count(*) >= 2)
SELECT CAST(video AS VARCHAR) AS file, 1 AS strategy, fixes, round(38 + (lo * 10 + 5) / 1e7, 7) AS lat, CAST(hi * 1000 AS DOUBLE) AS ts_ms FROM g
UNION ALL SELECT CAST(video AS VARCHAR), 2, fixes, round(39 + (lo * 10 + 5) / 1e7, 7), hi * 1000 + 500e0 FROM m WHERE video NOT IN (SELECT video FROM g)""",
    "route_with_jitter": f"""WITH p AS (SELECT n_nationkey AS line_id, CAST(unnest(range(20)) AS INTEGER) AS id FROM nation), l AS (SELECT *, 38e0 + line_id * 0.01e0 AS lat0, {_HAV('(38e0 + line_id * 0.01e0)', '-81e0', '(38e0 + line_id * 0.01e0)', '-80.9e0')} AS a, {_HAV('(38e0 + line_id * 0.01e0)', '-80.9e0', '(38.2e0 + line_id * 0.01e0)', '-80.9e0')} AS b FROM p),
q AS (SELECT *, (id + 0.5e0) / 20 * (a + b) AS pos FROM l) SELECT line_id, id, round(CASE WHEN pos < a THEN lat0 ELSE lat0 + 0.2e0 * (pos - a) / b END + ({_unit('11a')} - 0.5e0) * 8e-5, 6) AS lat, round(CASE WHEN pos < a THEN -81e0 + 0.1e0 * pos / a ELSE -80.9e0 END + ({_unit('11o')} - 0.5e0) * 8e-5, 6) AS lon,
 ['StopSigns', 'Curves', 'Warnings'][CAST(floor({_unit('11c')} * 3) AS INTEGER) + 1] AS class_name, round(0.3e0 + 0.7e0 * {_unit('11f')}, 6) AS confidence FROM q""",
    "reannotation_csv": f"WITH {tracks.INV} SELECT inv_id AS cluster_id, inv_class AS predicted_class, round(inv_lat, 6) AS lat, round(inv_lon, 6) AS lon, CASE inv_id % 4 WHEN 0 THEN 'a \"quoted\" word' WHEN 1 THEN 'one, two' WHEN 2 THEN 'first' || chr(10) || 'second' ELSE '' END AS note, 'drive \"1\".mp4' AS video_source FROM inv",
    "recommended_sizes": f"WITH {MF}, f AS (SELECT county, CAST(round(abs(size) * 1000) AS BIGINT) AS bytes FROM mf), s AS (SELECT county, count(*) AS files, avg(bytes) AS m, sum(bytes) + 1e7 > 2e8 AS over FROM f GROUP BY 1) SELECT county, files, round(m, 3) AS mean_bytes, over, CAST(CASE WHEN over THEN floor((2e8 - 1e7) / greatest(m, 1e0) / 4) * 4 ELSE files END AS BIGINT) AS recommended FROM s",
    "dataset_yaml": """SELECT CAST(n_regionkey AS VARCHAR) AS file, CAST(row_number() OVER w - 1 AS INTEGER) AS idx, n_name || '''s' AS name, CAST(count(*) OVER (PARTITION BY n_regionkey, split) AS INTEGER) AS nc, split,
 '/data/' || CAST(n_regionkey AS VARCHAR) || '/images/' || split AS images, '/data/' || CAST(n_regionkey AS VARCHAR) || '/labels/' || split AS labels FROM nation, (VALUES ('train'), ('val')) AS t(split) WINDOW w AS (PARTITION BY n_regionkey, split ORDER BY n_nationkey)""",
    "prefix_yaml": "SELECT CAST(n_regionkey AS VARCHAR) AS file, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS ord, substr(n_name, 1, 4) AS prefix, CAST(n_nationkey AS INTEGER) AS cls FROM nation",
}

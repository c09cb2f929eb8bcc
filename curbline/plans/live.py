"""Queries over streams: rows of the tables arrive as files, are drained through the streaming operators, and the sink's table is the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbline.plans import views
from curbline.plans.files import _scratch
from curbline.plans.tracks import DET
from curbline.streaming import repeats, streams, upsert


def _timed(spark: SparkSession, d: str) -> DataFrame:
    """Detections by event time, a tenth of a second for every one of theirs."""
    return views.detections(spark, d).select("det_idx", (F.col("video_id") % 40).alias("video"), "class_name", F.timestamp_millis((F.col("frame_ts") / 10).cast("long")).alias("ts"))


def _drained(spark: SparkSession, rows: DataFrame, f) -> DataFrame:
    """What f of the stream of rows leaves in its sink."""
    at = _scratch(spark, "stream")
    rows.write.parquet(f"{at}/in")
    streams.drain(f(streams.file_stream(spark, f"{at}/in", rows.schema)), f"{at}/out", f"{at}/progress")
    return spark.read.parquet(f"{at}/out")


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts; a window is final, and put out, once the watermark has passed its end."""
    out = _drained(spark, _timed(spark, d), lambda s: streams.windowed_counts(s, "ts", ("class_name",)))
    return out.select(F.unix_millis("start").alias("start_ms"), "class_name", "n")


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = _drained(spark, _timed(spark, d), lambda s: streams.gap_sessions(s, "video", "ts", "60 seconds", "10 minutes"))
    return out.select("video", F.unix_millis("first_ts").alias("first_ms"), F.unix_millis("last_ts").alias("last_ms"), "n")


_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stream_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Two drains of one stream whose rows lie shuffled over its files: what is kept follows event time, and state outlives the first drain. Arrow batches are
    small, so that a group has several. The files' row groups are small too, so that more tasks than files read them."""
    at, provider = _scratch(spark, "stream"), "spark.sql.streaming.stateStore.providerClass"
    rows = views.detections(spark, d).select((F.col("video_id") % 40).alias("video"), "det_idx", "confidence", F.timestamp_millis((F.col("det_idx") + 1) * 1000).alias("ts"))
    before = {k: spark.conf.get(k) for k in (provider, _ARROW_ROWS)}
    repeats.use_rocksdb(spark)
    spark.conf.set(_ARROW_ROWS, "50")
    try:
        middle = rows.agg(F.percentile_approx("det_idx", 0.5)).first()[0] or 0
        for part in (rows.where(F.col("det_idx") <= middle), rows.where(F.col("det_idx") > middle)):
            part.repartition(3, F.xxhash64("det_idx")).sortWithinPartitions(F.xxhash64("det_idx")).write.option("parquet.block.size", 1 << 24).mode("append").parquet(f"{at}/in")
            streams.drain(repeats.suppress_repeats(streams.file_stream(spark, f"{at}/in", rows.schema), "video", "ts", "confidence", 0.2, "det_idx", "1 minute"), f"{at}/out", f"{at}/progress")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(rows.schema).parquet(f"{at}/out").select("video", "det_idx")


def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Review events merged by key as their batches come, the last of each item staying; every batch is merged twice, as after a failure."""
    at = _scratch(spark, "stream")
    rows = views.detections(spark, d).select((F.col("det_idx") % 500).alias("item"), "det_idx", "class_name")
    table = upsert.KeyedTable(spark, f"{at}/table", rows.schema, "item", 8)

    def merge(batch: DataFrame, number: int) -> None:
        for again in (False, True):
            if table.merge(batch, number, "det_idx") == again:
                raise ValueError(f"batch {number} was merged twice")

    rows.repartition(4, "det_idx").write.parquet(f"{at}/in")
    streams.drain_each(streams.file_stream(spark, f"{at}/in", rows.schema, 1), merge, f"{at}/progress")
    return table.read()


def stream_resume(spark: SparkSession, d: str) -> DataFrame:
    """Three drains of one stream, the last without anything new: every row is processed once, and rows done elsewhere are skipped."""
    at = _scratch(spark, "stream")
    rows = views.manifest(spark, d).select("video_id", "county")
    done = rows.where("video_id % 10 = 0").select("video_id")

    def keep(batch: DataFrame, number: int) -> None:  # under its number: a batch that is run twice is there once
        streams.new_only(batch, done, "video_id").write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    for k in (0, 1, None):
        if k is not None:
            rows.where(F.col("video_id") % 2 == k).write.mode("append").parquet(f"{at}/in")
        streams.drain_each(streams.file_stream(spark, f"{at}/in", rows.schema), keep, f"{at}/progress")
    return spark.read.parquet(f"{at}/out").drop("batch")


def stream_distinct(spark: SparkSession, d: str) -> DataFrame:
    return _drained(spark, _timed(spark, d), lambda s: streams.first_of_each(s, ["video", "class_name"], "ts", "40 days")).select("video", "class_name")


QUERIES = {f.__name__: f for f in (stream_windows, stream_sessions, stream_repeats, stream_upsert, stream_resume, stream_distinct)}

_TD = f"{DET}, td AS (SELECT det_idx, video_id % 40 AS video, class_name, frame_ts // 10 AS t FROM d)"
ORACLES = {
    "stream_windows": f"WITH {_TD} SELECT CAST(t // 3600000 * 3600000 AS BIGINT) AS start_ms, class_name, count(*) AS n FROM td GROUP BY 1, 2 HAVING t // 3600000 * 3600000 + 3600000 <= (SELECT max(t) - 3600000 FROM td)".replace("HAVING t // 3600000 * 3600000", "HAVING start_ms"),
    "stream_sessions": f"""WITH {_TD}, g AS (SELECT video, t, CASE WHEN t - lag(t) OVER (PARTITION BY video ORDER BY t) <= 60000 THEN 0 ELSE 1 END AS s FROM td), k AS (SELECT video, t, sum(s) OVER (PARTITION BY video ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT video, CAST(min(t) AS BIGINT) AS first_ms, CAST(max(t) AS BIGINT) AS last_ms, count(*) AS n FROM k GROUP BY video, k HAVING max(t) + 60000 <= (SELECT max(t) - 600000 FROM td)""",
    "stream_repeats": f"""WITH RECURSIVE {DET}, q AS MATERIALIZED (SELECT video_id % 40 AS video, det_idx, confidence, row_number() OVER (PARTITION BY video_id % 40 ORDER BY det_idx) AS r FROM d),
w AS (SELECT video, det_idx, confidence AS last, r, true AS kept FROM q WHERE r = 1 UNION ALL SELECT q.video, q.det_idx, CASE WHEN abs(q.confidence - w.last) >= 0.2 THEN q.confidence ELSE w.last END, q.r, abs(q.confidence - w.last) >= 0.2 FROM w JOIN q ON q.video = w.video AND q.r = w.r + 1)
SELECT video, det_idx FROM w WHERE kept AND det_idx * 1000 < (SELECT max(det_idx) * 1000 - 60000 FROM d)""",
    "stream_upsert": f"WITH {DET} SELECT det_idx % 500 AS item, max(det_idx) AS det_idx, arg_max(class_name, det_idx) AS class_name FROM d GROUP BY 1",
    "stream_resume": f"WITH m AS ({views.MANIFEST}) SELECT video_id, county FROM m WHERE video_id % 10 <> 0",
    "stream_distinct": f"WITH {_TD} SELECT DISTINCT video, class_name FROM td",
}

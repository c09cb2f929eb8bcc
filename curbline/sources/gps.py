"""GPS tracks from caption files, CSV, metadata CSV and GPX as (file, ts_ms, lat, lon, alt, ord)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curbline.functions.geo import valid_fix
from curbline.functions.text import coordinate, leading_number, timestamp_ms

# The shapes of a position in captions, and of the time line.
CAPTION_SHAPES = [
    r"GPS\s*\(\s*(-?\d+\.\d+)\s*,\s*(-?\d+\.\d+)\s*(?:,\s*(-?\d+\.?\d*))?\s*\)",
    r"GPS\s*:\s*(-?\d+\.\d+)\s*,\s*(-?\d+\.\d+)",
    r"(?s)[Ll]at\s*[=:]\s*(-?\d+\.\d+).*?[Ll]on\s*[=:]\s*(-?\d+\.\d+)",
]
TIME_LINE = r"(\d{2}):(\d{2}):(\d{2})[,.](\d{3})\s*-->"
# Header names, in lower case.
ALIASES = {"lat": {"lat", "latitude"}, "lon": {"lon", "lng", "longitude", "long"}, "ts": {"timestamp", "time", "ts", "datetime"}, "alt": {"altitude", "alt", "elevation"}}
METADATA = {"sample": {"sample_time"}, "clock": {"gps_timestamp", "gpsdatetime"}, "lat": {"gps_latitude", "gpslatitude"}, "lon": {"gps_longitude", "gpslongitude"}, "alt": {"gps_altitude", "gpsaltitude"}}
#: First times above a day are absolute and count from the first.
DAY_MS = 86_400_000


def _group(text: Column, shape: str, k: int) -> Column:
    return F.regexp_extract(text, shape, k).try_cast("double")


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    """Caption (SRT) files: one fix a block that has a time line and a position; out-of-range positions and null islands go."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", r"\r?\n\s*\r?\n")).alias("ord", "block"))
    return parse_captions(text)


def parse_captions(text: DataFrame) -> DataFrame:
    """The fixes of caption blocks (file, ord, block)."""
    part = lambda k: F.regexp_extract("block", TIME_LINE, k).try_cast("long")
    ms = ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + part(4)
    first = lambda k: F.coalesce(*(F.when(F.rlike("block", F.lit(s)), _group(F.col("block"), s, k)) for s in CAPTION_SHAPES))
    alt = F.when(F.rlike("block", F.lit(CAPTION_SHAPES[0])), _group(F.col("block"), CAPTION_SHAPES[0], 3))
    rows = text.select("file", ms.cast("double").alias("ts_ms"), first(1).alias("lat"), first(2).alias("lon"), alt.alias("alt"), F.col("ord").cast("long").alias("ord"))
    return rows.where("ts_ms is not null and lat is not null and lon is not null").where(valid_fix(F.col("lat"), F.col("lon")))


def _column(columns: list[str], names: set[str]) -> str | None:
    return next((c for c in columns if c.strip().lower() in names), None)


#: What a fix says of its file, unless a reader is told otherwise.
FILE = "_metadata.file_name"


def _csv(spark: SparkSession, path: str, key: Column | None = None) -> DataFrame:
    rows = spark.read.csv(path, header=True, escape='"')
    return rows.select("*", (F.col(FILE) if key is None else key).alias("file"), F.col("_metadata.file_path").alias("_path"), F.monotonically_increasing_id().alias("ord"))


def _found(columns: list[str], wanted: dict[str, set[str]], path: str, needed: tuple[str, ...]) -> dict[str, Column]:
    """The columns by what they hold, whatever the case and spaces of their headers; null where there is none."""
    names = {k: _column(columns, v) for k, v in wanted.items()}
    if missing := [k for k in needed if not names[k]]:
        raise ValueError(f"{path} has no column for {', '.join(missing)} among {columns}")
    return {k: F.col(f"`{n}`") if n else F.lit(None).cast("string") for k, n in names.items()}


def _rebased(rows: DataFrame) -> DataFrame:
    least = F.min("ts_ms").over(Window.partitionBy("_path"))
    return rows.withColumn("_m", least).withColumn("ts_ms", F.when(F.col("_m") > DAY_MS, F.col("ts_ms") - F.col("_m")).otherwise(F.col("ts_ms"))).drop("_m", "_path")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with any of the usual header names; unreadable rows go, unreadable altitudes are null."""
    rows = _csv(spark, path)
    c = _found(rows.columns, ALIASES, path, ("lat", "lon", "ts"))
    out = rows.select("file", "_path", timestamp_ms(F.trim(c["ts"])).alias("ts_ms"), *(c[k].try_cast("double").alias(k) for k in ("lat", "lon", "alt")), "ord")
    return _rebased(out.where("ts_ms is not null and lat is not null and lon is not null").where(valid_fix(F.col("lat"), F.col("lon"))))


def read_metadata_csv(spark: SparkSession, path: str, key: Column | None = None) -> DataFrame:
    """CSV of a metadata tool: sample seconds if any row of the file has them, else absolute times from the first row's. Headers are as the tool
    writes them, with or without underscores, in any case."""
    rows = _csv(spark, path, key)
    c = _found(rows.columns, METADATA, path, ("lat", "lon"))
    clock = F.regexp_replace(c["clock"], r"^(\d{4}):(\d{2}):", "$1-$2-")
    out = rows.select(
        "file", "_path", (leading_number(c["sample"]) * 1000).alias("sample_ms"), timestamp_ms(clock).alias("clock_ms"), coordinate(c["lat"]).alias("lat"),
        coordinate(c["lon"]).alias("lon"), leading_number(c["alt"]).alias("alt"), "ord",
    )
    w = Window.partitionBy("_path")
    start = F.first("clock_ms", ignorenulls=True).over(w.orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    sampled = F.max(F.col("sample_ms").isNotNull()).over(w)
    out = out.withColumn("ts_ms", F.when(sampled, F.col("sample_ms")).otherwise(F.col("clock_ms") - start))
    return out.select("file", "ts_ms", "lat", "lon", "alt", "ord").where("ts_ms is not null and lat is not null and lon is not null").where(valid_fix(F.col("lat"), F.col("lon")))


def read_gpx(spark: SparkSession, path: str, key: Column | None = None) -> DataFrame:
    """Track points of GPX files from the first one's time on; a track of fewer than two timed points is none."""
    schema = "_lat double, _lon double, ele double, time string"
    rows = spark.read.format("xml").option("rowTag", "trkpt").schema(schema).load(path)
    out = rows.select((F.col(FILE) if key is None else key).alias("file"), F.col("_metadata.file_path").alias("_path"), timestamp_ms(F.col("time")).alias("t"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), F.col("ele").alias("alt"), F.monotonically_increasing_id().alias("ord"))
    w = Window.partitionBy("_path")
    out = out.where("t is not null").where(valid_fix(F.col("lat"), F.col("lon"))).withColumn("n", F.count("*").over(w)).where("n >= 2")
    return out.select("file", (F.col("t") - F.min("t").over(w)).alias("ts_ms"), "lat", "lon", "alt", "ord")


#: A strategy is accepted for a file if it finds so many fixes.
LEAST_FIXES = 2


def choose_tracks(files: DataFrame, strategies: list[DataFrame], strict: bool = True) -> DataFrame:
    """The fixes of each file (file) by the first of the strategies' tracks that has LEAST_FIXES or more of it, with strategy, its number from 1. A file for
    which none has is an error, or with strict=False has no rows."""
    every = None
    for k, rows in enumerate(strategies, 1):
        one = rows.withColumn("strategy", F.lit(k))
        every = one if every is None else every.unionByName(one)
    counts = every.groupBy("file", "strategy").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_FIXES)
    chosen = files.select("file").distinct().join(counts.groupBy("file").agg(F.min("strategy").alias("strategy")), "file", "left")
    if strict:
        failed = F.raise_error(F.concat(F.lit("no strategy finds a track in "), "file"))
        chosen = chosen.withColumn("strategy", F.coalesce("strategy", failed.cast("int")))
    return every.join(chosen.where("strategy is not null"), ["file", "strategy"])


def read_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """The reader for a file by its name and, for CSV, its header. A track without a fix is an error."""
    if path.lower().endswith(".srt"):
        out = read_captions(spark, path)
    elif path.lower().endswith(".gpx"):
        out = read_gpx(spark, path)
    elif path.lower().endswith(".csv"):
        header = {c.strip().lower() for c in spark.read.csv(path, header=True).columns}
        out = read_metadata_csv(spark, path) if header & METADATA["lat"] and header & METADATA["lon"] else read_csv(spark, path)
    else:
        raise ValueError(f"no reader for {path}")
    if out.isEmpty():
        raise ValueError(f"no fix in {path}")
    return out

"""Synthetic routes: detections along a polyline, the same on every run and partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbline.functions.geo import haversine_m, lerp
from curbline.functions.text import stable_order


def along_line(points: DataFrame, line: DataFrame, fraction: str = "fraction") -> DataFrame:
    """points with lat and lon at a fraction of the line's length; line is (line_id, ord, lat, lon), points have line_id. Segments carry the
    length before them; a fraction falls into one of them."""
    w = Window.partitionBy("line_id").orderBy("ord")
    seg = line.select("line_id", "lat", "lon", F.lead("lat").over(w).alias("lat2"), F.lead("lon").over(w).alias("lon2"), "ord")
    seg = seg.where("lat2 is not null").withColumn("len", haversine_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")))
    seg = seg.withColumn("before", F.coalesce(F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("total", F.sum("len").over(Window.partitionBy("line_id")))
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(fraction))) * F.col("total")
    last = F.col("before") + F.col("len") >= F.col("total") * (1 - 1e-12)
    hit = points.join(seg, "line_id").withColumn("at", at).where((F.col("at") >= F.col("before")) & ((F.col("at") < F.col("before") + F.col("len")) | last))
    f = F.when(F.col("len") > 0, (F.col("at") - F.col("before")) / F.col("len")).otherwise(F.lit(0.0))
    return hit.select(*points.columns, lerp(hit["lat"], F.col("lat2"), f).alias("lat"), lerp(hit["lon"], F.col("lon2"), f).alias("lon"))


def _unit(seed: str, key: Column) -> Column:
    return F.conv(F.substring(stable_order(seed, key), 1, 8), 16, 10).cast("double") / float(1 << 32)


def route(line: DataFrame, n: int, classes: list[str], seed: int = 11, jitter_deg: float = 4e-5) -> DataFrame:
    """n detections spread over each line with hashed jitter, class and confidence."""
    ids = line.select("line_id").distinct().withColumn("id", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("id", "line_id")
    key = F.concat_ws("/", "line_id", "id")
    placed = along_line(ids.withColumn("fraction", (F.col("id") + 0.5) / n), line)
    cls = F.element_at(F.array(*(F.lit(c) for c in classes)), (F.floor(_unit(f"{seed}c", key) * len(classes)) + 1).cast("int"))
    return placed.select("line_id", "id", (F.col("lat") + (_unit(f"{seed}a", key) - 0.5) * 2 * jitter_deg).alias("lat"), (F.col("lon") + (_unit(f"{seed}o", key) - 0.5) * 2 * jitter_deg).alias("lon"), cls.alias("class_name"), (0.3 + 0.7 * _unit(f"{seed}f", key)).alias("confidence"))

"""Clusters against the official inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbline.functions.classify import NOT_INVENTORIED, collapse
from curbline.functions.geo import CORRIDOR_M_PER_DEG, valid_fix
from curbline.operators.ordered import numbered
from curbline.operators.spatial import nearest, within
from curbline.plans.session import cut

MATCH_M, MISSING_M, CORRIDOR_M = 25.0, 60.0, 60.0


def corridor(points: DataFrame, buffer_m: float = CORRIDOR_M, lat: str = "lat_median", lon: str = "lon_median") -> DataFrame:
    """One row: the bounding box of the located points with a margin, and their number."""
    pad_lat = F.lit(buffer_m / CORRIDOR_M_PER_DEG)
    box = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).agg(F.min(lat).alias("lat0"), F.max(lat).alias("lat1"), F.min(lon).alias("lon0"), F.max(lon).alias("lon1"), F.avg(lat).alias("mid"), F.count("*").alias("n_located"))
    pad_lon = F.lit(buffer_m) / (CORRIDOR_M_PER_DEG * F.cos(F.radians("mid")))
    return box.select((F.col("lat0") - pad_lat).alias("lat0"), (F.col("lat1") + pad_lat).alias("lat1"), (F.col("lon0") - pad_lon).alias("lon0"), (F.col("lon1") + pad_lon).alias("lon1"), "n_located")


def in_corridor(inventory: DataFrame, points: DataFrame, buffer_m: float = CORRIDOR_M) -> DataFrame:
    """Inventory inside the corridor of the points; all of it if no point is located. The box is a single row, so broadcasting it is safe."""
    inside = F.col("inv_lat").between(F.col("lat0"), F.col("lat1")) & F.col("inv_lon").between(F.col("lon0"), F.col("lon1"))
    joined = inventory.join(F.broadcast(corridor(points, buffer_m)), F.lit(True), "left")
    return joined.where((F.coalesce(F.col("n_located"), F.lit(0)) == 0) | inside).drop("lat0", "lat1", "lon0", "lon1", "n_located")


def match(clusters: DataFrame, inventory: DataFrame, radius_m: float = MATCH_M) -> DataFrame:
    """(cluster_id, inv_ord, inv_id, inv_class, dist_m): each cluster's nearest inventory sign within the radius, of any class."""
    return nearest(clusters.select("cluster_id", "lat_median", "lon_median"), inventory, radius_m, "cluster_id", "inv_ord", ("lat_median", "lon_median"), ("inv_lat", "inv_lon"), ("inv_id", "inv_class"))


def missing(clusters: DataFrame, inventory: DataFrame, matched: DataFrame, radius_m: float = MISSING_M) -> DataFrame:
    """Inventory signs in reach of a cluster that no cluster matched, but for classes the inventory does not cover. Without any located cluster
    every such sign is missing."""
    asked = inventory.where(~F.col("inv_class").isin(*NOT_INVENTORIED)).join(matched.select("inv_ord").distinct(), "inv_ord", "left_anti")
    points = clusters.where("lat_median is not null and lon_median is not null").select(F.col("lat_median").alias("r_lat"), F.col("lon_median").alias("r_lon")).distinct()
    places = within(asked.select("inv_lat", "inv_lon").distinct(), points, radius_m, (), ("inv_lat", "inv_lon")).select("inv_lat", "inv_lon").distinct()
    reached = asked.join(places, ["inv_lat", "inv_lon"]).select("inv_ord")
    located = points.agg((F.count("*") > 0).alias("any"))
    out = asked.join(reached.withColumn("reached", F.lit(True)), "inv_ord", "left").join(F.broadcast(located), F.lit(True))
    return out.where("reached or not any").drop("reached", "any")


def reconcile(clusters: DataFrame, inventory: DataFrame, radius_m: float = MATCH_M, missing_m: float = MISSING_M, corridor_m: float = CORRIDOR_M) -> DataFrame:
    """clusters with inventory_match, inventory_distance_m, inventory_class and discrepancy_type, and a row for each missing sign, numbered on.

    A matched cluster of another class is a class_mismatch, an unmatched one detected_not_in_inventory, a missing sign
    in_inventory_not_detected; each asks for review and says why.
    """
    clusters = cut(clusters)  # used many times below
    signs = inventory.where(valid_fix(F.col("inv_lat"), F.col("inv_lon"))).select("inv_ord", "inv_id", "inv_class", "inv_lat", "inv_lon")
    nearby = cut(in_corridor(signs, clusters, corridor_m).repartition("inv_ord"))  # read by the matches and four times by what is missing; of few files
    matched = cut(match(clusters, nearby, radius_m))
    both = clusters.join(matched, "cluster_id", "left")
    differs = collapse(F.col("sign_class")) != collapse(F.col("inv_class"))
    kind = F.when(F.col("inv_id").isNull(), "detected_not_in_inventory").when(differs, "class_mismatch")
    why = F.when(F.col("inv_id").isNull(), "Not in inventory").when(differs, F.format_string("Class mismatch (detected %s, inventory %s)", "sign_class", "inv_class"))
    found = both.select(
        "cluster_id", "sign_class", "confidence", "sighting_count", (F.col("needs_review") | kind.isNotNull()).alias("needs_review"),
        F.nullif(F.concat_ws("; ", "review_reason", why), F.lit("")).alias("review_reason"), "lat_median", "lon_median",
        F.col("inv_id").cast("string").alias("inventory_match"), F.round("dist_m", 2).alias("inventory_distance_m"), F.col("inv_class").alias("inventory_class"), kind.alias("discrepancy_type"),
    )
    gone = missing(clusters, nearby, matched, missing_m)
    top = clusters.agg(F.coalesce(F.max("cluster_id"), F.lit(0)).alias("top"))
    gone = numbered(gone, ("inv_ord",), "_n").join(F.broadcast(top), F.lit(True)).select(
        (F.col("top") + F.col("_n")).alias("cluster_id"), F.col("inv_class").alias("sign_class"), F.lit(0.0).alias("confidence"), F.lit(0).cast("long").alias("sighting_count"), F.lit(True).alias("needs_review"),
        F.lit("In inventory but not detected").alias("review_reason"), F.col("inv_lat").alias("lat_median"), F.col("inv_lon").alias("lon_median"),
        F.col("inv_id").cast("string").alias("inventory_match"), F.lit(None).cast("double").alias("inventory_distance_m"), F.col("inv_class").alias("inventory_class"), F.lit("in_inventory_not_detected").alias("discrepancy_type"),
    )
    return found.unionByName(gone)

"""GeoJSON feature collections in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbline.functions.classify import collapse, normalize_sign_class

FEATURES = "type string, features array<struct<type:string,geometry:struct<type:string,coordinates:array<double>>,properties:map<string,string>>>"


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, lon, lat, properties) of every point feature of a file or folder, files in the order of their names."""
    rows = spark.read.schema(FEATURES).json(path, multiLine=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode("features").alias("ord", "f"))
    at = lambda i: F.get("f.geometry.coordinates", F.lit(i))
    return rows.select("file", "ord", at(0).alias("lon"), at(1).alias("lat"), F.col("f.properties").alias("properties"))


def read_feature_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same of files with one feature a line, which any size can be read of in parallel; ord is the place among the rows of this reading."""
    one = "type string, geometry struct<type:string,coordinates:array<double>>, properties map<string,string>"
    rows = spark.read.schema(one).json(path).select("*", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("ord"))
    at = lambda i: F.get("geometry.coordinates", F.lit(i))
    return rows.select("file", "ord", at(0).alias("lon"), at(1).alias("lat"), "properties")


def read_inventory(spark: SparkSession, path: str, overwrite: bool = True) -> DataFrame:
    """Inventory signs with sign_class by code and category; overwrite replaces a class that is there already."""
    return inventory_signs(read_features(spark, path), overwrite)


def inventory_signs(rows: DataFrame, overwrite: bool = True) -> DataFrame:
    """read_inventory's columns of features that are read already."""
    prop = lambda k: F.try_element_at("properties", F.lit(k))
    cls = normalize_sign_class(prop("MUTCDCODE"), prop("MUTCDCAT"))
    if not overwrite:
        cls = F.coalesce(F.nullif(prop("sign_class"), F.lit("")), cls)
    return rows.select(prop("OBJECTID").alias("inv_id"), F.struct("file", "ord").alias("inv_ord"), F.col("lat").alias("inv_lat"), F.col("lon").alias("inv_lon"), cls.alias("inv_class"), F.col("file").alias("inventory_source"), "properties")


def feature(lat: str, lon: str, properties: Column) -> Column:
    """A GeoJSON feature as a JSON string."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")), {"ignoreNullFields": "false"})


def features(clusters: DataFrame, lat: str = "lat_median", lon: str = "lon_median", cls: str = "sign_class") -> DataFrame:
    """One feature a located cluster; the position is the geometry and no property, classes shown as one are merged."""
    props = F.struct(*(collapse(F.col(c)).alias(c) if c == cls else F.col(c) for c in clusters.columns if c not in (lat, lon)))
    return clusters.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(feature(lat, lon, props).alias("value"))


def write_lines(clusters: DataFrame, path: str) -> None:
    """One feature a line: any size, in parallel."""
    features(clusters).write.mode("overwrite").text(path)


def collection(clusters: DataFrame) -> DataFrame:
    """One row, a whole FeatureCollection: for the result of one run, which a map loads at once."""
    parts = features(clusters).agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("f"))
    return parts.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.col("f"), F.lit("]}")).alias("value"))

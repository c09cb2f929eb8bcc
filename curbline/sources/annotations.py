"""Annotation files: label lines, exports, JSON annotations, archives, and lists of names."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label files as (stem, line_no, n_fields, class_text, class_idx, cx, cy, w, h, raw). Consumers choose how many fields they ask for."""
    return parse_labels(spark.read.text(path, wholetext=True).select(F.regexp_replace("_metadata.file_name", r"\.txt$", "").alias("stem"), "value"))


def parse_labels(texts: DataFrame) -> DataFrame:
    """The lines of label texts (stem, value)."""
    rows = texts.select("stem", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "raw"))
    f = F.split(F.trim("raw"), r"\s+")
    num = lambda i: F.get("f", F.lit(i)).try_cast("double")
    return rows.where(F.trim("raw") != "").withColumn("f", f).select(
        "stem", "line_no", F.size("f").alias("n_fields"), F.get("f", F.lit(0)).alias("class_text"), F.get("f", F.lit(0)).try_cast("int").alias("class_idx"), num(1).alias("cx"), num(2).alias("cy"), num(3).alias("w"), num(4).alias("h"), "raw",
    )


def read_semicolon_boxes(spark: SparkSession, path: str) -> DataFrame:
    """(filename, tag, x1, y1, x2, y2); header rows go wherever they are."""
    rows = spark.read.csv(path, sep=";", header=False)
    pick = [F.col(rows.columns[i]) for i in range(6)]
    names = ["filename", "tag", "x1", "y1", "x2", "y2"]
    out = rows.select(*(c.try_cast("int").alias(n) if i > 1 else c.alias(n) for i, (c, n) in enumerate(zip(pick, names, strict=True))))
    return out.where(F.col("filename") != "Filename")


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """Lines "name: a, b" as (name, category, ord): the distinct categories in order of appearance."""
    return parse_categories(spark.read.text(path, wholetext=True))


def parse_categories(texts: DataFrame) -> DataFrame:
    rows = texts.select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "v")).where(F.contains("v", F.lit(":")))
    parts = rows.select("line", F.trim(F.split_part("v", F.lit(":"), F.lit(1))).alias("name"), F.posexplode(F.split(F.regexp_replace("v", r"^[^:]*:", ""), ",")).alias("pos", "c"))
    return parts.where(F.trim("c") != "").groupBy("name", F.trim("c").alias("category")).agg(F.min(F.struct("line", "pos")).alias("ord"))


OBJECTS = "width int, height int, objects array<struct<label:string,bbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>,properties:struct<occluded:boolean,ambiguous:boolean,`out-of-frame`:boolean>>>"


def read_object_json(spark: SparkSession, path: str) -> DataFrame:
    """One row a usable object: (stem, width, height, label, xmin, ymin, xmax, ymax); occluded, ambiguous and out-of-frame ones go."""
    return usable_objects(spark.read.schema(OBJECTS).json(path, multiLine=True).select("*", F.regexp_replace("_metadata.file_name", r"\.json$", "").alias("stem")))


def parse_object_json(texts: DataFrame) -> DataFrame:
    """As read_object_json, of documents (stem, value) that are rows already."""
    return usable_objects(texts.select("stem", F.from_json("value", OBJECTS).alias("d")).select("stem", "d.*"))


def usable_objects(rows: DataFrame) -> DataFrame:
    bad = lambda o: F.coalesce(o["properties"]["occluded"], F.lit(False)) | F.coalesce(o["properties"]["ambiguous"], F.lit(False)) | F.coalesce(o["properties"]["out-of-frame"], F.lit(False))
    return rows.select("stem", "width", "height", F.explode(F.filter("objects", lambda o: ~bad(o))).alias("o")).select("stem", "width", "height", "o.label", "o.bbox.*")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")


def with_split(images: DataFrame, lists: dict[str, DataFrame], key: str = "stem") -> DataFrame:
    """images with the split whose list names them, else train."""
    named = None
    for split, names in lists.items():
        part = names.select(F.col("value").alias(key), F.lit(split).alias("split"))
        named = part if named is None else named.unionByName(part)
    named = named.groupBy(key).agg(F.min("split").alias("split"))
    return images.join(named, key, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def image_index(files: DataFrame) -> DataFrame:
    """(stem, path) of a listing (path, ord): of files with one stem the last counts."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return files.withColumn("stem", stem).groupBy("stem").agg(F.max_by("path", "ord").alias("path"))


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, ord) of the files under a folder, without their content."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", F.col("length").alias("bytes"))
    return rows.withColumn("ord", F.col("path"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, kind, stem, content) of the labels and images in zip files; the first of a stem and kind in an archive counts."""
    return open_archives(spark.read.format("binaryFile").load(path).select("path", "content"))


def open_archives(archives: DataFrame) -> DataFrame:
    """The same of archives (path, content) that are rows already. An archive is opened where it is, entry by entry, and entries go on by a few hundred or
    a few MB; one of over 2 GB does not fit a row."""
    names = ["archive", "kind", "stem", "content"]

    def entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                seen, rows, held = set(), [], 0
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        base = info.filename.replace("\\", "/").rsplit("/", 1)[-1]
                        stem, _, ext = base.rpartition(".")
                        kind = "label" if ext.lower() == "txt" else "image" if ext.lower() in ("jpg", "jpeg", "png") else None
                        if kind and stem and base not in ("classes.txt", "notes.json") and (kind, stem) not in seen:
                            seen.add((kind, stem))
                            rows.append((name, kind, stem, z.read(info)))
                            held += info.file_size
                            if len(rows) == 500 or held > 4 << 20:
                                yield pd.DataFrame(rows, columns=names)
                                rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return archives.select("path", "content").mapInPandas(entries, "archive string, kind string, stem string, content binary")


def merge_rounds(rounds: DataFrame, seen: DataFrame | None = None, seen_round: int | None = None) -> DataFrame:
    """First-wins merge of export rounds: (round, kind annotated or background, stem, has_image, ord). Labels without an image never count; annotated
    rows come before backgrounds of their round; stems already seen are skipped among the backgrounds of one round."""
    rows = rounds.where("has_image")
    if seen is not None:
        known = seen.select(F.col("value").alias("stem"), F.lit(True).alias("_seen")).distinct()
        rows = rows.join(known, "stem", "left").where(~((F.col("kind") == "background") & (F.col("round") == F.lit(seen_round)) & F.coalesce("_seen", F.lit(False)))).drop("_seen")
    order = Window.partitionBy("stem").orderBy("round", F.when(F.col("kind") == "annotated", 0).otherwise(1), "ord")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def round_summary(rounds: DataFrame, kept: DataFrame) -> DataFrame:
    """Counters a round: rows, without image, annotated and background kept, dropped as repeats."""
    a = rounds.groupBy("round").agg(F.count("*").alias("rows"), F.count_if(~F.col("has_image")).alias("label_without_image"), F.count_if(F.col("kind") == "annotated").alias("annotated"), F.count_if(F.col("kind") == "background").alias("background"))
    b = kept.groupBy("round").agg(F.count_if(F.col("kind") == "annotated").alias("annotated_kept"), F.count_if(F.col("kind") == "background").alias("background_kept"))
    out = a.join(b, "round", "left").na.fill(0)
    return out.withColumn("repeats", F.col("rows") - F.col("label_without_image") - F.col("annotated_kept") - F.col("background_kept"))


def read_ids(spark: SparkSession, paths: list[str], column: str = "video_id") -> DataFrame:
    """The distinct ids of several CSV files, of column or else the first one. Files that are not there are passed over."""
    fs = spark._jvm.org.apache.hadoop.fs
    out = None
    for p in paths:
        hp = fs.Path(p)
        if not hp.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hp):
            continue
        rows = spark.read.csv(p, header=True, escape='"')
        ids = rows.select(F.col(f"`{column if column in rows.columns else rows.columns[0]}`").alias(column))
        out = ids if out is None else out.unionByName(ids)
    return (out if out is not None else spark.createDataFrame([], f"{column} string")).where(F.col(column).isNotNull()).distinct()


MANIFEST = "video_id string, video_link string, sign_system_label string, primary_county string, filename string"


def read_manifest(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A manifest with all columns as strings, by its header or the given schema."""
    return spark.read.csv(path, header=True, schema=schema, escape='"')


def parse_dataset(text: str) -> dict:
    """A dataset's YAML: names as a list, nc from them, and for each split its images and labels folders."""
    import yaml

    raw = yaml.safe_load(text)
    names = raw.get("names") or []
    names = [names[k] for k in sorted(names)] if isinstance(names, dict) else list(names)
    root = str(raw.get("path", "")).rstrip("/")
    splits = {}
    for split in ("train", "val", "test"):
        if raw.get(split):
            images = f"{root}/{raw[split]}" if root and not str(raw[split]).startswith("/") else str(raw[split])
            head, _, tail = images.rpartition("images")
            splits[split] = {"images": images, "labels": f"{head}labels{tail}" if "images" in images else images}
    return {"names": names, "nc": len(names), "splits": splits}


def dataset_config(path: str) -> dict:
    """parse_dataset of a file the driver can open."""
    with open(path) as f:
        return parse_dataset(f.read())


def read_datasets(texts: DataFrame) -> DataFrame:
    """(file, idx, name, nc, split, images, labels) of dataset files (file, value): a row a class and split."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for file, text in zip(pdf["file"], pdf["value"], strict=True):
                found = parse_dataset(text)
                rows = [(file, i, n, found["nc"], k, s["images"], s["labels"]) for i, n in enumerate(found["names"]) for k, s in found["splits"].items()]
                yield pd.DataFrame(rows, columns=["file", "idx", "name", "nc", "split", "images", "labels"])

    return texts.select("file", "value").mapInPandas(parse, "file string, idx int, name string, nc int, split string, images string, labels string")


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """Frame clusters (frame_stem, cluster_id, split, keep, targeted_classes) with keep as a boolean and the classes as an array."""
    rows = spark.read.csv(path, header=True, escape='"')
    return rows.withColumn("keep", F.lower("keep") == "true").withColumn("targeted_classes", F.filter(F.split(F.coalesce("targeted_classes", F.lit("")), r"\|"), lambda c: c != ""))


def parse_rules(text: str) -> list[tuple[str, int]]:
    """Ordered (prefix, class) rules of YAML."""
    import yaml

    return [(str(r["prefix"]), r["class"]) for r in yaml.safe_load(text)["rules"]]


def prefix_rules(path: str) -> list[tuple[str, int]]:
    """parse_rules of a file the driver can open."""
    with open(path) as f:
        return parse_rules(f.read())


def read_rules(texts: DataFrame) -> DataFrame:
    """(file, ord, prefix, cls) of rule files (file, value)."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for file, text in zip(pdf["file"], pdf["value"], strict=True):
                yield pd.DataFrame([(file, k, p, c) for k, (p, c) in enumerate(parse_rules(text))], columns=["file", "ord", "prefix", "cls"])

    return texts.select("file", "value").mapInPandas(parse, "file string, ord int, prefix string, cls int")

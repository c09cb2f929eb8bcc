"""Label folders, dataset and report files. Bulk outputs are written in parallel; single documents are reports of one run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbline.functions import box as B
from curbline.operators.ordered import numbered


def write_csv(rows: DataFrame, path: str, mode: str = "overwrite", single: bool = False, order: tuple[str, ...] = ()) -> None:
    """CSV with a header and doubled quotes; mode append adds files, whose readers see one table."""
    rows = rows.orderBy(*order) if order else rows
    (rows.coalesce(1) if single else rows).write.mode(mode).csv(path, header=True, escape='"')


def label_text(boxes: DataFrame, stem: str = "stem") -> DataFrame:
    """(stem, text): a label file's lines, class and six decimals, in line order."""
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "class_idx", "cx", "cy", "w", "h")
    return boxes.groupBy(stem).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", line.alias("t")))), lambda x: x["t"]), "\n").alias("text"))


def write_label_folder(boxes: DataFrame, path: str, stem: str = "stem") -> None:
    """A folder of texts a stem."""
    label_text(boxes, stem).write.mode("overwrite").partitionBy(stem).text(path)


def coco(images: DataFrame, boxes: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, categories) with dense ids from 1 in the order of file names; boxes without an area are dropped."""
    ids = numbered(images, ("file_name",), "id")
    j = boxes.join(ids.select("stem", "width", "height", F.col("id").alias("image_id")), "stem")
    j = j.withColumn("b", B.coco_box(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), F.col("width").cast("double"), F.col("height").cast("double"))).where("b.w > 0 and b.h > 0")
    ann = numbered(j, ("image_id", "line_no", "class_idx", "cx", "cy", "w", "h"), "id").select(
        "id", "image_id", (F.col("class_idx") + 1).alias("category_id"), F.array("b.x", "b.y", "b.w", "b.h").alias("bbox"),
        F.round(F.col("b.w") * F.col("b.h"), 2).alias("area"), F.lit(0).alias("iscrowd"),
    )
    cats = images.sparkSession.createDataFrame([(i + 1, n) for i, n in enumerate(names)], "id int, name string")
    return ids.select("id", "file_name", "width", "height"), ann, cats


def invalid_categories(annotations: DataFrame, categories: DataFrame) -> DataFrame:
    return annotations.join(categories.select(F.col("id").alias("category_id")), "category_id", "left_anti")


def prediction_tasks(preds: DataFrame, image: str = "file_name", model: str = "model") -> DataFrame:
    """One JSON a line: an image with its predicted rectangles in percent, for an annotation tool."""
    b = B.percent_box(F.col("box"))
    value = F.struct(b["x"].alias("x"), b["y"].alias("y"), b["width"].alias("width"), b["height"].alias("height"), F.lit(0).alias("rotation"), F.array("class_name").alias("rectanglelabels"))
    result = F.struct(F.lit("label").alias("from_name"), F.lit("image").alias("to_name"), F.lit("rectanglelabels").alias("type"), F.col("conf").alias("score"), value.alias("value"))
    per = preds.groupBy(image).agg(F.sort_array(F.collect_list(F.struct("idx", result.alias("r")))).alias("rs"), F.avg("conf").alias("score"))
    task = F.struct(F.struct(F.col(image).alias("image")).alias("data"), F.array(F.struct(F.lit(model).alias("model_version"), "score", F.transform("rs", lambda r: r["r"]).alias("result"))).alias("predictions"))
    return per.select(F.to_json(task).alias("value"))


def report(rows: DataFrame, head: dict[str, object], name: str = "items", count: str = "total") -> DataFrame:
    """One row, a JSON document: the head, the number of rows and the rows."""
    body = rows.agg(F.collect_list(F.struct(*rows.columns)).alias(name), F.count("*").alias(count))
    return body.select(F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in head.items()), count, name), {"ignoreNullFields": "false"}).alias("value"))


def reviews_export(reviews: DataFrame, summary: DataFrame, head: dict[str, object]) -> DataFrame:
    """One row, a JSON document: reviews by cluster; wrong classes and false positives only where there are any."""
    fields = [c for c in reviews.columns if c != "cluster_id"]
    one = reviews.agg(F.map_from_entries(F.collect_list(F.struct(F.col("cluster_id").cast("string"), F.struct(*fields)))).alias("reviews"), F.collect_list(F.when(F.col("decision") == "no_sign", F.col("cluster_id"))).alias("fp"))
    wrong = summary.agg(F.collect_list(F.struct(*summary.columns)).alias("w"))
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    return one.join(F.broadcast(wrong), F.lit(True)).select(F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in head.items()), "reviews", some("w").alias("wrong_class_summary"), some("fp").alias("false_positives"))).alias("value"))


#: The three kinds of report documents, read as one: lists of items or discrepancies, or a map of reviews.
_ITEM = "id string, annotated_class string, predicted_class string, confidence double, iou double, lat double, lon double, status string, resolution string, reviewer_note string"
_DISCREPANCY = "id string, type string, sign_class string, inventory_class string, confidence double, lat double, lon double, review_reason string, status string, reviewer_note string"
_REVIEW = "decision string, corrected_class string, original_class string, note string, reviewed_at string"
REPORTS = f"video_source string, items array<struct<{_ITEM}>>, discrepancies array<struct<{_DISCREPANCY}>>, reviews map<string, struct<{_REVIEW}>>"
REPORT_ROW = ("kind", "id", "label_a", "class_a", "label_b", "class_b", "confidence", "iou", "lat", "lon", "reason", "status", "resolution", "note")


def report_rows(documents: DataFrame) -> DataFrame:
    """A row an entry of report documents (value, JSON text), in one shape for all three kinds: kind, id, two labelled classes, confidence, iou, place,
    reason, status, resolution, note. Structure decides: items, else discrepancies, else reviews; a document with none of them is an error."""
    doc = documents.select(F.from_json("value", REPORTS).alias("d")).select("d.*")
    kind = F.when(F.col("items").isNotNull(), "qa").when(F.col("discrepancies").isNotNull(), "discrepancy").when(F.col("reviews").isNotNull(), "review")
    doc = doc.withColumn("kind", F.coalesce(kind, F.raise_error(F.lit("a report has items, discrepancies or reviews"))))
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    percent = F.concat(F.format_string("%.0f", F.col("x.confidence") * 100), F.lit("%"))
    qa = doc.where("kind = 'qa'").select("kind", F.explode("items").alias("x")).select(
        "kind", "x.id", F.lit("Annotated as").alias("label_a"), F.col("x.annotated_class").alias("class_a"), F.lit("Model predicted").alias("label_b"), F.col("x.predicted_class").alias("class_b"), "x.confidence", "x.iou", "x.lat", "x.lon",
        F.concat(F.lit("IoU "), F.when(F.col("x.iou").isNotNull(), F.format_string("%.2f", F.col("x.iou"))).otherwise("?"), F.lit(", conf "), F.when(F.col("x.confidence").isNotNull(), percent).otherwise("?")).alias("reason"),
        F.coalesce("x.status", F.lit("pending")).alias("status"), "x.resolution", F.col("x.reviewer_note").alias("note"),
    )
    mismatch, detected = F.col("x.type") == "class_mismatch", F.coalesce(F.col("x.type") == "detected_not_in_inventory", F.lit(False))
    disc = doc.where("kind = 'discrepancy'").select("kind", F.explode("discrepancies").alias("x")).select(
        "kind", "x.id", F.when(mismatch, "Detected as").when(detected, "Detected").otherwise("Inventory").alias("label_a"), F.col("x.sign_class").alias("class_a"),
        F.when(mismatch, "Inventory says").when(detected, "Inventory").otherwise("Detected").alias("label_b"), F.when(mismatch, F.coalesce("x.inventory_class", F.lit("?"))).otherwise("Not found").alias("class_b"),
        "x.confidence", number.alias("iou"), "x.lat", "x.lon", F.coalesce("x.review_reason", "x.type").alias("reason"), F.coalesce("x.status", F.lit("pending")).alias("status"), text.alias("resolution"), F.col("x.reviewer_note").alias("note"),
    )
    rev = doc.where("kind = 'review'").select("kind", F.explode("reviews").alias("id", "x")).select(
        "kind", "id", F.lit("Reviewed").alias("label_a"), F.col("x.original_class").alias("class_a"), F.lit("Corrected to").alias("label_b"), F.col("x.corrected_class").alias("class_b"),
        number.alias("confidence"), number.alias("iou"), number.alias("lat"), number.alias("lon"), text.alias("reason"), F.lit("resolved").alias("status"), F.col("x.decision").alias("resolution"), "x.note",
    )
    return qa.unionByName(disc).unionByName(rev).select(*REPORT_ROW)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """report_rows of the JSON files under path, one document a file."""
    return report_rows(spark.read.text(path, wholetext=True))


def embed_script(document: DataFrame, variable: str, comment: str) -> DataFrame:
    """A script that sets a variable to each document (value, JSON text), for pages that cannot fetch."""
    return document.select(F.concat(F.lit(f"// {comment}\n{variable} = "), "value", F.lit(";\n")).alias("value"))


def sniff_report(text: str) -> str:
    """Which kind of report a JSON document is, by its top-level keys."""
    import json

    keys = set(json.loads(text))
    return next((kind for kind in ("items", "discrepancies", "reviews") if kind in keys), "unknown")


def markdown(rows: DataFrame, limit: int = 200) -> str:
    """A table of at most limit rows."""
    got = rows.limit(limit).collect()
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in got])


def dataset_yaml(path: str, train: str, val: str, names: list[str]) -> str:
    return "\n".join([f"path: {path}", f"train: {train}", f"val: {val}", f"nc: {len(names)}", "names:", *(f"  {i}: {n}" for i, n in enumerate(names))]) + "\n"


def dataset_yamls(classes: DataFrame, by: str, name: str, order: str) -> DataFrame:
    """(by, value): a dataset file for each group of classes, as dataset_yaml writes it, with the group as its path."""
    names = F.transform(F.array_sort(F.collect_list(F.struct(order, name))), lambda x: x[name])
    text = F.concat(
        F.lit("path: /data/"), by, F.lit("\ntrain: images/train\nval: images/val\nnc: "), F.size("n"), F.lit("\nnames:\n"), F.array_join(F.transform("n", lambda x, i: F.concat(F.lit("  "), i, F.lit(": '"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'"))), "\n"),
    )
    return classes.groupBy(by).agg(names.alias("n")).select(by, text.alias("value"))


#: The columns of a list of signs to annotate again, in their order.
REANNOTATION = ("cluster_id", "predicted_class", "lat", "lon", "note", "video_source")


def reannotation(wrong: DataFrame, video_source: str) -> DataFrame:
    """The list of wrongly classed clusters (cluster_id, sign_class, lat, lon, note), for write_csv: cells with quotes, commas or line ends are quoted."""
    rows = wrong.withColumnRenamed("sign_class", "predicted_class").withColumn("video_source", F.lit(video_source))
    return rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in REANNOTATION))


def download_script(rows: DataFrame, url: str = "url", name: str = "filename") -> DataFrame:
    """Shell lines that fetch what is not there yet."""
    quote = lambda c: F.concat(F.lit("'"), F.replace(F.col(c), F.lit("'"), F.lit("'\\''")), F.lit("'"))
    return rows.select(F.concat(F.lit("[ -f "), quote(name), F.lit(" ] || curl -fSL -o "), quote(name), F.lit(" "), quote(url)).alias("value"))


def to_upload(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Local files (key, content) that the remote listing (key, md5) lacks or has otherwise."""
    return local.withColumn("md5", F.md5("content")).join(remote.select("key", "md5"), ["key", "md5"], "left_anti").drop("content")

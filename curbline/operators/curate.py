"""Curation of label files: pairing, remapping, de-duplication, top rows, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbline.functions.box import aspect
from curbline.functions.text import stable_order
from curbline.operators.ordered import numbered


def remap(boxes: DataFrame, mapping: DataFrame, cls: str = "class_idx") -> DataFrame:
    """boxes with new_class by mapping (raw, new); classes unknown or mapped to null are dropped."""
    kept = mapping.where("new is not null").select(F.col("raw").alias(cls), F.col("new").alias("new_class"))
    return boxes.join(kept, cls)


def pair_orphans(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one side has."""
    a = left.select(key).distinct().withColumn("in_left", F.lit(True))
    b = right.select(key).distinct().withColumn("in_right", F.lit(True))
    both = a.join(b, key, "full_outer").where("in_left is null or in_right is null")
    return both.select(key, F.when(F.col("in_right").isNull(), "left_only").otherwise("right_only").alias("side"))


def first_wins(rows: DataFrame, key: str, order: tuple[str | Column, ...]) -> DataFrame:
    """The first row of each key in the given order: a minimum over whole rows, so equal keys are merged map-side."""
    names = [f"_o{i}" for i in range(len(order))]
    keyed = rows.withColumns({n: F.col(c) if isinstance(c, str) else c for n, c in zip(names, order, strict=True)})
    best = keyed.groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.struct(*names)).alias("r"))
    return best.select("r.*")


def top_per_group(rows: DataFrame, by: tuple[str, ...], order: tuple[Column | str, ...], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def best_hits(hits: DataFrame, frame: str = "frame", bucket: str = "bucket") -> DataFrame:
    """The best hit of each frame and bucket; a model's hit wins over a heuristic's of the same score, then the earlier."""
    rank = F.struct("score", F.when(F.col("method") == "model", 1).otherwise(0).alias("m"), (-F.col("ord")).alias("o"))
    return hits.groupBy(frame, bucket).agg(F.max_by(F.struct("score", "predicted_class", "method"), rank).alias("h")).select(frame, bucket, "h.*")


def dominant_class(boxes: DataFrame, stems: DataFrame, stem: str = "stem", cls: str = "class_idx", order: str = "line_no") -> DataFrame:
    """The most frequent class of each stem, the first seen of equal ones; -1 without boxes."""
    votes = boxes.groupBy(stem, cls).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    top = votes.groupBy(stem).agg(F.min_by(cls, F.struct((-F.col("n")).alias("m"), "first", cls)).alias("dominant"))
    return stems.select(stem).distinct().join(top, stem, "left").withColumn("dominant", F.coalesce("dominant", F.lit(-1)))


def yellow_diamond_hits(frames: DataFrame) -> DataFrame:
    """(frame, bucket, score, method) from the four pixel scores yd, deer, rail, curve of each frame."""
    # Least scores and the names of the buckets and methods.
    hit = lambda when, bucket, score, method: F.when(when, F.struct(F.lit(bucket).alias("bucket"), score.alias("score"), F.lit(method).alias("method")))
    found = F.array_compact(F.array(
        hit(F.col("deer") >= 0.12, "deerCrossing", F.col("yd") * (0.5 + F.col("deer")), "deer_pictogram_heuristic"),
        hit(F.col("rail") >= 0.25, "railroadCrossing", F.col("yd") * (0.5 + F.col("rail")), "railroad_pattern_heuristic"),
        hit(F.col("curve") >= 0.22, "curve", F.col("yd") * F.col("curve"), "curve_arrow_heuristic"),
    ))
    other = F.array(F.struct(F.lit("possible_yellow_diamond").alias("bucket"), F.col("yd").alias("score"), F.lit("yellow_diamond_heuristic").alias("method")))
    rows = frames.where("yd >= 0.05").withColumn("h", F.explode(F.when(F.size(found) > 0, found).otherwise(other)))
    return rows.select("frame", "h.*")


def frame_targets(boxes: DataFrame, stem: str = "stem", cls: str = "class_idx", targets: tuple[int, ...] = (1, 3, 10, 11)) -> DataFrame:
    """A stem's targeted classes, sorted and joined by bars, and the largest box of one."""
    hit = F.col(cls).isin(*targets)
    classes = F.array_sort(F.collect_set(F.when(hit, F.col(cls))))
    return boxes.groupBy(stem).agg(F.array_join(F.transform(classes, lambda c: c.cast("string")), "|").alias("targeted_classes"), F.coalesce(F.max(F.when(hit, F.col("w") * F.col("h"))), F.lit(0.0)).alias("max_area"))


def frame_score(laplacian: Column, area: Column) -> Column:
    return F.coalesce(laplacian * F.sqrt(area), area)


def exclude(rows: DataFrame, lists: list[DataFrame], key: str) -> DataFrame:
    """Rows whose key is in none of the lists."""
    out = rows
    for ids in lists:
        out = out.join(ids.select(key), key, "left_anti")
    return out


def with_lookup(rows: DataFrame, lookup: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """rows with the lookup's columns, or defaults where there is no row."""
    joined = rows.join(lookup.select(key, *defaults), key, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def class_support(boxes: DataFrame, classes: DataFrame, cls: str = "cls", few: int = 10) -> DataFrame:
    """Boxes of every class, those without included, and whether they are too few."""
    counts = boxes.groupBy(cls).agg(F.count("*").alias("n"))
    return classes.select(cls).join(counts, cls, "left").select(cls, F.coalesce("n", F.lit(0)).alias("n")).withColumn("few", F.col("n") < few)


# 0 leaves a road type out, others are ranks of preference; unknown types come last.
ROAD_PRIORITY = {"Interstate": 0, "US Route": 1, "WV Route": 1, "Municipal Non-State": 1, "County Route": 2, "Federal Aid Non-State": 2}
UNKNOWN_PRIORITY = 3


def by_road_priority(rows: DataFrame, road: str, priorities: dict[str, int] | None = None) -> DataFrame:
    """rows with priority; those of priority 0 go."""
    mapping = F.create_map(*(F.lit(x) for kv in (priorities or ROAD_PRIORITY).items() for x in kv))
    return rows.withColumn("priority", F.coalesce(F.try_element_at(mapping, F.col(road)), F.lit(UNKNOWN_PRIORITY))).where("priority > 0")


def drop_unlocated(frames: DataFrame, name: str = "location") -> DataFrame:
    """Frames that have a position; kept and skipped are counted on the way, as observed metrics."""
    seen = frames.observe(name, F.count("lat").alias("kept"), (F.count(F.lit(1)) - F.count("lat")).alias("skipped"))
    return seen.where("lat is not null and lon is not null")


def confident(rows: DataFrame, least: float = 0.5, conf: str = "conf") -> DataFrame:
    return rows.where(F.col(conf) >= least)


def squarish(rows: DataFrame, low: float = 0.5, high: float = 2.0, w: str = "w", h: str = "h") -> DataFrame:
    """Boxes whose aspect lies strictly between low and high; without a height it is 0."""
    shape = aspect(F.col(w), F.col(h))
    return rows.where((shape > low) & (shape < high))


# Fixed value: roads left out for their many stops.
MUNICIPAL = "Municipal Non-State"


def without_road(rows: DataFrame, road: str, left_out: str = MUNICIPAL) -> DataFrame:
    """rows but those of one road type; rows without a road type stay."""
    return rows.where(~F.col(road).eqNullSafe(F.lit(left_out)))


def sharp_parts(frames: DataFrame) -> DataFrame:
    """frames with part: candidate and background are sharp ones, blurred_candidate counts only in the tally; the rest goes."""
    part = F.when(F.col("is_candidate") & F.col("is_sharp"), "candidate").when(~F.col("is_candidate") & F.col("is_sharp"), "background").when(F.col("is_candidate"), "blurred_candidate")
    return frames.withColumn("part", part).where("part is not null")


# Fixed value: frames annotated in an hour.
FRAMES_AN_HOUR = 380


def annotation_hours(frames: DataFrame) -> DataFrame:
    """One row: the number of frames and the hours to annotate them."""
    return frames.agg(F.count("*").alias("n")).withColumn("hours", F.col("n") / FRAMES_AN_HOUR)


def dedupe_summary(frames: DataFrame, keep: int, cls: str = "cls", cluster: str = "cluster", score: str = "score", key: str = "stem") -> DataFrame:
    """A row a class: frames, instances (clusters), frames kept (the keep best of each cluster), frames an instance. Counts a class and cluster first."""
    per = frames.groupBy(cls, cluster).agg(F.count("*").alias("_n"))
    return per.groupBy(cls).agg(F.sum("_n").alias("frames"), F.count("*").alias("instances"), F.sum(F.least("_n", F.lit(keep))).alias("kept")).withColumn("frames_per_instance", F.col("frames") / F.col("instances"))


def method_counts(hits: DataFrame, bucket: str = "bucket", method: str = "method") -> DataFrame:
    return hits.groupBy(bucket, method).agg(F.count("*").alias("n"))


def shared_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on both sides: empty where splits are disjoint, as they must be."""
    return left.select(key).intersect(right.select(key))


def tiered(rows: DataFrame, tiers: tuple[Column, ...], key: str, seed: int = 42) -> DataFrame:
    """rows in order: those of the first tier's condition first, among them those of the second's, ...; within that by chance."""
    return rows.orderBy(*(F.when(t, 0).otherwise(1) for t in tiers), stable_order(seed, F.col(key)), key)


def top_class(rows: DataFrame, by: str, cls: str = "cls") -> DataFrame:
    """The most frequent class of each group; of equals the first by name."""
    n = rows.groupBy(by, cls).agg(F.count("*").alias("n"))
    return n.groupBy(by).agg(F.min_by(F.struct(cls, "n"), F.struct((-F.col("n")).alias("m"), cls)).alias("t")).select(by, F.col(f"t.{cls}").alias(cls), F.col("t.n").alias("n"))


def candidate_counts(rows: DataFrame, video: str, cls: str, classes: list[str]) -> DataFrame:
    """One row a video with a column a class: the classes are given, so that there is one pass."""
    return rows.groupBy(video).pivot(cls, classes).agg(F.count(F.lit(1))).na.fill(0, classes)


def recover_ids(rows: DataFrame, found: Column, order: str) -> DataFrame:
    """rows with cluster_id: the found one, or numbers above the largest found in the order of the rows that have none."""
    top = rows.agg(F.coalesce(F.max(found), F.lit(0)).alias("_top"))
    known = rows.where(found.isNotNull()).withColumn("cluster_id", found)
    rest = numbered(rows.where(found.isNull()), (order,), "_n").join(F.broadcast(top), F.lit(True))
    return known.unionByName(rest.withColumn("cluster_id", F.col("_top") + F.col("_n")).drop("_top", "_n"))


def pending(items: DataFrame) -> DataFrame:
    """QA items still to be resolved, the least confident first; those without a confidence come last."""
    return items.where("resolution is null and coalesce(status, 'pending') = 'pending'").orderBy(F.coalesce("confidence", F.lit(1.0)), "id")

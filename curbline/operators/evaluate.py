"""Boxes against boxes: matching, average precision, recall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbline.functions.box import iou
from curbline.operators.ordered import best_after, running
from curbline.operators.overlap import overlapping
from curbline.plans.session import cut


def best_overlap(asked: DataFrame, others: DataFrame, by: str, box: str = "box", other_box: str = "other_box", keep: tuple[str, ...] = (), order: str = "other_idx", eps: float = 0.0) -> DataFrame:
    """asked with iou, order and the kept columns of the best overlapping other of the same group; equal overlaps go to the lower order.

    A row whose group has no other stays, with iou 0 and nulls.
    """
    pairs = overlapping(asked, others.select(by, order, *keep, other_box), (by,), box, other_box).withColumn("iou", iou(F.col(box), F.col(other_box), eps))
    least = others.groupBy(by).agg(F.min(F.struct(order, *keep)).alias("_r"))  # for those that overlap none
    alone = asked.join(least, by, "left").withColumn("iou", F.lit(0.0)).select(*asked.columns, "iou", F.col(f"_r.{order}").alias(order), *(F.col(f"_r.{k}").alias(k) for k in keep))
    rank = F.struct("iou", (-F.col(order)).alias("o"), *keep)
    own = [c for c in asked.columns if c != box]
    best = pairs.drop(other_box).unionByName(alone).groupBy(*own).agg(F.max(rank).alias("b"))
    return best.select(*own, F.col("b.iou").alias("iou"), (-F.col("b.o")).alias(order), *(F.col(f"b.{k}").alias(k) for k in keep))


def greedy_match(preds: DataFrame, truth: DataFrame, threshold: float = 0.5, image: str = "image", cls: str = "cls") -> DataFrame:
    """preds (image, cls, idx, conf, box) with gt_idx, the truth each is matched to, or null.

    By falling confidence, equal ones by idx, every prediction takes the best free truth of its class that it overlaps by more than the threshold.
    """
    held = match_rounds(preds, truth, threshold, image, cls)[0]
    return preds.join(held.select(F.col("p").alias("idx"), F.col("g").alias("gt_idx")), "idx", "left")


def match_rounds(preds: DataFrame, truth: DataFrame, threshold: float = 0.5, image: str = "image", cls: str = "cls") -> tuple[DataFrame, int]:
    """The matched pairs (image, cls, p, g) of greedy_match, and in how many rounds they were found.

    In a round each prediction that comes first among all that could take its best free truth takes it: nothing before it can change that. It goes with its
    truth, and the rest goes on. The first prediction of all is always such a one, and those of different places don't wait for each other.
    """
    rows = preds.select(image, cls, F.col("idx").alias("p"), "conf", F.col("box").alias("_b"))
    pairs = overlapping(rows, truth.select(image, cls, F.col("idx").alias("g"), F.col("box").alias("_o")), (image, cls), "_b", "_o").withColumn("iou", iou(F.col("_b"), F.col("_o")))
    left, found, rounds = cut(pairs.where(F.col("iou") > threshold).select(image, cls, "p", "conf", "g", "iou")), [], 0
    group = [image, cls]
    while left.take(1):
        best = left.groupBy(*group, "p").agg(F.min(F.struct((-F.col("iou")).alias("i"), "g")).alias("b")).select(*group, "p", F.col("b.g").alias("g"))
        first = left.groupBy(*group, "g").agg(F.min(F.struct((-F.col("conf")).alias("c"), "p")).alias("f")).select(*group, "g", F.col("f.p").alias("p"))
        fixed = cut(best.join(first, [*group, "p", "g"]))
        found.append(fixed)
        left, rounds = cut(left.join(fixed, [*group, "p"], "left_anti").join(fixed, [*group, "g"], "left_anti")), rounds + 1
    out = left.select(*group, "p", "g")
    for f in found:
        out = out.unionByName(f.select(*group, "p", "g"))
    return out, rounds


def average_precision(scored: DataFrame, truth_counts: DataFrame, by: tuple[str, ...] = ("cls",), conf: str = "conf", tp: str = "is_tp", order: str = "idx") -> DataFrame:
    """All-point average precision a group: the area under the precision envelope. NaN without truth, 0 without predictions.

    scored has a row a prediction, truth_counts (by, n_gt). Running sums, a reversed running maximum, one sum: over ranges of confidence, so
    that a class with most of the predictions is not one task.
    """
    kept = cut(scored.select(*by, conf, tp, order))  # a sort by ranges reads its rows twice
    s = running(kept, by, (F.desc(conf), order), {"_tp": F.col(tp).cast("long"), "_n": F.lit(1)}, placed=True)
    s = best_after(s.withColumn("_precision", F.col("_tp") / F.col("_n")).select(*by, tp, "_precision", "_n", "_p", "_i"), by, ("_n",), "_precision", "_e")
    area = s.groupBy(*by).agg(F.sum(F.when(F.col(tp), F.col("_e")).otherwise(0.0)).alias("_a"))
    out = truth_counts.join(area, list(by), "left")
    return out.withColumn("ap50", F.when(F.col("n_gt") == 0, F.lit(float("nan"))).otherwise(F.coalesce(F.col("_a"), F.lit(0.0)) / F.col("n_gt"))).drop("_a")


def recall_matrix(matched_truth: DataFrame, cls: str = "cls", bucket: str = "bucket", buckets: tuple[str, ...] = ("tiny", "small", "medium", "large")) -> DataFrame:
    """Recall by class and size bucket, with n_gt and medium and large pooled; null where there is no truth. matched_truth has matched (boolean)."""
    share = lambda where, name: (F.count_if(where & F.col("matched")) / F.nullif(F.count_if(where), F.lit(0))).alias(name)
    cols = [share(F.col(bucket) == b, f"recall_{b}") for b in buckets]
    return matched_truth.groupBy(cls).agg(F.count("*").alias("n_gt"), *cols, share(F.col(bucket).isin("medium", "large"), "recall_medium_large"))


def weighted_recall(recalls: DataFrame, recall: str = "recall", support: str = "n") -> DataFrame:
    return recalls.agg(F.coalesce(F.sum(F.col(recall) * F.col(support)) / F.nullif(F.sum(support), F.lit(0)), F.lit(0.0)).alias("weighted_recall"))


def recall_gate(recalls: DataFrame, threshold: float = 0.65) -> DataFrame:
    """exit_code 1 if a class is below the threshold, else 2 if the weighted recall is, else 0."""
    w = weighted_recall(recalls)
    low = recalls.agg(F.count_if(F.col("recall") < threshold).alias("n_below"))
    return low.join(F.broadcast(w), F.lit(True)).withColumn("exit_code", F.when(F.col("n_below") > 0, 1).when(F.col("weighted_recall") < threshold, 2).otherwise(0))


def coarse_mean(fine: DataFrame, mapping: DataFrame, value: str = "ap50") -> DataFrame:
    """Mean of the evaluated fine classes of each coarse class."""
    return fine.join(mapping, "cls").where(F.col("coarse").isNotNull() & ~F.isnan(value)).groupBy("coarse").agg(F.avg(value).alias(f"mean_{value}"), F.count("*").alias("n_classes"))


def confidence_report(preds: DataFrame, images: DataFrame, image: str = "image", cls: str = "cls") -> DataFrame:
    """Detections and mean confidence a class; the row of null class counts images without any and their percentage."""
    per = preds.groupBy(cls).agg(F.count("*").alias("n"), F.avg("conf").alias("mean_conf"))
    empty = images.join(preds.select(image).distinct(), image, "left_anti").agg(F.count("*").alias("n"))
    share = empty.join(F.broadcast(images.agg(F.count("*").alias("all"))), F.lit(True)).select(F.lit(None).cast(preds.schema[cls].dataType).alias(cls), "n", (F.col("n") * 100.0 / F.col("all")).alias("mean_conf"))
    return per.unionByName(share)

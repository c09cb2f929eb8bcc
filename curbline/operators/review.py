"""Review decisions: folding events, applying them, queues and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbline.functions.classify import collapse
from curbline.operators.ordered import numbered


def fold(events: DataFrame, key: str = "cluster_id", seq: str = "seq") -> DataFrame:
    """The state of each key after its events (action decide, correct, note or clear; value; original): decision, corrected_class,
    original_class, note, reviewed_at.

    A clear forgets everything before it, any decision but wrong_class the corrected class, a note counts as a review only of what was
    not reviewed. All of it is the last event of some kind, so each key is one aggregate, map-side merged.
    """
    last = events.groupBy(key).agg(F.max(F.when(F.col("action") == "clear", F.col(seq))).alias("_c"))
    live = events.join(last, key).where(F.col("_c").isNull() | (F.col(seq) > F.col("_c"))).where("action <> 'clear'")
    decided = F.col("action").isin("decide", "correct")
    when = lambda cond, v: F.max_by(v, F.when(cond, F.col(seq)))
    decision = F.when(F.col("action") == "correct", "wrong_class").otherwise(F.col("value"))
    state = live.groupBy(key).agg(
        when(decided, decision).alias("decision"),
        F.max(F.when(F.col("action") == "correct", F.col(seq))).alias("_fix"),
        F.max(F.when((F.col("action") == "decide") & (F.col("value") != "wrong_class"), F.col(seq))).alias("_unfix"),
        when(F.col("action") == "correct", F.col("value")).alias("_cls"),
        when(F.col("action") == "correct", collapse(F.col("original"))).alias("_orig"),
        when(F.col("action") == "note", F.nullif(F.col("value"), F.lit(""))).alias("note"),
        F.max(F.when(decided, F.col(seq))).alias("_decided"),
        F.min(F.when(F.col("action") == "note", F.col(seq))).alias("_noted"),
    )
    fixed = F.col("_fix").isNotNull() & (F.col("_unfix").isNull() | (F.col("_fix") > F.col("_unfix")))
    return state.select(key, "decision", F.when(fixed, F.col("_cls")).alias("corrected_class"), F.when(fixed, F.col("_orig")).alias("original_class"), "note", F.coalesce("_decided", "_noted").alias("reviewed_at"))


def apply_reviews(clusters: DataFrame, reviews: DataFrame, key: str = "cluster_id") -> DataFrame:
    """clusters after review: no_sign goes, approved is cleared, wrong_class with a correction takes it and keeps the old class."""
    r = reviews.select(key, "decision", "corrected_class")
    j = clusters.join(r, key, "left").where("decision is null or decision <> 'no_sign'")
    fix = (F.col("decision") == "wrong_class") & F.col("corrected_class").isNotNull()
    done = F.coalesce(F.col("decision").isin("approved", "correct"), F.lit(False))
    return j.select(
        *[c for c in clusters.columns if c not in ("sign_class", "needs_review", "review_reason")],
        F.when(fix, F.col("corrected_class")).otherwise(F.col("sign_class")).alias("sign_class"),
        F.when(fix, F.col("sign_class")).alias("original_class"),
        F.coalesce(fix, F.lit(False)).alias("corrected"),
        F.when(done, False).otherwise(F.col("needs_review")).alias("needs_review"),
        F.when(done, F.lit(None)).otherwise(F.col("review_reason")).alias("review_reason"),
    )


def tally(reviews: DataFrame, total: int | None = None) -> DataFrame:
    count = lambda *names: F.count_if(F.col("decision").isin(*names))
    out = reviews.agg(count("approved", "correct").alias("approved"), count("wrong_class").alias("wrong_class"), count("no_sign").alias("no_sign"), F.count("decision").alias("reviewed"), F.count("*").alias("_n"))
    return out.withColumn("pct", F.round(F.col("reviewed") * 100.0 / F.nullif(F.lit(total) if total is not None else F.col("_n"), F.lit(0)), 2)).drop("_n")


def queue(clusters: DataFrame) -> DataFrame:
    """What is to be reviewed: discrepancies first, then the least confident."""
    first = F.when(F.col("discrepancy_type").isNotNull(), 0).otherwise(1)
    return clusters.where("needs_review").orderBy(first, F.coalesce("confidence", F.lit(1.0)), "cluster_id")


def next_nearest(clusters: DataFrame, lat: float, lon: float) -> DataFrame:
    """The unreviewed cluster nearest in squared degrees."""
    d2 = F.pow(F.col("lat_median") - lat, F.lit(2.0)) + F.pow(F.col("lon_median") - lon, F.lit(2.0))
    return clusters.where("needs_review").withColumn("d2", d2).orderBy("d2", "cluster_id").limit(1)


def mark_reviewed(clusters: DataFrame, cluster_id: int) -> DataFrame:
    hit = F.col("cluster_id") == cluster_id
    return clusters.withColumns({"needs_review": F.when(hit, False).otherwise(F.col("needs_review")), "review_reason": F.when(hit, F.lit(None)).otherwise(F.col("review_reason"))})


def discrepancies(clusters: DataFrame) -> DataFrame:
    """Numbered discrepancy rows, disc_001 and on, in the order of clusters."""
    found = numbered(clusters.where("discrepancy_type is not null"), ("cluster_id",), "_n")
    return found.select(F.format_string("disc_%03d", F.col("_n")).alias("id"), F.col("discrepancy_type").alias("type"), "cluster_id", "sign_class", "confidence", "sighting_count", "review_reason", F.lit("pending").alias("status"))


def wrong_class_summary(reviews: DataFrame) -> DataFrame:
    return reviews.where("decision = 'wrong_class' and corrected_class is not null").groupBy("original_class", "corrected_class").agg(F.count("*").alias("n"))


def marker(clusters: DataFrame) -> DataFrame:
    """Display colour and radius."""
    # Colours by state.
    colour = F.when(F.col("discrepancy_type") == "in_inventory_not_detected", "gray").when(F.col("discrepancy_type").isNotNull(), "red").when(F.col("needs_review"), "orange").otherwise("green")
    return clusters.withColumn("color", colour).withColumn("radius", F.least(F.lit(14.0), 5 + F.sqrt(F.col("sighting_count").cast("double"))))

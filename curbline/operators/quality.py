"""Data-quality checks as one pass of conditional counts, as rows (check, severity, n)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbline.operators.curate import pair_orphans


def label_checks(lines: DataFrame, stems: DataFrame, images: DataFrame, n_classes: int, strict: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """lines (stem, n_fields, class_text, cx, cy, w, h) of label files, stems (stem) of all label files, images (stem)."""
    cls = F.col("class_text").try_cast("int")
    five = F.col("n_fields") == 5
    outside = F.lit(False)
    for c in ("cx", "cy", "w", "h"):
        outside |= ~F.col(c).between(0, 1) | F.col(c).isNull()
    checks = {
        "wrong_field_count": ("error", F.count_if(~five)),
        "class_not_integer": ("error", F.count_if(five & cls.isNull())),
        "class_out_of_range": ("error", F.count_if(five & ~cls.between(0, n_classes - 1))),
        "coordinate_out_of_range": ("error", F.count_if(five & outside)),
    }
    wide = lines.groupBy(*by).agg(*(v.alias(k) for k, (_, v) in checks.items()))
    pairs = ", ".join(f"'{k}', '{s}', {k}" for k, (s, _) in checks.items())
    out = wide.selectExpr(*by, f"stack({len(checks)}, {pairs}) as (check, severity, n)")
    if by:
        return out
    empty = stems.join(lines.select("stem").distinct(), "stem", "left_anti").select(F.lit("empty_label").alias("check"), F.lit("warning").alias("severity"))
    alone = pair_orphans(stems, images, "stem")
    alone = alone.select(F.when(F.col("side") == "left_only", "label_without_image").otherwise("image_without_label").alias("check"), F.lit("error" if strict else "warning").alias("severity"))
    rest = empty.unionByName(alone).groupBy("check", "severity").agg(F.count("*").alias("n"))
    return out.unionByName(rest)


def preflight(splits: DataFrame, lines: DataFrame, stems: DataFrame, images: DataFrame, strict: bool = False) -> DataFrame:
    """One row a configuration and split: counts, the largest class index out of range, and PASS or FAIL.

    splits (config, split, nc) are those configured; lines (config, split, stem, n_fields, class_text, cx, cy, w, h) of label files, stems and images
    (config, split, stem, broken) of the files listed, broken ones being links that lead nowhere. A configured split without images or labels fails, as do bad
    lines and broken links; files without their pair are warnings, which fail only if strict.
    """
    key = ["config", "split", "stem"]
    none = {"label": F.lit(0), "image": F.lit(0), "broken_label": F.lit(False), "broken_image": F.lit(False), "line": F.lit(False)}
    fields = [f for f in lines.schema.fields if f.name in LINE]
    blank = {f.name: F.lit(None).cast(f.dataType) for f in fields}
    files = lambda x, name: x.select(*key, *((F.lit(1) if k == name else F.col("broken") if k == f"broken_{name}" else v).alias(k) for k, v in (none | blank).items()))
    listed = lines.select(*key, *((F.lit(True) if k == "line" else v).alias(k) for k, v in none.items()), *(f.name for f in fields))
    return preflight_listed(splits, listed.unionByName(files(stems, "label")).unionByName(files(images, "image")), strict)


#: What a label file's line has.
LINE = ("n_fields", "class_text", "cx", "cy", "w", "h")


def preflight_listed(splits: DataFrame, listed: DataFrame, strict: bool = False, once: bool = False) -> DataFrame:
    """preflight of one listing, in one pass: rows (config, split, stem, label, image, broken_label, broken_image, line and the fields of a line) say of a stem that so
    many label files and images of it are listed and that there is a line; with once a stem's files are listed by any number of its rows and count once.

    Stems are grouped once; configured splits, a row each, are broadcast.
    """
    by = ["config", "split"]
    cls, five, outside = F.col("class_text").try_cast("int"), F.col("line") & (F.col("n_fields") == 5), F.lit(False)
    for c in ("cx", "cy", "w", "h"):
        outside |= F.coalesce(~F.col(c).between(0, 1), F.lit(True))
    bad = cls.isNull() | ~cls.between(0, F.col("nc") - 1)
    fold = F.max if once else F.sum
    broken = lambda n: fold(F.when(F.col(f"broken_{n}") & (F.col(n) > 0), 1).otherwise(0))
    stems = listed.join(F.broadcast(splits.select(*by, "nc").distinct()), by).groupBy(*by, "stem").agg(
        fold("label").alias("label"), fold("image").alias("image"), broken("label").alias("broken_label"), broken("image").alias("broken_image"), F.count_if("line").alias("n_lines"),
        F.count_if(five).alias("boxes"), F.count_if(F.col("line") & (F.col("n_fields") != 5)).alias("bad_fields"), F.count_if(five & bad).alias("bad_class"),
        F.coalesce(F.max(F.when(five & bad, cls)), F.lit(-1)).alias("worst_class"), F.count_if(five & cls.isNotNull() & outside).alias("bad_coordinates"),
    )
    # a file without a stem has no partner and no lines
    alone = lambda a, b: F.count_if((F.col(a) > 0) & ((F.col(b) == 0) | F.col("stem").isNull()))
    empty = F.sum(F.when((F.col("n_lines") == 0) | F.col("stem").isNull(), F.col("label")).otherwise(0))
    totals = {"n_images": F.sum("image"), "broken_images": F.sum("broken_image"), "n_labels": F.sum("label"), "broken_labels": F.sum("broken_label")}
    totals |= {c: F.sum(c) for c in ("boxes", "bad_fields", "bad_class")} | {"worst_class": F.max("worst_class"), "bad_coordinates": F.sum("bad_coordinates")}
    totals |= {"empty_labels": empty, "labels_alone": alone("label", "image"), "images_alone": alone("image", "label")}
    out = splits.join(stems.groupBy(*by).agg(*(v.alias(k) for k, v in totals.items())), by, "left")
    out = out.withColumn("worst_class", F.coalesce("worst_class", F.lit(-1))).na.fill(0)
    errors = (F.col("n_images") == 0) | (F.col("n_labels") == 0) | (F.col("broken_images") + F.col("broken_labels") + F.col("bad_fields") + F.col("bad_class") + F.col("bad_coordinates") > 0)
    warned = F.col("labels_alone") + F.col("images_alone") > 0
    return out.withColumn("status", F.when(errors | (warned & F.lit(strict)), "FAIL").otherwise("PASS"))


def preflight_verdicts(report: DataFrame) -> DataFrame:
    """(config, status): a configuration passes if all its splits do."""
    return report.groupBy("config").agg(F.when(F.count_if(F.col("status") == "FAIL") > 0, "FAIL").otherwise("PASS").alias("status"))


def examples(lines: DataFrame, bad, k: int = 5) -> DataFrame:
    """The first k bad lines: a top-k, not a collected list."""
    return lines.where(bad).orderBy("stem", "line_no").limit(k)


def verdict(report: DataFrame) -> DataFrame:
    return report.agg(F.coalesce(F.sum(F.when(F.col("severity") == "error", F.col("n"))), F.lit(0)).alias("errors"), F.coalesce(F.sum(F.when(F.col("severity") == "warning", F.col("n"))), F.lit(0)).alias("warnings")).withColumn("status", F.when(F.col("errors") > 0, "FAIL").otherwise("PASS"))


def expected_counts(found: DataFrame, expected: DataFrame, key: str = "dataset") -> DataFrame:
    return expected.join(found, key, "left").select(key, "expected", F.coalesce("n", F.lit(0)).alias("n")).withColumn("ok", F.col("n") == F.col("expected"))


def storage(files: DataFrame, by: str, flag_gb: float = 40.0, usd_gb_month: float = 0.023) -> DataFrame:
    """Bytes, files, GB and monthly cost of each folder, with a flag beyond flag_gb."""
    s = files.groupBy(by).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("files"))
    s = s.withColumn("gb", F.round(F.col("bytes") / 1e9, 3))
    return s.withColumn("usd_month", F.round(F.col("bytes") / 1e9 * usd_gb_month, 4)).withColumn("over", F.col("bytes") / 1e9 > flag_gb)


def recommended_n(mean_bytes: float, budget_bytes: float, available: int) -> int:
    """Rows that fit the budget, rounded down to a multiple of four."""
    return min(available, int(budget_bytes // max(mean_bytes, 1.0))) // 4 * 4


def recommended_sizes(files: DataFrame, by: str, size: str, budget: float, fixed: float = 0.0) -> DataFrame:
    """(by, files, mean_bytes, over, recommended): whether a folder's files and the fixed bytes beside them exceed the budget, and how many files of their
    mean size fit, rounded down to a multiple of four."""
    s = files.groupBy(by).agg(F.count("*").alias("files"), F.avg(size).alias("mean_bytes"), F.sum(size).alias("_all"))
    fit = F.floor((budget - fixed) / F.greatest(F.col("mean_bytes"), F.lit(1.0)) / 4) * 4
    return s.select(by, "files", "mean_bytes", (F.col("_all") + fixed > budget).alias("over"), F.greatest(F.lit(0), F.when(F.col("_all") + fixed > budget, fit).otherwise(F.col("files"))).cast("long").alias("recommended"))

"""Samples, splits and allocations. Chance is the MD5 of seed and key: the same on any partitioning and in any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbline.functions.text import stable_order
from curbline.operators.ordered import LONG, by_length, numbered, running
from curbline.plans.session import cut


def first_by_chance(rows: DataFrame, key: str, by: tuple[str, ...], most: Column | int, seed: int = 42, ahead: Column | None = None, long: int = LONG) -> DataFrame:
    """The first most rows of each group, in the order of chance, or of ahead (a digit) and then chance. most is the same for all rows of a group.

    Groups are ranked by a window where none can have more than long rows. Else the rows are counted by ranges of their hash, the ranges before the last one
    needed are taken whole, and that one is counted again by finer ranges: no task sorts a group, and only a sixteen-millionth of it is ranked at last.
    """
    h = stable_order(seed, F.col(key)) if ahead is None else F.concat(ahead.cast("string"), stable_order(seed, F.col(key)))
    left = rows.withColumn("_h", h).withColumn("_need", F.lit(most).cast("long") if isinstance(most, int) else most.cast("long"))
    if by_length(rows, by, long)[1] is None:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("_h", key))
        return left.withColumn("_r", rank).where(F.col("_r") <= F.col("_need")).drop("_h", "_r", "_need")
    taken = None
    for level in range(2):
        filed = left.withColumn("_b", F.substring("_h", 3 * level + 1, 3))
        sizes = filed.groupBy(*by, "_b").agg(F.count("*").alias("_n"), F.first("_need").alias("_of"))
        before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # at most 4096 ranges
        sizes = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).where(F.col("_off") < F.col("_of")).select(*(F.col(b).alias(f"_g_{b}") for b in by), F.col("_b").alias("_gb"), "_n", "_of", "_off")
        same = F.col("_b") == F.col("_gb")
        for b in by:
            same &= F.col(b).eqNullSafe(F.col(f"_g_{b}"))
        met = filed.join(sizes, same)
        whole = F.col("_off") + F.col("_n") <= F.col("_of")
        part = met.where(whole).select(*rows.columns)
        taken = part if taken is None else taken.unionByName(part)
        left = met.where(~whole).withColumn("_need", F.col("_of") - F.col("_off")).select(*rows.columns, "_h", "_need", F.col("_b").alias("_range"))
    rank = F.row_number().over(Window.partitionBy(*by, "_range").orderBy("_h", key))
    return taken.unionByName(left.withColumn("_r", rank).where(F.col("_r") <= F.col("_need")).select(*rows.columns))


def random_split(rows: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """split train for the first floor(share * n) rows in chance order, else val. The cut is found by ranking within hash ranges, whose sizes
    are summed first, so that no task sorts everything."""
    h = rows.withColumn("_h", stable_order(seed, F.col(key))).withColumn("_b", F.substring("_h", 1, 3))
    sizes = h.groupBy("_b").agg(F.count("*").alias("_n"))  # at most 4096 rows
    ahead = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy()))
    ranked = h.join(F.broadcast(ahead), "_b").withColumn("_r", F.col("_off") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)))
    return ranked.withColumn("split", F.when(F.col("_r") <= F.floor(F.col("_all") * share), "train").otherwise("val")).drop("_h", "_b", "_n", "_off", "_all", "_r")


def stratified_split(rows: DataFrame, key: str, stratum: str, share: float = 0.8, seed: int = 42, empty: int = -1) -> DataFrame:
    """Each stratum's first max(1, floor(share * n)) rows are train; the stratum of empties may have none."""
    cut = F.floor(F.col("_all") * share)
    cut = F.when(F.col(stratum).cast("string") == str(empty), cut).otherwise(F.greatest(F.lit(1), cut))
    sizes = rows.groupBy(F.col(stratum).alias("_of")).agg(F.count("*").alias("_all"))
    ranked = running(rows.withColumn("_h", stable_order(seed, F.col(key))), (stratum,), ("_h", key), {"_r": F.lit(1)})
    met = ranked.join(sizes, F.col(stratum).eqNullSafe(F.col("_of")))
    return met.withColumn("split", F.when(F.col("_r") <= cut, "train").otherwise("val")).drop("_h", "_r", "_of", "_all")


def cluster_split(rows: DataFrame, cluster: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Whole clusters go to val: max(1, round(share * clusters)) of them by chance."""
    clusters = rows.select(cluster).distinct()
    n_val = clusters.agg(F.greatest(F.lit(1), F.bround(F.count("*") * share)).alias("_v"))
    ranked = numbered(clusters.withColumn("_h", stable_order(seed, F.col(cluster))), ("_h", cluster), "_r")
    chosen = ranked.join(F.broadcast(n_val), F.lit(True))
    chosen = chosen.select(cluster, F.when(F.col("_r") <= F.col("_v"), "val").otherwise("train").alias("split"))
    return rows.join(chosen, cluster)


def equal_stratified_sample(rows: DataFrame, key: str, cls: str, n: int, classes: int = 4, seed: int = 42, long: int = LONG) -> DataFrame:
    """n distinct keys: n // classes by chance of each class, filled up by chance from the rest."""
    per = first_by_chance(rows.select(key, cls).distinct(), key, (cls,), n // classes, seed, long=long).select(key).distinct()
    every = rows.select(key).distinct().join(per.withColumn("_first", F.lit(0)), key, "left").withColumn("_first", F.coalesce("_first", F.lit(1)))
    return every.orderBy("_first", stable_order(seed, F.col(key)), key).limit(n).select(key)


def quota_sample(rows: DataFrame, key: str, label: str, county: str, preferred: Column, quota: dict[str, int], seed: int = 42, long: int = LONG) -> DataFrame:
    """For each label its quota of rows: representatives of distinct counties first (preferred ones, then the lowest key), by chance, then others by chance."""
    want = F.element_at(F.create_map(*(F.lit(x) for kv in quota.items() for x in kv)), F.col(label))
    r = rows.where(F.col(label).isin(*quota))
    first = r.groupBy(F.col(label).alias("_l"), F.col(county).alias("_c")).agg(F.min(F.struct(F.when(preferred, 0).otherwise(1).alias("p"), F.col(key).alias("k"))).alias("_m"))
    r = r.join(first, F.col(label).eqNullSafe(F.col("_l")) & F.col(county).eqNullSafe(F.col("_c")), "left")
    r = r.withColumn("_rep", F.when(F.col(key) == F.col("_m.k"), 0).otherwise(1)).drop("_l", "_c", "_m")
    got = first_by_chance(r, key, (label,), want, seed, F.col("_rep"), long)
    order = Window.partitionBy(label).orderBy("_rep", stable_order(seed, F.col(key)), key)  # of a quota
    return got.withColumn("pick", F.row_number().over(order)).drop("_rep")


def class_budgets(shares: dict[str, float], n: int) -> dict[str, int]:
    """max(1, round(n * share)) each; what is over or under goes to the largest, the first of equals."""
    out = {c: max(1, round(n * s)) for c, s in shares.items()}
    out[max(out, key=lambda c: out[c])] += n - sum(out.values())
    return out


def budgets_by_share(classes: DataFrame, cls: str, share: Column, n: int) -> DataFrame:
    """class_budgets for a table: (cls, budget) of its rows, a row a class."""
    every = Window.partitionBy()
    b = classes.select(cls, F.greatest(F.lit(1), F.bround(n * share)).cast("long").alias("budget")).withColumn("_over", n - F.sum("budget").over(every))
    first = F.row_number().over(Window.orderBy(F.desc("budget"), cls)) == 1
    return b.withColumn("budget", F.col("budget") + F.when(first, F.col("_over")).otherwise(0)).select(cls, "budget")


def proportional_budget(pool: DataFrame, group: str, weight: Column, existing: DataFrame, n: int) -> DataFrame:
    """(group, available, weight, budget): shares of n by mean weight over one plus what exists, at least 1 and at most what is there; the rest tops up
    by falling weight. One row a group after the first aggregate."""
    g = pool.groupBy(group).agg(F.count("*").alias("available"), F.avg(weight).alias("_w"))
    g = g.join(existing.select(group, F.col("n").alias("_e")), group, "left").withColumn("weight", F.col("_w") / (1 + F.coalesce("_e", F.lit(0))))
    g = g.withColumn("_share", F.bround(n * F.col("weight") / F.sum("weight").over(Window.partitionBy())))
    g = g.withColumn("_b", F.least(F.greatest(F.lit(1), F.col("_share")), F.col("available")).cast("long"))
    order = Window.orderBy(F.desc("weight"), group).rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("available") - F.col("_b")
    left = n - F.sum("_b").over(Window.partitionBy()) - F.coalesce(F.sum(room).over(order), F.lit(0))
    return g.withColumn("budget", F.col("_b") + F.greatest(F.lit(0), F.least(room, left))).select(group, "available", "weight", "budget")


def sample_by_budget(pool: DataFrame, budgets: DataFrame, group: str, key: str, seed: int = 42, long: int = LONG) -> DataFrame:
    """Each group's budget of rows, by chance."""
    met = pool.join(budgets.select(group, "budget"), group)
    return first_by_chance(met, key, (group,), F.col("budget"), seed, long=long).drop("budget")


def road_type_budget(videos: DataFrame, total: int, main: str = "County Route", share: float = 0.4, least: int = 15) -> DataFrame:
    """(road_type, budget): share of total for the main type, the rest by number of videos with a floor of least frames a video."""
    fixed = int(total * share)
    others = videos.where(F.col("road_type") != main).groupBy("road_type").agg(F.count("*").alias("n"))
    others = others.withColumn("budget", F.greatest(least * F.col("n"), F.bround((total - fixed) * F.col("n") / F.sum("n").over(Window.partitionBy()))).cast("long"))
    return others.select("road_type", "budget").unionByName(videos.sparkSession.createDataFrame([(main, fixed)], "road_type string, budget long"))


def frames_by_road_type(frames: DataFrame, budgets: DataFrame, key: str = "filename", seed: int = 42, least: int = 15) -> DataFrame:
    """Of every road type's budget each video gets its base, by chance; what is left goes to the videos with most frames."""
    per = frames.groupBy("road_type", "video_id").agg(F.count("*").alias("n"))
    t = Window.partitionBy("road_type")
    per = per.join(budgets, "road_type").withColumn("_base", F.greatest(F.lit(least), F.floor(F.col("budget") / F.count("*").over(t))))
    per = per.withColumn("_take", F.least("_base", "n")).withColumn("_room", F.col("n") - F.col("_take"))
    before = F.coalesce(F.sum("_room").over(t.orderBy(F.desc("n"), "video_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.col("budget") - F.sum("_take").over(t) - before
    per = per.select("road_type", "video_id", (F.col("_take") + F.greatest(F.lit(0), F.least("_room", left))).alias("_want"))
    return first_by_chance(frames.join(per, ["road_type", "video_id"]), key, ("road_type", "video_id"), F.col("_want"), seed).drop("_want")


def even_background(frames: DataFrame, n: int, video: str = "video_id", key: str = "filename", seed: int = 42, long: int = LONG) -> DataFrame:
    """n frames spread evenly: max(1, n // videos) of each video by chance, then others by chance."""
    per = frames.agg(F.greatest(F.lit(1), F.floor(F.lit(n) / F.greatest(F.countDistinct(video), F.lit(1)))).alias("_per"))
    early = first_by_chance(frames.join(F.broadcast(per), F.lit(True)), key, (video,), F.col("_per"), seed, long=long).select(F.col(key).alias("_key")).distinct()
    late = frames.join(early, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn("_late", F.when(F.col("_key").isNull() & F.col(key).isNotNull(), 1).otherwise(0))
    return late.orderBy("_late", stable_order(seed, F.col(key)), key).limit(n).drop("_key", "_late")


# Fixed value: the share of candidates among new frames.
CANDIDATE_SHARE = 0.85


def mixed_sample(candidates: DataFrame, background: DataFrame, existing: DataFrame, n: int, group: str, key: str, weight: Column, share: float = CANDIDATE_SHARE, seed: int = 42) -> DataFrame:
    """n frames of two pools, round(share * n) candidates and the rest background, each spread over groups by proportional_budget."""
    n_candidates = round(n * share)
    parts = []
    for name, pool, most in (("candidate", candidates, n_candidates), ("background", background, n - n_candidates)):
        budgets = proportional_budget(pool, group, weight, existing, most)
        parts.append(sample_by_budget(pool, budgets, group, key, seed).withColumn("part", F.lit(name)))
    return parts[0].unionByName(parts[1])


def negatives(cells: DataFrame, positives: DataFrame, image: str, key: str, ratio: int = 3, seed: int = 42) -> DataFrame:
    """Of each image ratio times as many cells as it has positives, by chance."""
    n = positives.groupBy(image).agg((F.count("*") * ratio).alias("_n"))
    return first_by_chance(cells.join(n, image), key, (image,), F.col("_n"), seed).drop("_n")


def random_n(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by chance; a top-n, which no task sorts whole."""
    return rows.orderBy(stable_order(seed, F.col(key)), key).limit(n)


def weighted_choice(rows: DataFrame, key: str, weights: dict[str, float], seed: int = 42) -> DataFrame:
    """rows with choice drawn by the weights: the first 32 bits of the hash against running sums."""
    u = F.conv(F.substring(stable_order(seed, F.col(key)), 1, 8), 16, 10).cast("double") / float(1 << 32) * sum(weights.values())
    found, top = None, 0.0
    for name, w in weights.items():
        top += w
        found = F.when(u < top, name) if found is None else found.when(u < top, name)
    return rows.withColumn("choice", found.otherwise(list(weights)[-1]))


def county_capped(rows: DataFrame, score: Column, key: str, county: str, budget: int, cap: int, used: DataFrame | None = None) -> DataFrame:
    """The best rows with at most cap a county, less what the counties used before: a row is passed over only because its county is
    full, so the rank within the county decides, and the budget cuts what is left."""
    rank = F.row_number().over(Window.partitionBy(county).orderBy(F.desc("_s"), key))
    r = rows.withColumn("_s", score).withColumn("_r", rank)
    if used is not None:
        r = r.join(used.select(county, F.col("n").alias("_u")), county, "left")
    else:
        r = r.withColumn("_u", F.lit(0))
    return r.where(F.col("_r") <= cap - F.coalesce("_u", F.lit(0))).orderBy(F.desc("_s"), key).limit(budget).drop("_r", "_u").withColumnRenamed("_s", "score")


def select_for_classes(rows: DataFrame, scores: dict[str, Column], budgets: dict[str, int], key: str, county: str, cap: int) -> DataFrame:
    """county_capped for each class in order, counties and rows used by earlier classes counting: rows with score and target_class.

    Earlier classes and this one take at most cap rows of a county between them, so a class can only take rows that are among the county's first cap by its own
    score. Each class looks at those alone; what has been picked, at most the budgets, is kept in the shared folder from class to class.
    """
    picked, columns = None, [*rows.columns, "score", "target_class"]
    for cls, score in scores.items():
        best = F.row_number().over(Window.partitionBy(county).orderBy(F.desc("_b"), key))  # Spark drops later rows before it sorts
        left = rows.withColumn("_b", score.cast("double")).withColumn("_k", best).where(F.col("_k") <= cap).drop("_b", "_k")
        used = None
        if picked is not None:
            left, used = left.join(picked.select(key), key, "left_anti"), picked.groupBy(county).agg(F.count("*").alias("n"))
        chosen = county_capped(left, score.cast("double"), key, county, budgets[cls], cap, used).withColumn("target_class", F.lit(cls)).select(*columns)
        picked = cut(chosen if picked is None else picked.unionByName(chosen))
    return picked

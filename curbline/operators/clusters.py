"""Clusters of detections: density components, merging of close ones, and what is said of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbline.functions.geo import plane_x, plane_y
from curbline.operators.components import components_by_parts, connected_components
from curbline.operators.spatial import within
from curbline.operators.squares import cell_pairs, near_components
from curbline.plans.session import cut

EPS_M, MERGE_M = 15.0, 20.0
TOP_CONFIDENCES, TOP_PLACES = 3, 5
LOW_CONFIDENCE, SPLIT_VOTE = 0.5, 0.70
#: Graphs of at most so many edges are finished by one task instead of in rounds.
SMALL_GRAPH = 100_000
#: What is known of at most so many components is broadcast to their members.
FEW_MERGED = 100_000


def near_pairs(points: DataFrame, eps_m: float = EPS_M, by: str = "video_id", idx: str = "det_idx", mean_lat: str | None = None) -> DataFrame:
    """(a, b), a < b: points of one video at most eps_m apart in the plane through the video's mean latitude (a column, or that of the points)."""
    mean = F.col(mean_lat) if mean_lat else F.avg("lat").over(Window.partitionBy(by))
    return cell_pairs(_flat(points, mean, by, idx), eps_m, by)


def _flat(points: DataFrame, mean: Column, by: str, idx: str, *keep: str) -> DataFrame:
    placed = points.where("lat is not null and lon is not null")
    return placed.select(by, F.col(idx).alias("idx"), plane_x(F.col("lon"), mean).alias("x"), plane_y(F.col("lat")).alias("y"), *keep)


def dbscan(dets: DataFrame, eps_m: float = EPS_M, by: str = "video_id", idx: str = "det_idx", small: int | None = None) -> DataFrame:
    """dets with component, the smallest detection reachable in steps of at most eps_m: with one sample enough to be a core point, density
    clusters are the components of that graph, and nothing is noise. Detections without a place are left out.

    Detections at the very same place are one point, so that a standing vehicle makes no pairs. Components are found inside squares (near_components); what
    reaches beyond a square goes on in rounds, or to one task if that is at most small edges, SMALL_GRAPH unless said otherwise. With small=0 all goes in rounds.
    """
    placed = dets.where("lat is not null and lon is not null")
    means = placed.groupBy(by).agg(F.avg("lat").alias("_mean"))
    spots = placed.groupBy(by, "lat", "lon").agg(F.min(idx).alias("_spot"))
    spots = cut(_flat(spots.join(means, by), F.col("_mean"), by, "_spot", "lat", "lon"))  # where squares are full, or all goes in rounds, read again
    if small == 0:
        found = connected_components(cell_pairs(spots, eps_m, by))
        spots = spots.join(found, F.col("idx") == F.col("node"), "left").select(by, "lat", "lon", F.coalesce("component", F.col("idx").cast("long")).alias("component"))
    else:
        spots = near_components(spots, eps_m, by, ("lat", "lon"), small or SMALL_GRAPH)
    return placed.join(spots, [by, "lat", "lon"]).select(*dets.columns, "component")


def class_votes(members: DataFrame, group: str, order: str) -> DataFrame:
    """(group, top_class, top_n, second_class, second_n, total): most votes first, equal ones by who voted first."""
    votes = members.groupBy(group, "class_name").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "first", "class_name")))  # one a class
    tops = votes.groupBy(group).agg(ranked.alias("r"), F.sum("n").alias("total"))
    pick = lambda i, f: F.get(F.col("r"), i)[f]
    return tops.select(group, pick(0, "class_name").alias("top_class"), (-pick(0, "m")).alias("top_n"), pick(1, "class_name").alias("second_class"), (-pick(1, "m")).alias("second_n"), "total")


def _profiles(members: DataFrame, group: str, order: str, lows: tuple[str, ...] = (), spread: tuple[str, ...] = (), firsts: tuple[str, ...] = ()) -> DataFrame:
    """One row a group: votes as class_votes has them, c1 and on (the best confidences in their order), the medians of the best places, least values of
    lows, min_<c>, spreads, <c>_std, and the best member's values, best_<c>.

    The members are shuffled once, by group; ranks, votes and all else are windows and aggregates of the rows where they then lie.
    """
    w = Window.partitionBy(group)
    ranked = members.where(F.col(group).isNotNull()).withColumn("_r", F.row_number().over(w.orderBy(F.desc("confidence"), order)))
    ranked = ranked.withColumns({f"{c}_std": F.stddev_pop(c).over(w) for c in spread}) if spread else ranked
    at = lambda c, k: F.max(F.when(F.col("_r") == k, F.col(c)))
    most = {f"c{k}": at("confidence", k) for k in range(1, TOP_CONFIDENCES + 1)} | {f"_{c}{k}": at(c, k) for c in ("lat", "lon") for k in range(1, TOP_PLACES + 1)}
    most |= {f"best_{c}": at(c, 1) for c in firsts} | {f"{c}_std": F.max(f"{c}_std") for c in spread}
    votes = ranked.groupBy(group, "class_name").agg(F.count("*").alias("_n"), F.min(order).alias("_first"), *(v.alias(n) for n, v in most.items()), *(F.min(c).alias(f"min_{c}") for c in lows))
    votes = votes.withColumn("_k", F.row_number().over(w.orderBy(F.desc("_n"), "_first")))
    pick = lambda c, k: F.max(F.when(F.col("_k") == k, F.col(c)))
    out = votes.groupBy(group).agg(
        pick("class_name", 1).alias("top_class"), pick("_n", 1).alias("top_n"), pick("class_name", 2).alias("second_class"), pick("_n", 2).alias("second_n"), F.sum("_n").alias("total"),
        *(F.max(n).alias(n) for n in most), *(F.min(f"min_{c}").alias(f"min_{c}") for c in lows),
    )
    return out.withColumns({f"{c}_median": _median([F.col(f"_{c}{k}") for k in range(1, TOP_PLACES + 1)]) for c in ("lat", "lon")})


def _median(values: list[Column]) -> Column:
    v = F.sort_array(F.array_compact(F.array(*values)))
    at = lambda i: F.get(v, F.floor(i / 2).cast("int"))
    return at(F.size(v) - 1) * 0.5 + at(F.size(v)) * 0.5


def _merged(heads: DataFrame, radius_m: float, by: str) -> DataFrame:
    """(component, cluster) of the components that have another one of their class within the radius."""
    heads = heads.select("component", F.col(f"min_{by}").alias(by), "top_class", "lat_median", "lon_median")
    right = heads.select(by, "top_class", F.col("component").alias("other"), F.col("lat_median").alias("r_lat"), F.col("lon_median").alias("r_lon"))
    pairs = within(heads, right, radius_m, (by, "top_class"), ("lat_median", "lon_median")).where("component < other")
    part = lambda lat, lon: F.xxhash64(by, "top_class", F.floor(F.col(lat) * 100), F.floor(F.col(lon) * 100))
    pairs = pairs.select("component", "other", part("lat_median", "lon_median").alias("_pa"), part("r_lat", "r_lon").alias("_pb"))
    merged = cut(components_by_parts(pairs, "component", "other", "_pa", "_pb", SMALL_GRAPH).select(F.col("node").alias("component"), F.col("component").alias("cluster")))
    return F.broadcast(merged) if merged.count() <= FEW_MERGED else merged


def merge_close(clustered: DataFrame, radius_m: float = MERGE_M, by: str = "video_id", idx: str = "det_idx") -> DataFrame:
    """clustered with cluster, the smallest component of those that same-class centres at most radius_m apart join, and member_order, by
    component and then detection. Centres are those before merging."""
    clustered = cut(clustered)  # read twice below
    merged = _merged(cut(_profiles(clustered, "component", idx, lows=(by,))), radius_m, by)
    out = clustered.join(merged, "component", "left").withColumn("cluster", F.coalesce("cluster", "component"))
    return out.withColumn("member_order", F.struct("component", idx))


def merged_clusters(clustered: DataFrame, radius_m: float = MERGE_M, by: str = "video_id", idx: str = "det_idx", ts: str = "frame_ts") -> DataFrame:
    """aggregate_clusters of what merge_close gives, by cluster. A component that merges with none is its cluster, and what was gathered of its members to
    find that out is kept; only members of those that merge are gathered again."""
    clustered = cut(clustered)  # read twice below
    gathered = {"spread": ("lat", "lon"), "firsts": tuple(dict.fromkeys((ts, "det_idx")))}
    heads = cut(_profiles(clustered, "component", idx, lows=tuple(dict.fromkeys((by, ts))), **gathered))
    merged = _merged(heads, radius_m, by)
    members = clustered.join(merged, "component").withColumn("member_order", F.struct("component", idx))
    joined = _profiles(members, "cluster", "member_order", lows=(ts,), **gathered)
    alone = heads.join(merged, "component", "left_anti").withColumnRenamed("component", "cluster")
    return _described(alone.select(*joined.columns).unionByName(joined), "cluster", ts)


def aggregate_clusters(members: DataFrame, group: str, order: str = "det_idx", ts: str = "frame_ts") -> DataFrame:
    """One row a cluster: class by vote, mean of the best confidences, medians of the best places, spread, counts, best frame, review reason."""
    return _described(_profiles(members, group, order, lows=(ts,), spread=("lat", "lon"), firsts=tuple(dict.fromkeys((ts, "det_idx")))), group, ts)


def _described(profiles: DataFrame, group: str, ts: str) -> DataFrame:
    best = [F.col(f"c{k}") for k in range(1, TOP_CONFIDENCES + 1)]
    held = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in best), F.lit(0))
    out = profiles.withColumn("confidence", sum((F.coalesce(c, F.lit(0.0)) for c in best), F.lit(0.0)) / F.nullif(held, F.lit(0))).withColumn("class_vote_pct", F.col("top_n") / F.col("total"))
    out = out.withColumnsRenamed({"total": "sighting_count", f"min_{ts}": "first_seen_ts", f"best_{ts}": "best_frame_ts", "best_det_idx": "best_det"})
    reason = F.concat_ws(
        "; ",
        F.when(F.col("sighting_count") == 1, "Single sighting"),
        F.when(F.col("confidence") < LOW_CONFIDENCE, F.format_string("Low confidence (%.2f)", F.round("confidence", 9))),
        F.when(
            (F.col("class_vote_pct") < SPLIT_VOTE) & F.col("second_class").isNotNull(),
            F.format_string("Split class vote (%s %.0f%% / %s %.0f%%)", "top_class", F.round(F.col("class_vote_pct") * 100, 9), "second_class", F.round(F.col("second_n") / F.col("sighting_count") * 100, 9)),
        ),
    )
    out = out.withColumn("review_reason", F.nullif(reason, F.lit(""))).withColumn("needs_review", F.col("review_reason").isNotNull())
    return out.select(
        group, F.col("top_class").alias("sign_class"), F.round("confidence", 6).alias("confidence"), "sighting_count", "needs_review", "review_reason",
        F.round("class_vote_pct", 6).alias("class_vote_pct"), "first_seen_ts", "best_frame_ts", "best_det", F.round("lat_median", 8).alias("lat_median"),
        F.round("lon_median", 8).alias("lon_median"), F.round("lat_std", 8).alias("lat_std"), F.round("lon_std", 8).alias("lon_std"),
    )


def summary(clusters: DataFrame) -> DataFrame:
    """Clusters, sightings and open reviews by class and in total (null class)."""
    return clusters.rollup("sign_class").agg(F.count("*").alias("clusters"), F.sum("sighting_count").alias("sightings"), F.count_if("needs_review").alias("needs_review"))



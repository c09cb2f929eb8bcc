"""Operators over time: as-of interpolation, gap sessions, nearest frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbline.functions.geo import lerp
from curbline.operators.ordered import LONG, both, by_length, carried, ranges, running


def frame_grid(videos: DataFrame, fps: float, video: str = "video_id", duration_ms: str = "duration_ms") -> DataFrame:
    """One row a sampled frame: video, frame_no and ts_ms = frame_no * 1000 / fps up to the duration."""
    step = 1000.0 / fps
    frames = F.sequence(F.lit(0).cast("long"), F.floor(F.col(duration_ms) / step))
    return videos.where(F.col(duration_ms) >= 0).select(video, F.explode(frames).alias("frame_no")).withColumn("ts_ms", F.col("frame_no") * step)


def frame_stride(videos: DataFrame, every_s: Column | float, video: str = "video_id", fps: str = "fps", n_frames: str = "n_frames", max_s: float | None = None) -> DataFrame:
    """One row a frame taken by counting: every max(1, round(fps * every_s)) frames, as (video, taken, frame_idx, ts_ms); at most the frames of the
    first max_s seconds. A rate of 0 or null counts as 30."""
    rate = F.when(F.col(fps) > 0, F.col(fps)).otherwise(F.lit(30.0))
    step = F.greatest(F.lit(1), F.bround(rate * every_s)).cast("long")
    end = F.col(n_frames) if max_s is None else F.least(F.col(n_frames), F.floor(rate * max_s))
    rows = videos.where(F.col(n_frames) > 0).withColumn("_rate", rate).withColumn("_end", end.cast("long")).withColumn("_step", step).where("_end > 0")
    taken = F.sequence(F.lit(0).cast("long"), F.col("_end") - 1, F.col("_step"))
    return rows.select(video, F.posexplode(taken).alias("taken", "frame_idx"), "_rate").select(video, "taken", "frame_idx", (F.col("frame_idx") * 1000.0 / F.col("_rate")).alias("ts_ms"))


def frame_seek(videos: DataFrame, most: int | None = None, step_ms: float = 1000.0, video: str = "video_id", duration_ms: str = "duration_ms") -> DataFrame:
    """One row a position sought: every step_ms before the end, at most most of them, as (video, frame_no, ts_ms)."""
    n = F.ceil(F.col(duration_ms) / step_ms).cast("long")
    n = n if most is None else F.least(n, F.lit(most).cast("long"))
    rows = videos.withColumn("_n", n).where("_n > 0")
    return rows.select(video, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("frame_no")).withColumn("ts_ms", F.col("frame_no") * step_ms)


def interpolate_track(frames: DataFrame, fixes: DataFrame, by: str = "video_id", ts: str = "ts_ms", values: tuple[str, ...] = ("lat", "lon", "alt"), tolerance_ms: float = 2000, most: int = LONG) -> DataFrame:
    """frames with each value interpolated linearly between the fixes before and after.

    One union and one sort: the last fix at or before and the first one after each frame come from two windows, or for a track of more than most rows
    from ranges of it and what they carry over. Up to tolerance_ms outside the track the nearest end counts, beyond that values are null, as is an
    interpolated value if either side is.
    """
    have = F.struct(F.col(ts).cast("double").alias("t"), *(F.col(v) for v in values))
    extra = [c for c in frames.columns if c not in (by, ts)]
    left = frames.select(F.col(by).alias("_by"), F.col(ts).cast("double").alias("_t"), F.lit(1).alias("_side"), F.struct(*frames.columns).alias("_row"))
    right = fixes.select(F.col(by).alias("_by"), F.col(ts).cast("double").alias("_t"), F.lit(0).alias("_side"), have.alias("_fix"))
    short, long = by_length(left.unionByName(right, allowMissingColumns=True), ("_by",), most)
    if short is not None:
        order = Window.partitionBy("_by").orderBy("_t", "_side")
        lo = F.last("_fix", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
        back = Window.partitionBy("_by").orderBy(F.desc("_t"), F.desc("_side"))  # a frame that runs to the end is scanned anew for every row
        hi = F.last("_fix", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
        short = short.withColumn("_lo", lo).withColumn("_hi", hi)
    if long is not None:
        long = carried(long, ("_by",), ("_t", "_side"), "_fix", "_lo")
        long = carried(long, ("_by",), ("_t", "_side"), "_fix", "_hi", ahead=True, own=False)
    seen = both(short, long).where("_side = 1")
    f = (F.col("_t") - F.col("_lo.t")) / (F.col("_hi.t") - F.col("_lo.t"))
    out = []
    for v in values:
        a, b = F.col(f"_lo.{v}"), F.col(f"_hi.{v}")
        before = F.when(F.col("_hi.t") - F.col("_t") <= tolerance_ms, b)
        after = F.when(F.col("_t") - F.col("_lo.t") <= tolerance_ms, a)
        between = F.when(F.col("_t") == F.col("_lo.t"), a).otherwise(lerp(a, b, f))
        out.append(F.when(F.col("_lo").isNull(), before).when(F.col("_hi").isNull(), after).otherwise(between).alias(v))
    return seen.select(F.col(f"_row.{by}"), F.col(f"_row.{ts}"), *(F.col(f"_row.{c}") for c in extra if c not in values), *out)


def gap_sessions(rows: DataFrame, by: str, ts: str, gap: float, order: tuple[str, ...] = (), most: int = LONG) -> DataFrame:
    """rows with session, a number from 0 by time: a new one begins where the time since the row before is over gap. Groups of more than most rows are
    scanned by ranges, the last time and number being carried over."""
    short, long = by_length(rows, (by,), most)
    if short is not None:
        w = Window.partitionBy(by).orderBy(ts, *order)
        starts = F.coalesce((F.col(ts) - F.lag(ts).over(w) > gap).cast("long"), F.lit(0))
        short = short.withColumn("_new", starts).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    if long is not None:
        long = carried(long.withColumn("_at", F.struct(ts)), (by,), (ts, *order), "_at", "_before", own=False)
        starts = F.coalesce((F.col(ts) - F.col(f"_before.{ts}") > gap).cast("long"), F.lit(0))
        long = running(long, (by,), (ts, *order), {"session": starts}).drop("_at", "_before")
    return both(short, long)


def global_session_ids(sessions: DataFrame, by: str, session: str = "session") -> DataFrame:
    """sessions with cluster_id "{by}_c{n}", n counting sessions over all groups in the order of by. The offsets are a sum over one row a group."""
    counts = sessions.groupBy(by).agg((F.max(session) + 1).alias("_n"))
    ahead = Window.orderBy(F.col(by).cast("string")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).select(by, "_off")
    number = F.col("_off") + F.col(session)
    return sessions.join(offsets, by).withColumn("cluster_id", F.concat(F.col(by).cast("string"), F.lit("_c"), number.cast("string"))).drop("_off")


def nearest_frame(asked: DataFrame, frames: DataFrame, by: str, ts: str, frame_ts: str, tolerance: int = 300) -> DataFrame:
    """Each asked time with the frame time it means: the same, else one less, else one more, else the nearest within tolerance, the earlier
    first of equals. Times are dealt into bins of the tolerance, so that the range becomes an equi-join with three bins."""
    distinct = frames.select(F.col(by).alias("_by"), F.col(frame_ts).alias("_ft")).distinct().withColumn("_bin", F.floor(F.col("_ft") / tolerance))
    binned = asked.withColumn("_bin", F.explode(F.array(*(F.floor(F.col(ts) / tolerance) + k for k in (-1, 0, 1)))))
    near = binned.join(distinct, (F.col(by) == F.col("_by")) & (binned["_bin"] == distinct["_bin"]) & (F.abs(F.col("_ft") - F.col(ts)) <= tolerance))
    d = F.col("_ft") - F.col(ts)
    rank = F.struct(F.when(d == 0, 0).when(d == -1, 1).when(d == 1, 2).otherwise(3).alias("p"), F.abs(d).alias("d"), F.col("_ft").alias("t"))
    return near.groupBy(*asked.columns).agg(F.min(rank).alias("_r")).select(*asked.columns, F.col("_r.t").alias(frame_ts))


def _changes(values: Any, last: float | None, least: float) -> tuple[list[bool], float | None]:
    """Which values differ by at least least from the last one kept, and the last one kept in the end."""
    keep = []
    for v in values:
        keep.append(last is None or abs(v - last) >= least)
        last = v if keep[-1] else last
    return keep, last


def _walked(by: str, value: str, least: float, begin: dict[int, tuple[Any, float]], ends: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Walks a range of sorted rows from the state begin has for it (group, last kept): the kept rows, or with ends a row of the state it ends in."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, last, at = None, None, None
        for pdf in frames:
            if not len(pdf):
                continue
            if at is None:
                at = int(pdf["_p"].iloc[0])
                group, last = begin.get(at, (None, None))
            changed = pdf[by].ne(pdf[by].shift())
            for _, part in pdf.groupby(changed.cumsum(), sort=False):
                last = last if part[by].iloc[0] == group else None
                group = part[by].iloc[0]
                keep, last = _changes(part[value], last, least)
                if not ends:
                    yield part[keep]
        if ends and at is not None:
            yield pd.DataFrame({"_p": [at], "_group": [str(group)], "_last": [float(last)]})

    return run


def suppress_repeats(frames: DataFrame, by: str, ts: str, value: str, least_change: float, most: int = LONG) -> DataFrame:
    """Frames whose value differs by at least least_change from the last frame kept of the group. State is the last kept row, which no window
    has, so groups are walked; a group arrives sorted and only its two columns are held.

    Groups of more than most rows are walked by ranges. A range needs the state that the one before it ends in, so the ranges are walked from guesses, all at
    once, until none ends otherwise than was guessed: walks from different states soon keep the same rows, so that two or three rounds do. Only a row a range
    comes to the driver.
    """
    short, long = by_length(frames, (by,), most)
    if short is not None:
        short = short.groupBy(by).applyInPandas(lambda pdf: (p := pdf.sort_values([ts], kind="stable"))[_changes(p[value], None, least_change)[0]], frames.schema)
    if long is not None:
        kept = ranges(long.withColumn("_key", F.col(by).cast("string")), (by, ts)).drop("_i")
        begin: dict[int, tuple[Any, float]] | None = None
        while True:
            ends = kept.mapInPandas(_walked("_key", value, least_change, begin or {}, True), "_p int, _group string, _last double").orderBy("_p").collect()
            found = {after["_p"]: (before["_group"], before["_last"]) for before, after in zip(ends, ends[1:], strict=False)}
            if found == begin:
                break
            begin = found
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
        long = kept.mapInPandas(_walked("_key", value, least_change, begin, False), schema).select(*frames.columns)
    return both(short, long)


def running_budget(rows: DataFrame, size: str, order: tuple[Column | str, ...], budget: float, by: tuple[str, ...] = (), most: int = LONG) -> DataFrame:
    """The rows taken, in order, as long as what was taken before is under the budget. Groups of more than most rows are summed by ranges."""
    short, long = by_length(rows, by, most)
    if short is not None:
        before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        short = short.withColumn("used_before", F.coalesce(F.sum(size).over(before), F.lit(0)))
    if long is not None:
        long = running(long, by, order, {"used_before": F.coalesce(F.col(size), F.lit(0))}).withColumn("used_before", F.col("used_before") - F.coalesce(F.col(size), F.lit(0)))
    return both(short, long).where(F.col("used_before") < budget)


def early_stop(metrics: DataFrame, by: str, step: str, value: str, delta: float = 1e-4, patience: int = 10) -> DataFrame:
    """The step at which each run stops: patience steps after the last one that beat the best before it by over delta."""
    w = Window.partitionBy(by).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    better = F.coalesce(F.col(value) < F.min(value).over(w) - delta, F.lit(True))
    best = metrics.withColumn("_b", better).withColumn("_last", F.max(F.when(F.col("_b"), F.col(step))).over(Window.partitionBy(by).orderBy(step)))
    return best.groupBy(by).agg(F.coalesce(F.min(F.when(F.col(step) - F.col("_last") >= patience, F.col(step))), F.max(step)).alias("stop_step"))


"""Rectangle joins: boxes meet the boxes they overlap, by the cells of a grid of several levels.

A box belongs to the level whose cells are the least powers of two that are as large as it, so it touches four of them at most. Two boxes meet on the level
of the larger one: that one is filed there under its own cells, the smaller one under the cells it touches on that level. A pair is given out in one cell only,
the one of the first corner of what they share. So the pairs formed follow the overlaps, however many boxes an image has.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(b: Column) -> Column:
    return F.ceil(F.log2(F.greatest(b["x2"] - b["x1"], b["y2"] - b["y1"]))).cast("int")


def _sized(rows: DataFrame, box: str) -> DataFrame:
    b = F.col(box)
    return rows.where((b["x2"] > b["x1"]) & (b["y2"] > b["y1"]))


def _filed(rows: DataFrame, box: str, levels: list[int], own: int) -> DataFrame:
    """rows under (_f.k, _f.l, _cx, _cy). Of kind own a row is filed on its own level; of the other kind on all larger levels, and, where that is kind 0, on
    its own level too, so that boxes of one level meet once."""
    b, at = F.col(box), F.col("_own")
    places = [F.struct(F.lit(k).alias("k"), F.lit(x).alias("l"), F.lit(math.ldexp(1.0, -x)).alias("s")) for x in levels for k in (0, 1)]
    meant = lambda x: F.when(x["k"] == own, at == x["l"]).otherwise(at < x["l"] if own == 0 else at <= x["l"])
    spread = rows.withColumn("_own", _level(b)).withColumn("_f", F.explode(F.filter(F.array(*places), meant)))
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(b[lo] * F.col("_f.s")), F.floor(b[hi] * F.col("_f.s"))))
    return spread.withColumn("_cx", cells("x1", "x2")).withColumn("_cy", cells("y1", "y2"))


def overlapping(left: DataFrame, right: DataFrame, by: tuple[str, ...], box: str = "box", other_box: str = "other_box") -> DataFrame:
    """Inner join of the rows of left and right that are equal in by and whose boxes share area. Column names of the sides must differ but for by."""
    left, right = _sized(left, box), _sized(right, other_box)
    found = left.select(_level(F.col(box)).alias("l")).union(right.select(_level(F.col(other_box)).alias("l"))).agg(F.collect_set("l")).first()[0]
    levels = sorted(found)  # powers of two between the least and the largest box
    if not levels:
        return left.join(right, list(by)).where(F.lit(False))
    a = _filed(left, box, levels, 0)
    b = _filed(right, other_box, levels, 1).withColumnsRenamed({"_own": "_rown", "_f": "_rf", "_cx": "_rx", "_cy": "_ry"} | {c: f"_by_{c}" for c in by})
    on = (F.col("_f.k") == F.col("_rf.k")) & (F.col("_f.l") == F.col("_rf.l")) & (F.col("_cx") == F.col("_rx")) & (F.col("_cy") == F.col("_ry"))
    for c in by:
        on &= F.col(c) == F.col(f"_by_{c}")
    x, y = F.col(box), F.col(other_box)
    shared = (F.least(x["x2"], y["x2"]) > F.greatest(x["x1"], y["x1"])) & (F.least(x["y2"], y["y2"]) > F.greatest(x["y1"], y["y1"]))
    once = (F.floor(F.greatest(x["x1"], y["x1"]) * F.col("_f.s")) == F.col("_cx")) & (F.floor(F.greatest(x["y1"], y["y1"]) * F.col("_f.s")) == F.col("_cy"))
    return a.join(b, on & shared & once).select(*left.columns, *(c for c in right.columns if c not in by))

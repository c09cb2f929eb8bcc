"""Numbers and running sums over a whole order, without a task that sees all of it.

Rows are sorted by ranges and kept once, so that the ranges stay what they are; the ranges' sums, a row each, are added up, and every range goes
on from the sum of those before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbline.plans.session import cut

_LOW = (1 << 33) - 1  # the part of monotonically_increasing_id that counts inside a partition


def ranges(rows: DataFrame, order: tuple[Column | str, ...]) -> DataFrame:
    """rows sorted by ranges and kept, with _p, the number of the range, and _i, rising within it."""
    kept = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    return kept.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW)))


def numbered(rows: DataFrame, order: tuple[Column | str, ...], name: str) -> DataFrame:
    """rows with name, numbers from 1 in the given order, which should leave no ties."""
    kept = ranges(rows, order)
    sizes = kept.groupBy("_p").agg(F.count("*").alias("_n"))  # a row a partition
    ahead = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return kept.join(F.broadcast(ahead), "_p").withColumn(name, F.col("_off") + F.col("_i") + 1).drop("_p", "_i", "_off")


def running(rows: DataFrame, by: tuple[str, ...], order: tuple[Column | str, ...], sums: dict[str, Column], placed: bool = False) -> DataFrame:
    """rows with running sums inside each group of by in the given order, the row itself included. A group may have any size: windows see the part of
    it in one range, and what came before is added. With placed the columns that tell where rows lie stay, for best_after."""
    kept = rows if {"_p", "_i"} <= set(rows.columns) else ranges(rows, (*by, *order))
    parts = kept.groupBy("_p", *by).agg(*(F.sum(c).alias(f"_s_{n}") for n, c in sums.items()))  # a row a range and a row a group
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    ahead = parts.select(F.col("_p").alias("_q"), *(F.col(b).alias(f"_b_{b}") for b in by), *(F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in sums))
    here = Window.partitionBy("_p", *by).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    out = kept.withColumns({f"_here_{n}": F.sum(c).over(here) for n, c in sums.items()})
    met = out.join(ahead, (F.col("_p") == F.col("_q")) & _same(by))
    return met.withColumns({n: F.col(f"_off_{n}") + F.col(f"_here_{n}") for n in sums}).drop("_q", *(() if placed else ("_p", "_i")), *(f"_b_{b}" for b in by), *(f"_{k}_{n}" for k in ("off", "here") for n in sums))


def carried(rows: DataFrame, by: tuple[str, ...], order: tuple[Column | str, ...], value: str, name: str, ahead: bool = False, own: bool = True) -> DataFrame:
    """rows with name, the last value of its group that is not null at or before the row, or with own=False before it; with ahead the first one at or after it,
    or after it. What a range ends with is carried into those after it. The columns that tell where rows lie stay, for further scans of the same order."""
    kept = rows if {"_p", "_i"} <= set(rows.columns) else ranges(rows, (*by, *order))
    at = F.when(F.col(value).isNotNull(), F.col("_i"))
    parts = kept.groupBy("_p", *by).agg((F.min_by if ahead else F.max_by)(F.col(value), at).alias("_v"))
    # what lies ahead is what has passed in the reverse order: a frame that runs to the end is scanned anew for every row
    along = F.desc if ahead else F.asc
    groups, inside = Window.partitionBy(*by).orderBy(along("_p")), Window.partitionBy("_p", *by).orderBy(along("_i"))
    span = lambda w, near: w.rowsBetween(Window.unboundedPreceding, -near)
    pick = F.last
    other = parts.select(F.col("_p").alias("_q"), *(F.col(b).alias(f"_b_{b}") for b in by), pick("_v", ignorenulls=True).over(span(groups, 1)).alias("_far"))
    met = kept.withColumn("_here", pick(value, ignorenulls=True).over(span(inside, 0 if own else 1))).join(other, (F.col("_p") == F.col("_q")) & _same(by))
    return met.withColumn(name, F.coalesce("_here", "_far")).drop("_q", "_here", "_far", *(f"_b_{b}" for b in by))


#: A group of more rows than this is scanned by ranges instead of in one task.
LONG = 2_000_000


def by_length(rows: DataFrame, by: tuple[str, ...], most: int = LONG) -> tuple[DataFrame | None, DataFrame | None]:
    """rows of the groups of at most most rows, and of the longer ones; None for none. There are fewer longer groups than rows / most, so they are broadcast."""
    total = rows.count()
    if total <= most or not by:
        return (rows, None) if total <= most else (None, rows)
    big = cut(rows.groupBy(*(F.col(b).alias(f"_b_{b}") for b in by)).agg(F.count("*").alias("_n")).where(F.col("_n") > most).drop("_n"))
    if not big.take(1):
        return rows, None
    return rows.join(F.broadcast(big), _same(by), "left_anti"), rows.join(F.broadcast(big), _same(by), "left_semi")


def both(short: DataFrame | None, long: DataFrame | None) -> DataFrame:
    """The rows of either."""
    return short if long is None else long if short is None else short.unionByName(long.select(*short.columns))


def best_after(rows: DataFrame, by: tuple[str, ...], order: tuple[Column | str, ...], value: str, name: str) -> DataFrame:
    """rows with name, the largest value from the row on to the end of its group. Rows that running left with their ranges are not sorted again."""
    kept = rows if {"_p", "_i"} <= set(rows.columns) else ranges(rows, (*by, *order))
    parts = kept.groupBy("_p", *by).agg(F.max(value).alias("_m"))
    # in the reverse order: a frame that runs to the end is scanned anew for every row
    after = Window.partitionBy(*by).orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = parts.select(F.col("_p").alias("_q"), *(F.col(b).alias(f"_b_{b}") for b in by), F.max("_m").over(after).alias("_later"))
    here = Window.partitionBy("_p", *by).orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)
    met = kept.withColumn("_here", F.max(value).over(here)).join(ahead, (F.col("_p") == F.col("_q")) & _same(by))
    return met.withColumn(name, F.greatest("_here", "_later")).drop("_q", "_p", "_i", "_here", "_later", *(f"_b_{b}" for b in by))


def _same(by: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for b in by:
        out &= F.col(b).eqNullSafe(F.col(f"_b_{b}"))
    return out

"""Equi-joins whose keys may be very uneven."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of the left rows is heavy.
SHARE = 1000


def join_uneven(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, share: int = SHARE) -> DataFrame:
    """left joined with right on key, right having one row a key and in weight the number of left's rows of that key.

    total is at least the number of left's rows. So fewer than share keys can hold more than total / share of them: those rows of right are
    broadcast, and left's rows of all other keys are shuffled. left is read twice and should be cheap to read. Null keys meet nothing. The other rows of
    right are never broadcast: what is small enough for Spark's threshold when shuffled may be more than the driver can build tables of.
    """
    heavy = F.broadcast(right.where(F.col(weight) * share > total))
    light = right.where(F.col(weight) * share <= total)
    return left.join(heavy, key).unionByName(left.join(heavy.select(key), key, "left_anti").join(light.hint("merge"), key))

"""The best N items of every group, by two-stage salted ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.skew import SALTS, fresh, salt_of


def top_n(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, spread: Sequence[str], rank: str = "rnk", salts: int = SALTS) -> DataFrame:
    """``df``'s columns plus ``rank`` (from 1) of the first ``n`` rows of each group in ``order``.

    The first stage ranks inside (group, salt), the salt being a hash of the ``spread``
    columns, and keeps n there; the second ranks the at most n * salts survivors of a
    group. Both ranks are cut at once, so Spark limits each group before the shuffle. Null
    group values form a group like any other. ``order`` should be total, ties being
    otherwise any.
    """
    salt = fresh(df, "salt")
    place = fresh(df, "place")
    inner = Window.partitionBy(*group, salt).orderBy(*order)
    outer = Window.partitionBy(*group).orderBy(*order)
    kept = df.withColumn(salt, salt_of(spread, salts)).withColumn(place, F.row_number().over(inner)).where(F.col(place) <= n)
    last = kept.drop(place).withColumn(place, F.row_number().over(outer)).where(F.col(place) <= n)
    return last.select(*df.columns, F.col(place).cast("bigint").alias(rank))


def best_items(df: DataFrame, group: str, item: str, score: str, n: int) -> DataFrame:
    """(group, rnk, item, score): the ``n`` items of highest score, ties by smaller item.

    An item that occurs more than once in a group counts once, with its highest score. Null
    and NaN scores and null groups or items take no part; a group left empty gives no row.
    """
    valid = F.col(group).isNotNull() & F.col(item).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))
    once = df.where(valid).groupBy(F.col(group).alias("g"), F.col(item).alias("i")).agg(F.max(score).alias("s"))
    best = top_n(once, ["g"], [F.col("s").desc(), F.col("i")], n, spread=["i"])
    return best.select(F.col("g").alias(group), "rnk", F.col("i").alias(item), F.col("s").alias(score))

"""Composite keys, ids and portable pseudo-random orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_COLUMNS = ("search_query", "search_location_id", "search_is_delivery_search", "search_infm_params_text", "search_category")


def composite_key(columns: Sequence[str] = QUERY_COLUMNS) -> Column:
    """The columns as text, null as '', between unit separators."""
    return F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def short_id(key: Column) -> Column:
    """Sixteen hex digits of a hash of the key."""
    return F.substring(F.sha2(key, 256), 1, 16)


def shuffled(key: Column, seed: int) -> Column:
    """A value to order by that is random in the key and equal in any engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from the first 12 hex digits of ``shuffled``."""
    return (F.conv(F.substring(shuffled(key, seed), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def numbered(df: DataFrame, key: str, seed: int, column: str = "slot") -> DataFrame:
    """``df`` with the place (from 0) of each row in the ``shuffled`` order of its unique key.

    The order is cut at hash prefixes; places inside a prefix are counted apart and moved by
    the number of rows before it, so no task sees more than a 4096th of the rows.
    """
    order = df.withColumn("__h", shuffled(F.col(key), seed)).withColumn("__b", F.substring("__h", 1, 3))
    sizes = order.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__b").orderBy("__h", key))
    placed = order.withColumn("__i", inside).join(F.broadcast(before), "__b")  # at most 4096 rows
    return placed.select(*df.columns, (F.col("__before") + F.col("__i") - 1).cast("bigint").alias(column))

"""The n rows of least value, without sorting or gathering them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL = 4_000  # rows that one task may order
CUTS = [k / 64 for k in range(1, 64)]


def hex_value(text: Column) -> Column:
    """The first 12 hex digits as a number, in the order of the texts."""
    return F.conv(F.substring(text, 1, 12), 16, 10).cast("double")


def least(df: DataFrame, value: str, tie: list[str], n: int, small: int = SMALL) -> DataFrame:
    """The ``n`` rows of least ``value`` (a number, not null), equal ones by ``tie``; all if there are no more.

    The range that holds the n-th value is narrowed by 63 quantiles at a time, each pass
    giving 64 counts to the driver, until it holds at most ``small`` rows; those are ordered,
    everything below is taken as it is. ``df`` must give the same rows whenever it is read.
    """
    if n <= 0:
        return df.limit(0)
    low, before = None, 0
    inside, size = df, df.count()
    while size > small and before + size > n:
        cuts = sorted(set(inside.agg(F.percentile_approx(value, CUTS, 1000).alias("c")).first()["c"]))
        chunk = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col(value)))
        counts = {r["k"]: r["n"] for r in inside.groupBy(chunk.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
        at = before
        for k in sorted(counts):
            if at + counts[k] >= n or k == max(counts):
                break
            at += counts[k]
        if counts[k] == size:
            break  # one value only: its rows differ by their ties alone
        before, size = at, counts[k]
        low = cuts[k - 1] if k else low
        above = F.col(value) > F.lit(float(low)) if low is not None else F.lit(True)
        inside = df.where(above & (F.col(value) <= F.lit(float(cuts[k]))) if k < len(cuts) else above)
    rest = inside.orderBy(value, *tie).limit(n - before) if before + size > n else inside
    return rest if low is None else df.where(F.col(value) <= F.lit(float(low))).unionAll(rest)

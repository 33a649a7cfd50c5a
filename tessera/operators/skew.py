"""Joining rows to aggregates of their own key when one key may hold a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 32


def salt_of(columns: Sequence[str], salts: int = SALTS) -> Column:
    """A salt from the row's own values, so that a recomputed task gives the same one."""
    return F.pmod(F.xxhash64(F.lit(77), *[F.col(c) for c in columns]), F.lit(salts)).cast("int")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    name = f"__{stem}"
    while name in df.columns:
        name = f"_{name}"
    return name


def enrich(
    rows: DataFrame,
    keys: Sequence[str],
    partial: dict[str, Column],
    total: dict[str, Column],
    spread: Sequence[str],
    having: Column | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Inner join of ``rows`` with aggregates over their key, without a hot task.

    Rows are aggregated per (key, salt) first, where the salt comes from the ``spread``
    columns, then per key; each key's result goes back only to the salts in which the key
    occurs, so a join partition holds at most about 1/``salts`` of a hot key. ``partial``
    gives named aggregates of rows, ``total`` named aggregates of the partial ones. Groups
    with a null key take part (null equals null). ``having`` filters the groups.
    """
    salt = fresh(rows, "salt")
    found = fresh(rows, "salts")
    salted = rows.withColumn(salt, salt_of(spread, salts))
    first = salted.groupBy(*keys, salt).agg(*[c.alias(n) for n, c in partial.items()])
    groups = first.groupBy(*keys).agg(F.collect_list(salt).alias(found), *[c.alias(n) for n, c in total.items()])
    if having is not None:
        groups = groups.where(having)
    groups = groups.select(*keys, *total, F.explode(found).alias(salt))
    other = groups.select(*[F.col(c).alias(f"__g_{c}") for c in [*keys, salt]], *total)
    match = F.lit(True)
    for c in [*keys, salt]:
        match = match & salted[c].eqNullSafe(other[f"__g_{c}"])
    return salted.join(other, match).select(*rows.columns, *total)


def attach(rows: DataFrame, table: DataFrame, keys: Sequence[str], spread: Sequence[str], salts: int = SALTS) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has each key once, without a hot task.

    A key's row of ``table`` is repeated only for the salts in which the key occurs among
    ``rows``. Null keys meet null keys. Other columns may not share a name.
    """
    salt = fresh(rows, "salt")
    salted = rows.withColumn(salt, salt_of(spread, salts))
    found = salted.select(*keys, salt).distinct()
    other = found.select(*[F.col(c).alias(f"__f_{c}") for c in keys], F.col(salt).alias(f"__s_{salt}"))
    match = F.lit(True)
    for c in keys:
        match = match & other[f"__f_{c}"].eqNullSafe(table[c])
    extra = [c for c in table.columns if c not in keys]
    lifted = other.join(table, match).select(*[F.col(f"__f_{c}") for c in keys], f"__s_{salt}", *extra)
    match = salted[salt] == lifted[f"__s_{salt}"]
    for c in keys:
        match = match & salted[c].eqNullSafe(lifted[f"__f_{c}"])
    return salted.join(lifted, match).select(*rows.columns, *extra)

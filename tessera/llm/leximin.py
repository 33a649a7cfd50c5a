"""One ranking from several differently-scaled scores: leximin over in-group percentiles.

Places are counted exactly by one path for groups of any size. The values of a score are
cut into chunks of the value order, at quantiles for groups of over ``PIECE`` items; a value
that is itself a cut has a chunk of its own, which is dealt out by salts, as all its rows
have the same place. Only a chunk is ever sorted; the rows above it are a sum over chunks.
The cuts are computed once and kept, so every part of the plan sees the same ones.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.topn import top_n
from tessera.operators.skew import salt_of
from tessera.session import durable

PIECE = 50_000  # items of a group in one chunk, about
MOST_CUTS = 4096
BROADCAST_GROUPS = 2_000  # groups with cuts that are broadcast; more are joined by a shuffle


def _cuts(once: DataFrame, n: int, piece: int) -> DataFrame | None:
    """(g, c0, c1, …): the distinct cuts of each score of the groups of over ``piece`` items; None without such groups."""
    big = durable(once.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > piece))
    head = big.agg(F.count(F.lit(1)).alias("groups"), F.max("n").alias("most")).first()
    if not head["groups"]:
        return None
    few = head["groups"] <= BROADCAST_GROUPS
    pieces = min(MOST_CUTS, math.ceil(head["most"] / piece))
    at = [k / pieces for k in range(1, pieces)] or [0.5]
    side = lambda df: F.broadcast(df) if few else df
    cut = [F.array_distinct(F.percentile_approx(f"s{k}", at, max(1000, 20 * pieces))).alias(f"c{k}") for k in range(n)]
    return side(durable(once.join(side(big.select("g")), "g").groupBy("g").agg(*cut)))


def score_places(df: DataFrame, group: str, item: str, scores: Sequence[str], piece: int = PIECE) -> DataFrame:
    """(g, i, n_items, places, own, vector) for every distinct (group, item).

    ``places`` has for each score one plus the number of the group's items with a strictly
    higher value. ``own`` is the item's vector, weakest first: structs of the percentile
    1 - (place - 1) / valid values and the place; ``vector`` are its percentiles alone. An
    item that occurs more than once counts once, with its highest value of each score. Null
    and NaN have no place (null), count for nobody and stand as percentile 0. Null groups
    and items take no part. ``piece`` only says how finely large groups are cut.
    """
    number = lambda s: F.when(~F.isnan(F.col(s).cast("double")), F.col(s).cast("double"))
    once = df.where(F.col(group).isNotNull() & F.col(item).isNotNull()).groupBy(F.col(group).alias("g"), F.col(item).alias("i")).agg(
        *[F.max(number(s)).alias(f"s{k}") for k, s in enumerate(scores)]
    )
    n = len(scores)
    cuts = _cuts(once, n, piece)
    none = F.array().cast("array<double>")
    if cuts is not None:
        once = once.join(cuts, "g", "left")
    chunk = lambda v, c: 2 * F.size(F.filter(c, lambda x: x > v)) + F.exists(c, lambda x: x == v).cast("int")
    each = F.array(*[F.struct(F.lit(k).alias("s"), F.col(f"s{k}").alias("v"), (F.lit(0) if cuts is None else F.when(F.col(f"s{k}").isNull(), -1).otherwise(chunk(F.col(f"s{k}"), F.coalesce(f"c{k}", none)))).alias("chunk")) for k in range(n)])
    rows = once.select("g", "i", F.explode(each).alias("x")).select("g", "i", "x.s", "x.v", F.when(F.col("x.v").isNull(), -1).otherwise(F.col("x.chunk")).alias("chunk"))
    # Chunks of nulls (-1) and of single values (odd) hold equal rows, so any part of them gives the same places.
    rows = rows.withColumn("salt", F.when(F.col("chunk") % 2 != 0, salt_of(["i"])).otherwise(0))
    parts = ["g", "s", "chunk"]
    inside = rows.withColumn("inside", F.rank().over(Window.partitionBy(*parts, "salt").orderBy(F.col("v").desc())))
    sizes = rows.groupBy(*parts, "salt").agg(F.count(F.lit(1)).alias("c")).groupBy(*parts).agg(F.sum("c").alias("c"), F.collect_list("salt").alias("salts"))
    by = Window.partitionBy("g", "s")  # at most two rows a cut
    valid = F.when(F.col("chunk") >= 0, F.col("c")).otherwise(0)
    above = F.coalesce(F.sum(valid).over(by.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*parts, "salts", above.alias("above"), F.sum(valid).over(by).alias("valid"), F.sum("c").over(by).alias("n_items"))
    place = F.when(F.col("v").isNotNull(), F.col("above") + F.col("inside"))
    placed = inside.join(sizes.withColumn("salt", F.explode("salts")).drop("salts"), [*parts, "salt"]).select("g", "i", "s", "n_items", place.alias("place"), F.coalesce(1 - (place - 1) / F.col("valid"), F.lit(0.0)).alias("pct"))
    # The explicit exchange sends narrow rows; the wide aggregate then needs no other.
    wide = placed.repartition("g", "i").groupBy("g", "i").agg(F.max("n_items").alias("n_items"), *[F.max(F.when(F.col("s") == k, F.col(c))).alias(f"{c}{k}") for k in range(n) for c in ("place", "pct")])
    own = F.array_sort(F.array(*[F.struct(F.col(f"pct{k}").alias("pct"), F.col(f"place{k}").alias("place")) for k in range(n)]))
    out = wide.select("g", "i", "n_items", F.array(*[F.col(f"place{k}") for k in range(n)]).alias("places"), own.alias("own"))
    return out.withColumn("vector", F.transform("own", lambda x: x["pct"]))


def leximin_best(places: DataFrame, n: int) -> DataFrame:
    """(g, rnk, i, vector): the first ``n`` items of each group in leximin order, ties by smaller item.

    Vectors compare from their weakest score on, so a strong score can't hide a weak one.
    """
    ordered = top_n(places.select("g", "i", "vector"), ["g"], [F.col("vector").desc(), F.col("i")], n, spread=["i"])
    return ordered.select("g", "rnk", "i", "vector")

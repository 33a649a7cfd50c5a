"""Fusing lexical scores with signals; retrieving and collecting are projections of one plan."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.keys import numbered, uniform
from tessera.operators.exact import nearest_places

#: Final weights of the signals.
WEIGHTS = {"geo": 0.1, "facet": 0.1, "microcat": 0.02, "dense": 0.5}
MODES = ("normalized", "raw", "rrf")


@dataclass(frozen=True)
class Fusion:
    """``normalized`` divides the lexical score by the query's highest; ``rrf`` adds 1 / (k + rank), ranks from 0."""

    mode: str = "normalized"
    rrf_k: float = 60.0

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")


def with_extra(lexical: DataFrame, extra: DataFrame) -> DataFrame:
    """(query, doc, lexical) of all scored pairs plus the extra ones they lack, with score 0."""
    fresh = extra.select("query", "doc").distinct().join(lexical.select("query", "doc"), ["query", "doc"], "left_anti")
    return lexical.select("query", "doc", "lexical").unionByName(fresh.withColumn("lexical", F.lit(0.0)))


def total(config: Fusion, weights: dict[str, float]) -> Column:
    whole = Window.partitionBy("query")
    if config.mode == "rrf":
        place = lambda c: F.row_number().over(whole.orderBy(F.col(c).desc(), "doc")) - 1
        out = 1 / (config.rrf_k + place("lexical"))
        return sum((w / (config.rrf_k + place(c)) for c, w in weights.items() if w), out)
    out = F.col("lexical")
    if config.mode == "normalized":
        out = out / F.when(F.col("__top") == 0, 1.0).otherwise(F.col("__top"))
    return sum((w * F.col(c) for c, w in weights.items() if w), out)


def fuse(components: DataFrame, weights: dict[str, float], k: int, config: Fusion = Fusion()) -> DataFrame:
    """The ``k`` best of each query: rnk, the components and their total. A weight of 0 leaves its signal out of the total."""
    # The query's highest lexical score comes from an aggregate, so only the limited rank is a window.
    topped = components.join(components.groupBy("query").agg(F.max("lexical").alias("__top")), "query") if config.mode == "normalized" else components
    summed = topped.withColumn("total", F.round(total(config, weights), 9)).drop("__top")
    order = Window.partitionBy("query").orderBy(F.col("total").desc(), "doc")
    ranked = summed.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= k)
    return ranked.withColumn("rnk", F.col("rnk").cast("bigint"))


def collect(lexical: DataFrame, signals: Sequence, weights: dict[str, float], depth: int, extra: DataFrame | None = None, config: Fusion = Fusion()) -> DataFrame:
    """The ``depth`` best of each query with every component; nothing is cut before the sum."""
    pairs = lexical if extra is None else with_extra(lexical, extra)
    for signal in signals:
        pairs = signal.apply(pairs)
    return fuse(pairs, weights, depth, config)


def retrieve(lexical: DataFrame, signals: Sequence, weights: dict[str, float], k: int, extra: DataFrame | None = None, config: Fusion = Fusion()) -> DataFrame:
    """(query, rnk, doc): the same plan as ``collect``; signals of weight 0 aren't computed."""
    used = [s for s in signals if weights.get(s.name)]
    return collect(lexical, used, weights, k, extra, config).select("query", "rnk", "doc")


def pad_with_nearest(run: DataFrame, queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """``run`` with incomplete answers filled up by the nearest items not in them.

    ``queries`` (query, qlat, qlon) are those to answer; one without a place stays as it is.
    """
    have = queries.join(run.groupBy("query").agg(F.count(F.lit(1)).alias("n")), "query", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    short = have.where((F.col("n") < k) & F.col("qlat").isNotNull() & F.col("qlon").isNotNull())
    near = nearest_places(short.select("query", "qlat", "qlon"), items.where("ilat is not null and ilon is not null"), 2 * k)
    # 2k nearest hold k that the answer, of under k items, doesn't have.
    free = near.join(run.select("query", "doc"), ["query", "doc"], "left_anti").join(short.select("query", "n"), "query")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "doc")) + F.col("n")
    filled = free.withColumn("rnk", place.cast("bigint")).where(F.col("rnk") <= k)
    return run.select("query", "rnk", "doc").unionByName(filled.select("query", "rnk", "doc"))


def descend(components: DataFrame, relevant: DataFrame, start: dict[str, float], grids: dict[str, Sequence[float]], k: int) -> DataFrame:
    """(step, signal, weight, recall, chosen): weights tried one signal after the other, the best kept.

    ``components`` has query, doc, lexical (as it is to be summed) and the signals. A grid is
    one job; only its recalls, as many as it has weights, come to the driver. Of equal ones
    the smallest weight is kept.
    """
    spark = components.sparkSession
    sizes = relevant.groupBy("query").agg(F.count(F.lit(1)).alias("size"))
    n = sizes.count()
    truth = relevant.join(sizes, "query")
    weights, out = dict(start), []
    for step, (signal, grid) in enumerate(grids.items(), 1):
        rest = sum((F.lit(w) * F.col(s) for s, w in weights.items() if s != signal), F.col("lexical"))
        points = F.explode(F.array(*[F.lit(float(w)) for w in grid]))
        each = components.select("query", "doc", rest.alias("rest"), signal).withColumn("w", points).withColumn("total", F.round(F.col("rest") + F.col("w") * F.col(signal), 9))
        top = each.withColumn("rnk", F.row_number().over(Window.partitionBy("w", "query").orderBy(F.col("total").desc(), "doc"))).where(F.col("rnk") <= k)
        found = top.join(truth, ["query", "doc"]).groupBy("w").agg(F.round(F.sum(1 / F.col("size")) / n, 6).alias("recall"))
        recall = {r["w"]: r["recall"] for r in found.collect()}
        recall = {float(w): recall.get(float(w), 0.0) for w in grid}
        weights[signal] = min(recall, key=lambda w: (-recall[w], w))
        out += [(step, signal, w, r, w == weights[signal]) for w, r in recall.items()]
    return spark.createDataFrame(out, "step bigint, signal string, weight double, recall double, chosen boolean")


def random_run(queries: DataFrame, docs: DataFrame, k: int, seed: int) -> DataFrame:
    """(query, rnk, doc): ``k`` docs without replacement for each query, by slots of a numbered order.

    Each query starts at a slot of its own hash and takes every ``step``-th after it, the step
    having no divisor in common with the number of docs, so no query meets every doc.
    """
    n = docs.count()
    step = next(s for s in range(max(1, int(n * 0.618)), n + 2) if math.gcd(s, max(n, 1)) == 1)
    slots = F.explode(F.sequence(F.lit(0), F.lit(min(k, n) - 1))) if n else F.explode(F.array().cast("array<int>"))
    drawn = queries.select("query", F.floor(uniform(F.col("query"), seed) * n).alias("start"), slots.alias("i"))
    placed = drawn.select("query", (F.col("i") + 1).cast("bigint").alias("rnk"), F.pmod(F.col("start") + F.col("i") * step, F.lit(max(n, 1))).cast("bigint").alias("slot"))
    return placed.join(numbered(docs, "doc", seed), "slot").select("query", "rnk", "doc")

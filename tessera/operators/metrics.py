"""Recall, its curve and intervals, ranks of positives and effect sizes."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.keys import uniform


def recall_per_query(run: DataFrame, relevant: DataFrame, k: int | None = 50) -> DataFrame:
    """(query, recall) of every query with a relevant item; one that the run lacks has 0."""
    top = run if k is None else run.where(F.col("rnk") <= k)
    hit = relevant.distinct().join(top.select("query", "doc").distinct().withColumn("hit", F.lit(1)), ["query", "doc"], "left")
    return hit.groupBy("query").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))


def recall_curve(run: DataFrame, relevant: DataFrame, ks: Sequence[int] = (1, 5, 10, 20, 50, 100, 200, 500, 1000)) -> DataFrame:
    """(k, recall): the mean over queries, from one join."""
    best = relevant.distinct().join(run.groupBy("query", "doc").agg(F.min("rnk").alias("rnk")), ["query", "doc"], "left")
    each = best.groupBy("query").agg(*[(F.sum(F.when(F.col("rnk") <= k, 1.0).otherwise(0.0)) / F.count(F.lit(1))).alias(f"k{k}") for k in ks])
    means = each.agg(*[F.avg(f"k{k}").alias(f"k{k}") for k in ks])
    return means.select(F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.col(f"k{k}").alias("recall")) for k in ks])).alias("x")).select("x.k", "x.recall")


def positive_ranks(run: DataFrame, relevant: DataFrame) -> DataFrame:
    """(query, doc, rnk) of each relevant item, -1 where the run lacks it."""
    best = run.groupBy("query", "doc").agg(F.min("rnk").alias("rnk"))
    return relevant.distinct().join(best, ["query", "doc"], "left").select("query", "doc", F.coalesce("rnk", F.lit(-1)).alias("rnk"))


def _below(df: DataFrame, value: str, first: str) -> DataFrame:
    """(v, a, b, a_below, b_below) by distinct value: the rows of either sample with it and with less.

    Values are merged and counted in chunks of their order, so no task ranks all of them.
    Null and NaN count for nothing; the cuts come to the driver once, for all later reads.
    """
    v = F.col(value).cast("double")
    kept = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(v.alias("v")).agg(F.sum(F.when(F.col(first), 1).otherwise(0)).alias("a"), F.sum(F.when(F.col(first), 0).otherwise(1)).alias("b"))
    cuts = kept.agg(F.percentile_approx("v", [i / 64 for i in range(1, 64)], 1000).alias("c")).first()["c"] or []
    chunk = F.size(F.filter(F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]), lambda c: c < F.col("v"))) if cuts else F.lit(0)
    cut = kept.withColumn("chunk", chunk)
    over = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("chunk").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).select("chunk", *[F.coalesce(F.sum(c).over(over), F.lit(0)).alias(f"{c}_before") for c in "ab"])
    inside = Window.partitionBy("chunk").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    counted = cut.select("chunk", "v", "a", "b", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{c}_in") for c in "ab"]).join(F.broadcast(sums), "chunk")  # at most 64 rows
    return counted.select("v", "a", "b", *[(F.col(f"{c}_before") + F.col(f"{c}_in")).alias(f"{c}_below") for c in "ab"])


def cliffs_delta(df: DataFrame, value: str, first: str) -> DataFrame:
    """(first, others, delta) of two samples in one column; ``first`` is a boolean column.

    delta = 2 U / (n1 n2) - 1, ties at half.
    """
    u = F.sum(F.col("a") * (F.col("b_below") + F.col("b") / 2.0))
    return _below(df, value, first).agg(F.sum("a").alias("first"), F.sum("b").alias("others"), (2 * u / F.nullif(F.sum("a") * F.sum("b"), F.lit(0)) - 1).alias("delta"))


def ks_statistic(df: DataFrame, value: str, first: str) -> DataFrame:
    """(ks): the largest distance of the two samples' empirical distributions."""
    counts = _below(df, value, first)
    totals = counts.agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))
    upto = lambda c: (F.col(f"{c}_below") + F.col(c)) / F.nullif(F.col(f"all_{c}"), F.lit(0))
    return counts.crossJoin(F.broadcast(totals)).agg(F.max(F.abs(upto("a") - upto("b"))).alias("ks"))  # one row


def breakdown(df: DataFrame, value: str, hit: str, edges: Sequence[float], least: int = 20) -> DataFrame:
    """(bin, n, share): hit rate in the bins between ``edges``, open at both ends; bins under ``least`` are left out."""
    v = F.col(value)
    which = sum((F.when(v >= float(e), 1).otherwise(0) for e in edges), F.lit(0)).cast("bigint")
    known = df.where(v.isNotNull() & ~F.isnan(v.cast("double")))
    grouped = known.groupBy(which.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(hit).cast("double")).alias("share"))
    return grouped.where(F.col("n") >= least)


def poisson(u: Column) -> Column:
    """How often a row occurs in a resample: the Poisson(1) number of a uniform one, 8 at most."""
    total, term, steps = 0.0, math.exp(-1), []
    for k in range(8):
        total += term / math.factorial(k)
        steps.append(F.when(u >= F.lit(total), 1).otherwise(0))
    return sum(steps[1:], steps[0])


def resampled(values: DataFrame, key: str, value: str, resamples: int, seed: int = 0) -> DataFrame:
    """(resample, mean) of ``value`` over rows weighed by hashed Poisson numbers, a bootstrap without gathering.

    Each (row, resample) draws its weight from the hash of its key, so any engine gives the
    same means. Null and NaN values are left out; an empty resample has no mean.
    """
    rows = values.where(F.col(value).isNotNull() & ~F.isnan(value)).select(F.col(key).cast("string").alias("k"), F.col(value).alias("x"))
    drawn = rows.withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    weight = poisson(uniform(F.concat_ws("|", "resample", "k"), seed))
    return drawn.withColumn("w", weight).groupBy("resample").agg((F.sum(F.col("w") * F.col("x")) / F.nullif(F.sum("w"), F.lit(0))).alias("mean"))


def bootstrap_interval(values: DataFrame, key: str, value: str, resamples: int = 500, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """(mean, low, high): the mean of ``value`` and the percentile interval of its resamples."""
    tail = (1 - confidence) / 2
    means = resampled(values, key, value, resamples, seed).where("mean is not null")
    ends = means.agg(F.percentile("mean", F.lit(tail)).alias("low"), F.percentile("mean", F.lit(1 - tail)).alias("high"))
    whole = values.where(F.col(value).isNotNull() & ~F.isnan(value)).agg(F.avg(value).alias("mean"))
    return whole.crossJoin(ends)  # a row each


def paired_interval(before: DataFrame, after: DataFrame, key: str, value: str, resamples: int = 500, seed: int = 0) -> DataFrame:
    """(delta, low, high) of the mean difference over the keys that both have."""
    both = before.select(key, F.col(value).alias("__b")).join(after.select(key, F.col(value).alias("__a")), key)
    got = bootstrap_interval(both.select(key, (F.col("__a") - F.col("__b")).alias("d")), key, "d", resamples, seed=seed)
    return got.withColumnRenamed("mean", "delta")


def bootstrap_ci(values: Sequence[float], resamples: int = 2000, confidence: float = 0.95, seed: int = 0) -> tuple[float, float, float]:
    """Mean and percentile interval; NaN left out. One number a query comes to the driver."""
    x = np.asarray([v for v in values if v is not None and v == v], float)
    if not len(x):
        return (float("nan"),) * 3
    rng = np.random.default_rng(seed)
    means = np.array([x[rng.integers(0, len(x), len(x))].mean() for _ in range(resamples)])
    tail = (1 - confidence) / 2 * 100
    return float(x.mean()), *(float(q) for q in np.percentile(means, [tail, 100 - tail]))


def paired_bootstrap(before: dict, after: dict, resamples: int = 5000, seed: int = 0) -> tuple[float, float, float]:
    """Mean difference over the keys that both know, with its interval."""
    shared = [k for k in before if k in after and all(v is not None and v == v for v in (before[k], after[k]))]
    return bootstrap_ci([after[k] - before[k] for k in sorted(shared)], resamples, seed=seed)

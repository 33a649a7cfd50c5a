"""The exact best items of every query, by blocks: matrices of a query batch against an item block."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.blocks import block_join
from tessera.operators.spatial import circles_around, great_circle_km
from tessera.session import durable, sampled

WHOLE_GLOBE = 20_038.0  # km, over half the circumference
BLOCK_ROWS = 20_000
BATCH = 512


def best_by_block(queries: DataFrame, items: DataFrame, k: int, prepare: Callable[[pa.Table], np.ndarray], ask: Callable[[pa.RecordBatch], np.ndarray], score: Callable[[np.ndarray, np.ndarray], np.ndarray], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query, rnk, doc, score): the ``k`` items of highest score, ties by smaller doc.

    ``queries`` has query and more columns, ``items`` doc and others, no name shared. Items
    are dealt to blocks of about ``block_rows`` by hash, every query visits every block, and
    a block gives at most k items a query. NaN scores count for nothing.
    """
    n = max(1, math.ceil(items.count() / block_rows))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("doc"), F.lit(n)).cast("bigint"))
    asked = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("block", F.col("block").cast("bigint"))
    kinds = dict(queries.dtypes)["query"], dict(items.dtypes)["doc"]

    def grow(rows: pa.Table) -> tuple:
        rows = rows.sort_by("doc").combine_chunks()
        return rows.column("doc").combine_chunks(), prepare(rows)

    def probe(index: tuple, rows: pa.RecordBatch) -> pa.RecordBatch:
        docs, there = index
        wanted = ask(rows)
        who, where, how = [], [], []
        for at in range(0, len(wanted), BATCH):
            s = np.round(score(wanted[at : at + BATCH], there), 12)
            s = np.where(np.isnan(s), -np.inf, s)
            floor = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] > k else np.full(len(s), -np.inf)
            i, j = np.nonzero((s >= floor[:, None]) & np.isfinite(s))
            order = np.lexsort((j, -s[i, j], i))
            i, j = i[order], j[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            i, j = i[keep], j[keep]
            who.append(i + at)
            where.append(j)
            how.append(s[i, j])
        i, j, v = (np.concatenate(x) for x in (who, where, how))
        return pa.RecordBatch.from_arrays([rows.column("query").take(pa.array(i)), docs.take(pa.array(j)), pa.array(v)], names=["query", "doc", "score"])

    found = block_join(dealt, asked, grow, probe, f"query {kinds[0]}, doc {kinds[1]}, score double", BATCH)
    ranked = found.withColumn("rnk", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "doc"))).where(F.col("rnk") <= k)
    return ranked.select("query", F.col("rnk").cast("bigint").alias("rnk"), "doc", "score")


def _unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def closest_vectors(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """Exact cosine top-k of (query, qv) against (doc, iv); vectors are proper and of one length."""
    return best_by_block(queries, items, k, lambda t: _unit(t.column("iv")), lambda b: _unit(b.column("qv")), lambda q, i: q @ i.T)


def _by_all(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """Every place against every item, by blocks; coordinates count as they are, even off the globe."""
    both = lambda t, a, b: np.stack([np.asarray(t.column(c).to_numpy(zero_copy_only=False) if isinstance(t.column(c), pa.Array) else t.column(c).to_numpy(), float) for c in (a, b)], axis=1)
    score = lambda q, i: -great_circle_km(q[:, 0, None], q[:, 1, None], i[None, :, 0], i[None, :, 1])
    return best_by_block(queries, items, k, lambda t: both(t, "ilat", "ilon"), lambda b: both(b, "qlat", "qlon"), score)


def nearest_places(queries: DataFrame, items: DataFrame, k: int, sample: int = 8_192) -> DataFrame:
    """(query, rnk, doc, score): the exact ``k`` nearest items of (query, qlat, qlon) among (doc, ilat, ilon).

    The score is minus the km, ties go to the smaller doc. Equal places are searched once. A
    circle round each, wide enough by a bounded sample of the items to hold some 3k of them, goes through
    the spatial join; places that got fewer than k have theirs widened, at last to
    the whole globe. The few coordinates off the globe, which that join doesn't take, are
    met one by one.
    """
    place = F.concat_ws(" ", F.col("qlat").cast("string"), F.col("qlon").cast("string"))
    asked = queries.withColumn("place", place)
    places = durable(asked.select(F.col("place").alias("query"), "qlat", "qlon").distinct())
    on_globe = lambda a, b: F.col(a).between(-90.0, 90.0) & F.col(b).between(-180.0, 180.0)
    spots, odd = items.where(on_globe("ilat", "ilon")), items.where(~on_globe("ilat", "ilon"))
    n = spots.count()
    some = sampled(spots.select("ilat", "ilon"), n, sample).toPandas().to_numpy(float)

    def circles(share: float) -> Callable:
        """Adds the distance of the sample point that is to be the last inside."""
        at = math.ceil(share * len(some))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lat, lon = b.column("qlat").to_numpy(), b.column("qlon").to_numpy()
                if at >= len(some):
                    km = np.full(len(lat), WHOLE_GLOBE)
                else:
                    km = np.concatenate([np.partition(great_circle_km(lat[i : i + 256, None], lon[i : i + 256, None], some[:, 0], some[:, 1]), at, axis=1)[:, at] for i in range(0, len(lat), 256)] or [np.zeros(0)])
                yield pa.RecordBatch.from_arrays([b.column("query"), b.column("qlat"), b.column("qlon"), pa.array(km + 1e-9)], names=["query", "qlat", "qlon", "km"])

        return run

    left, found, share = places.where(on_globe("qlat", "qlon")), [], 3.0 * k / max(n, 1) + 3.0 / max(len(some), 1)
    while True:
        around = left.mapInArrow(circles(share), "query string, qlat double, qlon double, km double")
        near = circles_around(spots, around, ("doc", "ilat", "ilon"), ("query", "qlat", "qlon", "km")).select("query", "doc", F.round(-F.col("km"), 12).alias("score"))
        near = durable(near)
        found.append(near)
        if share >= 1:
            break
        full = near.groupBy("query").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
        left = durable(left.join(full, "query", "left_anti"))
        if left.isEmpty():
            break
        share *= 16
    if not odd.isEmpty():
        found.append(_by_all(places, odd, k).select("query", "doc", "score"))
    strange = places.where(~on_globe("qlat", "qlon"))
    if not strange.isEmpty():
        found.append(_by_all(strange, spots, k).select("query", "doc", "score"))
    pairs = reduce(DataFrame.unionAll, found).distinct()  # a widened circle finds again what the narrower one had
    ranked = pairs.withColumn("rnk", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "doc"))).where(F.col("rnk") <= k)
    best = ranked.select(F.col("query").alias("place"), F.col("rnk").cast("bigint").alias("rnk"), "doc", "score")
    return asked.select("query", "place").join(best, "place").select("query", "rnk", "doc", "score")

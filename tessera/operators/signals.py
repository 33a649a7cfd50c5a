"""Side signals of a (query, doc) pair: distance, facets, category and vectors.

A signal takes a table of pairs and adds one column. Curves are smoothed log-likelihood
ratios of two histograms, at most 17 numbers, and live on the driver as literals.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.geo import DISTANCE_EDGES, FACET_EDGES, SMOOTHING, bin_of, curve, haversine, number
from tessera.functions.keys import numbered, uniform
from tessera.functions.text import bare_tokens


class Signal(Protocol):
    name: str

    def apply(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` with one more column, named as the signal."""


def centroids(rows: DataFrame, location: str, lat: str = "item_latitude", lon: str = "item_longitude") -> DataFrame:
    """(location, lat, lon, n): exact medians, NaN left out; null locations have none."""
    known = rows.where(F.col(location).isNotNull())
    return known.groupBy(F.col(location).alias("location")).agg(F.median(number(lat)).alias("lat"), F.median(number(lon)).alias("lon"), F.count(F.lit(1)).alias("n"))


def log_ratio(histogram: DataFrame, bins: int, smoothing: float = SMOOTHING) -> list[float]:
    """ln of the smoothed rates of two histograms, from (side, bin, n); side is 'chosen' or 'random'."""
    counts = {(r["side"], r["bin"]): r["n"] for r in histogram.where("bin is not null").select("side", "bin", "n").collect()}
    total = {s: sum(n for (side, _), n in counts.items() if side == s) + smoothing * bins for s in ("chosen", "random")}
    rate = lambda s, b: (counts.get((s, b), 0) + smoothing) / total[s]
    return [math.log(rate("chosen", b) / rate("random", b)) for b in range(bins)]


def drawn_items(pairs: DataFrame, items: DataFrame, key: str = "pair_id", seed: int = 5) -> DataFrame:
    """``pairs`` joined with an item drawn with replacement for each; ``items`` is keyed by doc."""
    n = items.count()
    return pairs.withColumn("slot", F.floor(uniform(F.col(key), seed) * n).cast("bigint")).join(numbered(items, "doc", 3), "slot").drop("slot")


def geo_histogram(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """(side, bin, n) of distances from the searched place to the chosen and to a random item."""
    centre = centroids(pairs, "search_location_id").select(F.col("location").alias("search_location_id"), "lat", "lon")
    located = pairs.join(centre, "search_location_id").select("pair_id", "lat", "lon", number("item_latitude").alias("clat"), number("item_longitude").alias("clon"))
    places = items.select(F.col("item_id").alias("doc"), number("item_latitude").alias("rlat"), number("item_longitude").alias("rlon"))
    both = drawn_items(located, places)
    far = lambda a, b: bin_of(haversine(F.col("lat"), F.col("lon"), F.col(a), F.col(b)), DISTANCE_EDGES)
    each = both.select(F.explode(F.array(F.struct(F.lit("chosen").alias("side"), far("clat", "clon").alias("bin")), F.struct(F.lit("random").alias("side"), far("rlat", "rlon").alias("bin")))).alias("x"))
    return each.where("x.bin is not null").groupBy("x.side", "x.bin").agg(F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class GeoSignal:
    """An unknown place or item coordinate scores 0; a known one the curve at its distance."""

    queries: DataFrame  # query, qlat, qlon
    items: DataFrame  # doc, ilat, ilon
    scores: Sequence[float]
    name: str = "geo"

    def distance(self, pairs: DataFrame, column: str = "km") -> DataFrame:
        located = pairs.join(self.queries, "query", "left").join(self.items, "doc", "left")
        return located.withColumn(column, haversine(F.col("qlat"), F.col("qlon"), F.col("ilat"), F.col("ilon"))).drop("qlat", "qlon", "ilat", "ilon")

    def apply(self, pairs: DataFrame) -> DataFrame:
        return self.distance(pairs, "__km").withColumn(self.name, curve(bin_of(F.col("__km"), DISTANCE_EDGES), self.scores)).drop("__km")


def query_places(queries: DataFrame, centre: DataFrame) -> DataFrame:
    """(query, qlat, qlon) of (query, location); unknown locations stay null."""
    return queries.join(centre.select("location", F.col("lat").alias("qlat"), F.col("lon").alias("qlon")), "location", "left").select("query", "qlat", "qlon")


def item_places(items: DataFrame) -> DataFrame:
    return items.select(F.col("item_id").alias("doc"), number("item_latitude").alias("ilat"), number("item_longitude").alias("ilon"))


def known_facets(texts: DataFrame, key: str, text: str, items: DataFrame) -> DataFrame:
    """(key, wanted): the distinct filter tokens that some item's params have; rows without any are left out."""
    vocabulary = items.select(F.explode(bare_tokens("item_infm_params_text")).alias("token")).distinct()
    each = texts.select(key, F.explode(bare_tokens(text)).alias("token")).join(vocabulary, "token", "left_semi")
    return each.groupBy(key).agg(F.collect_set("token").alias("wanted"))


def facet_share(wanted: Column, there: Column) -> Column:
    return F.size(F.array_intersect(wanted, there)) / F.size(wanted)


def facet_histogram(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """(side, bin, n) of filter coverage by the chosen and by a random item, for the same filters."""
    wanted = known_facets(pairs, "pair_id", "search_infm_params_text", items)
    held = pairs.select("pair_id", bare_tokens("item_infm_params_text").alias("own")).join(wanted, "pair_id")
    both = drawn_items(held, items.select(F.col("item_id").alias("doc"), bare_tokens("item_infm_params_text").alias("other")))
    bins = lambda c: bin_of(facet_share(F.col("wanted"), F.col(c)), FACET_EDGES)
    each = both.select(F.explode(F.array(F.struct(F.lit("chosen").alias("side"), bins("own").alias("bin")), F.struct(F.lit("random").alias("side"), bins("other").alias("bin")))).alias("x"))
    return each.groupBy("x.side", "x.bin").agg(F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class FacetSignal:
    """A query without known filter tokens scores 0."""

    wanted: DataFrame  # query, wanted
    items: DataFrame  # doc, there
    scores: Sequence[float]
    name: str = "facet"

    def apply(self, pairs: DataFrame) -> DataFrame:
        joined = pairs.join(self.wanted, "query", "left").join(self.items, "doc", "left")
        share = F.when(F.col("wanted").isNotNull(), facet_share(F.col("wanted"), F.coalesce("there", F.array().cast("array<string>"))))
        return joined.withColumn(self.name, curve(bin_of(share, FACET_EDGES), self.scores)).drop("wanted", "there")


@dataclass(frozen=True)
class MicrocatSignal:
    """Log-ratio of (query, class); a class that the classifier doesn't know gets ``penalty``."""

    ratios: DataFrame  # query, class, ratio
    items: DataFrame  # doc, class
    penalty: float
    name: str = "microcat"

    def apply(self, pairs: DataFrame) -> DataFrame:
        return pairs.join(self.items, "doc", "left").join(self.ratios, ["query", "class"], "left").withColumn(self.name, F.coalesce("ratio", F.lit(self.penalty))).drop("class", "ratio")


def dot(a: Column, b: Column) -> Column:
    """Of two array columns of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column) -> Column:
    """A vector as doubles of length one."""
    size = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / size)


def proper(column: str, dims: int) -> Column:
    v = F.col(column)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x))
    return F.coalesce((F.size(v) == dims) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


@dataclass(frozen=True)
class DenseSignal:
    """Cosine of the vectors; a pair without two proper vectors scores 0."""

    queries: DataFrame  # query, qv
    items: DataFrame  # doc, iv
    name: str = "dense"

    def apply(self, pairs: DataFrame) -> DataFrame:
        # Brought to length one before they meet, so that a pair takes one product.
        asked, there = self.queries.withColumn("qv", unit(F.col("qv"))), self.items.withColumn("iv", unit(F.col("iv")))
        joined = pairs.join(asked, "query", "left").join(there, "doc", "left")
        return joined.withColumn(self.name, F.coalesce(dot(F.col("qv"), F.col("iv")), F.lit(0.0))).drop("qv", "iv")


def describe(signals: Sequence[tuple[Signal, float]]) -> str:
    return ", ".join(f"{s.name} x {w:g}" for s, w in signals)

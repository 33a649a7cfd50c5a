"""The retrieval chain over tables that may come from anywhere: index, signals, pool, features, answer."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.geo import DISTANCE_EDGES, FACET_EDGES
from tessera.functions.text import bare_tokens
from tessera.operators import features, fusion, microcat, signals
from tessera.operators.benchmark import LocalBenchmark
from tessera.operators.exact import closest_vectors
from tessera.operators.index import FIELDS, K1, Field, Index, build_index, item_fields
from tessera.operators.packed import known_keys
from tessera.session import durable, together
from tessera.sources.tables import QUERY_FIELDS, load_tables, read_items, read_pairs, read_queries, read_table, read_vectors, save_tables

DENSE_DEPTH = 1000  # nearest vectors of a query that join its lexical hits
RERANK_DEPTH = 200  # candidates of a query that are re-ranked
DIMS = 64
TEXTS = ("item_id", "item_title_raw", "item_description_raw", "item_infm_params_text")


@dataclass(frozen=True)
class Tables:
    """What the chain reads; ``vectors`` are (query_id, query_vector) and (item_id, item_vector), if there are any."""

    pairs: DataFrame
    items: DataFrame
    queries: DataFrame
    query_vectors: DataFrame | None = None
    item_vectors: DataFrame | None = None
    keys: tuple[str, ...] | None = None  # of params; without them the index takes params as they are

    def corpus(self, *columns: str) -> DataFrame:
        """Items, exact repeats counted once."""
        return self.items.select(*columns).where("item_id is not null").distinct()

    def asked(self, with_filter: bool = False) -> DataFrame:
        """(query, text); with the filter behind the words if so wished."""
        text = F.coalesce("search_query", F.lit(""))
        if with_filter:
            text = F.concat_ws(" ", text, F.coalesce("search_infm_params_text", F.lit("")))
        return self.queries.select(F.col("query_id").alias("query"), text.alias("text"))


def open_tables(spark: SparkSession, folder: str, dense: bool = True, parse: bool = False) -> Tables:
    """The tables of a folder; vectors are left out where there are none."""
    found: dict = {}
    if dense:
        try:
            found = {"query_vectors": read_vectors(spark, f"{folder}/query_vectors.parquet", "query_id", "query_vector"), "item_vectors": read_vectors(spark, f"{folder}/item_vectors.parquet", "item_id", "item_vector")}
        except Exception:  # noqa: BLE001 - no vectors, no vector signal
            found = {}
    keys = tuple(known_keys(read_table(spark, f"{folder}/param_keys.parquet"))) if parse else None
    return Tables(read_pairs(spark, folder), read_items(spark, folder), read_queries(spark, folder), **found, keys=keys)


def local_tables(local: LocalBenchmark, pairs: DataFrame, like: Tables) -> Tables:
    """A local benchmark in place of the real tables: only its fit pairs are learnt from."""
    items = local.corpus_items(pairs)
    queries = local.queries.select("query_id", *QUERY_FIELDS)
    return replace(like, pairs=local.fitted(pairs), items=items, queries=queries)


def lexical_index(t: Tables, fields: Sequence[Field] = FIELDS, k1: float = K1, folder: str | None = None, description_chars: int | None = None, address: bool = True) -> Index:
    """The index of the items; with ``folder`` its tables are saved there and read again as long as what went in is the same.

    Weights are never saved, so one saved index serves all of them.
    """
    if folder is None:
        return replace(build_index(item_fields(t.corpus(*TEXTS), keys=t.keys, description_chars=description_chars, address=address), keep=True), fields=tuple(fields), k1=k1)
    settings = {"keys": list(t.keys or ()), "description_chars": description_chars, "address": address, "items": _mark(t.corpus(*TEXTS))}
    spark = t.items.sparkSession
    found = load_tables(spark, folder, settings)
    if found is None:
        made = build_index(item_fields(t.corpus(*TEXTS), keys=t.keys, description_chars=description_chars, address=address))
        save_tables({"postings": made.postings, "lengths": made.lengths, "vocabulary": made.vocabulary}, folder, settings)
        found = load_tables(spark, folder, settings)
    return Index(found["postings"], found["lengths"], found["vocabulary"], tuple(fields), k1)


def _mark(df: DataFrame) -> list:
    """Rows and the sum of their hashes, so that a changed table isn't taken for the one that was saved."""
    return [str(x) for x in df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*df.columns))).first()]


def places(t: Tables) -> DataFrame:
    """(query, qlat, qlon): the centre of the items chosen in the query's location."""
    centre = signals.centroids(t.pairs, "search_location_id")
    return signals.query_places(t.queries.select(F.col("query_id").alias("query"), F.col("search_location_id").alias("location")), centre)


def geo(t: Tables) -> signals.GeoSignal:
    items = t.corpus("item_id", "item_latitude", "item_longitude")
    scores = signals.log_ratio(signals.geo_histogram(t.pairs, items), len(DISTANCE_EDGES) - 1)
    return signals.GeoSignal(places(t), signals.item_places(items), scores)


def facet(t: Tables) -> signals.FacetSignal:
    items = t.corpus("item_id", "item_infm_params_text")
    scores = signals.log_ratio(signals.facet_histogram(t.pairs, items), len(FACET_EDGES) - 1)
    filters = t.queries.select(F.col("query_id").alias("query"), "search_infm_params_text")
    there = items.select(F.col("item_id").alias("doc"), bare_tokens("item_infm_params_text").alias("there"))
    return signals.FacetSignal(signals.known_facets(filters, "query", "search_infm_params_text", items), there, scores)


def labelled(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("pair_id").alias("key"), F.col("search_query").alias("text"), F.col("item_microcat_id").alias("class"))


def category_ratios(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(log-probabilities of the queries, (doc, class) of the items)."""
    model = microcat.fit(labelled(t.pairs))
    items = t.corpus("item_id", "item_microcat_id").select(F.col("item_id").alias("doc"), F.col("item_microcat_id").alias("class"))
    return model.log_proba(t.asked().withColumnRenamed("query", "key")), items


def category(t: Tables) -> signals.MicrocatSignal:
    proba, items = category_ratios(t)
    ratios = durable(microcat.log_ratios(proba, items))
    penalty = ratios.agg(F.percentile("ratio", F.lit(0.05)).alias("p")).first()["p"] or 0.0
    return signals.MicrocatSignal(ratios.withColumnRenamed("key", "query"), items, penalty)


def dense(t: Tables) -> signals.DenseSignal:
    """Vectors by id; of several of one id the least counts."""
    one = lambda df, i, v, a, b: df.where(F.col(i).isNotNull() & signals.proper(v, DIMS)).groupBy(F.col(i).alias(a)).agg(F.min(v).alias(b))
    return signals.DenseSignal(one(t.query_vectors, "query_id", "query_vector", "query", "qv"), one(t.item_vectors, "item_id", "item_vector", "doc", "iv"))


def all_signals(t: Tables, weights: dict[str, float]) -> list:
    """Those of a weight; the vector signal only if there are vectors."""
    make = {"geo": geo, "facet": facet, "microcat": category}
    if t.item_vectors is not None and t.query_vectors is not None:
        make["dense"] = dense
    return together(*[lambda f=f: f(t) for name, f in make.items() if weights.get(name)])


def collected(t: Tables, index: Index, depth: int, weights: dict[str, float] = fusion.WEIGHTS, config: fusion.Fusion = fusion.Fusion(), dense_depth: int = DENSE_DEPTH, with_filter: bool = False) -> DataFrame:
    """The best ``depth`` of each query with their components: every lexical hit and the nearest vectors, all signals, one sum."""
    def near() -> DataFrame | None:
        if not (weights.get("dense") and dense_depth) or t.item_vectors is None or t.query_vectors is None:
            return None
        vectors = dense(t)
        return durable(closest_vectors(vectors.queries, vectors.items, dense_depth).select("query", "doc"))

    by_text = lambda: durable(index.scores(t.asked(with_filter)).select("query", "doc", F.round("score", 9).alias("lexical")))
    lexical, extra, found = together(by_text, near, lambda: all_signals(t, weights))
    return fusion.collect(lexical, found, {s.name: weights[s.name] for s in found}, depth, extra, config)


def feature_rows(t: Tables, index: Index, components: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """The feature table of collected candidates; signals that weren't computed count 0."""
    for name in ("geo", "facet", "microcat", "dense"):
        if name not in components.columns:
            components = components.withColumn(name, F.lit(0.0))
    pairs = t.pairs.select("search_query", "item_id")
    queries = t.queries.select(F.col("query_id").alias("query"), F.col("search_query").alias("text"), F.col("search_infm_params_text").alias("filter"), F.col("search_location_id").alias("location"))
    columns = [c for c in t.items.columns if c not in ("item_description_raw", "item_infm_params_text")]
    context = features.item_context(t.corpus(*columns), pairs, index)
    return features.build_features(components.drop("rnk"), queries, context, places(t), index, pairs, truth)


def feature_settings(t: Tables, fields: Sequence[Field], k1: float, weights: dict[str, float], mode: str, depth: int, dense_depth: int) -> dict:
    """All that decides on a feature table, for the fingerprint of a saved one."""
    return {"fields": [(f.name, f.boost, f.b) for f in fields], "k1": k1, "weights": weights, "mode": mode, "depth": depth, "dense_depth": dense_depth, "queries": _mark(t.queries), "items": _mark(t.corpus(*TEXTS))}


def padded(t: Tables, run: DataFrame, k: int) -> DataFrame:
    """``run`` filled up with the nearest items."""
    return fusion.pad_with_nearest(run, places(t), signals.item_places(t.corpus("item_id", "item_latitude", "item_longitude")), k)


def best(run: DataFrame, score: str, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col(score).desc(), "doc")
    return run.withColumn("rnk", F.row_number().over(order).cast("bigint")).where(F.col("rnk") <= k)


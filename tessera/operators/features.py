"""The feature table of (query, candidate) pairs: 35 columns in a fixed order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.geo import haversine, number
from tessera.functions.text import normalize, word_count
from tessera.operators.index import Index

FEATURES = (
    "lexical lexical_norm lexical_rank geo geo_rank distance_km distance_rank facet microcat dense dense_rank total_rank query_words empty_filter n_candidates "
    "title_cov title_cov_idf desc_cov same_location popularity seen memory twins price price_rank price_to_median rating reviews title_bm25 desc_bm25 title_len has_desc verbatim "
    "phone_hidden msg_forbidden"
).split()
#: What is read of an item.
ITEM_FIELDS = "item_id item_title_raw item_location_id item_price item_rating item_rating_reviews_count item_is_phone_hidden item_is_message_forbidden item_latitude item_longitude".split()
#: Features that tell of the item alone, for ablation.
PRIORS = ("popularity", "seen", "memory", "rating", "reviews", "phone_hidden", "msg_forbidden")


def item_context(items: DataFrame, pairs: DataFrame | None, index: Index) -> DataFrame:
    """One row per item: twins, popularity (clicks over the mean of clicked corpus items) and lengths."""
    titled = items.withColumn("title", normalize("item_title_raw"))
    twins = titled.groupBy("title").agg(F.count(F.lit(1)).alias("twins"))
    length = index.lengths.groupBy("doc").agg(F.sum(F.when(F.col("field") == "title", F.col("len")).otherwise(0)).alias("title_len"), F.sum(F.when(F.col("field") == "description", F.col("len")).otherwise(0)).alias("desc_len"))
    out = titled.join(twins, "title").withColumnRenamed("item_id", "doc").join(length, "doc", "left")
    if pairs is None:
        return out.withColumn("clicks", F.lit(0.0))
    clicks = pairs.groupBy(F.col("item_id").alias("doc")).agg(F.count(F.lit(1)).alias("n")).join(items.select(F.col("item_id").alias("doc")), "doc", "left_semi")
    mean = clicks.agg(F.avg("n").alias("m")).first()["m"] or 1.0
    return out.join(clicks.select("doc", (F.col("n") / mean).alias("clicks")), "doc", "left").withColumn("clicks", F.coalesce("clicks", F.lit(0.0)))


def build_features(components: DataFrame, queries: DataFrame, context: DataFrame, places: DataFrame, index: Index, pairs: DataFrame | None = None, relevant: DataFrame | None = None) -> DataFrame:
    """(query, doc, the 35 features, label).

    ``components`` has query, doc, the five scores and total, ``queries`` query, text,
    filter and location, ``places`` query, qlat, qlon. A query holds at most the collected
    depth, so its windows stay small. An unknown distance is -1 and ranks first, a missing
    price ranks last; price_to_median is null without any price and 0 over a median of 0.
    """
    asked = queries.withColumn("normal", normalize("text"))
    texts = queries.select("query", "text")
    there = index.presences(components, texts, ["title", "description"]).select(
        "query", "doc", F.col("title_coverage").alias("title_cov"), F.col("title_coverage_idf").alias("title_cov_idf"), "title_bm25", F.col("description_coverage").alias("desc_cov"), F.col("description_bm25").alias("desc_bm25")
    )
    rows = components.join(asked, "query")
    if pairs is None:
        rows = rows.withColumn("memory", F.lit(0.0))
    else:
        past = pairs.select(normalize("search_query").alias("normal"), F.col("item_id").alias("doc")).distinct().withColumn("memory", F.lit(1.0))
        rows = rows.join(past, ["normal", "doc"], "left").withColumn("memory", F.coalesce("memory", F.lit(0.0)))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    # What texts and raw fields tell is taken here, so that the joins below move numbers.
    rows = rows.join(context, "doc").select(
        *components.columns, "memory", "twins", "clicks", "title_len", "desc_len", F.contains("title", "normal").cast("double").alias("verbatim"), word_count("text").cast("double").alias("query_words"),
        (F.length(F.coalesce("filter", F.lit(""))) == 0).cast("double").alias("empty_filter"), flag(F.col("item_location_id") == F.col("location")).alias("same_location"), number("item_price").alias("price"),
        number("item_rating").alias("rating"), number("item_rating_reviews_count").alias("reviews"), flag(F.col("item_is_phone_hidden")).alias("phone_hidden"), flag(F.col("item_is_message_forbidden")).alias("msg_forbidden"),
        number("item_latitude").alias("ilat"), number("item_longitude").alias("ilon"),
    )
    rows = rows.join(places, "query", "left").join(there, ["query", "doc"])
    if relevant is not None:
        rows = rows.join(relevant.select("query", "doc").distinct().withColumn("label", F.lit(1)), ["query", "doc"], "left")
    rows = rows.withColumn("label", F.coalesce("label", F.lit(0)).cast("bigint") if relevant is not None else F.lit(0).cast("bigint"))
    km = haversine(F.col("qlat"), F.col("qlon"), F.col("ilat"), F.col("ilon"))
    rows = rows.withColumn("distance_km", F.coalesce(km, F.lit(-1.0)))
    rows = rows.join(rows.groupBy("query").agg(F.median("price").alias("middle"), F.max("lexical").alias("best"), F.count(F.lit(1)).cast("double").alias("n_candidates")), "query")
    by = Window.partitionBy("query")
    down = lambda c: (F.row_number().over(by.orderBy(F.col(c).desc(), "doc")) - 1).cast("double")
    columns = {
        "lexical": F.col("lexical"), "lexical_norm": F.col("lexical") / F.greatest("best", F.lit(1e-9)), "lexical_rank": down("lexical"), "geo": F.col("geo"), "geo_rank": down("geo"),
        "distance_km": F.col("distance_km"), "distance_rank": (F.row_number().over(by.orderBy("distance_km", "doc")) - 1).cast("double"), "facet": F.col("facet"), "microcat": F.col("microcat"),
        "dense": F.col("dense"), "dense_rank": down("dense"), "total_rank": down("total"), "query_words": F.col("query_words"), "empty_filter": F.col("empty_filter"),
        "n_candidates": F.col("n_candidates"), "title_cov": F.col("title_cov"), "title_cov_idf": F.col("title_cov_idf"), "desc_cov": F.col("desc_cov"), "same_location": F.col("same_location"),
        "popularity": F.log1p("clicks"), "seen": (F.col("clicks") > 0).cast("double"), "memory": F.col("memory"), "twins": F.col("twins").cast("double"), "price": F.col("price"),
        "price_rank": (F.row_number().over(by.orderBy(F.col("price").asc_nulls_last(), "doc")) - 1).cast("double"),
        "price_to_median": F.when(F.col("middle") == 0, 0.0).otherwise(F.col("price") / F.nullif("middle", F.lit(0.0))), "rating": F.col("rating"), "reviews": F.col("reviews"),
        "title_bm25": F.col("title_bm25"), "desc_bm25": F.col("desc_bm25"), "title_len": F.coalesce("title_len", F.lit(0)).cast("double"), "has_desc": (F.coalesce("desc_len", F.lit(0)) > 0).cast("double"),
        "verbatim": F.col("verbatim"), "phone_hidden": F.col("phone_hidden"), "msg_forbidden": F.col("msg_forbidden"),
    }
    return rows.select("query", "doc", *[columns[f].alias(f) for f in FEATURES], "label")

"""The queries of the training-data operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.distinctive import term_scores
from tessera.llm.knn import Search, most_similar
from tessera.llm.leakage import leaked, without_leaks
from tessera.llm.leximin import leximin_best, score_places
from tessera.llm.mixing import clean_name, known_targets, leaf_sizes, mix, mix_plan, short_sources, sized_records
from tessera.llm.split import grouped_split, search_key
from tessera.llm.subjects import LISTED, Terms, hash_share, labelled_sample, learn_terms, subject_areas
from tessera.llm.topn import best_items, top_n
from tessera.operators.packed import known_keys, one_per_key, split_values

MOST_AREAS = 10_000
ITEM_TEXTS = ["item_title_raw", "item_description_raw", "item_infm_params_text"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _searches(spark: SparkSession, folder: str, *carry: str) -> DataFrame:
    keys = known_keys(table(spark, folder, "param_keys"))
    pairs = table(spark, folder, "train").select("pair_id", "search_query", "search_location_id", "search_infm_params_text", *carry)
    return search_key(pairs, "search_query", "search_location_id", "search_infm_params_text", keys).select("pair_id", "k1", "k2", *carry)


def _split(spark: SparkSession, folder: str) -> DataFrame:
    return grouped_split(_searches(spark, folder, "item_category_id"), "pair_id", [["k1", "k2"]], "item_category_id")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of train that were put into a split together with others of their search, and the group's least pair_id."""
    return _split(spark, folder).where("n_rows > 1 and split is not null").select("pair_id", F.col("component").alias("group_id"))


def p2_split(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and searches of the splits by item category, every search whole in one split."""
    each = _split(spark, folder).groupBy("component", "split", "item_category_id").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("split", "item_category_id").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("searches"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Terms that mark out an item: in at most four items, a positive share of the divergence, at least three times in its texts."""
    scored = term_scores(table(spark, folder, "benchmark_items"), "item_id", ITEM_TEXTS, least_df=1, most_df=4)
    return scored.where("score > 0 and tf >= 3").select("item_id", "term")


def p4_top_terms(spark: SparkSession, folder: str) -> DataFrame:
    """The five most distinctive terms of each item among those that at least two items share."""
    scored = term_scores(table(spark, folder, "benchmark_items"), "item_id", ITEM_TEXTS, least_df=2).withColumn("score", F.round("score", 9))
    return top_n(scored, ["item_id"], [F.col("score").desc(), F.col("term")], 5, spread=["term"]).select("item_id", "rnk", "term", "score")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best candidates of each query by their highest total."""
    return best_items(table(spark, folder, "candidates"), "query_id", "item_id", "total", 10).select("query_id", "rnk", "item_id")


SCORES = ["lexical", "geo", "facet", "microcat", "dense"]


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Items among the best three of their query in at least four of the five scores, in queries of ten items or more."""
    placed = score_places(table(spark, folder, "candidates"), "query_id", "item_id", SCORES)
    good = F.size(F.filter("own", lambda x: x["place"] <= 3)) >= 4
    return placed.where((F.col("n_items") >= 10) & good).select(F.col("g").alias("query_id"), F.col("i").alias("item_id"))


def p6_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """The first ten candidates of each query in leximin order, with their weakest percentile."""
    placed = score_places(table(spark, folder, "candidates"), "query_id", "item_id", SCORES)
    best = leximin_best(placed.withColumn("vector", F.transform("vector", lambda x: F.round(x, 9))), 10)
    return best.select(F.col("g").alias("query_id"), "rnk", F.col("i").alias("item_id"), F.element_at("vector", 1).alias("weakest"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The five items of highest cosine for every query vector."""
    near = most_similar(table(spark, folder, "query_vectors"), table(spark, folder, "item_vectors"), ("query_id", "query_vector"), ("item_id", "item_vector"), 5, Search(64))
    return near.select("query_id", "item_id")


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaked(table(spark, folder, "documents"), table(spark, folder, "eval_passages"), ("doc_id", "text"), ("eval_id", "passage"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold at least twelve consecutive words of an evaluation passage."""
    return _leaks(spark, folder).select("doc_id", "eval_id").distinct()


def p8_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of the leaking documents when the leaked runs are cut out."""
    cleaned = without_leaks(table(spark, folder, "documents"), _leaks(spark, folder), ("doc_id", "text"))
    return cleaned.select("doc_id", "n_words", "leaked_words", "dropped", F.length("clean").cast("bigint").alias("clean_chars"))


def _sized(spark: SparkSession, folder: str, sources: list[str]) -> DataFrame:
    """Documents with tokens under language and source; these tables name no domain above them."""
    path = [F.coalesce(F.substring_index(clean_name("lang"), "-", 1), F.lit("und")), clean_name("source")]
    return sized_records(table(spark, folder, "documents"), "doc_id", "text", path, sources)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources too small for their target share even at their most repeats."""
    targets = known_targets(table(spark, folder, "mix_targets"))
    plan = mix_plan(leaf_sizes(_sized(spark, folder, list(targets))), targets)
    return spark.createDataFrame([(s,) for s in short_sources(plan, targets)], "source string")


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual shares of the mixed sources, from the records really selected."""
    targets = known_targets(table(spark, folder, "mix_targets"))
    plan, chosen = mix(_sized(spark, folder, list(targets)), targets, "doc_id")
    leaves = F.broadcast(spark.createDataFrame([(i, p["path"][-1]) for i, p in enumerate(plan)], "leaf int, source string"))
    mixed = chosen.join(leaves, "leaf").groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    aims = spark.createDataFrame([(s, *t) for s, t in targets.items()], "source string, target_share double, max_repeats double")
    whole = Window.partitionBy(F.lit(1))  # a row per source
    return aims.join(mixed, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.round(F.coalesce("tokens", F.lit(0)) / F.sum("tokens").over(whole), 9).alias("actual_share"))


def _listing_sample(spark: SparkSession, folder: str, most: int) -> list[tuple[str, list]]:
    """About ``most`` listings as labelled texts: a value of their params is what subject_areas says an area is about."""
    items = table(spark, folder, "benchmark_items").where("item_id is not null and item_infm_params_text is not null")
    some = one_per_key(items.where(hash_share("item_id", items.count(), most)), "item_id", ITEM_TEXTS)
    text = some.select("item_id", F.concat_ws("\n", "item_title_raw", "item_description_raw").alias("text"), "item_infm_params_text")
    about = [(r[0], r[1]) for r in table(spark, folder, "subject_areas").where("about is not null and subject_id is not null").select("about", "subject_id").distinct().limit(MOST_AREAS + 1).collect()]
    if len(about) > MOST_AREAS:
        raise ValueError(f"more than {MOST_AREAS} areas")
    areas = spark.createDataFrame(about, "val string, subject_id bigint")
    values = split_values(text, "item_infm_params_text", known_keys(table(spark, folder, "param_keys")), ["item_id", "text"])
    named = values.join(F.broadcast(areas), "val").groupBy("item_id").agg(F.min("text").alias("text"), F.collect_set("subject_id").alias("own"))
    return [(r["text"], r["own"]) for r in sorted(named.where(F.size("own") == 1).collect(), key=lambda r: r["item_id"])]


def _subject_terms(spark: SparkSession, folder: str) -> Terms:
    """Learned from about ``LABELLED`` labelled documents and about ``LISTED`` listings that name their area."""
    labelled = labelled_sample(table(spark, folder, "documents"), table(spark, folder, "subject_labels"), ("doc_id", "text"), "subject_id")
    return learn_terms(labelled + _listing_sample(spark, folder, LISTED))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """The areas that each document's text deals with."""
    return subject_areas(table(spark, folder, "documents"), _subject_terms(spark, folder), ("doc_id", "text")).select("doc_id", "subject_id")


def p10_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and characters by area; a document of several areas counts in each."""
    docs = table(spark, folder, "documents")
    found = subject_areas(docs, _subject_terms(spark, folder), ("doc_id", "text"))
    return found.join(docs.select("doc_id", "n_chars"), "doc_id").groupBy("subject_id").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"))


QUERIES = [p2_found, p2_split, p4_found, p4_top_terms, p5_found, p6_found, p6_ranking, p7_found, p8_found, p8_cleaned, p9_found, p9_mix, p10_found, p10_composition]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    from tessera.llm import oracle

    return oracle.SQL

"""Exploratory reports over pairs, queries and the corpus; each is one small DataFrame."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.geo import haversine, number
from tessera.functions.keys import QUERY_COLUMNS, composite_key
from tessera.functions.text import bare_tokens, coverage, lowered, normalize, tokens, truncate, word_count
from tessera.operators.metrics import cliffs_delta, ks_statistic
from tessera.operators.signals import centroids
from tessera.session import durable

#: Where descriptions are cut, and the distances in km, of the reports.
CUT_CHARS = (0, 100, 200, 300, 500, 1000, 100_000)
WITHIN_KM = (1, 5, 10, 25, 50, 100, 250, 500, 1000)


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _shares(cover: Column) -> list[Column]:
    return [
        F.avg((cover == 0).cast("double")).alias("none"),
        F.avg(((cover > 0) & (cover < 1)).cast("double")).alias("partial"),
        F.avg((cover == 1).cast("double")).alias("whole"),
        F.avg(cover).alias("mean"),
    ]


def query_item_counts(pairs: DataFrame) -> DataFrame:
    """(queries, mean, median, most, one, two, three): pairs per distinct query and shares of small counts."""
    per = pairs.groupBy(composite_key().alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("queries"), F.avg("n").alias("mean"), F.median("n").alias("median"), F.max("n").alias("most"), *[F.avg((F.col("n") == i).cast("double")).alias(name) for i, name in ((1, "one"), (2, "two"), (3, "three"))])


def overlap(pairs: DataFrame) -> DataFrame:
    """(fields, none, partial, whole, mean): how much of the query's words the chosen item's fields hold."""
    title = _text("item_title_raw")
    params = F.concat_ws(" ", title, _text("item_infm_params_text"))
    parts = {"title": title, "title+params": params, "title+params+description": F.concat_ws(" ", params, _text("item_description_raw"))}
    wanted = pairs.select(tokens("search_query").alias("q"), *[tokens(c).alias(f"f{i}") for i, c in enumerate(parts.values())])
    each = wanted.select(F.explode(F.array(*[F.struct(F.lit(n).alias("fields"), coverage(F.col("q"), F.col(f"f{i}")).alias("c")) for i, n in enumerate(parts)])).alias("x"))
    return each.groupBy("x.fields").agg(*_shares(F.col("x.c")))


def truncation(pairs: DataFrame, limits: Sequence[int] = CUT_CHARS) -> DataFrame:
    """(chars, none, whole, mean): the same with the description cut at several lengths.

    Everything is tokenised once. A description's other characters become blanks one for
    one, so what a cut leaves of it is a prefix, in which the query's words that the title
    and the params lack are looked up between blanks.
    """
    head = F.concat_ws(" ", _text("item_title_raw"), _text("item_infm_params_text"))
    wanted = pairs.select(F.array_distinct(tokens("search_query")).alias("q"), tokens(head).alias("h"), _text("item_description_raw").alias("d"))
    rows = wanted.select(F.size("q").alias("n"), F.array_except("q", "h").alias("rest"), "d", F.regexp_replace(lowered("d"), "[^0-9a-zа-я]", " ").alias("flat"))
    exact = F.length("flat") == F.length("d")  # a few letters change their length in lower case

    def left(chars: int) -> Column:
        kept = truncate("d", chars)
        prefix = F.concat(F.lit(" "), F.when(exact, F.substring("flat", F.lit(1), F.length(kept))).otherwise(F.regexp_replace(lowered(kept), "[^0-9a-zа-я]", " ")), F.lit(" "))
        lost = F.filter("rest", lambda w: ~F.contains(prefix, F.concat(F.lit(" "), w, F.lit(" "))))
        return (F.col("n") - F.size(lost)) / F.nullif(F.col("n"), F.lit(0))

    each = rows.select(F.explode(F.array(*[F.struct(F.lit(n).cast("bigint").alias("chars"), left(n).alias("c")) for n in limits])).alias("x"))
    return each.groupBy("x.chars").agg(*_shares(F.col("x.c"))).drop("partial")


def pair_distance(pairs: DataFrame, centre: DataFrame) -> DataFrame:
    """``pairs`` plus km from the searched location's centre; null if either is unknown."""
    at = centre.select(F.col("location").alias("search_location_id"), "lat", "lon")
    return pairs.join(at, "search_location_id", "left").withColumn("km", haversine(F.col("lat"), F.col("lon"), number("item_latitude"), number("item_longitude"))).drop("lat", "lon")


def distance(pairs: DataFrame, centre: DataFrame, thresholds: Sequence[float] = WITHIN_KM) -> DataFrame:
    """(km, share): how many of the pairs with a distance lie within each threshold."""
    known = pair_distance(pairs, centre).where("km is not null")
    shares = known.agg(*[F.avg((F.col("km") <= t).cast("double")).alias(f"t{i}") for i, t in enumerate(thresholds)])
    return shares.select(F.explode(F.array(*[F.struct(F.lit(float(t)).alias("km"), F.col(f"t{i}").alias("share")) for i, t in enumerate(thresholds)])).alias("x")).select("x.*")


def location_match(pairs: DataFrame) -> DataFrame:
    """(same, median, p90): equal ids, and distinct item locations of a searched one."""
    same = pairs.agg(F.avg((F.col("search_location_id") == F.col("item_location_id")).cast("double")).alias("same"))
    per = pairs.where("search_location_id is not null").groupBy("search_location_id").agg(F.count_distinct("item_location_id").alias("n"))
    spread = per.agg(F.percentile("n", F.lit(0.5)).alias("median"), F.percentile("n", F.lit(0.9)).alias("p90"))
    return same.crossJoin(spread)  # a row each


def facets(pairs: DataFrame) -> DataFrame:
    """(filtered, share, mean, whole, none, verbatim): how far the chosen item's params cover the filter."""
    filtered = F.length(_text("search_infm_params_text")) > 0
    a, b = bare_tokens("search_infm_params_text"), bare_tokens("item_infm_params_text")
    cover = F.when(filtered, coverage(a, b))
    verbatim = F.when(filtered, (normalize("item_infm_params_text").contains(normalize("search_infm_params_text")) & (F.size(a) > 0)).cast("double"))
    rows = pairs.select(filtered.alias("f"), cover.alias("c"), verbatim.alias("v"))
    return rows.agg(
        F.sum(F.col("f").cast("bigint")).alias("filtered"), F.avg(F.col("f").cast("double")).alias("share"), F.avg("c").alias("mean"), F.avg((F.col("c") == 1).cast("double")).alias("whole"),
        F.avg((F.col("c") == 0).cast("double")).alias("none"), F.avg("v").alias("verbatim"),
    )


def microcat_concentration(pairs: DataFrame, least: int = 3) -> DataFrame:
    """(queries, top_mean, top_median, entropy, single) over query texts of ``least`` pairs or more."""
    counts = pairs.groupBy(_text("search_query").alias("q"), "item_microcat_id").agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("q"))
    shares = counts.withColumn("all", F.sum("n").over(Window.partitionBy("q"))).withColumn("p", p).where(F.col("all") >= least)
    per = shares.groupBy("q").agg(F.max("p").alias("top"), F.sum(-F.col("p") * F.log2("p")).alias("h"))
    return per.agg(F.count(F.lit(1)).alias("queries"), F.avg("top").alias("top_mean"), F.median("top").alias("top_median"), F.avg("h").alias("entropy"), F.avg((F.col("top") == 1).cast("double")).alias("single"))


def selection_bias(pairs: DataFrame, items: DataFrame, columns: Sequence[str] = ("item_rating", "item_rating_reviews_count", "item_price")) -> DataFrame:
    """(feature, chosen, pool, delta): medians of chosen items and of the corpus, and Cliff's delta."""
    out = None
    for c in columns:
        both = pairs.select(number(c).alias("v"), F.lit(True).alias("chosen")).unionAll(items.select(number(c), F.lit(False)))
        medians = both.agg(F.median(F.when(F.col("chosen"), F.col("v"))).alias("chosen"), F.median(F.when(~F.col("chosen"), F.col("v"))).alias("pool"))
        part = medians.crossJoin(cliffs_delta(both, "v", "chosen").select("delta")).select(F.lit(c).alias("feature"), "chosen", "pool", "delta")  # a row each
        out = part if out is None else out.unionAll(part)
    return out


def shift(pairs: DataFrame, queries: DataFrame) -> DataFrame:
    """(words_train, words_bench, ks, empty_train, empty_bench, delivery_train, delivery_bench) over distinct queries of the log."""
    cols = list(QUERY_COLUMNS)
    both = pairs.select(*cols).distinct().withColumn("train", F.lit(True)).unionAll(queries.select(*cols).withColumn("train", F.lit(False)))
    rows = both.select("train", word_count("search_query").alias("words"), (F.length(_text("search_infm_params_text")) == 0).cast("double").alias("empty"), F.col("search_is_delivery_search").cast("double").alias("delivery"))
    mean = lambda c, side: F.avg(F.when(F.col("train") == side, F.col(c)))
    means = rows.agg(*[mean(c, side).alias(f"{c}_{name}") for c in ("words", "empty", "delivery") for side, name in ((True, "train"), (False, "bench"))])
    return means.crossJoin(ks_statistic(rows, "words", "train"))  # a row each


def duplicates(items: DataFrame) -> DataFrame:
    """(titles, items, repeated, most, by_title, by_location, by_microcat): repeated titles and what identifies an item."""
    rows = items.select(normalize("item_title_raw").alias("t"), "item_location_id", "item_microcat_id")
    n = rows.groupBy("t", "item_location_id", "item_microcat_id").agg(F.count(F.lit(1)).alias("n"))
    by_title = n.groupBy("t").agg(F.sum("n").alias("n"))
    titles = by_title.agg(F.count(F.lit(1)).alias("titles"), F.sum("n").alias("items"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("again"), F.max(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("most"), F.sum((F.col("n") == 1).cast("bigint")).alias("one"))
    two = n.groupBy("t", "item_location_id").agg(F.sum("n").alias("n")).agg(F.sum((F.col("n") == 1).cast("bigint")).alias("two"))
    three = n.agg(F.sum((F.col("n") == 1).cast("bigint")).alias("three"))
    row = titles.crossJoin(two).crossJoin(three)  # a row each
    return row.select("titles", "items", (F.col("again") / F.col("items")).alias("repeated"), "most", *[(F.col(a) / F.col("items")).alias(b) for a, b in (("one", "by_title"), ("two", "by_location"), ("three", "by_microcat"))])


def radius_counts(queries: DataFrame, items: DataFrame, centre: DataFrame, km: float = 25.0) -> DataFrame:
    """(query, n): items within ``km`` of the query's place, 0 for none or no place; each place is searched once."""
    from tessera.operators.spatial import points_near

    asked = queries.join(centre.select("location", "lat", "lon"), "location", "left")
    places = asked.select("location", "lat", "lon").where("lat is not null and lon is not null").distinct()
    near = points_near(items.select("item_id", F.col("item_latitude").alias("y"), F.col("item_longitude").alias("x")), places, ("item_id", "y", "x"), ("location", "lat", "lon"), km)
    counts = near.groupBy("location").agg(F.count(F.lit(1)).alias("n"))
    return asked.join(counts, "location", "left").select("query", F.coalesce("n", F.lit(0)).alias("n"))


FILTERS = {"geo": ("geo",), "facet": ("facet",), "microcat": ("microcat",), "geo+facet": ("geo", "facet"), "all": ("geo", "facet", "microcat")}


def surviving(items: DataFrame, queries: DataFrame, centre: DataFrame, predicted: DataFrame, km: float = 25.0) -> DataFrame:
    """(query, filter, n): what each filter of ``FILTERS`` leaves of the corpus for each query.

    ``items`` has item_id, item_latitude, item_longitude, item_infm_params_text and
    item_microcat_id, ``queries`` query, location and search_infm_params_text, ``predicted``
    the (query, class) that the category filter lets through. Distances come from one search a place, facets
    join on tokens and count, and a category's size is a number, so no query meets every item.
    A query without a known filter token passes everything by facet.
    """
    from tessera.operators.spatial import points_near

    asked = queries.join(centre.select("location", "lat", "lon"), "location", "left").withColumn("wanted", bare_tokens("search_infm_params_text"))
    spots = items.select("item_id", F.col("item_latitude").alias("y"), F.col("item_longitude").alias("x"))
    places = asked.select("location", "lat", "lon").where("lat is not null and lon is not null").distinct()
    near = durable(points_near(spots, places, ("item_id", "y", "x"), ("location", "lat", "lon"), km).select("location", "item_id"))
    # Of filter tokens only those that some item has are asked for.
    tokens_of = items.select("item_id", F.explode(bare_tokens("item_infm_params_text")).alias("token"))
    known = asked.select("query", F.explode("wanted").alias("token")).join(tokens_of.select("token").distinct(), "token", "left_semi")
    need = known.groupBy("query").agg(F.count(F.lit(1)).alias("need"))
    whole = durable(_all_tokens(known, tokens_of, need).select("query", "item_id"))
    kind = items.select("item_id", F.col("item_microcat_id").alias("class"))
    of_class = predicted.select("query", "class").distinct()
    pairs_geo = asked.select("query", "location").join(near, "location").select("query", "item_id")
    both = whole.join(asked.select("query", "location"), "query").join(near, ["location", "item_id"], "left_semi").select("query", "item_id")
    in_class = lambda pairs: pairs.join(kind, "item_id").join(of_class, ["query", "class"], "left_semi")
    count = lambda df, name: df.groupBy("query").agg(F.count(F.lit(1)).alias(name))
    by_place = near.groupBy("location").agg(F.count(F.lit(1)).alias("geo"))
    sizes = kind.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    parts = [need, count(whole, "facet"), count(both, "both"), of_class.join(sizes, "class").groupBy("query").agg(F.sum("n").alias("microcat")), count(in_class(pairs_geo), "geo_class"), count(in_class(both), "both_class")]
    rows = asked.select("query", "location").join(by_place, "location", "left")
    for part in parts:
        rows = rows.join(part, "query", "left")
    n = items.count()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    free = F.col("need").isNull()
    sizes = {"geo": zero("geo"), "facet": F.when(free, F.lit(n)).otherwise(zero("facet")), "microcat": zero("microcat"), "geo+facet": F.when(free, zero("geo")).otherwise(zero("both")), "all": F.when(free, zero("geo_class")).otherwise(zero("both_class"))}
    return rows.select("query", F.explode(F.array(*[F.struct(F.lit(f).alias("filter"), c.cast("bigint").alias("n")) for f, c in sizes.items()])).alias("x")).select("query", "x.filter", "x.n")


def _all_tokens(known: DataFrame, tokens_of: DataFrame, need: DataFrame) -> DataFrame:
    """(query, item_id) of the items that have all the known tokens of the query.

    Each query probes by its rarest token only and checks the others on the items found, so
    a token that most items have multiplies nothing unless it is a query's only one; then
    it is dealt to parts by item.
    """
    df = tokens_of.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    ranked = known.join(df, "token").groupBy("query").agg(F.min(F.struct("df", "token")).alias("rare"), F.sort_array(F.collect_set("token")).alias("wanted"))
    parts = F.ceil(F.col("rare.df") / 20_000).cast("int")
    asked = ranked.select("query", F.col("rare.token").alias("token"), "wanted", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    held = tokens_of.groupBy("item_id").agg(F.collect_set("token").alias("there"))
    used = asked.select("token").distinct().join(df, "token").select("token", F.ceil(F.col("df") / 20_000).cast("int").alias("parts"))
    probe = tokens_of.join(used, "token").select("token", "item_id", F.pmod(F.xxhash64("item_id"), "parts").cast("int").alias("part"))
    found = asked.join(probe, ["token", "part"]).select("query", "item_id", "wanted").join(held, "item_id")
    return found.where(F.size(F.array_except("wanted", "there")) == 0)


def filter_ceiling(pairs: DataFrame, items: DataFrame, queries: DataFrame, classes: DataFrame, predicted: DataFrame, km: float = 25.0) -> DataFrame:
    """(filter, ceiling, median, p90): none at all, the five of ``FILTERS``.

    The ceiling is the share of pairs whose item passes, the other two count what is left of
    the corpus for a query. ``classes`` has the (text, class) that the category filter lets
    through for each search text of ``pairs``, ``predicted`` those of each query.
    """
    centre = centroids(pairs, "search_location_id")
    a, b = bare_tokens("search_infm_params_text"), bare_tokens("item_infm_params_text")
    allowed = classes.groupBy("text").agg(F.collect_set("class").alias("classes"))
    held = pair_distance(pairs, centre).withColumn("text", normalize("search_query")).join(allowed, "text", "left")
    passes = {"geo": F.coalesce(F.col("km"), F.lit(1e9)) <= km, "facet": F.size(F.array_except(a, b)) == 0, "microcat": F.coalesce(F.array_contains("classes", F.col("item_microcat_id")), F.lit(False))}
    held = held.select(*[c.alias(f) for f, c in passes.items()])
    ceiling = held.agg(*[F.avg(reduce(and_, [F.col(p) for p in parts]).cast("double")).alias(f"c{i}") for i, parts in enumerate(FILTERS.values())])
    ceiling = ceiling.select(F.explode(F.array(*[F.struct(F.lit(f).alias("filter"), F.col(f"c{i}").alias("ceiling")) for i, f in enumerate(FILTERS)])).alias("x")).select("x.*")
    left = surviving(items, queries, centre, predicted, km).groupBy("filter").agg(F.percentile("n", F.lit(0.5)).alias("median"), F.percentile("n", F.lit(0.9)).alias("p90"))
    n = float(items.count())
    none = pairs.sparkSession.createDataFrame([("none", 1.0, n, n)], "filter string, ceiling double, median double, p90 double")
    return none.unionAll(ceiling.join(left, "filter").select("filter", "ceiling", "median", "p90"))


def within_limits(left: DataFrame, limits: Sequence[int] = (50, 200, 1000)) -> DataFrame:
    """(most, share): how many queries have at most so many candidates left after all filters; ``left`` is that of ``surviving``."""
    shares = left.where("filter = 'all'").agg(*[F.avg((F.col("n") <= k).cast("double")).alias(f"k{k}") for k in limits])
    return shares.select(F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("most"), F.col(f"k{k}").alias("share")) for k in limits])).alias("x")).select("x.*")


@dataclass(frozen=True)
class Side:
    """One of the benchmarks that are compared."""

    queries: DataFrame
    items: DataFrame
    truth: DataFrame  # query_id, item_id
    pairs: DataFrame  # what may be learnt from, with item_id


def _sizes(side: Side, centre: DataFrame) -> DataFrame:
    """One row of the ten numbers."""
    asked = side.queries.select("query_id", "search_location_id", word_count("search_query").alias("words"), (F.length(_text("search_infm_params_text")) == 0).cast("double").alias("empty"))
    queries = asked.agg(F.count(F.lit(1)).cast("double").alias("queries"), F.avg(F.col("words").cast("double")).alias("words"), F.avg("empty").alias("empty_filters"))
    seen = side.items.select("item_id").distinct().join(side.pairs.select("item_id").distinct().withColumn("s", F.lit(1)), "item_id", "left").agg((F.count("s") / F.count(F.lit(1))).alias("seen_share"))
    items = side.items.agg(F.count(F.lit(1)).cast("double").alias("items"), F.count_distinct("item_location_id").cast("double").alias("locations"), F.count_distinct("item_microcat_id").cast("double").alias("categories"))
    near = radius_counts(asked.select(F.col("query_id").alias("query"), F.col("search_location_id").alias("location")), side.items, centre).agg(F.median("n").alias("density"))
    per = side.truth.distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    positives = per.agg(F.avg("n").alias("positives"), F.avg((F.col("n") == 1).cast("double")).alias("single"))
    row = queries
    for part in (seen, items, near, positives):
        row = row.crossJoin(part)  # a row each
    return row


COMPARED = ("queries", "items", "words", "empty_filters", "seen_share", "density", "locations", "categories", "positives", "single")


def compare(sides: dict[str, Side], centre: DataFrame) -> DataFrame:
    """(quantity, a column for each side): ten numbers by which a built benchmark is held against the real one."""
    out = None
    for name, side in sides.items():
        part = _sizes(side, centre).select(F.explode(F.array(*[F.struct(F.lit(q).alias("quantity"), F.col(q).alias(name)) for q in COMPARED])).alias("x")).select("x.*")
        out = part if out is None else out.join(part, "quantity")
    return out

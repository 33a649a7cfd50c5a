"""Queries of the reports and of benchmark construction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.geo import number
from tessera.functions.keys import QUERY_COLUMNS
from tessera.functions.text import normalize
from tessera.operators import benchmark, microcat, reports, signals
from tessera.plans import chain, sql
from tessera.plans.retrieval import CENTRE, relevant
from tessera.session import durable
from tessera.sources.tables import corpus, read_pairs, read_queries

SEEN = 0.3
DONORS = 40_000 / 2_452  # budget of donor queries for each query of the benchmark


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _pairs(spark, folder, description=False):
    return read_pairs(spark, folder, description=description)


def _centre(spark, folder):
    return signals.centroids(read_pairs(spark, folder, ["search_location_id", "item_latitude", "item_longitude"]), "search_location_id")


def _queries(spark, folder):
    return read_queries(spark, folder).select(F.col("query_id").alias("query"), F.col("search_location_id").alias("location"), "search_infm_params_text")


def query_item_counts(spark, folder):
    return rounded(reports.query_item_counts(_pairs(spark, folder)))


def overlap_report(spark, folder):
    return rounded(reports.overlap(_pairs(spark, folder, True)))


def truncation_report(spark, folder):
    return rounded(reports.truncation(_pairs(spark, folder, True)))


def distance_report(spark, folder):
    return rounded(reports.distance(_pairs(spark, folder), _centre(spark, folder)))


def location_match(spark, folder):
    return rounded(reports.location_match(_pairs(spark, folder)))


def facet_report(spark, folder):
    return rounded(reports.facets(_pairs(spark, folder)))


def microcat_concentration(spark, folder):
    return rounded(reports.microcat_concentration(_pairs(spark, folder)))


def selection_bias(spark, folder):
    return rounded(reports.selection_bias(_pairs(spark, folder), corpus(spark, folder, ["item_id", "item_rating", "item_rating_reviews_count", "item_price"])))


def shift_report(spark, folder):
    return rounded(reports.shift(_pairs(spark, folder), read_queries(spark, folder)))


def duplicate_report(spark, folder):
    return rounded(reports.duplicates(corpus(spark, folder, ["item_id", "item_title_raw", "item_location_id", "item_microcat_id"])))


def radius_count(spark, folder):
    got = reports.radius_counts(_queries(spark, folder), corpus(spark, folder, ["item_id", "item_latitude", "item_longitude"]), _centre(spark, folder))
    return got.select(F.col("query").alias("query_id"), "n")


def corpus_density(spark, folder):
    return radius_count(spark, folder).agg(F.median("n").alias("median"))


_FILTERED = ["item_id", "item_latitude", "item_longitude", "item_infm_params_text", "item_microcat_id"]
TOP_CLASSES = 3


def _likeliest_classes(spark, folder):
    """(text, class) of the categories that the filter lets through, for all search texts of the log and of the queries."""
    pairs = read_pairs(spark, folder, ["pair_id", "search_query", "item_microcat_id"])
    model = microcat.fit(chain.labelled(pairs))
    texts = pairs.select(normalize("search_query").alias("text")).unionAll(read_queries(spark, folder, ["search_query"]).select(normalize("search_query"))).distinct()
    return durable(microcat.top_classes(model, texts.select(F.col("text").alias("key"), "text"), TOP_CLASSES).select(F.col("key").alias("text"), "class"))


def _of_queries(spark, folder, classes):
    texts = read_queries(spark, folder, ["query_id", "search_query"]).select(F.col("query_id").alias("query"), normalize("search_query").alias("text"))
    return texts.join(classes, "text").select("query", "class")


def filter_ceiling(spark, folder):
    classes = _likeliest_classes(spark, folder)
    return rounded(reports.filter_ceiling(_pairs(spark, folder), corpus(spark, folder, _FILTERED), _queries(spark, folder), classes, _of_queries(spark, folder, classes)))


def filter_survivors(spark, folder):
    """How many queries have at most 50, 200 and 1000 candidates left after all filters."""
    classes = _likeliest_classes(spark, folder)
    left = reports.surviving(corpus(spark, folder, _FILTERED), _queries(spark, folder), _centre(spark, folder), _of_queries(spark, folder, classes))
    return rounded(reports.within_limits(left))


def target_marginals(spark, folder):
    return rounded(benchmark.target_marginals(benchmark.descriptors(read_queries(spark, folder))))


def raking_weights(spark, folder):
    """The raked shares of the log's queries, by filter and words."""
    pool = benchmark.descriptors(read_pairs(spark, folder).select("search_query", "search_location_id", "search_infm_params_text").distinct())
    raked = benchmark.raking_weights(pool, benchmark.target_marginals(benchmark.descriptors(read_queries(spark, folder))))
    shares = raked.groupBy("empty_filter", "words").agg(F.sum("weight").alias("w"))
    return shares.select("empty_filter", "words", F.round(F.col("w") / F.sum("w").over(Window.partitionBy(F.lit(1))), 6).alias("share"))  # at most 14 rows


def _corpus_size(spark, folder):
    """The real corpus, as far as the pairs have items."""
    return min(corpus(spark, folder, ["item_id"]).count(), read_pairs(spark, folder, ["item_id"]).select("item_id").distinct().count())


def _n_queries(spark, folder):
    """The real queries, as far as the log has such ones."""
    real = read_queries(spark, folder)
    pool = benchmark.descriptors(benchmark.with_query_id(read_pairs(spark, folder)).select("query_id", *QUERY_COLUMNS).distinct())
    fit = benchmark.raking_weights(pool, benchmark.target_marginals(benchmark.descriptors(real))).where("weight > 0")
    return min(real.select("query_id").distinct().count(), fit.count())


def _donor(spark, folder, keyed):
    """As many unseen items as the corpus is to have."""
    size = _corpus_size(spark, folder)
    return benchmark.donor_cut(keyed, size - round(SEEN * size), 42)


def donor_cut(spark, folder):
    return _donor(spark, folder, benchmark.with_query_id(_pairs(spark, folder)))


def donor_match(spark, folder):
    """Donor queries with positives in the corpus, matched to a share of seen positives."""
    keyed = benchmark.with_query_id(_pairs(spark, folder))
    donor = _donor(spark, folder, keyed)
    fit = keyed.join(donor, "query_id", "left_anti").select("item_id").distinct()
    held = keyed.join(donor, "query_id", "left_semi").join(corpus(spark, folder, ["item_id"]), "item_id", "left_semi")
    budget = round(DONORS * read_queries(spark, folder, ["query_id"]).distinct().count())
    return benchmark.match_donors(held, fit, SEEN, budget, 7)


def _local(spark, folder):
    return benchmark.build_local(_pairs(spark, folder), read_queries(spark, folder), _n_queries(spark, folder), _corpus_size(spark, folder), SEEN)


def benchmark_build(spark, folder):
    """Sizes of the tables of a local benchmark."""
    out = None
    for name, df in _local(spark, folder).tables().items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = part if out is None else out.unionAll(part)
    return out


def benchmark_leaks(spark, folder):
    """What is wrong with a local benchmark: nothing, if it is built right; each check with its count all the same."""
    found = benchmark.leakage_checks(_local(spark, folder).tables(), SEEN, every=True)
    return found


def benchmark_compare(spark, folder):
    """A local benchmark beside the real one, in ten numbers."""
    local = _local(spark, folder)
    pairs = _pairs(spark, folder)
    columns = ["item_id", "item_location_id", "item_microcat_id", "item_latitude", "item_longitude"]
    here = reports.Side(local.queries, local.corpus_items(pairs, columns), local.qrels, local.fit_pairs)
    truth = relevant(spark, folder).select(F.col("query").alias("query_id"), F.col("doc").alias("item_id"))
    real = reports.Side(read_queries(spark, folder), corpus(spark, folder, columns), truth, pairs)
    return rounded(reports.compare({"local": here, "real": real}, _centre(spark, folder)))


def corpus_items(spark, folder):
    """The corpus of a local benchmark with the columns of each item's first pair."""
    return _local(spark, folder).corpus_items(_pairs(spark, folder), ["item_title_raw", "item_location_id", "item_price"])


def fit_pairs(spark, folder):
    """The pairs that a local benchmark allows to learn from."""
    return _local(spark, folder).fitted(read_pairs(spark, folder, ["pair_id", "item_id"]))


def popularity(spark, folder):
    """Clicks of each chosen corpus item over the mean of such items, and equal titles."""
    items = corpus(spark, folder, ["item_id", "item_title_raw"])
    clicks = read_pairs(spark, folder, ["item_id"]).groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).join(items.select("item_id"), "item_id", "left_semi")
    mean = clicks.agg(F.avg("n").alias("mean")).first()["mean"] or 1.0
    return clicks.select("item_id", F.round(F.col("n") / mean, 6).alias("popularity"))


def rating_by_location(spark, folder):
    """Items, mean rating and reviews by location and category, with totals (grouping sets)."""
    items = corpus(spark, folder, ["item_id", "item_location_id", "item_category_id", "item_rating"])
    grouped = items.groupingSets([[F.col("item_location_id")], [F.col("item_category_id")], []], "item_location_id", "item_category_id").agg(F.count(F.lit(1)).alias("items"), F.round(F.avg(number("item_rating")), 6).alias("rating"))
    return grouped.select("item_location_id", "item_category_id", "items", "rating")


QUERIES = [
    query_item_counts, overlap_report, truncation_report, distance_report, location_match, facet_report, microcat_concentration, selection_bias, shift_report, duplicate_report, radius_count,
    corpus_density, filter_ceiling, filter_survivors, corpus_items, fit_pairs, target_marginals, raking_weights, donor_cut, donor_match, benchmark_build, benchmark_leaks, benchmark_compare, popularity, rating_by_location,
]

_SHARES = """round(avg(case when c is null then null when c = 0 then 1.0::double else 0 end), 6) "none", round(avg(case when c is null then null when c > 0 and c < 1 then 1.0::double else 0 end), 6) "partial",
round(avg(case when c is null then null when c = 1 then 1.0::double else 0 end), 6) "whole", round(avg(c), 6) "mean\""""
_TP = "coalesce(item_title_raw, '') || ' ' || coalesce(item_infm_params_text, '')"
_Q = sql.toks("search_query")
_PKM = sql.km("lat", "lon", sql.real("item_latitude"), sql.real("item_longitude"))
_ITEM_KM = sql.km("lat", "lon", sql.real("i.item_latitude"), sql.real("i.item_longitude"))
_POOL = "<columns>"  # of the distinct queries that are raked
_BIASED = ("item_rating", "item_rating_reviews_count", "item_price")
_VALID = "not ((item_latitude)::varchar = 'nan') and not ((item_longitude)::varchar = 'nan') and item_latitude between -90 and 90 and item_longitude between -180 and 180"
_FIELDS = {"title": "coalesce(item_title_raw, '')", "title+params": _TP, "title+params+description": f"{_TP} || ' ' || coalesce(item_description_raw, '')"}
_KEYED = f"keyed as (select *, substr(sha256({sql.KEY}), 1, 16) query_id from train)"
_CORPUS_SIZE = "sizes as (select least((select count(distinct item_id) from benchmark_items), (select count(distinct item_id) from train)) size)"
_DONOR = f"""{_KEYED}, {_CORPUS_SIZE}, placed as (select query_id, item_id, {sql.shuffled("query_id", 42)} o from keyed),
freed as (select max(o) last from placed group by item_id order by last limit (select size - round(0.3::double * size)::bigint from sizes)),
donor as (select distinct query_id from placed where o <= (select max(last) from freed))"""
_DESCRIBED = f"select coalesce(search_location_id::varchar, '') location, (length(coalesce(search_infm_params_text, '')) = 0)::varchar empty_filter, least({sql.words('search_query')}, 6)::varchar words from benchmark_queries"


def _raked() -> str:
    """CTEs up to ``raked``: the log's queries, once each, with the weight that fits the real queries' marginals."""
    cells = ("location", "empty_filter", "words")
    described = "coalesce(search_location_id::varchar, '') location, (length(coalesce(search_infm_params_text, '')) = 0)::varchar empty_filter, least(" + sql.words("search_query") + ", 6)::varchar words"
    parts = [f"real_ as (select {described} from benchmark_queries)", *[f"aim_{c} as (select {c}, count(*)::double / (select count(*) from real_) share from real_ group by 1)" for c in cells]]
    parts.append(f"pool as (select distinct {_POOL}, {described} from keyed), cell as (select location, empty_filter, words, count(*) n from pool group by all)")
    parts.append("c0 as materialized (select c.*, case when a.share is not null and b.share is not null and d.share is not null then 1.0::double else 0 end w from cell c left join aim_location a using (location) left join aim_empty_filter b using (empty_filter) left join aim_words d using (words))")
    for n in range(30 * len(cells)):
        c = cells[n % len(cells)]
        parts.append(f"c{n + 1} as materialized (select location, empty_filter, words, n, case when share is not null and sum(w * n) over (partition by {c}) > 0 then w * (share * sum(w * n) over () / sum(w * n) over (partition by {c})) else w end w from c{n} left join aim_{c} using ({c}))")
    return ", ".join(parts) + f", raked as (select p.*, w weight from pool p join c{30 * len(cells)} using (location, empty_filter, words))"


def _bias(c: str) -> str:
    return f"""select '{c}' feature, round((select median(v) from a_{c}), 6) chosen, round((select median(v) from b_{c}), 6) pool,
round((select 2 * sum(x.n::double * y.n * (case when x.v > y.v then 1.0::double when x.v = y.v then 0.5::double else 0 end)) / sum(x.n::double * y.n) - 1 from (select v, count(*) n from a_{c} group by 1) x cross join (select v, count(*) n from b_{c} group by 1) y), 6) delta"""


def _local_sql() -> str:
    """CTEs of a local benchmark: held, truth, donor, fit_, corpus_."""
    order = sql.shuffled("item_id", 42)
    return f"""{_KEYED}, {_raked().replace(_POOL, "query_id, search_query, search_location_id, search_is_delivery_search, search_infm_params_text, search_category")}, {_CORPUS_SIZE},
held as materialized (select * from raked where weight > 0 order by round(-ln({sql.uniform("query_id", 42)}) / weight, 12), query_id limit (select count(distinct query_id) from benchmark_queries)),
truth as (select distinct query_id, item_id from keyed where query_id in (select query_id from held)), free_ as (select * from keyed where query_id not in (select query_id from held)),
freed as (select max({sql.shuffled("query_id", 42)}) last from free_ group by item_id order by last limit (select size - round(0.3::double * size)::bigint from sizes)),
donor as (select distinct query_id from free_ where {sql.shuffled("query_id", 42)} <= (select max(last) from freed)), fit_ as (select * from free_ where query_id not in (select query_id from donor)),
pos_ as (select distinct item_id from truth), fit_items as (select distinct item_id from fit_), seen_pool as (select item_id from fit_items where item_id not in (select item_id from pos_)),
unseen_pool as (select distinct item_id from free_ where item_id not in (select item_id from fit_items) and item_id not in (select item_id from pos_)),
n_seen as (select least(greatest(0, round(0.3::double * size)::bigint - (select count(*) from pos_ where item_id in (select item_id from fit_items))), (select count(*) from seen_pool)) n from sizes),
corpus_ as materialized (select item_id from pos_ union all (select item_id from seen_pool order by {order}, item_id limit (select n from n_seen))
  union all (select item_id from unseen_pool order by {order}, item_id limit (select greatest(0, size - (select count(*) from pos_) - (select n from n_seen)) from sizes)))"""


def _side_sql(name: str, queries: str, items: str, truth: str, pairs: str) -> str:
    """(quantity, the side's number) of benchmark_compare."""
    valid = _VALID.replace("item_l", "i.item_l")
    return f"""(select unnest(['queries', 'items', 'words', 'empty_filters', 'seen_share', 'density', 'locations', 'categories', 'positives', 'single']) quantity, unnest([
(select count(*) from {queries})::double, (select count(*) from {items})::double, (select avg({sql.words("search_query")}) from {queries}), (select avg((length(coalesce(search_infm_params_text, '')) = 0)::int) from {queries}),
(select avg((item_id in (select item_id from {pairs}))::int) from (select distinct item_id from {items})), (select median(n)::double from (select query_id, count(i.item_id) n from {queries} left join centre on location_ = search_location_id left join {items} i on {valid} and {_ITEM_KM} <= 25 group by 1)),
(select count(distinct item_location_id) from {items})::double, (select count(distinct item_microcat_id) from {items})::double, (select avg(n) from (select count(*) n from {truth} group by query_id)), (select avg((n = 1)::int) from (select count(*) n from {truth} group by query_id))]) v) {name}_"""


def _compare_sql() -> str:
    columns = "item_id, item_location_id, item_microcat_id, item_latitude, item_longitude"
    first = ", ".join(f"arg_min({c}, pair_id) {c}" for c in columns.split(", ")[1:])
    centre = CENTRE.replace("search_location_id location,", "search_location_id location_,")
    return f"""with {_local_sql()}, {centre}, {sql.QRELS}, there as (select item_id, {first} from train where item_id in (select item_id from corpus_) group by item_id), ri as (select distinct {columns} from benchmark_items where item_id is not null)
select quantity, round(local_.v, 6) "local", round(real_side_.v, 6) "real" from {_side_sql("local", "held", "there", "truth", "fit_")} join {_side_sql("real_side", "benchmark_queries", "ri", "rel", "train")} using (quantity)"""


def _ceiling_sql() -> str:
    """CTEs held (geo, facet, microcat of each pair) and s (what each filter leaves of the corpus for each query)."""
    texts = f"texts as (select distinct {sql.norm('search_query')} t from train union select distinct {sql.norm('search_query')} from benchmark_queries)"
    valid = _VALID.replace("item_l", "i.item_l")
    return f"""{sql.CORPUS}, {CENTRE}, {texts}, {sql.bayes("train", "pair_id", "search_query", "item_microcat_id", "texts", "t", "t")}, top3 as (select k, list(c) cs from (select k, c from j qualify row_number() over (partition by k order by round(j, 9) desc, c) <= 3) group by k),
held as (select coalesce({_PKM}, 1e9) <= 25 geo, len(list_filter({sql.bare("search_infm_params_text")}, lambda x: not list_contains({sql.bare("item_infm_params_text")}, x))) = 0 facet, coalesce(list_contains(cs, item_microcat_id), false) microcat from train left join centre on location = search_location_id left join top3 on k = {sql.norm("search_query")}),
voc as (select distinct unnest({sql.bare("item_infm_params_text")}) token from items), want as (select query_id, unnest({sql.bare("search_infm_params_text")}) token from benchmark_queries), need as (select query_id, list(token) wanted from want where token in (select token from voc) group by 1),
p as (select q.query_id, coalesce(case when {valid} then {_ITEM_KM} end, 1e9) <= 25 geo, wanted is null or len(list_intersect(wanted, {sql.bare("i.item_infm_params_text")})) = len(wanted) facet, coalesce(list_contains(cs, i.item_microcat_id), false) microcat
  from benchmark_queries q left join centre on location = search_location_id left join need using (query_id) left join top3 on top3.k = {sql.norm("q.search_query")} cross join items i),
s as (select query_id, sum(geo::int) n0, sum(facet::int) n1, sum(microcat::int) n2, sum((geo and facet)::int) n3, sum((geo and facet and microcat)::int) n4 from p group by 1)"""


def _ceiling_rows() -> str:
    passes = {"geo": "geo", "facet": "facet", "microcat": "microcat", "geo+facet": "geo and facet", "all": "geo and facet and microcat"}
    rows = [f"select '{f}' \"filter\", round((select avg(({c})::int) from held), 6) ceiling, quantile_cont(n{i}, 0.5)::double \"median\", round(quantile_cont(n{i}, 0.9)::double, 6) p90 from s" for i, (f, c) in enumerate(passes.items())]
    return " union all ".join([*rows, "select 'none', 1.0::double, count(*)::double, count(*)::double from items"])


def _bias_tables(c: str) -> str:
    return f"a_{c} as (select {sql.real(c)} v from train where {sql.real(c)} is not null), b_{c} as (select {sql.real(c)} v from items where {sql.real(c)} is not null)"


SQL = {
    "query_item_counts": f"""with p as (select {sql.KEY} k, count(*) n from train group by 1) select count(*) queries, round(avg(n), 6) "mean", round(median(n), 6)::double "median", max(n) most,
round(avg((n = 1)::int), 6) one, round(avg((n = 2)::int), 6) two, round(avg((n = 3)::int), 6) three from p""",
    "overlap_report": f"with e as ({' union all '.join(f"select '{n}' fields, {sql.covered(_Q, sql.toks(c))} c from train" for n, c in _FIELDS.items())}) select fields, {_SHARES} from e group by 1",
    "truncation_report": f"""with e as ({" union all ".join(f"select {n}::bigint chars, {sql.covered(_Q, sql.toks(_TP + " || ' ' || (" + sql.cut('item_description_raw', n) + ")"))} c from train" for n in (0, 100, 200, 300, 500, 1000, 100000))})
select chars, "none", "whole", "mean" from (select chars, {_SHARES} from e group by 1)""",
    "distance_report": f"""with {CENTRE}, d as (select {_PKM} km from train join centre on location = search_location_id), t as (select unnest([1, 5, 10, 25, 50, 100, 250, 500, 1000])::double t)
select t km, round(avg((d.km <= t)::int), 6) share from d cross join t where d.km is not null group by 1""",
    "location_match": """with p as (select search_location_id, count(distinct item_location_id) n from train where search_location_id is not null group by 1)
select round((select avg((search_location_id = item_location_id)::int) from train), 6) same, quantile_cont(n, 0.5)::double "median", round(quantile_cont(n, 0.9)::double, 6) p90 from p""",
    "facet_report": f"""with e as (select length(coalesce(search_infm_params_text, '')) > 0 f, {sql.bare("search_infm_params_text")} a, {sql.bare("item_infm_params_text")} b, contains({sql.norm("item_infm_params_text")}, {sql.norm("search_infm_params_text")}) v from train),
g as (select f, case when f then {sql.covered("a", "b")} end c, case when f then (v and len(a) > 0)::int end v from e)
select sum(f::int)::bigint filtered, round(avg(f::int), 6) share, round(avg(c), 6) "mean", round(avg(case when c is null then null else (c = 1)::int end), 6) whole, round(avg(case when c is null then null else (c = 0)::int end), 6) "none", round(avg(v), 6) verbatim from g""",
    "microcat_concentration": """with c as (select coalesce(search_query, '') q, item_microcat_id, count(*) n from train group by all), s as (select q, n::double / sum(n) over (partition by q) p, sum(n) over (partition by q) t from c),
e as (select q, max(p) top, sum(-p * log2(p)) h from s where t >= 3 group by 1) select count(*) queries, round(avg(top), 6) top_mean, round(median(top), 6) top_median, round(avg(h), 6) entropy, round(avg((top = 1)::int), 6) single from e""",
    "selection_bias": f"with {sql.CORPUS}, {', '.join(_bias_tables(c) for c in _BIASED)} {' union all '.join(_bias(c) for c in _BIASED)}",
    "shift_report": f"""with b as (select true train, * from (select distinct search_query, search_location_id, search_is_delivery_search, search_infm_params_text, search_category from train)
  union all select false, search_query, search_location_id, search_is_delivery_search, search_infm_params_text, search_category from benchmark_queries),
r as (select train, {sql.words("search_query")} words, (length(coalesce(search_infm_params_text, '')) = 0)::int empty, search_is_delivery_search delivery from b),
v as (select words, sum(train::int)::double a, sum((not train)::int)::double b from r group by 1), g as (select abs(sum(a) over (order by words) / sum(a) over () - sum(b) over (order by words) / sum(b) over ()) gap from v)
select {", ".join(f"round(avg(case when {'' if s == 'train' else 'not '}train then {c} end), 6) {c}_{s}" for c in ("words", "empty", "delivery") for s in ("train", "bench"))}, round((select max(gap) from g), 6) ks from r""",
    "duplicate_report": f"""with {sql.CORPUS}, r as (select {sql.norm("item_title_raw")} t, item_location_id l, item_microcat_id m from items), a as (select t, count(*) n from r group by 1), b as (select t, l, count(*) n from r group by all), c as (select t, l, m, count(*) n from r group by all)
select count(*) titles, sum(n)::bigint items, round(sum(case when n > 1 then n else 0 end)::double / sum(n), 6) repeated, max(case when n > 1 then n else 0 end)::bigint most, round(sum((n = 1)::int)::double / sum(n), 6) by_title,
round((select sum((n = 1)::int)::double / sum(n) from b), 6) by_location, round((select sum((n = 1)::int)::double / sum(n) from c), 6) by_microcat from a""",
    "radius_count": f"""with {sql.CORPUS}, {CENTRE}, i as (select * from items where {_VALID})
select query_id, count(i.item_id) n from benchmark_queries left join centre on location = search_location_id left join i on {_ITEM_KM} <= 25 group by 1""",
    "corpus_density": f"""with {sql.CORPUS}, {CENTRE}, i as (select * from items where {_VALID}), r as (select query_id, count(i.item_id) n from benchmark_queries left join centre on location = search_location_id left join i on {_ITEM_KM} <= 25 group by 1)
select median(n)::double "median" from r""",
    "filter_ceiling": f"with {_ceiling_sql()} {_ceiling_rows()}",
    "filter_survivors": f"with {_ceiling_sql()} select most::bigint most, round(avg((n4 <= most)::int), 6) share from s cross join (select unnest([50, 200, 1000]) most) group by most",
    "raking_weights": f"""with {_KEYED}, {_raked().replace(_POOL, "search_query, search_location_id, search_infm_params_text")} select empty_filter, words, round(sum(weight) / sum(sum(weight)) over (), 6) share from raked group by all""",
    "benchmark_build": f"""with {_local_sql()} select 'queries' part, count(*) n from held union all select 'qrels', count(*) from truth union all select 'corpus', count(*) from corpus_ union all select 'fit_pairs', count(*) from fit_ union all select 'donor', count(*) from donor""",
    "benchmark_leaks": f"""with {_local_sql()} select 'held_out_in_fit' problem, count(distinct query_id) n from fit_ where query_id in (select query_id from truth)
union all select 'positives_outside_corpus', count(*) from pos_ where item_id not in (select item_id from corpus_) union all select 'repeated_items', count(*) - count(distinct item_id) from corpus_
union all select 'queries_without_positives', count(*) from held where query_id not in (select query_id from truth) union all select 'judged_unknown_queries', count(distinct query_id) from truth where query_id not in (select query_id from held)
union all select 'seen_share_off', (abs(avg((item_id in (select item_id from fit_items))::int) - 0.3::double) > 0.02)::bigint from (select distinct item_id from corpus_)""",
    "benchmark_compare": _compare_sql(),
    "corpus_items": f"with {_local_sql()} select item_id, arg_min(item_title_raw, pair_id) item_title_raw, arg_min(item_location_id, pair_id) item_location_id, arg_min(item_price, pair_id) item_price from train where item_id in (select item_id from corpus_) group by item_id",
    "fit_pairs": f"with {_local_sql()} select pair_id, item_id from fit_",
    "target_marginals": f"""with d as ({_DESCRIBED}), e as (select 'location' "column", location "value" from d union all select 'empty_filter', empty_filter from d union all select 'words', words from d)
select "column", "value", round(count(*)::double / (select count(*) from d), 6) share from e group by all""",
    "donor_cut": f"with {_DONOR} select query_id from donor",
    "donor_match": f"""with {_DONOR}, fit as (select distinct item_id from keyed where query_id not in (select query_id from donor)),
held as (select distinct query_id, item_id from keyed where query_id in (select query_id from donor) and item_id in (select item_id from benchmark_items)),
per as (select query_id, count(f.item_id) seen, count(*) - count(f.item_id) unseen, {sql.shuffled("query_id", 7)} o from held left join fit f using (item_id) group by query_id),
budget as (select round(40000.0::double / 2452 * (select count(distinct query_id) from benchmark_queries))::bigint b), head as (select * from per where seen > 0 order by o, query_id limit (select greatest(1, b // 3) from budget)), g as (select coalesce(sum(seen), 0) * 0.7::double / 0.3::double - coalesce(sum(unseen), 0) needed, count(*) n from head),
tail as (select *, coalesce(sum(unseen) over (order by o, query_id rows between unbounded preceding and 1 preceding), 0) u, row_number() over (order by o, query_id) - 1 c from per where seen = 0)
select query_id, seen, unseen from head union all select query_id, seen, unseen from tail cross join g where needed - u > 0 and n + c < (select b from budget)""",
    "popularity": """with c as (select item_id, count(*) n from train where item_id in (select item_id from benchmark_items) group by 1) select item_id, round(n / (select avg(n) from c), 6) popularity from c""",
    "rating_by_location": f"""with {sql.CORPUS} select item_location_id, item_category_id, count(*) items, round(avg({sql.real("item_rating")}), 6) rating from items group by grouping sets ((item_location_id), (item_category_id), ())""",
}


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return SQL

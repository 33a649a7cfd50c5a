"""Queries of params, categories, features, the re-ranker and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import params
from tessera.functions.keys import shuffled
from tessera.functions.text import normalize
from tessera.operators import features, metrics, microcat, rerank
from tessera.operators.index import build_index, item_fields
from tessera.operators.packed import known_keys
from tessera.plans import retrieval, sql
from tessera.plans.texts import INDEX, corpus_index
from tessera.session import durable, together
from tessera.sources.tables import corpus, read_pairs, read_queries, read_table
from tessera.streaming import clicks


def _keys(spark, folder):
    return known_keys(read_table(spark, f"{folder}/param_keys.parquet"))


def _params(spark, folder):
    return corpus(spark, folder, ["item_id", "item_infm_params_text"])


def params_parse(spark, folder):
    """Keys and values of the concatenated params."""
    rows = _params(spark, folder).select("item_id", F.posexplode(params.parsed("item_infm_params_text", _keys(spark, folder))).alias("pos", "p"))
    return rows.select("item_id", F.col("pos").cast("bigint").alias("pos"), "p.key", "p.value")


def params_values(spark, folder):
    return _params(spark, folder).select("item_id", params.telling_values("item_infm_params_text", _keys(spark, folder)).alias("v")).select("item_id", F.array_join("v", " ").alias("text"))


def params_coverage(spark, folder):
    return _params(spark, folder).select("item_id", F.round(params.key_coverage("item_infm_params_text", _keys(spark, folder)), 6).alias("coverage"))


def frequent_values(spark, folder):
    rows = _params(spark, folder).select("item_id", params.telling_values("item_infm_params_text", _keys(spark, folder)).alias("v"))
    return params.frequent_values(rows, "v", 0.02)


def encoder_texts(spark, folder):
    return params.encoder_texts(corpus(spark, folder, ["item_id", "item_title_raw", "item_description_raw", "item_infm_params_text"]), _keys(spark, folder))


def branching_entropy(spark, folder):
    """Candidates for keys with their branching entropies."""
    got = params.branching(_params(spark, folder), "item_id", "item_infm_params_text")
    return got.select("gram", F.col("size").cast("bigint").alias("size"), "docs", *[F.abs(F.round(c, 6)).alias(c) for c in ("comma", "start", "before_entropy", "before_top", "after_entropy", "after_top")])


def params_discover(spark, folder):
    """Keys found in the params without being told any."""
    return spark.createDataFrame([(k,) for k in params.discover_parser(_params(spark, folder), "item_id", "item_infm_params_text")], "key string")


def microcat_proba(spark, folder):
    """The three likeliest categories of each query text."""
    proba, _ = retrieval._ratios(spark, folder)
    ranked = proba.withColumn("lp", F.round("lp", 9)).withColumn("rnk", F.row_number().over(Window.partitionBy("key").orderBy(F.col("lp").desc(), "class"))).where("rnk <= 3")
    return ranked.select(F.col("key").alias("query_id"), F.col("rnk").cast("bigint").alias("rnk"), F.col("class").alias("microcat"), F.abs(F.round("lp", 6)).alias("surprise"))


def microcat_signal(spark, folder):
    """Log-ratio of the item's category for every candidate; unknown categories get the 5th percentile."""
    got = retrieval._microcat(spark, folder).apply(retrieval.candidates(spark, folder).select("query", "doc"))
    return got.select(F.col("query").alias("query_id"), F.col("doc").alias("item_id"), F.round("microcat", 6).alias("microcat"))


def microcat_accuracy(spark, folder):
    """Top-k accuracy on held-out query texts, a fifth of all by hash."""
    rows = retrieval._labelled(spark, folder).withColumn("text", normalize("text")).where("text <> ''").withColumn("held", F.substring(shuffled(F.col("text"), 0), 1, 1).isin("0", "1", "2"))
    model = microcat.fit(rows.where("not held"))
    tests = rows.where("held")
    ranked = microcat.top_classes(model, tests.select(F.col("text").alias("key"), "text").distinct(), 20)
    hit = tests.select("text", "class").join(ranked.select(F.col("key").alias("text"), "class", "rnk"), ["text", "class"], "left")
    shares = hit.agg(*[F.avg((F.coalesce("rnk", F.lit(99)) <= k).cast("double")).alias(f"k{k}") for k in (1, 3, 5, 10, 20)])
    return shares.select(F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.round(f"k{k}", 6).alias("accuracy")) for k in (1, 3, 5, 10, 20)])).alias("x")).select("x.*")


def postings_parsed(spark, folder):
    """Postings of the index as the chain takes it: values of parsed params without the address, descriptions cut."""
    items = corpus(spark, folder, ["item_id", "item_title_raw", "item_description_raw", "item_infm_params_text"])
    index = build_index(item_fields(items, keys=_keys(spark, folder), description_chars=300, address=False))
    return index.postings.select(F.col("doc").alias("item_id"), "field", "term", "tf")


def _features(spark, folder) -> DataFrame:
    index = corpus_index(spark, folder)
    pairs = read_pairs(spark, folder, ["search_query", "item_id"])
    queries = read_queries(spark, folder).select(F.col("query_id").alias("query"), F.col("search_query").alias("text"), F.col("search_infm_params_text").alias("filter"), F.col("search_location_id").alias("location"))
    # Repeats are told by all columns, descriptions too; that is done once.
    items = durable(corpus(spark, folder).select(features.ITEM_FIELDS))
    context = features.item_context(items, pairs, index)
    return features.build_features(retrieval.candidates(spark, folder), queries, context, retrieval._places(spark, folder), index, pairs, retrieval.relevant(spark, folder))


def feature_table(spark, folder):
    rows = _features(spark, folder)
    return rows.select(F.col("query").alias("query_id"), F.col("doc").alias("item_id"), *[F.round(c, 6).alias(c) for c in features.FEATURES], "label")


def rerank_gbt(spark, folder):
    """Out-of-fold re-ranking: recall at 5 and 10 beside the fused order and the ceiling."""
    rows = durable(_features(spark, folder))
    scores = durable(rerank.cross_validate(rows))
    truth = retrieval.relevant(spark, folder)
    runs = {"rerank": rerank.ranked(scores, 10), "fused": retrieval.candidate_run(spark, folder).where("rnk <= 10"), "ceiling": rerank.ranked(scores.withColumn("score", F.col("label").cast("double")), 10)}
    out = None
    for name, run in runs.items():
        part = metrics.recall_curve(run, truth, (5, 10)).select(F.lit(name).alias("run"), "k", F.round("recall", 6).alias("recall"))
        out = part if out is None else out.unionAll(part)
    return out


def rerank_importance(spark, folder):
    """Importance of the features with and without those that tell of the item alone."""
    rows = durable(_features(spark, folder))
    plain = [f for f in features.FEATURES if f not in features.PRIORS]
    fits = together(lambda: rerank.train(rows), lambda: rerank.train(rows, plain))
    out = [(name, f, v) for name, used, model in zip(("all", "without_priors"), (features.FEATURES, plain), fits, strict=True) for f, v in rerank.importance(model, used)]
    return spark.createDataFrame(out, "variant string, feature string, importance double")


def stream_daily_events(spark, folder):
    """Events by day and type, counted by a stream over the table's files."""
    got = clicks.drain(clicks.windowed_counts(clicks.event_stream(spark, folder)))
    return got.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("value", 4).alias("value"))


QUERIES = [
    params_parse, params_values, params_coverage, frequent_values, encoder_texts, branching_entropy, params_discover, microcat_proba, microcat_signal, microcat_accuracy, postings_parsed, feature_table,
    rerank_gbt, rerank_importance, stream_daily_events,
]

_SPACED = "list_filter(regexp_split_to_array(coalesce(item_infm_params_text, ''), '[\\s\\p{Z}]+'), lambda t: t <> '')"


def _entropy(side: str) -> str:
    return f"{side}_ as (select gram, log2(sum(n)) - sum(n * log2(n)) / sum(n) {side}_entropy, max(n)::double / sum(n) {side}_top from (select gram, {side}, count(*) n from kept group by all) group by gram)"


_NB = f"{sql.CORPUS}, " + sql.bayes("train", "pair_id", "search_query", "item_microcat_id", "benchmark_queries", "query_id", "search_query")

_C = sql.real
_FEATURES = f"""{INDEX}, {retrieval.RUN}, {retrieval.CENTRE}, {retrieval._PLACE}, titled as (select *, {sql.norm("item_title_raw")} title from items), twin as (select title, count(*) twins from titled group by 1),
click as (select item_id, count(*) n from train where item_id in (select item_id from items) group by 1), past as (select distinct {sql.norm("search_query")} normal, item_id from train),
kt as (select query_id, term, idf from qt join idf using (term)),
pres as (select query_id, item_id, field, term, idf, coalesce(tf, 0)::double tf, coalesce(len, 0) len, b, a from (select query_id, item_id from cand) left join kt using (query_id) cross join par join av using (field) left join (select * from post join len using (item_id, field)) using (item_id, field, term) where field in ('title', 'description')),
pa as (select query_id, item_id, field, coalesce(sum(case when tf > 0 then 1.0::double else 0 end) / nullif(count(term), 0), 0) cov, coalesce(sum(case when tf > 0 then idf else 0 end) / nullif(sum(idf), 0), 0) cov_idf,
  coalesce(sum(idf * (tf / (1 - b + b * len / a)) / (1.2::double + tf / (1 - b + b * len / a))), 0) bm from pres group by all),
tl as (select item_id, sum(case when field = 'title' then len else 0 end) title_len, sum(case when field = 'description' then len else 0 end) desc_len from len group by 1),
f as (select c.*, q.search_query, q.search_infm_params_text fil, q.search_location_id loc, {sql.norm("q.search_query")} normal, t.title, t.item_location_id, {_C("t.item_price")} price, {_C("t.item_rating")} rating, {_C("t.item_rating_reviews_count")} reviews,
  t.item_is_phone_hidden ph, t.item_is_message_forbidden mf, twins, coalesce(k.n / (select avg(n) from click), 0) clicks, coalesce({sql.km("qlat", "qlon", _C("t.item_latitude"), _C("t.item_longitude"))}, -1.0::double) distance_km,
  x.cov title_cov, x.cov_idf title_cov_idf, x.bm title_bm25, y.cov desc_cov, y.bm desc_bm25, title_len, desc_len, (past.item_id is not null)::int::double memory, (rel.item_id is not null)::bigint label
  from cand c join benchmark_queries q using (query_id) join titled t using (item_id) join twin using (title) left join click k using (item_id) left join place using (query_id) join pa x on x.query_id = c.query_id and x.item_id = c.item_id and x.field = 'title'
  join pa y on y.query_id = c.query_id and y.item_id = c.item_id and y.field = 'description' left join tl on tl.item_id = c.item_id left join past on past.normal = {sql.norm("q.search_query")} and past.item_id = c.item_id left join rel on rel.query_id = c.query_id and rel.item_id = c.item_id)"""


def _rank(order: str) -> str:
    return f"(row_number() over (partition by query_id order by {order}, item_id) - 1)::double"


_MID = "median(price) over (partition by query_id)"
_COLUMNS = {
    "lexical": "lexical", "lexical_norm": "lexical / greatest(max(lexical) over (partition by query_id), 1e-9)", "lexical_rank": _rank("lexical desc"), "geo": "geo", "geo_rank": _rank("geo desc"), "distance_km": "distance_km",
    "distance_rank": _rank("distance_km"), "facet": "facet", "microcat": "microcat", "dense": "dense", "dense_rank": _rank("dense desc"), "total_rank": _rank("total desc"), "query_words": f"{sql.words('search_query')}::double",
    "empty_filter": "(length(coalesce(fil, '')) = 0)::int::double", "n_candidates": "(count(*) over (partition by query_id))::double", "title_cov": "title_cov", "title_cov_idf": "title_cov_idf", "desc_cov": "desc_cov",
    "same_location": "coalesce(item_location_id = loc, false)::int::double", "popularity": "ln(1 + clicks)", "seen": "(clicks > 0)::int::double", "memory": "memory", "twins": "twins::double", "price": "price", "price_rank": _rank("price asc nulls last"),
    "price_to_median": f"case when {_MID} = 0 then 0 else price / {_MID} end", "rating": "rating", "reviews": "reviews", "title_bm25": "title_bm25", "desc_bm25": "desc_bm25", "title_len": "coalesce(title_len, 0)::double",
    "has_desc": "(coalesce(desc_len, 0) > 0)::int::double", "verbatim": "contains(title, normal)::int::double", "phone_hidden": "coalesce(ph, false)::int::double", "msg_forbidden": "coalesce(mf, false)::int::double",
}

_PAR = sql.params("select item_id id, item_infm_params_text t from items")
_TELLING = f"value <> '' and not {sql.is_number('value')}"
_SAID = "coalesce({c}, '')"

SQL = {
    "params_parse": f"with {sql.CORPUS}, {_PAR} select id item_id, pos, key, value from par",
    "params_values": f"""with {sql.CORPUS}, {_PAR}, said as (select id, string_agg(value, ' ' order by pos) s from par where {_TELLING} group by id)
select item_id, coalesce(s, '') "text" from (select distinct item_id, item_infm_params_text from items) left join said on id = item_id""",
    "params_coverage": f"""with {sql.CORPUS}, {_PAR} select id item_id, round(case when len(w) = 0 then 1 when i is null then 0 else 1 - (i - 1)::double / len(w) end, 6)::double coverage from words_of left join first_key using (id)""",
    "frequent_values": f"""with {sql.CORPUS}, {_PAR} select value, count(distinct id) items from par where {_TELLING} group by value having count(distinct id) > 0.02::double * (select count(*) from items)""",
    "encoder_texts": f"""with {sql.CORPUS}, {_PAR}, said as (select id, pos, value from par where {_TELLING} and key <> '{params.ADDRESS_KEY}'),
common as (select value from said group by value having count(distinct id) > 0.2::double * (select count(*) from items)),
rare as (select id, string_agg(value, ' ' order by pos) v from said where value not in (select value from common) group by id)
select item_id, array_to_string(list_filter([coalesce(item_title_raw, ''), coalesce(v, ''), {sql.cut("item_description_raw", 250)}], lambda x: x <> ''), '. ') "text" from items left join rare on id = item_id""",
    "postings_parsed": f"""with {sql.CORPUS}, {_PAR}, said as (select id, string_agg(value, ' ' order by pos) s from par where {_TELLING} and key <> '{params.ADDRESS_KEY}' group by id),
docs as (select item_id, 'title' field, item_title_raw t from items union all select item_id, 'params', s from items left join said on id = item_id union all select item_id, 'description', {sql.cut("item_description_raw", 300)} from items)
select item_id, field, term, count(*) tf from (select item_id, field, unnest({sql.toks("t")}) term from docs) group by all""",
    "microcat_accuracy": f"""with rows_ as (select *, substr({sql.shuffled("t", 0)}, 1, 1) in ('0', '1', '2') held from (select pair_id, {sql.norm("search_query")} t, item_microcat_id from train) where t <> ''),
fit_ as (select * from rows_ where not held), ask_ as (select distinct t from rows_ where held), {sql.bayes("fit_", "pair_id", "t", "item_microcat_id", "ask_", "t", "t")},
ranked as (select k, c, row_number() over (partition by k order by round(j, 9) desc, c) r from j qualify r <= 20), hit as (select coalesce(r, 99) r from rows_ left join ranked on k = t and c = item_microcat_id where held)
select g::bigint k, round(avg((r <= g)::int), 6) accuracy from hit cross join (select unnest([1, 3, 5, 10, 20]) g) group by g""",
    "branching_entropy": f"""with {sql.CORPUS}, w as (select item_id, {_SPACED} w from items), s as (select item_id, w, unnest(range(1, len(w) + 1)) i from w),
g as (select item_id, w, i, unnest(range(1, least(5, len(w) - i + 1) + 1)) size from s where regexp_matches(w[i], '^\\p{{Lu}}')),
c as (select item_id, array_to_string(w[i:i + size - 1], ' ') gram, size, case when i > 1 then w[i - 1] else chr(2) end "before", coalesce(w[i + size], chr(2)) "after" from g),
able as (select gram, size, count(distinct item_id) docs, avg(("before" like '%,')::int) comma, avg(("before" = chr(2))::int) start from c group by all
  having count(distinct item_id) >= greatest(5, floor(0.004::double * (select count(*) from w where len(w) > 0))) and gram not like '%,' and not regexp_matches(gram, '[0-9]')),
kept as (select * from c where gram in (select gram from able)), {_entropy("before")}, {_entropy("after")}
select gram, size::bigint size, docs, {", ".join(f"abs(round({c}, 6)) {c}" for c in ("comma", "start", "before_entropy", "before_top", "after_entropy", "after_top"))} from able join before_ using (gram) join after_ using (gram)""",
    "microcat_proba": f"with {_NB} select k query_id, row_number() over (partition by k order by round(lp, 9) desc, c) rnk, c microcat, abs(round(round(lp, 9), 6)) surprise from lp qualify rnk <= 3",
    "microcat_signal": f"""with {_NB}, {retrieval.CAND}, share as (select item_microcat_id c, count(*) n from items group by 1), r as (select k, c, lp - ln(coalesce(n, 1) / (select count(*)::double from items)) ratio from lp left join share using (c))
select query_id, item_id, round(coalesce(ratio, (select quantile_cont(ratio, 0.05) from r)), 6) microcat from cand left join items using (item_id) left join r on k = query_id and c = item_microcat_id""",
    "feature_table": f"with {_FEATURES} select query_id, item_id, {', '.join(f'round({v}, 6) {k}' for k, v in _COLUMNS.items())}, label from f",
    "stream_daily_events": "select strftime(ts, '%Y-%m-%d') \"day\", event_type, count(*) n, round(sum(value), 4) \"value\" from events group by all",
}


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return SQL

"""Queries of signals, fusion, metrics and answers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.geo import DISTANCE_EDGES, FACET_EDGES, haversine, number
from tessera.functions.text import coverage, normalize, tokens, word_count
from tessera.operators import fusion, metrics, signals, submission
from tessera.operators.exact import closest_vectors, nearest_places
from tessera.plans import chain, sql
from tessera.plans.texts import INDEX
from tessera.session import durable
from tessera.sources.tables import corpus, qrels, read_pairs, read_queries, read_table

SCORES = ["lexical", "geo", "facet", "microcat", "dense"]
PLACES = ["item_id", "item_latitude", "item_longitude"]
DENSE_DEPTH = chain.DENSE_DEPTH


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """(query, doc, the five scores, total): repeated pairs with their highest scores, NaN and null as 0."""
    rows = read_table(spark, f"{folder}/candidates.parquet", ["query_id", "item_id", *SCORES, "total"]).where("query_id is not null and item_id is not null")
    return rows.groupBy(F.col("query_id").alias("query"), F.col("item_id").alias("doc")).agg(*[F.coalesce(F.max(number(s)), F.lit(0.0)).alias(s) for s in [*SCORES, "total"]])


def candidate_run(spark, folder):
    order = Window.partitionBy("query").orderBy(F.col("total").desc(), "doc")
    return candidates(spark, folder).select("query", "doc", F.row_number().over(order).cast("bigint").alias("rnk"))


def relevant(spark, folder):
    return qrels(spark, folder).select(F.col("query_id").alias("query"), F.col("item_id").alias("doc"))


def _pairs(spark, folder):
    return read_pairs(spark, folder, ["pair_id", "search_location_id", "search_infm_params_text", "item_infm_params_text", "item_latitude", "item_longitude"])


def _places(spark, folder):
    return chain.places(chain.open_tables(spark, folder))


def search_centroids(spark, folder):
    got = signals.centroids(_pairs(spark, folder), "search_location_id")
    return got.select("location", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), "n")


def item_centroids(spark, folder):
    got = signals.centroids(corpus(spark, folder, ["item_id", "item_location_id", "item_latitude", "item_longitude"]), "item_location_id")
    return got.select("location", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), "n")


def geo_calibration(spark, folder):
    """Pairs and random items by distance bin."""
    return signals.geo_histogram(_pairs(spark, folder), corpus(spark, folder, PLACES)).select("side", F.col("bin").cast("bigint").alias("bin"), "n")


def facet_calibration(spark, folder):
    return signals.facet_histogram(_pairs(spark, folder), corpus(spark, folder, ["item_id", "item_infm_params_text"])).select("side", F.col("bin").cast("bigint").alias("bin"), "n")


def _geo(spark, folder):
    return chain.geo(chain.open_tables(spark, folder))


def _facet(spark, folder):
    return chain.facet(chain.open_tables(spark, folder))


def _dense(spark, folder):
    return chain.dense(chain.open_tables(spark, folder))


def _labelled(spark, folder):
    return chain.labelled(read_pairs(spark, folder, ["pair_id", "search_query", "item_microcat_id"]))


def _ratios(spark, folder):
    return chain.category_ratios(chain.open_tables(spark, folder))


def _microcat(spark, folder):
    return chain.category(chain.open_tables(spark, folder))


def _named(df, *columns):
    return df.select(F.col("query").alias("query_id"), F.col("doc").alias("item_id"), *columns)


def geo_score(spark, folder):
    pairs = candidates(spark, folder).select("query", "doc")
    geo = _geo(spark, folder)
    return _named(geo.apply(geo.distance(pairs)), F.round("km", 6).alias("km"), F.round("geo", 6).alias("geo"))


def facet_score(spark, folder):
    return _named(_facet(spark, folder).apply(candidates(spark, folder).select("query", "doc")), F.round("facet", 6).alias("facet"))


def dense_score(spark, folder):
    return _named(_dense(spark, folder).apply(candidates(spark, folder).select("query", "doc")), F.round("dense", 6).alias("dense"))


def dense_topk(spark, folder):
    """The twenty items of highest cosine for every query vector, exactly."""
    d = _dense(spark, folder)
    return _named(closest_vectors(d.queries, d.items, 20), "rnk", F.round("score", 6).alias("cosine"))


def _fused(spark, folder, mode):
    return _named(fusion.fuse(candidates(spark, folder), fusion.WEIGHTS, 50, fusion.Fusion(mode)), "rnk", F.round("total", 6).alias("total"))


def fuse_normalized(spark, folder):
    return _fused(spark, folder, "normalized")


def fuse_raw(spark, folder):
    return _fused(spark, folder, "raw")


def fuse_rrf(spark, folder):
    return _fused(spark, folder, "rrf")


def collect_components(spark, folder):
    """The whole chain: every lexical hit and the nearest vectors, four signals, one sum, the best fifty."""
    tables = chain.open_tables(spark, folder)
    got = chain.collected(tables, chain.lexical_index(tables), 50)
    return _named(got, "rnk", *[F.round(c, 5).alias(c) for c in (*SCORES, "total")])


def pad_nearest(spark, folder):
    """Fifty items for every query: the candidates, filled up with the nearest items."""
    run = candidate_run(spark, folder).where("rnk <= 50")
    return _named(fusion.pad_with_nearest(run, _places(spark, folder), signals.item_places(corpus(spark, folder, PLACES)), 50), "rnk")


def nearest_items(spark, folder):
    """The control baseline: the fifty nearest items of each query's place."""
    places = _places(spark, folder).where("qlat is not null")
    items = signals.item_places(corpus(spark, folder, PLACES)).where("ilat is not null and ilon is not null")
    return _named(nearest_places(places, items, 50), "rnk", F.round(-F.col("score"), 6).alias("km"))


def recall_per_query(spark, folder):
    return metrics.recall_per_query(candidate_run(spark, folder), relevant(spark, folder), 50).select(F.col("query").alias("query_id"), F.round("recall", 6).alias("recall"))


def recall_curve(spark, folder):
    return metrics.recall_curve(candidate_run(spark, folder), relevant(spark, folder)).select("k", F.round("recall", 6).alias("recall"))


def candidate_coverage(spark, folder):
    each = metrics.recall_per_query(candidate_run(spark, folder), relevant(spark, folder), None)
    return each.agg(F.round(F.avg("recall"), 6).alias("coverage"), F.count(F.lit(1)).alias("queries"))


def positive_ranks(spark, folder):
    return _named(metrics.positive_ranks(candidate_run(spark, folder), relevant(spark, folder)), "rnk")


def _described(spark, folder):
    """Each relevant item with what may explain its rank."""
    ranks = metrics.positive_ranks(candidate_run(spark, folder), relevant(spark, folder)).withColumn("hit", F.col("rnk").between(1, 10))
    texts = read_queries(spark, folder, ["query_id", "search_query", "search_infm_params_text"]).withColumnRenamed("query_id", "query")
    items = corpus(spark, folder, ["item_id", "item_title_raw", "item_latitude", "item_longitude"])
    twins = items.groupBy(normalize("item_title_raw").alias("t")).agg(F.count(F.lit(1)).alias("twins"))
    titled = items.withColumn("t", normalize("item_title_raw")).join(twins, "t").withColumnRenamed("item_id", "doc")
    joined = ranks.join(texts, "query", "left").join(titled, "doc", "left").join(_places(spark, folder), "query", "left")
    km = haversine(F.col("qlat"), F.col("qlon"), number("item_latitude"), number("item_longitude"))
    title = F.when(F.col("t").isNotNull(), coverage(tokens("search_query"), tokens("item_title_raw")))
    return joined.select("query", "doc", "rnk", "hit", word_count("search_query").alias("words"), (F.length(F.coalesce("search_infm_params_text", F.lit(""))) == 0).alias("empty_filter"), km.alias("km"), F.col("twins").cast("double").alias("twins"), title.alias("title_coverage"))


def describe_positives(spark, folder):
    return _named(_described(spark, folder), "rnk", "hit", "words", "empty_filter", F.round("km", 6).alias("km"), "twins", F.round("title_coverage", 6).alias("title_coverage"))


def hits_vs_misses(spark, folder):
    """Medians of hits and misses and the effect size of misses against hits."""
    rows = durable(_described(spark, folder).withColumn("miss", ~F.col("hit")))
    out = None
    for name in ("words", "km", "twins", "title_coverage"):
        v = F.col(name).cast("double")
        medians = rows.agg(F.median(F.when(F.col("hit"), v)).alias("hits"), F.median(F.when(F.col("miss"), v)).alias("misses"))
        delta = metrics.cliffs_delta(rows, name, "miss").select("delta")
        part = medians.crossJoin(delta).select(F.lit(name).alias("feature"), *[F.round(c, 6).alias(c) for c in ("hits", "misses", "delta")])  # one row each
        out = part if out is None else out.unionAll(part)
    return out


def breakdown_by_distance(spark, folder):
    return metrics.breakdown(_described(spark, folder), "km", "hit", [1, 5, 25, 100, 500], least=5).select("bin", "n", F.round("share", 6).alias("share"))


def submission_build(spark, folder):
    queries = read_queries(spark, folder, ["query_id"]).withColumnRenamed("query_id", "query")
    return submission.build_submission(candidate_run(spark, folder).where("rnk <= 50"), queries)


def submission_validate(spark, folder):
    """Problems of the answers made of all candidates, however many."""
    answers = submission.build_submission(candidate_run(spark, folder))
    return submission.validate_submission(answers, read_queries(spark, folder, ["query_id"]), corpus(spark, folder, ["item_id"]))


def bootstrap_interval(spark, folder):
    """Mean recall at 10 and the interval of its resamples."""
    recalls = metrics.recall_per_query(candidate_run(spark, folder), relevant(spark, folder), 10)
    return metrics.bootstrap_interval(recalls, "query", "recall").select(*[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


def paired_interval(spark, folder):
    """The gain in recall at 10 of fusing over the lexical order."""
    truth = relevant(spark, folder)
    recalls = lambda weights: metrics.recall_per_query(fusion.fuse(candidates(spark, folder), weights, 10), truth, 10)
    return metrics.paired_interval(recalls({}), recalls(fusion.WEIGHTS), "query", "recall").select(*[F.round(c, 6).alias(c) for c in ("delta", "low", "high")])


#: The weights that a descent tries, signal by signal, and where it begins.
DESCENT = {
    "facet": (0.0, 0.01, 0.02, 0.05, 0.10, 0.20), "microcat": (0.0, 0.005, 0.01, 0.02, 0.05, 0.10),
    "dense": (0.0, 0.05, 0.1, 0.2, 0.35, 0.5, 0.8), "geo": (0.0, 0.02, 0.05, 0.10, 0.15, 0.20, 0.35),
}
START = {"geo": 0.10, "facet": 0.10, "microcat": 0.02, "dense": 0.0}


def weight_descent(spark, folder):
    """Coordinate descent of the weights by recall at 10: each signal's grid in one job over the kept components."""
    rows = candidates(spark, folder)
    rows = durable(rows.withColumn("lexical", F.col("lexical") / F.greatest(F.max("lexical").over(Window.partitionBy("query")), F.lit(1e-9))))
    return fusion.descend(rows, relevant(spark, folder), START, DESCENT, 10)


def lexical_grid(spark, folder):
    """Recall at 50 of the text search under 88 weightings, in one job."""
    from tessera.plans.experiments import lexical_grid as grid

    tables = chain.open_tables(spark, folder, dense=False)
    return grid(chain.lexical_index(tables), tables.asked(), relevant(spark, folder))


def random_items(spark, folder):
    """The control baseline of chance: fifty items drawn without replacement for each judged query."""
    items = corpus(spark, folder, ["item_id"])
    run = fusion.random_run(relevant(spark, folder).select("query").distinct(), items.select(F.col("item_id").alias("doc")), 50, 9)
    return _named(run, "rnk")


def weight_search(spark, folder):
    """Recall at 10 over a grid of weights, all points in one job over one table of components."""
    grid = [(i, g, f, d) for i, (g, f, d) in enumerate((g, f, d) for g in (0.0, 0.1, 0.3) for f in (0.0, 0.1) for d in (0.0, 0.5, 1.0))]
    points = F.array(*[F.struct(F.lit(i).alias("point"), F.lit(g).alias("wg"), F.lit(f).alias("wf"), F.lit(d).alias("wd")) for i, g, f, d in grid])
    rows = candidates(spark, folder).withColumn("lexical", F.col("lexical") / F.greatest(F.max("lexical").over(Window.partitionBy("query")), F.lit(1e-9)))
    each = rows.withColumn("p", F.explode(points)).withColumn("total", F.round(F.col("lexical") + F.col("p.wg") * F.col("geo") + F.col("p.wf") * F.col("facet") + F.col("p.wd") * F.col("dense"), 9))
    ranked = each.withColumn("rnk", F.row_number().over(Window.partitionBy("p.point", "query").orderBy(F.col("total").desc(), "doc"))).where("rnk <= 10")
    found = ranked.join(relevant(spark, folder), ["query", "doc"], "left_semi").groupBy("p", "query").agg(F.count(F.lit(1)).alias("hits"))
    sizes = relevant(spark, folder).groupBy("query").agg(F.count(F.lit(1)).alias("size"))
    n = sizes.count()
    best = found.join(sizes, "query").groupBy("p").agg((F.sum(F.col("hits") / F.col("size")) / n).alias("recall"))
    return best.select("p.wg", "p.wf", "p.wd", F.round("recall", 6).alias("recall"))


QUERIES = [
    search_centroids, item_centroids, geo_calibration, facet_calibration, geo_score, facet_score, dense_score, dense_topk, fuse_normalized, fuse_raw, fuse_rrf, collect_components, pad_nearest,
    nearest_items, recall_per_query, recall_curve, candidate_coverage, positive_ranks, describe_positives, hits_vs_misses, breakdown_by_distance, submission_build, submission_validate,
    bootstrap_interval, paired_interval, weight_search, weight_descent, lexical_grid, random_items,
]

_R = sql.real
CAND = "cand as (select query_id, item_id, " + ", ".join(f"coalesce(max({_R(s)}), 0) {s}" for s in [*SCORES, "total"]) + " from candidates where query_id is not null and item_id is not null group by all)"
RUN = f"{CAND}, run as (select query_id, item_id, row_number() over (partition by query_id order by total desc, item_id) rnk from cand), {sql.QRELS}"
CENTRE = f"centre as (select search_location_id location, median({_R('item_latitude')}) lat, median({_R('item_longitude')}) lon, count(*) n from train where search_location_id is not null group by 1)"
DRAWN = f"""numbered as (select *, row_number() over (order by {sql.shuffled("item_id", 3)}, item_id) - 1 slot from items),
drawn as (select pair_id, floor({sql.uniform("pair_id", 5)} * (select count(*) from items)) slot from train)"""
GEO = f"""{CENTRE}, {DRAWN},
gd as (select 'chosen' side, {sql.km("lat", "lon", _R("item_latitude"), _R("item_longitude"))} km from train join centre on location = search_location_id
  union all select 'random', {sql.km("lat", "lon", _R("n.item_latitude"), _R("n.item_longitude"))} from train t join centre on location = search_location_id join drawn d on d.pair_id = t.pair_id join numbered n using (slot)),
gh as (select side, {sql.bin_of("km", DISTANCE_EDGES)} bin, count(*) n from gd where km is not null group by all)"""
FACET = f"""fvoc as (select distinct unnest({sql.bare("item_infm_params_text")}) token from items),
pw as (select pair_id, list(token) wanted from (select pair_id, unnest({sql.bare("search_infm_params_text")}) token from train) where token in (select token from fvoc) group by pair_id),
fd as (select 'chosen' side, len(list_intersect(wanted, {sql.bare("item_infm_params_text")}))::double / len(wanted) share from pw join train using (pair_id)
  union all select 'random', len(list_intersect(wanted, {sql.bare("item_infm_params_text")}))::double / len(wanted) from pw join drawn using (pair_id) join numbered using (slot)),
fh as (select side, {sql.bin_of("share", FACET_EDGES)} bin, count(*) n from fd group by all)"""


def _ratio(h: str, bins: int, name: str) -> str:
    rate = lambda s: f"((coalesce((select n from {h} where side = '{s}' and bin = b), 0) + 20.0::double) / ((select coalesce(sum(n), 0) from {h} where side = '{s}') + 20.0::double * {bins}))"
    return f"{name} as (select b bin, ln({rate('chosen')} / {rate('random')}) score from (select unnest(range({bins})) b))"


_CURVES = f"{_ratio('gh', 17, 'gs')}, {_ratio('fh', 5, 'fs')}"
_QW = f"qw as (select query_id, list(token) wanted from (select query_id, unnest({sql.bare('search_infm_params_text')}) token from benchmark_queries) where token in (select token from fvoc) group by query_id)"
_PLACE = "place as (select query_id, lat qlat, lon qlon from benchmark_queries left join centre on location = search_location_id)"
_FINE = "coalesce(len({v}) = 64 and len(list_filter({v}, lambda x: x is null or ((x)::varchar = 'nan'))) = 0 and len(list_filter({v}, lambda x: x <> 0)) > 0, false)"
_ONE = "(select {i}, any_value(case when {fine} then {v}::double[] end) v from {t} where {i} is not null and {fine} group by 1)"
_VEC = "iv as " + _ONE.format(i="item_id", v="item_vector", t="item_vectors", fine=_FINE.format(v="item_vector")) + ", qv as " + _ONE.format(i="query_id", v="query_vector", t="query_vectors", fine=_FINE.format(v="query_vector"))
_KM = sql.km("qlat", "qlon", _R("item_latitude"), _R("item_longitude"))
_DTOP = "dtop as (select query_id, item_id, round(list_cosine_similarity(q.v, i.v), 12) cosine, row_number() over (partition by query_id order by round(list_cosine_similarity(q.v, i.v), 12) desc, item_id) rnk from qv q cross join iv i qualify rnk <= 20)"


def _signals(pairs: str) -> str:
    return f"""sig as (select p.*, coalesce(gs.score, 0) geo, coalesce(fs.score, 0) facet, coalesce(list_cosine_similarity(qv.v, iv.v), 0) dense, km from
  (select p.*, {_KM} km, case when wanted is not null then len(list_intersect(wanted, {sql.bare("item_infm_params_text")}))::double / len(wanted) end share
   from {pairs} p left join place using (query_id) left join items using (item_id) left join qw using (query_id)) p
  left join gs on gs.bin = {sql.bin_of("km", DISTANCE_EDGES)} left join fs on fs.bin = {sql.bin_of("share", FACET_EDGES)} left join qv using (query_id) left join iv using (item_id))"""


_RECALL10 = "select query_id, count(case when rnk <= 10 then 1 end)::double / count(*) r from rel left join {run} using (query_id, item_id) group by 1"


def _poisson(u: str) -> str:
    """The number of thresholds of the Poisson(1) distribution that a uniform number reaches."""
    total, out = 0.0, []
    for k in range(8):
        total += math.exp(-1) / math.factorial(k)
        out.append(f"({u} >= {total!r}::double)::int")
    return "(" + " + ".join(out) + ")"


def _interval(values: str, name: str) -> str:
    """The mean of a relation (query_id, r) and the interval of its 500 resamples."""
    return f"""select (select round(avg(r), 6) from {values}) "{name}", round(quantile_cont(m, 0.025), 6) low, round(quantile_cont(m, 0.975), 6) high from
(select b, sum(w * r) / nullif(sum(w), 0) m from (select b, r, {_poisson("u")} w from (select b, r, {sql.uniform("b || '|' || query_id", 0)} u from {values} cross join (select unnest(range(500)) b))) group by b) where m is not null"""


def _order_by(name: str, total: str) -> str:
    return f"{name} as (select query_id, item_id, row_number() over (partition by query_id order by round({total}, 9) desc, item_id) rnk from topped)"


def _descent() -> str:
    """Each step's recalls in a CTE that reads the weights chosen by the steps before."""
    steps, weight = [], {s: f"{w!r}::double" for s, w in START.items()}
    parts = [f"with {RUN}, comp as (select query_id, item_id, lexical / greatest(max(lexical) over (partition by query_id), 1e-9) lexical, geo, facet, microcat, dense from cand), size as (select query_id, count(*) size from rel group by 1)"]
    for n, (signal, grid) in enumerate(DESCENT.items(), 1):
        total = "lexical + " + " + ".join(f"{w} * {s}" for s, w in weight.items() if s != signal)
        parts.append(f"""t{n} as (select w, query_id, item_id, row_number() over (partition by w, query_id order by round({total} + w * {signal}, 9) desc, item_id) rnk from comp cross join (select unnest({list(grid)})::double w) qualify rnk <= 10),
f{n} as (select w, round(sum(1.0::double / size) / (select count(*) from size), 6) recall from t{n} join rel using (query_id, item_id) join size using (query_id) group by w),
r{n} as materialized (select w, coalesce(recall, 0) recall from (select unnest({list(grid)})::double w) left join f{n} using (w)), b{n} as materialized (select w from r{n} order by recall desc, w limit 1)""")
        weight[signal] = f"(select w from b{n})"
        steps.append(f"select {n}::bigint step, '{signal}' signal, w weight, recall, w = (select w from b{n}) chosen from r{n}")
    return ", ".join(parts) + " " + " union all ".join(steps)


_ALL = f"{GEO}, {FACET}, {_CURVES}, {_QW}, {_PLACE}, {_VEC}"
_SIGNED = f"with {sql.CORPUS}, {CAND}, {_ALL}, {_signals('(select query_id, item_id from cand)')}"
_TOP50 = "row_number() over (partition by query_id order by total desc, item_id)"
_DESC = f"""with {sql.CORPUS}, {RUN}, {CENTRE}, {_PLACE}, twin as (select {sql.norm("item_title_raw")} t, count(*) twins from items group by 1),
dsc as (select r.query_id, r.item_id, coalesce(rnk, -1) rnk, coalesce(rnk between 1 and 10, false) hit, {sql.words("search_query")} words, length(coalesce(search_infm_params_text, '')) = 0 empty_filter, {_KM} km, twins::double twins,
case when twins is not null then {sql.covered(sql.toks("search_query"), sql.toks("item_title_raw"))} end title_coverage
from rel r left join run using (query_id, item_id) left join benchmark_queries q using (query_id) left join items i using (item_id) left join twin on t = {sql.norm("item_title_raw")} left join place using (query_id))"""


def _effect(name: str) -> str:
    return f"""select '{name}' feature, round(median(case when hit then {name}::double end), 6) hits, round(median(case when not hit then {name}::double end), 6) misses,
round((select 2 * sum(case when m.v > h.v then 1.0::double when m.v = h.v then 0.5::double else 0 end) / nullif(count(*), 0) - 1 from (select {name} v from dsc where not hit and {name} is not null) m cross join (select {name} v from dsc where hit and {name} is not null) h), 6) delta from dsc"""


SQL = {
    "search_centroids": f"with {CENTRE} select location, round(lat, 7) lat, round(lon, 7) lon, n from centre",
    "item_centroids": f"with {sql.CORPUS} select item_location_id location, round(median({_R('item_latitude')}), 7) lat, round(median({_R('item_longitude')}), 7) lon, count(*) n from items where item_location_id is not null group by 1",
    "geo_calibration": f"with {sql.CORPUS}, {GEO} select side, bin::bigint bin, n from gh",
    "facet_calibration": f"with {sql.CORPUS}, {DRAWN}, {FACET} select side, bin::bigint bin, n from fh",
    "geo_score": f"{_SIGNED} select query_id, item_id, round(km, 6) km, round(geo, 6) geo from sig",
    "facet_score": f"{_SIGNED} select query_id, item_id, round(facet, 6) facet from sig",
    "dense_score": f"{_SIGNED} select query_id, item_id, round(dense, 6) dense from sig",
    "dense_topk": f"with {_VEC}, {_DTOP} select query_id, rnk, item_id, round(cosine, 6) cosine from dtop",
    "fuse_normalized": f"""with {CAND}, s as (select query_id, item_id, round(lexical / (case when max(lexical) over (partition by query_id) = 0 then 1 else max(lexical) over (partition by query_id) end) + 0.1::double * geo + 0.1::double * facet + 0.02::double * microcat + 0.5::double * dense, 9) total from cand)
select query_id, {_TOP50} rnk, item_id, round(total, 6) total from s qualify rnk <= 50""",
    "fuse_raw": f"""with {CAND}, s as (select query_id, item_id, round(lexical + 0.1::double * geo + 0.1::double * facet + 0.02::double * microcat + 0.5::double * dense, 9) total from cand)
select query_id, {_TOP50} rnk, item_id, round(total, 6) total from s qualify rnk <= 50""",
    "fuse_rrf": f"""with {CAND}, s as (select query_id, item_id, round({" + ".join(f"{w}::double / (60 + row_number() over (partition by query_id order by {c} desc, item_id) - 1)" for c, w in (("lexical", 1), ("geo", 0.1), ("facet", 0.1), ("microcat", 0.02), ("dense", 0.5)))}, 9) total from cand)
select query_id, {_TOP50} rnk, item_id, round(total, 6) total from s qualify rnk <= 50""",
    "collect_components": f"""with {INDEX}, {_ALL}, {_DTOP.replace("rnk <= 20", "rnk <= 1000")}, {sql.bayes("train", "pair_id", "search_query", "item_microcat_id", "benchmark_queries", "query_id", "search_query")},
pool as (select query_id, item_id, round(score, 9) lexical from lex union all select query_id, item_id, 0.0::double from dtop where (query_id, item_id) not in (select (query_id, item_id) from lex)), {_signals("pool")},
cshare as (select item_microcat_id c, count(*) n from items group by 1), ratio as (select k, c, lp - ln(coalesce(n, 1) / (select count(*)::double from items)) ratio from lp left join cshare using (c)),
csig as (select sig.*, coalesce(ratio, (select quantile_cont(ratio, 0.05) from ratio)) microcat from sig left join items using (item_id) left join ratio on k = query_id and c = item_microcat_id),
s as (select *, round(lexical / (case when max(lexical) over (partition by query_id) = 0 then 1 else max(lexical) over (partition by query_id) end) + 0.1::double * geo + 0.1::double * facet + 0.02::double * microcat + 0.5::double * dense, 9) total from csig)
select query_id, {_TOP50} rnk, item_id, {", ".join(f"round({c}, 5) {c}" for c in ("lexical", "geo", "facet", "microcat", "dense", "total"))} from s qualify rnk <= 50""",
    "pad_nearest": f"""with {sql.CORPUS}, {RUN}, {CENTRE}, {_PLACE}, top as (select * from run where rnk <= 50), have as (select query_id, qlat, qlon, coalesce(n, 0) n from place left join (select query_id, count(*) n from top group by 1) using (query_id)),
near as (select query_id, item_id, n, row_number() over (partition by query_id order by round({_KM}, 12), item_id) + n rnk from have cross join items where n < 50 and {_KM} is not null and (query_id, item_id) not in (select (query_id, item_id) from top))
select query_id, rnk, item_id from top union all select query_id, rnk, item_id from near where rnk <= 50""",
    "nearest_items": f"""with {sql.CORPUS}, {CENTRE}, {_PLACE}, near as (select query_id, item_id, round({_KM}, 12) km from place cross join items where {_KM} is not null)
select query_id, row_number() over (partition by query_id order by km, item_id) rnk, item_id, round(km, 6) km from near qualify rnk <= 50""",
    "recall_per_query": f"with {RUN} select query_id, round(count(case when rnk <= 50 then 1 end)::double / count(*), 6) recall from rel left join run using (query_id, item_id) group by 1",
    "recall_curve": f"""with {RUN}, each as (select k, query_id, count(case when rnk <= k then 1 end)::double / count(*) r from rel left join run using (query_id, item_id) cross join (select unnest([1, 5, 10, 20, 50, 100, 200, 500, 1000]) k) group by all)
select k::bigint k, round(avg(r), 6) recall from each group by 1""",
    "candidate_coverage": f"with {RUN}, each as (select query_id, count(rnk)::double / count(*) r from rel left join run using (query_id, item_id) group by 1) select round(avg(r), 6) coverage, count(*) queries from each",
    "positive_ranks": f"with {RUN} select query_id, item_id, coalesce(rnk, -1) rnk from rel left join run using (query_id, item_id)",
    "describe_positives": f"{_DESC} select query_id, item_id, rnk, hit, words, empty_filter, round(km, 6) km, twins, round(title_coverage, 6) title_coverage from dsc",
    "hits_vs_misses": f"{_DESC} " + " union all ".join(_effect(n) for n in ("words", "km", "twins", "title_coverage")),
    "breakdown_by_distance": f"{_DESC} select ({' + '.join(f'(km >= {e})::bigint' for e in (1, 5, 25, 100, 500))})::bigint bin, count(*) n, round(avg(hit::int), 6) share from dsc where km is not null group by 1 having count(*) >= 5",
    "submission_build": f"""with {RUN}, l as (select query_id, string_agg(item_id, ' ' order by rnk) answer from run where rnk <= 50 group by 1)
select query_id, coalesce(answer, '') answer from (select distinct query_id from benchmark_queries) left join l using (query_id)""",
    "submission_validate": f"""with {sql.CORPUS}, {RUN}, l as (select query_id, count(*) n, count(distinct item_id) d from run group by 1), ids as (select distinct item_id from run),
p as (select 'missing_queries' problem, count(*) n from benchmark_queries where query_id not in (select query_id from l)
union all select 'unknown_queries', count(*) from l where query_id not in (select query_id from benchmark_queries) union all select 'bad_query_length', count(*) from l where length(query_id) <> 16
union all select 'too_many_items', count(*) from l where n > 50 union all select 'repeated_items', count(*) from l where n <> d
union all select 'malformed_items', count(*) from ids where not regexp_full_match(item_id, '[0-9a-f]{{16}}') union all select 'items_outside_corpus', count(*) from ids where item_id not in (select item_id from items))
select problem, n from p where n > 0""",
    "bootstrap_interval": f"with {RUN}, v as ({_RECALL10.format(run='run')}) {_interval('v', 'mean')}",
    "paired_interval": f"""with {RUN}, topped as (select *, case when max(lexical) over (partition by query_id) = 0 then 1 else max(lexical) over (partition by query_id) end top from cand), {_order_by("lex_run", "lexical / top")}, {_order_by("all_run", "lexical / top + 0.1::double * geo + 0.1::double * facet + 0.02::double * microcat + 0.5::double * dense")},
v as (select query_id, a.r - b.r r from ({_RECALL10.format(run="all_run")}) a join ({_RECALL10.format(run="lex_run")}) b using (query_id)) {_interval("v", "delta")}""",
    "weight_descent": _descent(),
    "lexical_grid": f"""with {INDEX}, {sql.QRELS}, h as (select query_id, item_id, term, any_value(idf) idf, {", ".join(f"sum(case when field = '{f}' then tf / (1 - b + b * len / a) else 0 end) {c}" for f, c in (("title", "t"), ("params", "p"), ("description", "d")))}
  from qt join post using (term) join len using (item_id, field) join av using (field) join par using (field) join idf using (term) group by all),
g as (select gt, gp, gd, 1.2::double gk from (select unnest([1, 2, 3, 5, 8, 20, 40])::double gt) cross join (select unnest([0, 0.1, 0.25, 0.5])::double gp) cross join (select unnest([0.5, 1, 2])::double gd) union all select 20, 0.5, 1, unnest([0.6, 0.9, 1.6, 2.2])::double),
sc as (select gt, gp, gd, gk, query_id, item_id, round(sum(idf * (gt * t + gp * p + gd * d) / (gk + gt * t + gp * p + gd * d)), 9) s from h cross join g group by all),
rk as (select *, row_number() over (partition by gt, gp, gd, gk, query_id order by s desc, item_id) r from sc qualify r <= 50), size as (select query_id, count(*) size from rel group by 1),
hit as (select gt, gp, gd, gk, sum(1.0::double / size) v from rk join rel using (query_id, item_id) join size using (query_id) where s > 0 group by all)
select gt title, gp params, gd description, gk k1, round(coalesce(v, 0) / (select count(*) from size), 6)::double recall from g left join hit using (gt, gp, gd, gk)""",
    "random_items": f"""with {sql.CORPUS}, {sql.QRELS}, ids as (select distinct item_id from items), nd as (select count(*) n from ids), placed as (select item_id, row_number() over (order by {sql.shuffled("item_id", 9)}, item_id) - 1 slot from ids),
st as (select min(s) step from (select unnest(range(greatest(1, floor(n * 0.618::double)::bigint), n + 2)) s, n from nd) where gcd(s, n) = 1),
d as (select query_id, i + 1 rnk, (floor({sql.uniform("query_id", 9)} * n)::bigint + i * step) % n slot from (select distinct query_id from rel) cross join nd cross join st cross join (select unnest(range(50)) i) where i < n)
select query_id, rnk, item_id from d join placed using (slot)""",
    "weight_search": f"""with {RUN}, s as (select query_id, item_id, lexical / greatest(max(lexical) over (partition by query_id), 1e-9) lexical, geo, facet, dense from cand),
g as (select unnest([0.0, 0.1, 0.3])::double wg), f as (select unnest([0.0, 0.1])::double wf), d as (select unnest([0.0, 0.5, 1.0])::double wd),
t as (select wg, wf, wd, query_id, item_id, row_number() over (partition by wg, wf, wd, query_id order by round(lexical + wg * geo + wf * facet + wd * dense, 9) desc, item_id) rnk from s cross join g cross join f cross join d qualify rnk <= 10),
size as (select query_id, count(*) size from rel group by 1), h as (select wg, wf, wd, query_id, count(*) hits from t join rel using (query_id, item_id) group by all)
select wg, wf, wd, round(sum(hits::double / size) / (select count(*) from size), 6) recall from h join size using (query_id) group by all""",
}


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return SQL

"""What the commands run: reports, a local benchmark and the measurements on it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import params
from tessera.functions.geo import haversine, number
from tessera.functions.text import coverage, normalize, tokens, word_count
from tessera.operators import benchmark, fusion, metrics, rerank
from tessera.operators.exact import nearest_places
from tessera.operators.index import FIELDS, K1, Field
from tessera.operators.signals import item_places
from tessera.operators.termblocks import places_by_weighting
from tessera.plans import chain, models, reports
from tessera.session import durable
from tessera.sources.tables import load_keys, read_items, read_pairs, read_queries, save_keys, save_tables, write_report, write_table_csv

#: The boosts and saturations that the lexical grid tries.
TITLE_GRID = (1.0, 2.0, 3.0, 5.0, 8.0, 20.0, 40.0)
PARAMS_GRID = (0.0, 0.1, 0.25, 0.5)
DESCRIPTION_GRID = (0.5, 1.0, 2.0)
K1_GRID = (0.6, 0.9, 1.2, 1.6, 2.2)

EDA = {
    "query_item_counts": reports.query_item_counts, "overlap": reports.overlap_report, "truncation": reports.truncation_report, "location_match": reports.location_match, "distance": reports.distance_report,
    "facets": reports.facet_report, "microcat_concentration": reports.microcat_concentration, "microcat_accuracy": models.microcat_accuracy, "selection_bias": reports.selection_bias, "shift": reports.shift_report,
    "duplicates": reports.duplicate_report, "filter_ceiling": reports.filter_ceiling, "filter_survivors": reports.filter_survivors,
}


def eda(spark: SparkSession, folder: str, out: str, names: Sequence[str] = tuple(EDA)) -> dict:
    """All reports on the tables of ``folder``, as one JSON file at ``out``."""
    return write_report(spark, {name: EDA[name](spark, folder) for name in names}, out)


def split(spark: SparkSession, folder: str, out: str, seen_share: float = reports.SEEN, seed: int = 42, sanity: bool = True) -> dict:
    """Builds a local benchmark, checks it for leaks, saves it at ``out`` and measures the control baselines on it."""
    pairs = read_pairs(spark, folder)
    made = benchmark.build_local(pairs, read_queries(spark, folder), reports._n_queries(spark, folder), reports._corpus_size(spark, folder), seen_share, seed)
    made.save(out)
    local = benchmark.LocalBenchmark.load(spark, out)
    leaks = {r["problem"]: r["n"] for r in benchmark.leakage_checks(local.tables(), seen_share).collect()}
    if leaks:
        raise ValueError(f"the benchmark leaks: {leaks}")
    found = {"meta": local.meta, "sizes": {n: df.count() for n, df in local.tables().items()}}
    return found | ({"baselines": [r.asDict() for r in baselines(local, pairs).collect()]} if sanity else {})


def truth(local: benchmark.LocalBenchmark) -> DataFrame:
    return local.qrels.select(F.col("query_id").alias("query"), F.col("item_id").alias("doc"))


def baselines(local: benchmark.LocalBenchmark, pairs: DataFrame, k: int = 50) -> DataFrame:
    """(run, mean, low, high): recall of k random and of the k nearest items."""
    items = local.corpus_items(pairs, ["item_latitude", "item_longitude"])
    t = chain.Tables(local.fitted(pairs), items, local.queries)
    near = nearest_places(chain.places(t).where("qlat is not null"), item_places(items).where("ilat is not null and ilon is not null"), k)
    runs = {"random": fusion.random_run(local.queries.select(F.col("query_id").alias("query")), items.select(F.col("item_id").alias("doc")), k, 9), "nearest": near.select("query", "rnk", "doc")}
    return _recalls(runs, truth(local), k)


def _recalls(runs: dict[str, DataFrame], relevant: DataFrame, k: int) -> DataFrame:
    parts = [metrics.bootstrap_interval(metrics.recall_per_query(run, relevant, k), "query", "recall").select(F.lit(name).alias("run"), "mean", "low", "high") for name, run in runs.items()]
    return reduce(DataFrame.unionAll, parts)


@dataclass(frozen=True)
class Bench:
    """A local benchmark with the tables that the chain reads."""

    local: benchmark.LocalBenchmark
    tables: chain.Tables
    truth: DataFrame


def open_bench(spark: SparkSession, folder: str, saved: str) -> Bench:
    """A benchmark saved by ``split``; vectors of local queries are used where the vector tables have their ids."""
    local = benchmark.LocalBenchmark.load(spark, saved)
    if local is None:
        raise FileNotFoundError(f"no benchmark in {saved}: run split first")
    like = chain.open_tables(spark, folder, parse=True)
    t = chain.local_tables(local, read_pairs(spark, folder, description=True), like)
    if like.query_vectors is not None and like.query_vectors.join(local.query_ids(), "query_id", "left_semi").isEmpty():
        t = replace(t, query_vectors=None, item_vectors=None)
    return Bench(local, t, truth(local))


def lexical_grid(index, asked: DataFrame, relevant: DataFrame, k: int = 50, points: Sequence[tuple[float, float, float, float]] | None = None) -> DataFrame:
    """(title, params, description, k1, recall): recall of the text search under each weighting, in one job.

    A document's contributions of a term are kept by field, so a weighting is an expression over
    them; a relevant item's place is the count of the query's items that come before it,
    which blocks of documents count by themselves: no pair of query and item is ever stored.
    """
    grid = list(points or [*((a, b, c, K1) for a in TITLE_GRID for b in PARAMS_GRID for c in DESCRIPTION_GRID), *((FIELDS[0].boost, FIELDS[1].boost, FIELDS[2].boost, x) for x in K1_GRID if x != K1)])
    names = [f.name for f in FIELDS]
    _, norm = replace(index, fields=FIELDS)._norm(index.averages())
    wanted = durable(asked_terms(index, asked))
    terms = wanted.select("term", "idf").distinct()
    of_term = index.postings.join(terms.select("term"), "term", "left_semi").groupBy("doc", "term").agg(*[F.sum(F.when(F.col("field") == n, F.col("tf") / norm).otherwise(0.0)).alias(n) for n in names]).join(terms, "term")
    held = of_term.groupBy("doc").agg(F.collect_list(F.struct("term", "idf", *names)).alias("x")).select("doc", F.col("x.term").alias("terms"), *[F.col(f"x.{c}").alias(c) for c in ("idf", *names)])
    judged = wanted.join(relevant.select("query").distinct(), "query", "left_semi").select("query", "term")
    mine = places_by_weighting(durable(held), judged, relevant, index.size(), grid)
    # A weighting that gives a pair nothing hasn't found it.
    placed = mine.select("query", F.transform(F.arrays_zip("before", "own"), lambda z: ((z["before"] < k) & (z["own"] > 0)).cast("double")).alias("hit"))
    sizes = relevant.groupBy("query").agg(F.count(F.lit(1)).alias("size"))
    n = sizes.count()
    total = placed.join(sizes, "query").agg(F.array(*[F.round(F.coalesce(F.sum(F.col("hit")[i] / F.col("size")), F.lit(0.0)) / max(n, 1), 6) for i in range(len(grid))]).alias("r"))
    rows = F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(p, ("title", "params", "description", "k1"), strict=True)], F.col("r")[i].alias("recall")) for i, p in enumerate(grid)])
    return total.select(F.explode(rows).alias("x")).select("x.*")


def asked_terms(index, asked: DataFrame) -> DataFrame:
    """(query, term, idf) of the known terms."""
    from tessera.operators.index import query_terms

    return query_terms(asked).join(index.vocabulary.select("term", "idf"), "term")


def baseline(spark: SparkSession, folder: str, saved: str, grid: bool = True) -> dict[str, DataFrame]:
    """Text search on a local benchmark: its recall with and without the filter behind the words, its curve, and the grid of weights."""
    b = open_bench(spark, folder, saved)
    index = chain.lexical_index(b.tables)
    runs = {"text": index.search(b.tables.asked(), 1000), "text+filter": index.search(b.tables.asked(True), 50)}
    runs = {n: durable(df) for n, df in runs.items()}
    out = {"recall": _recalls(runs, b.truth, 50), "curve": metrics.recall_curve(runs["text"], b.truth)}
    if grid:
        out["grid"] = lexical_grid(index, b.tables.asked(), b.truth).orderBy(F.desc("recall"), "title", "params", "description", "k1")
    return out


def fuse(spark: SparkSession, folder: str, saved: str, start: dict[str, float], grids: dict[str, Sequence[float]]) -> dict[str, DataFrame]:
    """Weights by coordinate descent on a local benchmark, over one table of components; each step's recalls."""
    b = open_bench(spark, folder, saved)
    index = chain.lexical_index(b.tables)
    every = {**dict.fromkeys(grids, 1.0), **{n: 1.0 for n in start}}
    found = chain.all_signals(b.tables, every)
    rows = index.scores(b.tables.asked()).select("query", "doc", F.round("score", 9).alias("lexical"))
    for signal in found:
        rows = signal.apply(rows)
    top = rows.groupBy("query").agg(F.max("lexical").alias("__top"))
    rows = durable(rows.join(top, "query").withColumn("lexical", F.col("lexical") / F.greatest("__top", F.lit(1e-9))).drop("__top"))
    names = {s.name for s in found}
    steps = fusion.descend(rows, b.truth, {n: w for n, w in start.items() if n in names}, {n: g for n, g in grids.items() if n in names}, 50)
    chosen = dict(start) | {r["signal"]: r["weight"] for r in steps.where("chosen").collect()}
    total = sum((F.lit(chosen[n]) * F.col(n) for n in sorted(names)), F.col("lexical"))
    before = sum((F.lit(start[n]) * F.col(n) for n in sorted(names & set(start))), F.col("lexical"))
    run = lambda score: durable(chain.best(rows.select("query", "doc", F.round(score, 9).alias("total")), "total", 1000).select("query", "rnk", "doc"))
    now, then = run(total), run(before)
    recall = lambda r: metrics.recall_per_query(r, b.truth, 50)
    return {"steps": steps, "recall": _recalls({"chosen": now, "start": then}, b.truth, 50), "gain": metrics.paired_interval(recall(then), recall(now), "query", "recall"), "curve": metrics.recall_curve(now, b.truth)}


def donor_set(spark: SparkSession, folder: str, saved: str, out: str, n_queries: int = 40_000, seed: int = 7) -> dict:
    """Donor queries whose share of seen positives is that of the held-out ones, saved as tables with what they were made by."""
    b = open_bench(spark, folder, saved)
    keyed = benchmark.with_query_id(read_pairs(spark, folder))
    held = keyed.join(b.local.donor, "query_id", "left_semi").join(b.local.corpus, "item_id", "left_semi")
    fit = b.local.fit_pairs.select("item_id").distinct()
    seen = b.local.qrels.join(fit.withColumn("f", F.lit(1)), "item_id", "left").agg((F.count("f") / F.count(F.lit(1))).alias("s")).first()["s"] or 0.0
    chosen = durable(benchmark.match_donors(held, fit, seen, n_queries, seed))
    first = benchmark.first_rows(keyed, "query_id", [c for c in benchmark.QUERY_COLUMNS])
    queries = chosen.select("query_id").join(first, "query_id")
    relevant = held.join(chosen.select("query_id"), "query_id", "left_semi").select("query_id", "item_id").distinct()
    meta = {"n_queries": n_queries, "seed": seed, "seen_share": round(seen, 6)}
    save_tables({"queries": queries, "relevant": relevant}, out, meta)
    return meta | {"queries": chosen.count()}


def rerank_on(spark: SparkSession, folder: str, saved: str, model: str | None = None, depth: int = chain.RERANK_DEPTH, k: int = 50, **how) -> dict[str, DataFrame]:
    """Recall of the summed order, the re-ranked one with and without item priors, and the pool's ceiling; the model is saved if asked for."""
    b = open_bench(spark, folder, saved)
    index = chain.lexical_index(b.tables)
    pool = durable(chain.collected(b.tables, index, depth))
    rows = durable(chain.feature_rows(b.tables, index, pool, b.truth))
    plain = [f for f in models.features.FEATURES if f not in models.features.PRIORS]
    prior = pool.select("query", "doc", "rnk")
    runs = {"sum": prior.select("query", "rnk", "doc"), "ceiling": rerank.ranked(rows.select("query", "doc", F.col("label").cast("double").alias("score")), k, prior)}
    for name, used in (("all", models.features.FEATURES), ("without_priors", plain)):
        runs[name] = rerank.ranked(durable(rerank.cross_validate(rows, features=used, **how)), k, prior)
    if model:
        rerank.save_model(rerank.train(rows, **how), model, "all", models.features.FEATURES)
    return {"recall": _recalls(runs, b.truth, k)}


def errors(spark: SparkSession, folder: str, saved: str, out: str, model: str | None = None, k: int = 50) -> dict[str, DataFrame]:
    """Where the relevant items went: each with what may explain its place, as one CSV file, and hits beside misses."""
    b = open_bench(spark, folder, saved)
    t, index = b.tables, chain.lexical_index(b.tables)
    pool = durable(chain.collected(t, index, chain.RERANK_DEPTH))
    found = rerank.load_model(spark, model) if model else None
    run = pool.select("query", "rnk", "doc")
    if found:
        rows = chain.feature_rows(t, index, pool, b.truth)
        run = rerank.ranked(rerank.predict(found[0], rows, found[1]), chain.RERANK_DEPTH, run.select("query", "doc", "rnk"))
    described = durable(describe(t, durable(run), b.truth, k))
    write_table_csv(described, out)
    rows = described.withColumn("miss", ~F.col("hit"))
    out_ = {"places": described.agg(F.count(F.lit(1)).alias("relevant"), F.sum(F.col("hit").cast("bigint")).alias("top"), F.sum(((F.col("rnk") > 0) & ~F.col("hit")).cast("bigint")).alias("deeper"), F.sum((F.col("rnk") < 0).cast("bigint")).alias("outside"))}
    deltas = [metrics.cliffs_delta(rows, c, "miss").select(F.lit(c).alias("feature"), "delta") for c in ("words", "km", "twins", "title_coverage")]
    out_["effects"] = reduce(DataFrame.unionAll, deltas)
    for name, edges in {"km": (1, 5, 25, 100, 500), "title_coverage": (1e-9, 0.5, 0.999), "twins": (2.0, 5.0, 20.0, 100.0)}.items():
        out_[f"by_{name}"] = metrics.breakdown(rows, name, "hit", edges)
    return out_


def describe(t: chain.Tables, run: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Each relevant item with its place (-1 for none) and what may explain it."""
    ranks = metrics.positive_ranks(run, relevant).withColumn("hit", F.col("rnk").between(1, k))
    texts = t.queries.select(F.col("query_id").alias("query"), "search_query", "search_infm_params_text")
    titled = t.corpus("item_id", "item_title_raw", "item_latitude", "item_longitude").withColumn("t", normalize("item_title_raw"))
    twins = titled.groupBy("t").agg(F.count(F.lit(1)).cast("double").alias("twins"))
    joined = ranks.join(texts, "query", "left").join(titled.join(twins, "t").withColumnRenamed("item_id", "doc"), "doc", "left").join(chain.places(t), "query", "left")
    km = haversine(F.col("qlat"), F.col("qlon"), number("item_latitude"), number("item_longitude"))
    title = F.when(F.col("t").isNotNull(), coverage(tokens("search_query"), tokens("item_title_raw")))
    return joined.select("query", "doc", "rnk", "hit", word_count("search_query").alias("words"), (F.length(F.coalesce("search_infm_params_text", F.lit(""))) == 0).alias("empty_filter"), km.alias("km"), "twins", title.alias("title_coverage"))


def param_keys(spark: SparkSession, folder: str, pinned: str | None = None, sample: int = params.SAMPLE, seed: int = 0, write: str | None = None) -> dict:
    """Keys found afresh beside the pinned ones: how many, what each parses from the first word on, and what only one has."""
    items = read_items(spark, folder, ["item_id", "item_infm_params_text"]).where("item_id is not null").distinct().where(F.length(F.trim(F.coalesce("item_infm_params_text", F.lit("")))) > 0)
    known = load_keys(spark, pinned) if pinned else list(chain.open_tables(spark, folder, False, True).keys)
    fresh = params.discover_parser(items, "item_id", "item_infm_params_text", sample=sample, seed=seed)
    whole = lambda keys: items.agg(F.avg((params.key_coverage("item_infm_params_text", keys) == 1).cast("double")).alias("c")).first()["c"]
    if write:
        save_keys(spark, fresh, write)
    return {"pinned": len(known), "fresh": len(fresh), "pinned_coverage": whole(known), "fresh_coverage": whole(fresh), "only_fresh": sorted(set(fresh) - set(known)), "only_pinned": sorted(set(known) - set(fresh))}


def fields_of(title: float, params_: float, description: float) -> tuple[Field, ...]:
    return tuple(replace(f, boost=b) for f, b in zip(FIELDS, (title, params_, description), strict=True))

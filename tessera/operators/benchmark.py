"""Local benchmarks without leaks: raked sampling, donor cut, corpus and checks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.keys import QUERY_COLUMNS, composite_key, short_id, shuffled, uniform
from tessera.functions.text import word_count
from tessera.operators.selection import hex_value, least
from tessera.session import durable
from tessera.sources.tables import ITEM_FIELDS, load_tables, save_tables

MATCHED = ("location", "empty_filter", "words")
MOST_CELLS = 1_000_000


def with_query_id(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("query_id", short_id(composite_key()))


def descriptors(queries: DataFrame) -> DataFrame:
    """``queries`` plus location, empty_filter and words (up to 6) as text."""
    empty = F.length(F.coalesce("search_infm_params_text", F.lit(""))) == 0
    return queries.withColumns({"location": F.coalesce(F.col("search_location_id").cast("string"), F.lit("")), "empty_filter": empty.cast("string"), "words": F.least(word_count("search_query"), F.lit(6)).cast("string")})


def target_marginals(queries: DataFrame, columns: Sequence[str] = MATCHED) -> DataFrame:
    """(column, value, share) of described queries."""
    each = queries.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])).alias("x")).groupBy("x.column", "x.value").agg(F.count(F.lit(1)).alias("n"))
    return each.select("column", "value", (F.col("n") / F.sum("n").over(Window.partitionBy("column"))).alias("share"))


def rake(cells: dict[tuple, float], targets: dict[int, dict[str, float]], rounds: int = 30) -> dict[tuple, float]:
    """Weight of a single row of each cell so that all marginals fit; ``cells`` has their row counts.

    Cells with a value outside a target get 0; if none is left, ValueError.
    """
    weight = {c: 1.0 if all(c[i] in t for i, t in targets.items()) else 0.0 for c in cells}
    if not any(w * cells[c] for c, w in weight.items()):
        raise ValueError("no query fits the target distribution")
    for _ in range(rounds):
        for i, target in targets.items():
            total = sum(w * cells[c] for c, w in weight.items())
            now: dict[str, float] = {}
            for c, w in weight.items():
                now[c[i]] = now.get(c[i], 0.0) + w * cells[c]
            for c in weight:
                if c[i] in target and now[c[i]] > 0:
                    weight[c] *= target[c[i]] * total / now[c[i]]
    return weight


def raking_weights(pool: DataFrame, targets: DataFrame, columns: Sequence[str] = MATCHED) -> DataFrame:
    """``pool`` plus weight. Weights depend on the cell only, so just the distinct cells come
    to the driver (values of the matched columns multiplied, refused above ``MOST_CELLS``)."""
    rows = pool.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).limit(MOST_CELLS + 1).collect()
    if len(rows) > MOST_CELLS:
        raise ValueError("too many cells")
    wanted: dict[int, dict[str, float]] = {i: {} for i in range(len(columns))}
    for r in targets.collect():
        wanted[list(columns).index(r["column"])][r["value"]] = r["share"]
    weights = rake({tuple(r[c] for c in columns): r["n"] for r in rows}, wanted)
    schema = ", ".join([*(f"{c} string" for c in columns), "weight double"])
    return pool.join(pool.sparkSession.createDataFrame([(*k, w) for k, w in sorted(weights.items())], schema), list(columns))


def sample_weighted(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement with chances by ``weight``: the least exponential races. Too few raise ValueError."""
    eligible = rows.where("weight > 0")
    if eligible.count() < n:
        raise ValueError(f"fewer than {n} eligible queries")
    race = F.round(-F.log(uniform(F.col(key), seed)) / F.col("weight"), 12)
    return least(eligible.withColumn("race", race), "race", [key], n).drop("race")


def sample_rows(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement, all with the same chance: the first in the hash order of their key."""
    placed = rows.withColumn("__o", shuffled(F.col(key), seed))
    return least(placed.withColumn("__v", hex_value(F.col("__o"))), "__v", ["__o", key], n).drop("__o", "__v")


def donor_cut(pairs: DataFrame, needed: int, seed: int) -> DataFrame:
    """(query_id) of the donor: whole queries in a random order until ``needed`` items have no pair left.

    An item is free when its last query goes, so the cut is the needed-th smallest of the
    items' last places; nothing is walked through. All queries go if there aren't as many items.
    """
    placed = pairs.select("query_id", "item_id", shuffled(F.col("query_id"), seed).alias("o"))
    if needed <= 0:
        return placed.select("query_id").limit(0)
    freed = placed.groupBy("item_id").agg(F.max("o").alias("last")).withColumn("v", hex_value(F.col("last")))
    cut = least(freed, "v", ["last"], needed).agg(F.max("last").alias("cut"))
    return placed.select("query_id", "o").distinct().join(F.broadcast(cut), F.col("o") <= F.col("cut")).select("query_id")  # one row


def match_donors(positives: DataFrame, fit_items: DataFrame, target: float, n: int, seed: int) -> DataFrame:
    """(query_id, seen, unseen): donor queries whose share of seen positives is near ``target``.

    All queries with a seen positive, at most n // 3 of them, set the scale; others are
    added in a random order while unseen positives are short and fewer than n are chosen.
    Running sums go over hash buckets, so no task walks through all queries.
    """
    flags = positives.select("query_id", "item_id").distinct().join(fit_items.select("item_id").distinct().withColumn("f", F.lit(1)), "item_id", "left")
    per = flags.groupBy("query_id").agg(F.count("f").alias("seen"), (F.count(F.lit(1)) - F.count("f")).alias("unseen")).withColumn("o", shuffled(F.col("query_id"), seed))
    head = least(per.where("seen > 0").withColumn("v", hex_value(F.col("o"))), "v", ["o", "query_id"], max(1, n // 3))
    got = head.agg(F.coalesce(F.sum("seen"), F.lit(0)).alias("s"), F.coalesce(F.sum("unseen"), F.lit(0)).alias("u"), F.count(F.lit(1)).alias("n")).first()
    needed = got["s"] * (1 - target) / target - got["u"] if target > 0 else float("inf")
    rest = per.where("seen = 0").withColumn("b", F.substring("o", 1, 3))
    sums = rest.groupBy("b").agg(F.sum("unseen").alias("u"), F.count(F.lit(1)).alias("c"))
    upto = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("b", F.coalesce(F.sum("u").over(upto), F.lit(0)).alias("bu"), F.coalesce(F.sum("c").over(upto), F.lit(0)).alias("bc"))
    inside = Window.partitionBy("b").orderBy("o", "query_id").rowsBetween(Window.unboundedPreceding, -1)
    walked = rest.withColumns({"iu": F.coalesce(F.sum("unseen").over(inside), F.lit(0)), "ic": F.count(F.lit(1)).over(inside)}).join(F.broadcast(before), "b")  # at most 4096 rows
    tail = walked.where((F.lit(float(needed)) - F.col("bu") - F.col("iu") > 0) & (F.lit(got["n"]) + F.col("bc") + F.col("ic") < n))
    return head.select("query_id", "seen", "unseen").unionAll(tail.select("query_id", "seen", "unseen"))


def build(pairs: DataFrame, queries: DataFrame, n_queries: int, corpus_size: int, seen_share: float, seed: int = 42) -> dict[str, DataFrame]:
    """Tables queries, qrels, corpus, fit_pairs and donor of a local benchmark.

    Held-out queries follow the marginals of ``queries``; their pairs are the qrels. Donor
    queries leave the fit until enough items are unseen; the corpus has all positives and
    seen and unseen items filled up to ``corpus_size`` in the wanted share.
    """
    # Ids, held-out queries, donor and corpus are each read many times, so they are computed once.
    keyed = durable(with_query_id(pairs).select("pair_id", "query_id", "item_id", *QUERY_COLUMNS))
    pool = durable(descriptors(keyed.select("query_id", *QUERY_COLUMNS).distinct()))
    weighted = raking_weights(pool, target_marginals(descriptors(queries)))
    held = durable(sample_weighted(durable(weighted), "query_id", n_queries, seed).select("query_id", *QUERY_COLUMNS))
    truth = keyed.join(held.select("query_id"), "query_id", "left_semi").select("query_id", "item_id").distinct()
    free = keyed.join(held.select("query_id"), "query_id", "left_anti")
    seen_target = round(seen_share * corpus_size)
    donor = durable(donor_cut(free, corpus_size - seen_target, seed))
    fit = durable(free.select("pair_id", "query_id", "item_id").join(donor, "query_id", "left_anti"))
    positives = truth.select("item_id").distinct()
    fit_items = fit.select("item_id").distinct()
    from_positives = positives.join(fit_items, "item_id", "left_semi").count()
    n_positives = positives.count()
    pick = lambda df, n: sample_rows(df, "item_id", n, seed)
    seen_pool = fit_items.join(positives, "item_id", "left_anti")
    seen_n = min(max(0, seen_target - from_positives), seen_pool.count())
    unseen_pool = free.select("item_id").distinct().join(fit_items, "item_id", "left_anti").join(positives, "item_id", "left_anti")
    unseen_n = corpus_size - n_positives - seen_n
    if unseen_n > unseen_pool.count():
        raise ValueError("not enough unseen items: raise seen_share or lower corpus_size")
    items = durable(positives.unionAll(pick(seen_pool, seen_n)).unionAll(pick(unseen_pool, unseen_n)))
    return {"queries": held, "qrels": truth, "corpus": items, "fit_pairs": fit.select("pair_id", "query_id", "item_id"), "donor": donor}


def first_rows(pairs: DataFrame, key: str, columns: Sequence[str], order: str = "pair_id") -> DataFrame:
    """(key, the columns) of each key's first row by ``order``; only the least row of a task's own travels."""
    rows = pairs.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.min_by(F.struct(*columns), order).alias("__r"))
    return rows.select(F.col("__k").alias(key), *[F.col(f"__r.{c}").alias(c) for c in columns])


PARTS = ("queries", "qrels", "corpus", "fit_pairs", "donor")


@dataclass(frozen=True)
class LocalBenchmark:
    """A built benchmark: held-out queries and their qrels, the corpus' ids, the pairs that may be learnt from, the donor."""

    queries: DataFrame
    qrels: DataFrame
    corpus: DataFrame
    fit_pairs: DataFrame
    donor: DataFrame
    meta: dict

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in PARTS}

    def query_ids(self) -> DataFrame:
        return self.queries.select("query_id")

    def corpus_items(self, pairs: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
        """The corpus with the columns of each item's first pair; an item without one raises KeyError."""
        wanted = [c for c in columns or ITEM_FIELDS if c != "item_id" and c in pairs.columns]
        lost = self.corpus.join(pairs.select("item_id").distinct(), "item_id", "left_anti").count()
        if lost:
            raise KeyError(f"{lost} items of the corpus have no pair")
        return self.corpus.select("item_id").distinct().join(first_rows(pairs, "item_id", wanted), "item_id")

    def fitted(self, pairs: DataFrame) -> DataFrame:
        """The pairs that may be learnt from: without held-out and donor queries."""
        return pairs.join(self.fit_pairs.select("pair_id"), "pair_id", "left_semi")

    def save(self, folder: str) -> None:
        save_tables(self.tables(), folder, self.meta)

    @classmethod
    def load(cls, spark: SparkSession, folder: str, meta: dict | None = None) -> LocalBenchmark | None:
        """A saved benchmark, or None if there is none or one of another ``meta``."""
        found = load_tables(spark, folder, meta)
        if found is None:
            return None
        tables, settings = found if isinstance(found, tuple) else (found, meta)
        return cls(**{name: tables[name] for name in PARTS}, meta=settings)


def build_local(pairs: DataFrame, queries: DataFrame, n_queries: int, corpus_size: int, seen_share: float, seed: int = 42) -> LocalBenchmark:
    """``build`` with what it was built by."""
    tables = build(pairs, queries, n_queries, corpus_size, seen_share, seed)
    return LocalBenchmark(**tables, meta={"n_queries": n_queries, "corpus_size": corpus_size, "seen_share": seen_share, "seed": seed})


def leakage_checks(tables: dict[str, DataFrame], seen_share: float, every: bool = False) -> DataFrame:
    """(problem, n) of a built benchmark; none means that nothing leaks. ``every`` also gives the checks that found nothing."""
    queries, truth, items, fit = (tables[t] for t in ("queries", "qrels", "corpus", "fit_pairs"))
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("problem"), "n")
    known = items.select("item_id").distinct()
    judged = truth.select("query_id").distinct()
    share = known.join(fit.select("item_id").distinct().withColumn("f", F.lit(1)), "item_id", "left").agg((F.abs(F.count("f") / F.nullif(F.count(F.lit(1)), F.lit(0)) - seen_share) > 0.02).cast("bigint").alias("n"))
    found = [
        one("held_out_in_fit", fit.select("query_id").distinct().join(judged, "query_id", "left_semi")),
        one("positives_outside_corpus", truth.select("item_id").distinct().join(known, "item_id", "left_anti")),
        items.agg((F.count(F.lit(1)) - F.count_distinct("item_id")).alias("n")).select(F.lit("repeated_items").alias("problem"), "n"),
        one("queries_without_positives", queries.select("query_id").join(judged, "query_id", "left_anti")),
        one("judged_unknown_queries", judged.join(queries.select("query_id"), "query_id", "left_anti")),
        share.select(F.lit("seen_share_off").alias("problem"), "n"),
    ]
    out = found[0]
    for part in found[1:]:
        out = out.unionAll(part)
    return out if every else out.where("n > 0")

"""From a query set to a checked file of ranked answers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import rerank
from tessera.operators.fusion import WEIGHTS, Fusion
from tessera.operators.index import FIELDS, K1, Field
from tessera.operators.submission import TOP_K, build_submission, save_submission
from tessera.plans import chain
from tessera.session import durable
from tessera.sources.tables import cached_table


@dataclass(frozen=True)
class Plan:
    """How to answer. ``mode`` None ranks by text alone; ``model`` and ``cache`` are folders, None for none."""

    fields: Sequence[Field] = FIELDS
    k1: float = K1
    with_filter: bool = False
    mode: str | None = "normalized"
    weights: dict[str, float] | None = None
    top_k: int = TOP_K
    dense_depth: int = chain.DENSE_DEPTH
    rerank_depth: int = chain.RERANK_DEPTH
    model: str | None = None
    cache: str | None = None


@dataclass(frozen=True)
class Answer:
    """(query, rnk, doc), how it was made, and what had to be left out."""

    run: DataFrame
    used: tuple[str, ...]
    warnings: tuple[str, ...]


def rank(t: chain.Tables, plan: Plan = Plan()) -> Answer:
    """The ranked items of every query, padded with the nearest ones.

    What isn't there is done without and told: no vectors, no vector signal; no model, or no
    vectors for it, the order of the sum. The feature table of the re-ranker is kept in
    ``plan.cache`` and read again as long as all that decides on it is the same.
    """
    index = chain.lexical_index(t, plan.fields, plan.k1, f"{plan.cache}/index" if plan.cache else None)
    if plan.mode is None:
        found = index.search(t.asked(plan.with_filter), plan.top_k)
        return Answer(found.select("query", "rnk", "doc"), ("lexical",), ())
    weights = dict(WEIGHTS if plan.weights is None else plan.weights)
    warnings = []
    dense = t.item_vectors is not None and t.query_vectors is not None
    if weights.get("dense") and not dense:
        warnings.append("no vectors: ranked without them")
    model = rerank.load_model(t.items.sparkSession, plan.model) if plan.model else None
    if plan.model and (model is None or not dense):
        warnings.append("no model, or no vectors for it: ranked by the sum")
        model = None
    depth = max(plan.top_k, plan.rerank_depth) if model else plan.top_k
    pool = lambda: chain.collected(t, index, depth, weights, Fusion(plan.mode), plan.dense_depth, plan.with_filter)
    if model:
        pipeline, features, _ = model
        rows = lambda: chain.feature_rows(t, index, pool())
        settings = chain.feature_settings(t, plan.fields, plan.k1, weights, plan.mode, depth, plan.dense_depth)
        table = cached_table(t.items.sparkSession, f"{plan.cache}/features", settings, rows) if plan.cache else rows()
        prior = table.select("query", "doc", F.col("total_rank").alias("rnk"))
        run = rerank.ranked(rerank.predict(pipeline, table, features), plan.top_k, prior)
    else:
        run = pool().select("query", "rnk", "doc")
    used = ["lexical", *[n for n, w in weights.items() if w and (n != "dense" or dense)], *(["rerank"] if model else [])]
    return Answer(chain.padded(t, durable(run.select("query", "rnk", "doc")), plan.top_k), tuple(used), tuple(warnings))


def make_answer(spark: SparkSession, folder: str, out: str, plan: Plan = Plan(), dense: bool = True) -> dict:
    """Answers the queries of ``folder`` into one CSV file at ``out``; raises and writes nothing if it wouldn't be accepted.

    Returns what was used and left out and how full the answers are.
    """
    t = chain.open_tables(spark, folder, dense, parse=True)
    answer = rank(t, plan)
    queries = t.queries.select(F.col("query_id").alias("query"))
    answers = durable(build_submission(answer.run, queries))
    warnings = save_submission(answers, out, t.queries.select("query_id"), t.corpus("item_id"), plan.top_k)
    n = F.size(F.filter(F.split("answer", " "), lambda x: x != ""))
    full = answers.agg(F.median(n).alias("median"), F.avg((n < plan.top_k).cast("double")).alias("short"), F.sum((n == 0).cast("bigint")).alias("empty")).first()
    return {"used": answer.used, "warnings": [*answer.warnings, *warnings], "median_items": full["median"], "short_answers": full["short"], "empty_answers": full["empty"]}

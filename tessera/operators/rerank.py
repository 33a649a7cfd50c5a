"""A gradient-boosted re-ranker over the feature table."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.boosting import GBTClassifier
from tessera.operators.features import FEATURES
from tessera.session import together
from tessera.sources.tables import read_text, write_text

MISSING = -1e6  # trees split a missing value off


class OneLabelError(ValueError):
    """Rows of which a model can't learn; ``label`` is all they have, 0 without rows."""

    def __init__(self, label: int) -> None:
        super().__init__("both labels are needed")
        self.label = label


def _filled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({f"in_{c}": F.coalesce(F.col(c).cast("double"), F.lit(MISSING)) for c in features})


def train(df: DataFrame, features: Sequence[str] = FEATURES, trees: int = 400, depth: int = 6, rate: float = 0.05, seed: int = 0) -> PipelineModel:
    """Balanced: a row of the rarer label weighs as much more as there are fewer of them."""
    counts = {r["label"]: r["n"] for r in df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        raise OneLabelError(next(iter(counts), 0))
    most = max(counts.values())
    weight = F.when(F.col("label") == 1, most / counts[1]).otherwise(most / counts[0])
    stages = [VectorAssembler(inputCols=[f"in_{c}" for c in features], outputCol="in_vector"), GBTClassifier(featuresCol="in_vector", labelCol="label", weightCol="in_weight", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed)]
    return Pipeline(stages=stages).fit(_filled(df, features).withColumn("in_weight", weight))


def save_model(model: PipelineModel, folder: str, name: str, features: Sequence[str]) -> None:
    """The model and, beside it, what it is called, what it reads and what it was fitted to."""
    model.write().overwrite().save(f"{folder}/model")
    spark = SparkSession.active()
    write_text(spark, json.dumps({"name": name, "features": list(features), "objective": "logloss"}), f"{folder}/model.json")


def load_model(spark: SparkSession, folder: str) -> tuple[PipelineModel, list[str], str] | None:
    """(model, its features, its name), or None if there is none."""
    try:
        about = json.loads(read_text(spark, f"{folder}/model.json"))
        return PipelineModel.load(f"{folder}/model"), about["features"], about["name"]
    except Exception:  # noqa: BLE001 - no model is an answer
        return None


def predict(model: PipelineModel, df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """(query, doc, label, score), the score being the probability of label 1."""
    return model.transform(_filled(df, features)).select("query", "doc", "label", F.element_at(vector_to_array("probability"), 2).alias("score"))


def importance(model: PipelineModel, features: Sequence[str] = FEATURES) -> list[tuple[str, float]]:
    values = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, (float(v) for v in values), strict=True), key=lambda x: (-x[1], x[0]))


def cross_validate(df: DataFrame, folds: int = 5, seed: int = 0, features: Sequence[str] = FEATURES, **how) -> DataFrame:
    """Out-of-fold (query, doc, label, score); a query's candidates are all in one fold.

    If the other folds have one label only, it is the score of a fold's rows; if that holds for all folds, it is an error.
    """
    split = df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), "query"), F.lit(folds)))

    def fit(k: int) -> PipelineModel | OneLabelError:
        try:
            return train(split.where(F.col("fold") != k), features, **how)
        except OneLabelError as only:
            return only

    # A fit is one long task; those of the folds run beside each other.
    models = together(*[lambda k=k: fit(k) for k in range(folds)])
    if all(isinstance(m, OneLabelError) for m in models):
        raise models[0]
    held = [split.where(F.col("fold") == k) for k in range(folds)]
    parts = [h.select("query", "doc", "label", F.lit(float(m.label)).alias("score")) if isinstance(m, OneLabelError) else predict(m, h, features) for m, h in zip(models, held, strict=True)]
    return reduce(DataFrame.unionAll, parts)


def ranked(scores: DataFrame, k: int, prior: DataFrame | None = None) -> DataFrame:
    """(query, rnk, doc): best scores first; equal ones in the order of ``prior`` (query, doc, rnk) or by doc."""
    rows = scores
    tie = [F.col("doc")]
    if prior is not None:
        rows = scores.join(prior.select("query", "doc", F.col("rnk").alias("prior")), ["query", "doc"], "left")
        tie = [F.col("prior").asc_nulls_last(), F.col("doc")]
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc_nulls_last(), *tie))
    return rows.withColumn("rnk", place).where(F.col("rnk") <= k).select("query", F.col("rnk").cast("bigint").alias("rnk"), "doc")

"""The re-ranker's fit in one task against Spark's own fit of the same trees."""

import numpy as np
import pytest
from pyspark.ml import classification
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tessera.operators import boosting, rerank


def rows(spark, n=3000, seed=5):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.exponential(size=n), rng.integers(0, 7, n), rng.integers(0, 2, n), np.full(n, 3.0), np.where(rng.random(n) < 0.2, -1e6, rng.random(n))])
    y = (x[:, 0] + x[:, 1] * (x[:, 3] - 0.5) + rng.normal(size=n) > 0.8).astype(int)
    w = rng.uniform(0.5, 2, n)
    df = spark.createDataFrame([(i, *map(float, v), int(k), float(u)) for i, (v, k, u) in enumerate(zip(x, y, w, strict=True))], "id long, a double, b double, c double, d double, e double, f double, label long, w double")
    return VectorAssembler(inputCols=list("abcdef"), outputCol="v").transform(df).withColumn("balanced", F.when(F.col("label") == 1, 4.5).otherwise(1.0)).cache()


def probabilities(model, df):
    return [r.p for r in model.transform(df).select("id", F.element_at(vector_to_array("probability"), 2).alias("p")).orderBy("id").collect()]


@pytest.mark.parametrize("how", [{"weightCol": "balanced"}, {"weightCol": "w"}, {}])
def test_same_trees_as_sparks_fit(spark, how, monkeypatch):
    monkeypatch.setattr(boosting, "FEW", 200)  # so that nodes are counted either way
    df = rows(spark)
    used = {"featuresCol": "v", "labelCol": "label", "maxIter": 12, "maxDepth": 4, "stepSize": 0.3, "seed": 0} | how
    ours, theirs = (kind(**used).fit(df) for kind in (boosting.GBTClassifier, classification.GBTClassifier))
    assert probabilities(ours, df) == pytest.approx(probabilities(theirs, df), abs=1e-9)
    assert ours.featureImportances.toArray() == pytest.approx(theirs.featureImportances.toArray(), abs=1e-9)
    assert (ours.getNumTrees, ours.treeWeights, ours.numFeatures) == (theirs.getNumTrees, theirs.treeWeights, theirs.numFeatures)


def test_a_fit_is_no_job_for_each_level_of_each_tree(spark, monkeypatch):
    df = rows(spark, 400).drop("balanced")
    jobs = []
    for cells in (boosting.CELLS, 0):  # without room in a task, Spark's fit takes over
        monkeypatch.setattr(boosting, "CELLS", cells)
        spark.sparkContext.setJobGroup(f"fit {cells}", "")
        model = boosting.GBTClassifier(featuresCol="v", labelCol="label", maxIter=10, maxDepth=3, seed=0).fit(df)
        assert model.getNumTrees == 10
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit {cells}")))
    assert jobs[0] < 20 < jobs[1]


def test_splits_of_a_feature():
    ones = np.ones(1000)
    assert boosting.thresholds(np.array([3.0, 1.0, 3.0]), ones[:3], 31).tolist() == [2.0]
    assert len(boosting.thresholds(ones, ones, 31)) == 0
    assert len(boosting.thresholds(np.array([]), np.array([]), 31)) == 0
    assert boosting.thresholds(np.array([np.nan, 1.0, 2.0, np.nan]), ones[:4], 31).tolist() == [1.5]
    many = boosting.thresholds(np.arange(1000.0), ones, 4)
    assert many == pytest.approx([200, 400, 600, 800], abs=1)


def test_a_fold_whose_others_have_one_label(spark):
    df = spark.createDataFrame([(f"q{i % 30}", f"d{i}", float(i % 11), int(i % 30 == 7 and i % 11 > 8)) for i in range(900)], "query string, doc string, lexical double, label long")
    got = rerank.cross_validate(df, 3, features=["lexical"], trees=2, depth=2)
    assert got.count() == 900
    folds = got.withColumn("fold", F.pmod(F.xxhash64(F.lit(0), "query"), F.lit(3))).groupBy("fold").agg(F.max("label").alias("label"), F.countDistinct("score").alias("scores"), F.max("score").alias("most")).collect()
    assert {r.label: (r.scores, r.most) for r in folds if r.label} == {1: (1, 0.0)}  # nothing was there to learn from
    assert all(r.scores > 1 for r in folds if not r.label)
    with pytest.raises(ValueError, match="labels"):
        rerank.cross_validate(df.where("label = 0"), 3, features=["lexical"], trees=2, depth=2)

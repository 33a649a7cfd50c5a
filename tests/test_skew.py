from pyspark.sql import functions as F

from tessera.operators.skew import enrich


def test_enrich_equals_a_window(spark):
    rows = [("hot" if i % 3 == 0 else f"k{i % 50}", i) for i in range(3000)] + [(None, 1), (None, 2), ("one", 9)]
    df = spark.createDataFrame(rows, "k string, v long").withColumn("__salt", F.lit("mine"))
    got = enrich(df, ["k"], {"__n": F.count(F.lit(1)), "__s": F.sum("v")}, {"n": F.sum("__n"), "s": F.sum("__s")}, ["v"], having=F.col("n") > 1)
    want = {}
    for k, v in rows:
        want.setdefault(k, []).append(v)
    assert sorted(((r.k, r.v, r.n, r.s, r["__salt"]) for r in got.collect()), key=str) == sorted(((k, v, len(want[k]), sum(want[k]), "mine") for k, v in rows if len(want[k]) > 1), key=str)
    assert enrich(df.limit(0), ["k"], {"__n": F.count(F.lit(1))}, {"n": F.sum("__n")}, ["v"]).count() == 0

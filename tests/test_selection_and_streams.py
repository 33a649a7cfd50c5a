import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.params import key_coverage
from tessera.operators import metrics
from tessera.operators.packed import value_tokenizer
from tessera.operators.selection import least
from tessera.operators.skew import attach
from tessera.streaming import clicks


@pytest.mark.parametrize("n", [0, 1, 777, 4000, 9999, 10_000, 20_000])
def test_least_rows_are_those_of_a_sort(spark, n):
    rng = random.Random(3)
    rows = [(f"k{i:05d}", rng.choice([0.5, rng.random(), rng.random() ** 6])) for i in range(10_000)]
    got = least(spark.createDataFrame(rows, "k string, v double"), "v", ["k"], n, small=50).collect()
    assert sorted(map(tuple, got)) == sorted(sorted(rows, key=lambda r: (r[1], r[0]))[:n])


def test_least_of_nothing_and_of_equal_values(spark):
    df = spark.createDataFrame([(f"k{i:03d}", 1.0) for i in range(300)], "k string, v double")
    assert least(df.limit(0), "v", ["k"], 5).count() == 0
    assert sorted(r.k for r in least(df, "v", ["k"], 7, small=10).collect()) == [f"k{i:03d}" for i in range(7)]


def test_attach_joins_a_hot_and_a_null_key(spark):
    rows = [(i, "hot" if i % 3 else None, i) for i in range(600)] + [(601, "rare", 1), (602, "absent", 1)]
    table = [("hot", 1), (None, 2), ("rare", 3), ("unused", 4)]
    df = spark.createDataFrame(rows, "n long, k string, salt long")
    got = {r.n: (r.salt, r.v) for r in attach(df, spark.createDataFrame(table, "k string, v long"), ["k"], ["n"]).collect()}
    assert got == {n: (s, dict(table)[k]) for n, k, s in rows if k != "absent"}


def test_ks_and_delta_of_many_values(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(0, 1, 3000).round(3), rng.normal(0.3, 1.2, 2000).round(3)
    rows = [(float(x), True) for x in a] + [(float(x), False) for x in b] + [(None, True), (math.nan, False)]
    df = spark.createDataFrame(rows, "v double, f boolean")
    at = np.union1d(a, b)
    ks = np.abs(np.searchsorted(np.sort(a), at, "right") / len(a) - np.searchsorted(np.sort(b), at, "right") / len(b)).max()
    assert metrics.ks_statistic(df, "v", "f").first().ks == pytest.approx(ks, abs=1e-12)
    u = sum(np.searchsorted(np.sort(b), a, "left")) + sum(np.searchsorted(np.sort(b), a, "right") - np.searchsorted(np.sort(b), a, "left")) / 2
    got = metrics.cliffs_delta(df, "v", "f").first()
    assert (got["first"], got.others) == (3000, 2000)
    assert got.delta == pytest.approx(2 * u / 6e6 - 1, abs=1e-12)


def test_resamples_are_a_bootstrap(spark):
    rng = random.Random(2)
    rows = [(f"q{i}", rng.random()) for i in range(400)] + [("none", None), ("nan", math.nan)]
    df = spark.createDataFrame(rows, "q string, r double")
    x = np.array([v for _, v in rows[:400]])
    mean, low, high = metrics.bootstrap_interval(df, "q", "r", 400).first()
    assert mean == pytest.approx(x.mean())
    plain = metrics.bootstrap_ci(list(x), 2000)
    assert low == pytest.approx(plain[1], abs=0.01)
    assert high == pytest.approx(plain[2], abs=0.01)
    better = df.withColumn("r", F.col("r") + 0.1)
    assert all(v == pytest.approx(0.1, abs=1e-9) for v in metrics.paired_interval(df, better, "q", "r", 50).first())
    assert metrics.bootstrap_interval(df.limit(0), "q", "r", 10).first().mean is None


def test_key_coverage_with_marks_in_keys(spark):
    df = spark.createDataFrame([("Цена (руб) 5",), ("до Цена (руб) 5",), ("Срок 5 Цена (руб) 1",), ("нет ничего",), (" ",), (None,)], "t string")
    got = [r[0] for r in df.select(key_coverage("t", ["Цена (руб)", "Срок"])).collect()]
    assert got == [1.0, 0.75, 1.0, 0.0, 1.0, 1.0]


def test_many_open_quotes_take_linear_time():
    tokenize = value_tokenizer(["Срок"])

    def seconds(n):
        began = time.perf_counter()
        tokenize("«" * n + "a»")
        return time.perf_counter() - began

    assert seconds(64_000) < 24 * max(seconds(8_000), 0.01)  # 64 times if it were quadratic
    assert tokenize("Срок «a «b» c» ; «d") == [("Срок", "a «b» c"), ("Срок", "«d")]


def test_stream_lets_late_events_go(spark, tmp_path):
    at = f"{tmp_path}/in"

    def put(name, rows):
        spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{at}/{name}.parquet")

    put("events", [("2024-01-01 10:00:00", "click", 1.0), ("2024-01-20 10:00:00", "click", 2.0), ("2024-01-20 11:00:00", "view", 4.0)])

    def counted():
        stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(f"{at}/*.parquet")
        return {(str(r.start)[:10], r.event_type): (r.n, r.value) for r in clicks.drain(clicks.windowed_counts(stream), f"{tmp_path}/out").collect()}

    first = {("2024-01-01", "click"): (1, 1.0), ("2024-01-20", "click"): (1, 2.0), ("2024-01-20", "view"): (1, 4.0)}
    assert counted() == first
    # The first is nineteen days late, the second six: only that one still counts.
    put("later", [("2024-01-01 12:00:00", "click", 8.0), ("2024-01-14 12:00:00", "click", 16.0), ("2024-01-20 12:00:00", "view", 32.0)])
    assert counted() == first | {("2024-01-14", "click"): (1, 16.0), ("2024-01-20", "view"): (2, 36.0)}

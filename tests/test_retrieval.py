import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import benchmark, features, fusion, metrics, microcat, rerank, signals, submission
from tessera.operators.exact import closest_vectors, nearest_places


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_exact_vectors_and_places(spark):
    rng = np.random.default_rng(0)
    v, q = rng.standard_normal((300, 8)), rng.standard_normal((20, 8))
    items = table(spark, "doc string, iv array<float>", *[(f"{i:03d}", [float(x) for x in r]) for i, r in enumerate(v)])
    queries = table(spark, "query string, qv array<float>", *[(f"q{i}", [float(x) for x in r]) for i, r in enumerate(q)])
    cos = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T
    got = {}
    for r in closest_vectors(queries, items, 4).collect():
        got.setdefault(r.query, {})[r.rnk] = r.doc
    assert all([got[f"q{i}"][k + 1] for k in range(4)] == [f"{j:03d}" for j in np.argsort(-cos[i])[:4]] for i in range(20))
    places = table(spark, "doc string, ilat double, ilon double", ("a", 55.0, 37.0), ("b", 55.0, 37.0), ("c", 43.0, 131.0))
    near = nearest_places(table(spark, "query string, qlat double, qlon double", ("q", 55.1, 37.0)), places, 2)
    assert [(r.rnk, r.doc) for r in near.orderBy("rnk").collect()] == [(1, "a"), (2, "b")]


def test_signals(spark):
    pairs = table(spark, "query string, doc string", ("q", "near"), ("q", "far"), ("lost", "near"))
    geo = signals.GeoSignal(table(spark, "query string, qlat double, qlon double", ("q", 55.0, 37.0), ("lost", None, None)), table(spark, "doc string, ilat double, ilon double", ("near", 55.0, 37.0), ("far", 43.0, 131.0)), [3.0] + [0.5] * 15 + [-2.0])
    assert {(r.query, r.doc): r.geo for r in geo.apply(pairs).collect()} == {("q", "near"): 3.0, ("q", "far"): -2.0, ("lost", "near"): 0.0}
    facet = signals.FacetSignal(table(spark, "query string, wanted array<string>", ("q", ["a", "b"])), table(spark, "doc string, there array<string>", ("near", ["a", "b"]), ("far", ["c"])), [-1.0, 0.0, 0.1, 0.2, 2.0])
    assert {(r.query, r.doc): r.facet for r in facet.apply(pairs).collect()} == {("q", "near"): 2.0, ("q", "far"): -1.0, ("lost", "near"): 0.0}
    dense = signals.DenseSignal(table(spark, "query string, qv array<float>", ("q", [1.0, 0.0])), table(spark, "doc string, iv array<float>", ("near", [2.0, 0.0]), ("far", [0.0, 5.0])))
    assert {(r.query, r.doc): r.dense for r in dense.apply(pairs).collect()} == {("q", "near"): 1.0, ("q", "far"): 0.0, ("lost", "near"): 0.0}
    hist = table(spark, "side string, bin int, n long", ("chosen", 0, 10), ("random", 1, 10))
    assert signals.log_ratio(hist, 2) == [math.log(30 / 50 / (20 / 50)), math.log(20 / 50 / (30 / 50))]
    assert signals.describe([(geo, 0.5)]) == "geo x 0.5"


def test_filter_words_outside_the_vocabulary_do_not_count(spark):
    items = table(spark, "item_id string, item_infm_params_text string", ("a", "Вид ремонт"), ("b", None))
    got = signals.known_facets(table(spark, "query string, f string", ("q", "вид неведомое"), ("none", "неведомое"), ("null", None)), "query", "f", items)
    assert [(r.query, r.wanted) for r in got.collect()] == [("q", ["вид"])]


COMPONENTS = [("q", "a", 4.0, 0.0, 1.0), ("q", "b", 2.0, 6.0, 0.0), ("q", "c", 0.0, 1.0, 9.0), ("z", "a", 0.0, 0.0, 0.0)]


@pytest.mark.parametrize("mode", fusion.MODES)
def test_retrieve_equals_collect(spark, mode):
    lexical = table(spark, "query string, doc string, lexical double", *[c[:3] for c in COMPONENTS])
    side = table(spark, "query string, doc string, geo double, dense double", *[(c[0], c[1], c[3], c[4]) for c in COMPONENTS])

    class Given:
        def __init__(self, name):
            self.name = name

        def apply(self, pairs):
            return pairs.join(side.select("query", "doc", self.name), ["query", "doc"], "left").fillna(0.0)

    both = [Given("geo"), Given("dense")]
    config = fusion.Fusion(mode)
    for weights in ({"geo": 0.1, "dense": 0.5}, {"geo": 0.1, "dense": 0.0}):
        a = fusion.retrieve(lexical, both, weights, 2, config=config)
        b = fusion.collect(lexical, both, weights, 2, config=config)
        assert sorted(map(tuple, a.collect())) == sorted((r.query, r.rnk, r.doc) for r in b.collect())
    with pytest.raises(ValueError, match="mode"):
        fusion.Fusion("other")


def test_extra_candidates_and_padding(spark):
    lexical = table(spark, "query string, doc string, lexical double", ("q", "a", 3.0))
    extra = table(spark, "query string, doc string", ("q", "a"), ("q", "b"), ("n", "c"))
    assert sorted(map(tuple, fusion.with_extra(lexical, extra).collect())) == [("n", "c", 0.0), ("q", "a", 3.0), ("q", "b", 0.0)]
    run = table(spark, "query string, rnk long, doc string", ("q", 1, "far"))
    places = table(spark, "query string, qlat double, qlon double", ("q", 55.0, 37.0), ("lost", None, None), ("new", 43.0, 131.0))
    items = table(spark, "doc string, ilat double, ilon double", ("near", 55.0, 37.1), ("mid", 56.0, 40.0), ("far", 43.0, 131.0), ("none", None, 1.0))
    padded = fusion.pad_with_nearest(run, places, items, 2)
    assert sorted(map(tuple, padded.collect())) == [("new", 1, "far"), ("new", 2, "mid"), ("q", 1, "far"), ("q", 2, "near")]


def test_recall(spark):
    truth = table(spark, "query string, doc string", ("a", "i1"), ("b", "i1"), ("b", "i2"), ("b", "i2"), ("c", "i9"))
    run = table(spark, "query string, rnk long, doc string", ("a", 1, "i1"), ("b", 1, "i1"), ("b", 2, "i7"), ("x", 1, "i1"))
    assert {r.query: r.recall for r in metrics.recall_per_query(run, truth).collect()} == {"a": 1.0, "b": 0.5, "c": 0.0}
    assert {r.k: r.recall for r in metrics.recall_curve(run, truth, (1, 50)).collect()} == {1: 0.5, 50: 0.5}
    late = table(spark, "query string, rnk long, doc string", ("a", 50, "i1"))
    one = truth.where("query = 'a'")
    assert [metrics.recall_per_query(late, one, k).first().recall for k in (50, 49)] == [1.0, 0.0]
    assert sorted((r.query, r.doc, r.rnk) for r in metrics.positive_ranks(run, truth).collect()) == [("a", "i1", 1), ("b", "i1", 1), ("b", "i2", -1), ("c", "i9", -1)]


def test_effect_sizes(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 30, 400), rng.integers(5, 35, 300)
    rows = [(float(x), True) for x in a] + [(float(x), False) for x in b] + [(None, True), (float("nan"), False)]
    df = table(spark, "v double, first boolean", *rows)
    want = (np.sign(a[:, None] - b[None, :])).mean()
    row = metrics.cliffs_delta(df, "v", "first").first()
    assert (row.first, row.others) == (400, 300)
    assert row.delta == pytest.approx(want)
    swapped = metrics.cliffs_delta(df.withColumn("other", ~F.col("first")), "v", "other").first().delta
    assert swapped == pytest.approx(-want)
    grid = np.arange(40)
    ks = max(abs((a <= g).mean() - (b <= g).mean()) for g in grid)
    assert metrics.ks_statistic(df.where("v is not null and not isnan(v)"), "v", "first").first().ks == pytest.approx(ks)
    cut = metrics.breakdown(df, "v", "first", [10, 20], least=50)
    assert {r.bin: r.n for r in cut.collect()} == {0: int((a < 10).sum() + (b < 10).sum()), 1: int(((a >= 10) & (a < 20)).sum() + ((b >= 10) & (b < 20)).sum()), 2: int((a >= 20).sum() + (b >= 20).sum())}


def test_bootstrap():
    mean, low, high = metrics.bootstrap_ci([0.0, 1.0] * 100)
    assert mean == 0.5
    assert 0.4 < low < 0.5 < high < 0.6
    assert metrics.paired_bootstrap({"a": 0.0, "b": None, "c": 1.0}, {"a": 1.0, "b": 0.5, "c": 1.0})[0] == 0.5
    assert all(math.isnan(x) for x in metrics.bootstrap_ci([]))


A, B = "0" * 16, "f" * 16


def test_submission(spark, tmp_path):
    run = table(spark, "query string, rnk long, doc string", ("0012345678901234", 2, A), ("0012345678901234", 1, B))
    queries = table(spark, "query string", ("0012345678901234",), ("q" * 16,))
    answers = submission.build_submission(run, queries)
    assert {r.query_id: r.answer for r in answers.collect()} == {"0012345678901234": f"{B} {A}", "q" * 16: ""}
    expected = queries.withColumnRenamed("query", "query_id")
    corpus = table(spark, "item_id string", (A,), (B,))
    assert submission.save_submission(answers, f"{tmp_path}/a.csv", expected, corpus) == ["empty_answers"]
    assert sorted(map(tuple, submission.read_submission(spark, f"{tmp_path}/a.csv").collect())) == [("0012345678901234", f"{B} {A}"), ("q" * 16, "")]
    text = (tmp_path / "a.csv").read_bytes()  # one file, not a folder
    assert b"\r" not in text


@pytest.mark.parametrize(
    ("rows", "problem"),
    [
        ([("q" * 16, A.replace("0", "F"))], "malformed_items"),
        ([("q" * 16, "e" * 16)], "items_outside_corpus"),
        ([("q" * 16, " ".join([A, B, "1" * 16]))], "too_many_items"),
        ([("q" * 16, f"{A} {A}")], "repeated_items"),
        ([], "missing_queries"),
        ([("q" * 16, A), ("q" * 16, A)], "repeated_queries"),
        ([("q" * 16, A), ("z" * 16, A)], "unknown_queries"),
        ([("q" * 16, A), ("1", A)], "bad_query_length"),
        ([("q" * 16, "")], "empty_answers"),
    ],
)
def test_submission_problems(spark, tmp_path, rows, problem):
    answers = table(spark, "query_id string, answer string", *rows)
    expected, corpus = table(spark, "query_id string", ("q" * 16,)), table(spark, "item_id string", (A,), (B,))
    found = {r.problem for r in submission.validate_submission(answers, expected, corpus, 2).collect()}
    assert problem in found
    if problem != "empty_answers":
        with pytest.raises(submission.SubmissionError, match=problem):
            submission.save_submission(answers, f"{tmp_path}/x.csv", expected, corpus, 2)
        assert not (tmp_path / "x.csv").exists()
    wrong = answers.withColumnRenamed("answer", "items")
    assert [r.problem for r in submission.validate_submission(wrong, expected).collect()] == ["wrong_columns"]


def test_raking():
    cells = {(loc, f): n for (loc, f), n in zip([("1", "T"), ("1", "F"), ("2", "T"), ("2", "F"), ("3", "T")], [100, 400, 300, 200, 50], strict=True)}
    weights = benchmark.rake(cells, {0: {"1": 0.3, "2": 0.7}, 1: {"T": 0.8, "F": 0.2}})
    total = sum(weights[c] * n for c, n in cells.items())
    assert weights["3", "T"] == 0
    assert sum(weights[c] * n for c, n in cells.items() if c[0] == "1") / total == pytest.approx(0.3, abs=0.01)
    assert sum(weights[c] * n for c, n in cells.items() if c[1] == "T") / total == pytest.approx(0.8, abs=0.01)
    with pytest.raises(ValueError, match="fits"):
        benchmark.rake({("9", "T"): 5}, {0: {"1": 1.0}})


def test_donor_cut_equals_the_walk(spark):
    import hashlib
    import random

    rng = random.Random(3)
    for needed in (0, 1, 5, 12, 99):
        rows = [(f"q{rng.randrange(12)}", f"i{rng.randrange(15)}") for _ in range(30)]
        left = {}
        for _, i in rows:
            left[i] = left.get(i, 0) + 1
        donor, free = set(), 0
        for q in sorted({q for q, _ in rows}, key=lambda q: hashlib.md5(f"1:{q}".encode()).hexdigest()):
            if free >= needed:
                break
            donor.add(q)
            for a, i in rows:
                if a == q:
                    left[i] -= 1
                    free += left[i] == 0
        got = benchmark.donor_cut(table(spark, "query_id string, item_id string", *rows), needed, 1)
        assert {r.query_id for r in got.collect()} == donor


def test_microcat_against_dense_arithmetic(spark):
    texts = ["ремонт кранов", "ремонт крыши", "крыша дома", "стрижка собак", "стрижка кошек", "собаки", "ремонт дома", "кошки дома"] * 2
    labels = [1, 2, 2, 3, 3, 3, 2, 3] * 2
    pairs = table(spark, "key long, text string, class long", *[(i, t, c) for i, (t, c) in enumerate(zip(texts, labels, strict=True))])
    model = microcat.fit(pairs, least_df=1)
    got = {(r.key, r["class"]): r.lp for r in model.log_proba(table(spark, "key string, text string", ("a", "ремонт крана"), ("b", "собака"))).collect()}

    def grams(text):
        out = {}
        for w in text.split():
            p = f" {w} "
            for n in (3, 4, 5):
                for i in range(max(1, len(p) - n + 1)):
                    if n == 3 or len(p) >= n:
                        out[p[i : i + n]] = out.get(p[i : i + n], 0) + 1
        return out

    df = {}
    for t in texts:
        for g in grams(t):
            df[g] = df.get(g, 0) + 1
    names = sorted(df)

    def row(text):
        w = np.array([(1 + math.log(c)) * (math.log((1 + len(texts)) / (1 + df[g])) + 1) if (c := grams(text).get(g)) else 0.0 for g in names])
        return w / np.linalg.norm(w)

    x = np.stack([row(t) for t in texts])
    for key, text in (("a", "ремонт крана"), ("b", "собака")):
        joint = []
        for c in (1, 2, 3):
            comp = x.sum(axis=0) - x[np.array(labels) == c].sum(axis=0) + 0.2
            joint.append(row(text) @ -np.log(comp / comp.sum()))
        lp = np.array(joint) - np.logaddexp.reduce(joint)
        assert [got[key, c] for c in (1, 2, 3)] == pytest.approx(list(lp))


def test_rerank_learns_and_breaks_ties(spark):
    rng = np.random.default_rng(2)
    rows = [(f"q{i % 40}", f"d{i}", float(rng.random()), None if i % 9 == 0 else 1.0) for i in range(800)]
    df = table(spark, "query string, doc string, lexical double, price double", *rows).withColumn("label", (F.col("lexical") > 0.8).cast("bigint"))
    scores = rerank.cross_validate(df, 2, features=["lexical", "price"], trees=3, depth=2, rate=0.3)
    means = {r.label: r.m for r in scores.groupBy("label").agg(F.avg("score").alias("m")).collect()}
    assert means[1] > means[0] + 0.2
    assert scores.count() == 800
    given = table(spark, "query string, doc string, score double", ("q", "a", 0.5), ("q", "b", 0.5), ("q", "c", 0.9))
    prior = table(spark, "query string, doc string, rnk long", ("q", "b", 1), ("q", "a", 2))
    assert [(r.rnk, r.doc) for r in rerank.ranked(given, 3, prior).orderBy("rnk").collect()] == [(1, "c"), (2, "b"), (3, "a")]
    with pytest.raises(ValueError, match="labels"):
        rerank.train(df.where("label = 0"), ["lexical"], 2, 2)
    assert len(features.FEATURES) == len(set(features.FEATURES)) == 35

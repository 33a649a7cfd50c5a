import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import termblocks
from tessera.operators.index import FIELDS, Index, build_index, search_once
from tessera.plans import experiments

WORDS = ["кран", "течь", "дом", "окно", "дверь", "плитка"]


@pytest.fixture(scope="module")
def small(spark):
    """Documents that nearly all queries find, many of them alike, and queries of which some ask for the same."""
    dice = random.Random(3)
    of = lambda n: " ".join(dice.choices(WORDS, k=n))
    docs = [(f"d{i:03}", f.name, "" if dice.random() < 0.1 else of(dice.randint(1, 4))) for i in range(300) for f in FIELDS]
    asked = [(f"q{i:02}", of(3)) for i in range(40)] + [("none", "неизвестно"), ("empty", None)]
    truth = [(f"q{i:02}", f"d{dice.randint(0, 299):03}") for i in range(40) for _ in range(2)] + [("q00", "nowhere"), ("none", "d001")]
    return build_index(spark.createDataFrame(docs, "doc string, field string, text string"), keep=True), spark.createDataFrame(asked, "query string, text string"), spark.createDataFrame(truth, "query string, doc string").distinct()


def test_grid_stores_no_pairs_of_query_and_document(small, monkeypatch):
    index, asked, truth = small
    kept = []
    for module in (experiments, termblocks):
        whole = module.durable
        monkeypatch.setattr(module, "durable", lambda df, whole=whole: kept.append(whole(df)) or kept[-1])
    points = [(20.0, 0.5, 1.0, 1.2), (1.0, 0.0, 0.5, 0.6)]
    got = {(r.title, r.params, r.description, r.k1): r.recall for r in experiments.lexical_grid(index, asked, truth, 20, points).collect()}
    assert index.scores(asked).count() > 8_000
    assert max(df.count() for df in kept) <= 300  # documents, queries or judged pairs
    for p in points:
        found = {(r["query"], r.doc) for r in index.reweight(experiments.fields_of(*p[:3]), p[3]).search(asked, 20).where("score > 0").collect()}
        true = {(r["query"], r.doc) for r in truth.collect()}
        size = {q: sum(x == q for x, _ in true) for q, _ in true}
        assert got[p] == pytest.approx(sum(1 / size[q] for q, _ in found & true) / len(size), abs=1e-6)


def test_places_do_not_depend_on_blocks(small, spark):
    rows = spark.createDataFrame([(f"d{i:03}", ["a", "b"][: 1 + i % 2], [1.0, 2.0][: 1 + i % 2], [float(i % 7), 1.0][: 1 + i % 2]) for i in range(200)], "doc string, terms array<string>, idf array<double>, x array<double>")
    wanted = spark.createDataFrame([("q", "a"), ("q", "b"), ("r", "a"), ("s", "b"), ("s", "a"), ("t", "c")], "query string, term string")
    truth = spark.createDataFrame([(q, d) for q in "qrst" for d in ("d000", "d013", "d100", "none")], "query string, doc string")
    grid = [(2.0, 1.0), (5.0, 0.5)]

    def score(i, p, terms):
        x = {"a": p[0] * (i % 7)} | ({"b": p[0]} if i % 2 else {})
        return round(sum({"a": 1, "b": 2}[t] * x[t] / (p[1] + x[t]) for t in sorted(terms) if t in x), 9)

    want = {}
    for q, terms in {"q": "ab", "r": "a", "s": "ab"}.items():
        for i in (0, 13, 100):
            order = [[(-score(j, p, terms), j) for j in range(200)] for p in grid]
            want[q, f"d{i:03}"] = [sum(x < (-score(i, p, terms), i) for x in o) for p, o in zip(grid, order, strict=True)]
    for sizes in ({}, {"block_docs": 30, "slice_sets": 1}):
        got = termblocks.places_by_weighting(rows, wanted, truth, 200, grid, **sizes)
        assert {(r["query"], r.mine): list(r.before) for r in got.select("query", "mine", F.col("before")).collect()} == want


def test_search_makes_no_table_of_pairs_and_both_ways_agree(small, spark, monkeypatch):
    index, asked, _ = small
    order = lambda r: (-r.score, r.doc)
    want = {}
    for r in index.scores(asked).select("query", "doc", F.round("score", 9).alias("score")).collect():
        want.setdefault(r["query"], []).append(r)
    want = {(q, i + 1): (r.doc, pytest.approx(r.score, abs=2e-9)) for q, rows in want.items() for i, r in enumerate(sorted(rows, key=order)[:7])}

    def refuse(*_):
        raise AssertionError("all pairs")

    monkeypatch.setattr(Index, "scores", refuse)
    found = lambda df: {(r["query"], r.rnk): (r.doc, r.score) for r in df.collect()}
    assert found(index.search(asked, 7)) == want
    dice = random.Random(4)
    texts = [(f"d{i:02}", *(None if dice.random() < 0.1 else " ".join(dice.choices(WORDS, k=3)) for _ in FIELDS)) for i in range(80)]
    texts += [*texts[:20], ("d05", "кран", None, ""), ("d05", "кран", "", None)]  # repeats, and other texts of one id
    wide = spark.createDataFrame(texts, "doc string, title string, params string, description string")
    long = wide.distinct().select("doc", F.explode(F.array(*[F.struct(F.lit(f.name).alias("field"), F.coalesce(f.name, F.lit("")).alias("text")) for f in FIELDS])).alias("x")).select("doc", "x.*")
    assert found(search_once(wide, asked, 9)) == {k: (d, pytest.approx(v, abs=2e-9)) for k, (d, v) in found(build_index(long).search(asked, 9)).items()}
    assert search_once(wide, asked.where("query = 'none'"), 9).count() == search_once(wide, asked.where("query = 'empty'"), 9).count() == 0

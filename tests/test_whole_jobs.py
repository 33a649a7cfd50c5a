"""Queries that must do the whole job at the size of their tables, against definitions that share no constant with them."""

import hashlib

import duckdb
import pytest

from tessera.operators import fusion, rerank
from tessera.plans import models, reports, retrieval, sql, training
from tessera.plans.texts import INDEX

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    from pathlib import Path

    c = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def test_fused_chain_takes_all_near_vectors_and_the_category(spark, duck):
    got = {(r["query_id"], r["item_id"]): r for r in retrieval.collect_components(spark, FOLDER).collect()}
    # With 80 items all are among the 1000 nearest, so each query's pool is its lexical hits and every item with a vector.
    pool = duck.sql(f"""with {INDEX}, {retrieval._VEC} select query_id, item_id, max(l) lexical from
        (select query_id, item_id, round(score, 9) l from lex union all select query_id, item_id, 0.0::double from qv cross join iv) group by all""")
    duck.register("pool", pool.df())
    signed = duck.sql(f"with {sql.CORPUS}, {retrieval._ALL}, {retrieval._signals('pool')} select query_id, item_id, lexical, geo, facet, dense from sig").fetchall()
    pairs = spark.createDataFrame([(q, i) for q, i, *_ in signed], "query string, doc string")
    category = {(r.query, r.doc): r.microcat for r in retrieval._microcat(spark, FOLDER).apply(pairs).collect()}
    top = {}
    for q, _, lexical, *_ in signed:
        top[q] = max(top.get(q, 0.0), lexical)
    w, rows = fusion.WEIGHTS, {}
    for q, i, lexical, geo, facet, dense in signed:
        total = lexical / (top[q] or 1) + w["geo"] * geo + w["facet"] * facet + w["microcat"] * category[q, i] + w["dense"] * dense
        rows.setdefault(q, []).append((-round(total, 9), i))
    want = {(q, i): (n, -t) for q, found in rows.items() for n, (t, i) in enumerate(sorted(found)[:50], 1)}
    assert got.keys() == want.keys()
    for k, (n, t) in want.items():
        assert got[k]["rnk"] == n
        assert got[k]["total"] == pytest.approx(t, abs=2e-5)
        assert got[k]["microcat"] == pytest.approx(category[k], abs=2e-5)
    assert retrieval.DENSE_DEPTH == 1000


def test_local_benchmark_and_donor_have_the_size_of_the_tables(spark, duck):
    queries, items = duck.sql("select (select count(distinct query_id) from benchmark_queries), (select count(distinct item_id) from benchmark_items)").fetchall()[0]
    parts = {r.part: r.n for r in reports.benchmark_build(spark, FOLDER).collect()}
    # Only searches that fit the real ones in place, filter and words can be drawn.
    described = reports._DESCRIBED.replace("select ", "select query_id k, ", 1).replace("benchmark_queries", "keyed")
    eligible = duck.sql(f"""with real as ({reports._DESCRIBED}), {reports._KEYED}, log as ({described})
        select count(distinct k) from log where location in (select location from real) and empty_filter in (select empty_filter from real) and words in (select words from real)""").fetchall()[0][0]
    assert (parts["queries"], parts["corpus"]) == (min(queries, eligible), items)
    quota = items - round(0.3 * items)
    pairs = duck.sql(f"with {reports._KEYED} select query_id, item_id from keyed").fetchall()
    donor = {r.query_id for r in reports.donor_cut(spark, FOLDER).collect()}
    kept = {i for q, i in pairs if q not in donor}
    freed = {i for _, i in pairs} - kept
    assert kept
    assert len(freed) >= quota
    chosen = {r.query_id: (r.seen, r.unseen) for r in reports.donor_match(spark, FOLDER).collect()}
    corpus = {i for (i,) in duck.sql("select item_id from benchmark_items").fetchall()}
    with_seen = {q for q, i in pairs if q in donor and i in kept & corpus}
    # All of them, or as many as a third of the budget: 40000 a 2452 queries.
    assert len({q for q, (seen, _) in chosen.items() if seen}) == min(len(with_seen), round(queries * 40_000 / 2_452) // 3)


def test_neighbours_of_every_asked_item(spark, tmp_path):
    # One place for two items, one far away, one without coordinates, 200 times over.
    rows = [(f"{kind}{n}", lat, 30.0 if lat is not None else None) for n in range(200) for kind, lat in (("a", n / 5), ("b", n / 5), ("far", -80 + n / 5), ("none", None))]
    spark.createDataFrame(rows, "item_id string, item_latitude double, item_longitude double").write.parquet(f"{tmp_path}/benchmark_items.parquet")
    asked = {i for i, *_ in rows if int(hashlib.md5(f"50:{i}".encode()).hexdigest()[:12], 16) % 50 == 0}
    got = {r.item_id: (r.neighbours, r.nearest_km) for r in training.p3_neighbours(spark, str(tmp_path)).collect()}
    assert {i.rstrip("0123456789") for i in asked} == {"a", "b", "far", "none"}
    assert got == {i: (1, 0.0) if i[0] in "ab" else (0, None) for i in asked}


def test_registered_reranker_has_the_full_model(spark, monkeypatch):
    used = []
    whole = rerank.GBTClassifier

    def small(maxIter, maxDepth, stepSize, **how):  # noqa: N803 - as Spark names them
        used.append((maxIter, maxDepth, stepSize))
        return whole(maxIter=1, maxDepth=1, stepSize=stepSize, **how)

    monkeypatch.setattr(rerank, "GBTClassifier", small)
    rows = spark.createDataFrame([(f"q{i % 60}", f"d{i}", float(i % 7), i % 7 // 6) for i in range(600)], "query string, doc string, x double, label long")
    monkeypatch.setattr(models, "_features", lambda *_: rows.selectExpr("*", *[f"x as {c}" for c in models.features.FEATURES]))
    models.rerank_gbt(spark, FOLDER)
    assert used == [(400, 6, 0.05)] * 5
    models.rerank_importance(spark, FOLDER)
    assert used == [(400, 6, 0.05)] * 7


def test_rerank_queries_with_few_trees(spark, monkeypatch):
    larger = FOLDER.replace("sf0.001", "sf0.01")
    whole = rerank.GBTClassifier
    monkeypatch.setattr(rerank, "GBTClassifier", lambda maxIter, maxDepth, **how: whole(maxIter=3, maxDepth=3, **how))  # noqa: N803
    recall = {(r.run, r.k): r.recall for r in models.rerank_gbt(spark, larger).collect()}
    assert recall.keys() == {(run, k) for run in ("rerank", "fused", "ceiling") for k in (5, 10)}
    assert all(recall["ceiling", k] >= max(recall["rerank", k], recall["fused", k]) for k in (5, 10))
    found = models.rerank_importance(spark, larger).collect()
    for variant, n in (("all", 35), ("without_priors", 28)):
        own = [r.importance for r in found if r.variant == variant]
        assert len(own) == n
        assert sum(own) == pytest.approx(1)


def test_found_keys_are_those_of_the_params(spark, duck):
    found = {r.key for r in models.params_discover(spark, FOLDER.replace("sf0.001", "sf0.01")).collect()}
    known = {" ".join(k.split()) for (k,) in duck.sql("select param_key from param_keys").fetchall()}
    # Keys that always end in the same words, or that only part of the listings have, are told apart by these alone.
    assert len(found & known) >= len(known) / 2


def test_nearest_places_widen_until_they_have_enough(spark):
    import random

    from tessera.operators.exact import _by_all, nearest_places

    rng = random.Random(4)
    rows = [(f"i{n:04d}", rng.gauss(55, 0.2), rng.gauss(37, 0.3)) for n in range(1500)] + [(f"f{n:03d}", rng.uniform(-90, 90), rng.uniform(-180, 180)) for n in range(150)]
    rows += [("odd1", 95.0, 30.0), ("odd2", 55.0, 400.0), ("same1", 10.0, 10.0), ("same0", 10.0, 10.0)]
    items = spark.createDataFrame(rows, "doc string, ilat double, ilon double")
    asked = spark.createDataFrame([("a", 55.0, 37.0), ("b", 55.0, 37.0), ("c", -60.0, -170.0), ("d", 10.0, 10.0), ("e", 91.0, 0.0), ("f", 0.0, 180.0)], "query string, qlat double, qlon double")
    for k, sample in ((1, 8192), (20, 300), (2000, 8192)):
        got = {(r.query, r.rnk): (r.doc, r.score) for r in nearest_places(asked, items, k, sample).collect()}
        want = {(r.query, r.rnk): (r.doc, r.score) for r in _by_all(asked, items, k).collect()}
        assert {at: doc for at, (doc, _) in got.items()} == {at: doc for at, (doc, _) in want.items()}
        assert all(got[at][1] == pytest.approx(want[at][1], abs=1e-9) for at in want)
    assert nearest_places(asked, items.limit(0), 3).count() == 0
    assert nearest_places(asked.limit(0), items, 3).count() == 0

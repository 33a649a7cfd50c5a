"""The commands end to end on the smallest tables."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.__main__ import main
from tessera.operators import benchmark, rerank
from tessera.plans import answer, chain, experiments
from tessera.sources import tables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def work(tmp_path_factory):
    return str(tmp_path_factory.mktemp("work"))


@pytest.fixture
def run(spark, work, capsys):
    def call(*args, data=FOLDER):
        assert main(["--data", data, "--work", work, *args], spark) == 0
        return json.loads(capsys.readouterr().out)

    return call


def test_check_data_tells_sizes(run):
    found = {x["path"].rsplit("/", 1)[1]: x for x in run("check-data")}
    assert found["train.parquet"]["there"]
    assert found["train.parquet"]["mb"] == pytest.approx(0.051, abs=0.002)


def test_answer_by_text_alone_and_by_all_signals(run, spark, work):
    text = run("make-answer", "--no-geo", "--out", f"{work}/text.csv")
    assert text["used"] == ["lexical"]
    whole = run("make-answer")
    assert whole["used"] == ["lexical", "geo", "facet", "microcat", "dense"]
    assert whole["warnings"] == ["no model, or no vectors for it: ranked by the sum"]
    assert whole["empty_answers"] == 0
    assert run("validate-answer", f"{work}/answer.csv") == {}
    lines = open(f"{work}/answer.csv", "rb").read().split(b"\n")
    assert lines[0] == b"query_id,answer"
    assert len(lines) == 8  # six queries, the header and the end
    # A second time the saved index is read; the answer is the same.
    again = run("make-answer", "--out", f"{work}/again.csv")
    assert again == whole
    assert sorted(open(f"{work}/again.csv")) == sorted(open(f"{work}/answer.csv"))


def test_answer_without_vectors_says_so(spark):
    t = chain.open_tables(spark, FOLDER, dense=False)
    got = answer.rank(t, answer.Plan(top_k=5, dense_depth=10))
    assert got.warnings == ("no vectors: ranked without them",)
    per = {r["query"]: r["count"] for r in got.run.groupBy("query").count().collect()}
    assert set(per.values()) <= {5} | set(range(5))


def test_benchmark_commands(run, spark, work):
    larger = FOLDER.replace("sf0.001", "sf0.01")  # so that each fold has positives
    made = run("split", "--seen-share", "0.3", data=larger)
    assert made["sizes"]["queries"] >= 1
    assert {b["run"] for b in made["baselines"]} == {"random", "nearest"}
    local = benchmark.LocalBenchmark.load(spark, f"{work}/local_benchmark")
    assert local.meta == made["meta"]
    assert benchmark.LocalBenchmark.load(spark, f"{work}/local_benchmark", {**local.meta, "seed": 1}) is None
    pairs = tables.read_pairs(spark, larger)
    items = local.corpus_items(pairs, ["item_price"])
    assert items.count() == local.corpus.count()
    held = {r.query_id for r in local.query_ids().collect()}
    assert not held & {r.query_id for r in benchmark.with_query_id(local.fitted(pairs)).collect()}
    with pytest.raises(KeyError, match="1 items"):
        benchmark.LocalBenchmark(local.queries, local.qrels, local.corpus.unionAll(spark.createDataFrame([("x",)], "item_id string")), local.fit_pairs, local.donor, {}).corpus_items(pairs)
    found = run("baseline", "--no-grid", data=larger)
    assert {r["run"] for r in found["recall"]} == {"text", "text+filter"}
    assert run("donor-set", "--n-queries", "30", data=larger)["queries"] >= 1
    steps = run("fuse", data=larger)["steps"]
    assert {s["signal"] for s in steps} == {"facet", "microcat", "geo"}  # local queries have no vectors
    recalls = {r["run"]: r["mean"] for r in run("rerank", "--save", "--trees", "2", "--depth", "2", data=larger)["recall"]}
    assert max(recalls.values()) == recalls["ceiling"]
    model, used, name = rerank.load_model(spark, f"{work}/reranker")
    assert (len(used), name) == (35, "all")
    lost = run("errors", data=larger)
    assert lost["places"][0]["relevant"] == local.qrels.count()
    assert open(f"{work}/reports/errors.csv").readline().startswith("query,doc,rnk,hit")
    # The saved model now ranks the real queries' answer, and its features are kept.
    assert run("make-answer")["used"][-1] == "rerank"
    assert spark.read.parquet(f"{work}/artifacts/features/table.parquet").count() > 0


def test_lexical_grid_against_searches(spark):
    t = chain.open_tables(spark, FOLDER, dense=False)
    index = chain.lexical_index(t)
    truth = tables.qrels(spark, FOLDER).select(F.col("query_id").alias("query"), F.col("item_id").alias("doc"))
    points = [(20.0, 0.5, 1.0, 1.2), (1.0, 0.0, 0.5, 0.6), (40.0, 0.0, 2.0, 2.2)]
    got = {(r.title, r.params, r.description, r.k1): r.recall for r in experiments.lexical_grid(index, t.asked(), truth, 5, points).collect()}
    from tessera.operators import metrics

    for p in points:
        run = index.reweight(experiments.fields_of(*p[:3]), p[3]).search(t.asked(), 5)
        per = [r.recall for r in metrics.recall_per_query(run, truth, 5).collect()]
        assert got[p] == pytest.approx(sum(per) / len(per), abs=1e-5)


def test_reports_and_keys_as_files(run, spark, work):
    found = experiments.eda(spark, FOLDER, f"{work}/reports/eda.json", ["duplicates", "location_match"])
    assert json.load(open(f"{work}/reports/eda.json")) == found
    keys = run("param-keys", "--write")
    assert keys["pinned"] == 26
    assert len(tables.load_keys(spark, f"{work}/param_keys.json")) == keys["fresh"]


def test_vectors_must_be_those_of_the_items(spark, tmp_path):
    spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "item_id string, v array<float>").write.parquet(f"{tmp_path}/v.parquet")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "item_id string")
    assert tables.read_vectors(spark, f"{tmp_path}/v.parquet", "item_id", "v", ids("b", "a")).count() == 2
    with pytest.raises(ValueError, match="1 ids without a vector, 1 vectors of unknown ids"):
        tables.read_vectors(spark, f"{tmp_path}/v.parquet", "item_id", "v", ids("a", "c"))


def test_index_refuses_what_it_cannot_take(spark):
    from tessera.operators.index import Field, build_index

    docs = spark.createDataFrame([("d", "title", "a"), ("d", "title", "b")], "doc string, field string, text string")
    with pytest.raises(KeyError, match="text"):
        build_index(docs.drop("text"))
    with pytest.raises(ValueError, match="each document"):
        build_index(docs, [Field("title", 1.0, 0.5)], check=True)
    with pytest.raises(KeyError, match="nowhere"):
        build_index(docs).reweight([Field("nowhere", 1.0, 0.5)])

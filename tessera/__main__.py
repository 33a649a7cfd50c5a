"""Commands: python -m tessera COMMAND --data FOLDER …; each prints what it found as JSON."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tessera.session import local_session, ship


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description="Retrieval analytics over a folder of parquet tables.")
    p.add_argument("--data", default=".", help="folder of the tables")
    p.add_argument("--work", default="work", help="folder of benchmarks, models and reports")
    p.add_argument("--cores", type=int, default=0, help="run locally on so many cores; 0 takes the session that there is")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, text: sub.add_parser(name, help=text)
    add("check-data", "which tables are there")
    add("eda", "all reports")
    c = add("split", "build a local benchmark")
    c.add_argument("--seen-share", type=float, default=0.096)
    c.add_argument("--seed", type=int, default=42)
    c.add_argument("--no-sanity", action="store_true")
    c = add("baseline", "text search on the local benchmark")
    c.add_argument("--no-grid", action="store_true")
    add("fuse", "find the signals' weights")
    c = add("donor-set", "queries to train the re-ranker on")
    c.add_argument("--n-queries", type=int, default=40_000)
    c = add("rerank", "train and measure the re-ranker")
    c.add_argument("--save", action="store_true")
    c.add_argument("--trees", type=int, default=400)
    c.add_argument("--depth", type=int, default=6)
    c = add("make-answer", "answer the queries")
    for name, value in (("title", 20.0), ("params", 0.5), ("description", 1.0)):
        c.add_argument(f"--{name}", type=float, default=value)
    for name, value in (("geo", 0.1), ("facet", 0.1), ("microcat", 0.02), ("dense", 0.5)):
        c.add_argument(f"--{name}-weight", type=float, default=value)
    c.add_argument("--with-filter", action="store_true")
    c.add_argument("--no-geo", action="store_true", help="text alone")
    c.add_argument("--fusion", choices=("normalized", "raw", "rrf"), default="normalized")
    c.add_argument("--dense-depth", type=int, default=1000)
    c.add_argument("--no-rerank", action="store_true")
    c.add_argument("--out", default="")
    c = add("errors", "where relevant items were lost")
    c.add_argument("--top-k", type=int, default=50)
    c = add("param-keys", "find the keys of params afresh")
    c.add_argument("--sample", type=int, default=20_000)
    c.add_argument("--seed", type=int, default=0)
    c.add_argument("--write", action="store_true")
    c = add("validate-answer", "check an answer file")
    c.add_argument("path")
    return p


def run(spark: SparkSession, a: argparse.Namespace) -> dict | list:
    """What a command found, small by its meaning."""
    from tessera.operators import submission
    from tessera.plans import answer, experiments, retrieval
    from tessera.sources.tables import check_data, corpus, read_queries

    data, work = a.data.rstrip("/"), a.work.rstrip("/")
    saved, model = f"{work}/local_benchmark", f"{work}/reranker"
    match a.command:
        case "check-data":
            return check_data(spark, [f"{data}/{t}.parquet" for t in ("train", "benchmark_items", "benchmark_queries", "qrels", "item_vectors", "query_vectors", "param_keys")])
        case "eda":
            return experiments.eda(spark, data, f"{work}/reports/eda.json")
        case "split":
            return experiments.split(spark, data, saved, a.seen_share, a.seed, not a.no_sanity)
        case "baseline":
            return experiments.baseline(spark, data, saved, not a.no_grid)
        case "fuse":
            return experiments.fuse(spark, data, saved, retrieval.START, retrieval.DESCENT)
        case "donor-set":
            return experiments.donor_set(spark, data, saved, f"{work}/donor", a.n_queries)
        case "rerank":
            return experiments.rerank_on(spark, data, saved, model if a.save else None, trees=a.trees, depth=a.depth)
        case "errors":
            return experiments.errors(spark, data, saved, f"{work}/reports/errors.csv", model, a.top_k)
        case "param-keys":
            return experiments.param_keys(spark, data, None, a.sample, a.seed, f"{work}/param_keys.json" if a.write else None)
        case "validate-answer":
            answers = submission.read_submission(spark, a.path)
            found = submission.validate_submission(answers, read_queries(spark, data, ["query_id"]), corpus(spark, data, ["item_id"]))
            return {r["problem"]: r["n"] for r in found.collect()}
        case "make-answer":
            weights = {n: getattr(a, f"{n}_weight") for n in ("geo", "facet", "microcat", "dense")}
            plan = answer.Plan(
                fields=experiments.fields_of(a.title, a.params, a.description), with_filter=a.with_filter, mode=None if a.no_geo else a.fusion, weights=weights,
                dense_depth=a.dense_depth, model=None if a.no_rerank else model, cache=f"{work}/artifacts",
            )
            return answer.make_answer(spark, data, a.out or f"{work}/answer.csv", plan)
    raise ValueError(a.command)


def plain(found):
    """For JSON: small tables as lists of rows."""
    if isinstance(found, DataFrame):
        return [r.asDict(True) for r in found.collect()]
    return {k: plain(v) for k, v in found.items()} if isinstance(found, dict) else found


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if spark is None:
        spark = local_session(a.cores) if a.cores else ship(SparkSession.builder.appName("tessera").getOrCreate())
    print(json.dumps(plain(run(spark, a)), ensure_ascii=False, indent=1, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

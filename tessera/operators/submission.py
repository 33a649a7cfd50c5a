"""Building, checking, writing and reading answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import write_file

ID_PATTERN = "^[0-9a-f]{16}$"
ID_LENGTH = 16
TOP_K = 50
WARNINGS = ("empty_answers",)


class SubmissionError(ValueError):
    """The answer would be refused."""


def build_submission(run: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, answer): the docs of each query in rank order between blanks; '' for queries without."""
    lists = run.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rnk", "doc"))), lambda x: x["doc"]), " ").alias("answer"))
    if queries is not None:
        lists = queries.select("query").distinct().join(lists, "query", "left").withColumn("answer", F.coalesce("answer", F.lit("")))
    return lists.select(F.col("query").alias("query_id"), "answer")


def validate_submission(answers: DataFrame, expected: DataFrame, corpus: DataFrame | None = None, top_k: int = TOP_K) -> DataFrame:
    """(problem, n) of all kinds found; none means that the answer is fine.

    ``expected`` has query_id, ``corpus`` item_id. Wrong columns are the only problem told.
    """
    spark = answers.sparkSession
    if answers.columns != ["query_id", "answer"]:
        return spark.createDataFrame([("wrong_columns", 1)], "problem string, n bigint")
    rows = answers.select("query_id", F.filter(F.split(F.coalesce("answer", F.lit("")), " "), lambda x: x != "").alias("ids"))
    distinct = rows.select("query_id").distinct()
    wanted = expected.select("query_id").distinct()
    ids = rows.select(F.explode("ids").alias("item_id")).distinct()
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("problem"), "n")
    total = lambda name, c: rows.agg(F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).alias("n")).select(F.lit(name).alias("problem"), "n")
    found = [
        rows.agg((F.count(F.lit(1)) - F.count_distinct(F.coalesce("query_id", F.lit("")))).alias("n")).select(F.lit("repeated_queries").alias("problem"), "n"),
        one("missing_queries", wanted.join(distinct, "query_id", "left_anti")),
        one("unknown_queries", distinct.join(wanted, "query_id", "left_anti")),
        total("bad_query_length", F.length(F.coalesce("query_id", F.lit(""))) != ID_LENGTH),
        total("too_many_items", F.size("ids") > top_k),
        total("repeated_items", F.size(F.array_distinct("ids")) != F.size("ids")),
        one("malformed_items", ids.where(~F.col("item_id").rlike(ID_PATTERN))),
        total("empty_answers", F.size("ids") == 0),
    ]
    if corpus is not None:
        found.append(one("items_outside_corpus", ids.where(F.col("item_id").rlike(ID_PATTERN)).join(corpus.select("item_id").distinct(), "item_id", "left_anti")))
    out = found[0]
    for part in found[1:]:
        out = out.unionAll(part)
    return out.where("n > 0")


def split_problems(problems: Sequence[str]) -> tuple[list[str], list[str]]:
    """Those that block, and mere warnings."""
    return [p for p in problems if p not in WARNINGS], [p for p in problems if p in WARNINGS]


def save_submission(answers: DataFrame, path: str, expected: DataFrame, corpus: DataFrame | None = None, top_k: int = TOP_K) -> list[str]:
    """Writes one CSV file with LF line ends at ``path`` and returns the warnings; with a problem it raises and writes nothing."""
    problems = [r["problem"] for r in validate_submission(answers, expected, corpus, top_k).collect()]
    blocking, warnings = split_problems(problems)
    if blocking:
        raise SubmissionError(", ".join(sorted(blocking)))
    write_file(answers, path, "csv", header=True, lineSep="\n", emptyValue="")
    return warnings


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    """Ids stay text, an empty answer stays ''."""
    return spark.read.option("header", True).schema("query_id string, answer string").csv(path).select("query_id", F.coalesce("answer", F.lit("")).alias("answer"))

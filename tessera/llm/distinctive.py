"""How distinctive a term is per record: smoothed language-model divergence.

Record and collection are unigram models. A record's is Dirichlet-smoothed with the
collection's: p(t|d) = (tf + mu p(t|C)) / (|d| + mu). A term's score is its contribution to
their relative entropy, p(t|d) ln(p(t|d) / p(t|C)).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.packed import one_per_key
from tessera.operators.skew import salt_of
from tessera.session import durable

WORD = "[a-zа-я]{4,}"


def term_counts(df: DataFrame, record: str, fields: Sequence[str], pattern: str = WORD) -> DataFrame:
    """(r, len, term, tf) of each row: the matches of ``pattern`` in its fields, in lower case with ё as е.

    A word never spans two fields; ``len`` counts all matches. A row's words are counted where
    its text is, so no token is ever shuffled or hashed against other rows.
    """
    text = F.concat_ws("\n", *[F.col(f) for f in fields])
    rows = df.select(F.col(record).alias("r"), F.replace(F.lower(text), F.lit("ё"), F.lit("е")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(pattern).findall
        for batch in batches:
            row: list[int] = []
            length: list[int] = []
            term: list[str] = []
            tf: list[int] = []
            for i, words in enumerate(map(find, batch.column("text").to_pylist())):
                held = Counter(words)
                row.extend([i] * len(held))
                length.extend([len(words)] * len(held))
                term.extend(held.keys())
                tf.extend(held.values())
            yield pa.RecordBatch.from_arrays([batch.column("r").take(pa.array(row, pa.int32())), pa.array(length, pa.int64()), pa.array(term, pa.string()), pa.array(tf, pa.int64())], names=["r", "len", "term", "tf"])

    return rows.mapInArrow(count, f"r {dict(rows.dtypes)['r']}, len bigint, term string, tf bigint")


def term_scores(
    df: DataFrame, record: str, fields: Sequence[str], mu: float = 1000.0, least_df: int = 1, most_df: int | None = None, pattern: str = WORD
) -> DataFrame:
    """(record, term, tf, df, score) for every term of every record with least_df <= df <= most_df.

    Records that repeat an id count once (the least row); null ids take no part; null and
    empty fields hold no term, a record without any gives no row. All counts cover the
    whole collection: terms outside the df bounds still count in lengths and totals. The
    one number that goes to the driver is the collection's length. A word that most records
    share is spread over salts in the join with its own counts.
    """
    tf = term_counts(one_per_key(df, record, fields), record, fields, pattern).withColumn("salt", salt_of(["r"]))
    first = tf.groupBy("term", "salt").agg(F.count(F.lit(1)).alias("d"), F.sum("tf").alias("c"))
    # One row a term, kept: the collection's length and the join both read it.
    terms = durable(first.groupBy("term").agg(F.sum("d").alias("df"), F.sum("c").alias("cf"), F.collect_list("salt").alias("salts")))
    length = terms.agg(F.sum("cf")).first()[0] or 0
    bounds = F.col("df") >= least_df if most_df is None else F.col("df").between(least_df, most_df)
    joined = tf.join(terms.where(bounds).select("term", "df", "cf", F.explode("salts").alias("salt")), ["term", "salt"])
    background = F.col("cf") / F.lit(float(max(length, 1)))
    own = (F.col("tf") + mu * background) / (F.col("len") + mu)
    return joined.select(F.col("r").alias(record), "term", "tf", "df", (own * F.log(own / background)).alias("score"))

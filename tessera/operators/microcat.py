"""Categories of short texts: complement naive Bayes on character n-grams, as sparse joins.

A class's weight of a gram is -ln((all - own + a) / (sum over grams of all - own + a)). For a
gram that the class never had this is the same for all classes but for the denominator,
so a text's score needs only the grams that text and class share.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import lowered, normalize
from tessera.session import durable

MOST_CLASSES = 10_000


def gram_counts(texts: DataFrame, least: int = 3, most: int = 5) -> DataFrame:
    """(key, gram, tf) of (key, text): the n-grams of ``char_ngrams``, counted where the text is.

    A short text has some hundred grams of a few dozen words, so counting them in the batch
    spares the shuffle and the hashing of every single one.
    """
    rows = texts.select("key", lowered("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile("[0-9a-zа-я]+").findall
        for batch in batches:
            row: list[int] = []
            gram: list[str] = []
            tf: list[int] = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                held: Counter = Counter()
                for word in map(" {} ".format, find(text)):
                    for n in range(least, min(most, len(word)) + 1):
                        held.update(word[j : j + n] for j in range(len(word) - n + 1))
                row.extend([i] * len(held))
                gram.extend(held.keys())
                tf.extend(held.values())
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row, pa.int32())), pa.array(gram, pa.string()), pa.array(tf, pa.int64())], names=["key", "gram", "tf"])

    return rows.mapInArrow(count, f"key {dict(rows.dtypes)['key']}, gram string, tf bigint")


def gram_weights(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """(key, gram, w) of gram counts: sublinear tf times idf, to unit length; unknown grams are left out."""
    raw = counts.join(idf, "gram").select("key", "gram", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    size = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("key")))  # the grams of one short text
    return raw.select("key", "gram", (F.col("w") / size).alias("w"))


@dataclass(frozen=True)
class Classifier:
    idf: DataFrame  # gram, idf
    grams: DataFrame  # gram, all
    own: DataFrame  # class, gram, own
    classes: list[tuple]  # (class, its total)
    total: float
    size: int
    alpha: float

    def _shared(self, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(key, base, mass) of each text with a known gram, and (key, class, extra) of the classes that share one."""
        w = durable(gram_weights(gram_counts(texts.select("key", "text").distinct()), self.idf).join(self.grams, "gram"))
        base = w.groupBy("key").agg(F.sum(-F.col("w") * F.log(F.col("all") + self.alpha)).alias("base"), F.sum("w").alias("mass"))
        gain = F.col("w") * (F.log(F.col("all") + self.alpha) - F.log(F.col("all") - F.col("own") + self.alpha))
        return base, w.join(self.own, "gram").groupBy("key", "class").agg(F.sum(gain).alias("extra"))

    def _rests(self) -> dict:
        """ln of each class's denominator."""
        return {c: math.log(self.total - own + self.alpha * self.size) for c, own in self.classes}

    def _each(self, base: DataFrame) -> DataFrame:
        """(key, base, mass, class, ln) of every class."""
        kind = dict(self.own.dtypes)["class"]
        rest = F.array(*[F.struct(F.lit(c).cast(kind).alias("class"), F.lit(ln).alias("ln")) for c, ln in self._rests().items()])
        return base.select("key", "base", "mass", F.explode(rest).alias("x")).select("key", "base", "mass", "x.class", "x.ln")

    def log_proba(self, texts: DataFrame) -> DataFrame:
        """(key, class, lp) for every class and every text with a known gram."""
        base, shared = self._shared(texts)
        joint = self._each(base).join(shared, ["key", "class"], "left").withColumn("j", F.col("base") + F.coalesce("extra", F.lit(0.0)) + F.col("mass") * F.col("ln"))
        by = Window.partitionBy("key")  # a row a class
        top = joint.withColumn("m", F.max("j").over(by))
        return top.withColumn("z", F.log(F.sum(F.exp(F.col("j") - F.col("m"))).over(by)) + F.col("m")).select("key", "class", (F.col("j") - F.col("z")).alias("lp"))


def top_classes(model: Classifier, texts: DataFrame, k: int) -> DataFrame:
    """(key, class, rnk): the ``k`` likeliest classes of each text with a known gram, ties by smaller class.

    A class that shares no gram with a text scores mass * ln, whatever the text, so only the
    ``k`` best of these by ln can be among the first: with the classes that do share one they
    are all that is scored. Scores are rounded to 9 digits before they are ranked.
    """
    kind = dict(model.own.dtypes)["class"]
    rests = sorted(model._rests().items(), key=lambda x: (-x[1], x[0]))
    base, shared = model._shared(texts)
    if not rests:
        return base.select("key", F.lit(None).cast(kind).alias("class"), F.lit(0).cast("bigint").alias("rnk")).limit(0)
    lns = F.broadcast(texts.sparkSession.createDataFrame(rests, f"class {kind}, ln double"))  # at most MOST_CLASSES
    held = shared.join(lns, "class").groupBy("key").agg(F.collect_list(F.struct("class", "extra", "ln")).alias("s"))
    rows = base.join(held, "key", "left").withColumn("s", F.coalesce("s", F.array().cast(f"array<struct<class:{kind},extra:double,ln:double>>")))
    order, known = F.array(*[F.lit(c).cast(kind) for c, _ in rests]), F.create_map(*[x for c, ln in rests for x in (F.lit(c).cast(kind), F.lit(ln))])
    free = F.slice(F.array_except(order, F.transform("s", lambda x: x["class"])), 1, k)
    score = lambda c, extra, ln: F.struct(F.round(-(F.col("base") + extra + F.col("mass") * ln), 9).alias("s"), c.alias("class"))
    all_ = F.concat(F.transform("s", lambda x: score(x["class"], x["extra"], x["ln"])), F.transform(free, lambda c: score(c, F.lit(0.0), F.element_at(known, c))))
    best = rows.select("key", F.posexplode(F.slice(F.array_sort(all_), 1, k)).alias("rnk", "x"))
    return best.select("key", "x.class", (F.col("rnk") + 1).cast("bigint").alias("rnk"))


def fit(pairs: DataFrame, least_df: int = 3, alpha: float = 0.2, most: int = MOST_CLASSES) -> Classifier:
    """From (text, class) rows; texts are normalised and equal ones worked on once, with their count.

    The texts' grams and the model's tables are kept in the shared folder. Over ``most`` classes raise ValueError.
    """
    rows = durable(pairs.where(F.col("class").isNotNull()).groupBy(normalize("text").alias("key"), "class").agg(F.count(F.lit(1)).alias("n")))
    texts = rows.groupBy("key").agg(F.sum("n").alias("n"))
    counts = durable(gram_counts(texts.select("key", F.col("key").alias("text"))))
    grams = counts.join(texts, "key").groupBy("gram").agg(F.sum("n").alias("df")).where(F.col("df") >= least_df)
    n = rows.agg(F.sum("n")).first()[0] or 0
    idf = durable(grams.select("gram", (F.log((1.0 + n) / (1 + F.col("df"))) + 1).alias("idf")))
    weights = gram_weights(counts, idf).join(rows, "key")
    own = durable(weights.groupBy("class", "gram").agg(F.sum(F.col("w") * F.col("n")).alias("own")))
    every = durable(own.groupBy("gram").agg(F.sum("own").alias("all")))
    classes = rows.select("class").distinct().join(own.groupBy("class").agg(F.sum("own").alias("s")), "class", "left").limit(most + 1).collect()
    if len(classes) > most:
        raise ValueError(f"more than {most} classes")
    known = sorted((r["class"], r["s"] or 0.0) for r in classes)
    return Classifier(idf, every, own, known, sum(s for _, s in known), every.count(), alpha)


def log_ratios(proba: DataFrame, items: DataFrame) -> DataFrame:
    """(key, class, ratio): log-probability over the log of the class's share of the corpus (one item if it has none)."""
    n = items.count()
    share = items.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    return proba.join(share, "class", "left").select("key", "class", (F.col("lp") - F.log(F.coalesce("n", F.lit(1)) / F.lit(float(n)))).alias("ratio"))

"""Multi-field BM25F over long tables.

An index is three tables: postings (doc, field, term, tf), lengths (doc, field, len) and
vocabulary (term, df, idf). Boosts and length penalties come in late, as expressions, so
re-weighting never tokenises again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.params import telling_values
from tessera.functions.text import tokens, truncate
from tessera.operators.termblocks import Postings, best_by_terms, postings_of
from tessera.session import durable

K1 = 1.2
HOT = 20_000  # documents of a term that one join task may take


@dataclass(frozen=True)
class Field:
    name: str
    boost: float
    b: float


#: The default weights.
FIELDS = (Field("title", 20.0, 0.6), Field("params", 0.5, 0.75), Field("description", 1.0, 0.75))


def item_fields(items: DataFrame, doc: str = "item_id", keys: Sequence[str] | None = None, description_chars: int | None = None, address: bool = True) -> DataFrame:
    """(doc, field, text) of the three fields; null texts are ''.

    With ``keys`` the params are parsed and only their telling values indexed, without the
    address if so wished; ``description_chars`` cuts the description.
    """
    params = F.col("item_infm_params_text") if keys is None else F.array_join(telling_values("item_infm_params_text", keys, address), " ")
    description = F.col("item_description_raw") if description_chars is None else truncate("item_description_raw", description_chars)
    texts = {"title": F.col("item_title_raw"), "params": params, "description": description}
    parts = F.array(*[F.struct(F.lit(n).alias("field"), F.coalesce(c, F.lit("")).alias("text")) for n, c in texts.items()])
    return items.select(F.col(doc).alias("doc"), F.explode(parts).alias("x")).select("doc", "x.field", "x.text")


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    lengths: DataFrame
    vocabulary: DataFrame
    fields: tuple[Field, ...] = FIELDS
    k1: float = K1
    known: tuple[str, ...] = tuple(f.name for f in FIELDS)  # the fields that were indexed
    documents: int | None = None

    def reweight(self, fields: Sequence[Field] | None = None, k1: float | None = None) -> Index:
        """The same tables under other weights; idf stays. Unknown fields raise KeyError."""
        chosen = tuple(fields) if fields is not None else self.fields
        unknown = [f.name for f in chosen if f.name not in self.known]
        if unknown:
            raise KeyError(f"no such fields: {', '.join(unknown)}")
        return replace(self, fields=chosen, k1=self.k1 if k1 is None else k1)

    def size(self) -> int:
        """About the number of documents, as blocks are cut by it."""
        return self.documents if self.documents is not None else self.lengths.count() // max(1, len(self.known))

    def averages(self) -> dict[str, float]:
        """Mean length of the non-empty texts by field; one row a field comes to the driver."""
        rows = self.lengths.where("len > 0").groupBy("field").agg(F.avg("len").alias("a")).collect()
        return {r["field"]: r["a"] for r in rows}

    def _norm(self, averages: dict[str, float]) -> tuple[Column, Column]:
        boost, norm = F.lit(None).cast("double"), F.lit(None).cast("double")
        for f in self.fields:
            mine = F.col("field") == f.name
            boost = F.when(mine, f.boost).otherwise(boost)
            length = F.when(F.col("len") > 0, 1 - f.b + f.b * F.col("len") / averages.get(f.name, 1.0)).otherwise(1.0)
            norm = F.when(mine, length).otherwise(norm)
        return boost, norm

    def weights(self, terms: DataFrame | None = None) -> DataFrame:
        """(doc, term, w): the saturated sum over fields times idf; only for ``terms`` if given.

        Restricting to terms comes before any weight is computed; lengths and idf are
        those of the whole collection all the same.
        """
        boost, norm = self._norm(self.averages())
        known = self.postings.where(F.col("field").isin([f.name for f in self.fields]))
        if terms is not None:
            known = known.join(terms.select("term").distinct(), "term", "left_semi")
        summed = known.groupBy("doc", "term").agg(F.sum(boost * F.col("tf") / norm).alias("x"))
        return summed.join(self.vocabulary.select("term", "idf"), "term").select("doc", "term", (F.col("idf") * F.col("x") / (self.k1 + F.col("x"))).alias("w"))

    def scores(self, queries: DataFrame) -> DataFrame:
        """(query, doc, score) of every pair that shares a term; ``queries`` has (query, text).

        A term counts once in a query. Unknown words and empty queries give nothing. A term
        of more than ``HOT`` documents is dealt to as many parts as that makes, the queries
        that ask for it going to each.
        """
        parts = F.ceil(F.col("df") / HOT).cast("int")
        wanted = query_terms(queries).join(self.vocabulary.select("term", parts.alias("parts")), "term")
        there = self.weights(wanted).join(wanted.select("term", "parts").distinct(), "term").select("doc", "term", "w", F.pmod(F.xxhash64("doc"), "parts").cast("int").alias("part"))
        asked = wanted.select("query", "term", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        return asked.join(there, ["term", "part"]).groupBy("query", "doc").agg(F.sum("w").alias("score"))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query, rnk, doc, score): the ``k`` best, ties by smaller doc."""
        wanted = durable(query_terms(queries).join(self.vocabulary.select("term"), "term", "left_semi").select("query", "term"))
        held = self.weights(wanted).groupBy("doc").agg(F.collect_list(F.struct("term", "w")).alias("x")).select("doc", F.col("x.term").alias("terms"), F.col("x.w").alias("w"))
        return best_by_terms(held, wanted, self.size(), k, lambda rows: postings_of(rows, ["w"]))

    def presence(self, pairs: DataFrame, queries: DataFrame, field: str) -> DataFrame:
        """For each (query, doc) of ``pairs`` the coverage of the query's known terms in ``field``
        plain and by idf (0 without terms), and the field's own BM25."""
        got = self.presences(pairs, queries, [field])
        return got.select("query", "doc", *[F.col(f"{field}_{c}").alias(c) for c in ("coverage", "coverage_idf", "bm25")])

    def presences(self, pairs: DataFrame, queries: DataFrame, names: Sequence[str]) -> DataFrame:
        """``presence`` of several fields at once, their names before the columns': pairs meet their terms only once."""
        chosen = {f.name: f for f in self.fields}
        missing = [n for n in names if n not in chosen]
        if missing:
            raise KeyError(", ".join(missing))
        averages = self.averages()
        wanted = query_terms(queries).join(self.vocabulary.select("term", "idf"), "term")
        asked = pairs.select("query", "doc").distinct().join(wanted, "query", "left")
        of = lambda n, c: F.max(F.when(F.col("field") == n, F.col(c))).alias(f"{c}_{n}")
        words = F.broadcast(wanted.select("term").distinct())
        there = self.postings.where(F.col("field").isin(list(names))).join(words, "term", "left_semi").groupBy("doc", "term").agg(*[of(n, c) for n in names for c in ("tf", "len")])
        out = []
        for n in names:
            tf = F.coalesce(F.col(f"tf_{n}"), F.lit(0)).cast("double")
            x = tf / (1 - chosen[n].b + chosen[n].b * F.coalesce(F.col(f"len_{n}"), F.lit(0)) / averages.get(n, 1.0))
            out += [
                F.coalesce(F.sum(F.when(tf > 0, 1.0).otherwise(0.0)) / F.nullif(F.count("term"), F.lit(0)), F.lit(0.0)).alias(f"{n}_coverage"),
                F.coalesce(F.sum(F.when(tf > 0, F.col("idf")).otherwise(0.0)) / F.nullif(F.sum("idf"), F.lit(0.0)), F.lit(0.0)).alias(f"{n}_coverage_idf"),
                F.coalesce(F.sum(F.col("idf") * x / (self.k1 + x)), F.lit(0.0)).alias(f"{n}_bm25"),
            ]
        return asked.join(there, ["doc", "term"], "left").groupBy("query", "doc").agg(*out)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query, term), each term once."""
    return queries.select("query", F.explode(F.array_distinct(tokens("text"))).alias("term"))


def build_index(documents: DataFrame, fields: Sequence[Field] = FIELDS, k1: float = K1, tokenizer: Callable[[str], Column] = tokens, least_df: int = 1, check: bool = False, keep: bool = False) -> Index:
    """An index of (doc, field, text) rows, one row per doc and field.

    ``tokenizer`` makes an array column of a text column's name. A text's length counts all
    its tokens; a term needs ``least_df`` documents summed over the fields, while idf counts
    a document once whichever fields have the term. idf = ln(1 + (N - df + .5) / (df + .5)).
    Missing columns raise KeyError; ``check`` also looks for documents that lack or repeat a
    field, which raise ValueError. With ``keep`` the tokens and the vocabulary are written to
    the checkpoint folder, so that what is read several times is tokenised once.
    """
    missing = [c for c in ("doc", "field", "text") if c not in documents.columns]
    if missing:
        raise KeyError(f"missing columns: {', '.join(missing)}")
    if check:
        shape = documents.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("field").alias("d")).where((F.col("n") != len(fields)) | (F.col("d") != len(fields)))
        if not shape.isEmpty():
            raise ValueError("each document needs one text in each field")
    cut = documents.select("doc", "field", tokenizer("text").alias("words"))
    cut = durable(cut) if keep else cut
    lengths = cut.select("doc", "field", F.size("words").cast("bigint").alias("len"))
    postings = cut.select("doc", "field", F.size("words").cast("bigint").alias("len"), F.explode("words").alias("term")).groupBy("doc", "field", "term", "len").agg(F.count(F.lit(1)).alias("tf"))
    if least_df > 1:
        enough = postings.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_df)
        postings = postings.join(enough, "term", "left_semi")
    n = lengths.select("doc").distinct().count()
    df = postings.select("term", "doc").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df = durable(df) if keep else df
    vocabulary = df.select("term", "df", F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    return Index(postings, lengths, vocabulary, tuple(fields), k1, tuple(f.name for f in fields), n)


def search_once(documents: DataFrame, queries: DataFrame, k: int, fields: Sequence[Field] = FIELDS, k1: float = K1) -> DataFrame:
    """What ``search`` of an index of (doc, a text a field) gives, without keeping the index: of the texts only
    lengths and the places of asked words stay, a row a document.

    Repeated rows count once. The distinct words of all queries go to every worker.
    """
    names = [f.name for f in fields]
    asked = durable(query_terms(queries))
    words = pa.array(sorted(r["term"] for r in asked.select("term").distinct().collect()), pa.string())
    # Texts behind their lengths, so that no two rows of different texts give the same.
    mark = F.unhex(F.md5(F.concat(*[F.coalesce(F.concat(F.length(n).cast("string"), F.lit(":"), F.col(n)), F.lit("-")) for n in names])))
    cut = documents.select("doc", mark.alias("mark"), *[tokens(n).alias(n) for n in names])

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """An asked word's code is its place among the words, times the fields, plus the field; repeats stay."""
        for b in batches:
            sizes = np.stack([pc.list_value_length(b.column(n)).to_numpy(zero_copy_only=False) for n in names], axis=1).astype(np.int32)
            rows, codes = [], []
            for f, n in enumerate(names):
                at = pc.index_in(b.column(n).flatten(), value_set=words)
                there = at.is_valid().to_numpy(zero_copy_only=False)
                rows.append(np.repeat(np.arange(b.num_rows), sizes[:, f])[there])
                codes.append(at.drop_null().to_numpy(zero_copy_only=False).astype(np.int64) * len(names) + f)
            row, code = np.concatenate(rows), np.concatenate(codes)
            order = np.lexsort((code, row))
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b.num_rows))])
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * len(names), pa.int32()), pa.array(sizes.ravel())), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(code[order].astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("mark"), *lists], names=["doc", "mark", "sizes", "codes"])

    kind = dict(documents.dtypes)["doc"]
    read = cut.mapInArrow(narrow, f"doc {kind}, mark binary, sizes array<int>, codes array<int>")
    held = durable(read.groupBy("doc").agg(F.collect_set(F.struct("mark", "sizes", "codes")).alias("x")).select("doc", F.col("x.sizes").alias("sizes"), F.col("x.codes").alias("codes")))
    lengths = held.select("doc", F.explode("sizes").alias("s")).agg(F.count_distinct("doc").alias("n"), *[F.avg(F.when(F.col("s")[i] > 0, F.col("s")[i])).alias(f"a{i}") for i in range(len(names))]).first()
    n, averages = lengths["n"], [lengths[f"a{i}"] or 1.0 for i in range(len(names))]
    df = held.select(F.explode(F.array_distinct(F.transform(F.flatten("codes"), lambda c: F.floor(c / len(names)).cast("int")))).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("df"))
    idf = np.zeros(len(words))
    for r in df.select("code", F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")).collect():
        idf[r["code"]] = r["idf"]

    def grow(rows: pa.Table) -> Postings:
        rows = rows.sort_by("doc").combine_chunks()
        versions = rows.column("codes").combine_chunks()
        of = np.repeat(np.arange(rows.num_rows), pc.list_value_length(versions).to_numpy(zero_copy_only=False))
        size = rows.column("sizes").combine_chunks().flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(names))
        each = versions.flatten()
        version = np.repeat(np.arange(len(each)), pc.list_value_length(each).to_numpy(zero_copy_only=False))
        code = each.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        key, tf = np.unique(version * (len(words) * len(names)) + code, return_counts=True)
        version, code = np.divmod(key, len(words) * len(names))
        word, field = np.divmod(code, len(names))
        boost, b, a = (np.array(x)[field] for x in ([f.boost for f in fields], [f.b for f in fields], averages))
        pair, at = np.unique(of[version] * len(words) + word, return_inverse=True)
        x = np.bincount(at, boost * tf / (1 - b + b * size[version, field] / a), len(pair))
        place, word = np.divmod(pair, len(words))
        return Postings.of(rows.column("doc").combine_chunks(), place, pa.array(word.astype(np.int32)), (idf[word] * x / (k1 + x))[:, None])

    known = asked.sparkSession.createDataFrame([(w, i) for i, w in enumerate(words.to_pylist()) if idf[i]], "term string, code int")
    wanted = asked.join(known, "term").select("query", F.col("code").alias("term"))
    return best_by_terms(held, wanted, n, k, grow)

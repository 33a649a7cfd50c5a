"""Text scores by blocks: the term sets of many queries against the postings of a block of documents.

Pairs of query and document live only inside a task; what leaves a block is a bounded list a
query. Term sets that several queries share are scored once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.blocks import block_join
from tessera.session import durable

BLOCK_DOCS = 1 << 17  # documents of a block, whose postings a task holds
SLICE = 8_192  # term sets that a task meets with a block
GRID_BLOCK, GRID_SLICE, GRID_PART = 20_000, 2_048, 4_000  # the same for many weightings, and the documents whose scores by all of them are held at once
BATCH = 1_024


def alike(wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((query, lead), (lead, asks)) of (query, term): a set of terms goes by the least query that asks for it."""
    each = durable(wanted.groupBy("query").agg(F.array_sort(F.collect_set("term")).alias("asks")))
    sets = durable(each.groupBy("asks").agg(F.min("query").alias("lead")).select("lead", "asks"))
    return each.join(sets, "asks").select("query", "lead"), sets


@dataclass(frozen=True)
class Postings:
    """A block's postings, term after term; ``docs`` is in order, so smaller places are smaller ids."""

    docs: pa.Array
    terms: pa.Array
    start: np.ndarray
    place: np.ndarray
    values: np.ndarray  # a row a posting

    @classmethod
    def of(cls, docs: pa.Array, place: np.ndarray, terms: pa.Array, values: np.ndarray) -> Postings:
        coded = terms.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        order = np.lexsort((place, code))
        start = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(coded.dictionary)))])
        return cls(docs, coded.dictionary, start, place[order].astype(np.int64), values[order])

    def asked(self, lists: pa.ListArray) -> list[list[int]]:
        """For each list of terms the codes of those that the block has."""
        at = pc.index_in(lists.flatten(), value_set=self.terms).to_pylist()
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
        return [[c for c in at[a:b] if c is not None] for a, b in zip(ends, ends[1:], strict=False)]


def postings_of(rows: pa.Table, names: Sequence[str]) -> Postings:
    """The postings of rows (doc, terms, a list for each of ``names``), a row a document."""
    rows = rows.sort_by("doc").combine_chunks()
    flat = lambda c: rows.column(c).combine_chunks().flatten()
    sizes = pc.list_value_length(rows.column("terms")).to_numpy()
    values = np.stack([flat(c).to_numpy(zero_copy_only=False).astype(float) for c in names], axis=1)
    return Postings.of(rows.column("doc").combine_chunks(), np.repeat(np.arange(len(sizes)), sizes), flat("terms"), values)


def _dealt(build: DataFrame, sets: DataFrame, docs: int, block_docs: int, slice_sets: int) -> tuple[DataFrame, DataFrame, int]:
    """Every slice of the sets with every block of the documents, and how many such pairs there are."""
    n, m = max(1, math.ceil(docs / block_docs)), max(1, math.ceil(sets.count() / slice_sets))
    of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    theirs = build.withColumn("block", F.explode(F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda s: of("doc", n) * m + s)))
    asked = sets.withColumn("block", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: b * m + of("lead", m))))
    return theirs, asked, n * m


def best_by_terms(build: DataFrame, wanted: DataFrame, docs: int, k: int, open_block: Callable[[pa.Table], Postings], block_docs: int = BLOCK_DOCS, slice_sets: int = SLICE) -> DataFrame:
    """(query, rnk, doc, score): the ``k`` documents of highest sum over a query's terms, ties by smaller doc.

    ``wanted`` has (query, term), ``build`` doc, a row a document, and what ``open_block`` makes
    postings of one value from. ``docs``, about their number, decides on blocks alone.
    """
    asked, sets = alike(wanted)
    theirs, probe, parts = _dealt(build, sets, docs, block_docs, slice_sets)

    def best(index: Postings, rows: pa.RecordBatch) -> pa.RecordBatch:
        who, where, how = [], [], []
        seen = np.zeros(len(index.docs), bool)
        for i, codes in enumerate(index.asked(rows.column("asks"))):
            if not codes:
                continue
            spans = [slice(index.start[c], index.start[c + 1]) for c in codes]
            place = np.concatenate([index.place[s] for s in spans])
            total = np.bincount(place, np.concatenate([index.values[s, 0] for s in spans]))
            seen[place] = True
            there = np.flatnonzero(seen)
            seen[place] = False
            score = np.round(total[there], 9)
            if len(there) > k:
                keep = score >= np.partition(score, len(score) - k)[len(score) - k]
                there, score = there[keep], score[keep]
            order = np.lexsort((there, -score))[:k]
            who.append(np.full(len(order), i))
            where.append(there[order])
            how.append(score[order])
        i, j, v = (np.concatenate(x) if x else np.zeros(0, int) for x in (who, where, how))
        return pa.RecordBatch.from_arrays([rows.column("lead").take(pa.array(i)), index.docs.take(pa.array(j)), pa.array(v, pa.float64())], names=["lead", "doc", "score"])

    kinds = dict(sets.dtypes)["lead"], dict(build.dtypes)["doc"]
    found = block_join(theirs, probe, open_block, best, f"lead {kinds[0]}, doc {kinds[1]}, score double", BATCH, parts)
    ranked = found.withColumn("rnk", F.row_number().over(Window.partitionBy("lead").orderBy(F.col("score").desc(), "doc"))).where(F.col("rnk") <= k)
    return asked.join(ranked, "lead").select("query", F.col("rnk").cast("bigint").alias("rnk"), "doc", "score")


def places_by_weighting(build: DataFrame, wanted: DataFrame, relevant: DataFrame, docs: int, grid: Sequence[Sequence[float]], block_docs: int = GRID_BLOCK, slice_sets: int = GRID_SLICE) -> DataFrame:
    """(query, mine, own, before): for each relevant document that a query's terms find its score under each weighting, and how many documents come before it.

    ``build`` has (doc, terms, idf and a list for each field), ``grid`` the fields' boosts and the saturation of each
    weighting. The scores of the relevant documents come first; they then go to every block, which counts what is ahead of them.
    """
    names = [c for c in build.columns if c not in ("doc", "terms", "idf")]
    points = np.array(grid, float)
    asked, sets = alike(wanted)
    mine = asked.join(relevant.select("query", "doc").distinct(), "query")
    pairs = mine.select("lead", F.col("doc").alias("mine")).distinct().join(sets, "lead")

    def weights(values: np.ndarray) -> np.ndarray:
        """A row a posting, a column a weighting."""
        x = points[:, 0] * values[:, 1, None]
        for f in range(1, len(names)):
            x += points[:, f] * values[:, f + 1, None]
        return values[:, 0, None] * x / (points[:, -1] + x)

    def grow(rows: pa.Table) -> Postings:
        return postings_of(rows, ["idf", *names])

    def own(index: Postings, rows: pa.RecordBatch) -> pa.RecordBatch:
        at = pc.index_in(rows.column("mine"), value_set=index.docs).to_pylist()
        who, scores = [], []
        for i, codes in enumerate(index.asked(rows.column("asks"))):
            hits = []
            for c in codes if at[i] is not None else ():
                p = index.start[c] + np.searchsorted(index.place[index.start[c] : index.start[c + 1]], at[i])
                if p < index.start[c + 1] and index.place[p] == at[i]:
                    hits.append(p)
            if hits:
                total = np.zeros(len(points))
                for w in weights(index.values[hits]):
                    total += w
                who.append(i)
                scores.append(np.round(total, 9))
        flat = pa.array(np.concatenate(scores) if scores else np.zeros(0))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(who) + 1) * len(points), pa.int32()), flat)
        keep = pa.array(who, pa.int64())
        return pa.RecordBatch.from_arrays([rows.column("lead").take(keep), rows.column("mine").take(keep), lists], names=["lead", "mine", "own"])

    n = max(1, math.ceil(docs / block_docs))
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(n))
    kinds = dict(sets.dtypes)["lead"], dict(build.dtypes)["doc"]
    scored = durable(block_join(build.withColumn("block", at("doc")), pairs.withColumn("block", at("mine")), grow, own, f"lead {kinds[0]}, mine {kinds[1]}, own array<double>"))

    def parted(rows: pa.Table) -> list[Postings]:
        rows = rows.sort_by("doc").combine_chunks()
        return [grow(rows.slice(i, GRID_PART)) for i in range(0, rows.num_rows, GRID_PART)]

    def ahead(index: list[Postings], rows: pa.RecordBatch) -> pa.RecordBatch:
        mine = rows.column("mine").flatten()
        owns = rows.column("own").flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(points))
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(rows.column("mine")).to_numpy(zero_copy_only=False))])
        count = np.zeros((len(mine), len(points)), np.int64)
        for part in index:
            names = part.docs.to_pylist()
            smaller = np.searchsorted(np.array(names, object), np.array(mine.to_pylist(), object))
            by_all = weights(part.values)
            total = np.zeros((len(names), len(points)))
            seen = np.zeros(len(names), bool)
            for i, codes in enumerate(part.asked(rows.column("asks"))):
                if not codes:
                    continue
                for c in codes:
                    span = slice(part.start[c], part.start[c + 1])
                    total[part.place[span]] += by_all[span]
                    seen[part.place[span]] = True
                there = np.flatnonzero(seen)
                score = np.round(total[there], 9)
                for j in range(ends[i], ends[i + 1]):
                    low = np.searchsorted(there, smaller[j])
                    count[j] += (score[:low] >= owns[j]).sum(axis=0)
                    count[j] += (score[low:] > owns[j]).sum(axis=0)
                total[there] = 0.0
                seen[there] = False
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(mine) + 1) * len(points), pa.int32()), pa.array(count.ravel()))
        return pa.RecordBatch.from_arrays([rows.column("lead").take(pa.array(np.repeat(np.arange(rows.num_rows), np.diff(ends)))), mine, lists], names=["lead", "mine", "before"])

    probe = scored.groupBy("lead").agg(F.collect_list(F.struct("mine", "own")).alias("x")).select("lead", F.col("x.mine").alias("mine"), F.col("x.own").alias("own")).join(sets, "lead")
    theirs, probe, parts = _dealt(build, probe, docs, block_docs, slice_sets)
    found = block_join(theirs, probe, parted, ahead, f"lead {kinds[0]}, mine {kinds[1]}, before array<bigint>", BATCH, parts)
    before = found.groupBy("lead", "mine").agg(F.array(*[F.sum(F.col("before")[i]) for i in range(len(points))]).alias("before"))
    return mine.select("query", "lead", F.col("doc").alias("mine")).join(scored, ["lead", "mine"]).join(before, ["lead", "mine"]).select("query", "mine", "own", "before")

"""Mixing sources to target weights, measured in tokens of a public tokenizer.

Weights run down a tree (domain, language, source). A node's budget is shared among its
children by weight, but none gets more than its leaves can give when repeated as often as
allowed; what a child can't take goes to its siblings first and to the node's own siblings
only when all children are full. Each leaf then gives whole epochs of its records and a
token-prefix of one more, in a seeded order.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import durable

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
MOST_LEAVES = 1000
BUCKETS = 1024
PIECE = 20_000
#: Fixed: the word pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODERS: dict = {}


def pieces(text: str, most: int = PIECE) -> list[str]:
    """A text in pieces of at most ``most`` characters, cut where a blank begins if there is one."""
    out, at = [], 0
    while len(text) - at > most:
        end = at + most
        while end > at + 1 and not (text[end].isspace() and not text[end - 1].isspace()):
            end -= 1
        end = end if end > at + 1 else at + most
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def token_count(spark: SparkSession, text: str, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of a text column; 0 for null and ''. The vocabulary (under a few MB) is broadcast.

    Very long texts are encoded in pieces cut at blanks; a run of more than ``PIECE``
    characters without a blank is cut inside, which can change its count by a token a cut.
    """
    raw = Path(vocabulary).read_bytes()
    digest = hashlib.sha256(raw).hexdigest()
    shared = spark.sparkContext.broadcast(raw)

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        import tiktoken

        if digest not in _ENCODERS:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
            _ENCODERS[digest] = tiktoken.Encoding(digest[:12], pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        encode = _ENCODERS[digest].encode_ordinary
        return pd.Series([sum(len(encode(p)) for p in pieces(t)) if t else 0 for t in texts], dtype="int64")

    return count(F.col(text))


@dataclass(frozen=True)
class Leaf:
    path: tuple[str, ...]
    weight: float
    size: int
    repeats: float

    @property
    def room(self) -> float:
        return self.size * self.repeats


def budgets(leaves: Sequence[Leaf], total: float) -> dict[tuple[str, ...], float]:
    """Tokens for each leaf; their sum is ``total`` unless all leaves are full."""
    out: dict[tuple[str, ...], float] = {}

    def share(group: list[Leaf], depth: int, budget: float) -> None:
        if len(group) == 1 and depth >= len(group[0].path):
            out[group[0].path] = min(budget, group[0].room)
            return
        children: dict[str, list[Leaf]] = {}
        for leaf in group:
            children.setdefault(leaf.path[depth], []).append(leaf)
        room = {k: sum(x.room for x in v) for k, v in children.items()}
        weight = {k: sum(x.weight for x in v) for k, v in children.items()}
        given, open_, rest = dict.fromkeys(children, 0.0), set(children), budget
        while open_ and rest > 1e-9:
            of = sum(weight[k] for k in open_)
            if of <= 0:
                break
            full = {k for k in open_ if given[k] + rest * weight[k] / of >= room[k]}
            if not full:
                for k in open_:
                    given[k] += rest * weight[k] / of
                break
            # Children that would overflow take what fits; the rest is shared again.
            for k in full:
                rest -= room[k] - given[k]
                given[k] = room[k]
            open_ -= full
        for k, v in sorted(children.items()):
            share(v, depth + 1, given[k])

    if leaves:
        share(sorted(leaves, key=lambda x: x.path), 0, total)
    return out


def mix_plan(sizes: Sequence[tuple[tuple[str, ...], int]], targets: dict[str, tuple[float, float]]) -> list[dict]:
    """A row per leaf: path, size, target tokens, room and budget.

    ``sizes``: (path, tokens), the last part of a path being the source. ``targets``: share
    and most repeats by source. A source's share is divided among its leaves by their size;
    the whole budget is the total size times the sum of the shares.
    """
    by_source: dict[str, int] = {}
    for path, n in sizes:
        by_source[path[-1]] = by_source.get(path[-1], 0) + n
    total = sum(by_source.values())
    leaves = []
    for path, n in sizes:
        target, repeats = targets[path[-1]]
        leaves.append(Leaf(path, target * n / by_source[path[-1]] if by_source[path[-1]] else 0.0, n, repeats))
    given = budgets(leaves, total * sum(share for share, _ in targets.values()))
    return [{"path": x.path, "size": x.size, "target": x.weight * total, "room": x.room, "budget": given[x.path]} for x in leaves]


def short_sources(plan: Sequence[dict], targets: dict[str, tuple[float, float]]) -> list[str]:
    """Sources whose budgets stay under their target: what they may be repeated can't fill it.

    Only a source whose leaves are all full gets less than its target, as what a child
    can't take is only ever added to others. One without any record is short too.
    """
    total = sum(p["size"] for p in plan)
    got = dict.fromkeys(targets, 0.0)
    for p in plan:
        got[p["path"][-1]] += p["budget"]
    return sorted(s for s, (share, _) in targets.items() if got[s] < share * total * (1 - 1e-9))


def select_records(sized: DataFrame, plan: Sequence[dict], record: str, seed: int = 0) -> DataFrame:
    """(record, leaf, tokens, copies) with copies > 0, so that each leaf gives at most its budget.

    ``sized`` has the record id, ``leaf`` (the place in ``plan``) and ``tokens``. A leaf gives
    floor(budget / size) whole epochs and, of the next epoch's seeded order, the longest
    prefix within the rest; a record without tokens is never selected. The order is cut into hash buckets, so no leaf is ever sorted
    as one.
    """
    spark = sized.sparkSession
    rows = []
    for number, p in enumerate(plan):
        whole = int(p["budget"] // p["size"]) if p["size"] else 0
        rows.append((number, whole, int(p["budget"] - whole * p["size"]) if p["size"] else 0))
    wanted = F.broadcast(spark.createDataFrame(rows, "leaf int, whole int, rest bigint"))  # at most MOST_LEAVES rows
    ordered = sized.join(wanted, "leaf").withColumn("h", F.xxhash64(F.lit(seed), "whole", record)).withColumn("bucket", F.shiftrightunsigned("h", 54).cast("int"))
    by_bucket = ordered.groupBy("leaf", "bucket").agg(F.sum("tokens").alias("n"))
    before = by_bucket.select("leaf", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("leaf").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.sum("tokens").over(Window.partitionBy("leaf", "bucket").orderBy(F.shiftleft("h", 10), "h", record).rowsBetween(Window.unboundedPreceding, 0))
    cut = ordered.withColumn("upto", inside).join(before, ["leaf", "bucket"])
    copies = F.col("whole") + F.when(F.col("before") + F.col("upto") <= F.col("rest"), 1).otherwise(0)
    return cut.select(record, "leaf", "tokens", copies.cast("int").alias("copies")).where("copies > 0 and tokens > 0")


def clean_name(column: str) -> Column:
    """Trimmed of all white space and in lower case."""
    return F.lower(F.regexp_replace(F.col(column), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def known_targets(targets: DataFrame, source: str = "source", share: str = "target_share", repeats: str = "max_repeats") -> dict[str, tuple[float, float]]:
    """The targets by clean source name, at most ``MOST_LEAVES``."""
    got = targets.where(F.col(source).isNotNull()).select(clean_name(source), F.coalesce(F.col(share).cast("double"), F.lit(0.0)), F.coalesce(F.col(repeats).cast("double"), F.lit(1.0))).distinct().limit(MOST_LEAVES + 1).collect()
    if len(got) > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} sources")
    return {r[0]: (r[1], r[2]) for r in sorted(got)}


def sized_records(df: DataFrame, record: str, text: str, path: Sequence[Column], sources: Sequence[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """(record, p0, p1, …, tokens) of the records whose source (the last path column) is known."""
    names = [f"p{i}" for i in range(len(path))]
    known = df.select(F.col(record), F.col(text).alias("text"), *[c.alias(n) for n, c in zip(names, path, strict=True)]).where(F.col(names[-1]).isin(list(sources)))
    return known.select(record, *names, token_count(df.sparkSession, "text", vocabulary).alias("tokens"))


def leaf_sizes(sized: DataFrame) -> list[tuple[tuple[str, ...], int]]:
    """Tokens by path, at most ``MOST_LEAVES`` of them."""
    names = [c for c in sized.columns if c[0] == "p" and c[1:].isdigit()]
    got = sized.groupBy(*names).agg(F.sum("tokens").alias("n")).limit(MOST_LEAVES + 1).collect()
    if len(got) > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} leaves")
    return sorted((tuple(r[n] for n in names), int(r["n"])) for r in got)


def mix(sized: DataFrame, targets: dict[str, tuple[float, float]], record: str, seed: int = 0) -> tuple[list[dict], DataFrame]:
    """The plan and the selected records; ``sized`` is computed once and kept in the shared folder."""
    kept = durable(sized)
    plan = mix_plan(leaf_sizes(kept), targets)
    names = [c for c in kept.columns if c[0] == "p" and c[1:].isdigit()]
    spark = sized.sparkSession
    schema = ", ".join([*(f"{n} string" for n in names), "leaf int"])
    numbers = F.broadcast(spark.createDataFrame([(*p["path"], i) for i, p in enumerate(plan)], schema))
    return plan, select_records(kept.join(numbers, names).select(record, "leaf", "tokens"), plan, record, seed)

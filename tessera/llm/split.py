"""Train, validation and test splits that keep related records together.

Records that share a value of a linking key form a component, and so do records linked
through others, by whichever keys. Components are placed by grouped iterative
stratification: each carries the vector of its label counts; labels are taken by the fewest
records outstanding, the components whose rarest label it is are placed into the splits
that still need that label most. Components of at least a thousandth of all records (at
most a thousand of them) are placed one by one on the driver. The rest are placed in bulk:
per label the driver knows only the summed label vectors in hash bins, at most
``MOST_CELLS`` of them over all labels, gives each split the bins that fill its need, and one
pass over the components reads the split from (label, bin). Neither components nor links
ever come to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.packed import value_set
from tessera.operators.skew import attach, enrich
from tessera.session import durable

SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}
BINS = 2048  # of a label, at most
MOST_CELLS = 16_384  # bins of all labels together, about
MOST_LABELS = 500


def query_words(column: str | Column) -> Column:
    """The words of a text in order, one blank between: runs of letters and digits, in lower
    case, with ё as е and the Latin letters a e o p c x as the Cyrillic ones they look like.
    Null and wordless texts give ''."""
    text = F.col(column) if isinstance(column, str) else column
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), "ёaeopcx", "еаеорсх")
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))


def search_key(df: DataFrame, query: str, location: str, params: str, keys: Sequence[str]) -> DataFrame:
    """``df`` without the rows of a blank query, plus k1, k2: a 128-bit key of the search.

    Two rows have the same key if their words, their location (null equals null) and their
    set of packed values are the same.
    """
    parts = [query_words(query), F.coalesce(F.col(location).cast("string"), F.lit("-")), value_set(params, keys)]
    names = ["__words", "__place", "__set"]
    named = df.withColumns(dict(zip(names, parts, strict=True))).where("__words <> ''")
    return named.withColumns({"k1": F.xxhash64(*names), "k2": F.xxhash64(F.lit("second"), *reversed(names))}).drop(*names)


def _stars(rows: DataFrame, keys: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """(n, m): each row and the least row that has the same key. A key with a null links nothing."""
    known = rows.select("n", *keys, *carry).where(" and ".join(f"`{k}` is not null" for k in keys))
    return enrich(known, keys, partial={"__m": F.min("n")}, total={"m": F.min("__m")}, spread=["n"]).select("n", "m", *carry)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("n", "m"))).first())


def components(df: DataFrame, row_id: str, keys: Sequence[Sequence[str]], carry: Sequence[str] = ()) -> DataFrame:
    """(n, component) and the ``carry`` columns: each row and the least row of its component.

    ``keys`` are the linking keys, each of one column or more; rows that share any of them
    are in one component. A single key makes stars, which are components. Several are merged
    by alternating large and small stars, each step written to the checkpoint folder, in a
    number of steps about logarithmic in the length of the longest chain. Nodes of many
    neighbours are spread by salts. Rows with a null id take no part; a repeated id is one
    node, each of its rows coming out. A key with a null in it links nothing; an empty table gives no row.
    """
    names = list(dict.fromkeys(c for key in keys for c in key))
    kept = [f"__c{i}" for i in range(len(carry))]
    rows = durable(df.where(F.col(row_id).isNotNull()).select(F.col(row_id).alias("n"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(names)], *[F.col(c).alias(k) for c, k in zip(carry, kept, strict=True)]))
    key_names = [[f"__k{names.index(c)}" for c in key] for key in keys]
    back = [F.col(k).alias(c) for c, k in zip(carry, kept, strict=True)]
    if len(keys) == 1:
        alone = rows.where(" or ".join(f"`{k}` is null" for k in key_names[0])).select("n", F.col("n").alias("m"), *kept)
        return _stars(rows, key_names[0], kept).unionAll(alone).select("n", F.col("m").alias("component"), *back)
    links = None
    for key in key_names:
        part = _stars(rows, key)
        links = part if links is None else links.unionAll(part)
    edges = durable(links.where("n <> m").distinct())
    before = None
    while (now := _mark(edges)) != before:
        before = now
        both = edges.unionAll(edges.select(F.col("m").alias("n"), F.col("n").alias("m")))
        least = enrich(both, ["n"], partial={"__l": F.min("m")}, total={"l": F.min("__l")}, spread=["m"])
        # Large star: every larger neighbour of a node goes to the least of the neighbourhood.
        large = least.where("m > n").select(F.col("m").alias("n"), F.least("n", "l").alias("m")).distinct()
        # Small star: a node and its smaller neighbours go to the least of these.
        least = enrich(large, ["n"], partial={"__l": F.min("m")}, total={"l": F.min("__l")}, spread=["m"])
        small = least.select(F.col("m").alias("n"), F.col("l").alias("m")).unionAll(least.select("n", F.col("l").alias("m")))
        edges = durable(small.where("n <> m").distinct())
    # Only now has every row but the least of a component exactly one link.
    return rows.join(edges, "n", "left").select("n", F.coalesce("m", "n").alias("component"), *back)


def grouped_split(df: DataFrame, row_id: str, keys: Sequence[Sequence[str]], label: str, shares: dict[str, float] = SPLITS) -> DataFrame:
    """(row_id, component, n_rows, label, split) for every row of ``df`` with an id.

    Components are those of ``keys``, named by their least row, ``n_rows`` their size;
    splits are those of ``stratified_split`` by ``label``.
    """
    rows = durable(components(df, row_id, keys, [label]))
    out = attach(rows, stratified_split(rows, "component", label, shares), ["component"], ["n"])
    return out.select(F.col("n").alias(row_id), "component", "n_rows", label, "split")


def place_components(total: np.ndarray, heavy: list[tuple], bulk: dict[tuple[int, int], np.ndarray], shares: Sequence[float]) -> tuple[dict, dict]:
    """Splits of the heavy components and of the (label, bin) cells.

    ``total``: records by label. ``heavy``: (id, label vector). ``bulk``: label vectors by
    (rarest label, bin). Deterministic: ties go to the smaller number.
    """
    shares = np.asarray(shares, float)
    need = np.outer(shares, total)
    order = np.lexsort((np.arange(len(total)), total))
    rank = np.argsort(order)
    rarest = lambda v: min(np.flatnonzero(v), key=lambda k: rank[k], default=0)
    queue: dict[int, list] = {}
    for who, vector in sorted(heavy, key=lambda x: (-x[1].sum(), x[0])):
        queue.setdefault(rarest(vector), []).append((("one", who), vector))
    for cell, vector in sorted(bulk.items(), key=lambda x: (-x[1].sum(), x[0])):
        queue.setdefault(cell[0], []).append((("bin", cell), vector))
    ones: dict = {}
    bins: dict = {}
    outstanding = total.astype(float).copy()
    left = set(queue)
    while left:
        label = min(left, key=lambda k: (outstanding[k], k))
        left.remove(label)
        for (kind, who), vector in queue[label]:
            scarce = np.lexsort((np.arange(len(shares)), -need.sum(axis=1), -need[:, label]))
            split = int(scarce[0])
            need[split] -= vector
            outstanding -= vector
            (ones if kind == "one" else bins)[who] = split
    return ones, bins


def stratified_split(df: DataFrame, component: str, label: str, shares: dict[str, float] = SPLITS, cells: int = MOST_CELLS) -> DataFrame:
    """(component, n_rows, split): one row per component of ``df``, whole components to one split.

    A null label is a label of its own; rows with a null component take no part. At most
    ``MOST_LABELS`` labels are taken, more raise ValueError, as label vectors are dense.
    A label has bins by its share of all rows, 16 at least and ``BINS`` at most, so the driver
    gets at most ``cells`` + 16 x labels sums, each of the labels that occur in it.
    """
    rows = df.where(F.col(component).isNotNull()).select(F.col(component).alias("c"), F.coalesce(F.col(label).cast("string"), F.lit("\0")).alias("l"))
    by_label = rows.groupBy("c", "l").agg(F.count(F.lit(1)).alias("n"))
    counts = {r[0]: r[1] for r in rows.groupBy("l").count().limit(MOST_LABELS + 1).collect()}
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    names = sorted(counts, key=lambda k: (counts[k], k))  # by rarity: the first of a component's labels is its rarest
    total = np.array([counts[k] for k in names], np.int64)
    if not names:
        return rows.select(F.col("c").alias(component), F.lit(0).cast("bigint").alias("n_rows"), F.lit("").alias("split"))
    number = F.create_map(*[x for i, k in enumerate(names) for x in (F.lit(k), F.lit(i))])
    vectors = by_label.groupBy("c").agg(F.sum("n").alias("size"), F.collect_list(F.struct(number[F.col("l")].alias("l"), "n")).alias("v"))
    floor = max(1, int(total.sum()) // 1000)
    bins = F.array(*[F.lit(int(b)) for b in np.clip(np.ceil(cells * total / total.sum()), 16, BINS)])
    rare = F.array_min(F.transform("v", lambda x: x["l"]))
    cell = F.pmod(F.xxhash64(F.lit(3), "c"), F.element_at(bins, F.col("rare") + 1)).cast("int")
    placed = durable(vectors.select("c", "size", "v", rare.alias("rare")).withColumn("bin", cell))
    vector = lambda pairs: np.bincount([p[0] for p in pairs], [p[1] for p in pairs], len(names))
    heavy = [(r["c"], vector(r["v"])) for r in placed.where(F.col("size") > floor).select("c", "v").collect()]
    sums: dict = {}
    small = placed.where(F.col("size") <= floor).select("rare", "bin", F.explode("v").alias("x")).groupBy("rare", "bin", "x.l").agg(F.sum("x.n").alias("n"))
    for r in small.collect():
        sums.setdefault((r["rare"], r["bin"]), []).append((r["l"], r["n"]))
    ones, bulk = place_components(total, heavy, {k: vector(v) for k, v in sums.items()}, list(shares.values()))
    spark = df.sparkSession
    by_cell = spark.createDataFrame([(int(a), int(b), s) for (a, b), s in bulk.items()], "rare int, bin int, s int")
    kind = dict(rows.dtypes)["c"]
    by_one = spark.createDataFrame([(c, s) for c, s in ones.items()], f"c {kind}, t int")
    # Both are bounded: the cells above, and a thousand heavy components.
    out = placed.select("c", "size", "rare", "bin").join(F.broadcast(by_one), "c", "left").join(F.broadcast(by_cell), ["rare", "bin"], "left")
    splits = F.array(*[F.lit(s) for s in shares])
    at = F.coalesce("t", "s")
    # Not element_at alone: of a literal array it gives the last entry for a null place.
    return out.select(F.col("c").alias(component), F.col("size").alias("n_rows"), F.when(at.isNotNull(), F.element_at(splits, at + 1)).alias("split"))

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm.distinctive import term_scores
from tessera.llm.leximin import leximin_best, score_places
from tessera.llm.split import components, grouped_split, place_components, query_words, search_key, stratified_split
from tessera.llm.topn import best_items, top_n
from pyspark.sql import functions as F

NAN = float("nan")


def test_query_words(spark):
    df = spark.createDataFrame([(" Ёлка-2, «сосна» ",), ("eлкa 2 cocнa",), ("...",), (None,), ("a  b",)], "q string")
    assert [r[0] for r in df.select(query_words("q")).collect()] == ["елка 2 сосна", "елка 2 сосна", "", "", "а b"]


def test_same_search_groups_with_a_hot_search(spark):
    rows = [(i, "Ремонт окон", 5, "Срок 1; 2", "x") for i in range(300, 0, -1)]
    rows += [(1000, "ремонт  ОКОН!", 5, "Срок: 2, Срок 1", "x"), (1001, "ремонт окон", 6, "Срок 1; 2", "x"), (1002, "ремонт окон", None, None, "x"), (1003, "ремонт окон", None, "", "x")]
    rows += [(1004, " ", 5, None, "x"), (1005, None, 5, None, "x"), (1006, " ", 5, None, "x"), (1007, "ремонт окон", 5, "Срок 1", "x"), (None, "ремонт окон", 5, "Срок 1", "x")]
    df = spark.createDataFrame(rows, "pair_id long, q string, loc long, f string, group_id string")
    keyed = search_key(df, "q", "loc", "f", ["Срок"])
    found = components(keyed, "pair_id", [["k1", "k2"]])
    sizes = Counter(r.component for r in found.collect())
    got = sorted((r.n, r.component) for r in found.collect() if sizes[r.component] > 1)
    assert got == sorted([(i, 1) for i in range(1, 301)] + [(1000, 1), (1002, 1002), (1003, 1002)])
    assert sizes[1001] == sizes[1007] == 1
    assert components(keyed.limit(0), "pair_id", [["k1", "k2"]]).count() == 0


def plain_components(rows):
    """Of (id, key, key, …) with null keys, by union-find."""
    parent = {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k in range(1, len(rows[0])):
        first = {}
        for r in rows:
            if r[k] is not None:
                a, b = root(r[0]), root(first.setdefault(r[k], r[0]))
                parent[max(a, b)] = min(a, b)
    return {r[0]: root(r[0]) for r in rows}


@pytest.mark.parametrize("shape", ["random", "chain", "hot"])
def test_components_over_several_keys(spark, shape):
    rng = random.Random(7)
    if shape == "random":
        rows = [(i, rng.choice([None, *range(120)]), rng.choice([None, *range(90)])) for i in range(200)]
    elif shape == "chain":  # each record shares its author with the one before and its source with the one after
        order = rng.sample(range(101), 101)
        rows = [(order[i], (i + 1) // 2, i // 2) for i in range(101)]
    else:
        rows = [(i, 0 if i % 3 == 0 else i, i // 2 if i < 40 else None) for i in range(300)]
    df = spark.createDataFrame([*rows, (None, 0, 0)], "id long, author long, source long")
    assert {r.n: r.component for r in components(df, "id", [["author"], ["source"]]).collect()} == plain_components(rows)
    assert components(df.limit(0), "id", [["author"], ["source"]]).count() == 0


def test_grouped_split_keeps_linked_records_together(spark):
    rng = random.Random(8)
    rows = [(i, rng.randrange(900), rng.choice([None, *range(1500)]), rng.choice("aaab")) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, author long, source long, label string").withColumn("component", F.lit("clash")).withColumn("salt", F.lit(1))
    got = grouped_split(df, "id", [["author"], ["source"]], "label").collect()
    want = plain_components([r[:3] for r in rows])
    assert {r.id: r.component for r in got} == want
    sizes, split = Counter(want.values()), {}
    for r in got:
        assert r.n_rows == sizes[r.component]
        assert split.setdefault(r.component, r.split) == r.split


def test_split_keeps_components_and_shares(spark):
    rng = random.Random(1)
    rows = []
    for c in range(3000):
        size = 2000 if c == 0 else rng.choice([1, 1, 1, 2, 5])
        rows += [(f"c{c}", rng.choice(["a"] * 20 + ["b"] * 4 + ["r"] + [None])) for _ in range(size)]
    df = spark.createDataFrame([*rows, (None, "a")], "c string, l string")
    placed = {r.c: r.split for r in stratified_split(df, "c", "l").collect()}
    assert placed.keys() == {c for c, _ in rows}
    by_label = defaultdict(Counter)
    for c, label in rows:
        by_label[label][placed[c]] += 1
        by_label["all"][placed[c]] += 1
    for counts in by_label.values():
        n = sum(counts.values())
        assert abs(counts["train"] / n - 0.8) < 0.03
        assert abs(counts["test"] / n - 0.1) < 0.03
    assert stratified_split(df.limit(0), "c", "l").count() == 0
    with pytest.raises(ValueError, match="labels"):
        stratified_split(spark.range(600).select(F.col("id").alias("c"), F.col("id").alias("l")), "c", "l")


def test_placing_gives_the_rarest_label_where_it_is_needed():
    ones, bins = place_components(np.array([10, 90]), [("x", np.array([5, 5])), ("y", np.array([5, 5]))], {(1, 0): np.array([0, 80])}, [0.5, 0.5])
    assert ones["x"] != ones["y"]
    assert bins.keys() == {(1, 0)}


def test_term_scores_against_plain_python(spark):
    rng = random.Random(3)
    vocabulary = ["общее", "слово", "редкость", "naming", "ёлка", "да", "abc"]
    rows = [(f"i{k}", " ".join(rng.choices(vocabulary, k=30)), rng.choice([None, "", "Общее-СЛОВО"]), k) for k in range(40)]
    rows += [rows[0], (None, "общее", None, 1), ("none", None, None, 2)]
    df = spark.createDataFrame(rows, "id string, a string, b string, term int")
    got = {(r.id, r.term): (r.tf, r.df, r.score) for r in term_scores(df, "id", ["a", "b"], mu=50.0).collect()}
    texts = {}
    for i, a, b, _ in rows:
        if i is not None:
            words = re.findall("[a-zа-я]{4,}", "\n".join(x for x in (a, b) if x is not None).lower().replace("ё", "е"))
            texts[i] = Counter(words)
    df_, cf = Counter(), Counter()
    for c in texts.values():
        df_.update(c.keys())
        cf.update(c)
    n = sum(cf.values())
    want = {}
    for i, c in texts.items():
        for t, tf in c.items():
            p = (tf + 50 * cf[t] / n) / (sum(c.values()) + 50)
            want[i, t] = (tf, df_[t], p * math.log(p / (cf[t] / n)))
    assert got.keys() == want.keys()
    assert all(got[k][:2] == want[k][:2] and abs(got[k][2] - want[k][2]) < 1e-12 for k in want)
    assert term_scores(df.limit(0), "id", ["a", "b"]).count() == 0
    assert {r.df for r in term_scores(df, "id", ["a", "b"], least_df=41).collect()} == set()


def test_best_items_ties_repeats_nulls_and_a_hot_group(spark):
    rows = [("hot", f"{i:05d}", float(i % 7)) for i in range(5000)]
    rows += [("q", "b", 1.0), ("q", "a", 1.0), ("q", "b", 3.0), ("q", "c", NAN), ("q", "d", None), (None, "a", 1.0), ("q", None, 9.0), ("empty", "x", None)]
    df = spark.createDataFrame(rows, "g string, i string, s double").withColumn("rnk", F.lit("clash"))
    got = sorted((r.g, r.rnk, r.i) for r in best_items(df, "g", "i", "s", 4).collect())
    assert got == sorted([("hot", k + 1, f"{7 * k + 6:05d}") for k in range(4)] + [("q", 1, "b"), ("q", 2, "a")])
    assert best_items(df.limit(0), "g", "i", "s", 4).count() == 0
    kept = top_n(df.select("g", "i", "s"), ["g"], [F.col("s").desc_nulls_last(), F.col("i")], 1, spread=["i"])
    assert {r.g for r in kept.collect()} == {"hot", "q", None, "empty"}


@pytest.mark.parametrize("piece", [1, 100, 50_000])
def test_places_and_leximin_against_plain_python(spark, piece):
    rng = random.Random(5)
    rows = []
    for g, n in (("hot", 9000), ("small", 12), ("one", 1)):
        for i in range(n):
            rows.append((g, f"{i:05d}", 0.0 if rng.random() < 0.4 else rng.random(), rng.choice([None, NAN, 1e6 * rng.random()]), float(rng.randrange(3))))
    rows += [rows[0], ("small", "00000", 5.0, None, NAN), (None, "x", 1.0, 1.0, 1.0), ("small", None, 9.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "q string, item string, a double, b double, c double").withColumn("salt", F.lit(1)).withColumn("g", F.lit("clash"))
    best = defaultdict(lambda: [None] * 3)
    for q, item, *scores in rows:
        if q is not None and item is not None:
            have = best[q, item]
            for k, s in enumerate(scores):
                if s is not None and s == s and (have[k] is None or s > have[k]):
                    have[k] = s
    groups = defaultdict(list)
    for (q, item), s in best.items():
        groups[q].append((item, s))
    want = {}
    for q, items in groups.items():
        ordered = [sorted(s[k] for _, s in items if s[k] is not None) for k in range(3)]
        for item, s in items:
            places, pct = [], []
            for k in range(3):
                if s[k] is None:
                    places.append(None)
                    pct.append(0.0)
                else:
                    higher = len(ordered[k]) - np.searchsorted(ordered[k], s[k], side="right")
                    places.append(int(higher) + 1)
                    pct.append(1 - higher / len(ordered[k]))
            want[q, item] = (len(items), places, sorted(pct))
    placed = score_places(df, "q", "item", ["a", "b", "c"], piece).cache()
    got = {(r.g, r.i): (r.n_items, r.places, r.vector) for r in placed.collect()}
    assert got.keys() == want.keys()
    assert all(got[k][:2] == want[k][:2] and np.allclose(got[k][2], want[k][2], atol=1e-12) for k in want)
    first = sorted((r.g, r.rnk, r.i) for r in leximin_best(placed, 5).collect())
    expected = []
    for q, items in groups.items():
        ranked = sorted(((got[q, i][2], i) for i, _ in items), key=lambda x: ([-v for v in x[0]], x[1]))
        expected += [(q, n + 1, i) for n, (_, i) in enumerate(ranked[:5])]
    assert first == sorted(expected)
    assert score_places(df.limit(0), "q", "item", ["a", "b", "c"]).count() == 0

"""The queries that SQL can't express, on real tables: against counts made another way."""

import base64
from collections import Counter, defaultdict

import pytest
import tiktoken

from tessera.llm import queries as llm
from tessera.llm import split
from tessera.llm.leakage import plain_words, words_with_places
from tessera.llm.mixing import PATTERN, VOCABULARY

FOLDER = "/root/testdata/sf0.01"


def rows(spark, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{FOLDER}/{name}.parquet").select(*columns).collect()]


def test_cleaned_documents_against_all_grams(spark):
    docs = dict(rows(spark, "documents", "doc_id", "text"))
    grams = set()
    for (passage,) in rows(spark, "eval_passages", "passage"):
        w = plain_words(passage)
        grams |= {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
    want = {}
    for doc, text in docs.items():
        w = plain_words(text)
        leaked = {j for i in range(len(w) - 11) if tuple(w[i : i + 12]) in grams for j in range(i, i + 12)}
        if leaked:
            places = words_with_places(text)[1]
            kept = len(text)
            for i in sorted(leaked):  # a run goes with all that stands between its words
                kept -= places[i][1] - (places[i - 1][1] if i - 1 in leaked else places[i][0])
            dropped = 2 * len(leaked) > len(w)
            want[doc] = (len(w), len(leaked), dropped, 0 if dropped else kept)
    got = {r.doc_id: (r.n_words, r.leaked_words, r.dropped, r.clean_chars) for r in llm.p8_cleaned(spark, FOLDER).collect()}
    assert len(got) > 10
    assert got == want


def test_mixed_shares_against_token_counts(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    encoding = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    targets = {s: (share, repeats) for s, share, repeats in rows(spark, "mix_targets", "source", "target_share", "max_repeats")}
    own, longest, leaves = Counter(), 0, set()
    for text, source, lang in rows(spark, "documents", "text", "source", "lang"):
        name = (source or "").strip().lower()
        if name in targets:
            n = len(encoding.encode_ordinary(text or ""))
            own[name] += n
            longest = max(longest, n)
            leaves.add((name, (lang or "und").strip().lower().split("-")[0]))
    total = sum(own.values())
    short = {s for s, (share, repeats) in targets.items() if share * total > repeats * own[s]}
    assert short
    assert {r.source for r in llm.p9_found(spark, FOLDER).collect()} == short
    got = {r.source: r for r in llm.p9_mix(spark, FOLDER).collect()}
    assert got.keys() == targets.keys()
    slack = longest * len(leaves)
    assert abs(sum(r.tokens for r in got.values()) - total) <= slack
    for s, r in got.items():
        assert r.actual_share == pytest.approx(r.tokens / sum(x.tokens for x in got.values()), abs=1e-9)
        assert r.most_copies <= targets[s][1]
        if s in short:
            assert r.tokens == targets[s][1] * own[s]
        else:  # gets its target and a part of what the short ones can't give
            assert r.tokens >= targets[s][0] * total - slack
    # What is left over is shared by weight: nobody's share is far from its target times one factor.
    rest = [got[s].tokens / targets[s][0] for s in targets if s not in short]
    assert max(rest) < 1.15 * min(rest)


def test_split_shares_of_whole_searches(spark):
    counts, by_label = Counter(), defaultdict(Counter)
    for r in llm.p2_split(spark, FOLDER).collect():
        counts[r.split] += r.n_rows
        by_label[r.item_category_id][r.split] += r.n_rows
    n = sum(counts.values())
    assert n == spark.read.parquet(f"{FOLDER}/train.parquet").where("trim(translate(search_query, ' ', ' ')) <> ''").count()
    assert counts["train"] / n == pytest.approx(0.8, abs=0.02)
    assert counts["test"] / n == pytest.approx(0.1, abs=0.02)
    placed = defaultdict(set)
    for r in llm._split(spark, FOLDER).collect():
        placed[r.component].add(r.split)
    assert all(len(s) == 1 for s in placed.values())


def test_the_queries_rows_come_through_their_methods(spark, monkeypatch):
    """With a dummy in place of the method nothing is left of the query's rows."""
    monkeypatch.setattr(split, "place_components", lambda total, heavy, bulk, shares: ({}, {}))
    assert llm.p2_found(spark, FOLDER).count() == 0
    import tessera.llm.mixing as mixing

    monkeypatch.setattr(mixing, "budgets", lambda leaves, total: {x.path: float("inf") for x in leaves})
    assert llm.p9_found(spark, FOLDER).count() == 0
    plan = llm.p4_found(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "LN(" in plan.upper()
    plan = llm.p6_found(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort" in plan

"""Evaluation texts inside training texts, by a generalised suffix automaton of the evaluation set.

The automaton accepts every run of words of every passage. A document's words are streamed
through it; the matched length says at each word how long a run of passage words ends
there. Runs of at least ``least`` words are leaks.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 12
PART_CHARS = 8_000_000  # of passages in one automaton; a larger evaluation set takes several
VANISHING = dict.fromkeys(map(ord, "\u00ad\u200b"))
TAG = re.compile(r"<[^<>]{0,20}>")
WORD = re.compile("[0-9a-zа-я]+")


def plain_words(text: str | None) -> list[str]:
    """Words as runs of 0-9, a-z, а-я in lower case with ё as е; soft hyphens and zero-width
    spaces vanish first, a tag of at most twenty characters is a blank."""
    if not text:
        return []
    return WORD.findall(TAG.sub(" ", text.translate(VANISHING)).lower().replace("ё", "е"))


def words_with_places(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """The same words, with the part of the original text that each comes from."""
    kept = [(i, c) for i, c in enumerate(text) if ord(c) not in VANISHING]
    blanked = TAG.sub(lambda m: " " * len(m.group()), "".join(c for _, c in kept))
    lowered, origin = [], []
    for (i, _), c in zip(kept, blanked, strict=True):
        for low in c.lower():
            lowered.append("е" if low == "ё" else low)
            origin.append(i)
    found = [(m.group(), (origin[m.start()], origin[m.end() - 1] + 1)) for m in WORD.finditer("".join(lowered))]
    return [w for w, _ in found], [p for _, p in found]


class SuffixAutomaton:
    """Of several word sequences; each state knows the sequences that hold its runs, from ``least`` words on."""

    def __init__(self, passages: Iterable[tuple[object, str | None]], least: int):
        self.least = least
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = array("i", [-1]), array("i", [0])
        sequences = [(i, w) for i, t in passages if i is not None and len(w := plain_words(t)) >= least]
        for _, words in sequences:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self.vocabulary = frozenset(w for _, words in sequences for w in words)
        # Most states have one holder, so equal sets are one object and a state costs a reference.
        nobody: frozenset = frozenset()
        self.holders: list[frozenset] = [nobody] * len(self.next)
        known: dict[tuple[frozenset, object], frozenset] = {}
        for who, words in sequences:
            at = 0
            for word in words:
                at = self.next[at][word]
                state = at
                while state > 0 and self.length[state] >= least and who not in self.holders[state]:
                    now = self.holders[state]
                    more = known.get((now, who))
                    if more is None:
                        more = known[now, who] = now | {who}
                    self.holders[state] = more
                    state = self.link[state]
        # A shorter run has the holders of the longer ones it ends; where it has no more, a search passes it by.
        self.up = array("i", bytes(4 * len(self.next)))
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            above = self.link[state]
            if above > 0 and self.length[above] >= least:
                self.up[state] = above if len(self.holders[above]) > len(self.holders[state]) else self.up[above]

    def _state(self, length: int, link: int, following: dict[str, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, before: int, word: str, target: int) -> int:
        """A copy of ``target`` for the runs that end in ``before`` + ``word``."""
        copy = self._state(self.length[before] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while before >= 0 and self.next[before].get(word) == target:
            self.next[before][word] = copy
            before = self.link[before]
        return copy

    def _extend(self, last: int, word: str) -> int:
        there = self.next[last].get(word)
        if there is not None:
            return there if self.length[there] == self.length[last] + 1 else self._split(last, word, there)
        new = self._state(self.length[last] + 1, 0, {})
        before = last
        while before >= 0 and word not in self.next[before]:
            self.next[before][word] = new
            before = self.link[before]
        if before >= 0:
            there = self.next[before][word]
            self.link[new] = there if self.length[there] == self.length[before] + 1 else self._split(before, word, there)
        return new

    def spans(self, words: list[str]) -> dict[object, tuple[int, list[tuple[int, int]]]]:
        """For each leaked sequence its longest run in ``words`` and the union of its runs as (first, past the last)."""
        found: dict[object, tuple[int, list[tuple[int, int]]]] = {}
        following, link, length, least = self.next, self.link, self.length, self.least
        known = self.vocabulary
        state = matched = 0
        at, n = 0, len(words)
        while at < n:
            if not matched:
                # A run needs `least` known words: look from its far end, and jump past an unknown one.
                far = at + least - 1
                if far >= n:
                    break
                while far >= at and words[far] in known:
                    far -= 1
                if far >= at:
                    at = far + 1
                    continue
            word = words[at]
            while state and word not in following[state]:
                state = link[state]
                matched = length[state]
            if word in following[state]:
                state = following[state][word]
                matched += 1
            at += 1
            if matched >= least:
                up, seen = state, set()
                while length[up] >= least:
                    size = min(matched, length[up])
                    for who in self.holders[up] - seen:
                        seen.add(who)
                        longest, runs = found.get(who, (0, []))
                        first = at - size
                        while runs and runs[-1][1] >= first:  # ends only grow, so the union does at its end
                            first = min(first, runs.pop()[0])
                        runs.append((first, at))
                        found[who] = (max(longest, size), runs)
                    up = self.up[up]
        return found


def covered(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, as spans in order."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


_BUILT: dict[tuple, SuffixAutomaton] = {}


def _automaton(part: list, number: int, token: str, least: int) -> SuffixAutomaton:
    """Built once in a worker process."""
    key = (token, number, least)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = SuffixAutomaton(part, least)
    return _BUILT[key]


def _parts(evals: DataFrame, eval_id: str, passage: str) -> Iterator[list[tuple[object, str]]]:
    """The evaluation set in parts of bounded size."""
    part, size = [], 0
    for r in evals.where(F.col(eval_id).isNotNull() & F.col(passage).isNotNull()).select(eval_id, passage).toLocalIterator():
        if part and size + len(r[1]) > PART_CHARS:
            yield part
            part, size = [], 0
        part.append((r[0], r[1]))
        size += len(r[1])
    yield part


def leaked(docs: DataFrame, evals: DataFrame, doc: tuple[str, str], item: tuple[str, str], least: int = LEAST) -> DataFrame:
    """(doc id, eval id, longest, words, first, spans) for each document and passage that share ``least`` consecutive words.

    ``longest`` is the longest common run in words, ``words`` how many of the document's
    words such runs cover, ``first`` the first of them (from 0), ``spans`` the runs. Whole
    texts are read. Null ids and texts and passages under ``least`` words give nothing;
    repeated documents or passages give repeated rows for a repeated document only. Only
    the passages travel to the workers, in parts of at most ``PART_CHARS`` characters.
    """
    context = docs.sparkSession.sparkContext
    narrow = docs.where(F.col(doc[0]).isNotNull() & F.col(doc[1]).isNotNull()).select(F.col(doc[0]).alias("d"), F.col(doc[1]).alias("t"))
    kinds = (dict(narrow.dtypes)["d"], dict(evals.dtypes)[item[0]])
    whole = None
    token = uuid.uuid4().hex  # a worker outlives this call; nothing else tells two evaluation sets apart there
    for number, part in enumerate(_parts(evals, *item)):
        shared = context.broadcast(part)
        ids = evals.select(item[0]).schema

        def run(batches: Iterator[pa.RecordBatch], shared=shared, number=number, token=token) -> Iterator[pa.RecordBatch]:
            machine = _automaton(shared.value, number, token, least)
            for batch in batches:
                row, who, longest, words, first, spans = [], [], [], [], [], []
                for i, text in enumerate(batch.column("t").to_pylist()):
                    for e, (most, union) in machine.spans(plain_words(text)).items():
                        row.append(i)
                        who.append(e)
                        longest.append(most)
                        words.append(sum(hi - lo for lo, hi in union))
                        first.append(union[0][0])
                        spans.append([{"lo": lo, "hi": hi} for lo, hi in union])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("d").take(pa.array(row, pa.int32())), pa.array(who, arrow_type), pa.array(longest, pa.int64()), pa.array(words, pa.int64()),
                        pa.array(first, pa.int64()), pa.array(spans, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))),
                    ],
                    names=["d", "e", "longest", "words", "first", "spans"],
                )

        from pyspark.sql.pandas.types import to_arrow_type

        arrow_type = to_arrow_type(ids[0].dataType)
        got = narrow.mapInArrow(run, f"d {kinds[0]}, e {kinds[1]}, longest bigint, words bigint, first bigint, spans array<struct<lo:int,hi:int>>")
        whole = got if whole is None else whole.unionAll(got)
    return whole.select(F.col("d").alias(doc[0]), F.col("e").alias(item[0]), "longest", "words", "first", "spans")


def without_leaks(docs: DataFrame, leaks: DataFrame, doc: tuple[str, str], longest: int = LEAST, coverage: float = 0.5) -> DataFrame:
    """(doc id, n_words, leaked_words, dropped, clean) for the documents of ``leaks``.

    Runs of at least ``longest`` words are cut out of the text; a document of whose words
    such runs cover more than ``coverage`` is dropped whole (``dropped``, clean is '').
    Documents without leaks stay as they are and give no row. Ids must be unique in ``docs``.
    """
    runs = leaks.select(F.col(doc[0]).alias("d"), F.explode("spans").alias("s")).where(F.col("s.hi") - F.col("s.lo") >= longest)
    merged = runs.groupBy("d").agg(F.collect_set("s").alias("spans"))
    hit = docs.select(F.col(doc[0]).alias("d"), F.col(doc[1]).alias("t")).join(merged, "d")
    kind = dict(hit.dtypes)["d"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("t").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words, places = words_with_places(text)
                union = covered((s["lo"], s["hi"]) for s in spans)
                n = sum(hi - lo for lo, hi in union)
                dropped = n > coverage * len(words)
                kept, at = [], 0
                for lo, hi in union:
                    kept.append(text[at : places[lo][0]])
                    at = places[hi - 1][1]
                rows.append((len(words), n, dropped, "" if dropped else "".join([*kept, text[at:]])))
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            types = [pa.int64(), pa.int64(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("d"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["d", "n_words", "leaked_words", "dropped", "clean"])

    out = hit.mapInArrow(run, f"d {kind}, n_words bigint, leaked_words bigint, dropped boolean, clean string")
    return out.withColumnRenamed("d", doc[0])

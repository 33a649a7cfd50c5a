"""Subject areas of documents: weighted subject terms, matched sentence by sentence.

The term list is curated by a rule from a bounded sample of labelled texts: one- and
two-word terms that keep to few subjects, each with the share of its use by subject. An
Aho-Corasick automaton finds the longest terms of every sentence. A sentence's evidence
for a subject is the terms' shares weighted by their rarity and divided by the whole rarity
matched, terms that two subjects use being read in the light of the whole text. A sentence
deals with a subject if the evidence exceeds the subject's threshold, calibrated on the
labelled texts; a text has the subjects of at least two sentences, or of one if it has no
more than two sentences.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VANISHING = dict.fromkeys(map(ord, "\u00ad\u200b"))
TAG = re.compile(r"<[^<>]{0,20}>")
WORD = re.compile("[0-9a-zа-я]+")
STOP = re.compile(r"[.!?…]+(?=\s|$)|\n+")
LABELLED = 20_000  # labelled documents that a term list is learnt from, about
LISTED = 10_000  # labelled texts of another kind beside them, about
GRID = (0.3, 0.4, 0.5, 0.6, 0.7)

Sentences = list[list[str]]


def sentences(text: str | None) -> Sentences:
    """The words of each sentence; sentences end at . ! ? … before a blank, at line breaks and at tags."""
    if not text:
        return []
    plain = TAG.sub("\n", text.translate(VANISHING)).lower().replace("ё", "е")
    return [words for part in STOP.split(plain) if (words := WORD.findall(part))]


@dataclass
class Terms:
    """``share[t]`` is the use of term t by subject (in the order of ``subjects``), ``rarity[t]`` its idf."""

    subjects: list
    terms: list[str]
    share: np.ndarray
    rarity: np.ndarray
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    _automaton: object = None

    def automaton(self):
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for n, term in enumerate(self.terms):
                a.add_word(" " + "  ".join(term.split(" ")) + " ", n)
            if self.terms:
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def evidence(self, parts: Sentences) -> np.ndarray:
        """Evidence by sentence and subject; a sentence without terms has none."""
        return self.evidence_of([parts])[0]

    def evidence_of(self, texts: Sequence[Sentences]) -> list[np.ndarray]:
        """The evidence of several texts, computed over all their matched terms at once."""
        sizes = [len(parts) for parts in texts]
        out = np.zeros((sum(sizes), len(self.subjects)))
        if self.terms and len(out):
            automaton = self.automaton()
            hits = [[n for _, n in automaton.iter_long(" " + "  ".join(words) + " ")] for parts in texts for words in parts]
            sentence = np.repeat(np.arange(len(out)), [len(h) for h in hits])
            term = np.fromiter((n for h in hits for n in h), np.int64, len(sentence))
            doc = np.repeat(np.arange(len(texts)), sizes)[sentence]
            weight, share = self.rarity[term], self.share[term]
            add = lambda to, values, n: np.stack([np.bincount(to, values[:, s], n) for s in range(values.shape[1])], axis=1)
            whole = add(doc, share * weight[:, None], len(texts))
            light = 0.05 + whole / np.maximum(whole.sum(axis=1, keepdims=True), 1e-300)
            read = share * light[doc]
            read /= read.sum(axis=1, keepdims=True)
            mass = np.bincount(sentence, weight, len(out))
            out = add(sentence, read * weight[:, None], len(out)) / np.where(mass > 0, mass, 1.0)[:, None]
        return np.split(out, np.cumsum(sizes)[:-1]) if texts else []

    def subjects_of(self, parts: Sentences, evidence: np.ndarray, thresholds: np.ndarray) -> list[tuple[int, int, float]]:
        """(subject number, sentences, mean evidence) of the text's subjects."""
        if not len(parts):
            return []
        deals = evidence >= thresholds
        counts = deals.sum(axis=0)
        need = 1 if len(parts) <= 2 else 2
        return [(int(s), int(counts[s]), float(evidence[:, s].mean())) for s in np.flatnonzero(counts >= need)]


def learn_terms(labelled: Iterable[tuple[str | None, Sequence]], least_df: int = 3, focus: float = 0.3, common: float = 0.04, surprise: float = 5.5) -> Terms:
    """Terms and calibrated thresholds from (text, its subjects).

    Terms come from texts of a single subject: used by at least ``least_df`` of them, with a
    share of at least ``focus`` in some subject after allowing for the subjects' sizes, and
    at least ``surprise`` standard deviations above an even use there. A
    two-word term may not contain a word that over ``common`` of the texts use. Thresholds
    are those of ``GRID`` with the best F1 over all labelled texts, by subject.
    """
    texts = [(parts, set(subjects)) for text, subjects in labelled if (parts := sentences(text)) and subjects]
    subjects = sorted({s for _, own in texts for s in own})
    number = {s: i for i, s in enumerate(subjects)}
    seen: list[Counter] = [Counter() for _ in subjects]
    sizes = np.zeros(len(subjects))
    for parts, own in texts:
        if len(own) == 1:
            i = number[next(iter(own))]
            sizes[i] += 1
            terms = {w for words in parts for w in words}
            terms.update(f"{a} {b}" for words in parts for a, b in zip(words, words[1:]))
            seen[i].update(terms)
    df: Counter = Counter()
    for c in seen:
        df.update(c)
    n = max(1.0, sizes.sum())
    names, shares = [], []
    for term, count in sorted(df.items()):
        if count < least_df:
            continue
        rate = np.array([c[term] for c in seen]) / np.maximum(sizes, 1)
        share = rate / rate.sum()
        words = term.split(" ")
        # More than chance: the subject's count against that of an even use.
        best = int(share.argmax())
        even = count * sizes[best] / n
        if (seen[best][term] - even) / math.sqrt(max(even * (1 - sizes[best] / n), 1e-9)) < surprise:
            continue
        if share.max() >= focus and (len(words) == 1 or max(df[w] for w in words) <= common * n):
            names.append(term)
            shares.append(share)
    found = Terms(subjects, names, np.array(shares).reshape(len(names), len(subjects)), np.array([math.log(1 + n / df[t]) for t in names]))
    right = np.zeros((len(GRID), len(subjects)))
    said = np.zeros_like(right)
    true = np.zeros(len(subjects))
    for (parts, own), evidence in zip(texts, found.evidence_of([parts for parts, _ in texts]), strict=True):
        for s in own:
            true[number[s]] += 1
        for g, threshold in enumerate(GRID):
            for s, _, _ in found.subjects_of(parts, evidence, np.full(len(subjects), threshold)):
                said[g, s] += 1
                right[g, s] += subjects[s] in own
    f1 = 2 * right / np.maximum(said + true, 1)
    found.thresholds = np.array(GRID)[np.argmax(f1, axis=0)] if len(subjects) else np.zeros(0)
    return found


def hash_share(key: str, rows: int, most: int) -> Column:
    """True for about ``most`` of ``rows`` distinct keys, the same ones every time; for all if there are no more."""
    return F.lit(True) if rows <= most else F.pmod(F.xxhash64(F.lit(13), key), F.lit(1 << 40)) < int(most / rows * (1 << 40))


def labelled_sample(docs: DataFrame, labels: DataFrame, doc: tuple[str, str], subject: str, most: int = LABELLED) -> list[tuple[str, list]]:
    """(text, its subjects) of about ``most`` labelled documents, chosen by the hash of their ids; of all if there are no more."""
    own = labels.where(F.col(doc[0]).isNotNull() & F.col(subject).isNotNull()).groupBy(F.col(doc[0]).alias("d")).agg(F.sort_array(F.collect_set(subject)).alias("own"))
    chosen = own.where(hash_share("d", own.count(), most))
    got = docs.select(F.col(doc[0]).alias("d"), F.col(doc[1]).alias("t")).join(F.broadcast(chosen), "d").groupBy("d").agg(F.min("t").alias("t"), F.first("own").alias("own"))  # about ``most`` ids
    return [(r["t"], r["own"]) for r in sorted(got.collect(), key=lambda r: r["d"])]


def subject_areas(docs: DataFrame, terms: Terms, doc: tuple[str, str], kind: str = "bigint") -> DataFrame:
    """(doc id, subject_id, sentences, score) for every subject that a document's text deals with.

    Whole texts are read. Null ids and null, empty or wordless texts have no subject;
    ``terms`` without any term gives none at all. ``score`` is the mean evidence of the
    text's sentences. Repeated rows give repeated results. The term list, bounded by the
    labelled sample, travels to the workers.
    """
    narrow = docs.where(F.col(doc[0]).isNotNull() & F.col(doc[1]).isNotNull()).select(F.col(doc[0]).alias("d"), F.col(doc[1]).alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            row, subject, n, score = [], [], [], []
            texts = [sentences(t) for t in batch.column("t").to_pylist()]
            for i, (parts, evidence) in enumerate(zip(texts, model.evidence_of(texts), strict=True)):
                for s, count, mean in model.subjects_of(parts, evidence, model.thresholds):
                    row.append(i)
                    subject.append(model.subjects[s])
                    n.append(count)
                    score.append(mean)
            yield pa.RecordBatch.from_arrays([batch.column("d").take(pa.array(row, pa.int32())), pa.array(subject).cast(target), pa.array(n, pa.int64()), pa.array(score, pa.float64())], names=["d", "subject_id", "sentences", "score"])

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_type(_parse_datatype_string(kind))
    return narrow.mapInArrow(run, f"d {dict(narrow.dtypes)['d']}, subject_id {kind}, sentences bigint, score double").withColumnRenamed("d", doc[0])

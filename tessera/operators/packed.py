"""Several values packed in one field: a quote-aware finite-state tokenizer.

The machine has three states: plain text, inside a plain quote ("…" or '…') and inside
angle quotes with a nesting depth («… «…» …»). Only the plain state knows keys and
delimiters. Each transition consumes one lexeme, so a text is read once, whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_KEYS = 10_000
DELIMITERS = ";|,/•\t\n\r"
SMALL_LETTER = "a-zß-öø-ÿа-џ"

Pair = tuple[str | None, str]


def value_tokenizer(keys: Sequence[str]) -> Callable[[str | None], list[Pair]]:
    """A function from a packed text to its (key, value) pairs in order.

    * A key is an entry of ``keys`` standing as whole words outside quotes, the longest that
      fits, with any white space between its words; an optional ``:`` or ``=`` follows it.
    * ``; | , / •``, tab and line break delimit outside quotes, but not directly between
      two digits, and a comma not before a small letter (blanks may stand between).
    * Quotes are removed; inside "…" a doubled quote is one quote; «…» may nest, the inner
      ones stay. A quote that never closes is an ordinary character, as is an apostrophe
      inside a word.
    * Empty pieces don't count; a key without any value gives ('key', ''). A value before
      the first key has the key None. Null and blank texts give no pair.
    """
    names = sorted({" ".join(k.split()) for k in keys if k and k.strip()}, key=lambda k: (-len(k), k))
    spelled = "|".join(r"\s+".join(map(re.escape, k.split(" "))) for k in names)
    key = rf"(?<!\w)(?P<key>{spelled})(?!\w)\s*[:=]?" if names else r"(?P<key>(?!))"
    marks = "".join(map(re.escape, DELIMITERS.replace(",", "")))
    between = lambda mark: rf"(?:(?<!\d){mark}|{mark}(?!\d))"
    lexeme = re.compile(
        rf"(?P<cut>{between(f'[{marks}]')}|{between(',')}(?<=,)(?![ \xa0]*[{SMALL_LETTER}]))"
        rf"|{key}"
        r'|"(?P<double>(?:[^"]|"")*)"'
        r"|(?<!\w)'(?P<single>[^']*)'"
        r"|(?P<angle>«)"
    )
    angle = re.compile("[«»]")

    def closings(text: str) -> dict[int, int]:
        """The place of the closing » by that of each « that has one, in one pass with a stack."""
        pairs, waiting = {}, []
        for m in angle.finditer(text):
            if m.group() == "«":
                waiting.append(m.start())
            elif waiting:
                pairs[waiting.pop()] = m.start()
        return pairs

    def tokenize(text: str | None) -> list[Pair]:
        out: list[Pair] = []
        if not text:
            return out
        current: str | None = None
        waiting = False
        piece: list[str] = []
        closed = closings(text) if "«" in text else {}

        def end_piece() -> None:
            nonlocal waiting
            value = " ".join("".join(piece).split())
            piece.clear()
            if value:
                out.append((current, value))
                waiting = False

        at = 0
        seek = 0
        while m := lexeme.search(text, seek):
            kind = m.lastgroup
            if kind == "angle":
                close = closed.get(m.start())
                if close is None:
                    seek = m.end()
                    continue
                piece.append(text[at : m.start()])
                piece.append(text[m.end() : close])
                at = seek = close + 1
                continue
            piece.append(text[at : m.start()])
            if kind == "double":
                piece.append(m["double"].replace('""', '"'))
            elif kind == "single":
                piece.append(m["single"])
            else:
                end_piece()
                if kind == "key":
                    if waiting:
                        out.append((current, ""))
                    current, waiting = " ".join(m["key"].split()), True
            at = seek = m.end()
        piece.append(text[at:])
        end_piece()
        if waiting:
            out.append((current, ""))
        return out

    return tokenize


def known_keys(keys: DataFrame, column: str = "param_key", most: int = MAX_KEYS) -> list[str]:
    """The distinct keys, on the driver; more than ``most`` are refused, so the size is bounded."""
    got = [r[0] for r in keys.where(F.col(column).isNotNull()).select(column).distinct().limit(most + 1).collect()]
    if len(got) > most:
        raise ValueError(f"more than {most} keys")
    return sorted(got)


def split_values(df: DataFrame, text: str, keys: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """One row per value of ``text``: the ``carry`` columns, pos (from 1), param_key, val.

    Nothing is shuffled; a row with a null, empty or blank text gives none. Other columns of
    ``df`` don't matter, whatever their names.
    """
    narrow = df.where(F.col(text).isNotNull()).select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.col(text).cast("string").alias("t"))
    kept = [f"c{i}" for i in range(len(carry))]
    types = dict(narrow.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in kept), "pos bigint", "param_key string", "val string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize = value_tokenizer(keys)
        for batch in batches:
            row: list[int] = []
            pos: list[int] = []
            key: list[str | None] = []
            val: list[str] = []
            for i, text in enumerate(batch.column("t").to_pylist()):
                pairs = tokenize(text)
                row.extend([i] * len(pairs))
                pos.extend(range(1, len(pairs) + 1))
                key.extend(k for k, _ in pairs)
                val.extend(v for _, v in pairs)
            take = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(take) for c in kept), pa.array(pos, pa.int64()), pa.array(key, pa.string()), pa.array(val, pa.string())],
                names=[*kept, "pos", "param_key", "val"],
            )

    out = narrow.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "pos", "param_key", "val")


def value_set(text: str, keys: Sequence[str]) -> Column:
    """A column: the set of (key, value) pairs of a packed text as one canonical string, '' for none."""
    @F.pandas_udf("string")
    def canonical(texts: pd.Series) -> pd.Series:
        tokenize = value_tokenizer(keys)
        seen: dict[str, str] = {}
        for t in texts.dropna().unique():
            seen[t] = "\x1e".join(sorted({f"{k or ''}\x1f{v}" for k, v in tokenize(t)}))
        return texts.map(seen).fillna("")

    return canonical(F.col(text))


def one_per_key(df: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """``key`` and ``values``, one row per non-null key: the least row of those that repeat it.

    Partial aggregation merges repeats before the shuffle, so a key that holds many rows
    doesn't travel.
    """
    packed = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.min(F.struct(*[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])).alias("__v"))
    return packed.select(F.col("__k").alias(key), *[F.col(f"__v.v{i}").alias(v) for i, v in enumerate(values)])

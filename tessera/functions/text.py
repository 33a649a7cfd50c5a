"""Text as Column expressions: normalising, tokens, cutting, coverage and n-grams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Russian stop list.
STOP_WORDS = (
    "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по "
    "только ее мне было вот от меня еще нет о из ему теперь когда даже ну вдруг ли если "
    "уже или ни быть был него до вас нибудь опять уж вам ведь там потом себя ничего ей "
    "может они тут где есть надо ней для мы тебя их чем была сам чтоб без будто чего раз "
    "тоже себе под будет ж тогда кто этот того потому этого какой совсем ним здесь этом "
    "один почти мой тем чтобы нее сейчас были куда зачем всех никогда можно при наконец "
    "два об другой хоть после над больше тот через эти нас про всего них какая много "
    "разве три эту моя впрочем хорошо свою этой перед иногда лучше чуть том нельзя такой "
    "им более всегда конечно всю между"
).split()
LEAST_LENGTH = 2
BLANK = r"[\s\p{Z}]+"


def as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lowered(text: str | Column) -> Column:
    """Lower case with ё as е; '' for null."""
    return F.replace(F.lower(F.coalesce(as_column(text), F.lit(""))), F.lit("ё"), F.lit("е"))


def normalize(text: str | Column) -> Column:
    """Lower case, ё as е, runs of anything but 0-9 a-z а-я as one blank; '' for null."""
    return F.trim(F.regexp_replace(lowered(text), "[^0-9a-zа-я]+", " "))


def runs(text: str | Column, least: int = 1) -> Column:
    """The words of the normalised text that have at least ``least`` letters, without normalising first."""
    return F.regexp_extract_all(lowered(text), F.lit(f"[0-9a-zа-я]{{{least},}}"), F.lit(0))


def tokens(text: str | Column, stop: bool = True, least: int = LEAST_LENGTH) -> Column:
    """Normalised words of at least ``least`` letters, without stop words; repeats stay."""
    words = runs(text, least)
    return F.filter(words, lambda t: ~t.isin(STOP_WORDS)) if stop else words


def bare_tokens(text: str | Column) -> Column:
    """Distinct normalised words of any length, as facets are compared."""
    return F.array_distinct(runs(text))


def word_count(text: str | Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(F.coalesce(as_column(text), F.lit("")), BLANK), lambda t: t != "")).cast("bigint")


def truncate(text: str | Column, most: int) -> Column:
    """At most ``most`` characters, cut at the last blank if that lies past the middle; '' for null."""
    c = F.coalesce(as_column(text), F.lit(""))
    head = F.substring(c, 1, most) if most else F.lit("")
    blank = F.length(head) - F.instr(F.reverse(head), " ")  # 0-based place of the last blank, if any
    backed = F.when((F.instr(head, " ") > 0) & (blank > most // 2), F.substring(head, F.lit(1), blank)).otherwise(head)
    return F.when(F.length(c) <= most, c).otherwise(backed)


def coverage(needed: Column, there: Column) -> Column:
    """Share of the distinct tokens of ``needed`` that ``there`` has; null if none is needed."""
    return F.size(F.array_intersect(needed, there)) / F.nullif(F.size(F.array_distinct(needed)), F.lit(0))


def char_ngrams(text: str | Column, least: int = 3, most: int = 5) -> Column:
    """Character n-grams of each normalised word between blanks; a word shorter than n once."""
    words = runs(text)

    def of(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        size = F.length(padded)

        def of_size(n: int) -> Column:
            return F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(padded, i, F.lit(n)))

        # A word as short as n - 1 gives itself at the first n only.
        none = F.array().cast("array<string>")
        parts = [of_size(n) if n == least else F.when(size >= n, of_size(n)).otherwise(none) for n in range(least, most + 1)]
        return F.concat(*parts)

    return F.flatten(F.transform(words, of))

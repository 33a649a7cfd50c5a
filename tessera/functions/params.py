"""Concatenated key/value text: greedy longest-key parsing in the JVM, and finding the keys."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.keys import uniform
from tessera.functions.text import BLANK, as_column, truncate

SAMPLE = 20_000  # texts that keys are sought in by the command
ADDRESS_KEY = "Место оказания услуг"
_BOUNDARY = "\x02"


def _plain(text: str | Column) -> Column:
    """Words with single blanks between."""
    return F.trim(F.regexp_replace(F.coalesce(as_column(text), F.lit("")), BLANK, " "))


def _any_key(keys: Sequence[str]) -> str:
    """One of the keys, the longest first."""
    names = sorted({" ".join(k.split()) for k in keys if k.strip()}, key=lambda k: (-len(k.split(" ")), -len(k), k))
    return "|".join(re.sub(r"([^\w ])", r"\\\1", k) for k in names) or "(?!)"


def _pattern(keys: Sequence[str]) -> str:
    any_key = _any_key(keys)
    return rf"(?<![^ ])({any_key})(?![^ ])(?: (.*?))??(?= (?:{any_key})(?![^ ])|$)"


def parsed(text: str | Column, keys: Sequence[str]) -> Column:
    """array<struct<key, value>> in order: words up to the next key belong to the key before
    them, the longest key wins, a key without words has ''. Words before the first key are nobody's."""
    pattern = F.lit(_pattern(keys))
    plain = _plain(text)
    return F.arrays_zip(F.regexp_extract_all(plain, pattern, F.lit(1)).alias("key"), F.regexp_extract_all(plain, pattern, F.lit(2)).alias("value"))


def values_of(pairs: Column, key: str) -> Column:
    """All values of a key, [] if it is absent."""
    return F.transform(F.filter(pairs, lambda p: p["key"] == key), lambda p: p["value"])


def first_value(pairs: Column, key: str) -> Column:
    return F.coalesce(F.get(values_of(pairs, key), F.lit(0)), F.lit(""))


def as_map(pairs: Column) -> Column:
    """map<key, array<value>>."""
    names = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_arrays(names, F.transform(names, lambda k: F.transform(F.filter(pairs, lambda p: p["key"] == k), lambda p: p["value"])))


def key_coverage(text: str | Column, keys: Sequence[str]) -> Column:
    """Share of the words from the first key on; 1 for texts without words."""
    plain = _plain(text)
    head = F.regexp_extract(plain, rf"^(.*?)(?<![^ ])(?:{_any_key(keys)})(?![^ ])", 1)
    n = lambda c: F.size(F.filter(F.split(c, " "), lambda t: t != ""))
    has_key = F.size(F.regexp_extract_all(plain, F.lit(_pattern(keys)), F.lit(1))) > 0
    return F.when(n(plain) == 0, 1.0).when(has_key, 1 - n(head) / n(plain)).otherwise(0.0)


def is_number(value: Column) -> Column:
    """A time like 09:30 or digits with at most one dot and one comma."""
    marks = lambda m: F.length(value) - F.length(F.replace(value, F.lit(m), F.lit("")))
    digits = value.rlike(r"^[0-9.,]*[0-9][0-9.,]*$") & (marks(".") <= 1) & (marks(",") <= 1)
    return value.rlike(r"^\d{1,2}[:.]\d{2}$") | digits


def telling_values(text: str | Column, keys: Sequence[str], address: bool = True) -> Column:
    """Values that say something: not empty, no numbers or times, without the address if so wished."""
    kept = F.filter(parsed(text, keys), lambda p: (p["value"] != "") & ~is_number(p["value"]) & (F.lit(address) | (p["key"] != ADDRESS_KEY)))
    return F.transform(kept, lambda p: p["value"])


def frequent_values(items: DataFrame, values: str, most: float = 0.2) -> DataFrame:
    """(value, items) of values that over ``most`` of the rows hold."""
    n = items.count()
    return items.select(F.explode(F.array_distinct(values)).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("items")).where(F.col("items") > most * n)


def encoder_texts(items: DataFrame, keys: Sequence[str], chars: int = 250, most: float = 0.2) -> DataFrame:
    """(item_id, text): title, rare values and the description's head, '. ' between what isn't empty."""
    rows = items.select("item_id", "item_title_raw", "item_description_raw", telling_values("item_infm_params_text", keys, address=False).alias("v"))
    common = frequent_values(rows, "v", most).agg(F.coalesce(F.collect_list("value"), F.array().cast("array<string>")).alias("common"))  # fewer than values an item / most
    joined = rows.crossJoin(F.broadcast(common))  # one row
    rare = F.array_join(F.filter("v", lambda x: ~F.array_contains("common", x)), " ")
    parts = F.array(F.coalesce("item_title_raw", F.lit("")), rare, truncate("item_description_raw", chars))
    return joined.select("item_id", F.array_join(F.filter(parts, lambda p: p != ""), ". ").alias("text"))


def gram_contexts(texts: DataFrame, doc: str, text: str, longest: int = 5) -> DataFrame:
    """(doc, gram, size, before, after) of every run of up to ``longest`` words that begins with a capital."""
    words = texts.select(F.col(doc).alias("doc"), F.filter(F.split(_plain(text), " "), lambda t: t != "").alias("w")).where(F.size("w") > 0)
    starts = words.select("doc", "w", F.posexplode("w").alias("i", "t")).where(F.col("t").rlike(r"^\p{Lu}"))
    sized = starts.withColumn("size", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w") - F.col("i")))))
    return sized.select(
        "doc", F.array_join(F.slice("w", F.col("i") + 1, F.col("size")), " ").alias("gram"), "size", F.coalesce(F.get("w", F.col("i") - 1), F.lit(_BOUNDARY)).alias("before"), F.coalesce(F.get("w", F.col("i") + F.col("size")), F.lit(_BOUNDARY)).alias("after")
    )


def _branching(grams: DataFrame, side: str) -> DataFrame:
    """(gram, entropy in bits, share of the commonest neighbour) of one side."""
    counts = grams.groupBy("gram", side).agg(F.count(F.lit(1)).alias("n"))
    # H = log2 N - sum(n log2 n) / N needs no second pass over the counts.
    summed = counts.groupBy("gram").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.log2("n")).alias("nl"), F.max("n").alias("top"))
    return summed.select("gram", (F.log2("all") - F.col("nl") / F.col("all")).alias(f"{side}_entropy"), (F.col("top") / F.col("all")).alias(f"{side}_top"))


def branching(texts: DataFrame, doc: str, text: str, least_share: float = 0.004, longest: int = 5) -> DataFrame:
    """Key candidates with what decides on them: documents, both entropies, commonest neighbours,
    and how often a comma or the text's start comes before."""
    grams = gram_contexts(texts, doc, text, longest)
    n = texts.where(F.length(_plain(text)) > 0).count()
    counted = grams.groupBy("gram", "size").agg(F.count_distinct("doc").alias("docs"), F.avg(F.col("before").endswith(",").cast("double")).alias("comma"), F.avg((F.col("before") == _BOUNDARY).cast("double")).alias("start"))
    able = counted.where((F.col("docs") >= max(5, int(least_share * n))) & ~F.col("gram").endswith(",") & ~F.col("gram").rlike("[0-9]"))
    kept = grams.join(able.select("gram"), "gram", "left_semi")
    return able.join(_branching(kept, "before"), "gram").join(_branching(kept, "after"), "gram")


def discover_keys(texts: DataFrame, doc: str, text: str, left: float = 2.0, right: float = 1.2, neighbour: float = 0.7, comma: float = 0.4, start: float = 0.5, most: int = 10_000) -> list[str]:
    """Keys by branching entropy, the shorter first, none that holds a key found before.

    Only accepted candidates come to the driver, at most ``most`` of them.
    """
    fine = branching(texts, doc, text).where(
        ((F.col("start") >= start) | ((F.col("before_entropy") >= left) & (F.col("before_top") <= neighbour))) & (F.col("after_entropy") >= right) & (F.col("after_top") <= neighbour) & (F.col("comma") <= comma)
    )
    rows = fine.orderBy("size", F.desc("docs"), "gram").select("gram").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} keys")
    found: list[str] = []
    taken: set[str] = set()
    for (gram,) in rows:
        words = gram.split(" ")
        inner = {" ".join(words[a:b]) for a in range(len(words)) for b in range(a + 1, len(words) + 1)} - {gram}
        if not inner & taken:
            taken.add(gram)
            found.append(gram)
    return sorted(found, key=lambda k: (-len(k.split(" ")), k))


def discover_parser(texts: DataFrame, doc: str, text: str, address: str = ADDRESS_KEY, sample: int | None = None, seed: int = 0) -> list[str]:
    """Keys in two passes: if the address is one, its values are blanked (their first place) and keys sought again.

    With ``sample`` about so many texts are looked at, chosen by the hash of their doc; None takes all.
    """
    if sample is not None and (n := texts.count()) > sample:
        texts = texts.where(uniform(F.col(doc), seed) < sample / n)
    first = discover_keys(texts, doc, text)
    if address not in first:
        return first
    held = F.filter(values_of(parsed(text, first), address), lambda v: v != "")

    def blank(acc: Column, v: Column) -> Column:
        at = F.instr(acc, v)
        return F.when(at > 0, F.concat(F.substring(acc, F.lit(1), at - 1), F.lit(" "), F.substring(acc, at + F.length(v), F.length(acc)))).otherwise(acc)

    masked = texts.select(doc, F.aggregate(held, _plain(text), blank).alias(text))
    return sorted({*discover_keys(masked, doc, text), address}, key=lambda k: (-len(k.split(" ")), k))

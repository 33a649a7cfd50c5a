import math

import pytest
from pyspark.sql import functions as F

from tessera.functions.geo import bin_of, curve, haversine
from tessera.functions.keys import composite_key, numbered, short_id, shuffled
from tessera.functions.params import as_map, discover_keys, discover_parser, first_value, is_number, key_coverage, parsed, telling_values, values_of
from tessera.functions.text import STOP_WORDS, char_ngrams, normalize, tokens, truncate, word_count
from tessera.operators.index import Field, build_index
from tessera.sources.tables import available_columns, check_data, decimals_to_double, fingerprint, load_tables, read_table, require_columns, save_tables


def one(spark, column, *values, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(column).collect()]


def test_normalize_tokens_words(spark):
    assert one(spark, normalize("x"), "Ёлка, №5!  и ТУТ", None, "", "...") == ["елка 5 и тут", "", "", ""]
    assert one(spark, tokens("x"), "Ремонт и ремонт в доме я", None) == [["ремонт", "ремонт", "доме"], []]
    assert one(spark, word_count("x"), " a  b\xa0c\n", None, "") == [3, 0, 0]
    assert len(set(STOP_WORDS)) == 151


@pytest.mark.parametrize(("text", "n", "want"), [("aa bb cc", 5, "aa bb"), ("aa bbbbbb", 6, "aa bbb"), ("short", 10, "short"), ("aaaa bb", 6, "aaaa"), (None, 5, ""), ("abc", 0, "")])
def test_truncate(spark, text, n, want):
    assert one(spark, truncate("x", n), text) == [want]


def test_char_ngrams(spark):
    assert one(spark, char_ngrams("x"), "аб в")[0] == [" аб", "аб ", " аб ", " в "]
    assert one(spark, char_ngrams("x"), None, "") == [[], []]


def test_geo_columns(spark):
    row = spark.range(1).select(haversine(F.lit(55.75), F.lit(37.62), F.lit(59.94), F.lit(30.31)).alias("a"), haversine(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("b")).first()
    assert row.a == pytest.approx(634, abs=2)
    assert row.b is None
    bins = spark.createDataFrame([(0.0,), (0.5,), (99.0,), (None,)], "x double").select(bin_of(F.col("x"), (0, 0.5, 1)).alias("b"))
    assert [r.b for r in bins.collect()] == [0, 1, 1, None]
    assert [r[0] for r in bins.select(curve(F.col("b"), [5.0, 7.0], -1.0)).collect()] == [5.0, 7.0, 7.0, -1.0]


def test_keys_and_numbers(spark):
    df = spark.createDataFrame([("q", None, 1, "f", 2)], "search_query string, search_location_id long, search_is_delivery_search int, search_infm_params_text string, search_category int")
    row = df.select(composite_key().alias("k"), short_id(composite_key()).alias("i")).first()
    assert row.k == "q\x1f\x1f1\x1ff\x1f2"
    assert len(row.i) == 16
    ids = spark.range(500).select(F.col("id").cast("string").alias("id"))
    got = [r.id for r in numbered(ids, "id", 4).orderBy("slot").collect()]
    assert got == [r.id for r in ids.orderBy(shuffled(F.col("id"), 4), "id").collect()]
    assert [r.slot for r in numbered(ids, "id", 4).orderBy("slot").collect()] == list(range(500))


def docs(spark, *rows):
    return spark.createDataFrame([(d, f, t) for d, fields in rows for f, t in fields.items()], "doc string, field string, text string")


def asked(spark, *rows):
    return spark.createDataFrame(list(rows), "query string, text string")


def test_bm25f_by_hand(spark):
    fields = (Field("title", 2.0, 0.5), Field("body", 1.0, 0.0))
    index = build_index(docs(spark, ("a", {"title": "кран кран", "body": "кран течь"}), ("b", {"title": "течь", "body": ""}), ("c", {"title": "", "body": "дом"})), fields)
    idf = lambda df: math.log(1 + (3 - df + 0.5) / (df + 0.5))
    average = 1.5
    x = 2 * 2 / (0.5 + 0.5 * 2 / average) + 1.0
    found = {r.doc: r.score for r in index.search(asked(spark, ("q", "кран кран"), ("none", "неизвестно"), ("empty", None)), 5).collect()}
    assert found == {"a": pytest.approx(idf(1) * x / (1.2 + x), abs=1e-8)}
    body = index.reweight([Field("body", 1.0, 0.0)], 0.5)
    assert {r.doc: r.score for r in body.search(asked(spark, ("q", "кран")), 5).collect()} == {"a": pytest.approx(idf(1) / 1.5, abs=1e-8)}
    assert {r.term: r.df for r in index.vocabulary.collect()} == {"кран": 1, "течь": 2, "дом": 1}


def test_title_boost_flips_the_order_and_min_df_counts_fields(spark):
    rows = docs(spark, ("t", {"title": "кран", "description": "дом"}), ("d", {"title": "дом", "description": "кран кран кран"}))
    index = build_index(rows, (Field("title", 5.0, 0.0), Field("description", 1.0, 0.0)))
    first = lambda i: i.search(asked(spark, ("q", "кран")), 1).first().doc
    assert first(index) == "t"
    assert first(index.reweight([Field("title", 0.1, 0.0), Field("description", 1.0, 0.0)])) == "d"
    assert {r.term for r in build_index(docs(spark, ("a", {"title": "кран", "description": "кран"}), ("b", {"title": "дом", "description": ""})), least_df=2).vocabulary.collect()} == {"кран"}


def test_presence(spark):
    index = build_index(docs(spark, ("a", {"title": "ремонт кранов", "description": "кухня"}), ("b", {"title": "дом", "description": "ремонт"})))
    pairs = spark.createDataFrame([("q", "a"), ("q", "b"), ("e", "a")], "query string, doc string")
    got = {(r.query, r.doc): r for r in index.presence(pairs, asked(spark, ("q", "ремонт кухня неизвестно"), ("e", "")), "title").collect()}
    assert got["q", "a"].coverage == 0.5
    assert got["q", "b"].coverage == got["e", "a"].coverage == got["e", "a"].bm25 == 0.0
    with pytest.raises(KeyError):
        index.presence(pairs, asked(spark, ("q", "x")), "nothing")


KEYS = ["Вид услуги", "Тип услуги", "Время работы, с", "Время работы", "Предоплата"]


def test_params(spark):
    df = spark.createDataFrame([("Вид услуги Автосервис, аренда Тип услуги Аренда авто Вид услуги Мойка Предоплата",), ("Время работы, с 09:30 Вид услуги Ремонт",), ("без ключа",), ("ничьё Предоплата",), (None,)], "x string").withColumn("p", parsed("x", KEYS))
    rows = df.select("p", as_map(F.col("p")).alias("m"), first_value(F.col("p"), "Вид услуги").alias("f"), values_of(F.col("p"), "Вид услуги").alias("v"), telling_values("x", KEYS).alias("t"), key_coverage("x", KEYS).alias("c")).collect()
    assert [tuple(p) for p in rows[0].p] == [("Вид услуги", "Автосервис, аренда"), ("Тип услуги", "Аренда авто"), ("Вид услуги", "Мойка"), ("Предоплата", "")]
    assert rows[0].m == {"Вид услуги": ["Автосервис, аренда", "Мойка"], "Тип услуги": ["Аренда авто"], "Предоплата": [""]}
    assert [tuple(p) for p in rows[1].p] == [("Время работы, с", "09:30"), ("Вид услуги", "Ремонт")]
    assert rows[1].t == ["Ремонт"]
    assert [r.f for r in rows] == ["Автосервис, аренда", "Ремонт", "", "", ""]
    assert rows[2].v == []
    assert [r.c for r in rows] == [1.0, 1.0, 0.0, 0.5, 1.0]
    assert one(spark, is_number(F.col("x")), "09:30", "9.30", "1.000,5", "12", "1.2.3", "5 лет", ".") == [True, True, True, True, False, False, False]


def test_keys_are_found(spark):
    rows = [(i, f"Вид {a}{i % 7} {b} Цвет {c} {d}") for i, (a, b, c, d) in enumerate((a, b, c, d) for a in "абвгде" for b in ("один", "два", "три", "пять") for c in ("синий", "алый", "белый", "серый") for d in "xyz")]
    found = discover_keys(spark.createDataFrame(rows, "id int, t string"), "id", "t")
    assert "Цвет" in found
    assert "Вид" in found
    assert discover_parser(spark.createDataFrame(rows, "id int, t string"), "id", "t") == found
    assert discover_keys(spark.createDataFrame([], "id int, t string"), "id", "t") == []


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id long, t string").withColumn("d", F.lit("1.5").cast("decimal(10,2)"))
    df.write.parquet(f"{tmp_path}/t.parquet")
    assert available_columns(spark, f"{tmp_path}/t.parquet") == ["id", "t", "d"]
    assert dict(read_table(spark, f"{tmp_path}/t.parquet").dtypes)["d"] == "double"
    assert dict(decimals_to_double(df).dtypes)["id"] == "bigint"
    with pytest.raises(KeyError, match="nothing"):
        require_columns(df, ["id", "nothing"])
    assert [c["there"] for c in check_data(spark, [f"{tmp_path}/t.parquet", f"{tmp_path}/none"])] == [True, False]
    save_tables({"t": df}, f"{tmp_path}/index", {"k1": 1.2})
    assert load_tables(spark, f"{tmp_path}/index", {"k1": 1.2})["t"].count() == 1
    assert load_tables(spark, f"{tmp_path}/index", {"k1": 1.3}) is None
    assert load_tables(spark, f"{tmp_path}/nowhere", {}) is None
    assert fingerprint(a=1, b=2) == fingerprint(b=2, a=1) != fingerprint(a=1, b=3)

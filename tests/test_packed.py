import pytest

from tessera.operators.packed import known_keys, one_per_key, split_values, value_set, value_tokenizer

KEYS = ["Вид работ", "Срок", "Срок, не позже", "Пакет", "Часы, с", "Формат", "Формат занятий", "Марка"]


def by_hand(text: str) -> list[tuple[str | None, str]]:
    """A character-by-character reading of the rules, for texts without nested quotes."""
    closing = {'"': '"', "'": "'", "«": "»"}
    out, key, waiting, piece, at = [], None, False, "", 0

    def put():
        nonlocal piece, waiting
        value = " ".join(piece.split())
        if value:
            out.append((key, value))
            waiting = False
        piece = ""

    def key_at(i):
        if i and (text[i - 1].isalnum() or text[i - 1] == "_"):
            return None
        for k in sorted(KEYS, key=len, reverse=True):
            j = i
            for n, word in enumerate(k.split(" ")):
                if n:
                    start = j
                    while j < len(text) and text[j].isspace():
                        j += 1
                    if j == start:
                        break
                if not text.startswith(word, j):
                    break
                j += len(word)
            else:
                if j >= len(text) or not (text[j].isalnum() or text[j] == "_"):
                    return k, j
        return None

    while at < len(text):
        c = text[at]
        if c in closing and not (c == "'" and at and text[at - 1].isalnum()):
            end = at + 1
            while True:
                end = text.find(closing[c], end)
                if end >= 0 and c == '"' and text[end : end + 2] == '""':
                    end += 2
                    continue
                break
            if end >= 0:
                inside = text[at + 1 : end]
                piece += inside.replace('""', '"') if c == '"' else inside
                at = end + 1
                continue
        if found := key_at(at):
            put()
            if waiting:
                out.append((key, ""))
            (key, at), waiting = found, True
            rest = at
            while rest < len(text) and text[rest].isspace():
                rest += 1
            if rest < len(text) and text[rest] in ":=":
                at = rest + 1
            continue
        if c in ";|,/•\t\n\r":
            digits = 0 < at < len(text) - 1 and text[at - 1].isdigit() and text[at + 1].isdigit()
            after = text[at + 1 :].lstrip("  ")
            if not digits and not (c == "," and after[:1].islower()):
                put()
                at += 1
                continue
        piece += c
        at += 1
    put()
    if waiting:
        out.append((key, ""))
    return out


CASES = [
    ("Вид работ: Уборка, Мойка; Срок, не позже 31/08", [("Вид работ", "Уборка"), ("Вид работ", "Мойка"), ("Срок, не позже", "31/08")]),
    ("Пакет;;Вид работ = \"Студия \"\"Ларь\"\"\" / 'a; b'", [("Пакет", ""), ("Вид работ", 'Студия "Ларь"'), ("Вид работ", "a; b")]),
    ("Формат занятий Запись, с проверкой", [("Формат занятий", "Запись, с проверкой")]),
    ("Часы, с:08:30 • Срок 24/7, , 1,5 часа", [("Часы, с", "08:30"), ("Срок", "24/7"), ("Срок", "1,5 часа")]),
    ("Срок «Пакет; Срок»  Срочно", [("Срок", "Пакет; Срок Срочно")]),
    ("без ключа; Марка O'Neil", [(None, "без ключа"), ("Марка", "O'Neil")]),
    ('Марка "не закрыта; ещё', [("Марка", '"не закрыта'), ("Марка", "ещё")]),
    ("", []),
    (" ; , ", []),
    ("Пакет", [("Пакет", "")]),
]


@pytest.mark.parametrize(("text", "pairs"), CASES)
def test_rules(text, pairs):
    assert value_tokenizer(KEYS)(text) == pairs
    assert by_hand(text) == pairs


def test_nested_angle_quotes_keep_the_inner_ones():
    assert value_tokenizer(KEYS)("Марка «a «b; c» d»; e") == [("Марка", "a «b; c» d"), ("Марка", "e")]
    assert value_tokenizer(KEYS)(None) == []
    assert value_tokenizer([])("a; b") == [(None, "a"), (None, "b")]


def test_real_texts_against_the_hand_reading(spark):
    folder = "/root/testdata/sf0.001"
    keys = known_keys(spark.read.parquet(f"{folder}/param_keys.parquet"))
    KEYS[:] = keys
    tokenize = value_tokenizer(keys)
    texts = [r[0] for r in spark.read.parquet(f"{folder}/benchmark_items.parquet").select("item_infm_params_text").collect() if r[0]]
    assert texts
    assert all(tokenize(t) == by_hand(t) for t in texts)


def test_rows_positions_and_odd_columns(spark):
    long = "Срок " + "; ".join(f"день {i}" for i in range(20_000))
    df = spark.createDataFrame([("a", "Срок 1 • 2", 7), ("b", None, 7), ("c", "", 7), ("a", "Срок 1 • 2", 7), ("d", long, 7)], "id string, t string, pos int")
    got = split_values(df, "t", ["Срок"], ["id"])
    assert got.columns == ["id", "pos", "param_key", "val"]
    rows = [tuple(r) for r in got.where("id <> 'd'").orderBy("id", "pos").collect()]
    assert rows == [("a", 1, "Срок", "1"), ("a", 1, "Срок", "1"), ("a", 2, "Срок", "2"), ("a", 2, "Срок", "2")]
    assert got.where("id = 'd'").count() == 20_000
    assert split_values(df.limit(0), "t", ["Срок"], ["id"]).count() == 0


def test_one_per_key_and_value_set(spark):
    df = spark.createDataFrame([("a", "y", 1), ("a", "x", 2), (None, "z", 3), ("b", None, 4)], "id string, t string, __k int")
    assert sorted(map(tuple, one_per_key(df, "id", ["t"]).collect()), key=str) == [("a", "x"), ("b", None)]
    sets = spark.createDataFrame([("Срок 1; 2",), ("Срок: 2, Срок 1",), (None,), ("",)], "t string").select(value_set("t", ["Срок"]).alias("s"))
    a, b, c, d = (r[0] for r in sets.collect())
    assert a == b != ""
    assert c == d == ""
    with pytest.raises(ValueError, match="more than 1 keys"):
        known_keys(spark.createDataFrame([("a",), ("b",)], "param_key string"), most=1)

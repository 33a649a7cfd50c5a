"""The subpackage's queries on the smallest tables: against their SQL where there is one, against plain Python for the searches."""

import re
from pathlib import Path

import duckdb
import pytest

from tessera.llm import queries as llm
from tessera.operators.packed import value_tokenizer

FOLDER = "/root/testdata/sf0.001"


def plain(row):
    return tuple("nan" if isinstance(v, float) and v != v else repr(v) for v in row)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_query(spark, duck, name):
    df = llm.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted(plain(r[c] for c in columns) for r in df.collect())
    sql = llm.oracle_sql().get(name)
    if sql is None:
        assert len(rows) == len(set(rows))
        return
    rel = duck.sql(sql)
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert rows == sorted(plain(r[i] for i in at) for r in rel.fetchall())


def test_repeated_searches_against_plain_python(spark, duck):
    tokenize = value_tokenizer([r[0] for r in duck.execute("select param_key from param_keys").fetchall()])
    alike = str.maketrans("ёaeopcx", "еаеорсх")
    groups = {}
    for pair, query, location, params in duck.execute("select pair_id, search_query, search_location_id, search_infm_params_text from train").fetchall():
        if query and query.strip():
            words = tuple(re.findall(r"[^\W_]+", query.lower().translate(alike)))
            groups.setdefault((words, location, frozenset(tokenize(params))), []).append(pair)
    want = {(p, min(g)) for g in groups.values() if len(g) > 1 for p in g}
    assert {(r.pair_id, r.group_id) for r in llm.p2_found(spark, FOLDER).collect()} == want

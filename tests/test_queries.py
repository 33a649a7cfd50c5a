"""Every query that doesn't come from the training-data subpackage against its SQL, on the smallest tables."""

import duckdb
import pytest

from tessera.plans import models, reports, retrieval, texts, training

FOLDER = "/root/testdata/sf0.001"
PARTS = (training, texts, retrieval, reports, models)
ALL = {name: (query, part.oracle_sql().get(name)) for part in PARTS for name, query in part.queries().items()}
#: Fits of 400 trees; test_whole_jobs has them with fewer.
SLOW = {"rerank_gbt", "rerank_importance"}


def plain(row):
    return tuple("nan" if isinstance(v, float) and v != v else repr(v) for v in row)


@pytest.fixture(scope="module")
def duck():
    from pathlib import Path

    c = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", [n for n in ALL if n not in SLOW])
def test_query(spark, duck, name):
    query, sql = ALL[name]
    df = query(spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted(plain(r[c] for c in columns) for r in df.collect())
    if sql is None:
        return
    rel = duck.sql(sql)
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert rows == sorted(plain(r[i] for i in at) for r in rel.fetchall())

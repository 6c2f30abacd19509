import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda v: None if pd.isna(v) else v.item() if hasattr(v, "item") else v
    return sorted((tuple(float(x) if isinstance(x := plain(v), float) else x for v in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [k for k in entry.catalog.QUERIES if k in entry.catalog.ORACLES])
def test_query_equals_sql(spark, sql, name):
    found, want = entry.queries()[name](spark, SF).toPandas(), sql.sql(entry.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(want.columns)
    a, b = rows(found), rows(want)
    assert len(a) == len(b) and all(x == y or [round(v, 6) if isinstance(v, float) else v for v in x] == [round(v, 6) if isinstance(v, float) else v for v in y] for x, y in zip(a, b, strict=True))


def test_entry(spark):
    assert entry.entry(spark).count() > 0

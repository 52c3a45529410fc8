"""Every query against its SQL in DuckDB, on the smallest tables; queries without SQL have rows."""

import duckdb
import pandas as pd
import pytest

from lodestone import queries as engine

TABLES = ["documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events"]


def plain(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    rows = []
    for r in df.itertuples(index=False):
        rows.append(tuple(None if x is None or x is pd.NA or x != x else round(float(x), 6) if isinstance(x, (float, int)) or hasattr(x, "dtype") and x.dtype.kind in "iuf" else str(x) for x in r))
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name", list(engine.QUERIES))
def test_query(spark, data, name):
    got = engine.QUERIES[name](spark, data).toPandas()
    if name not in engine.ORACLE:
        assert len(got)
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    want = con.sql(engine.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)

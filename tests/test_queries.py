"""Every registered mail query against its SQL."""

import duckdb
import pandas as pd
import pytest

from mailgrain.plans import queries, stored, values

assert values.query is stored.query is queries.query  # their queries are registered with the others
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def rows(frame):
    def plain(v):
        if pd.isna(v):
            return None
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(repr(tuple(map(plain, r))) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, sf, con, name):
    got = queries.QUERIES[name](spark, sf).toPandas()
    expected = con.execute(queries.SQL[name]).fetchdf()
    assert list(sorted(got.columns)) == sorted(expected.columns)
    assert rows(got) == rows(expected)

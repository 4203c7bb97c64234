"""Every query of the engine against its DuckDB form on the smallest tables."""

import math

import duckdb
import pytest

from reachbase.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(row):
    return tuple("null" if v is None or isinstance(v, float) and math.isnan(v) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_oracle(spark, duck, name):
    rows = catalogue.QUERIES[name](spark, SF)
    got = [plain(r) for r in rows.select(*sorted(rows.columns)).collect()]
    if name not in catalogue.ORACLE:
        assert got
        return
    result = duck.sql(catalogue.ORACLE[name])
    assert sorted(result.columns) == sorted(rows.columns)
    quoted = ", ".join(f'"{c}"' for c in sorted(result.columns))
    assert sorted(got) == sorted(plain(r) for r in result.select(quoted).fetchall())

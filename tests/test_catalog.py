"""Every query with SQL gives DuckDB's rows; those without give rows of a stable schema."""

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest

from shockwire import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return plain(float(v))
    if isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


def rows(found):
    return sorted((tuple(map(plain, r)) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    assert cols == sorted(duck.sql(SQL[name]).columns)
    quoted = ", ".join(f'"{c}"' for c in cols)
    assert rows(df.select(*[f"`{c}`" for c in cols]).collect()) == rows(duck.sql(f"select {quoted} from ({SQL[name]})").fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.schema == QUERIES[name](spark, SF).schema
    df.collect()


def test_names_are_ids():
    assert len(QUERIES) > 120

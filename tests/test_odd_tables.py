"""Queries against DuckDB on tables on which they differed: without events, with flat series, with ties."""

import os
from pathlib import Path

import duckdb
import pytest
from test_catalog import QUERIES, SF, SQL, rows


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """The tables with one price on all days and no urgent orders (no shock, no warning), and line items four times: in order over
    two files, so that rows of one order and number differ in their part."""
    folder = tmp_path_factory.mktemp("odd")
    for p in Path(SF).glob("*.parquet"):
        if p.stem not in ("orders", "lineitem"):
            os.symlink(p, folder / p.name)
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    con.sql("set threads = 1")  # its ties are in the table's order with one thread only
    con.sql(f"copy (select * replace (100.0::DOUBLE as o_totalprice, '5-LOW' as o_orderpriority) from '{SF}/orders.parquet') to '{folder}/orders.parquet'")
    (folder / "lineitem.parquet").mkdir()
    for k in range(2):
        con.sql(f"copy (select * replace (l_partkey + 1000 * (1 - i) + 5000 * (1 - {k}) as l_partkey) from range(2) r(i), '{SF}/lineitem.parquet' order by hash(l_orderkey, l_linenumber, i + {k})) to '{folder}/lineitem.parquet/part-{k}.parquet' (row_group_size 2048)")
    for p in folder.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return str(folder), con


@pytest.mark.parametrize("name", ["B11_daily_scores", "B11_score_table", "D1_distinct_ids", "M24_dual_axis", "Q16_catch_up"])
def test_sql_on_odd_tables(spark, odd, name):
    folder, con = odd
    df = QUERIES[name](spark, folder)
    quoted = ", ".join(f'"{c}"' for c in df.columns)
    want = con.sql(f"select {quoted} from ({SQL[name]})").fetchall()
    assert want and rows(df.collect()) == rows(want)

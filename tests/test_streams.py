"""Date partitions under a manifest, and statuses in order of date, on streams."""

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shockwire.streaming import daily, partitioned, status

DAY = dt.date(2024, 1, 1)
SCHEMA = "date date, k string, risk_score double"


def day(n):
    return DAY + dt.timedelta(days=n)


def size(path):
    return sum(p.stat().st_size for p in Path(path).rglob("*.parquet"))


def test_a_batch_writes_its_dates(spark, tmp_path):
    table = f"{tmp_path}/table"
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    rnd = random.Random(1)
    rows = {(day(n), f"k{k}"): rnd.random() for n in range(40) for k in range(500)}
    assert partitioned.write_batch(make([(*k, v) for k, v in rows.items()]), 0, table, "date", "k") == 40
    first = size(table)
    new = [(day(7), "k3", -1.0), (day(7), "new", -2.0), (day(40), "k0", -3.0), (None, "k0", -4.0)]
    assert partitioned.write_batch(make(new), 1, table, "date", "k") == 3
    assert size(table) - first < first / 10  # one of forty dates, and a few rows
    rows |= {(d, k): v for d, k, v in new}
    current = lambda: {(r.date, r.k): r.risk_score for r in partitioned.read(spark, table, make([]).schema).collect()}
    assert current() == rows
    before = size(table)
    assert partitioned.write_batch(make([(day(7), "k3", 99.0)]), 1, table, "date", "k") == 0
    assert size(table) == before and current() == rows
    # a batch that failed before its manifest leaves the table as it was, and can be repeated
    make([(day(2), "half", 0.0)]).write.partitionBy("date").parquet(f"{table}/data/batch=2")
    assert current() == rows
    assert partitioned.write_batch(make([(day(2), "whole", 5.0)]), 2, table, "date", "k") == 1
    assert current() == rows | {(day(2), "whole"): 5.0}
    assert partitioned.write_batch(make([]), 3, table, "date", "k") == 0
    with pytest.raises(ValueError, match="date"):
        partitioned.write_batch(make(new), 4, table, "k")


def test_upsert_dates_on_a_stream(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    for rows in ([(day(0), "a", 1.0), (day(1), "a", 2.0)], [(day(1), "a", 9.0), (day(2), "a", 3.0)]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        partitioned.upsert_dates(daily.landing(spark, f"{tmp_path}/in", schema), f"{tmp_path}/table", f"{tmp_path}/ck", "date", "k").awaitTermination()
    assert sorted(map(tuple, partitioned.read(spark, f"{tmp_path}/table", schema).collect())) == [(day(0), "a", 1.0), (day(1), "a", 9.0), (day(2), "a", 3.0)]
    assert {(r.date, r.batch) for r in partitioned.manifest(spark, f"{tmp_path}/table").collect()} == {(day(0), 0), (day(1), 1), (day(2), 1)}


def test_shuffled_days_are_told_in_order(spark, tmp_path):
    """Days that come up to six days late give the statuses of the ordered series."""
    rnd = random.Random(2)
    scores = {s: [rnd.choice((5.0, 18.52, 40.0)) for _ in range(30)] for s in "ab"}
    rows = sorted(((s, day(n), x) for s, xs in scores.items() for n, x in enumerate(xs)), key=lambda r: (r[1] - DAY).days + rnd.random() * 5)
    assert [r[1] for r in rows if r[0] == "a"] != [day(n) for n in range(30)]
    schema = "series string, date date, risk_score double"
    batches = [rows[at : at + 12] for at in range(0, len(rows), 12)] + [[("a", day(100), 0.0), ("b", day(100), None)], [("a", day(200), 0.0)], [("a", day(3), 99.0)]]
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        found = status.ordered_streaks(daily.landing(spark, f"{tmp_path}/in", schema), 18.52)
        daily.run_once(found, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    want = []
    for s, xs in scores.items():
        run = 0
        for n, x in enumerate(xs):
            run = run + 1 if x >= 18.52 else 0
            want.append((s, day(n), x, run, "WARNING" if run else "NORMAL"))
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, got.where(F.col("date") < day(50)).collect())) == sorted(want)
    assert [tuple(r) for r in got.where(F.col("date") == day(100)).orderBy("series").collect()] == [("a", day(100), 0.0, 0, "NORMAL"), ("b", day(100), None, 0, "NORMAL")]

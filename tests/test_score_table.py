"""Range sums, the score table and footers against plain loops."""

import datetime as dt
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from shockwire.operators import scoring, windows
from shockwire.sources import footers, score_table

DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def test_range_sums_by_a_plain_loop(spark):
    rnd = random.Random(1)
    daily = {(k, day(rnd.randrange(60))): rnd.randint(1, 9) for k in "abc" for _ in range(30)}
    asked = {(k, day(rnd.randrange(-5, 70)), rnd.choice((1, 7, 30))) for k in "abcd" for _ in range(40)}
    got = windows.range_sums(
        spark.createDataFrame([(k, d, n) for (k, d), n in daily.items()], "property_id string, date date, cnt long"),
        spark.createDataFrame(list(asked), "property_id string, ref_date date, window_days int"), ["property_id"], ["cnt"],
    )
    want = {(k, r, w, sum(n for (j, d), n in daily.items() if j == k and r - dt.timedelta(days=w) <= d < r)) for k, r, w in asked}
    assert {tuple(r) for r in got.select("property_id", "ref_date", "window_days", "cnt").collect()} == want


class Inputs:
    """Counts of 90 days with gaps, and a model of three properties."""

    def __init__(self, spark):
        rnd = random.Random(2)
        self.spark = spark
        self.counts = {(day(n), p): rnd.randint(1, 20) for n in range(90) for p in "xyz" if rnd.random() < 0.8}
        self.model = {"x": (3, 10.0, 1.0), "y": (7, 60.0, 0.5), "z": (14, 100.0, 0.25)}
        self.articles = {d: 5 for d, _ in self.counts}
        self.top = 1.5

    def frames(self):
        make = self.spark.createDataFrame
        return (
            make([(d, p, n) for (d, p), n in self.counts.items()], "date date, property_id string, cnt long"), make(list(self.articles.items()), "date date, n_articles long"),
            make([(p, *v) for p, v in self.model.items()], "property_id string, optimal_window int, ctrl_freq_mean double, weight double"), make([(self.top,)], "top double"),
        )

    def score(self, ref):
        raw = 0.0
        for p, (w, mean, weight) in self.model.items():
            inside = [ref - dt.timedelta(days=k) for k in range(1, w + 1)]
            freq, held = sum(self.counts.get((d, p), 0) for d in inside), sum(d in self.articles for d in inside)
            if 0 < held < w and held / w < 0.8:
                freq = int(freq * w / held)
            raw += weight * max(freq / mean - 1, 0)
        return round(raw, 4), round(min(100.0, raw * 100 / self.top), 2)


def scores(df):
    return {r.date: (pytest.approx(r.raw_score, abs=1e-9), pytest.approx(r.risk_score, abs=1e-9)) for r in df.collect()}


def test_batch_by_a_plain_loop(spark):
    data = Inputs(spark)
    counts, articles, params, top = data.frames()
    days = spark.createDataFrame([(day(n),) for n in range(0, 100, 3)] + [(None,), (day(3),)], "date date")
    batch = scoring.daily_batch(counts, articles, days, params, top)
    assert scores(batch) == {day(n): data.score(day(n)) for n in range(0, 100, 3)}
    plan = batch._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and "explode" not in plan  # no list of days
    assert {r.risk_score for r in scoring.daily_batch(counts, articles, days, params, spark.createDataFrame([(None,)], "top double")).collect()} == {0.0}
    assert scoring.daily_batch(counts, articles, days.limit(0), params, top).count() == 0


def test_score_table_scores_what_is_due(spark, tmp_path):
    data, path = Inputs(spark), f"file://{tmp_path}/table"
    days = lambda *n: spark.createDataFrame([(day(k),) for k in range(*n)], "date date")

    def run(d):
        counts, articles, params, top = data.frames()
        return score_table.backfill(path, counts, articles, d, params, top)

    assert run(days(20, 50)) == 30 and run(days(20, 50)) == 0
    assert run(days(20, 95)) == 45  # the absent days only
    data.counts[day(40), "x"] = 500
    assert run(days(20, 95)) == 14  # days 41 to 54: the longest window after the changed day
    assert scores(score_table.read(spark, path)) == {day(n): data.score(day(n)) for n in range(20, 95)}
    runs = {r.date: r.run for r in score_table.read(spark, path).collect()}
    assert {n for n in range(20, 95) if runs[day(n)] == max(runs.values())} == set(range(41, 55))
    data.counts[day(93), "z"], data.articles[day(93)] = 7, 1  # a new day, late
    assert run(days(20, 97)) == 3  # the stale day 94, and 95 and 96
    data.model["y"] = (7, 50.0, 0.5)
    assert run(days(20, 97)) == 77  # another model
    assert scores(score_table.read(spark, path)) == {day(n): data.score(day(n)) for n in range(20, 97)}
    assert run(days(0)) == 0


@pytest.mark.parametrize("kind", ["date", "timestamp", "text"])
def test_footers_tell_the_span(spark, tmp_path, kind):
    """With every byte before the footers gone, the span is still told: no page is read."""
    days = [day(n) for n in range(300)]
    values = {"date": pa.array(days, pa.date32()), "timestamp": pa.array([dt.datetime(d.year, d.month, d.day, 5) for d in days], pa.timestamp("us")), "text": pa.array([d.isoformat() for d in days])}[kind]
    pq.write_table(pa.table({"n": list(range(300)), "date": values}), tmp_path / "a.parquet", row_group_size=30)
    pq.write_table(pa.table({"n": [1, 2], "date": pa.array([None, None], values.type)}), tmp_path / "b.parquet")
    pq.write_table(pa.table({"n": pa.array([], pa.int64()), "date": pa.array([], values.type)}), tmp_path / "c.parquet")
    tail = {r.date for r in footers.tail_dates(spark, f"file://{tmp_path}", n=4).collect()}
    assert tail == set(days[180:])
    footer = footers.row_groups(spark, f"file://{tmp_path}").agg({"footer_bytes": "sum", "n_rows": "sum"}).first()
    for p in tmp_path.glob("*.parquet"):
        whole = p.read_bytes()
        held = int.from_bytes(whole[-8:-4], "little") + 8
        p.write_bytes(whole[:4] + b"\0" * (len(whole) - held - 4) + whole[-held:])
    got = footers.date_range(spark, f"file://{tmp_path}").first()
    assert (got.first_date, got.last_date) == (days[0], days[-1]) and footer["sum(n_rows)"] == 302


def test_footer_bytes_do_not_follow_rows(spark, tmp_path):
    size = {}
    for n in (1000, 10_000):
        pq.write_table(pa.table({"date": pa.array([day(k // 50) for k in range(n)], pa.date32())}), tmp_path / "t.parquet", row_group_size=n // 4)
        size[n] = footers.row_groups(spark, f"file://{tmp_path}/t.parquet").agg({"footer_bytes": "sum"}).first()[0]
    assert abs(size[10_000] - size[1000]) < 64


def test_footers_without_statistics(spark, tmp_path):
    pq.write_table(pa.table({"date": pa.array([day(3), None, day(9)], pa.date32())}), tmp_path / "a.parquet", write_statistics=False)
    pq.write_table(pa.table({"date": pa.array([day(5)], pa.date32())}), tmp_path / "b.parquet")
    got = footers.date_range(spark, f"file://{tmp_path}").first()
    assert (got.first_date, got.last_date) == (day(3), day(9))
    assert {r.date for r in footers.tail_dates(spark, f"file://{tmp_path}").collect()} == {day(3), day(9), day(5)}
    pq.write_table(pa.table({"date": pa.array([], pa.date32())}), tmp_path / "a.parquet")
    pq.write_table(pa.table({"date": pa.array([], pa.date32())}), tmp_path / "b.parquet")
    none = footers.date_range(spark, f"file://{tmp_path}").first()
    assert none.first_date is None and footers.tail_dates(spark, f"file://{tmp_path}").count() == 0

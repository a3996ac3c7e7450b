"""Queries without SQL, and reports, against values worked out another way."""

import datetime as dt

import duckdb
import numpy as np
import pytest

from shockwire import registry
from shockwire.operators import charts, tagging, trajectory, validation
from shockwire.plans import catalog_series as series
from shockwire.sources import sinks

SF = "/root/testdata/sf0.001"


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("orders", "lineitem", "documents"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_plane_of_the_query(spark, duck):
    """X13 against numpy's least squares on rows that DuckDB made."""
    rows = duck.sql(f"with {series.MON}, l as (select lag(risk_mean, 1) over (order by year_month) as a, lag(risk_max, 2) over (order by year_month) as b, warning_days::double as c, returned as y from merged) select a, b, c, y from l where a is not null and b is not null and c is not null and y is not null").fetchall()
    x, y = np.array([[1, *r[:3]] for r in rows]), np.array([r[3] for r in rows])
    beta, n = np.linalg.lstsq(x, y, rcond=None)[0], len(y)
    e = y - x @ beta
    r2 = 1 - (e @ e) / ((y - y.mean()) @ (y - y.mean()))
    want = dict(zip(["intercept", "risk_mean_lag", "risk_max_lag", "warning_days", "r2", "adjusted_r2", "mae", "half_width_95", "n"], [*beta, r2, 1 - (1 - r2) * (n - 1) / (n - 4), np.abs(e).mean(), 1.96 * e.std(), n], strict=True))
    got = {r["name"]: r["value"] for r in registry.queries()["X13_ols"](spark, SF).collect()}
    assert got == {k: pytest.approx(v, rel=1e-4, abs=2e-6) for k, v in want.items()}


def test_embeddings_of_the_query(spark, duck):
    """M2 over all documents against the encoder called once on each article's text."""
    from shockwire.plans.catalog_text import LEAD

    rows = duck.sql(f"select doc_id, split_part(text, chr(10), 1) as title, {LEAD.replace('body', 'text')} as lead from documents").fetchall()
    got = {r.article_id: r.embedding for r in registry.queries()["M2_encode"](spark, SF).collect()}
    assert len(got) == len(rows)
    for i, title, lead in rows:
        text = f"{title or ''} {lead or ''}".strip()
        assert got[i] == pytest.approx(list(tagging.hashing_encoder([text])[0]), abs=1e-5), i


def plain_metrics(rows):
    tp, fp = sum(y and p for y, p in rows), sum(not y and p for y, p in rows)
    fn, tn = sum(y and not p for y, p in rows), sum(not y and not p for y, p in rows)
    div = lambda a, b: round(a / b, 4) if b else 0.0
    return {"precision": div(tp, tp + fp), "recall": div(tp, tp + fn), "f1": div(2 * tp, 2 * tp + fp + fn), "fpr": div(fp, fp + tn), "tp": tp, "fp": fp, "fn": fn, "tn": tn}


def test_validation_report_by_hand(spark):
    #        day, label, level, score
    train = [(0, 1, 3, 9.0), (1, 1, 2, 7.0), (2, 0, 2, 3.0), (3, 0, 0, 1.0), (4, 0, 1, 2.0)]
    test = [(10, 1, 2, 8.0), (12, 0, 2, 1.0), (14, 1, 0, 7.5), (20, 0, 1, 9.0)]
    scored = spark.createDataFrame([(day(d), y, v, s) for d, y, v, s in train + test] + [(None, 1, 3, 99.0)], "date date, label int, level int, score double")
    happened = spark.createDataFrame([(day(12),), (day(19),)], "date date")
    got = validation.validation_report(scored, happened, str(day(5)))
    values = {(r.section, r.model, r.measure): r.value for r in got.collect()}
    assert values["chosen", "A", "alert_level"] == 2 and values["chosen", "B", "threshold"] == 7.0
    warn = {"A": lambda v, s: v >= 2, "B": lambda v, s: s >= 7.0}
    warn |= {"and": lambda v, s: v >= 2 and s >= 7.0, "or": lambda v, s: v >= 2 or s >= 7.0}
    for section, rows in (("train", train), ("test", test)):
        assert values[section, "all", "rows"] == len(rows)
        for model, rule in warn.items():
            want = plain_metrics([(y == 1, rule(v, s)) for _, y, v, s in rows])
            assert {m: values[section, model, m] for m in want} == want
    assert values["train", "B", "auc"] == 1.0 and values["test", "B", "auc"] == 0.5
    for k in (1, 2, 3):
        want = plain_metrics([(y == 1, v >= k) for _, y, v, _ in train])
        assert values["alert level", str(k), "f1"] == want["f1"]
    lead = lambda model: [values["lead time", model, m] for m in ("mean_lead", "median_lead", "min_lead", "max_lead", "n_warnings", "n_with_future")]
    assert lead("A") == [1.0, 1.0, 0.0, 2.0, 2.0, 2.0]  # days 10 and 12
    assert lead("B") == [3.5, 3.5, 2.0, 5.0, 3.0, 2.0]  # days 10, 14 and 20, the last without an event
    text = sinks.report("Validation", got, ("train", "test"))
    assert text.startswith("# Validation\n\n## train\n\n| measure | A | B | all | and | or |\n") and "| auc | - | 0.5000 | - | - | - |" in text


def test_status_and_peak_by_hand(spark):
    make = lambda xs: spark.createDataFrame([(day(n), x) for n, x in xs], "date date, risk_score double")
    scores = make([(0, 5.0), (8, 6.0), (10, 20.0), (11, 40.0), (12, 40.0), (13, 1.0), (14, 19.0), (15, 25.0)])
    details = spark.createDataFrame([(day(15), "a", 1.6, 0.2), (day(15), "b", 1.2, 0.9), (day(15), "c", 0.4, 0.0), (day(12), "z", 9.0, 9.0)], "date date, property_id string, ratio double, contribution double")
    r = charts.status_panel(scores, details, 18.52, top=2).collect()
    assert [tuple(x)[:-1] for x in r] == [(day(15), 25.0, "WARNING", 2, 40.0, day(11), 2, 1)]
    assert [(t.property_id, t.ratio) for t in r[0].top] == [("b", 1.2), ("a", 1.6)]
    assert charts.status_panel(scores, details.limit(0), 18.52).first().n_active == 0 and charts.status_panel(scores.limit(0), details, 1.0).count() == 0
    got = [tuple(x) for x in charts.peak_pattern(scores, 18.52).orderBy("date").collect()]
    assert got == [
        (day(8), 6.0, False, False, "normal"), (day(10), 20.0, True, False, "rise"), (day(11), 40.0, True, True, "rise"), (day(12), 40.0, True, False, "fall"), (day(13), 1.0, False, False, "fall"),
        (day(14), 19.0, True, False, "fall"), (day(15), 25.0, True, False, "fall"),
    ]
    assert charts.peak_pattern(scores, 99.0).count() == 0


def test_separation_by_hand(spark):
    make = lambda xs: spark.createDataFrame([(1, x) for x in xs] + [(2, 0.0)], "rank int, similarity double")
    controls = [0.1, 0.5, 0.6, 0.9]
    got = {r.kind: r for r in trajectory.separation(make([0.95, 0.4]), make(controls)).collect()}
    c = got["control"]
    assert (c.n, c.mean_similarity, c.std_similarity, c.max_similarity, c.p95_similarity) == pytest.approx((4, np.mean(controls), np.std(controls), 0.9, np.percentile(controls, 95)))
    assert got["event"].share_above == 0.5 and got["event"].max_similarity == 0.95

"""Prefix scans and fused similarity products against plain loops."""

import datetime as dt
import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from shockwire.operators import backtest, stats, tagging, validation
from shockwire.operators.scan import Running, bounds, scan


@pytest.mark.parametrize("ranges", [1, 2, 7, 40, None])
def test_scan_by_a_plain_loop(spark, ranges):
    rnd = random.Random(1)
    rows = [(rnd.choice("ab"), rnd.choice((None, *range(30))), rnd.choice((None, *range(-5, 6)))) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, at int, v int").repartition(5)
    running = {"total": Running("sum", "v"), "top": Running("max", "v"), "least": Running("min", "v", after=True), "rest": Running("sum", "v", after=True)}
    place = lambda x: -math.inf if x is None else x

    def want(k, at, keyed):
        same = [(place(a), v) for j, a, v in rows if v is not None and (j == k or not keyed)]
        upto, after = [v for a, v in same if a <= place(at)], [v for a, v in same if a >= place(at)]
        return tuple(f(x) if x else None for f, x in ((sum, upto), (max, upto), (min, after), (sum, after)))

    for keys in ((), ("k",)):
        got = sorted(map(tuple, scan(df, "at", running, keys, ranges).collect()), key=repr)
        assert got == sorted(((k, a, v, *want(k, a, bool(keys))) for k, a, v in rows), key=repr)
    assert scan(df.limit(0), "at", running, (), ranges).count() == 0


def test_scan_of_dates_and_doubles(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=n) for n in range(50)]
    df = spark.createDataFrame([(d, float(i)) for i, d in enumerate(days)], "d date, x double")
    assert len(bounds(df, "d", 5)) == 4
    assert [r.s for r in scan(df, "d", {"s": Running("sum", "x")}, ranges=5).orderBy("d").collect()] == list(itertools.accumulate(range(50)))
    assert [r.s for r in scan(df, "x", {"s": Running("max", "x")}, ranges=5).orderBy("d").collect()] == [float(k) for k in range(50)]


def test_millions_of_distinct_scores(spark):
    """5 million distinct scores over 8 ranges: no task has all of them, and the area is the known one."""
    n = 5_000_000
    scored = spark.range(0, n, 1, 8).select((F.col("id") * 0.5).alias("score"), (F.col("id") % 2).alias("label"))
    began = time.perf_counter()
    assert stats.auc(scored, ranges=8).first()["auc"] == pytest.approx(0.5 + 1 / n, abs=1e-9)
    assert time.perf_counter() - began < 300
    plan = stats.auc(scored, ranges=8)._jdf.queryExecution().optimizedPlan().toString()
    assert all("_range" in line for line in plan.splitlines() if line.strip(" :+-").startswith("Window ["))


def test_curves_in_ranges(spark):
    rnd = random.Random(2)
    rows = [(float(rnd.randrange(25)), rnd.randrange(2)) for _ in range(300)]
    df = spark.createDataFrame(rows, "score double, label int")
    pos, neg = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    for ranges in (1, 6):
        for r in stats.roc(df, ranges).collect():
            tp, fp = sum(y for x, y in rows if x >= r.threshold), sum(1 - y for x, y in rows if x >= r.threshold)
            assert (r.tp, r.fp) == (tp, fp) and (r.precision, r.recall, r.fpr) == pytest.approx((tp / (tp + fp), tp / pos, fp / neg))
        pairs = [(a > b) + (a == b) / 2 for a, y in rows for b, z in rows if y and not z]
        assert stats.auc(df, ranges).first()["auc"] == pytest.approx(sum(pairs) / len(pairs))


def test_leads_and_drawdowns_in_ranges(spark):
    rnd = random.Random(3)
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    warned, happened = [rnd.randrange(200) for _ in range(60)], [rnd.randrange(180) for _ in range(15)]
    make = lambda xs: spark.createDataFrame([(day(x),) for x in xs] + [(None,)], "date date")
    for ranges in (1, 5, None):
        got = validation.lead_times(make(warned), make(happened), ranges).collect()
        want = [(day(w), *next(((day(e), e - w) for e in sorted(happened) if e >= w), (None, None))) for w in warned] + [(None, None, None)]
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    series = {s: [rnd.random() * 100 for _ in range(120)] for s in "ab"}
    df = spark.createDataFrame([(s, day(i), x) for s, xs in series.items() for i, x in enumerate(xs)], "strategy string, date date, asset double")
    for ranges in (1, 4):
        peaks = {(r.strategy, r.date): r.drawdown for r in backtest.drawdowns(df, ranges).collect()}
        assert peaks == {(s, day(i)): pytest.approx(x / max(xs[: i + 1]) - 1) for s, xs in series.items() for i, x in enumerate(xs)}


@pytest.fixture(scope="module")
def space(spark):
    rnd = np.random.default_rng(4)
    vectors = {f"P{k}": v / np.linalg.norm(v) for k, v in enumerate(rnd.normal(size=(6, 8)))}
    vectors["P6"] = vectors["P2"]  # a tie
    articles = {k: rnd.normal(size=8) for k in range(300)} | {300: np.zeros(8), 301: vectors["P2"] * 3, 302: None}
    make = lambda d, schema: spark.createDataFrame([(k, None if v is None else [float(x) for x in v]) for k, v in d.items()], schema)
    cos = {(a, p): 0.0 if not v.any() else float(v @ w / np.linalg.norm(v)) for a, v in articles.items() if v is not None for p, w in vectors.items()}
    return make(articles, "article_id long, embedding array<double>").repartition(3), make(vectors, "property_id string, vector array<double>"), cos


def test_tags_leave_the_batch_as_hits(spark, space):
    articles, properties, cos = space
    limits = {"P0": 0.3, "P1": 0.9999, "P2": 0.1, "P6": -2.0, "PX": 0.0}
    thresholds = spark.createDataFrame(list(limits.items()), "property_id string, threshold double")
    got = {r.article_id: r.properties for r in tagging.tag_articles(articles, properties, thresholds).collect()}
    assert got == {a: sorted(p for p in limits if (a, p) in cos and cos[a, p] >= limits[p]) for a in range(302)}
    none = tagging.tag_articles(articles, properties.limit(0), thresholds)
    assert {tuple(r.properties) for r in none.collect()} == {()} and none.count() == 302


def test_arg_max_in_the_batch(spark, space):
    articles, properties, cos = space
    twice = articles.unionByName(articles.where("article_id < 20").withColumn("embedding", F.transform("embedding", lambda x: -x)))
    got = {r.article_id: (r.property_id, pytest.approx(r.similarity)) for r in tagging.map_tags(twice, properties, "article_id", 0.4).collect()}
    signs = lambda a: (1, -1) if a < 20 else (1,)
    best = {a: min((-s * cos[a, f"P{p}"], f"P{p}") for p in range(6) for s in signs(a)) for a in range(302)}
    assert got == {a: (p, -c) for a, (c, p) in best.items() if -c >= 0.4}
    assert got[301][0] == "P2"
    assert tagging.map_tags(articles, properties.limit(0), "article_id").count() == 0


def test_calibration_from_histograms(spark, space):
    articles, properties, cos = space
    rnd = random.Random(5)
    truth = {(a, p) for (a, p), c in cos.items() if c + rnd.gauss(0, 0.2) > 0.4} | {(302, "P1"), (5, "PX")}
    frame = spark.createDataFrame([*truth, (7, "P1"), (7, "P1"), (None, "P1")], "article_id long, property_id string")
    truth |= {(7, "P1")}
    got = {r.property_id: (r.threshold, pytest.approx(r.f1)) for r in tagging.calibrate(articles, properties, frame, "article_id").collect()}
    grid = [round(0.3 + k * 0.05, 10) for k in range(11)]

    def best(pairs):
        scored = [(2 * sum(cos[x] >= t for x in pairs if x in truth) / max(1, sum(cos[x] >= t for x in pairs) + sum(x in truth for x in pairs)), t) for t in grid]
        f1 = max(f for f, _ in scored)
        return next((f, t) for f, t in scored if f == f1)

    whole = best(list(cos))
    want = {None: (whole[1] if whole[0] > 0 else 0.5, whole[0])}
    for k in range(7):
        f1, t = best([x for x in cos if x[1] == f"P{k}"])
        want[f"P{k}"] = (t if f1 > 0 else want[None][0], f1)
    assert got == want
    histogram = tagging.similarity_histogram(articles, properties, frame, grid).collect()
    assert len(histogram) <= 7 * 12 and sum(r.n for r in histogram) == 302 * 7

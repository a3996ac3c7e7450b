"""Operators that SQL does not reach, against hand-worked values and plain folds."""

import datetime as dt
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from shockwire.functions import special
from shockwire.functions.adf import adf_pvalue
from shockwire.functions.hdbscan import hdbscan, silhouette
from shockwire.operators import backtest, checks, dictionary, evaluator, events, scoring, social, stats, tagging, text, trajectory, windows
from shockwire.plans import standins
from shockwire.sources import files, sinks
from shockwire.streaming import daily as stream

DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def test_tails():
    assert special.student_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert special.f_tail(4.9646, 1, 10) == pytest.approx(0.05, abs=1e-4)
    assert special.betainc(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-10)
    assert special.hypergeometric_tail(3, 1, 1, 3) == pytest.approx(17 / 70)
    assert special.hypergeometric_tail(0, 5, 0, 5) == 1


def test_tail_columns(spark):
    df = spark.createDataFrame([(1.959964, 3.841459, 2.228, 10.0), (None, None, None, None)], "z double, x double, t double, df double")
    r = df.select(special.normal_tail("z").alias("z"), special.chi2_tail("x").alias("x"), special.t_two_sided("t", "df").alias("t")).collect()
    assert [r[0].z, r[0].x, r[0].t] == [pytest.approx(v, abs=1e-4) for v in (0.025, 0.05, 0.05)] and r[1].z is None


def test_sessions_at_the_gap(spark):
    days = spark.createDataFrame([(day(n),) for n in (0, 5, 10, 16, 17)], "date date")
    assert [r.event_id for r in events.sessions(days, 5).orderBy("date").collect()] == [1, 1, 1, 2, 2]


def test_event_at_the_first_price_has_no_fall(spark):
    prices = spark.createDataFrame([(day(0), 100.0), (day(1), 50.0), (day(2), 60.0), (day(9), 20.0)], "date date, close double")
    shocks = spark.createDataFrame([(day(0),), (day(9),)], "date date")
    table = events.event_table(events.sessions(shocks), prices).orderBy("event_id").collect()
    assert table[0].max_cumulative_drop is None and table[1].max_cumulative_drop == -66.67
    assert events.event_table(events.sessions(shocks.limit(0)), prices).count() == 0


def test_missing_close_is_carried(spark):
    prices = spark.createDataFrame([(day(0), 100.0), (day(1), None), (day(2), 90.0)], "date date, close double")
    assert [r.ret for r in events.returns(prices).orderBy("date").collect()] == [None, 0.0, pytest.approx(-0.1)]


def test_properties_of_each_kind(spark):
    rows = spark.createDataFrame([(1, '["a", "b"]'), (2, "not json"), (3, None), (4, "[]")], "id int, properties string")
    got = {r.id: r.properties for r in windows.normalize_properties(rows).collect()}
    assert got == {1: ["a", "b"], 2: None, 3: None, 4: []}


def test_windows_against_a_mask(spark):
    rnd = np.random.default_rng(3)
    daily = [(day(int(n)), f"p{n % 3}", int(rnd.integers(1, 9))) for n in rnd.choice(60, 40, replace=False)]
    refs = [(f"r{n}", day(n)) for n in (0, 10, 33, 61)]
    got = {(r.ref_id, r.window_days, r.property_id): r.freq for r in windows.window_frequencies(spark.createDataFrame(daily, "date date, property_id string, cnt long"), spark.createDataFrame(refs, "ref_id string, ref_date date"), (3, 14)).collect()}
    want = {}
    for i, d in refs:
        for w in (3, 14):
            for when, p, c in daily:
                if 1 <= (d - when).days <= w:
                    want[i, w, p] = want.get((i, w, p), 0) + c
    assert got == want


def test_coverage_rules(spark):
    freq = spark.createDataFrame([("a", 10, "p", 7)], "ref_id string, window_days int, property_id string, freq long")
    for days, want in ((10, (7, 7, 7)), (8, (8, 7, 7)), (7, (10, 10, 7)), (0, (7, 7, 7))):
        held = spark.createDataFrame([("a", 10, 5, days)], "ref_id string, window_days int, n_articles long, actual_days long")
        assert tuple(scoring.correct_coverage(freq, held, rule).first().freq for rule in ("always", "below_0_8", "none")) == want


def test_presence_tests(spark):
    rows = [("big", 7, 30, 50, 40, 150), ("small", 7, 3, 4, 1, 4), ("flat", 7, 0, 50, 0, 150)]
    table = spark.createDataFrame(rows, "property_id string, window_days int, be_present long, be_total long, ctrl_present long, ctrl_total long").withColumns({"be_rate": F.col("be_present") / F.col("be_total"), "ctrl_rate": F.col("ctrl_present") / F.col("ctrl_total")})
    got = {r.property_id: r for r in stats.presence_tests(table).collect()}
    assert got["big"].test_type == "chi2" and got["big"].statistic == pytest.approx(200 * (abs(30 * 110 - 20 * 40) - 100) ** 2 / (50 * 150 * 70 * 130))
    assert got["big"].p_value == pytest.approx(math.erfc(math.sqrt(got["big"].statistic / 2)))
    assert got["small"].test_type == "fisher" and got["small"].p_value == pytest.approx(17 / 70)
    assert got["flat"].p_value == pytest.approx(1.0) and got["flat"].odds_ratio == math.inf


def test_bh_with_ties(spark):
    p = [0.01, 0.01, 0.04, 0.03, 0.5]
    rows = spark.createDataFrame(list(enumerate(p)), "id int, p_value double")
    got = [r.p_adjusted for r in stats.bh_adjust(rows, "p_value", None, "id").orderBy("id").collect()]
    assert got == [pytest.approx(x) for x in (0.025, 0.025, 0.05, 0.05, 0.5)]


def test_frequency_test_of_zeros(spark):
    rows = spark.createDataFrame([(f"r{k}", k % 2, 7, "p", 0) for k in range(10)], "ref_id string, label int, window_days int, property_id string, freq long")
    assert stats.frequency_tests(rows).first().p_value == 1.0


def test_auc_of_one_class(spark):
    assert stats.auc(spark.createDataFrame([(1, 2.0), (1, 3.0)], "label int, score double")).first().auc == 0.0


def test_rules_with_long_consequents(spark):
    baskets = spark.createDataFrame([(["a", "b", "c"],)] * 6 + [(["a"],), (["b"],), (["d"],), (["e"],)], "items array<string>")
    got = {(tuple(r.antecedents), tuple(r.consequents)): r for r in stats.association_rules(baskets, baskets.limit(0)).collect()}
    r = got[("c",), ("a", "b")]
    assert (r.support, r.confidence, r.ctrl_support) == (pytest.approx(0.6), pytest.approx(1.0), 0.0) and r.lift == pytest.approx(1 / 0.6)


def test_text_columns(spark):
    body = "First sentence here. Second one follows! Third is cut. " + "x" * 200
    df = spark.createDataFrame([(body, "1. war\n- fear\n\n* panic", "a  b\t<c>가나!")], "body string, tags string, raw string")
    r = df.select(text.lead_sentences(F.col("body")).alias("a"), text.lead_cut(F.col("body")).alias("b"), text.tag_lines(F.col("tags")).alias("c"), text.normalize_text(F.col("raw")).alias("d")).first()
    assert r.a == "First sentence here. Second one follows!" and r.b == "First sentence here. Second one follows! Third is cut."
    assert r.c == ["war", "fear", "panic"] and r.d == "a b c가나!"
    dates = spark.createDataFrame([("20240131",), ("20240131.0",), ("2024-01-31",), ("x",), (None,)], "s string").select(text.iso_date(F.col("s")).alias("d")).collect()
    assert [r.d for r in dates] == [dt.date(2024, 1, 31)] * 3 + [None] * 2
    assert set(text.rename_headers(spark.createDataFrame([(1, 2, 3)], "`뉴스 식별자` int, `일자(발행)` int, other int")).columns) == {"article_id", "date", "other"}


def test_title_dedup_scopes(spark):
    rows = [(1, "e1", "the same twenty letters A"), (2, "e1", "the same twenty letters B"), (3, "e2", "the same twenty letters C"), (4, "e2", "other")]
    df = spark.createDataFrame(rows, "id int, ref_id string, title string")
    assert sorted(r.id for r in text.deduplicate_titles(df, "ref_id", "id").collect()) == [1, 4]
    assert sorted(r.id for r in text.deduplicate_titles(df, "ref_id", "id", scope="per_event").collect()) == [1, 3, 4]


def test_hdbscan_finds_blobs():
    rnd = np.random.default_rng(0)
    x = np.vstack([rnd.normal(c, 0.1, (30, 2)) for c in (0, 3, 6)] + [rnd.uniform(-20, 20, (5, 2))])
    labels = hdbscan(x, 10)
    assert [len(set(labels[k : k + 30])) for k in (0, 30, 60)] == [1, 1, 1] and len(set(labels[:90])) == 3 and (labels[90:] < 0).sum() >= 3
    assert silhouette(x[:90], labels[:90]) > 0.9
    assert set(hdbscan(x[:5], 10)) == {-1} and silhouette(x, np.zeros(95, int)) == 0
    assert (hdbscan(np.zeros((20, 2)), 5) >= -1).all()


def test_unit_root():
    rnd = np.random.default_rng(1)
    steps = rnd.normal(size=400)
    assert adf_pvalue(steps, 6) < 0.01 and adf_pvalue(np.cumsum(steps), 6) > 0.05 and adf_pvalue(np.ones(50), 6) == 1


def test_granger_direction(spark):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=200)
    y = np.concatenate([[0], 0.9 * x[:-1]]) + 0.1 * rnd.normal(size=200)
    rows = spark.createDataFrame([(f"{2000 + k // 12}-{k % 12 + 1:02d}", float(a), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))], "year_month string, x double, y double")
    got = {(r.risk_metric, r.social_indicator, r.lag): r.p_value for r in social.granger(rows, ["x", "y"], ["x", "y"]).collect()}
    assert got["x", "y", 1] < 1e-6 and got["y", "x", 1] > 0.01


def test_short_series_have_no_lags(spark):
    rows = spark.createDataFrame([(f"2020-{k:02d}", float(k), float(k * k)) for k in range(1, 10)], "year_month string, x double, y double")
    assert social.lagged(rows, "x", "y").count() == 0


def test_exact_mann_whitney(spark):
    """The tail over all orders, and small samples without ties by it, others by the normal tail."""
    from itertools import combinations

    for n1, n2 in ((1, 1), (2, 3), (3, 4), (4, 2)):
        us = [sum(a > b for a in some for b in set(range(n1 + n2)) - set(some)) for some in combinations(range(n1 + n2), n1)]
        tail = stats._u_tail(*sorted((n1, n2)))
        assert all(tail[u] == pytest.approx(np.mean([x >= u for x in us])) for u in range(n1 * n2 + 1))
    rows = [("a", 7, k, int(k > 4), k) for k in range(8)] + [("b", 7, k, int(k > 4), k // 2) for k in range(8)]
    got = {r.property_id: r.p_value for r in stats.frequency_tests(spark.createDataFrame(rows, "property_id string, window_days int, ref_id int, label int, freq int")).collect()}
    assert got["a"] == pytest.approx(1 / 56) and got["b"] != pytest.approx(1 / 56)


def test_price_file(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Date,Close ^KS11,Volume\n,^KS11,^KS11\n2024-01-03 00:00:00+09:00,2.5,1\n2024-01-02,2,1\n2024-01-04T00:00:00Z,,1\n")
    assert [tuple(r) for r in files.read_prices(spark, f"file://{tmp_path}/p.csv").collect()] == [(dt.date(2024, 1, 2), 2.0), (dt.date(2024, 1, 3), 2.5), (dt.date(2024, 1, 4), None)]
    (tmp_path / "q.csv").write_text("Date,Close\n")
    with pytest.raises(ValueError, match="no prices"):
        files.read_prices(spark, f"file://{tmp_path}/q.csv")
    (tmp_path / "r.csv").write_text("Date,Open\n2024-01-02,1\n")
    with pytest.raises(ValueError, match="lacks a close"):
        files.read_prices(spark, f"file://{tmp_path}/r.csv")


def test_dynamics_of_few_days(spark):
    rows = lambda n: spark.createDataFrame([(day(k), "p", 1.0 + k) for k in range(n)], "date date, property_id string, rate double")
    assert evaluator.dynamics(rows(1)).count() == 0
    r = evaluator.dynamics(rows(2)).first()
    assert (r.trend, r.velocity) == ("unknown", 1.0) and evaluator.dynamics(rows(3)).first().trend == "rising"


def trajectories(n: int, seed: int = 3) -> list[tuple[int, list[float]]]:
    """Paths of two shapes with noise, by turns."""
    rnd = np.random.default_rng(seed)
    shapes = ([0.1, 0.2, 0.1, 0.2, 0.9], [0.8, 0.7, 0.8, 0.6, 0.2])
    return [(k, [float(x + e) for x, e in zip(shapes[k % 2], rnd.normal(0, 0.03, 5), strict=True)]) for k in range(n)]


def plain_similarity(a, b, alpha):
    a, b = np.array(a), np.array(b)
    if len(a) < 2 or np.allclose(a, 0) or np.allclose(b, 0):
        return 0.0
    return round(float(alpha * (a @ b) / (np.linalg.norm(a) * np.linalg.norm(b)) + (1 - alpha) * (1 - min(np.linalg.norm(a - b) / np.sqrt(len(a)), 1))), 4)


def plain_best(path, types, alpha):
    tried = [(-plain_similarity(path[:n], c[:n], alpha), t, -n) for t, c in types.items() for n in (2, 3, 4, 5) if n <= len(path)]
    s, t, n = min(tried, default=(0.0, None, 0))
    return t, {-5: "D-0", -4: "D-7", -3: "D-14", -2: "D-21"}.get(n), -s


def plain_types(rows, size):
    x = np.array([p for _, p in rows])
    labels = hdbscan(x, size)
    return {f"type_{k}": x[labels == k].mean(axis=0) for k in sorted(set(labels.tolist()) - {-1})}, labels


def test_leave_one_out_by_a_plain_loop(spark):
    rows = trajectories(26)
    labels = plain_types(rows, 5)[1]
    frame = spark.createDataFrame([(i, p, int(v)) for (i, p), v in zip(rows, labels, strict=True)], "id int, path array<double>, label int")
    got = {r.id: r for r in trajectory.leave_one_out(frame, 5).collect()}
    for k, (i, p) in enumerate(rows):
        types = plain_types(rows[:k] + rows[k + 1 :], 5)[0]
        full, partial, r = plain_best(p, types, 0.7), plain_best(p[:3], types, 0.7), got[i]
        assert (r.full_type, r.full_similarity, r.partial_type, r.partial_phase, r.partial_similarity) == (full[0], pytest.approx(full[2], abs=1e-4), partial[0], partial[1], pytest.approx(partial[2], abs=1e-4))
        assert r.agrees == (full[0] == partial[0] is not None) and r.true_label == labels[k]
    few = trajectory.leave_one_out(frame.limit(4), 5).collect()
    assert all(r.full_type is None and r.partial_similarity == 0 and not r.agrees for r in few) and len(few) == 4


def test_time_split_and_its_skips(spark):
    frame = lambda rows: spark.createDataFrame([(i, p, day(i) if i else None) for i, p in rows], "id int, path array<double>, date date")
    rows = trajectories(40)
    cutoff = str(day(30))
    summary, matches = trajectory.time_split(frame(rows), cutoff, 5)
    types = plain_types(rows[1:30], 5)[0]
    want = {i: plain_best(p, types, 0.7) for i, p in rows[30:]}
    assert {r.id: (r.type_id, r.phase, r.similarity) for r in matches.collect()} == {i: (t, q, pytest.approx(v, abs=1e-4)) for i, (t, q, v) in want.items()}
    r = summary.first()
    assert (r.skipped, r.reason, r.n_train, r.n_test, r.n_train_clusters, r.matched_count) == (False, None, 29, 10, 2, 10) and r.mean_similarity == pytest.approx(np.mean([v for *_, v in want.values()]), abs=1e-4)
    for some, reason in ((rows[:6] + rows[32:], "insufficient_train_data"), ([r for r in rows[:30] if r[0] % 2] + rows[32:], "only_")):
        summary, matches = trajectory.time_split(frame(some), cutoff, 5)
        assert summary.first().skipped and summary.first().reason.startswith(reason) and summary.first().matched_count == matches.count() == 0


def test_cluster_sizes_need_two_clusters(spark):
    one = [(k, [float(x) for x in np.random.default_rng(k).normal(0, 0.01, 5)]) for k in range(12)] + [(99, [5.0] * 5)]
    tried = trajectory.search_cluster_sizes(spark.createDataFrame(one, "id int, path array<double>"), range(4, 6))
    assert all(r.silhouette == -1 for r in tried.collect() if r.n_clusters < 2) and tried.where("n_clusters < 2").count() > 0
    two = trajectory.search_cluster_sizes(spark.createDataFrame(trajectories(30), "id int, path array<double>"), range(4, 8))
    best = trajectory.best_cluster_size(two).first()
    assert best.n_clusters == 2 and best.silhouette == max(r.silhouette for r in two.collect())


@pytest.mark.parametrize(("centroid", "name"), [([0.1, 0.2], "unknown"), ([0.5, 0.55, 0.52, 0.5, 0.51], "flat"), ([0.1, 0.2, 0.5, 0.7, 0.9], "late-surge"), ([0.5, 0.4, 0.6, 0.8, 0.9], "gradual-build"), ([0.3, 0.35, 0.4, 0.42, 0.2], "plateau"), ([0.1, 0.35, 0.2, 0.5, 0.6], "accelerating"), ([0.9, 0.2, 0.6, 0.1, 0.3], "mixed")])
def test_shapes(spark, centroid, name):
    assert spark.createDataFrame([(centroid,)], "c array<double>").select(trajectory.shape_name(F.col("c"))).first()[0] == name


def test_next_match_is_the_runner_up(spark):
    path, types = spark.createDataFrame([(1, [0.2, 0.4, 0.6, 0.8, 1.0])], "id int, path array<double>"), spark.createDataFrame([("type_0", 0, [0.2, 0.4, 0.6, 0.8, 1.0]), ("type_1", 1, [1.0, 0.1, 0.9, 0.1, 0.2]), ("noise", -1, [0.0] * 5)], "type_id string, label int, centroid array<double>")
    found = trajectory.match(path, types)
    top = trajectory.top_matches(found).orderBy("rank").collect()
    assert [(r.type_id, r.phase) for r in top[:4]] == [("type_0", q) for q in ("D-0", "D-7", "D-14", "D-21")] and len(top) == 8 and top[0].next_phase == "D-7" and top[7].next_type_id is None
    limits = spark.createDataFrame([(0.9, 0.01)], "threshold double, margin double")
    assert trajectory.confidence(found, limits).first().confidence == "uncertain"  # the same type's next phase is as near


def test_ols_recovers_a_plane(spark):
    rnd = np.random.default_rng(5)
    rows = spark.createDataFrame([(float(a), float(b), float(2 + 3 * a - b)) for a, b in rnd.normal(size=(50, 2))], "a double, b double, y double")
    got = {r.name: r.value for r in social.ols(rows, ["a", "b"], "y").collect()}
    assert (got["intercept"], got["a"], got["b"], got["r2"]) == tuple(pytest.approx(v) for v in (2, 3, -1, 1))
    assert social.ols(rows.limit(0), ["a"], "y").count() == 0


def test_strategies():
    s = np.array([0, 6, 8, 4, 1, 20, 20, 9, 9, 0], float)
    assert backtest.risk_off(10)(s)[0] == [1, 1, 1, 1, 1, 0, 0, 1, 1, 1]
    assert backtest.contrarian(18.52, 2, -2.0)(s) == ([0, 0, 0, 0, 0, 1, 1, 0, 0, 0], [1.0] * 5 + [-2.0, -2.0] + [1.0] * 3)
    assert backtest.buy_the_dip(hold=2)(s)[0] == [0, 0, 0, 1, 1, 0, 0, 1, 1, 1]
    # worked by hand: the last row held starts a new peak at its score
    assert backtest.buy_the_dip(hold=2)(np.array([20, 8, 40, 15, 15], float))[0] == [0, 1, 1, 1, 1]
    assert backtest.hold_with_dip(hold=2)(np.array([20, 8, 40, 15, 15], float)) == ([1] * 5, [1.0, 2.0, 2.0, 2.0, 2.0])
    # long from the row after the switch, for two rows
    assert backtest.inverse_then_leverage(18.52, 2)(np.array([20, 30, 14, 10, 10, 10, 10], float)) == ([1, 1, 1, 1, 1, 0, 0], [-2.0, -2.0, -2.0, 2.0, 2.0, 1.0, 1.0])
    plan = backtest.Tranches(hold=4)
    assert plan.signals(s, np.array([9, 9, 9, 9, 9, 10, 9.4, 9.3, 8.8, 8.0])) == (["", "", "", "", "", "entry", "add", "", "add", "exit"], [0, 0, 0, 0, 0, 1, 1, 1, 1, 1])


def test_equity_dies_at_zero(spark):
    rows = [("s", day(0), 1.0, None, 1.0, 2.0), ("s", day(1), 1.0, 0.1, 1.0, 2.0), ("s", day(2), 1.0, -0.6, 1.0, 2.0), ("s", day(3), 1.0, 0.5, 1.0, 2.0)]
    got = [r.asset for r in backtest.equity(spark.createDataFrame(rows, "strategy string, date date, close double, ret double, position double, leverage double"), 100.0, 0.0).orderBy("date").collect()]
    assert got == [pytest.approx(v) for v in (100.0, 120.0, 0.0, 0.0)]


def test_dca_by_hand(spark):
    """1,000 in two parts, commission of a tenth: 500 bought for 550, then 50 per cent on it twice over, then 409.09 more."""
    rows = [(day(0), 10.0, 0.0, None), (day(1), 10.0, 20.0, 0.0), (day(2), 10.0, 0.0, 0.25), (day(3), 9.0, 0.0, 0.0), (day(4), 9.0, 0.0, 0.5), (day(5), 9.0, 0.0, 0.0)]
    got = backtest.dca(spark.createDataFrame(rows, "date date, close double, risk_score double, ret double"), {"p": backtest.Tranches(n=2, hold=3)}, 1000.0, 0.1).orderBy("date").collect()
    assert [(r.signal, r.position, r.leverage) for r in got] == [("", 0, 1), ("entry", 1, 2), ("", 1, 2), ("add", 1, 2), ("exit", 1, 2), ("", 0, 1)]
    added = 450 / 1.1
    assert [r.asset for r in got] == [pytest.approx(v) for v in (1000, 950, 450 + 750, 750 + added, (750 + added) * 0.9, (750 + added) * 0.9)]


def test_metrics_by_hand(spark):
    """Returns on the seed, buys and sells without the first day's, and the share of round trips won."""
    placed = [(1, 990.0), (1, 1000.0), (0, 1000.0), (1, 1000.0), (1, 1200.0), (0, 1200.0), (1, 1100.0), (0, 1000.0), (1, 1000.0)]
    rows = [("s", day(k), float(p), a) for k, (p, a) in enumerate(placed)]
    assets = spark.createDataFrame(rows, "strategy string, date date, position double, asset double")
    m = backtest.metrics(assets, seed=1000.0).first()
    assert (m.n_trades, m.win_rate_pct, m.total_return_pct) == (6, 50.0, pytest.approx(0.0)) and m.mdd_pct == pytest.approx(-100 / 6)
    assert [(r.entry_date, r.exit_date, r.won) for r in backtest.round_trips(assets).orderBy("entry_date").collect()] == [(day(3), day(5), True), (day(6), day(7), False), (day(8), None, None)]


def test_checks(spark):
    bad = spark.createDataFrame([(day(0), 1.0), (day(0), None), (day(20), -1.0)], "date date, close double")
    report = checks.check_prices(bad, "2024-01-01", "2024-01-22")
    assert {(r.check, r.severity) for r in report.collect()} == {("trading_gaps", "WARNING"), ("missing_close", "CRITICAL"), ("repeated_dates", "WARNING"), ("nonpositive_close", "CRITICAL"), ("few_rows", "CRITICAL")}
    assert not checks.passed(report).first().passed
    with pytest.raises(ValueError, match="few_rows"):
        checks.require(report)
    checks.require(report.limit(0))
    assert [r.check for r in checks.stale_outputs(spark, {"a": True, "b": False}).collect()] == ["a"]


def test_encoder_halves_its_batch(spark):
    def encoder(texts):
        if len(texts) > 20:
            raise MemoryError
        return tagging.hashing_encoder(texts)

    rows = spark.range(100).select(F.col("id").alias("article_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    assert tagging.encode(rows, encoder).count() == 100


def test_sample_refills(spark):
    rows = spark.createDataFrame([(k, day(k % 50 if k % 2 else 5), k % 2) for k in range(400)], "article_id int, date date, label int")
    got = dictionary.stratified_sample(rows, 100).groupBy("label").count().collect()
    assert {(r.label, r["count"]) for r in got} == {(0, 50), (1, 50)}


def workbook(path, rows):
    cell = lambda v, c, r: f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' if v is not None else ""
    body = "".join(f'<row r="{r}">' + "".join(cell(v, c, r) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("제목,일자\n하나,20240101\n".encode("cp949"))
    (tmp_path / "b.csv").write_bytes("제목,일자\n둘,20240102\n".encode("utf-8-sig"))
    (tmp_path / "empty.csv").write_bytes(b"")
    assert sorted((r["제목"], r["file"]) for r in files.read_csv_any(spark, f"file://{tmp_path}", ["제목", "일자", "없음"]).collect()) == [("둘", "b.csv"), ("하나", "a.csv")]
    workbook(tmp_path / "x.xlsx", [["title", "date"], ["one", None], [None, "2"]])
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    assert sorted(map(str, (tuple(r) for r in files.read_xlsx(spark, f"file://{tmp_path}", ["date", "title"]).collect()))) == sorted(map(str, [(None, "one", "x.xlsx"), ("2", None, "x.xlsx")]))
    assert files.read_or_empty(spark, f"file://{tmp_path}/none.csv", "a int").count() == 0
    (tmp_path / "log").mkdir()
    (tmp_path / "log/a.jsonl").write_text('{"k": 1}\nbroken\n{"k": 2}\n')
    assert sorted((r.k, r.file) for r in files.read_jsonl(spark, f"file://{tmp_path}/log", "k int").collect()) == [(1, "a.jsonl"), (2, "a.jsonl")]
    calls = []
    fetch = lambda: calls.append(1) or spark.range(3)
    assert [files.read_through(spark, f"file://{tmp_path}/cache", fetch, r).count() for r in (False, False, True)] == [3, 3, 3] and len(calls) == 2
    with pytest.raises(ValueError, match="value"):
        (tmp_path / "m.csv").write_text("year_month,x\n2020-01,1\n")
        files.manual_indicator(spark, f"file://{tmp_path}/m.csv")


def test_sinks(spark, tmp_path):
    path, rows = f"file://{tmp_path}/days", spark.createDataFrame([(day(0), 1), (day(1), 2)], "date date, v int")
    sinks.write_days(rows, path)
    sinks.write_days(rows.withColumn("v", F.lit(9)).unionByName(spark.createDataFrame([(day(2), 3)], "date date, v int")), path)
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1, 2, 3]
    sinks.append_jsonl(rows, f"file://{tmp_path}/log")
    sinks.append_jsonl(rows, f"file://{tmp_path}/log")
    assert files.read_jsonl(spark, f"file://{tmp_path}/log", "v int").count() == 4
    assert sinks.markdown("T", rows.orderBy("date")).startswith("# T\n\n| date | v |")
    sinks.write_csv(rows, f"file://{tmp_path}/csv")
    assert files.read_or_empty(spark, f"file://{tmp_path}/csv", "date date, v int").count() == 2


def landed(spark, tmp_path, n=40):
    rows = spark.range(n).select((F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=(F.col("id") * 7).cast("int"))).alias("ts"), F.array(F.lit("all"), F.concat(F.lit("p"), (F.col("id") % 2).cast("string"))).alias("properties"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    return rows


def test_stream_counts_are_the_batch(spark, tmp_path):
    rows = landed(spark, tmp_path)
    q = stream.daily_counts(stream.landing(spark, f"{tmp_path}/in", rows.schema)).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = windows.daily_counts(rows.withColumn("date", F.to_date("ts")))
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, want.collect()))


def test_stream_windows_and_sessions(spark, tmp_path):
    rows = landed(spark, tmp_path)
    q = stream.trailing_counts(stream.landing(spark, f"{tmp_path}/in", rows.schema), 3).writeStream.format("memory").queryName("trail").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    daily = windows.daily_counts(rows.withColumn("date", F.to_date("ts")))
    refs = daily.select(F.col("date").cast("string").alias("ref_id"), F.col("date").alias("ref_date")).distinct()
    want = {(r.ref_id, r.property_id): r.freq for r in windows.window_frequencies(daily, refs, (3,)).collect()}
    got = {(str(r.ref_date), r.property_id): r.freq for r in spark.table("trail").collect()}
    assert {k: v for k, v in got.items() if k in want} == want
    shocks = spark.createDataFrame([(f"2024-01-{d:02d}",) for d in (1, 6, 12)], "s string").select(F.lit("x").alias("series"), F.col("s").cast("timestamp").alias("ts"))
    shocks.coalesce(1).write.parquet(f"{tmp_path}/shocks")
    q = stream.shock_sessions(stream.landing(spark, f"{tmp_path}/shocks", shocks.schema), 5).writeStream.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.first_shock_date.day, r.last_shock_date.day, r.shock_count) for r in spark.table("sessions").collect()) == [(1, 6, 2), (12, 12, 1)]


def test_stream_upsert(spark, tmp_path):
    one = spark.createDataFrame([(day(0), 1.0), (day(1), 2.0)], "date date, risk_score double")
    one.coalesce(1).write.parquet(f"{tmp_path}/in")
    read = lambda: stream.landing(spark, f"{tmp_path}/in", one.schema)
    stream.upsert_into(read(), f"{tmp_path}/table", f"{tmp_path}/ck", "date").awaitTermination()
    spark.createDataFrame([(day(1), 9.0)], "date date, risk_score double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream.upsert_into(read(), f"{tmp_path}/table", f"{tmp_path}/ck", "date").awaitTermination()
    assert sorted((r.date, r.risk_score) for r in spark.read.parquet(f"{tmp_path}/table/v1").collect()) == [(day(0), 1.0), (day(1), 9.0)]


def test_stream_streaks(spark, tmp_path):
    for n, scores in enumerate(((20.0, 5.0, 30.0), (40.0, 1.0))):
        start = 3 * n
        spark.createDataFrame([("s", day(start + k), x) for k, x in enumerate(scores)], "series string, date date, risk_score double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = stream.warning_streaks(stream.landing(spark, f"{tmp_path}/in", "series string, date date, risk_score double"), 18.52)
        stream.run_once(q, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert [r.streak for r in spark.read.parquet(f"{tmp_path}/out").orderBy("date").collect()] == [1, 0, 1, 2, 0]


def test_no_cartesian_product_on_articles(spark):
    from shockwire.plans.catalog_events import refs

    sf = "/root/testdata/sf0.001"
    joined = windows.match_articles(standins.tagged(spark, sf), refs(spark, sf), 7)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    scan = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_shipdate >= timestamp'1995-01-01'").select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate)" in scan

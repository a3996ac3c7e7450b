"""Association rules and basket counts against plain loops."""

import random
from itertools import combinations

import pytest

from shockwire.operators import stats


def baskets_of(spark, sets):
    return spark.createDataFrame([(sorted(s),) for s in sets], "items array<string>")


def test_basket_counts_by_a_plain_loop(spark):
    rnd = random.Random(1)
    baskets = [set(rnd.choices("abcdefg", k=rnd.randint(0, 6))) for _ in range(300)] + [set()]
    asked = [c for k in (1, 2, 3) for c in combinations("abcdefgz", k)]
    df = spark.createDataFrame([(sorted(b) * 2,) for b in baskets], "items array<string>").repartition(5)  # repeated items count once
    got = {tuple(r["items"]): r["n"] for r in stats.basket_counts(df, spark.createDataFrame([(list(a),) for a in asked], "items array<string>")).collect()}
    assert got == {a: n for a in asked if (n := sum(set(a) <= b for b in baskets))}
    assert stats.basket_counts(df.limit(0), spark.createDataFrame([(["a"],)], "items array<string>")).count() == 0


def test_counts_over_many_bitmaps(spark):
    df = spark.range(0, 200_000, 1, 2).selectExpr("case when id % 3 = 0 then array('a', 'b') when id % 3 = 1 then array('b') else array('a') end as items")
    got = {tuple(r["items"]): r["n"] for r in stats.basket_counts(df, spark.createDataFrame([(["a", "b"],), (["a"],), (["b"],)], "items array<string>")).collect()}
    assert got == {("a", "b"): 66_667, ("a",): 133_333, ("b",): 133_334}


def test_rules_by_a_plain_loop(spark):
    rnd = random.Random(2)
    draw = lambda: {x for x, p in (("a", 0.7), ("b", 0.6), ("c", 0.5), ("d", 0.3), ("e", 0.2)) if rnd.random() < p} | ({"b"} if rnd.random() < 0.3 else set())
    events, controls = [draw() or {"a"} for _ in range(80)], [draw() for _ in range(50)]
    support = lambda s, rows: sum(s <= b for b in rows) / len(rows)
    want = {}
    for k in (2, 3, 4, 5):
        for items in map(set, combinations("abcde", k)):
            if (s := support(items, events)) >= 0.1:
                for m in range(1, k):
                    for left in map(set, combinations(sorted(items), m)):
                        c = s / support(left, events)
                        if c >= 0.5 and (lift := c / support(items - left, events)) >= 1.02:
                            want[tuple(sorted(left)), tuple(sorted(items - left))] = tuple(map(pytest.approx, (s, c, lift, support(items, controls))))
    rules = stats.association_rules(baskets_of(spark, events), baskets_of(spark, controls), 0.1, 0.5, 1.02)
    got = {(tuple(r.antecedents), tuple(r.consequents)): (r.support, r.confidence, r.lift, r.ctrl_support) for r in rules.collect()}
    assert len(want) > 5 and got == want
    plan = rules._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r.ctrl_support for r in stats.association_rules(baskets_of(spark, events), baskets_of(spark, controls).limit(0), 0.1, 0.5, 1.02).collect()} == {0.0}

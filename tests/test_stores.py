"""The evaluator's stores."""

from shockwire.sources import stores


def test_stores(spark, tmp_path):
    path = f"file://{tmp_path}/evaluator"
    assert stores.insights(spark, path).count() == 0 and stores.judgments(spark, path).count() == 0 and stores.load_text(spark, path, "memory") == ""
    insight = lambda o, t=None: spark.createDataFrame([(t, "pattern", ["P1"], o, {"P1_rate": ">10"}, 0.7, "two days", None)], stores.INSIGHT)
    stores.add_insights(insight("one", "2026-03-07T14:30:00"), path, "2026-03-07")
    stores.add_insights(insight("두 번째"), path, "2026-03-07")
    stores.add_insights(insight("three"), path, "2026-03-08")
    assert {(r.date, r.observation) for r in stores.insights(spark, path).collect()} == {("2026-03-07", "one"), ("2026-03-07", "두 번째"), ("2026-03-08", "three")}
    of_day = {r.observation: r.timestamp for r in stores.insights(spark, path, "2026-03-07").collect()}
    assert of_day["one"] == "2026-03-07T14:30:00" and len(of_day["두 번째"]) == 19
    judged = spark.createDataFrame([("2026-03-06", "scoring", "too low", ["P1"], "underweight", 0.6, True)], stores.JUDGMENT.removesuffix(", timestamp string"))
    stores.add_judgments(judged, path)
    stores.add_judgments(judged, path)
    assert [(r.verdict, r.revisable, bool(r.timestamp)) for r in stores.judgments(spark, path).collect()] == [("underweight", True, True)] * 2
    for text in ("first", "second\nwith lines"):
        stores.save_text(spark, path, "memory", text)
        stores.save_text(spark, path, "sessions", f"session {text}", "2026-03-07")
    assert stores.load_text(spark, path, "memory") == "second\nwith lines" and stores.load_text(spark, path, "sessions", "2026-03-07") == "session second\nwith lines"
    assert stores.load_text(spark, path, "sessions", "2026-03-08") == ""


def test_a_job_takes_up_where_it_stopped(spark, tmp_path):
    path = f"file://{tmp_path}/jobs"
    assert stores.load_state(spark, path, "convert") == {}
    for done in (["a.xlsx"], ["a.xlsx", "나.xlsx"]):
        stores.save_state(spark, path, "convert", {"done": done, "end": None})
    stores.save_state(spark, path, "download", {"from": "2024-01-01"})
    assert stores.load_state(spark, path, "convert") == {"done": ["a.xlsx", "나.xlsx"], "end": None}

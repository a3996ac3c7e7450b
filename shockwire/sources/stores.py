"""What the evaluator keeps (insights by date, judgments, its memory and sessions by date), and where a job stopped.

Insights and judgments are JSON lines that are appended to, so two writers do not lose each other's; memory and sessions are texts of
which the newest version counts. All of them lie under one path, on any file system that Spark writes.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shockwire.sources.files import exists

INSIGHT = "timestamp string, type string, properties array<string>, observation string, conditions map<string,string>, confidence double, basis string, prior_ref string"
JUDGMENT = "target_date string, type string, assessment string, properties_evaluated array<string>, verdict string, confidence double, revisable boolean, timestamp string"
_TEXT = "name string, version long, content string"


def _stamped(rows: DataFrame) -> DataFrame:
    """rows with the time of writing where they bring none."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    return rows.withColumn("timestamp", F.coalesce("timestamp", now) if "timestamp" in rows.columns else now)


def add_insights(rows: DataFrame, path: str, date: str) -> None:
    _stamped(rows).write.mode("append").json(f"{path}/insights/date={date}")


def insights(spark: SparkSession, path: str, date: str | None = None) -> DataFrame:
    """Insights of a date, or of all, with their date; none where none were written."""
    if not exists(spark, f"{path}/insights"):
        return spark.createDataFrame([], f"{INSIGHT}, date string")
    rows = spark.read.schema(f"{INSIGHT}, date string").json(f"{path}/insights")
    return rows.where(F.col("date") == date) if date else rows


def add_judgments(rows: DataFrame, path: str) -> None:
    _stamped(rows).write.mode("append").json(f"{path}/judgments")


def judgments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(JUDGMENT).json(f"{path}/judgments") if exists(spark, f"{path}/judgments") else spark.createDataFrame([], JUDGMENT)


def save_text(spark: SparkSession, path: str, kind: str, content: str, name: str = "") -> None:
    """A new version of a text: kind `memory`, or `sessions` with the date as its name."""
    version = (_newest(spark, path, kind, name) or (0, ""))[0] + 1
    spark.createDataFrame([(name, version, content)], _TEXT).coalesce(1).write.mode("append").parquet(f"{path}/{kind}")


def load_text(spark: SparkSession, path: str, kind: str, name: str = "") -> str:
    """The newest version of a text; empty where there is none."""
    return (_newest(spark, path, kind, name) or (0, ""))[1]


def save_state(spark: SparkSession, path: str, job: str, state: dict) -> None:
    """Where a job stands, as JSON: the files it has done, the dates it chose."""
    save_text(spark, path, "state", json.dumps(state, ensure_ascii=False, sort_keys=True), job)


def load_state(spark: SparkSession, path: str, job: str) -> dict:
    """The newest state of a job; empty at its start."""
    return json.loads(load_text(spark, path, "state", job) or "{}")


def _newest(spark: SparkSession, path: str, kind: str, name: str) -> tuple[int, str] | None:
    if not exists(spark, f"{path}/{kind}"):
        return None
    rows = spark.read.schema(_TEXT).parquet(f"{path}/{kind}").where(F.col("name") == name)
    found = rows.agg(F.max_by(F.struct("version", "content"), "version").alias("x")).first()["x"]
    return (found["version"], found["content"]) if found else None

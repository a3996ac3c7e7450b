"""The daily increment as Structured Streaming: a landing folder, counts, windows, sessions and an upserted score table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from shockwire.sources.files import exists
from shockwire.sources.sinks import upsert


def landing(spark: SparkSession, folder: str, schema: StructType | str, per_trigger: int | None = None) -> DataFrame:
    """Parquet files as they land; the checkpoint remembers which were taken."""
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def daily_counts(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """(date, property_id, cnt) of rows (ts, properties); a day is final when the watermark has passed it."""
    rows = stream.withWatermark("ts", late).select("ts", F.explode("properties").alias("property_id"))
    return rows.groupBy(F.window("ts", "1 day"), "property_id").agg(F.count(F.lit(1)).alias("cnt")).select(F.to_date("window.start").alias("date"), "property_id", "cnt")


def trailing_counts(stream: DataFrame, days: int, late: str = "2 days") -> DataFrame:
    """(ref_date, property_id, freq): sums of the `days` days before ref_date, by sliding windows."""
    rows = stream.withWatermark("ts", late).select("ts", F.explode("properties").alias("property_id"))
    return rows.groupBy(F.window("ts", f"{days} days", "1 day"), "property_id").agg(F.count(F.lit(1)).alias("freq")).select(F.to_date("window.end").alias("ref_date"), "property_id", "freq")


def shock_sessions(shocks: DataFrame, gap_days: int, late: str = "10 days") -> DataFrame:
    """(series, first_shock_date, last_shock_date, shock_count) of shock days (series, ts); a gap of exactly gap_days still
    joins. Session windows on a stream need a key, so each price series has its name."""
    s = F.session_window("ts", f"{gap_days} days")
    found = shocks.withWatermark("ts", late).groupBy("series", s).agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count(F.lit(1)).alias("shock_count"))
    return found.select("series", F.to_date("a").alias("first_shock_date"), F.to_date("b").alias("last_shock_date"), "shock_count")


def warning_streaks(scores: DataFrame, threshold: float) -> DataFrame:
    """(series, date, streak): length of the run of days at or above the threshold, kept as state. Rows: series, date,
    risk_score; days of a series come in order within and across batches."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = state.get[0] if state.exists else 0
        out = []
        for row in pd.concat(list(frames)).sort_values("date").itertuples():
            run = run + 1 if row.risk_score >= threshold else 0
            out.append((key[0], row.date, run))
        state.update((run,))
        yield pd.DataFrame(out, columns=["series", "date", "streak"])

    return scores.groupBy("series").applyInPandasWithState(step, "series string, date date, streak int", "run int", "append", GroupStateTimeout.NoTimeout)


def upsert_into(stream: DataFrame, table: str, checkpoint: str, *keys: str) -> StreamingQuery:
    """K5 on a stream: each batch replaces its keys' rows of the Parquet table. Versions alternate between two folders, and
    the newer complete one is current, so that a failed batch can be repeated."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now, before = f"{table}/v{batch_id % 2}", f"{table}/v{(batch_id + 1) % 2}"
        rows = upsert(spark.read.parquet(before), batch, *keys) if exists(spark, f"{before}/_SUCCESS") else batch
        rows.write.mode("overwrite").parquet(now)

    return stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_once(frame: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything that has landed, appended to a Parquet table; then it ends."""
    return frame.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

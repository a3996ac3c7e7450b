"""Readers of the analysis's files."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shockwire.sources.tables import read_tables


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on any file system that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A CSV with a header, or no rows where it is missing; rows that can't be read are dropped."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.csv(path, header=True, schema=schema, mode="DROPMALFORMED")


def read_csv_any(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The columns of every CSV under path, in whichever encoding it has; see `tables`."""
    return read_tables(spark, path, columns, "*.csv")


def read_xlsx(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """S3: the columns of the first sheet of every workbook under path; see `tables`."""
    return read_tables(spark, path, columns, "*.xlsx")


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines of one file or of a folder, with the file's name; lines that can't be read are dropped."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema).withColumn("file", F.lit(None).cast("string"))
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).withColumn("file", F.col("_metadata.file_name"))


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON document, or an array of them."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """Date and close of a price file as vendors give it, sorted by date: a CSV whose header may name the ticker after
    each field (Close^KS11, Close.1), with or without a line of tickers under it, dates with or without a time zone. Rows
    without a date go; a file without rows raises."""
    df = spark.read.csv(path, header=True)
    field = lambda name: next((c for c in df.columns if re.match(rf"{name}\b", c, re.I)), None)
    day, close = field("date"), field("close")
    if day is None or close is None:
        raise ValueError(f"{path} lacks {'a date' if day is None else 'a close'}")
    local = F.regexp_extract(F.col(f"`{day}`"), r"^\s*(\d{4}-\d{2}-\d{2})", 1)  # the day as written: a time zone is dropped, not converted
    rows = df.select(F.try_to_date(F.nullif(local, F.lit(""))).alias("date"), F.expr(f"try_cast(`{close}` as double)").alias("close")).where("date is not null")
    if rows.isEmpty():
        raise ValueError(f"{path} has no prices")
    return rows.orderBy("date")


def manual_indicator(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with year_month and value, or an error that says what it lacks."""
    df = spark.read.csv(path, header=True)
    if missing := {"year_month", "value"} - set(df.columns):
        raise ValueError(f"{path} lacks {', '.join(sorted(missing))}")
    return df.select("year_month", F.col("value").cast("double").alias("value"))


class MissingKey(ValueError):
    """A service's key is not configured."""


def read_through(spark: SparkSession, cache: str, fetch: Callable[[], DataFrame], refresh: bool = False, schema: StructType | str | None = None) -> DataFrame:
    """The Parquet table at `cache`; where it is missing, or on refresh, what fetch() gives is written there first, unless that
    is empty. Where fetch() raises MissingKey, an older table stands in; without one there are no rows of `schema`, or the
    error where none is given."""
    if refresh or not exists(spark, cache):
        try:
            found = fetch()
        except MissingKey:
            if exists(spark, cache):
                return spark.read.parquet(cache)
            if schema is None:
                raise
            return spark.createDataFrame([], schema)
        if found.isEmpty():
            return found
        found.write.mode("overwrite").parquet(cache)
    return spark.read.parquet(cache)


def months(spark: SparkSession, start: str, end: str) -> DataFrame:
    """year_month, first and last day of each month of a span, cut at its ends."""
    span = spark.sql(f"select explode(sequence(trunc(date'{start}', 'MM'), date'{end}', interval 1 month)) as m")
    return span.select(F.date_format("m", "yyyy-MM").alias("year_month"), F.greatest("m", F.lit(start).cast("date")).alias("first_day"), F.least(F.last_day("m"), F.lit(end).cast("date")).alias("last_day"))


def days(spark: SparkSession, start: str, end: str) -> DataFrame:
    """S21."""
    return spark.sql(f"select explode(sequence(date'{start}', date'{end}')) as date")


def date_range(df: DataFrame) -> DataFrame:
    """First, last and number of distinct dates."""
    return df.agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count_distinct("date").alias("n_dates"))

"""K5 on a stream: a table of date partitions under a manifest, where a batch rewrites the dates it touches and no others.

`data/batch=N/date=D` holds what batch N made of date D; `manifest/batch=N` names the dates that batch N made. The newest batch that
the manifest names for a date is its current version. Data are written before the manifest, so a batch that fails in between
leaves the table as it was, and a batch that comes again after its manifest is there changes nothing. Bytes written follow the
touched dates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from shockwire.sources.files import exists
from shockwire.sources.sinks import upsert

_MANIFEST = "date date, batch long"


def manifest(spark: SparkSession, table: str) -> DataFrame:
    """date, batch: the current version of each date."""
    if not exists(spark, f"{table}/manifest"):
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).parquet(f"{table}/manifest").groupBy("date").agg(F.max("batch").alias("batch"))


def read(spark: SparkSession, table: str, schema: StructType) -> DataFrame:
    """The table's current rows: partitions the manifest doesn't name are pruned."""
    if not exists(spark, f"{table}/data"):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(StructType([*schema.fields]).add("batch", "long")).parquet(f"{table}/data")
    now = manifest(spark, table).select(F.col("date").alias("_date"), F.col("batch").alias("_batch"))
    same = F.col("date").eqNullSafe(F.col("_date")) & (F.col("batch") == F.col("_batch"))
    return rows.join(F.broadcast(now), same, "left_semi").select(*schema.names)  # a row a date


def write_batch(batch: DataFrame, batch_id: int, table: str, *keys: str) -> int:
    """Upserts a batch by keys (date among them) as version batch_id; returns the number of dates written, 0 for a batch that is
    there already."""
    spark = batch.sparkSession
    if "date" not in keys:
        raise ValueError("the keys of a table of date partitions have to name date")
    if exists(spark, f"{table}/manifest/batch={batch_id}/_SUCCESS"):
        return 0
    now = {r["date"]: r["batch"] for r in manifest(spark, table).collect()}  # dates
    touched = [r["date"] for r in batch.select("date").distinct().collect()]
    if not touched:
        return 0
    paths = [f"{table}/data/batch={now[d]}/date={'__HIVE_DEFAULT_PARTITION__' if d is None else d}" for d in touched if d in now]
    schema = batch.schema
    before = spark.read.schema(schema).option("basePath", f"{table}/data/").parquet(*paths) if paths else spark.createDataFrame([], schema)
    rows = upsert(before, batch, *keys)
    rows.repartition("date").write.mode("overwrite").option("compression", "zstd").partitionBy("date").parquet(f"{table}/data/batch={batch_id}")
    spark.createDataFrame([(d,) for d in touched], "date date").coalesce(1).write.mode("overwrite").parquet(f"{table}/manifest/batch={batch_id}")
    return len(touched)


def upsert_dates(stream: DataFrame, table: str, checkpoint: str, *keys: str) -> StreamingQuery:
    """K5 on a stream: see `write_batch`."""
    write = lambda batch, batch_id: write_batch(batch, batch_id, table, *keys) and None
    return stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Helpers that the operators of this package share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """The column as text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, one machine's own folder does; a cluster needs the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = "file:///tmp/checkpoints"
    return folder.rstrip("/")


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder or file as Spark names it, and its path there."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", path)))


def fresh(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as it takes to be none of df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def packed(df: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep`, and all others in one struct `_row`, so that no name can clash with an operator's own."""
    others = [c for c in df.columns if c not in keep]
    return df.select(*keep, (F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None).cast("string")).alias("_row"))


def unpacked(df: DataFrame, names: list[str], *keep: str) -> DataFrame:
    """The columns `names` again, those in `keep` from df and the others from its `_row`."""
    return df.select(*[F.col(f"`{c}`") if c in keep else F.col("_row").getField(c).alias(c) for c in names])


def cut(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: a lost executor costs nothing before this point."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch; Spark's own default stands for several hundred MB in an executor, on both sides of the pipe.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, once its session's Arrow batches are bounded by BATCH_BYTES (unless the session has a bound of its own)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key) in ("67108864b", "67108864"):
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, rows: int = 512) -> DataFrame:
    """Runs make() once a task, and what it returns on slices of at most `rows` rows, so that a task's memory
    follows one slice and not Arrow's batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield f(batch.slice(at, rows))

    return small_batches(df).mapInArrow(run, schema)

"""What a table's dates span, from its Parquet footers.

Files are listed by Spark and their footers read in tasks, so that the bytes read follow the number of files and row groups and
not the rows. Row groups without statistics, and files on file systems that tasks can't open by themselves, are read by a scan of
their date column.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from zoneinfo import ZoneInfo

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shockwire.sources.shared import file_system

#: Row groups of a tail scan.
TAIL = 20
_GROUPS = "path string, row_group int, n_rows long, first_date date, last_date date, footer_bytes long, known boolean"


def as_date(value: object, zone: str) -> dt.date | None:
    """A statistic as a date: dates, timestamps (those in UTC as days of the zone) and text that begins with one."""
    if isinstance(value, bytes):
        value = value.decode("utf-8", "replace")
    if isinstance(value, str):
        try:
            return dt.date.fromisoformat(value[:10])
        except ValueError:
            return None
    if isinstance(value, dt.datetime):
        return (value.astimezone(ZoneInfo(zone)) if value.tzinfo else value).date()
    return value if isinstance(value, dt.date) else None


def row_groups(spark: SparkSession, path: str, column: str = "date") -> DataFrame:
    """path, row_group, n_rows, first_date, last_date, footer_bytes, known of every row group of the Parquet files under path;
    known is false where its dates have to be read (row_group -1: the whole file). A row group of nulls alone has no dates
    and is known."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    paths = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).select("path")

    def of(file: str) -> Iterator[tuple]:
        try:
            system, name = file_system(file)
        except pa.ArrowInvalid:  # a file system that only Spark knows
            yield file, -1, None, None, None, 0, False
            return
        with system.open_input_file(name) as f:
            footer = pq.read_metadata(f)
        at = footer.schema.to_arrow_schema().names.index(column) if column in footer.schema.to_arrow_schema().names else -1
        leaf = next((k for k in range(footer.num_columns) if footer.schema.column(k).path == column), None)
        for g in range(footer.num_row_groups):
            group = footer.row_group(g)
            stats = group.column(leaf).statistics if leaf is not None and at >= 0 else None
            first, last = (as_date(stats.min, zone), as_date(stats.max, zone)) if stats is not None and stats.has_min_max else (None, None)
            empty = group.num_rows == 0 or (stats is not None and stats.has_null_count and stats.null_count == group.num_rows)
            yield file, g, group.num_rows, first, last, footer.serialized_size if g == 0 else 0, bool(empty or (first and last))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for file in batch.column(0).to_pylist() for r in of(file)]
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.date32(), pa.date32(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[c.split()[0] for c in _GROUPS.split(", ")])

    return paths.mapInArrow(run, _GROUPS)


def _scan(spark: SparkSession, groups: DataFrame, column: str) -> DataFrame | None:
    """The dates of files whose footers do not tell them; None where all do."""
    files = [r[0] for r in groups.where("not known").select("path").distinct().collect()]  # names of such files alone
    return spark.read.parquet(*files).select(F.col(column).cast("date").alias("date")).where("date is not null") if files else None


def date_range(spark: SparkSession, path: str, column: str = "date") -> DataFrame:
    """first_date and last_date of the table's rows; both null where it has none."""
    groups = row_groups(spark, path, column)
    spans = groups.where("known").select("first_date", "last_date")
    if (rest := _scan(spark, groups, column)) is not None:
        spans = spans.unionByName(rest.agg(F.min("date").alias("first_date"), F.max("date").alias("last_date")))
    return spans.agg(F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"))


def tail_dates(spark: SparkSession, path: str, column: str = "date", n: int = TAIL) -> DataFrame:
    """The distinct dates of the last `n` row groups, by their latest date, then by path and place; only these row groups'
    date columns are read. Files without statistics are read whole."""
    groups = row_groups(spark, path, column)
    last = groups.where("known and last_date is not null").orderBy(F.desc("last_date"), F.desc("path"), F.desc("row_group")).limit(n).select("path", "row_group")
    zone = spark.conf.get("spark.sql.session.timeZone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, group in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                system, name = file_system(file)
                with system.open_input_file(name) as f:
                    values = pq.ParquetFile(f).read_row_group(group, columns=[column]).column(0).unique().to_pylist()
                days = sorted({d for v in values if (d := as_date(v, zone))})
                yield pa.RecordBatch.from_arrays([pa.array(days, pa.date32())], names=["date"])

    found = last.mapInArrow(run, "date date")
    if (rest := _scan(spark, groups, column)) is not None:
        found = found.unionByName(rest)
    return found.distinct()

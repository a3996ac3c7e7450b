"""Writers of the analysis's results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shockwire.sources.files import exists


def upsert(existing: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """K5: existing rows whose key is not in new, and all of new."""
    return existing.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def insert_missing(existing: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """K6: existing rows, and new ones whose key they lack; of repeated new keys the last by order of all columns."""
    fresh = new.join(existing.select(*keys).distinct(), list(keys), "left_anti")
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in new.columns if c not in keys] or [F.lit(0)]))
    return existing.unionByName(fresh.withColumn("_n", n).where("_n = 1").drop("_n"), allowMissingColumns=True)


def write_csv(df: DataFrame, path: str) -> None:
    """K1."""
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_parquet(df: DataFrame, path: str, *partitions: str) -> None:
    """K2, K3: zstd Parquet; a directory of parts is the table, so there is nothing to merge."""
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*partitions).parquet(path)


def write_days(df: DataFrame, path: str) -> None:
    """K4: one partition a day; days that exist already are left alone, so that a run can be repeated."""
    spark = df.sparkSession
    if exists(spark, path):
        done = spark.read.parquet(path).select(F.col("date").cast("date").alias("date")).distinct()
        df = df.join(done, "date", "left_anti")
    df.write.mode("append").option("compression", "zstd").partitionBy("date").parquet(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """K8."""
    df.write.mode("append").json(path)


def to_json_rows(df: DataFrame) -> DataFrame:
    """K7: each row as JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def markdown(title: str, df: DataFrame, most: int = 200) -> str:
    """K9: a small result as a Markdown table."""
    rows = df.limit(most).collect()
    head = f"# {title}\n\n| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}\n"
    return head + "".join(f"| {' | '.join('' if v is None else str(v) for v in r)} |\n" for r in rows)


def report(title: str, rows: DataFrame, order: tuple[str, ...] = ()) -> str:
    """K9: rows (section, model, measure, value) as Markdown: a table a section, measures down and models across. Sections
    stand in the given order, others by name after them; numbers have four digits, counts none."""
    found = rows.select("section", "model", "measure", "value").collect()  # what a report prints
    held: dict[str, dict[tuple[str, str], float | None]] = {}
    for r in found:
        held.setdefault(r["section"], {})[r["measure"], r["model"]] = r["value"]
    text = [f"# {title}"]
    for section in [*[o for o in order if o in held], *sorted(set(held) - set(order))]:
        cells = held[section]
        models, measures = sorted({m for _, m in cells}), list(dict.fromkeys(m for m, _ in cells))
        show = lambda v: "-" if v is None else f"{v:.0f}" if float(v).is_integer() else f"{v:.4f}"
        text += ["", f"## {section}", "", f"| measure | {' | '.join(models)} |", "|---" * (len(models) + 1) + "|"]
        text += [f"| {k} | {' | '.join(show(cells.get((k, m))) for m in models)} |" for k in measures]
    return "\n".join(text) + "\n"

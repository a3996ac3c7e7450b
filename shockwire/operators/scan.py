"""Running aggregates over one long order, by a two-pass prefix scan.

A window without a key sorts all rows in one task. Here the order is cut into ranges at approximate quantiles; each range is
its own window, and what the ranges before (or after) it add is one row a range: partial aggregates of the same input, joined
back by broadcast. Ranges are a function of the order's value, so equal values are never parted and nothing has to be
materialised between the passes. Order values should repeat little: rows of one value are one range's.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of a scan, where the caller names none: one for so many rows, MAX_RANGES at most.
ROWS, MAX_RANGES = 500_000, 512


@dataclass(frozen=True)
class Running:
    """A running `kind` (sum, min or max) of a column, over the rows before it in the order and itself; with `after`, over itself
    and the rows after it."""

    kind: str
    column: str
    after: bool = False

    def of(self, column: Column) -> Column:
        return getattr(F, self.kind)(column)

    def both(self, one: Column, other: Column) -> Column:
        """The two together; a null counts for nothing."""
        if self.kind == "sum":
            return F.coalesce(one + other, one, other)
        return (F.least if self.kind == "min" else F.greatest)(one, other)


def bounds(df: DataFrame, order: str, ranges: int | None) -> list:
    """At most ranges - 1 values that cut df's rows, in ascending order of a column, into about equal ranges; of ROWS rows where
    `ranges` is None. One pass."""
    if ranges is not None and ranges < 2:
        return []
    value = F.unix_date(order) if dict(df.dtypes)[order] == "date" else F.col(order)
    most = ranges or MAX_RANGES
    found = df.agg(F.percentile_approx(value, [k / most for k in range(1, most)], 20 * most).alias("b"), F.count(order).alias("n")).first()
    step = 1 if ranges else max(1, most // max(1, -(-found["n"] // ROWS)))
    return sorted(set((found["b"] or [])[step - 1 :: step]))


def range_of(df: DataFrame, order: str, cuts: list) -> Column:
    """The number of cuts at or below the row's value: its range, from 0. A null is in range -1."""
    value = F.unix_date(order) if dict(df.dtypes)[order] == "date" else F.col(order)
    below = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= value)) if cuts else F.lit(0)
    return F.when(F.col(order).isNull(), -1).otherwise(below)


def scan(df: DataFrame, order: str, running: dict[str, Running], keys: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """Adds the columns of `running` (name -> Running) to df, along ascending `order` within each of `keys`; rows of equal order
    see each other. Nulls of order come first."""
    cuts = bounds(df, order, ranges)
    marked = df.withColumn("_range", range_of(df, order, cuts))
    totals = marked.groupBy(*keys, "_range").agg(*[r.of(F.col(r.column)).alias(f"_t_{n}") for n, r in running.items()])
    # frames that end at the last row are made by the reversed order: Spark builds them in quadratic time
    along = lambda r: Window.partitionBy(*keys or [F.lit(0)]).orderBy(F.desc("_range") if r.after else "_range").rowsBetween(Window.unboundedPreceding, -1)  # noqa: E731  a row a range
    others = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_r"), *[r.of(F.col(f"_t_{n}")).over(along(r)).alias(f"_o_{n}") for n, r in running.items()])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.col("_range") == F.col("_r"))
    within = lambda r: Window.partitionBy(*keys, "_range").orderBy(F.desc(order) if r.after else order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    local = marked.select("*", *[r.of(F.col(r.column)).over(within(r)).alias(f"_l_{n}") for n, r in running.items()])
    joined = local.join(F.broadcast(others) if not keys else others, same)  # without keys MAX_RANGES + 1 rows
    return joined.select(*df.columns, *[r.both(F.col(f"_l_{n}"), F.col(f"_o_{n}")).alias(n) for n, r in running.items()])

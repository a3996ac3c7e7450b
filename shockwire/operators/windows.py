"""The kernel: daily property counts, and their sums over the days before reference dates.

Articles are counted to (date, property) once; everything after works on days. A band join of dates becomes an equi-join:
reference dates are few, so each is expanded to the days of its longest window. Where every day is a reference date, a
range window over the dense days takes the join's place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def normalize_properties(articles: DataFrame, column: str = "properties") -> DataFrame:
    """properties as array<string>, from an array or from JSON text; what can't be read becomes null."""
    kind = dict(articles.dtypes)[column]
    return articles if kind.startswith("array") else articles.withColumn(column, F.from_json(column, "array<string>"))


def daily_counts(articles: DataFrame) -> DataFrame:
    """A1: (date, property_id, cnt) from (date, properties)."""
    return articles.where(F.col("properties").isNotNull()).select("date", F.explode("properties").alias("property_id")).where("property_id is not null").groupBy("date", "property_id").agg(F.count(F.lit(1)).alias("cnt"))


def daily_articles(articles: DataFrame) -> DataFrame:
    """A2: (date, n_articles) with readable properties, for days with at least one tag."""
    days = articles.where(F.col("properties").isNotNull()).groupBy("date").agg(F.count(F.lit(1)).alias("n_articles"), F.max(F.size("properties")).alias("_tags"))
    return days.where("_tags > 0").drop("_tags")


def expand(refs: DataFrame, days: int) -> DataFrame:
    """Refs with a row for each of the `days` days before ref_date: day, back (1 is the day before)."""
    return refs.withColumn("back", F.explode(F.sequence(F.lit(1), F.lit(days)))).withColumn("day", F.date_sub("ref_date", F.col("back")))


def window_frequencies(daily: DataFrame, refs: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    """(ref_id, window_days, property_id, freq) over [ref - w, ref - 1], all windows from one join."""
    joined = expand(refs.select("ref_id", "ref_date"), max(windows)).join(daily, F.col("day") == F.col("date"))
    sums = joined.groupBy("ref_id", "property_id").agg(*[F.sum(F.when(F.col("back") <= w, F.col("cnt"))).alias(f"w{w}") for w in windows])
    return _unpivot(sums, ["ref_id", "property_id"], windows, "freq").where("freq is not null")


def window_articles(articles_per_day: DataFrame, refs: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    """A3: (ref_id, window_days, n_articles, actual_days) over [ref - w, ref - 1]; 0 where a window has no days."""
    joined = expand(refs.select("ref_id", "ref_date"), max(windows)).join(articles_per_day, F.col("day") == F.col("date"), "left")
    for_w = lambda w: F.struct(F.lit(w).alias("window_days"), F.coalesce(F.sum(F.when(F.col("back") <= w, F.col("n_articles"))), F.lit(0)).alias("n_articles"), F.count(F.when((F.col("back") <= w), F.col("n_articles"))).alias("actual_days"))
    return joined.groupBy("ref_id").agg(F.array(*map(for_w, windows)).alias("x")).select("ref_id", F.explode("x").alias("x")).select("ref_id", "x.*")


def _unpivot(wide: DataFrame, keys: list[str], windows: tuple[int, ...], name: str) -> DataFrame:
    each = F.array(*[F.struct(F.lit(w).alias("window_days"), F.col(f"w{w}").alias(name)) for w in windows])
    return wide.select(*keys, F.explode(each).alias("x")).select(*keys, "x.*")


def property_windows(daily: DataFrame, refs: DataFrame, params: DataFrame, longest: int) -> DataFrame:
    """(ref_id, property_id, freq) with each property's own window (params: property_id, optimal_window <= longest)."""
    joined = expand(refs.select("ref_id", "ref_date"), longest).join(daily, F.col("day") == F.col("date")).join(params.select("property_id", "optimal_window"), "property_id")
    return joined.where(F.col("back") <= F.col("optimal_window")).groupBy("ref_id", "property_id").agg(F.sum("cnt").alias("freq"))


def trailing(daily: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    """J4 for every day of the series: (date, property_id, w<w>...) over dense days; properties are dealt over tasks."""
    every = Window.partitionBy(F.lit(0))  # one row a property
    spans = daily.groupBy("property_id").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    spans = spans.select("property_id", F.min("lo").over(every).alias("lo"), F.max("hi").over(every).alias("hi"))
    days = spans.select("property_id", F.explode(F.sequence("lo", "hi")).alias("date"))
    dense = days.join(daily, ["date", "property_id"], "left")
    index = F.datediff("date", F.lit("1970-01-01").cast("date"))
    w = lambda n: Window.partitionBy("property_id").orderBy("_day").rangeBetween(-n, -1)
    return dense.withColumn("_day", index).select("date", "property_id", *[F.coalesce(F.sum("cnt").over(w(n)), F.lit(0)).alias(f"w{n}") for n in windows])


def range_sums(daily: DataFrame, asked: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """J4 where many days are asked for: keys, ref_date, window_days and the sums of daily's values over [ref_date - window_days,
    ref_date - 1] for each distinct row of asked (keys, ref_date, window_days).

    A running sum over a key's days is read at the two ends of each window: two rows a window, however long it is, and no list
    of days. daily: keys, date, values."""
    names = ["ref_date", "window_days"]
    end = lambda day, sign: asked.select(*keys, day.alias("date"), F.lit(sign).alias("sign"), *names, *[F.lit(None).cast(dict(daily.dtypes)[v]).alias(v) for v in values])
    counts = daily.select(*keys, "date", F.lit(0).alias("sign"), F.lit(None).cast("date").alias("ref_date"), F.lit(None).cast("int").alias("window_days"), *values)
    rows = counts.unionByName(end(F.date_sub("ref_date", 1), 1)).unionByName(end(F.date_sub("ref_date", F.col("window_days") + 1), -1))
    to_here = Window.partitionBy(*keys or [F.lit(0)]).orderBy("date", F.abs("sign")).rowsBetween(Window.unboundedPreceding, 0)  # without keys: as many rows as days
    running = rows.select(*keys, *names, "sign", *[F.coalesce(F.sum(v).over(to_here), F.lit(0)).alias(v) for v in values]).where("sign != 0")
    return running.groupBy(*keys, *names).agg(*[F.sum(F.col("sign") * F.col(v)).alias(v) for v in values])


def combined_daily(main: DataFrame, daily: DataFrame) -> DataFrame:
    """Main rows, and daily rows of dates that main does not have."""
    return main.unionByName(daily.join(main.select("date").distinct(), "date", "left_anti"), allowMissingColumns=True)


def match_articles(articles: DataFrame, refs: DataFrame, days: int) -> DataFrame:
    """J3 on articles: each article once for every reference date whose window holds it."""
    return expand(refs.select("ref_id", "ref_date"), days).drop("back").join(articles, F.col("day") == F.col("date")).drop("day")


def dates_of(*frames: DataFrame) -> DataFrame:
    """The distinct dates of several frames."""
    return reduce(DataFrame.union, [f.select("date") for f in frames]).distinct()

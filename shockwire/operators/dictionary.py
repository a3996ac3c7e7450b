"""Building the property dictionary from clusters of free tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shockwire.config import DEFAULT
from shockwire.functions.vectors import cosine


def stratified_sample(articles: DataFrame, size: int, periods: int = 5, seed: str = DEFAULT.seed) -> DataFrame:
    """About size rows, an equal quota for each cell of period (fifth of the dates) and label; what a cell lacks is
    refilled from cells of the same label, the nearest period first (the earlier of equals). articles: article_id, date, label."""
    every = Window.partitionBy(F.lit(0))
    days = articles.groupBy("date").agg(F.count(F.lit(1)).alias("_c"))  # one row a day
    cells = days.withColumn("period", F.least(F.floor(F.datediff("date", F.min("date").over(every)) * periods / (F.datediff(F.max("date").over(every), F.min("date").over(every)) + 1)), F.lit(periods - 1)).cast("int")).select("date", "period")
    ordered = articles.join(cells, "date").withColumn("_n", F.row_number().over(Window.partitionBy("period", "label").orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col("article_id").cast("string"))))))
    quota = size // periods // 2
    held = {(r["period"], r["label"]): r["count"] for r in articles.join(cells, "date").groupBy("period", "label").count().collect()}  # periods x labels rows
    take = {cell: min(quota, n) for cell, n in held.items()}
    for label in {label for _, label in held}:
        for p in range(periods):
            lack = quota - take.get((p, label), 0)
            for q in sorted((q for q in range(periods) if q != p), key=lambda q: (abs(q - p), q)):
                spare = held.get((q, label), 0) - take.get((q, label), 0)
                moved = min(lack, spare)
                if moved > 0:
                    take[(q, label)] += moved
                    lack -= moved
    rows = [(p, label, n) for (p, label), n in take.items()]
    quotas = articles.sparkSession.createDataFrame(rows, "period int, label int, _take int")
    return ordered.join(quotas, ["period", "label"]).where("_n <= _take").drop("_n", "_take")


def representatives(tags: DataFrame, top: int = 10) -> DataFrame:
    """For each cluster of (cluster, tag, embedding, article_id): the tag nearest its centroid, the `top` nearest,
    the number of tags and (D7) of distinct articles. Noise (-1) has no representative."""
    known = tags.where("cluster >= 0")
    dims = known.select("cluster", F.posexplode("embedding").alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("x"))
    centre = dims.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centre"))
    near = known.select("cluster", "tag", "embedding").distinct().join(centre, "cluster").select("cluster", "tag", cosine(F.col("embedding"), F.col("centre")).alias("similarity"))
    best = near.groupBy("cluster", "tag").agg(F.max("similarity").alias("similarity")).withColumn("_n", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("similarity"), "tag"))).where(F.col("_n") <= top)
    words = best.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "tag"))), lambda s: s["tag"]).alias("cluster_keywords"))
    sizes = known.groupBy("cluster").agg(F.count(F.lit(1)).alias("cluster_size"), F.count_distinct("article_id").alias("article_count"))
    return words.join(sizes, "cluster").withColumn("representative_tag", F.col("cluster_keywords")[0])


def cross_validation(labels: DataFrame) -> DataFrame:
    """For each cluster of (tag_id, cluster, cv_cluster), the share of its tags that the other clustering keeps
    together in its commonest (non-noise) cluster."""
    counts = labels.where("cluster >= 0").groupBy("cluster", "cv_cluster").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("cluster").agg((F.coalesce(F.max(F.when(F.col("cv_cluster") >= 0, F.col("n"))), F.lit(0)) / F.sum("n")).alias("cross_validation_confidence"))


def filter_clusters(clusters: DataFrame, n_articles: int, least: int = 10, most_share: float = 0.8, confidence: float = 0.3) -> DataFrame:
    """M6: clusters that are neither rare, nor everywhere, nor unstable."""
    return clusters.where((F.col("article_count") >= least) & (F.col("article_count") <= int(most_share * n_articles)) & (F.col("cross_validation_confidence") >= confidence))


def build_dictionary(clusters: DataFrame) -> DataFrame:
    """M7: property ids 1..n in the order of cluster labels."""
    n = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("cluster"))
    return clusters.select(F.format_string("Property_%03d", n).alias("property_id"), *[c for c in clusters.columns if c != "cluster"])

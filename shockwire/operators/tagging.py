"""Tagging articles with properties by vector similarity, and calibrating its thresholds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shockwire.config import DEFAULT
from shockwire.functions.vectors import norm

#: Properties that may be broadcast as one matrix; a dictionary has about a hundred.
MAX_PROPERTIES = 10_000


def property_vectors(embedded: DataFrame) -> DataFrame:
    """M1: property_id and the unit mean of its rows' embeddings."""
    dims = embedded.select("property_id", F.posexplode("embedding").alias("i", "x")).groupBy("property_id", "i").agg(F.avg("x").alias("x"))
    mean = dims.groupBy("property_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    return mean.select("property_id", F.when(norm(F.col("v")) > 0, F.transform("v", lambda x: x / norm(F.col("v")))).otherwise(F.col("v")).alias("vector"))


def property_matrix(properties: DataFrame) -> tuple[list[str], np.ndarray]:
    """The ids of properties (property_id, vector), ascending, and their vectors as rows."""
    rows = properties.select("property_id", "vector").orderBy("property_id").limit(MAX_PROPERTIES + 1).collect()
    if len(rows) > MAX_PROPERTIES:
        raise ValueError(f"more than {MAX_PROPERTIES} properties")
    return [r[0] for r in rows], np.array([r[1] for r in rows], dtype=float).reshape(len(rows), -1 if rows else 0)


def products(batches: Iterator[pa.RecordBatch], matrix: np.ndarray, rows: int = 1024) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of batches whose second column holds embeddings, and their cosines with the matrix's rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            v = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, -1)
            length = np.linalg.norm(v, axis=1, keepdims=True)
            yield part, (v / np.where(length > 0, length, 1)) @ matrix.T


def _embedded(articles: DataFrame, key: str, *also: str) -> DataFrame:
    return articles.select(key, F.col("embedding").cast("array<double>").alias("embedding"), *also).where("embedding is not null")


def similarities(articles: DataFrame, properties: DataFrame, key: str = "article_id") -> DataFrame:
    """(key, property_id, similarity) of every article with every property: a matrix product for each Arrow batch
    against the broadcast property matrix. articles: key, embedding; properties: property_id, vector. Where only some of these
    rows matter, `tag_articles`, `map_tags` and `calibrate` do not make the others."""
    names, matrix = property_matrix(properties)
    kind = dict(articles.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sims in products(batches, matrix):
            keys = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), len(names))))
            yield pa.RecordBatch.from_arrays([keys, pa.array(names * part.num_rows), pa.array(sims.ravel())], names=[key, "property_id", "similarity"])

    if not names:
        return articles.select(key, F.lit("").alias("property_id"), F.lit(0.0).alias("similarity")).limit(0)
    return _embedded(articles, key).mapInArrow(run, f"{key} {kind}, property_id string, similarity double")


def tag_articles(articles: DataFrame, properties: DataFrame, thresholds: DataFrame, key: str = "article_id") -> DataFrame:
    """M4: key and the sorted properties whose similarity reaches their threshold (property_id, threshold), a row an embedded
    article; empty if none. The threshold is applied inside the product's batch: what leaves it are the hits."""
    names, matrix = property_matrix(properties.join(thresholds.select("property_id"), "property_id", "left_semi"))
    known = {r["property_id"]: r["threshold"] for r in thresholds.where(F.col("property_id").isin(names)).collect()}  # MAX_PROPERTIES at most
    least, ids = np.array([known[n] for n in names]), pa.array(names, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sims in products(batches, matrix):
            row, hit = np.nonzero(sims >= least)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part.num_rows))])
            tags = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids.take(pa.array(hit)))
            yield pa.RecordBatch.from_arrays([part.column(0), tags], names=[key, "properties"])

    kind = dict(articles.dtypes)[key]
    if not names:
        return _embedded(articles, key).select(key, F.array().cast("array<string>").alias("properties"))
    return _embedded(articles, key).mapInArrow(run, f"{key} {kind}, properties array<string>")


def map_tags(tags: DataFrame, properties: DataFrame, key: str = "tag", least: float = DEFAULT.tag_similarity) -> DataFrame:
    """M3: each free tag's most similar property, where it reaches `least` (the smaller id of equals). The largest is taken
    inside the batch; a tag that stands in several rows keeps the best of them."""
    names, matrix = property_matrix(properties)
    kind, ids = dict(tags.dtypes)[key], pa.array(names, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sims in products(batches, matrix):
            best = sims.argmax(axis=1)  # names ascend: the first of equals
            most = sims[np.arange(len(best)), best]
            hit = np.flatnonzero(most >= least)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(hit)), ids.take(pa.array(best[hit])), pa.array(most[hit])], names=[key, "property_id", "similarity"])

    if not names:
        return tags.select(key, F.lit("").alias("property_id"), F.lit(0.0).alias("similarity")).limit(0)
    found = _embedded(tags, key).mapInArrow(run, f"{key} {kind}, property_id string, similarity double")
    return found.groupBy(key).agg(F.min(F.struct((-F.col("similarity")).alias("s"), "property_id")).alias("b")).select(key, "b.property_id", (-F.col("b.s")).alias("similarity"))


def similarity_histogram(articles: DataFrame, properties: DataFrame, truth: DataFrame, grid: list[float], key: str = "article_id") -> DataFrame:
    """property_id, bucket (how many grid values, ascending, a similarity reaches), n and positives: how many similarities
    of articles are there, and how many of those pairs stand in truth (key, property_id). A task emits one histogram a property."""
    names, matrix = property_matrix(properties)
    number, width = {n: i for i, n in enumerate(names)}, len(grid) + 1
    of = truth.where(F.col(key).isNotNull()).groupBy(key).agg(F.collect_set("property_id").alias("_truth"))  # properties at most
    rows = _embedded(articles, key).join(of, key, "left").select(key, "embedding", "_truth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, right = np.zeros(len(names) * width, np.int64), np.zeros(len(names) * width, np.int64)
        for part, sims in products(batches, matrix):
            cell = np.searchsorted(grid, sims, side="right") + np.arange(len(names)) * width
            every += np.bincount(cell.ravel(), minlength=len(every))
            true = [(i, number[p]) for i, known in enumerate(part.column(2).to_pylist()) for p in known or () if p in number]
            if true:
                right += np.bincount(cell[tuple(np.array(true).T)], minlength=len(right))
        some = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array([names[k // width] for k in some], pa.string()), pa.array(some % width, pa.int32()), pa.array(every[some]), pa.array(right[some])], names=["property_id", "bucket", "n", "positives"])

    schema = "property_id string, bucket int, n long, positives long"
    if not names:
        return articles.sparkSession.createDataFrame([], schema)
    return rows.mapInArrow(run, schema).groupBy("property_id", "bucket").agg(F.sum("n").alias("n"), F.sum("positives").alias("positives"))


def calibrate(articles: DataFrame, properties: DataFrame, truth: DataFrame, key: str, start: float = 0.3, end: float = 0.8, step: float = 0.05) -> DataFrame:
    """property_id (null: all together), threshold, f1: the grid's first threshold with the best F1, from one histogram
    of similarities a property. Thresholds without any hit stand at 0.5 globally and at the global one by property.
    truth: key, property_id."""
    grid = [round(start + i * step, 10) for i in range(round((end - start) / step) + 1)]
    counts = similarity_histogram(articles, properties, truth, grid, key)
    both = counts.unionByName(counts.withColumn("property_id", F.lit(None).cast("string"))).groupBy("property_id", "bucket").agg(F.sum("n").alias("n"), F.sum("positives").alias("positives"))
    # a threshold's hits are the buckets above it
    reach = lambda c, i: F.sum(F.when(F.col("bucket") > i, F.col(c)).otherwise(0))
    each = F.array(*[F.struct(F.lit(t).alias("t"), reach("positives", i).alias("tp"), reach("n", i).alias("hits"), F.sum("positives").alias("positives")) for i, t in enumerate(grid)])
    sums = both.groupBy("property_id").agg(each.alias("x")).select("property_id", F.explode("x").alias("x")).select("property_id", "x.*")
    scored = sums.withColumn("f1", F.when(F.col("hits") + F.col("positives") > 0, 2 * F.col("tp") / F.when(F.col("hits") + F.col("positives") > 0, F.col("hits") + F.col("positives"))).otherwise(0.0))
    best = scored.withColumn("_n", F.row_number().over(Window.partitionBy("property_id").orderBy(F.desc("f1"), "t"))).where("_n = 1")
    whole = F.max(F.when(F.col("property_id").isNull(), F.when(F.col("f1") > 0, F.col("t")).otherwise(0.5))).over(Window.partitionBy(F.lit(0)))  # a row a property
    return best.select("property_id", F.when(F.col("f1") > 0, F.col("t")).otherwise(whole).alias("threshold"), "f1")


def encode(articles: DataFrame, encoder: Callable[[list[str]], np.ndarray], key: str = "article_id", text: str = "text", batch_rows: int = 64) -> DataFrame:
    """M2: key and the embedding that `encoder` gives for its text; a batch that does not fit memory is halved, down to
    16 rows, before the error stands."""
    kind = dict(articles.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = batch_rows
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, size)
                try:
                    vectors = encoder(part.column(1).to_pylist())
                except MemoryError:
                    if size <= 16:
                        raise
                    size = max(16, size // 2)
                    continue
                at += part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([list(map(float, v)) for v in vectors], pa.list_(pa.float32()))], names=[key, "embedding"])

    return articles.select(key, F.coalesce(F.col(text), F.lit("")).alias(text)).mapInArrow(run, f"{key} {kind}, embedding array<float>")


def hashing_encoder(texts: list[str], dims: int = 64) -> np.ndarray:
    """A test double for a sentence encoder: signed hashed word counts, unit length. It carries no meaning."""
    import xxhash

    out = np.zeros((len(texts), dims))
    for row, text in zip(out, texts, strict=True):
        for word in text.split():
            h = xxhash.xxh64_intdigest(word)
            row[h % dims] += 1 if h >> 63 else -1
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(length > 0, length, 1)

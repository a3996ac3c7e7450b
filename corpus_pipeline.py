"""A training corpus from `documents`: quality, near-duplicates, personal data, source mixture, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet to the shared folder
and gives it, reread, to the next. All but the last return the columns of docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shockwire.llm import bpe, mixing, neardup, pii, quality
from shockwire.llm.common import cut, fresh, table
from shockwire.llm.queries import QUALITY_THRESHOLD


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier accepts. It learns from the labelled rows among docs."""
    score = fresh(docs, "score")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")), score)
    return scored.where(F.col(score) >= QUALITY_THRESHOLD).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group."""
    name = fresh(docs, "kept_id")
    kept = neardup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, and terms that disclose it, in every text; n_chars follows."""
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else clean


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the source mixture takes its words, in whole copies: taken / size, rounded; a document of
    which less than half is taken goes."""
    id_, copies, copy = (fresh(docs, c) for c in ("taken_id", "copies", "copy"))
    times = F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)) + 0.5).cast("int")
    taken = mixing.mix(docs).select(F.col("doc_id").alias(id_), times.alias(copies)).groupBy(id_).agg(F.max(copies).alias(copies)).where(F.col(copies) > 0)
    repeated = docs.join(taken, F.col("doc_id").eqNullSafe(F.col(id_))).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return repeated.select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and its byte-level BPE ids, with their number and digests of ids and decoded bytes."""
    return bpe.digests(bpe.encode(docs, decoded=True), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", classify),
    ("near-duplicates", deduplicate),
    ("personal data", sanitise),
    ("source mixture", mixture),
    ("byte-level BPE", tokenise),
]

#: The classifier and the tokenizer are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""The queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shockwire.llm import bpe, chroma, filter_audit, fingerprints, html_text, line_dedup, mixing, neardup, pii, prefix_counts, quality, ranked_search, warc
from shockwire.llm.common import table


def op1_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds audio: a tone for each word of the whole text of documents stands in for a recording."""
    recordings = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("audio"))
    return chroma.matches(chroma.fingerprints(recordings, chroma.tones)).drop("codes").withColumnRenamed("id", "doc_id")


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


#: Tokens that a document of op3 may have.
TOKEN_LIMIT = 4096


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = prefix_counts.prefix_counts(table(spark, sf_dir, "documents"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


#: Score from which op4 predicts label 1.
QUALITY_THRESHOLD = 0.7


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), decoded=True))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_chroma": op1_chroma, "op2_neardup": op2_neardup, "op3_token_counts": op3_token_counts, "op4_quality": op4_quality, "op5_mixing": op5_mixing, "op6_pii": op6_pii, "op7_bpe": op7_bpe, "op8_fingerprints": op8_fingerprints, "op9_html_text": op9_html_text, "op10_warc": op10_warc, "op11_filter_audit": op11_filter_audit, "op12_ranked_search": op12_ranked_search, "op13_line_dedup": op13_line_dedup}


def oracle_sql() -> dict[str, str]:
    return {"op2_neardup": neardup.ORACLE, "op5_mixing": mixing.oracle_sql(), "op10_warc": warc.ORACLE, "op11_filter_audit": filter_audit.oracle_sql(), "op12_ranked_search": ranked_search.oracle_sql(), "op13_line_dedup": line_dedup.oracle_sql()}

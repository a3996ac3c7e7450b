"""The analysis's inputs, made from the general tables: each as a DataFrame and as a common table expression.

prices from orders (mean order total a day), tagged articles from lineitem (three tags a row, some rows untagged or
unreadable), articles from documents, property vectors from embeddings, labels with scores from labels and documents,
monthly series from orders and lineitem. The price series is noise, so shocks are falls of a half and the exclusion zone is
shorter than the model's default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHOCK = -0.5
GAP = 5
EXCLUSION = 4
WINDOWS = (7, 14, 30)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))
    return read(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg((cents.cast("double") / (F.lit(100.0) * F.count(F.lit(1)))).alias("close"))


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.array(F.concat("l_returnflag", "l_linestatus"), F.concat(F.lit("Q"), F.floor(F.col("l_quantity") / 10).cast("string")), F.concat(F.lit("D"), F.round(F.col("l_discount") * 100).cast("int").cast("string")))
    properties = F.when(F.col("l_linenumber") == 7, None).when(F.col("l_linenumber") == 6, F.array().cast("array<string>")).otherwise(tags)
    return read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("article_id"), F.to_date("l_shipdate").alias("date"), properties.alias("properties"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.substring_index("text", "\n", 1)
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 90).cast("int"))
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), day.alias("date"), first.alias("title"), F.col("text").alias("body"), "source", "lang")


def property_vectors_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("Property_"), F.lpad(F.col("label").cast("string"), 3, "0")).alias("property_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", F.col("quality").alias("label"), (F.floor(F.col("n_chars") / 100) * 1.0).alias("score"), F.date_add(F.lit("2018-01-01").cast("date"), (F.col("doc_id") % 1500).cast("int")).alias("date"))


def daily_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, risk_score): orders a day by a made-up scale, for what works on a score series."""
    score = F.round(F.sum(F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1).otherwise(0)) * 100 / F.count(F.lit(1)), 2)
    return read(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(score.alias("risk_score"))


def monthly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(year_month, value): lines shipped a month, a made-up indicator."""
    return read(spark, sf_dir, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("year_month")).agg((F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)) * 1.0).alias("value"))


PRICES = "prices AS (SELECT o_orderdate::DATE AS date, sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / (100.0::DOUBLE * count(*)) AS close FROM orders GROUP BY 1)"
TAGGED = """tagged AS (SELECT l_orderkey * 10 + l_linenumber AS article_id, l_shipdate::DATE AS date, CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN []::VARCHAR[]
  ELSE [l_returnflag || l_linestatus, 'Q' || floor(l_quantity / 10)::BIGINT, 'D' || round(l_discount * 100)::INT] END AS properties FROM lineitem)"""
ARTICLES = "articles AS (SELECT doc_id AS article_id, DATE '2024-01-01' + (doc_id % 90)::INT AS date, split_part(text, chr(10), 1) AS title, text AS body, source, lang FROM documents)"
SCORED = "scored AS (SELECT l.doc_id, l.quality AS label, (d.n_chars // 100)::DOUBLE AS score, DATE '2018-01-01' + (l.doc_id % 1500)::INT AS date FROM labels l JOIN documents d USING (doc_id))"
SCORES = "scores AS (SELECT o_orderdate::DATE AS date, round(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END)::DOUBLE * 100 / count(*), 2) AS risk_score FROM orders GROUP BY 1)"
MONTHLY = "series AS (SELECT strftime(l_shipdate, '%Y-%m') AS year_month, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::DOUBLE AS value FROM lineitem GROUP BY 1)"
VECTORS = "vectors AS (SELECT vec_id, 'Property_' || lpad(label::VARCHAR, 3, '0') AS property_id, embedding::DOUBLE[] AS embedding FROM embeddings)"

RETURNS = f"{PRICES}, returns AS (SELECT date, close, close / lag(close) OVER (ORDER BY date) - 1 AS ret FROM prices)"
SHOCKS = f"""{RETURNS}, shocks AS (SELECT * FROM returns WHERE ret <= {SHOCK}),
starts AS (SELECT *, CASE WHEN lag(date) OVER (ORDER BY date) IS NULL OR date - lag(date) OVER (ORDER BY date) > {GAP} THEN 1 ELSE 0 END AS s FROM shocks),
clustered AS (SELECT date, close, ret, sum(s) OVER (ORDER BY date)::INT AS event_id FROM starts)"""
EVENTS = f"""{SHOCKS}, spans AS (SELECT event_id, min(date) AS first_shock_date, max(date) AS last_shock_date, count(*)::INT AS shock_count FROM clustered GROUP BY 1),
prior AS (SELECT date, lag(close) OVER (ORDER BY date) AS prior_close FROM prices),
lows AS (SELECT event_id, min(close) AS low FROM spans JOIN prices ON date BETWEEN first_shock_date AND last_shock_date GROUP BY 1),
events_ AS (SELECT event_id, first_shock_date, last_shock_date, last_shock_date - first_shock_date + 1 AS duration_days, shock_count, CASE WHEN prior_close > 0 THEN round((low / prior_close - 1) * 100, 2) END AS max_cumulative_drop
  FROM spans JOIN prior ON date = first_shock_date JOIN lows USING (event_id))"""
CONTROLS = f"""{EVENTS}, candidates AS (SELECT date FROM prices WHERE NOT EXISTS (SELECT 1 FROM events_ WHERE abs(date - first_shock_date) <= {EXCLUSION})),
picked AS (SELECT date, row_number() OVER (ORDER BY md5('42|' || date::VARCHAR)) AS n FROM candidates),
controls AS (SELECT row_number() OVER (ORDER BY date)::INT AS control_id, date FROM picked WHERE n <= 3 * (SELECT count(*) FROM events_))"""
REFS = f"""{CONTROLS}, refs AS (SELECT 'event_' || event_id AS ref_id, 'event' AS kind, 1 AS label, first_shock_date AS ref_date FROM events_ UNION ALL SELECT 'control_' || control_id, 'control', 0, date FROM controls)"""
DAILY = f"""{TAGGED}, daily AS (SELECT date, property_id, count(*) AS cnt FROM (SELECT date, unnest(properties) AS property_id FROM tagged) GROUP BY 1, 2),
per_day AS (SELECT date, count(*) AS n_articles FROM tagged WHERE properties IS NOT NULL GROUP BY 1 HAVING max(len(properties)) > 0)"""
_W = ", ".join(f"({w})" for w in WINDOWS)
FREQ = f"""{REFS}, {DAILY}, w AS (SELECT * FROM (VALUES {_W}) AS v(window_days)),
freq AS (SELECT ref_id, window_days, property_id, sum(cnt)::BIGINT AS freq FROM refs, w, daily WHERE date BETWEEN ref_date - window_days AND ref_date - 1 GROUP BY ALL),
win AS (SELECT ref_id, window_days, coalesce(sum(n_articles), 0)::BIGINT AS n_articles, count(n_articles) AS actual_days FROM refs CROSS JOIN w LEFT JOIN per_day ON date BETWEEN ref_date - window_days AND ref_date - 1 GROUP BY ALL)"""

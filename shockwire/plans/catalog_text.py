"""Queries on article text and de-duplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from shockwire.operators import text
from shockwire.plans import standins as s
from shockwire.registry import query


@query("P2_not_excluded", f"WITH {s.ARTICLES} SELECT article_id FROM articles WHERE CASE WHEN lang = 'de' THEN 'y' END IS NULL")
def _(spark, d):
    return s.articles(spark, d).withColumn("excluded", F.when(F.col("lang") == "de", "y")).where(F.col("excluded").isNull()).select("article_id")


@query("P3_iso_date", "SELECT o_orderkey, o_orderdate::DATE AS date FROM orders")
def _(spark, d):
    orders = s.read(spark, d, "orders")
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".0"))).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return orders.select("o_orderkey", text.iso_date(raw).alias("date"))


@query("P4_lead_sentences", f"WITH {s.ARTICLES}, h AS (SELECT article_id, trim(substr(body, 1, 200)) AS b FROM articles), p AS (SELECT article_id, string_split_regex(regexp_replace(b, '([.!?。다])[ \\t\\n\\r]+', '\\1' || chr(1), 'g'), chr(1)) AS x FROM h) SELECT article_id, array_to_string(x[1:2], ' ') AS lead FROM p")
def _(spark, d):
    return s.articles(spark, d).select("article_id", text.lead_sentences(F.col("body")).alias("lead"))


@query("P5_lead_cut", f"WITH {s.ARTICLES}, h AS (SELECT article_id, substr(trim(body), 1, 200) AS b FROM articles), p AS (SELECT *, length(b) - position('.' IN reverse(b)) AS cut_at, position('.' IN reverse(b)) AS f FROM h) SELECT article_id, CASE WHEN f > 0 AND cut_at > 50 THEN substr(b, 1, cut_at + 1) ELSE b END AS lead FROM p")
def _(spark, d):
    return s.articles(spark, d).select("article_id", text.lead_cut(F.col("body")).alias("lead"))


@query("P6_normalize_text", f"WITH {s.ARTICLES} SELECT article_id, trim(regexp_replace(regexp_replace(body, '\\s+', ' ', 'g'), '[^\\p{{L}}\\p{{N}}\\p{{M}}_ .,!?·()\"''-]', '', 'g')) AS body FROM articles")
def _(spark, d):
    return s.articles(spark, d).select("article_id", text.normalize_text(F.col("body")).alias("body"))


#: The lead of P4 in SQL.
LEAD = "array_to_string(string_split_regex(regexp_replace(trim(substr(body, 1, 200)), '([.!?。다])[ \\t\\n\\r]+', '\\1' || chr(1), 'g'), chr(1))[1:2], ' ')"


@query("P7_fill_leads", f"WITH {s.ARTICLES}, l AS (SELECT *, CASE WHEN lang = 'fr' THEN ' ' ELSE {LEAD} END AS lead FROM articles) SELECT article_id, title, CASE WHEN trim(lead) = '' THEN title ELSE lead END AS lead FROM l WHERE trim(coalesce(title, '')) <> ''")
def _(spark, d):
    lead = F.when(F.col("lang") == "fr", " ").otherwise(text.lead_sentences(F.col("body")))
    return text.fill_leads(s.articles(spark, d).withColumn("lead", lead)).select("article_id", "title", "lead")


@query("P8_article_text", f"WITH {s.ARTICLES} SELECT article_id, coalesce(title, '') || ' ' || coalesce(CASE WHEN lang = 'fr' THEN NULL ELSE {LEAD} END, '') AS full_text FROM articles")
def _(spark, d):
    return s.articles(spark, d).withColumn("lead", F.when(F.col("lang") != "fr", text.lead_sentences(F.col("body")))).select("article_id", text.article_text().alias("full_text"))


@query("P9_daily_ids", f"WITH {s.ARTICLES} SELECT article_id AS original, 'daily_' || date || '_' || (row_number() OVER (PARTITION BY date ORDER BY article_id) - 1) AS article_id FROM articles")
def _(spark, d):
    return text.daily_ids(s.articles(spark, d).select(F.col("article_id").alias("original"), "date"), "original").select("original", "article_id")


@query("P14_tag_lines", f"WITH {s.ARTICLES}, t AS (SELECT article_id, list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(regexp_replace(trim(x), '^[0-9.\\-*•)\\s]+', ''))), lambda x: x <> '')[1:5] AS tags FROM articles) SELECT article_id, array_to_string(tags, '|') AS tags FROM t")
def _(spark, d):
    return s.articles(spark, d).select("article_id", F.array_join(text.tag_lines(F.col("body")), "|").alias("tags"))


@query("P15_W11_coverage_gaps", "WITH r AS (SELECT n_nationkey AS k, 'news_' AS p, DATE '2024-01-01' + (n_nationkey * 10)::INT AS a, DATE '2024-01-01' + (n_nationkey * 10 + 5 + (n_nationkey * 7) % 9)::INT AS b FROM nation), g AS (SELECT 'news_' || strftime(a, '%Y%m%d') || '-' || strftime(b, '%Y%m%d') AS name, a AS start, b AS \"end\", max(b) OVER (ORDER BY a, b, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f, lag(b) OVER (ORDER BY a, b, k) AS l FROM r) SELECT name, start, \"end\", CASE WHEN start - f > 1 THEN 'gap' ELSE 'overlap' END AS kind, (start - f)::INT AS days, (start - l)::INT AS adjacent_days FROM g WHERE start - f <> 1")
def _(spark, d):
    k = F.col("n_nationkey").cast("int")
    day = lambda n: F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), n), "yyyyMMdd")
    names = s.read(spark, d, "nation").select(F.concat(F.lit("news_"), day(k * 10), F.lit("-"), day(k * 10 + 5 + (k * 7) % 9)).alias("name"))
    start, end = text.file_dates(F.col("name"))
    return text.coverage_gaps(names.select("name", start.alias("start"), end.alias("end")))


@query("D1_distinct_ids", "WITH x AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey FROM x WHERE n = 1")
def _(spark, d):
    # rows of one number stand in the table's order, which no exchange keeps
    rows = s.read(spark, d, "lineitem").select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return text.first_of(rows, ["l_orderkey"], "l_linenumber", "_file", "_row").select("l_orderkey", "l_linenumber", "l_partkey")


@query("D2_distinct_vendor_ids", "WITH x AS (SELECT l_partkey AS vendor_id, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS n FROM lineitem) SELECT vendor_id, l_orderkey, l_linenumber FROM x WHERE n = 1")
def _(spark, d):
    rows = s.read(spark, d, "lineitem").withColumnRenamed("l_partkey", "vendor_id")
    return text.first_of(rows, ["vendor_id"], "l_shipdate", "l_orderkey", "l_linenumber").select("vendor_id", "l_orderkey", "l_linenumber")


@query("D3_title_and_date", f"WITH {s.ARTICLES} SELECT DISTINCT title, date FROM articles")
def _(spark, d):
    return s.articles(spark, d).select("title", "date").dropDuplicates(["title", "date"])


@query("D4_title_dedup", f"WITH {s.ARTICLES}, x AS (SELECT *, row_number() OVER (PARTITION BY substr(title, 1, 20) ORDER BY date, article_id) AS n FROM articles) SELECT article_id, title FROM x WHERE n = 1")
def _(spark, d):
    return text.deduplicate_titles(s.articles(spark, d), "date", "article_id").select("article_id", "title")


@query("D5_keep_last", "WITH x AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) SELECT o_custkey, o_orderkey, o_orderdate::DATE AS date FROM x WHERE n = 1")
def _(spark, d):
    return text.first_of(s.read(spark, d, "orders"), ["o_custkey"], "-o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("date"))

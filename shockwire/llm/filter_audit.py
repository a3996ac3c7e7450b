"""Filter interaction audit by direct relational replay: what every order of a set of filters removes, step by step.

1. Each document gets the set of filters that it fails, as bits of one number, before anything is removed.
2. These rows are crossed with all orders of the filters (5! = 120 rows, a bound that the number of filters sets), and the
   first failure of each (document, order) is the least of its failing filters' positions there.
3. The steps of the order are exploded, and conditional sums by (part, order, step) are combined on the map side, so that
   what is shuffled is 600 rows a part and task, whatever the number of documents.
4. shapley is a filter's removals over all orders and steps, a sum over the few rows of (3).

Equal texts meet by SHA-256: the smallest doc_id of each text that several hold is found by partial aggregation, and joined
back to rows without texts. Texts of more than one row in HOT_TEXTS, of which there are HOT_TEXTS at most, are broadcast, so that
their rows need no exchange; what is shuffled holds no larger group.

Defined results: a null text is empty; a null source is the part ''; rows that repeat a doc_id count each by itself, and are
no copies of each other; a null doc_id is neither smaller nor greater than any other and has no labels; labels that repeat or
contradict each other count for each value once; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shockwire.llm.common import WORD, cut, text_of

#: Filters of the audit, in the order of their bits; E needs the other documents.
FILTERS = "ABCDE"
MIN_WORDS = 200
#: Distinct words, in per cent of the words, and capitals, in per cent of the code points.
MIN_DISTINCT, MAX_CAPITALS = 50, 2
#: A text that more than one in so many rows hold is joined by broadcast.
HOT_TEXTS = 1000
SYMBOLS = r"[#$%&*|]"


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, fails (bit i: the document fails FILTERS[i]) of every row of docs (doc_id, text, source)."""
    words = F.regexp_extract_all("t", F.lit(WORD), F.lit(0))
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    alone = [n < MIN_WORDS, 100 * distinct < MIN_DISTINCT * n, 100 * F.regexp_count("t", F.lit("[A-Z]")).cast("long") > MAX_CAPITALS * F.char_length("t").cast("long"), F.col("t").rlike(SYMBOLS)]
    rows = cut(
        docs.select(F.col("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text_of("text").alias("t"))
        .select("doc_id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), bits(alone).alias("own"))
    )
    copies = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count(F.lit(1)).alias("n")).where("first_id < last_id")
    many = F.col("n") * HOT_TEXTS >= rows.count()
    hot, others = (copies.where(c).select("digest", "first_id") for c in (many, ~many))
    marked = rows.join(F.broadcast(hot), "digest", "left")
    rest = marked.where("first_id is null").drop("first_id").join(others, "digest", "left")
    copied = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    return marked.where("first_id is not null").unionByName(rest).select("doc_id", "part", (F.col("own") + F.when(copied, 1 << len(alone)).otherwise(0)).alias("fails"))


def bits(conditions: list[Column]) -> Column:
    """The conditions as bits of one number, the first lowest; a null condition is false."""
    return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)), F.lit(0))


def replay(flagged: DataFrame, filters: str = FILTERS, counted: dict[str, str] | None = None) -> DataFrame:
    """part, filter_order, step and counts of every order of the filters over flagged (part, fails).

    counted: for each further count its 0/1 column of flagged; it counts the documents removed at the step.
    """
    counted = counted or {}
    some = range(len(filters))
    orders = flagged.sparkSession.createDataFrame(
        [(i, "".join(filters[k] for k in p), [1 << k for k in p], [p.index(k) + 1 for k in some]) for i, p in enumerate(permutations(some))], "order_no int, filter_order string, bits array<int>, at array<int>"
    )
    fails, here = F.col("fails"), F.col("bit")
    first = F.least(*[F.when(fails.bitwiseAND(1 << k) != 0, F.col("at")[k]).otherwise(len(filters) + 1) for k in some])
    crossed = flagged.select("part", "fails", *counted.values()).join(F.broadcast(orders.drop("filter_order"))).withColumn("first", first)
    steps = crossed.select("part", "order_no", "fails", "first", *counted.values(), F.posexplode("bits").alias("step", "bit")).withColumn("step", F.col("step") + 1)
    step, failing = F.col("step"), fails.bitwiseAND(here) != 0
    n = lambda c: F.sum(F.when(c, 1).otherwise(0).cast("long"))
    sums = steps.groupBy("part", "order_no", "step", "bit").agg(
        n(F.col("first") > step).alias("kept"), n(F.col("first") == step).alias("removed"), n(failing & (F.col("first") < step)).alias("redundant"), n(fails == here).alias("unique_fails"),
        *[n((F.col("first") == step) & (F.col(c) == 1)).alias(name) for name, c in counted.items()],
    )
    over = Window.partitionBy("part", "bit")  # as many rows as there are orders
    return (
        sums.withColumn("shapley", F.sum("removed").over(over))
        .join(F.broadcast(orders.select("order_no", "filter_order")), "order_no")
        .select("part", "filter_order", step.cast("int").alias("step"), "kept", "removed", "redundant", "unique_fails", *counted, "shapley")
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The replay of FILTERS over docs, with the documents of quality 1 and of toxic 1 that each step removes."""
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    return replay(failures(docs).join(known, "doc_id", "left"), counted={"good_lost": "good", "toxic_lost": "toxic"})


def oracle_sql() -> str:
    """The rows of op11 in DuckDB's SQL."""
    orders = ", ".join(f"('{''.join(p)}')" for p in permutations(FILTERS))
    fails = ", ".join(f"('{k}', {k.lower()})" for k in FILTERS)
    return f"""
WITH words AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
flags AS (SELECT row_number() OVER () AS r, doc_id, part, len(w) < {MIN_WORDS} AS a, 100 * len(list_distinct(w)) < {MIN_DISTINCT} * len(w) AS b,
  100 * len(regexp_extract_all(t, '[A-Z]')) > {MAX_CAPITALS} * length(t) AS c, regexp_matches(t, '{SYMBOLS}') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM words),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
each AS (SELECT r, part, v.filter, v.f FROM flags, LATERAL (VALUES {fails}) AS v(filter, f)),
many AS (SELECT r, sum(CASE WHEN f THEN 1 ELSE 0 END) AS n FROM each GROUP BY 1),
orders AS (SELECT * FROM (VALUES {orders}) AS o(filter_order)),
steps AS (SELECT e.r, e.part, o.filter_order, instr(o.filter_order, e.filter)::INT AS step, e.filter, e.f FROM each e CROSS JOIN orders o),
firsts AS (SELECT r, filter_order, coalesce(min(CASE WHEN f THEN step END), 6) AS first_ FROM steps GROUP BY ALL),
sums AS (SELECT s.part, s.filter_order, s.step, s.filter, sum(CASE WHEN first_ > step THEN 1 ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN first_ = step THEN 1 ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN f AND first_ < step THEN 1 ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN f AND m.n = 1 THEN 1 ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN first_ = step AND k.good = 1 THEN 1 ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN first_ = step AND k.toxic = 1 THEN 1 ELSE 0 END)::BIGINT AS toxic_lost
  FROM steps s JOIN firsts x ON s.r = x.r AND s.filter_order = x.filter_order JOIN many m ON s.r = m.r JOIN flags g ON s.r = g.r LEFT JOIN known k ON g.doc_id = k.doc_id GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM sums
"""

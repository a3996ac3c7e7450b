"""Document fingerprints by consistent weighted sampling, in DataFrame expressions alone.

A document is a weighted set: its words with their counts. For sample k a term with weight w draws, from hashes of the term
and k alone, r and c ~ Gamma(2, 1) (-ln of two uniforms' product) and b ~ U(0, 1), and takes
t = floor(ln(w) / r + b), ln(a) = ln(c) - r (t - b + 1). The sample is the term with the smallest a, at its t. Two documents
draw the same sample with a probability of their generalised Jaccard similarity, sum min(w) / sum max(w). As a is a function
of term and t, the smallest a itself stands for the sample; 16 bits of its hash are kept, SAMPLES of them a fingerprint.

The edited text of a document needs the start of the next one in order of doc_id. Only ids and lengths are put in order
(range partitions, then a window in each, so no task sees all of them); of a text, just the needed start is sent on. Texts
are dealt by doc_id once; counting words and taking minima then need no further exchange.

Defined results: a null text is empty; a text without words has the empty word as its one term;
a row with null doc_id stands outside the order: it has no next document, its edited text is its
first half and near_next is null; rows that repeat a doc_id are rows of their own, and as a next document the one with the
smallest hash of its text counts; after the last document comes the first; a single document is its own next; an empty
table gives no rows; further columns of docs are not read.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shockwire.llm.common import cut, text_of

SAMPLES = 64
#: Code points of texts that a task of the counting stage should hold.
TASK_CHARS = 2_000_000
#: Most tasks of that stage; beyond it, tasks grow and spill.
MAX_TASKS = 50_000
#: Samples that one row of the sampling stage makes; more would make the code that Spark generates for it too long.
LANE = 8


#: Coefficients of a polynomial for ln(x) on [1, 4], lowest power first; its error is below 2e-5.
LOG = [float(c) for c in np.polynomial.Chebyshev.interpolate(np.log, 8, [1, 4]).convert(kind=np.polynomial.Polynomial).coef]


def _gamma(bits: Column, one: Column, two: Column) -> Column:
    """A draw of Gamma(2, 1), -ln of two uniforms' product. A uniform is m / 2**e: e the place of the first bit set, m in
    [1, 2); both places together are that of the second bit set. one, two: the uniforms' m. F.log costs three times as much."""
    rest = bits.bitwiseAND(bits - 1)
    p = one * two
    return F.bit_count(rest.bitwiseXOR(rest - 1)) * F.lit(math.log(2)) - reduce(lambda y, c: y * p + F.lit(c), LOG[-2::-1], F.lit(LOG[-1]))


def _between(x: Column, at: int, n: int) -> Column:
    """n bits of x from bit `at` on, as a double within (0, 1)."""
    return F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << n) - 1)).cast("double") * F.lit(2.0**-n) + F.lit(2.0 ** -(n + 1))


def samples_of(term: Column, k: Column, *log_weights: Column) -> list[Column]:
    """ln(a) of sample k for a term's hash and each log of a weight (null: none). r and c are never cut to a table: their
    tails reach 2**-40 (r) and 2**-18 (c, whose small values decide, with 46 bits there)."""
    h = F.xxhash64(term, k)
    g = F.xxhash64(h)
    f = F.xxhash64(g)
    r = _gamma(F.shiftrightunsigned(h, 24), 1 + _between(g, 0, 32), 1 + _between(g, 32, 32))
    c = _gamma(F.shiftrightunsigned(f, 46), 1 + _between(f, 0, 23), 1 + _between(f, 23, 23))
    b = _between(h, 0, 24)
    return [F.log(c) - r * (F.floor(lw / r + b) - b + 1) for lw in log_weights]


def fingerprint_words(words: DataFrame, by: list[str], samples: int = SAMPLES, parts: int = 1) -> DataFrame:
    """by, lane and marks_0, marks_1, ... (LANE ints below 2**16) from rows (by, part, word): samples / LANE lanes for each
    by. A word's hashes and draws are made once for all parts."""
    weights = [F.log(F.sum(F.when(F.col("part") == p, 1).otherwise(0)).cast("double")).alias(f"lw{p}") for p in range(parts)]
    terms = words.groupBy(*by, "word").agg(*weights).select(*by, F.xxhash64("word").alias("term"), *[f"lw{p}" for p in range(parts)])
    lanes = terms.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(samples // LANE - 1))))
    drawn = [samples_of(F.col("term"), F.col("lane") * LANE + k, *[F.col(f"lw{p}") for p in range(parts)]) for k in range(LANE)]
    least = lanes.groupBy(*by, "lane").agg(*[F.min(drawn[k][p]).alias(f"s{p}_{k}") for p in range(parts) for k in range(LANE)])
    return least.select(*by, "lane", *[F.array(*[F.hash(f"s{p}_{k}").bitwiseAND(F.lit(65535)) for k in range(LANE)]).alias(f"marks_{p}") for p in range(parts)])


def in_order(rows: DataFrame) -> DataFrame:
    """For rows (doc_id, n): each distinct doc_id (not null), n (the largest), next_id in ascending order, round the end."""
    ids = rows.where("doc_id is not null").groupBy("doc_id").agg(F.max("n").alias("n"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = cut(ids.repartitionByRange(parts, "doc_id").withColumn("part", F.spark_partition_id()))
    firsts = ids.groupBy("part").agg(F.min("doc_id").alias("first"))
    every = Window.partitionBy(F.lit(0))  # one row a partition
    ends = firsts.select(F.col("part").alias("_part"), F.coalesce(F.lead("first").over(every.orderBy("part")), F.min("first").over(every)).alias("then"))
    within = ids.withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id")))
    return within.join(ends, F.col("part") == F.col("_part")).select("doc_id", "n", F.coalesce("next_id", "then").alias("next_id"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples of two arrays of marks."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x) / F.size(a)


def text_form(marks: Column) -> Column:
    """Four hexadecimal digits a sample."""
    return F.array_join(F.transform(marks, lambda x: F.lower(F.lpad(F.hex(x), 4, "0"))), "")


def fingerprint(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of docs
    (doc_id, text)."""
    # no alias where doc_id is a long already: both uses of `dealt` must look alike for Spark to share its exchange
    doc_id = F.col("doc_id") if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id")
    base = docs.select(doc_id, text_of("text").alias("text"))
    lengths = cut(base.select("doc_id", F.char_length("text").cast("long").alias("n")))
    chain = cut(in_order(lengths))
    chars = lengths.agg(F.sum("n")).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MAX_TASKS, -(-chars // TASK_CHARS)))
    dealt = base.where("doc_id is not null").repartition(parts, "doc_id")
    half = F.floor(F.char_length("text") / 2).cast("int")
    # the start of each document, as long as the one before it needs, sent there
    needs = chain.select(F.col("next_id").alias("_id"), F.col("doc_id").alias("to"), F.floor(F.col("n") / 2).cast("int").alias("need"))
    starts = dealt.join(needs, F.col("doc_id") == F.col("_id")).select("to", F.struct(F.xxhash64("text").alias("h"), F.expr("left(text, need)").alias("start")).alias("start"))
    starts = starts.repartition(parts, "to").groupBy("to").agg(F.min("start").alias("start"))
    first_half = F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 2) as int))")
    joined = dealt.join(starts, F.col("doc_id") == F.col("to"), "left").select("doc_id", "text", F.concat(first_half, F.substring(F.coalesce("start.start", F.lit("")), F.lit(1), half)).alias("edited"))
    apart = base.where("doc_id is null").select("doc_id", "text", first_half.alias("edited"))
    known = cut(_marks(joined, samples).unionByName(_marks(apart, samples)))
    following = known.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("h", "marks")).alias("m")).select(F.col("doc_id").alias("_n"), F.col("m.marks").alias("next_marks"))
    following = chain.select(F.col("doc_id").alias("_c"), "next_id").join(following, F.col("next_id") == F.col("_n")).select("_c", "next_marks")
    out = known.join(following, F.col("doc_id") == F.col("_c"), "left")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", text_form(F.col("marks")).alias("fingerprint"), text_form(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"), likeness(F.col("marks"), F.col("next_marks")).alias("near_next"),
    )


def _marks(texts: DataFrame, samples: int) -> DataFrame:
    """doc_id, h (hash of the text), n_chars, edited_sha256, marks, edited_marks of each row of texts (doc_id, text,
    edited). What is told of a row rides along as bytes with the words of its own text."""
    words = F.array_remove(F.split("body", r"[\x20\x09-\x0D]+"), "")
    eight = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    facts = F.concat(eight(F.xxhash64("text")), eight(F.char_length("text").cast("long")), F.unhex(F.sha2("edited", 256)))
    bodies = F.array(F.struct(F.lit(0).alias("part"), F.col("text").alias("body")), F.struct(F.lit(1).alias("part"), F.col("edited").alias("body")))
    numbered = texts.withColumn("row", F.monotonically_increasing_id())  # of its own, so that both parts share it
    rows = numbered.select("doc_id", "row", facts.alias("facts"), F.explode(bodies).alias("x")).select("doc_id", "row", "facts", "x.part", "x.body")
    terms = rows.select("doc_id", "row", "facts", "part", F.explode(F.when(F.size(words) > 0, words).otherwise(F.array(F.lit("")))).alias("word"))
    marks = fingerprint_words(terms, ["doc_id", "row", "facts"], samples, parts=2)
    of = lambda part: F.concat(*[F.max(F.when(F.col("lane") == lane, F.col(f"marks_{part}"))) for lane in range(samples // LANE)])
    both = marks.groupBy("doc_id", "row", "facts").agg(of(0).alias("marks"), of(1).alias("edited_marks"))
    number = lambda at: F.conv(F.hex(F.substring("facts", at, 8)), 16, -10).cast("long")
    return both.select("doc_id", number(1).alias("h"), number(9).alias("n_chars"), F.lower(F.hex(F.substring("facts", 17, 32))).alias("edited_sha256"), "marks", "edited_marks")

"""Ranked lexical search as a blocked sparse matrix product, items x terms times terms x documents.

1. Items become (item, term, multiplicity) rows. They are dealt into blocks of about BLOCK_TERMS of these rows by a hash of the
   item; a block's terms are numbered on the driver, and that matrix is what a task gets. A block is never larger than
   MAX_BLOCK_TERMS: it raises, as one item alone would have to hold that many terms.
2. Against a block, each document becomes one sparse row: its length in terms, and numbers and occurrences of those of its
   terms that the block has. The rows are written once. N, L and the terms' df are aggregated from them.
3. A batch of documents is one block of the product. Its rows are turned into columns by term, with the impact
   w * (1000000000 * tf div (1000 * tf + 20 * m)) of each entry as int64; for each item the columns of its terms are merged into one
   accumulator over the block's documents (Gustavson), and the largest `k` go on.
4. A task keeps `k` documents an item over its blocks; those of all tasks meet in two steps, by (item, salt) and by item.

Defined results: an item or document without terms (null or empty text) is nowhere in the result and no part of N; items of one
item_id, null included, are one item whose terms add up; rows that repeat a doc_id are documents of their own; a null doc_id
comes last among equal scores; scores of 0 are left out; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shockwire.llm.common import cut, map_rows, small_batches, text_of

TOP = 50
#: Rows (item, term) of a block of items, and the most that one may have.
BLOCK_TERMS, MAX_BLOCK_TERMS = 200_000, 2_000_000
#: Documents of a block of the product.
BLOCK_DOCS = 8192
#: Groups in which an item's candidates meet first.
SALTS = 64
#: Bytes of a text that are split at once.
PIECE = 1 << 20
#: Stands for a null doc_id: after all others.
LAST = (1 << 63) - 1
#: Bytes outside terms become blanks, A-Z become a-z; bytes of characters beyond ASCII are parts of terms.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def term_counts(text: bytes) -> Counter[bytes]:
    """Occurrences of each term of a text in UTF-8."""
    found: Counter[bytes] = Counter()
    rest = b""
    for at in range(0, len(text), PIECE):
        piece = rest + text[at : at + PIECE].translate(_TERMS)
        cut_at = piece.rfind(b" ") + 1 if at + PIECE < len(text) else len(piece)
        found.update(piece[:cut_at].split())
        rest = piece[cut_at:]
    return found


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term (binary), times of items (item_id, text)."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [term_counts(t) for t in batch.column(1).to_pylist()]
            back = pa.array(np.repeat(np.arange(batch.num_rows), [len(c) for c in found]))
            return pa.RecordBatch.from_arrays([batch.column(0).take(back), pa.array([t for c in found for t in c], pa.binary()), pa.array([n for c in found for n in c.values()], pa.int64())], names=["item_id", "term", "times"])

        return f

    rows = items.select("item_id", text_of("text").cast("binary").alias("text"))
    return map_rows(rows, make, type(rows.schema)([rows.schema["item_id"]]).add("term", "binary").add("times", "long")).groupBy("item_id", "term").agg(F.sum("times").alias("times"))


class ItemBlock:
    """A block of items as a sparse matrix: row i holds columns `terms[ptr[i]:ptr[i + 1]]` with their multiplicities."""

    def __init__(self, rows: list, once: bool) -> None:
        order = lambda x: (x is not None, x if x is not None else 0)
        rows = sorted(((r["item_id"], bytes(r["term"]), r["times"]) for r in rows), key=lambda r: (order(r[0]), r[1]))
        self.items = list(dict.fromkeys(r[0] for r in rows))
        number = {item: i for i, item in enumerate(self.items)}
        self.vocabulary = {t: i for i, t in enumerate(sorted({r[1] for r in rows}))}
        self.ptr = np.searchsorted([number[r[0]] for r in rows], np.arange(len(self.items) + 1))
        self.terms = np.array([self.vocabulary[r[1]] for r in rows], np.int64)
        self.times = np.array([1 if once else r[2] for r in rows], np.int64)


def incidence(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms, with repeats), terms and tf (numbers and occurrences of the vocabulary's terms) of every row with terms."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        known = shared.value

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            lengths, sizes, terms, tf = [], [], [], []
            for text in batch.column(1).to_pylist():
                counts = term_counts(text)
                hit = [(known[t], n) for t, n in counts.items() if t in known] if len(counts) < len(known) else [(i, counts[t]) for t, i in known.items() if t in counts]
                lengths.append(counts.total())
                sizes.append(len(hit))
                terms += [h[0] for h in hit]
                tf += [h[1] for h in hit]
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tf, pa.int64()))], names=["doc_id", "n", "terms", "tf"])

        return f

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), text_of("text").cast("binary").alias("text"))
    return map_rows(rows, make, "doc_id long, n long, terms array<int>, tf array<long>", rows=128).where("n > 0")


def impacts(n: np.ndarray, row: np.ndarray, tf: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The int64 impact of each entry: of documents of n terms, the entries' rows, occurrences and term weights."""
    m = np.array([50 + 50 * int(x) * n_docs // n_terms for x in n], np.int64)  # Python's numbers: the product may pass 64 bits
    return weight * (1_000_000_000 * tf // (1000 * tf + 20 * m[row]))


def top_of_block(block: pa.Table, items: ItemBlock, weights: np.ndarray, n_docs: int, n_terms: int, k: int, best: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Merges a block of documents (rows of `incidence`) into `best`, each item's `k` best (scores, doc_ids)."""
    doc, n = block["doc_id"].to_numpy(), block["n"].to_numpy()
    lists = block["terms"].combine_chunks()
    term = lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(doc)), np.diff(lists.offsets.to_numpy()))
    value = impacts(n, row, block["tf"].combine_chunks().flatten().to_numpy(), weights[term], n_docs, n_terms)
    by_term = np.argsort(term, kind="stable")
    row, value = row[by_term], value[by_term]
    start = np.searchsorted(term[by_term], np.arange(len(weights) + 1))
    total = np.zeros(len(doc), np.int64)
    for i in range(len(items.items)):
        total[:] = 0
        for j in range(items.ptr[i], items.ptr[i + 1]):
            lo, hi = start[items.terms[j]], start[items.terms[j] + 1]
            total[row[lo:hi]] += items.times[j] * value[lo:hi]  # a document once a term
        scores, ids = best[i]
        new = np.flatnonzero(total >= max(1, scores[-1] if len(scores) == k else 1))
        if len(new):
            scores, ids = np.concatenate([scores, total[new]]), np.concatenate([ids, doc[new]])
            order = np.lexsort((ids, -scores))[:k]
            best[i] = scores[order], ids[order]


def _blocks(batches: Iterator[pa.RecordBatch], docs: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, docs):
            held.append(batch.slice(at, docs))
            if sum(b.num_rows for b in held) >= docs:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def search_block(docs: DataFrame, items: ItemBlock, item_type: str, k: int = TOP) -> DataFrame:
    """item_id, doc_id, score of each task's `k` best documents of every item of the block."""
    spark = docs.sparkSession
    matrix = cut(incidence(docs, items.vocabulary))
    whole = matrix.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = whole["docs"], whole["terms"] or 1
    df = np.zeros(len(items.vocabulary), np.int64)
    for r in matrix.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row a term of the block
        df[r["t"]] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    shared = spark.sparkContext.broadcast((items, weights))
    kind = pa.array(items.items).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, w = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(held.items)
        for block in _blocks(batches, BLOCK_DOCS):
            top_of_block(block, held, w, n_docs, n_terms, k, best)
        back = np.repeat(np.arange(len(best)), [len(s) for s, _ in best])
        if len(back):
            yield pa.RecordBatch.from_arrays([pa.array(held.items, kind).take(pa.array(back)), pa.array(np.concatenate([b for _, b in best])), pa.array(np.concatenate([s for s, _ in best]))], names=["item_id", "doc_id", "score"])

    return small_batches(matrix).mapInArrow(run, f"item_id {item_type}, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, once: bool = True) -> DataFrame:
    """item_id, rank, doc_id, score: each item's `k` best documents. once: an item's repeated terms count once, else as often as
    they stand there."""
    spark = docs.sparkSession
    terms = cut(item_terms(items))
    n_blocks = max(1, math.ceil(terms.count() / BLOCK_TERMS))
    item_type = dict(terms.dtypes)["item_id"]
    found = []
    for b in range(n_blocks):
        rows = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b).limit(MAX_BLOCK_TERMS + 1).collect()
        if len(rows) > MAX_BLOCK_TERMS:
            raise ValueError(f"a block of items has more than {MAX_BLOCK_TERMS} terms")
        if rows:
            found.append(search_block(docs, ItemBlock(rows, once), item_type, k))
    if not found:
        return spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id long, score long")
    best = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id"))
    some = reduce(DataFrame.unionAll, found).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).withColumn("rank", best("item_id", "salt")).where(F.col("rank") <= k)
    return some.withColumn("rank", best("item_id")).where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), F.nullif("doc_id", F.lit(LAST)).alias("doc_id"), "score")


def oracle_sql(k: int = TOP) -> str:
    """The rows of op12 in DuckDB's SQL."""
    terms = "unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"
    return f"""
WITH asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, {terms} AS term FROM benchmark)),
docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM (SELECT r, doc_id, {terms} AS term FROM docs) GROUP BY ALL),
lengths AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY 1),
whole AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term, n_docs),
impact AS (SELECT t.r, t.doc_id, t.term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))) AS x FROM tf t JOIN lengths USING (r) JOIN weights USING (term), whole),
scores AS (SELECT item_id, r, doc_id, sum(x)::BIGINT AS score FROM asked JOIN impact USING (term) GROUP BY ALL),
ranked AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= {k}
"""

"""Line dedup: a line that stands in several documents stays in the first of them.

1. Each line of MIN_CHARS code points or more, stripped and with A-Z lowered, becomes (128-bit hash, document, position); shorter
   lines never go and are not sent.
2. These rows are range-partitioned and sorted by (hash, document, position). Document and position are part of the range, so
   a line that a third of all documents hold is cut over as many tasks as its rows fill.
3. Each task streams its rows: the first of a hash names the document that keeps it, and the lines of the others go. Where
   a task begins inside a hash, only the lines of that hash's first document there are open. Every task also returns the
   hash it ends in, with the document that it saw first; these rows, one a task, settle the open ones.
4. The positions that go, of each document, become a bitmap of the lines kept, compressed; a document that loses no
   line has none. Texts are not moved for this: `apply` joins the bitmaps to them.

Defined results: a null or empty text is one empty line; rows of one doc_id are one document, so a line that stands in them
alone stays in all; a null doc_id is one document, after all others; an empty table gives no rows; further columns of docs stay
as they are in `apply`, and are not read elsewhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shockwire.llm.common import cut, map_rows, small_batches, text_of

MIN_CHARS = 10
SPACE = b" \t\n\x0b\x0c\r"
#: Stands for a null doc_id: after all others.
LAST = (1 << 63) - 1
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_DROP, _OPEN, _END = 0, 1, 2
_LINES = "d long, row long, n_lines int, at int, h1 long, h2 long"


def line_key(line: bytes, least: int = MIN_CHARS) -> bytes | None:
    """A line's key, or None where it has less than `least` code points."""
    key = line.strip(SPACE)
    if len(key) < least or (len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least):
        return None
    return key.translate(_LOWER)


def identity(docs: DataFrame) -> tuple[Column, Column]:
    """What tells documents apart, and rows of one doc_id: equal rows have equal lines."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), F.xxhash64(text_of("text"))


def hashed_lines(docs: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """d, row, n_lines, at (from 0), h1, h2 of every line of at least `least` code points."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, lengths, at, digests = [], [], [], []
            for text in batch.column(2).to_pylist():
                before, lines = len(at), text.split(b"\n")
                for i, line in enumerate(lines):
                    if (key := line_key(line, least)) is not None:
                        at.append(i)
                        digests.append(xxhash.xxh3_128_digest(key))
                counts.append(len(at) - before)
                lengths.append(len(lines))
            back = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            columns = [batch.column(0).take(back), batch.column(1).take(back), pa.array(np.repeat(np.array(lengths, np.int32), counts)), pa.array(at, pa.int32()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())]
            return pa.RecordBatch.from_arrays(columns, names=["d", "row", "n_lines", "at", "h1", "h2"])

        return f

    d, row = identity(docs)
    return map_rows(docs.select(d.alias("d"), row.alias("row"), text_of("text").cast("binary").alias("text")), make, _LINES)


def first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _LINES in order of hash, document and position: those that go (_DROP), those that an earlier task decides (_OPEN),
    and the hash that the task ends in with the document seen first in it (_END)."""
    head = last = None
    first, end = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        d, h1, h2 = (batch.column(k).to_numpy() for k in (0, 4, 5))
        key = (h1[0], h2[0])
        head = head or key
        new = np.concatenate([[key != last], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        group = np.cumsum(new)
        firsts = np.concatenate([[first], d[new]])
        gone = d != firsts[group]
        kind = np.where(gone, _DROP, _OPEN).astype(np.int8)
        out = gone | ((h1 == head[0]) & (h2 == head[1]))
        last, first = (h1[-1], h2[-1]), firsts[-1]
        end = batch.slice(batch.num_rows - 1)
        yield pa.RecordBatch.from_arrays([*batch.filter(pa.array(out)).columns, pa.array(kind[out])], names=[*batch.schema.names, "kind"])
    if end is not None:
        yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), *end.columns[1:], pa.array([_END], pa.int8())], names=[*end.schema.names, "kind"])


def dropped_lines(docs: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """d, row, n_lines, at of every line that goes."""
    order = ["h1", "h2", "d", "at"]
    ordered = hashed_lines(docs, least).repartitionByRange(*order).sortWithinPartitions(*order)
    found = cut(small_batches(ordered).mapInArrow(first_occurrences, f"{_LINES}, kind byte"))
    lines = ["d", "row", "n_lines", "at"]
    ends = found.where(F.col("kind") == _END).groupBy("h1", "h2").agg(F.min("d").alias("first"))  # one row a task at most
    settled = found.where(F.col("kind") == _OPEN).join(F.broadcast(ends), ["h1", "h2"]).where("d > first")
    return found.where(F.col("kind") == _DROP).select(*lines).unionByName(settled.select(*lines))


def pack(n_lines: int, dropped: np.ndarray) -> bytes:
    """A bitmap of n_lines bits, the first highest, 0 at the lines dropped; compressed."""
    keep = np.ones(n_lines, bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep).tobytes())


def unpack(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def keep_bitmaps(docs: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """d, row, n_lines, n_dropped, keep (see `pack`) of every document that loses a line, once each distinct text of it."""
    grouped = dropped_lines(docs, least).groupBy("d", "row").agg(F.max("n_lines").alias("n_lines"), F.collect_set("at").alias("at"))  # the lines of one text

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            at = [np.array(x, np.int64) for x in batch.column(3).to_pylist()]
            keep = [pack(n, x) for n, x in zip(batch.column(2).to_pylist(), at, strict=True)]
            return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(x) for x in at], pa.int64()), pa.array(keep, pa.binary())], names=["d", "row", "n_lines", "n_dropped", "keep"])

        return f

    return map_rows(grouped, make, "d long, row long, n_lines int, n_dropped long, keep binary")


def apply(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with text as the kept lines, joined by line feeds, and n_lines and n_dropped; columns of these names give way."""
    names = [c for c in docs.columns if c.lower() not in ("text", "n_lines", "n_dropped")]
    d, row = identity(docs)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_others") if names else F.lit(None).cast("string").alias("_others"), text_of("text").alias("_text"), d.alias("_d"), row.alias("_row"))
    sent = bitmaps.select(F.col("d").alias("_d"), F.col("row").alias("_row"), "keep", "n_dropped").hint("shuffle_hash")
    joined = rows.join(sent, ["_d", "_row"], "left").select("_others", F.col("_text").cast("binary").alias("_text"), "keep", F.coalesce("n_dropped", F.lit(0)).alias("_dropped"))

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, lengths = [], []
            for text, keep in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n = text.count(b"\n") + 1
                if keep is not None:
                    lines = text.split(b"\n")
                    text = b"\n".join([lines[i] for i in np.flatnonzero(unpack(keep, n))])
                texts.append(text)
                lengths.append(n)
            kept = pa.array(texts, pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([batch.column(0), kept, pa.array(lengths, pa.int64()), batch.column(3)], names=["_others", "_text", "_lines", "_dropped"])

        return f

    schema = type(joined.schema)([joined.schema["_others"]]).add("_text", "string").add("_lines", "long").add("_dropped", "long")
    done = map_rows(joined, make, schema, rows=256)
    others = {c: F.col("_others").getField(c) for c in names}
    return done.select(*[F.col("_text").alias(c) if c.lower() == "text" else others[c].alias(c) for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")], F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row of docs (doc_id, text)."""
    some = docs.select("doc_id", "text")
    kept = apply(some, keep_bitmaps(some))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def oracle_sql(least: int = MIN_CHARS) -> str:
    """The rows of op13 in DuckDB's SQL."""
    space = " || ".join(f"chr({b})" for b in SPACE)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
each AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM docs),
keyed AS (SELECT *, {lower.format(f"trim(line, {space})")} AS key FROM each),
firsts AS (SELECT key, min(coalesce(doc_id, {LAST})) AS first_ FROM keyed WHERE length(key) >= {least} GROUP BY 1),
marked AS (SELECT k.*, coalesce(coalesce(k.doc_id, {LAST}) > f.first_, false) AS gone FROM keyed k LEFT JOIN firsts f ON k.key = f.key AND length(k.key) >= {least})
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, sum(CASE WHEN gone THEN 1 ELSE 0 END)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r
"""

"""Near-duplicate groups: MinHash signatures joined by multi-index Hamming search, confirmed on full shingle sets.

Signatures. A document's set holds the 64-bit hashes of its distinct SHINGLE-word shingles. SYMBOLS MinHash values of 32
bits each form its signature; two documents of similarity J differ in about (1 - J) SYMBOLS of them.

Multi-index Hamming join. The signature is split into CHUNKS chunks of WIDTH symbols. By the pigeonhole principle two
signatures that differ in at most CHUNKS * (ERRORS + 1) - 1 symbols have a chunk with at most ERRORS differences, and
with every choice of ERRORS symbols of a chunk left out, they share a key: all pairs below that distance meet. Pairs
beyond it that meet are not dropped, so at J = 0.75 a pair is missed with probability (1 - 0.633)**14 < 1e-6.

Equal sets are one class from the start, whatever their number. Within a key:
1. A shingle that no other candidate has can't be in an intersection; a class whose other shingles can't reach the
   similarity is set aside (exactly: it has no partner among those it meets).
2. Each key's leader is its class with the smallest share of such shingles; every member is compared with its leader on
   full sets, which joins most of a group by as many comparisons as it has members.
3. Only pairs of different components are left. For these the comparisons with the leader bound the intersection from
   above: of the leader's shingles, both have at most those that neither lacks (a 512-bit map of the lacking ones), and
   outside it at most the smaller number of shared shingles. Pairs whose bound reaches the similarity are compared on full
   sets. The bound is exact arithmetic, so no link is lost, and a group of n near copies makes about n comparisons.

Components come from links by contraction: every node takes its smallest neighbour, the links are drawn anew between what
is left, until none is. All steps are joins and aggregations; links and members never come to the driver.

Defined results: a document without words has the empty set and is linked with nothing; rows that repeat a doc_id are one
node of the links where their sets are equal, and one document otherwise (a link of either holds for both); a row with null
doc_id is linked with nothing, has no component and is kept; an empty table gives no rows; further columns of docs are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shockwire.llm.common import cut, map_rows, small_batches, text_of

SHINGLE = 5
#: Similarity, in per cent, from which documents are linked.
PERCENT = 75
WIDTH, ERRORS, CHUNKS = 5, 1, 14
SYMBOLS = WIDTH * CHUNKS
#: 64-bit words of the map of a leader's shingles.
MAP = 8
#: Words of a task's cache.
CACHE = 200_000

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
_rng = np.random.default_rng(20_240_501)
_A, _B = (_rng.integers(0, 2**32, SYMBOLS, dtype=np.uint32) for _ in range(2))
_A |= np.uint32(1)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = xxhash.xxh64_intdigest(word)
        return n


def finish(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix in which every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(32))) * _MIX[3]
    x = (x ^ (x >> np.uint64(32))) * _MIX[4]
    return x ^ (x >> np.uint64(29))


def shingles(text: str, words: _Words) -> np.ndarray:
    """The 64-bit hashes of a text's distinct shingles, ascending. A-Z is lowered, words end at ASCII white space; a text
    of fewer words has one shingle, of all of them. words: the task's cache."""
    if len(words) > CACHE:
        words.clear()
    found = text.encode().lower().split()  # on bytes, lower() is A-Z and split() is at \x20 and \x09-\x0D
    n = len(found)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, n)
    if not n:
        return h
    width = min(n, SHINGLE)
    x = finish(h[: n - width + 1] + np.uint64(width))
    for k in range(1, width):
        x = finish(x * _MIX[0] + h[k : n - width + 1 + k])
    return np.unique(x)


def signature(found: np.ndarray) -> np.ndarray:
    """The SYMBOLS MinHash values of a set that isn't empty."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(SYMBOLS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        out = np.minimum(out, (x[None, at : at + 2048] * _A[:, None] + _B[:, None]).min(axis=1))
    return out


def keys(signed: np.ndarray) -> np.ndarray:
    """The keys of a signature: for each of its chunks, each choice of ERRORS symbols left out."""
    chunks = signed.astype(np.uint64).reshape(CHUNKS, WIDTH)
    out = []
    for variant, out_of in enumerate(combinations(range(WIDTH), ERRORS)):
        h = finish(np.arange(CHUNKS, dtype=np.uint64) * _MIX[1] + np.uint64(variant + 1))
        for k in range(WIDTH):
            if k not in out_of:
                h = finish(h * _MIX[0] + chunks[:, k])
        out.append(h)
    return np.concatenate(out)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), hi, lo (128 bits of the set) and keys of every row of docs (doc_id, text)."""

    def f(batch: pa.RecordBatch, words: _Words) -> pa.RecordBatch:
        n, hi, lo, key, ends = [], [], [], [], [0]
        for text in batch.column(1).to_pylist():
            s = shingles(text, words)
            n.append(len(s))
            hi.append(finish(s ^ _MIX[1]).sum(dtype=np.uint64) if len(s) else np.uint64(0))
            lo.append(finish(s ^ _MIX[2]).sum(dtype=np.uint64) if len(s) else np.uint64(0))
            if len(s):
                key.append(keys(signature(s)))
            ends.append(ends[-1] + (len(key[-1]) if len(s) else 0))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _long(np.concatenate(key) if key else np.zeros(0, np.uint64)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), _long(np.array(hi, np.uint64)), _long(np.array(lo, np.uint64)), lists], names=["doc_id", "n", "hi", "lo", "keys"])

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")), lambda: partial(f, words=_Words()), "doc_id long, n long, hi long, lo long, keys array<long>")


def sets(docs: DataFrame) -> DataFrame:
    """doc_id, n and the set (array of long, ascending as unsigned) of docs (doc_id, text)."""

    def f(batch: pa.RecordBatch, words: _Words) -> pa.RecordBatch:
        found = [shingles(t, words) for t in batch.column(1).to_pylist()]
        ends = np.concatenate(([0], np.cumsum([len(s) for s in found]))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), _long(np.concatenate(found) if found else np.zeros(0, np.uint64)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends).astype(np.int64)), lists], names=["id", "n", "set"])

    return map_rows(docs.select(F.col("doc_id").alias("id"), text_of("text").alias("text")), lambda: partial(f, words=_Words()), "id long, n long, set array<long>")


def compare(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """For pairs (a, b): na, nb, both (size of the intersection) and m0.. (the map of a's shingles that b lacks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(k) for k in (2, 3))
            na, nb, both, maps = [], [], [], np.zeros((batch.num_rows, MAP), np.uint64)
            for r in range(batch.num_rows):
                a, b = (c[r].values.to_numpy().view(np.uint64) for c in (left, right))
                at = np.searchsorted(b, a)
                has = (at < len(b)) & (b[np.minimum(at, len(b) - 1)] == a)
                lacks = np.flatnonzero(~has)
                np.bitwise_or.at(maps[r], lacks // 64 % MAP, np.uint64(1) << (lacks % 64).astype(np.uint64))
                na.append(len(a))
                nb.append(len(b))
                both.append(int(has.sum()))
            columns = [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in (na, nb, both)), *(_long(np.ascontiguousarray(maps[:, k])) for k in range(MAP))]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "na", "nb", "both", *(f"m{k}" for k in range(MAP))])

    one = known.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    two = known.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    schema = "a long, b long, na long, nb long, both long, " + ", ".join(f"m{k} long" for k in range(MAP))
    return small_batches(pairs).join(one, "a").join(two, "b").select("a", "b", "set_a", "set_b").mapInArrow(run, schema)


def _similar(both: Column, na: Column, nb: Column) -> Column:
    return 100 * both >= PERCENT * (na + nb - both)


def components(links: DataFrame) -> DataFrame:
    """id and label (the smallest id that can be reached) of every id in links (a, b)."""
    edges = cut(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    names = cut(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("label", F.col("id")))
    while not edges.isEmpty():
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("b"))
        step = cut(near.select(F.col("a").alias("from"), F.least("a", "b").alias("to")))
        # two steps at once: the smallest neighbour's smallest neighbour
        step = cut(step.join(step.select(F.col("from").alias("_f"), F.col("to").alias("_t")), F.col("to") == F.col("_f"), "left").select("from", F.coalesce("_t", "to").alias("to")))
        names = cut(names.join(step, F.col("label") == F.col("from"), "left").select("id", F.coalesce("to", "label").alias("label")))
        one = edges.join(step, F.col("a") == F.col("from")).select(F.col("to").alias("a"), "b")
        two = one.join(step, F.col("b") == F.col("from")).select("a", F.col("to").alias("b")).where("a != b")
        edges = cut(two.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return names


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text)."""
    profile = cut(profiles(docs))
    classes = profile.where("n > 0 and doc_id is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys"))
    met = classes.select("id", F.explode("keys").alias("key"))
    met = cut(met.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("_n > 1").select("key", "id").distinct())
    wanted = met.select("id").distinct()
    known = cut(sets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")).dropDuplicates(["id", "set"]))
    # shingles that only one candidate has, and candidates that can't be similar to any for want of others
    single = known.select("id", F.explode("set").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id")).where("c = 1")
    lonely = single.groupBy("id").agg(F.count(F.lit(1)).alias("alone"))
    able = known.groupBy("id").agg(F.max("n").alias("n")).join(lonely, "id", "left").select("id", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("shared"))
    able = cut(able.where(100 * F.col("shared") >= PERCENT * F.col("n")))
    kept = met.join(able, "id")
    leaders = kept.groupBy("key").agg(F.min(F.struct((1 - F.col("shared") / F.col("n")).alias("alone"), "id")).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", F.col("first.id").alias("leader"))
    placed = cut(kept.join(leaders, "key"))
    stars = placed.where("leader != id").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    compared = cut(compare(stars, known))
    links = compared.where(_similar(F.col("both"), F.col("na"), F.col("nb"))).select("a", "b")
    names = components(links)
    # what is left: members of one key in different components, by what the leader tells of both
    maps = [f"m{k}" for k in range(MAP)]
    rows = placed.join(compared.groupBy("a", "b").agg(F.max("na").alias("na"), F.max("both").alias("both"), *[F.min(m).alias(m) for m in maps]), (F.col("leader") == F.col("a")) & (placed["id"] == F.col("b")), "left")
    rows = rows.join(names.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left")
    rows = rows.select("key", "id", "n", "shared", F.coalesce("label", "id").alias("label"), F.coalesce("na", "n").alias("nl"), F.coalesce("both", "n").alias("both"), *[F.coalesce(m, F.lit(0)).alias(m) for m in maps])
    rows = cut(rows)
    mixed = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("key")
    rows = rows.join(mixed, "key")
    x, y = rows.alias("x"), rows.alias("y")
    lacking = reduce(lambda p, q: p + q, [F.bit_count(F.col(f"x.{m}").bitwiseOR(F.col(f"y.{m}"))) for m in maps])
    most = F.least("x.both", "y.both", F.col("x.nl") - lacking) + F.greatest(F.least(F.col("x.shared") - F.col("x.both"), F.col("y.shared") - F.col("y.both")), F.lit(0))
    small = F.least("x.shared", "y.shared")
    may = (F.col("x.label") != F.col("y.label")) & (F.col("x.id") < F.col("y.id")) & _similar(small, F.col("x.n"), F.col("y.n")) & _similar(most, F.col("x.n"), F.col("y.n"))
    rest = x.join(y, (F.col("x.key") == F.col("y.key")) & may).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    more = compare(rest, known).where(_similar(F.col("both"), F.col("na"), F.col("nb"))).select("a", "b")
    names = components(links.unionByName(more))
    # back to documents, through their classes; written, so that Spark can split the join where a class has many copies
    labels = cut(classes.select("hi", "lo", "id").join(names, "id", "left").select("hi", "lo", F.coalesce("label", "id").alias("label")))
    out = profile.select("doc_id", "n", "hi", "lo").join(labels, ["hi", "lo"], "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM d),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
e AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM s),
p AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM e x JOIN e y USING (g) WHERE x.doc_id < y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
both_ AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS c FROM n UNION SELECT b, c FROM r JOIN both_ ON a = v WHERE c < b)
SELECT n.doc_id, n.n AS n_shingles, min(least(c, n.doc_id)) AS component_id, n.doc_id = min(least(c, n.doc_id)) AS kept FROM n JOIN r ON r.v = n.doc_id GROUP BY n.doc_id, n.n
"""

"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. Targets: sources in code-point order (null last) weigh 1, 2, 3, 1, ... and share all words; a target stops at
   `repeats` times its source's size and the excess goes to the others by weight (water filling, in closed form).
2. Sources are cut into about sqrt(rows) shards by a hash of doc_id, so that neither the shards of one source nor the
   rows of one shard grow with more than the square root of a source: a source with a third of all rows is dealt over
   many tasks.
3. A source's shards, end to end, are one line of words, cut into blocks of `block_words`; only its last block is short. A
   block belongs to the shard in which it begins. Highest quotients target / (2 seats + 1) give each source its quota of
   blocks, and the same rule gives each shard of it an integer quota.
4. A shard's documents stand in a seeded order; the quota takes whole rounds of its blocks, then a run of blocks from a
   seeded start, round the end. A document's taken words are the overlap with what was taken, so a source's taken words
   are its quota's blocks, whatever the lengths of its texts.
5. What a source's blocks leave short of its quota in words (by the same rule over all words), because its last block is short or it
   has less than a block, is taken in words: from the first shards with room, and there from the first documents with room.
   So no source is short by a word or more, and none is over by more than two blocks.

Defined results: a null text has size 0 and is never taken; an empty table gives no rows; rows that repeat a doc_id are
rows of their own (ordered by size where all else ties); a null source is a source of its own; a null doc_id is hashed
as the empty text. Only the named columns are read, so further columns and their names do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shockwire.llm.common import WORD, cut, text_of

BLOCK_WORDS = 16
SEED = "mix-1"


def _number(*parts: Column | str) -> Column:
    """A seeded 32-bit number of the parts."""
    cols = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("long")


def apportion(df: DataFrame, group: list[str], key: str, weight: str, seats: str) -> DataFrame:
    """Adds `quota`: the seats of each group, given to its rows by the highest quotients weight / (2 given + 1).

    Rows start with round(weight / d) seats at a divisor d that can't give too many; only the few seats left are ranked,
    so about three quotients a row are made however many seats there are. Ties go to the smaller key.
    """
    g = Window.partitionBy(*group)
    total, n = F.sum(weight).over(g), F.count(F.lit(1)).over(g)
    first = (
        df.withColumns({"_w": F.col(weight).cast("double"), "_t": total.cast("double"), "_n": n})
        .withColumn("_free", F.col(seats) - F.col("_n") / F.lit(2.0))
        .withColumn("_a", F.when((F.col("_free") > 0) & (F.col("_t") > 0), F.floor(F.col("_w") * F.col("_free") / F.when(F.col("_t") > 0, F.col("_t")) + 0.5)).otherwise(F.lit(0)).cast("long"))
        .withColumn("_left", F.col(seats) - F.sum("_a").over(g))
    )
    tries = (
        first.where("_w > 0")
        .withColumn("_j", F.explode(F.sequence(F.lit(0), (F.floor(F.col("_n") * F.col("_w") / F.col("_t")) + 1).cast("int"))))
        .withColumn("_q", F.col("_w") / (2 * (F.col("_a") + F.col("_j")) + 1))
        .withColumn("_rank", F.row_number().over(g.orderBy(F.desc("_q"), F.asc(key), F.asc("_j"))))
    )
    kept = [c for c in df.columns]
    return (
        tries.groupBy(*kept, "_a").agg(F.sum(F.when(F.col("_rank") <= F.col("_left"), 1).otherwise(0)).alias("_more"))
        .select(*kept, (F.col("_a") + F.col("_more")).alias("quota"))
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3) -> DataFrame:
    """Per source of (source, size): ordinal, source_size, n_rows, target. One row a source; the windows over all
    sources hold these rows alone."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    every = Window.partitionBy(F.lit(0))
    per = per.withColumn("ordinal", F.row_number().over(every.orderBy(F.asc_nulls_last("source"))))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("ordinal") - 1) % len(weights) + 1)
    by_ratio = every.orderBy("ratio", "ordinal")
    return (
        per.withColumn("weight", weight)
        .withColumn("cap", repeats * F.col("source_size"))
        .withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
        .withColumn("before", F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
        .withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(every) - F.col("before")).cast("double") / F.col("open"))
        .withColumn("water", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct(F.col("ratio"), F.col("ordinal"), F.col("level")))).over(every)["level"])
        .select("source", "ordinal", "source_size", "n_rows", F.least(F.col("cap").cast("double"), F.col("water") * F.col("weight")).alias("target"))
    )


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, repeats: int = 3, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row of docs (doc_id, text, source)."""
    sizes = cut(docs.select("doc_id", "source", F.regexp_count(text_of("text"), F.lit(WORD)).cast("long").alias("size")))
    per = targets(sizes, repeats=repeats)
    b = F.lit(block_words)
    total = F.sum("source_size").over(Window.partitionBy(F.lit(0)))
    seats = apportion(per.withColumns({"all": F.lit(0), "seats": F.floor(total / F.lit(float(block_words)) + 0.5).cast("long")}), ["all"], "ordinal", "target", "seats")
    # a source without words has no quota, but its place and target
    every = per.select(F.col("source").alias("_source"), "ordinal", F.ceil(F.sqrt(F.col("n_rows").cast("double"))).cast("long").alias("n_shards"))
    sources = cut(every.join(seats.select("ordinal", "quota"), "ordinal", "left"))
    known = per.select(F.col("source").alias("_source"), "ordinal", "source_size", "target")
    sharded = (
        sizes.join(sources, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
        .withColumn("id_text", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
        .withColumn("shard", F.when(F.col("n_shards") > 0, F.pmod(_number(seed, "shard", F.col("id_text")), F.col("n_shards"))).otherwise(F.lit(0)))
    )
    line = Window.partitionBy("ordinal").orderBy("shard")  # the shards of a source: as many as the square root of its rows
    so_far = lambda w: F.floor((w + b - 1) / b).cast("long")  # blocks that begin before word w of the line
    shards = (
        sharded.groupBy("ordinal", "shard").agg(F.sum("size").alias("shard_size"), F.first("quota").alias("seats")).where("shard_size > 0 and seats is not null")
        .withColumn("base", F.sum("shard_size").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("shard_size"))
        .withColumn("first", so_far(F.col("base")))
        .withColumn("blocks", so_far(F.col("base") + F.col("shard_size")) - F.col("first"))
    )
    shards = cut(shards)
    quotas = apportion(shards, ["ordinal"], "shard", "blocks", "seats").select(F.col("ordinal").alias("_o"), F.col("shard").alias("_s"), F.col("quota").alias("shard_quota"))
    chosen = (
        shards.join(quotas, (F.col("ordinal") == F.col("_o")) & (F.col("shard") == F.col("_s")), "left").drop("_o", "_s")
        .withColumn("quota_", F.least("shard_quota", repeats * F.col("blocks")))
        .withColumn("rounds", F.when(F.col("blocks") > 0, F.floor(F.col("quota_") / F.col("blocks"))).cast("long"))
        .withColumn("rest", F.col("quota_") - F.col("rounds") * F.col("blocks"))
        .withColumn("from", F.when(F.col("blocks") > 0, F.pmod(_number(seed, "start", F.col("ordinal").cast("string"), F.col("shard").cast("string")), F.col("blocks"))))
        .withColumn("to", F.col("from") + F.col("rest"))
        # how often the last block of the shards before, which may reach into this one, is taken
        .withColumn("carried", F.last(F.col("rounds") + F.when(F.col("to") >= F.col("blocks"), 1).otherwise(0), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)))
        .select(F.col("ordinal").alias("_o"), F.col("shard").alias("_s"), "base", "first", "blocks", "rounds", "from", "to", "carried")
    )
    order = Window.partitionBy("ordinal", "shard").orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col("id_text"))), "id_text", "size")
    placed = sharded.withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("begin", F.col("end") - F.col("size"))
    joined = placed.join(chosen, (F.col("ordinal") == F.col("_o")) & (F.col("shard") == F.col("_s")), "left").withColumns({"begin": F.col("base") + F.col("begin"), "end": F.col("base") + F.col("end")})
    # words of the document in blocks lo .. hi - 1 of its source
    over = lambda lo, hi: F.greatest(F.least(F.col("end"), hi * b) - F.greatest(F.col("begin"), lo * b), F.lit(0))
    first, last = F.col("first"), F.col("first") + F.col("blocks")
    own = F.col("rounds") * over(first, last) + over(first + F.col("from"), F.least(first + F.col("to"), last)) + over(first, first + F.col("to") - F.col("blocks"))
    before = F.col("carried") * F.greatest(F.least(F.col("end"), first * b) - F.col("begin"), F.lit(0))
    taken = joined.select("doc_id", "source", "size", "ordinal", "shard", "id_text", (F.coalesce(own, F.lit(0)) + F.coalesce(before, F.lit(0))).cast("long").alias("taken"))
    full = top_up(cut(taken), word_quotas(per), repeats, seed)
    return full.join(known.withColumnRenamed("ordinal", "_o"), F.col("ordinal") == F.col("_o"), "left").select("doc_id", "source", "size", "source_size", "target", "taken")


def word_quotas(per: DataFrame) -> DataFrame:
    """ordinal and words: the integer words of each source, which add up to all words."""
    total = F.sum("source_size").over(Window.partitionBy(F.lit(0)))  # a row a source
    return apportion(per.withColumns({"all": F.lit(0), "seats": total}), ["all"], "ordinal", "target", "seats").select(F.col("ordinal").alias("_o"), F.col("quota").alias("words"))


def top_up(taken: DataFrame, words: DataFrame, repeats: int, seed: str) -> DataFrame:
    """taken (ordinal, shard, id_text, size, taken) with what its sources lack added in words, by shard and in its seeded order."""
    room = repeats * F.col("size") - F.col("taken")
    line = Window.partitionBy("ordinal").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)  # the shards of a source
    shards = taken.groupBy("ordinal", "shard").agg(F.sum("taken").alias("shard_taken"), F.sum(room).alias("room"))
    lacking = shards.withColumn("upto", F.sum("room").over(line)).withColumn("source_taken", F.sum("shard_taken").over(Window.partitionBy("ordinal")))
    lack = F.col("words") - F.col("source_taken")
    extra = F.least(F.greatest(lack - (F.col("upto") - F.col("room")), F.lit(0)), F.col("room"))
    extra = lacking.join(words, F.col("ordinal") == F.col("_o")).withColumn("extra", extra).where("extra > 0").select(F.col("ordinal").alias("_o"), F.col("shard").alias("_s"), "extra")
    order = Window.partitionBy("ordinal", "shard").orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col("id_text"))), "id_text", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = taken.withColumn("room", room).withColumn("upto", F.sum("room").over(order))
    more = F.least(F.greatest(F.col("extra") - (F.col("upto") - F.col("room")), F.lit(0)), F.col("room"))
    joined = placed.join(extra, (F.col("ordinal") == F.col("_o")) & (F.col("shard") == F.col("_s")), "left")
    return joined.select("doc_id", "source", "size", "ordinal", (F.col("taken") + F.coalesce(more, F.lit(0))).cast("long").alias("taken"))


def oracle_sql(block_words: int = BLOCK_WORDS, seed: str = SEED) -> str:
    """The rows of op5 in DuckDB's SQL."""

    def quota(name: str, rows: str, group: str, key: str, weight: str) -> str:
        return f"""
{name}_a AS (SELECT *, {weight}::DOUBLE AS w_, sum({weight}) OVER (PARTITION BY {group})::DOUBLE AS t_, count(*) OVER (PARTITION BY {group}) AS n_ FROM {rows}),
{name}_b AS (SELECT *, CASE WHEN seats - n_ / 2.0::DOUBLE > 0 AND t_ > 0 THEN floor(w_ * (seats - n_ / 2.0::DOUBLE) / t_ + 0.5)::BIGINT ELSE 0 END AS a_ FROM {name}_a),
{name}_c AS (SELECT *, seats - sum(a_) OVER (PARTITION BY {group}) AS left_ FROM {name}_b),
{name}_d AS (SELECT *, unnest(range(0, floor(n_ * w_ / t_)::BIGINT + 2)) AS j_ FROM {name}_c WHERE w_ > 0),
{name}_e AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY w_ / (2 * (a_ + j_) + 1) DESC, {key}, j_) AS r_ FROM {name}_d),
{name} AS (SELECT {group}, {key}, a_ + sum(CASE WHEN r_ <= left_ THEN 1 ELSE 0 END)::BIGINT AS quota FROM {name}_e GROUP BY {group}, {key}, a_)"""

    return f"""
WITH sizes AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_rows, row_number() OVER (ORDER BY source NULLS LAST) AS ordinal FROM sizes GROUP BY source),
p1 AS (SELECT *, (ordinal - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM per),
p2 AS (SELECT *, cap::DOUBLE / weight AS ratio, sum(source_size) OVER () AS total FROM p1),
p3 AS (SELECT *, (total - (sum(cap) OVER (ORDER BY ratio, ordinal) - cap))::DOUBLE / (sum(weight) OVER (ORDER BY ratio, ordinal ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level FROM p2),
p4 AS (SELECT *, (SELECT level FROM p3 WHERE level <= ratio ORDER BY ratio, ordinal LIMIT 1) AS water FROM p3),
targets AS (SELECT source, ordinal, source_size, n_rows, 0 AS every, least(cap::DOUBLE, water * weight) AS target, floor(total / {block_words}.0::DOUBLE + 0.5)::BIGINT AS seats FROM p4),
{quota("source_quota", "targets", "every", "ordinal", "target")},
sharded AS (SELECT s.doc_id, s.size, t.*, q.quota, coalesce(s.doc_id::VARCHAR, '') AS id_text,
  ('0x' || substr(md5('{seed}|shard|' || coalesce(s.doc_id::VARCHAR, '')), 1, 8))::BIGINT % ceil(sqrt(n_rows::DOUBLE))::BIGINT AS shard
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN source_quota q USING (ordinal)),
shard_sizes AS (SELECT ordinal, shard, sum(size)::BIGINT AS shard_size, first(quota) AS seats FROM sharded WHERE quota IS NOT NULL GROUP BY ordinal, shard HAVING sum(size) > 0),
shard_base AS (SELECT *, (sum(shard_size) OVER (PARTITION BY ordinal ORDER BY shard) - shard_size)::BIGINT AS base FROM shard_sizes),
shards AS (SELECT *, (base + {block_words} - 1) // {block_words} AS first_, (base + shard_size + {block_words} - 1) // {block_words} - (base + {block_words} - 1) // {block_words} AS blocks FROM shard_base),
{quota("shard_quota", "shards", "ordinal", "shard", "blocks")},
c1 AS (SELECT s.*, least(q.quota, 3 * blocks) AS q, ('0x' || substr(md5('{seed}|start|' || ordinal || '|' || shard), 1, 8))::BIGINT % nullif(blocks, 0) AS lo FROM shards s LEFT JOIN shard_quota q USING (ordinal, shard)),
c2 AS (SELECT *, q // nullif(blocks, 0) AS rounds FROM c1),
c3 AS (SELECT *, lo + q - rounds * blocks AS hi FROM c2),
chosen AS (SELECT *, last_value(rounds + CASE WHEN hi >= blocks THEN 1 ELSE 0 END IGNORE NULLS) OVER (PARTITION BY ordinal ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried FROM c3),
placed AS (SELECT *, sum(size) OVER (PARTITION BY ordinal, shard ORDER BY md5('{seed}|' || id_text), id_text, size ROWS UNBOUNDED PRECEDING)::BIGINT AS e_ FROM sharded),
joined AS (SELECT p.*, base + e_ - size AS b, base + e_ AS e, first_, first_ + blocks AS last_, blocks, rounds, lo, hi, carried FROM placed p LEFT JOIN chosen USING (ordinal, shard)),
taken AS (SELECT doc_id, size, source_size, target, ordinal, shard, id_text,
  (coalesce(rounds * greatest(e - greatest(b, first_ * {block_words}), 0) + greatest(least(e, least(first_ + hi, last_) * {block_words}) - greatest(b, (first_ + lo) * {block_words}), 0)
     + greatest(least(e, (first_ + hi - blocks) * {block_words}) - greatest(b, first_ * {block_words}), 0), 0)
   + coalesce(carried * greatest(least(e, first_ * {block_words}) - b, 0), 0))::BIGINT AS taken FROM joined),
by_word AS (SELECT * REPLACE (total_::BIGINT AS seats) FROM (SELECT *, sum(source_size) OVER () AS total_ FROM targets)),
{quota("word_quota", "by_word", "every", "ordinal", "target")},
room_a AS (SELECT ordinal, shard, sum(taken) AS taken, sum(3 * size - taken) AS room FROM taken GROUP BY 1, 2),
room_b AS (SELECT *, sum(room) OVER (PARTITION BY ordinal ORDER BY shard) AS upto, sum(taken) OVER (PARTITION BY ordinal) AS source_taken FROM room_a),
extra AS (SELECT r.ordinal, r.shard, least(greatest(q.quota - source_taken - (upto - room), 0), room) AS extra FROM room_b r JOIN word_quota q USING (ordinal)),
docs_room AS (SELECT t.*, 3 * size - taken AS room, sum(3 * size - taken) OVER (PARTITION BY ordinal, shard ORDER BY md5('{seed}|' || id_text), id_text, size ROWS UNBOUNDED PRECEDING) AS upto, x.extra FROM taken t LEFT JOIN extra x USING (ordinal, shard))
SELECT doc_id, size, source_size, target, (taken + coalesce(least(greatest(extra - (upto - room), 0), room), 0))::BIGINT AS taken FROM docs_room
  """

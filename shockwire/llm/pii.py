"""Personal data: spans by pattern, and terms that disclose them by corpus co-occurrence; DataFrame expressions alone.

Base spans (email, ip, card, phone) are the leftmost non-overlapping matches of each kind that pass its rule. Patterns
are written so that a text is gone over once: a run is entered at its start only and never backtracked into, which
finds the same matches. A card's pattern takes exactly the maximal runs of 16 to 19 digits.

Information-theoretic sanitisation. The base spans' values are the protected entities. A context is the CONTEXT words on
either side of an entity within its line. All counts are of one unit, unlike documents: the median of the distinct values of
MARKS smallest hashes of a document's SHINGLE-word shingles, so that copies count once and near copies hardly more, while
different records of one template are counted each. Of N in the corpus, n hold a term t, d an entity e, and c hold t in a
context of e; PMI(t; e) = log2(c N / (n d)), and the entity's information is IC(e) = log2(N / d). A term with c >=
MIN_CONTEXTS and PMI >= DISCLOSURE * IC reveals e: its occurrences in the documents that hold e are spans of kind `term`,
which sanitise() generalises (a number or a word), as base spans are replaced by their kind.

Counts cover all documents: the pairs of terms and entities come from the contexts alone, and only the terms among them
that have enough contexts, and are not already too frequent for PMI in the documents with entities, are looked for in the
corpus; the others of a document are left out in the task that reads it.

Defined results: a null text is empty and has no spans; rows that repeat a doc_id get the terms of all of them; a null
doc_id gets base spans alone; an empty table gives no rows; further columns of docs are kept by sanitise(), else not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shockwire.llm.common import WORD, cut, packed, text_of, unpacked

KINDS = ("email", "ip", "card", "phone", "term")
LABELS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]")
#: Words on either side of an entity.
CONTEXT = 10
#: Slots of a hash of terms, of which those of the terms looked for are broadcast.
SLOTS = 1 << 18
#: Words of the shingles that tell copies of a document from others.
SHINGLE, MARKS = 5, 5
MIN_CONTEXTS = 3
DISCLOSURE = 0.7

_NAME = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_NAME}]))[{_NAME}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text has to hold for the kind's pattern to be tried.
SIGNS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_SPANS = "array<struct<kind:int,start:int,end:int,value:string>>"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    d = F.reverse(_digits(v))
    each = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.when(i % 2 == 1, F.substring(d, i, F.lit(1)).cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.substring(d, i, F.lit(1)).cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10 == 0


def _byte(p: Column) -> Column:
    p = F.ltrim(p, F.lit("0"))
    return (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255"))


RULES = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), _byte),
    "card": _luhn,
    "phone": lambda v: F.length(_digits(v)).between(8, 15),
}


def _placed(text: Column, hits: Column, pattern: Column | str, kind: int) -> Column:
    """Spans of the matches `hits` of a pattern, from the lengths of what lies between them."""
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(F.char_length(g).alias("g"), F.char_length(h).alias("n")))
    # the state of a fold is copied at each step, so it holds numbers alone
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    starts = F.aggregate(steps, begin, lambda acc, x: F.struct((acc["at"] + x["g"] + x["n"]).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x["g"])).alias("out")), lambda acc: acc["out"])
    return F.zip_with(starts, hits, lambda s, h: F.struct(F.lit(kind).alias("kind"), s.alias("start"), (s + F.char_length(h)).alias("end"), h.alias("value")))


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `base`: the spans of the base kinds, by kind and start."""
    names = docs.columns
    found = docs.withColumn("_text", text_of(text))
    for kind in PATTERNS:
        hits = F.regexp_extract_all("_text", F.lit(PATTERNS[kind]), F.lit(0))
        found = found.withColumn(f"_{kind}", F.when(F.col("_text").contains(SIGNS[kind]), hits) if SIGNS[kind] else hits)
    parts = []
    for n, kind in enumerate(PATTERNS):
        hits = F.col(f"_{kind}")
        rule = RULES[kind]
        spans = F.filter(_placed(F.col("_text"), hits, PATTERNS[kind], n), lambda s: rule(s["value"]))
        parts.append(F.when(F.size(hits) > 0, spans).otherwise(F.array().cast(_SPANS)))
    return found.select(*names, F.concat(*parts).alias("base"))


def _core(word: Column) -> Column:
    """A word without what stands around its letters and digits, lowered."""
    return F.lower(F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _mark(k: int):
    return lambda w: F.xxhash64(F.lit(k), w)


def _marks(found: DataFrame) -> DataFrame:
    """found (_text, ...) with m0, m1, ...: MARKS MinHash values of a text's shingles (of all words, where they are fewer)."""
    staged = found.withColumn("_w", F.regexp_extract_all(F.lower("_text"), F.lit(WORD), F.lit(0)))
    shingles = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_w") - SHINGLE + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("_w", i, SHINGLE), " ")))
    staged = staged.withColumn("_s", shingles)
    return staged.withColumns({f"m{k}": F.array_min(F.transform("_s", _mark(k))) for k in range(MARKS)}).drop("_w", "_s")


def contexts(found: DataFrame, context: int = CONTEXT) -> DataFrame:
    """doc_id, entity, near (the cores of the words about it) and m0, m1, ... (marks of the document) of found (doc_id, text,
    base). A kind's entities cut its text into pieces; words and line ends between them form one array, in which each entity
    is an element and a context is a slice, so that work is linear in the text, however many entities it holds."""
    piece = lambda c: F.regexp_extract_all(c, F.lit(WORD + r"|\n"), F.lit(0))
    marks = [f"m{k}" for k in range(MARKS)]
    marked = cut(_marks(found.withColumn("_text", text_of("text"))))
    parts = []
    for n, kind in enumerate(PATTERNS):
        rule = RULES[kind]
        hits, gaps = F.regexp_extract_all("_text", F.lit(PATTERNS[kind]), F.lit(0)), F.split("_text", PATTERNS[kind], -1)
        entity = lambda h: F.array(F.concat(F.lit(f"\x01{kind}:"), F.lower(h)))  # noqa: B023, E731
        each = F.zip_with(gaps, hits, lambda g, h: F.concat(piece(g), F.when(h.isNull(), F.array().cast("array<string>")).when(rule(h), entity(h)).otherwise(piece(h))))  # noqa: B023
        parts.append(marked.where(F.exists("base", lambda x: x["kind"] == n)).select("doc_id", *marks, F.flatten(each).alias("t")))
    places = F.filter(F.transform("t", lambda w, i: F.when(F.startswith(w, F.lit("\x01")), i + 1)), lambda i: i.isNotNull())
    # written, so that Spark can't move the making of `t` into the loops over it
    rows = cut(reduce(DataFrame.unionByName, parts).withColumn("_at", places))
    start = lambda i: F.greatest(i - context, F.lit(1))
    sides = F.transform("_at", lambda i: F.struct(F.element_at("t", i).alias("e"), F.reverse(F.slice("t", start(i), i - start(i))).alias("left"), F.slice("t", i + 1, context).alias("right")))
    core = lambda w: _core(F.regexp_replace(w, "^\x01[a-z]+:", ""))
    until = lambda words: F.when(F.array_contains(words, "\n"), F.slice(words, F.lit(1), F.array_position(words, "\n").cast("int") - 1)).otherwise(words)
    each = F.transform(sides, lambda x: F.struct(F.substring(x["e"], F.lit(2), F.lit(1 << 30)).alias("entity"), F.array_distinct(F.transform(F.concat(F.reverse(until(x["left"])), until(x["right"])), core)).alias("near")))
    # exploded last, so that no row but a text's own holds its words
    return rows.select("doc_id", *marks, each.alias("x")).select("doc_id", *marks, F.explode("x").alias("x")).select("doc_id", "x.entity", "x.near", *marks)


def _unlike() -> Column:
    """The number of unlike documents among rows with marks."""
    return F.element_at(F.array_sort(F.array(*[F.count_distinct(f"m{k}") for k in range(MARKS)])), MARKS // 2 + 1)


def _slot(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(SLOTS))


def holders(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """m0, m1, ... (marks of a document of docs) and each term of wanted (term) that it holds; the empty term, if wanted, is held
    by all. What falls in no wanted term's slot goes before any exchange, and SLOTS bound what is broadcast, however many the terms."""
    cores = F.array_distinct(F.concat(F.transform(F.array_distinct(_words(F.col("_text"))), _core), F.array(F.lit(""))))
    # outer, as Spark makes the array twice to leave out empty ones, of which there are none
    held = _marks(docs.select(text_of("text").alias("_text"))).select(*[f"m{k}" for k in range(MARKS)], F.explode_outer(cores).alias("term"))
    slots = F.broadcast(wanted.select(_slot(F.col("term")).alias("_slot")).distinct())
    return held.join(slots, _slot(F.col("term")) == F.col("_slot"), "left_semi").join(wanted, "term", "left_semi")


def disclosing_terms(docs: DataFrame, found: DataFrame, context: int = CONTEXT, min_contexts: int = MIN_CONTEXTS, disclosure: float = DISCLOSURE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, entity) of the documents' entities, and (entity, term) of the terms that reveal them. docs: doc_id, text; found:
    those with entities, and their base spans."""
    spark = docs.sparkSession
    seen = cut(contexts(found, context))
    marks = [f"m{k}" for k in range(MARKS)]
    known = seen.groupBy("entity").agg(_unlike().alias("d")).where(F.col("d") >= min_contexts)
    terms = seen.select("entity", F.explode("near").alias("term"), *marks).where("term != ''")
    pairs = terms.groupBy("entity", "term").agg(_unlike().alias("c")).where(F.col("c") >= min_contexts)
    pairs = cut(pairs.join(known, "entity"))
    entities, none = seen.select("doc_id", "entity").distinct(), spark.createDataFrame([], "entity string, term string")
    if pairs.isEmpty():
        return entities, none
    # PMI >= disclosure * IC, of entities with an IC, is n <= c * (N / d) ** (1 - disclosure); N is the number of rows at most, and n that among the
    # documents with entities at least, so that frequent terms are told to be too frequent before the corpus is gone over
    most = F.max(F.col("c") * F.pow(F.greatest(F.lit(float(docs.count())) / F.col("d"), F.lit(1.0)), F.lit(max(1.0 - disclosure, 0.0))))
    likely = cut(pairs.groupBy("term").agg((most * (1 + 1e-6)).alias("most")))
    among = cut(holders(found, likely.select("term")).groupBy("term").agg(_unlike().alias("n")))
    likely = likely.join(among, "term", "left").where("n is null or n <= most").select("term")
    # the empty term stands for the whole, so that its n is N
    wanted = cut(likely.union(spark.range(1).select(F.lit("").alias("term"))))
    held = cut(holders(docs, wanted))
    whole = float(held.where("term = ''").agg(_unlike().alias("n")).first()["n"])
    counted = held.where("term != ''").groupBy("term").agg(_unlike().alias("n"))
    ratio = F.log2(F.try_divide(F.col("c") * F.lit(whole), F.col("n") * F.col("d")))
    ic = F.log2(F.try_divide(F.lit(whole), F.col("d")))
    revealing = pairs.join(counted, "term").where((ic > 0) & (ratio >= F.lit(disclosure) * ic)).select("entity", "term")
    return entities, cut(revealing)


def all_spans(docs: DataFrame, **parameters) -> DataFrame:
    """docs (doc_id, text, ...) with `base` and `spans` (base spans, then those of disclosing terms by start)."""
    found = base_spans(docs)
    # only documents with entities can have terms: these are kept, the others pass without an exchange
    some = cut(found.where(F.size("base") > 0))
    entities, revealing = disclosing_terms(docs.select("doc_id", "text"), some.select("doc_id", "text", "base"), **parameters)
    terms = entities.where("doc_id is not null").join(revealing, "entity").groupBy("doc_id").agg(F.collect_set("term").alias("_terms")).withColumnRenamed("doc_id", "_id")
    some = some.join(terms, F.col("doc_id") == F.col("_id"), "left").drop("_id")
    quoted = F.array_join(F.transform(F.sort_array("_terms"), lambda t: F.concat(F.lit(r"\Q"), F.replace(t, F.lit(r"\E"), F.lit("")), F.lit(r"\E"))), "|")
    some = some.withColumn("_text", text_of("text")).withColumn("_like", F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), quoted, F.lit(r")(?![\p{L}\p{N}])")))
    some = some.withColumn("_hits", F.when(F.col("_like").isNotNull(), F.regexp_extract_all("_text", F.col("_like"), F.lit(0))))
    placed = F.when(F.size("_hits") > 0, _placed(F.col("_text"), F.col("_hits"), F.col("_like"), 4)).otherwise(F.array().cast(_SPANS))
    free = F.filter(placed, lambda t: ~F.exists("base", lambda b: (t["start"] < b["end"]) & (b["start"] < t["end"])))
    some = some.withColumn("spans", F.when(F.size("_hits") > 0, F.concat("base", free)).otherwise(F.col("base"))).drop("_text", "_like", "_hits", "_terms")
    return some.unionByName(found.where(F.size("base") == 0).withColumn("spans", F.col("base")))


def said(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row of docs."""
    found = all_spans(docs.select("doc_id", "text"), **parameters)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)], F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def sanitise(docs: DataFrame, **parameters) -> DataFrame:
    """docs (doc_id, text, ...) with the spans of its text replaced: base spans by their kind, terms by [NUMBER] or [WORD].
    Of overlapping spans the first in the text is replaced, and the longest of those that start together."""
    found = all_spans(packed(docs, "doc_id", "text"), **parameters)
    labels = F.array(*map(F.lit, LABELS))
    ordered = F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"), s["value"].alias("value"))))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    some = F.size("spans") > 0
    # the places of the spans replaced, then pieces of the text's characters between them, so that each is copied once
    found = found.withColumn("_o", F.when(some, ordered)).withColumn("_chars", F.when(some, F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0))))
    end = lambda i: -F.element_at("_o", i)["back"]
    step = lambda acc, i: F.when(F.element_at("_o", i)["start"] >= acc["at"], F.struct(end(i).alias("at"), F.concat(acc["out"], F.array(i)).alias("out"))).otherwise(acc)
    found = found.withColumn("_kept", F.when(some, F.aggregate(F.sequence(F.lit(1), F.size("_o")), begin, step, lambda acc: acc["out"])))
    label = lambda s: F.when(s["kind"] < 4, F.get(labels, s["kind"])).when(s["value"].rlike("^[0-9]+$"), "[NUMBER]").otherwise("[WORD]")
    since = lambda j: F.when(j == 0, F.lit(0)).otherwise(end(F.element_at("_kept", F.greatest(j, F.lit(1)))))
    pieces = F.flatten(F.transform("_kept", lambda i, j: F.concat(F.slice("_chars", since(j) + 1, F.element_at("_o", i)["start"] - since(j)), F.array(label(F.element_at("_o", i))))))
    clean = F.array_join(F.concat(pieces, F.slice("_chars", since(F.size("_kept")) + 1, F.size("_chars"))), "")
    return unpacked(found.withColumn("text", F.when(F.size("spans") > 0, clean).otherwise(F.col("text"))), docs.columns, "doc_id", "text")

"""Each operator against brute force on small frames, and on odd rows."""

import hashlib
import io
import math
import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__
from shockwire.llm import bpe, common, fingerprints, html_text, mixing, neardup, pii, prefix_counts, quality, warc
from shockwire.llm import queries as llm_queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, n int, row string, part int, key long, size long, score double"
ODD = [
    (1, "one two three four five six", "a", 1, "r", 1, 1, 1, 1.0), (1, "one two three four five six", "a", 1, "r", 1, 1, 1, 1.0), (2, None, None, None, None, None, None, None, None),
    (3, "", "b", 0, "", 0, 0, 0, 0.0), (4, " \t\n", "b", 0, "", 0, 0, 0, 0.0), (None, "no id here but some words", None, 1, "", 1, 1, 1, 1.0), (5, "é漢字 😀 x y \x00 z", "c", 1, "", 1, 1, 1, 1.0),
    (6, "word " * 30_000, "c", 1, "", 1, 1, 1, 1.0), (7, "x" * 50_000, "c", 1, "", 1, 1, 1, 1.0), (1, "another text under an id that stands already", "a", 1, "", 1, 1, 1, 1.0),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(llm_queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = llm_queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(f"select {', '.join(cols)} from ({llm_queries.oracle_sql()[name]})").fetchall()
    key = lambda r: repr(r)
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=key) == sorted(want, key=key)


def test_queries_are_registered():
    names = set(__spark_entry__.queries())
    assert {"pipeline", "op2_neardup", "op3_token_counts", "op4_quality", "op5_mixing", "op6_pii", "op7_bpe", "op8_fingerprints", "op9_html_text", "op10_warc", "op11_filter_audit", "op12_ranked_search", "op13_line_dedup"} <= names


# 2


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                if i != j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and label[j] < label[i]:
                    label[i], changed = label[j], True
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_neardup_families(spark):
    """Copies, chains and families of near copies about the threshold."""
    rnd, rows = random.Random(5), []
    for family in range(6):
        base = [f"w{family}_{k}" for k in range(rnd.choice((12, 60, 150)))]
        for _ in range(25):
            words = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 15))):
                words[rnd.randrange(len(words))] = f"e{rnd.random()}"
            rows.append((len(rows) * 3 + 1, " ".join(words)))
    rows += [(1000 + k, "Exactly the same text as others have it") for k in range(40)] + [(2000, "EXACTLY the same text as others have it"), (2001, "two words"), (2002, "two  words"), (2003, "two words more"), (2004, None), (2005, " ")]
    want = brute_components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == want


def test_neardup_odd(odd, none):
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == len(ODD) and neardup.near_duplicates(none).count() == 0
    by = {r.doc_id: r for r in rows}
    assert by[None].component_id is None and by[None].kept
    assert by[2].n_shingles == by[3].n_shingles == by[4].n_shingles == 0 and by[3].component_id == 3
    assert all(r.component_id == 1 and r.kept for r in rows if r.doc_id == 1)
    assert by[6].n_shingles == 1


def test_pigeonhole_keys():
    """Signatures that differ in fewer than CHUNKS * (ERRORS + 1) symbols share a key, wherever they differ; one more
    difference, two in each chunk, leaves none."""
    rnd = np.random.default_rng(1)
    most = neardup.CHUNKS * (neardup.ERRORS + 1) - 1
    for n in [most] * 300 + [5, 15, 25]:
        a = rnd.integers(0, 2**32, neardup.SYMBOLS, dtype=np.uint32)
        b = a.copy()
        b[rnd.choice(neardup.SYMBOLS, n, replace=False)] ^= np.uint32(1)
        assert set(neardup.keys(a)) & set(neardup.keys(b))
    worst = np.arange(neardup.SYMBOLS) % neardup.WIDTH <= neardup.ERRORS
    for free in range(neardup.CHUNKS):  # all chunks but one have two differences, that one has one
        b = a ^ worst.astype(np.uint32)
        b[free * neardup.WIDTH] = a[free * neardup.WIDTH]
        assert set(neardup.keys(a)) & set(neardup.keys(b))
    assert not set(neardup.keys(a)) & set(neardup.keys(a ^ worst.astype(np.uint32)))


# 3


def test_prefix_counts_every_prefix():
    sp, c = sentencepiece.SentencePieceProcessor(model_file=P.path(prefix_counts.MODEL)), prefix_counts.counter(P.path(prefix_counts.MODEL))
    rnd = random.Random(2)
    bits = [*"ab  the\n\t▁éß漢字😀\x00'12", "tion", "ing", " of", "Straße", "    "]
    for _ in range(300):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25)))
        assert list(np.cumsum(np.frombuffer(c.changes(text), np.int8), dtype=int)) == [len(sp.encode(text[:k])) for k in range(1, len(text) + 1)]


def test_prefix_counts_odd(odd, none):
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path(prefix_counts.MODEL))
    counted = prefix_counts.prefix_counts(odd)
    rows = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in counted.collect())
    assert rows == sorted((i or 0, len((t or "").encode()), len(sp.encode(t or ""))) for i, t, *_ in ODD)
    assert prefix_counts.prefix_counts(none).count() == 0


def test_budgets(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path(prefix_counts.MODEL))
    text = "A sentence of ordinary words, cut somewhere."
    counted = prefix_counts.prefix_counts(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    for k in (0, 1, 7, 20, 500):
        assert prefix_counts.tokens_at(counted.withColumn("k", F.lit(k)), "k").first().tokens_at == len(sp.encode(text[:k]))
    for most in (0, 1, 5, 100):
        n = prefix_counts.longest_within(counted.withColumn("k", F.lit(most)), "k").first().longest_within
        assert len(sp.encode(text[:n])) <= most and all(len(sp.encode(text[:m])) > most for m in range(n + 1, len(text) + 1))


# 4


def test_quality_held_out(spark):
    rows = llm_queries.op4_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    auc = np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good])
    assert auc > 0.98
    assert np.mean([(r.predicted == r.quality) for r in rows]) > 0.95


def test_quality_split(spark):
    import zlib

    rows = llm_queries.op4_quality(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)


def test_training_is_ftrl():
    """Against follow-the-regularised-leader written for one coordinate at a time."""
    rnd = random.Random(3)
    rows = [(" ".join(rnd.choice("good fine 12 Bad ugly, x".split()) for _ in range(rnd.randint(0, 12))), rnd.randint(0, 1)) for _ in range(60)]
    z, n, words = Counter(), Counter(), quality._Words()
    weight = lambda k: 0.0 if abs(z[k]) <= quality.L1 else -(z[k] - np.sign(z[k]) * quality.L1) / ((quality.BETA + n[k] ** 0.5) / quality.ALPHA + quality.L2)
    for _ in range(3):
        for text, label in rows:
            x = Counter({1 << quality.BITS: 1.0})
            for kind in quality.features(text, words):
                for k in kind.tolist():
                    x[k] += 1 / len(kind)
            w = {k: weight(k) for k in x}
            p = 1 / (1 + np.exp(-sum(w[k] * x[k] for k in x)))
            for k, v in x.items():
                g = (p - label) * v
                z[k] += g - ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / quality.ALPHA * w[k]
                n[k] += g * g
    got, bias = quality.train(rows, epochs=3)
    assert abs(bias - weight(1 << quality.BITS)) < 1e-9 and all(abs(got[k] - weight(k)) < 1e-6 for k in z if k < 1 << quality.BITS)
    assert np.count_nonzero(got) <= len(z)


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k, "word " * 100) for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    assert quality.fit(docs, labels, max_chars=499)[1] == 0.0  # no text fits
    one = quality.fit(docs, labels, max_chars=500)
    assert one[1] == quality.fit(docs, labels, max_rows=1)[1] != quality.fit(docs, labels)[1]


def test_shapes_of_whole_words():
    assert quality.shape("a" * 70 + "%%%%" + "b" * 70) == "a%%%%a" and quality.shape("x" * 70 + "123456789" + "Y" * 70) == "a0A"


def test_a_long_text_leaves_the_others_in(spark):
    """A labelled text beyond the bound, wherever the hash places it, changes nothing but its own absence."""
    rows = [(i, ("good words " if i % 2 else "bad ones 12 ") * 20) for i in range(0, 60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(90)], "doc_id long, quality int")
    docs = lambda extra: spark.createDataFrame(rows + extra, "doc_id long, text string")
    want = quality.fit(docs([]), labels, max_chars=50_000)
    got = quality.fit(docs([(i, "long text " * 6_000) for i in range(60, 90)]), labels, max_chars=50_000)
    assert want[0].any() and np.array_equal(want[0], got[0]) and want[1] == got[1]


def test_quality_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 0), (3, 0), (6, 1), (9, 1)], "doc_id long, quality int")
    model = quality.fit(odd, labels)
    rows = quality.score(odd, model)
    assert rows.columns == [*[c for c in odd.columns if c != "score"], "score"] and rows.count() == len(ODD)
    assert quality.score(none, model).count() == 0
    assert {r.score for r in quality.score(odd, quality.fit(odd, labels.limit(0))).collect()} == {0.5}


# 5


def test_mixing_reaches_targets(spark):
    rnd = random.Random(1)
    rows = [(k, "w " * rnd.randint(1, 400), rnd.choice(["a"] * 6 + ["b", "c", "d", None])) for k in range(1500)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by, size, target = Counter(), {}, {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        by[r.source] += r.taken
        size[r.source], target[r.source] = r.source_size, r.target
    total = sum(size.values())
    assert abs(sum(target.values()) - total) < 1e-6 * total
    for s, t in target.items():
        assert t <= 3 * size[s] + 1e-6 and abs(by[s] - t) <= 0.02 * t + 2 * mixing.BLOCK_WORDS
    again = mixing.mix(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string")).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_mixing_short_texts(spark):
    """No words are lost in short blocks, however short texts, shards and sources are."""
    rnd = random.Random(7)
    rows = [(k, "w " * n, s) for k, (s, n) in enumerate([("a", 5)] * 900 + [("b", 5)] * 300 + [("c", 1)] * 400 + [("d", 3)] * 40 + [("e", rnd.randint(0, 9)) for _ in range(300)])]
    by, facts = Counter(), {}
    for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        assert 0 <= r.taken <= 3 * r.size
        by[r.source] += r.taken
        facts[r.source] = r.target
    assert all(abs(by[s] - t) <= 2 * mixing.BLOCK_WORDS for s, t in facts.items()), (by, facts)


@pytest.mark.parametrize("sizes", [[3] * 60, [1] * 7, [5, 17, 40, 0, 3, 250, 16, 15], [2, 2, 4000]])
def test_sources_below_a_block(spark, sizes):
    """Sources of a few words take all the words that are theirs: no source is short by a word, the whole by none."""
    rows = [(1000 * k + i, "w " * n, f"s{k:02d}") for k, size in enumerate(sizes) for i, n in enumerate([size // 3, size // 3, size - 2 * (size // 3)])]
    by, target = Counter(), {}
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for r in mixing.mix(docs).collect():
        assert 0 <= r.taken <= 3 * r.size
        by[r.source] += r.taken
        target[r.source] = r.target
    assert all(by[s] - t > -1 and by[s] - t <= 2 * mixing.BLOCK_WORDS for s, t in target.items()), (by, target)
    assert sum(sizes) <= by.total()
    if len(sizes) == 60:
        assert all(abs(by[s] - t) < 1 for s, t in target.items()) and by.total() == 180
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = con.sql(f"select doc_id, taken from ({mixing.oracle_sql()})").fetchall()
    assert sorted(want) == sorted((r.doc_id, r.taken) for r in mixing.mix(docs).collect())


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_mixing_of_given_tables(spark, sf):
    by = llm_queries.op5_mixing(spark, f"/root/testdata/sf{sf}").groupBy("target", "source_size").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= max(0.01 * r.target, 2 * mixing.BLOCK_WORDS) for r in by)


def test_apportion_is_sainte_lague(spark):
    rnd = random.Random(4)
    rows = [(g, k, rnd.randint(0, 1000), seats) for g, seats in ((0, 7), (1, 100), (2, 3), (3, 0)) for k in range(9)]
    got = {(r.g, r.k): r.quota for r in mixing.apportion(spark.createDataFrame(rows, "g int, k int, w long, seats long"), ["g"], "k", "w", "seats").collect()}
    for g, seats in ((0, 7), (1, 100), (2, 3), (3, 0)):
        want, weights = Counter(), {k: w for gg, k, w, _ in rows if gg == g}
        for _ in range(seats):
            want[max(weights, key=lambda k: (weights[k] / (2 * want[k] + 1), -k))] += 1
        assert {k: got.get((g, k), 0) for k in weights} == {k: want[k] for k in weights}


def test_mixing_odd(odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD) and all(r.taken == 0 for r in rows if r.size == 0) and all(0 <= r.taken <= 3 * r.size for r in rows)
    assert mixing.mix(none).count() == 0
    assert {r.taken for r in mixing.mix(odd.where("size = 0")).collect()} == {0}


# 6

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, value):
    d = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def base_of(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k in PATTERNS for m in re.finditer(PATTERNS[k], text) if passes(k, m.group()))


def test_pii_base(spark, odd, none):
    rnd = random.Random(3)
    bits = [*"a.@-_+ 0123456789()é😀\n%", "4532015112830366", "1.2.3.4", "a@b.c", "+1 (23) 4567890", "a@b.c_x@d.e", "4532-0151-1283-0366 ", "256.1.1.1", "001.2.3.4"]
    rows = [(k, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40)))) for k in range(600)] + [(9000, "1" * 30_000), (9001, "a" * 60_000 + " b@c.d " + "+1" * 3000)]
    got = pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = dict(rows)
    for r in got:
        base = base_of(want[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans.startswith(base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(base.count(f"{k}:") for k in PATTERNS)
    assert pii.report(odd).count() == len(ODD) and pii.report(none).count() == 0
    assert pii.sanitise(odd).columns == odd.columns and pii.sanitise(odd).count() == len(ODD)


def test_pii_disclosing_terms(spark):
    rnd = random.Random(8)
    some = lambda n: " ".join(f"word{rnd.randrange(300)}" for _ in range(n))
    rows = [(k, f"{some(6)} Zoltan {some(3)} zk@mail.example {some(5)}") for k in range(6)] + [(10 + k, some(30)) for k in range(400)]
    rows += [(7, "Zoltan wrote zk@mail.example hello. ZOLTAN! 4532015112830366"), (8, "Zoltan alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    assert got[7] == "email:13:28,card:44:60,term:0:6,term:36:42"
    assert got[3].count("term") == 1 and got[8] == "" and got[20] == ""
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[7] == "[WORD] wrote [EMAIL] hello. [WORD]! [CARD]" and clean[8] == "Zoltan alone"
    odd = [(1, "😀 é\n a@b.cd 😀漢 4532015112830366\n😀"), (2, "a@b.cd"), (3, None), (4, "x")]
    assert {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(odd, "doc_id long, text string")).collect()} == {1: "😀 é\n [EMAIL] 😀漢 [CARD]\n😀", 2: "[EMAIL]", 3: None, 4: "x"}
    near = [(k, f"Zoltan Kovacs the second of his name is at zk@mail.example now and then, edit{k}") for k in range(4)]
    copies = spark.createDataFrame([(k + 500, "Zoltan Kovacs is at zk@mail.example now") for k in range(9)] + near + rows[6:50], "doc_id long, text string")
    assert not [r for r in pii.report(copies).collect() if "term" in r.spans]


def test_pii_templates_and_copies(spark):
    """Records of one template are evidence each; copies and near copies of a document are one."""
    rnd = random.Random(2)
    some = lambda n: " ".join(f"word{rnd.randrange(300)}" for _ in range(n))
    records = [(k, f"Contact note {k} mister Zoltan uses zk@mail.example today for case {k}") for k in range(6)]
    rest = [(100 + k, some(30)) for k in range(400)]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(records + rest, "doc_id long, text string")).collect()}
    assert all("term:" in got[k] for k in range(6)) and not any("term" in got[k] for k, _ in rest)
    base = f"{some(60)} mister Zoltan uses zk@mail.example today {some(60)}"
    near = [(k, base + f" edit{k}") for k in range(5)] + [(10 + k, base) for k in range(9)]
    assert not [r for r in pii.report(spark.createDataFrame(near + rest, "doc_id long, text string")).collect() if "term" in r.spans]


@pytest.mark.parametrize("copies", [1, 50, 1000])
def test_pii_copies_hide_nothing(spark, copies):
    """The spans of six records are the same, however often each record, or each other document, is copied."""
    rnd = random.Random(3)
    some = lambda n: " ".join(f"word{rnd.randrange(300)}" for _ in range(n))
    records = [f"{some(6)} Zoltan {some(3)} zk@mail.example {some(5)}" for _ in range(6)]
    rest = [some(30) for _ in range(200)]
    told = [r.spans for r in pii.report(spark.createDataFrame(list(enumerate(records + rest)), "doc_id long, text string")).collect()]
    assert sum("term" in x for x in told) == 6
    once = set(told)
    rows = list(enumerate(records * copies + rest * min(copies, 20)))
    assert {r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == once


def _shuffled(spark, since=-1):
    """Bytes that stages after `since` have written for exchanges, and the last stage."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    told = [(s.stageId(), s.shuffleWriteBytes()) for s in (stages.apply(k) for k in range(stages.size()))]
    return sum(n for k, n in told if k > since), max((k for k, _ in told), default=-1)


def test_pii_exchanges_no_other_terms(spark):
    """Of the corpus, the terms that may reveal an entity alone are exchanged; neither words that stand by none nor frequent ones."""
    rnd = random.Random(4)
    some = lambda n: " ".join(f"word{rnd.randrange(40_000)} the" for _ in range(n))
    records = [(k, f"{some(3)} Zoltan the zk@mail.example {some(5)}") for k in range(6)]
    rest = [(100 + k, some(300) + (f" by a{k}@mail.example" if k % 4 == 0 else "")) for k in range(1200)]
    docs = spark.createDataFrame(records + rest, "doc_id long, text string").repartition(4).localCheckpoint()
    _, last = _shuffled(spark)
    got = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    moved, _ = _shuffled(spark, last)
    assert all(got[k].count("term:") == 1 for k in range(6)) and not any("term" in got[k] for k, _ in rest)
    assert moved < 0.3 * sum(len(t) for _, t in rest), moved


def test_disclosure_by_brute_force(spark):
    """Which terms reveal which entities, from counts of unlike documents made one by one: each text here is one, or a copy."""
    rnd = random.Random(6)
    names = ["Zoltan", "Imre", "(Vera)", "river", "market", "report", "the"]
    rows = []
    for k in range(400):
        words = [rnd.choice(names[3:]) if rnd.random() < 0.3 else f"w{rnd.randrange(900)}" for _ in range(14)]
        if k % 8 == 0:
            who = rnd.randrange(3)
            words[5:5] = [names[who] if rnd.random() < 0.9 else "market", f"mail{who}@mail.example"]
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, rows[k % 40][1]) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.base_spans(docs).where(F.size("base") > 0)
    _, revealing = pii.disclosing_terms(docs, found)
    texts = {t for _, t in rows}
    core = lambda w: re.sub(r"^\W+|\W+$", "", w).lower()
    holds, d, c = Counter(), Counter(), Counter()
    for t in texts:
        words = t.split()
        holds.update({core(w) for w in words})
        for k, w in enumerate(words):
            if "@" in w:
                d[w] += 1
                c.update({(w, core(v)) for v in words[max(0, k - 10) : k] + words[k + 1 : k + 11]})
    size, want = len(texts), set()
    for (e, t), n in c.items():
        if n >= 3 and d[e] >= 3 and math.log2(n * size / (holds[t] * d[e])) >= 0.7 * math.log2(size / d[e]) > 0:
            want.add((f"email:{e}", t))
    assert {(r.entity, r.term) for r in revealing.collect()} == want and len(want) >= 3


def test_contexts_by_brute_force(spark):
    rnd = random.Random(5)
    bits = ["alpha", "beta,", "(gamma)", "\n", " \n", "zk@mail.example", "<b@c.org>,", "1.2.3.4", "999.1.1.1", "+1 2345 67890", "delta"]
    rows = [(k, " ".join(rnd.choice(bits) for _ in range(rnd.randint(0, 60)))) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.entity, tuple(r.near)) for r in pii.contexts(pii.base_spans(docs), 3).collect())
    want = Counter()
    core = lambda w: re.sub(r"^[^\w]+|[^\w]+$", "", w).lower()
    for i, text in rows:
        for kind, pattern in PATTERNS.items():
            hits = [m for m in re.finditer(pattern, text)]
            pieces, at = [], 0
            for m in hits:
                pieces += re.findall(r"[^\x20\x09-\x0D]+|\n", text[at : m.start()]) + ([m] if passes(kind, m.group()) else re.findall(r"[^\x20\x09-\x0D]+|\n", m.group()))
                at = m.end()
            pieces += re.findall(r"[^\x20\x09-\x0D]+|\n", text[at:])
            for k, m in enumerate(pieces):
                if not isinstance(m, str):
                    left, right = pieces[max(0, k - 3) : k], pieces[k + 1 : k + 4]
                    if "\n" in left:
                        left = left[len(left) - left[::-1].index("\n") :]
                    right = right[: right.index("\n")] if "\n" in right else right
                    words = [core(w if isinstance(w, str) else w.group()) for w in left + right]
                    want[i, f"{kind}:{m.group().lower()}", tuple(dict.fromkeys(words))] += 1
    assert got == want


def test_many_entities_in_one_text(spark):
    """Linear, but for copies of references: four times the entities take less than eight times as long."""
    took = []
    for n in (4_000, 16_000):
        text = " ".join(f"name{k}@mail{k % 7}.example" for k in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.perf_counter()
        assert pii.report(docs).first().n_email == n
        assert pii.sanitise(docs).first().text == " ".join(["[EMAIL]"] * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] and took[1] < 120, took


# 7


def test_bpe_round_trip(spark, odd, none):
    enc, _ = bpe.tokenizer(P.path(bpe.RANKS))
    rnd = random.Random(6)
    bits = [*"ab  \n\t  é漢😀'12²½\x1c\x85٣", "'s", "'ll", " of", "\r\n", "<|endoftext|>", "thing"]
    rows = [(k, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40)))) for k in range(300)]
    for size in (10, bpe.MAX_WORDS):
        got = {r.doc_id: r for r in bpe.decode(bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), max_words=size)).collect()}
        for k, t in rows:
            assert list(got[k].ids) == enc.encode_ordinary(t) and bytes(got[k].bytes) == t.encode()
    rows = bpe.digests(bpe.encode(odd, decoded=True)).collect()
    assert sorted((r.doc_id or 0, r.decoded_sha256) for r in rows) == sorted((i or 0, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in ODD)
    assert bpe.encode(none).count() == 0


def test_another_order_raises():
    """Documents whose words are numbered otherwise than those sent out, with words of one length, are found out."""
    batch = lambda texts: bpe.pa.RecordBatch.from_arrays([bpe.pa.array(range(len(texts))), bpe.pa.array(texts), bpe.pa.array([0] * len(texts))], names=["doc_id", "text", "split"])
    words = [b for b in bpe._encode_words(P.path(bpe.RANKS))(bpe._split(1, 100)(iter([batch(["one two", "six ten"])])))]
    for texts, fails in ((["one two", "six ten"], False), (["six ten", "one two"], True)):
        rows = words + list(bpe._split(None, 100)(iter([batch(texts)])))
        if fails:
            with pytest.raises(ValueError, match="twice alike"):
                list(bpe._reassemble(P.path(bpe.RANKS), True)(iter(rows)))
        else:
            assert [bytes(x) for b in bpe._reassemble(P.path(bpe.RANKS), True)(iter(rows)) for x in b.column(2).to_pylist()] == [t.encode() for t in texts]


def test_packed_numbers():
    x = np.array([0, 5, 127, 128, 16383, 16384, 1 << 20])
    assert list(bpe.unpack(bpe.pack(x))) == list(x) and list(bpe.unpack(b"")) == []


# 8


def test_fingerprints(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order, error = sorted(rows), []

    def likeness(a, b):
        a, b = Counter(a.split()), Counter(b.split())
        return sum((a & b).values()) / max(1, sum((a | b).values()))

    for k, (i, t) in enumerate(order):
        after, h, r = order[(k + 1) % len(order)][1], len(t) // 2, got[i]
        edited = t[: len(t) - h] + after[:h]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        error += [r.near_edited - likeness(t, edited), r.near_next - likeness(t, after)]
    assert abs(np.mean(error)) < 0.02 and np.sqrt(np.mean(np.square(error))) < 0.1
    prints = {}
    for i, t in rows:
        assert prints.setdefault(t, got[i].fingerprint) == got[i].fingerprint


@pytest.mark.parametrize("n", [20_000, 200_000])
def test_likeness_of_long_texts(spark, n):
    rnd, ranks = random.Random(n), range(1, 100_001)
    counts = [Counter(f"w{k}" if k <= 100 else f"{side}{k}" for k in rnd.choices(ranks, [1 / k for k in ranks], k=n)) for side in "xy"]
    exact = sum((counts[0] & counts[1]).values()) / sum((counts[0] | counts[1]).values())
    words = spark.createDataFrame([(side, w, c) for side in (0, 1) for w, c in counts[side].items()], "id int, word string, n int").selectExpr("id", "0 AS part", "explode(array_repeat(word, n)) AS word")
    marks = {(r.id, r.lane): r.marks_0 for r in fingerprints.fingerprint_words(words, ["id"], 512).collect()}
    equal = [a == b for lane in range(64) for a, b in zip(marks[0, lane], marks[1, lane], strict=True)]
    assert abs(sum(equal) / 512 - exact) < 0.06  # of 512 samples, nearly three standard deviations


def test_draws_are_gamma(spark):
    """The least of a over terms of weight w is exponential with rate w per term; r and c follow Gamma(2, 1) in their tails."""
    r = fingerprints._gamma
    h, g = F.xxhash64("id"), F.xxhash64("id", F.lit(1))
    x = np.array([row[0] for row in spark.range(400_000).select(r(F.shiftrightunsigned(h, 24), 1 + fingerprints._between(g, 0, 32), 1 + fingerprints._between(g, 32, 32))).collect()])
    tail = lambda v: (1 + v) * np.exp(-v)
    for v in (0.01, 0.1, 0.5, 1, 2, 4, 8, 10):
        p = tail(v)
        assert abs((x > v).mean() - p) < 5 * np.sqrt(p * (1 - p) / len(x)) + 1e-5
    a = fingerprints.samples_of(F.col("id"), F.lit(3), F.lit(0.0), F.log(F.lit(7.0)))
    got = np.array([tuple(row) for row in spark.range(200_000).select(*a).collect()])
    for k, w in ((0, 1), (1, 7)):
        e = np.exp(got[:, k]) * w
        assert all(abs((e > v).mean() - np.exp(-v)) < 5 * np.sqrt(np.exp(-v) / len(e)) for v in (0.001, 0.01, 0.1, 1, 3))
    assert spark.range(3).select(fingerprints.samples_of(F.col("id"), F.lit(0), F.lit(None).cast("double"))[0].alias("a")).where("a is not null").count() == 0


def test_sampler_by_brute_force(spark):
    """Marks against samples drawn one by one, from the hashes Spark gives."""
    words = [(d, 0, w) for d, text in enumerate(("a b a c a", "b c d d d d d d d", "a", "z y x w v u z y z")) for w in text.split()]
    got = {(r.d, r.lane): r.marks_0 for r in fingerprints.fingerprint_words(spark.createDataFrame(words, "d int, part int, word string"), ["d"], 16).collect()}
    named = spark.createDataFrame(sorted({(w,) for *_, w in words}), "word string").select("word", F.xxhash64("word").alias("term")).crossJoin(spark.range(16).select(F.col("id").cast("int").alias("k")))
    hashes = {(r.word, r.k): (r.h, r.g, r.f) for r in named.withColumn("h", F.xxhash64("term", "k")).withColumn("g", F.xxhash64("h")).withColumn("f", F.xxhash64("g")).collect()}
    bits = lambda x, at, n: ((x & (2**64 - 1)) >> at & (2**n - 1)) / 2**n + 0.5 / 2**n

    def second(x):
        places = [k for k in range(64) if x >> k & 1]
        return places[1] + 1 if len(places) > 1 else 64

    def a(word, k, weight):
        h, g, f = (x & (2**64 - 1) for x in hashes[word, k])
        r = second(h >> 24) - np.log2((1 + bits(g, 0, 32)) * (1 + bits(g, 32, 32)))
        c = second(f >> 46) - np.log2((1 + bits(f, 0, 23)) * (1 + bits(f, 23, 23)))
        b = bits(h, 0, 24)
        r, c = r * np.log(2), c * np.log(2)
        return np.log(c) - r * (np.floor(np.log(weight) / r + b) - b + 1)

    winners = {}
    for d in range(4):
        counts = Counter(w for x, _, w in words if x == d)
        for k in range(16):
            word = min(counts, key=lambda w: a(w, k, counts[w]))  # noqa: B023
            winners.setdefault((k, word, round(a(word, k, counts[word]), 3)), set()).add(got[d, k // 8][k % 8])
    assert all(len(marks) == 1 for marks in winners.values())  # equal samples, equal marks
    assert len({(k, min(m)) for (k, *_), m in winners.items()}) >= len(winners) - 1  # and unequal ones


def test_fingerprints_odd(spark, odd, none):
    rows = fingerprints.fingerprint(odd).collect()
    assert len(rows) == len(ODD) and fingerprints.fingerprint(none).count() == 0
    assert [r.near_next for r in rows if r.doc_id is None] == [None]
    assert len({r.fingerprint for r in rows if r.doc_id in (2, 3, 4)}) == 1
    single = fingerprints.fingerprint(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert single.near_next == 1.0 and single.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


# 9

PAGES = "page_id long, url string, html string, text string, lines int"


def test_main_text():
    prose = "An ordinary sentence of the article itself. " * 4
    page = f'<html><head><title>T</title><style>p{{}}</style></head><body><header>Top</header><nav class="x"><ul><li><a href="/a">Home</a></li></ul></nav><div id="cookie-notice"><p>{prose}</p></div><div class="content"><h1>Title &amp; more</h1><p>{prose}wor<b>ld</b> a &lt; b</p><!-- {prose} --><p>short\n  one</p><script>var x = "</p>";</script></div><section class="comments"><p>{prose}</p></section><aside><p>{prose}</p></aside><form><label>Mail</label></form><footer>&copy; x</footer></body></html>'
    want = f"Title & more\n{' '.join(prose.split())} world a < b\nshort one"
    assert html_text.main_text(page) == want
    assert html_text.main_text(page.replace('div class="content"', "article").replace("</div><section", "</article><section")) == want
    assert html_text.main_text("") == html_text.main_text("<div><script>x</script></div>") == ""
    assert html_text.main_text("<p>tiny</p>") == "tiny"
    assert html_text.main_text("plain text & no markup") == "plain text & no markup"


def test_named_article_is_weighed():
    prose = " ".join(["An ordinary sentence of the article itself."] * 9)
    links = "".join(f'<p><a href="/{k}">Read more of story {k} here</a></p>' for k in range(4))
    page = f"<body><p>Short line</p><article><h1>Title</h1><p>{prose}</p>{links}<p>{prose}</p></article><div><p>{prose} outside</p></div><p>Our site</p></body>"
    assert html_text.main_text(page) == f"Title\n{prose}\n{prose}\n{prose} outside\nOur site"
    assert html_text.main_text("<p>Welcome to the pages of our house.</p><article><p>one</p><p>two</p><p>three</p><p>four is the last line</p></article>") == "one\ntwo\nthree\nfour is the last line"


def test_headings_and_paragraphs_stay():
    prose = " ".join(["An ordinary sentence of the article itself."] * 9)
    page = f'<main><article><h1>T</h1><p>{prose}</p><h2 id="related-work">Related work</h2><p class="social">{prose} a</p><section id="search-methods"><p>{prose} b</p></section><div class="related-posts"><p>{prose} no</p></div><div class="share-links">x</div></article></main><article><p>Teaser of another story</p></article>'
    assert html_text.main_text(page) == f"T\n{prose}\nRelated work\n{prose} a\n{prose} b"


def test_stretches_by_brute_force():
    """Surge and dive against sums made line by line, and stretches by their definition."""
    rnd = random.Random(12)
    for _ in range(400):
        n = rnd.randint(0, 14)
        weight, inside = [rnd.choice((0, 0, 3, 30, 90)) for _ in range(n)], sorted(rnd.random() < 0.5 for _ in range(n))
        total = [0] * n
        for k in range(n):
            for m in range(k, min(n, k + html_text.WINDOW)):
                if inside[m] == inside[k]:
                    total[k] += weight[m]
        surge = min(html_text.SURGE, max(total, default=0))
        want = set()
        for k in range(n):
            if total[k] and total[k] >= surge:
                before = [j for j in range(k) if all(weight[i] and inside[i] == inside[k] for i in range(j, k))]
                after = [j for j in range(k, n) if all(total[i] and inside[i] == inside[k] for i in range(k, j + 1))]
                want |= {j for j in before + after if weight[j]}
        assert set(html_text.stretches(weight, inside)) == want, (weight, inside)


def test_tokens_by_brute_force():
    """Against a scan that looks at each tag by itself."""
    rnd = random.Random(13)
    for _ in range(3000):
        page, at, want = "".join(rnd.choice(["<a ", "<b>", '"', "'", ">", "x", "</p>", "<!-- ", "-->"]) for _ in range(rnd.randint(0, 14))), 0, []
        while at < len(page):
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                end = len(page) if end < 0 else end + 3
            elif re.match("</?[a-z]", page[at:]):
                m = re.compile(r"""<(?:[^>"']|"[^"]*"|'[^']*')*>""").match(page, at)
                end = m.end() if m else page.find(">", at) + 1
            else:
                end = 0
            if end:
                want.append((at, end))
            at = end or at + 1
        assert list(html_text.tokens(page)) == want, page


@pytest.mark.parametrize("bit", ['<a "', "<a \"'>", "<nav><footer>", "<nav><div></p>", "<!--", "<![CDATA[", "<a", "<p>x", "&amp;", "<nav><article><p>"])
def test_long_malformed_pages(bit):
    """A megabyte of each takes about a second; at quadratic cost it would take an hour."""
    began = time.perf_counter()
    html_text.main_text(bit * (1_000_000 // len(bit)))
    assert time.perf_counter() - began < 20


def test_pages_odd(spark):
    rows = [(1, "u", "<article><p>a</p></article>", "x", 1), (1, "u", "<article><p>a</p></article>", "x", 1), (None, None, None, None, None), (2, None, "", "", 0), (3, "v", "<p>" + "word " * 50_000, "", 0), (4, "w", "<" * 1000, "", 0)]
    got = html_text.extract(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == sorted([(1, 1), (1, 1), (0, 0), (2, 0), (3, 249_999), (4, 1000)])
    assert html_text.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_given_pages(spark):
    for r, p in zip(html_text.extract(spark.read.parquet(f"{SF}/pages.parquet")).orderBy("page_id").collect(), spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").collect(), strict=True):
        body = re.search("<article>(.*?)</article>", p.html, re.S)[1]
        parts = [" ".join(html_text.html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)[^>]*>", body)]
        assert r.text == "\n".join(x for x in parts if x)


# 10


def test_warc(spark, tmp_path):
    long = "same payload " * 20
    rows = [(5, "http://www.Example.com:8080/b?x=1#y", long), (2, "http://a.example.com/\r\nX: y", long), (9, None, long), (3, "u", "short"), (4, "u", "short"), (6, "bad[url", None), (None, "http://z.example/", long), (7, "http://crlf.example/", "a\r\n\r\nb" * 30), (7, "http://crlf.example/", "a\r\n\r\nb" * 30)]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, digest string, archive int")
    got = sorted(((r.page_id if r.page_id is not None else 99), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = [((i if i is not None else 99), len((t or "").encode()), sha(t), "revisit" if t == long and i != 2 else "response", 2 if t == long and i != 2 else None) for i, _, t in rows]
    assert got == sorted(want, key=lambda r: tuple(-1 if x is None else x for x in r)) or sorted(map(repr, got)) == sorted(map(repr, want))
    captures = warc.write(warc.plan(pages), str(tmp_path), archive_bytes=200)
    assert captures.select("archive").distinct().count() > 1
    facts = warc.read_files(spark, str(tmp_path))
    assert facts.count() == len(rows) and warc.resolve(facts).where("payload_digest is null").count() == 0
    one = warc.look_up(spark.createDataFrame([(3, "u"), (77, "nothing"), (3, "u")], "page_id long, url string"), warc.build_index(captures)).collect()
    assert [r.page_id for r in one] == [3]
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_index_of_many(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), (F.col("id") % 7).cast("string"), F.lit(".example/"), F.expr("repeat('long', int(id % 2) * 80)"), F.col("id").cast("string")).alias("url"), F.concat(F.lit("<p>"), F.col("id").cast("string")).alias("html"))
    index = warc.build_index(warc.write(warc.plan(pages), archive_bytes=50_000))
    assert index.count() > 4
    wanted = pages.where("page_id % 20 < 2")
    assert sorted(r.page_id for r in warc.look_up(wanted, index).collect()) == [k for k in range(3000) if k % 20 < 2]


def test_look_up_reads_its_ranges_only(spark, tmp_path):
    """Bytes of other records may be gone: a look-up doesn't touch them."""
    pages = spark.createDataFrame([(k, f"http://x.example/{k}", f"page {k} " * 50) for k in range(50)], "page_id long, url string, html string").coalesce(1)
    captures = warc.write(warc.plan(pages), str(tmp_path))
    index = warc.build_index(captures)
    for c in captures.where("key not like '% 7'").collect():
        with open(common.file_system(c.archive)[1], "r+b") as f:
            f.seek(c.offset)
            f.write(b"\0" * c.length)
    got = warc.look_up(pages.where("page_id = 7"), index).first()
    assert got.payload_digest == hashlib.sha256(("page 7 " * 50).encode()).hexdigest()


def test_parse_is_linear():
    member = warc.record(1, "u", b"payload " * 40, "0", None)
    took = []
    for n in (4_000, 16_000):
        began = time.perf_counter()
        assert sum(1 for _ in warc.parse(io.BytesIO(member * n))) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0]


def test_warc_long_payload(spark):
    long = "".join(chr(97 + k * k % 23) for k in range(3_000_000))
    got = warc.round_trip(spark.createDataFrame([(1, "u" * 5000, long), (2, "u" * 5000 + "x", long)], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [(r.payload_bytes, r.record_type, r.refers_to) for r in got] == [(3_000_000, "response", None), (3_000_000, "revisit", 1)]


def test_url_keys():
    assert warc.url_key("http://www.Example.com:8080/b?x=1#y") == "com,example,www:8080)/b?x=1"
    assert warc.url_key(None) == "" and warc.url_key("http://[bad") == "http://[bad"


def test_fresh_names(odd):
    assert common.fresh(odd, "score") == "_score" and common.fresh(odd, "new") == "new"

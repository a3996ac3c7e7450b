"""The pipeline held against its parts, and stages on odd input."""

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shockwire.llm import bpe, mixing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, f in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.cut(f(spark, docs, SF))
        out.append((before, docs))
    return out


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-duplicates", "personal data", "source mixture", "byte-level BPE"]


def test_columns_stay(stages):
    for before, after in stages[:-1]:
        assert after.schema.simpleString() == before.schema.simpleString()


def test_quality_rejects_bad_and_keeps_good(spark, stages):
    before, after = stages[0]
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect()}
    kept = set(ids(after))
    good = [i for i in ids(before) if labels.get(i) == 1]
    assert sum(i in kept for i in good) >= 0.95 * len(good)
    assert not [i for i in kept if labels.get(i) == 0]


def test_one_of_each_group_stays(stages):
    before, after = stages[1]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}

    def words(t):
        w = t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {i: words(t) for i, t in texts.items()}
    group = {i: i for i in sets}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    order = sorted(sets)
    for n, i in enumerate(order):
        for j in order[n + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                group[b] = a
    assert ids(after) == sorted({find(i) for i in order})


def test_personal_data_is_gone(stages):
    before, after = stages[2]
    assert after.count() == before.count()
    assert after.where(F.col("text").rlike("[a-z0-9.]+@mail")).count() == 0
    assert after.where(F.col("n_chars") != F.char_length("text")).count() == 0


def test_mixture_takes_whole_copies(stages):
    """Each document as often as its taken words make it whole, counted by hand; sources come near their targets."""
    before, after = stages[3]
    taken = {r.doc_id: r for r in mixing.mix(before).collect()}
    copies = Counter(ids(after))
    assert copies == Counter({i: math.floor(r.taken / max(r.size, 1) + 0.5) for i, r in taken.items() if math.floor(r.taken / max(r.size, 1) + 0.5)})
    words, target, largest = Counter(), {}, Counter()
    for i, r in taken.items():
        words[r.source] += copies[i] * r.size
        target[r.source], largest[r.source] = r.target, max(largest[r.source], r.size)
    shards = Counter(r.source for r in taken.values())
    assert all(abs(words[s] - t) <= largest[s] * math.ceil(shards[s] ** 0.5) + 32 for s, t in target.items())  # two halves of a document a shard at most


def test_run_is_its_stages(spark, stages):
    rows = lambda df: Counter((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, SF)) == rows(stages[-1][1])


def test_tokens_come_back(stages):
    before, after = stages[4]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    enc, _ = bpe.tokenizer(bpe.public_tokenizers.path(bpe.RANKS))
    rows = after.collect()
    assert len(rows) == before.count()
    for r in rows:
        assert list(r["ids"]) == enc.encode_ordinary(texts[r["doc_id"]])
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_stages_on_odd_rows(spark):
    """Nulls everywhere, repeated rows, empty and white texts, columns that clash with the stages' own."""
    rows = [(1, "a plain text of some words here", "en", "s", 31, 0.5, "x", 9), (1, "a plain text of some words here", "en", "s", 31, 0.5, "x", 9), (2, None, None, None, None, None, None, None), (None, "text without an id that is long enough", "en", "s", 39, 0.1, "y", 1), (3, "", "en", "t", 0, 0.0, "", 0), (4, " \n ", "en", "t", 3, 0.0, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, base string, copies int")
    for _, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, docs, SF).columns == docs.columns
        assert f(spark, docs, SF).count() <= 3 * len(rows)
    assert corpus_pipeline.STAGES[1][1](spark, docs, SF).where("doc_id = 1").count() == 2
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows)


def test_stages_on_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, docs, SF).count() == 0

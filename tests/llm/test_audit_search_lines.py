"""op11, op12 and op13 against plain loops, and on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from shockwire.llm import filter_audit, line_dedup, ranked_search

DOCS = "doc_id long, text string, source string, fails int, part string, step int, n int, at int, keep string, n_lines int, score double"
REST = (1, "p", 1, 1, 1, "k", 1, 1.0)
SPACE = " \t\n\x0b\x0c\r"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, *REST) for r in rows], DOCS)


ODD = [
    (1, "one two three\nA LONG LINE OF WORDS\none two three", "a"), (1, "one two three\nA LONG LINE OF WORDS\none two three", "a"), (2, None, None), (3, "", "b"), (4, " \t\n", "b"), (None, "a long line of words \nno id", None),
    (None, "\tA long line of words", None), (5, "é漢字 😀 x y \x00 z\n" + "é" * 10 + "\n" + "é" * 9, "c"), (6, "word " * 30_000 + "\n" + "É" * 9 + "\n" + "é" * 10, "c"), (7, "x" * 50_000, "c"), (8, "x" * 50_000 + "\n\n", "c"), (1, "other  text\n  a long line of words", "a"), (0, "short\nshort", ""),
]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# 11


def brute_audit(rows, labels):
    """Replays each order document by document."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    conditions = {
        "A": lambda i, t: len(words(t)) < 200, "B": lambda i, t: 100 * len(set(words(t))) < 50 * len(words(t)), "C": lambda i, t: 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
        "D": lambda i, t: bool(re.search(r"[#$%&*|]", t)), "E": lambda i, t: i is not None and i > first[t],
    }
    good, toxic = ({r[0] for r in labels if r[k] == 1} for k in (1, 2))
    out = Counter()
    for order in map("".join, permutations("ABCDE")):
        for i, t, s in rows:
            alive, t = True, t or ""
            failed = {k for k, f in conditions.items() if f(i, t)}
            for step, k in enumerate(order, 1):
                at = (s or "", order, step)
                out[at] += 0
                out[(*at, "redundant")] += k in failed and not alive
                out[(*at, "unique")] += failed == {k}
                if alive and k in failed:
                    alive = False
                    out[(*at, "removed")] += 1
                    out[(*at, "good")] += i in good
                    out[(*at, "toxic")] += i in toxic
                out[(*at, "kept")] += alive
    shap = Counter()
    for at in [a for a in out if len(a) == 3]:
        shap[at[0], at[1][at[2] - 1]] += out[(*at, "removed")]
    return {(*at, *(out[(*at, c)] for c in ("kept", "removed", "redundant", "unique", "good", "toxic")), shap[at[0], at[1][at[2] - 1]]) for at in [a for a in out if len(a) == 3]}


def audited(df):
    return {tuple(r) for r in df.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()}


def test_audit_by_replay(spark):
    rnd = random.Random(3)
    rows = [*ODD]
    for i in range(40):
        n = rnd.choice((30, 199, 200, 260))
        text = " ".join(rnd.choice(("alpha", "Beta", "GAMMA", f"w{rnd.random()}", f"u{rnd.random()}")) for _ in range(n)) + rnd.choice(("", "", " #", "|"))
        rows += [(20 + i, text, rnd.choice("ab"))] + [(200 + i, text, "a")] * (i % 3)
    labels = [(i, rnd.choice((0, 1, None)), rnd.choice((0, 1, None))) for i in range(0, 230)] + [(20, 1, 1), (None, 1, 1)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = brute_audit(rows, [r for r in labels if r[0] is not None])
    got = filter_audit.audit(docs_of(spark, rows).repartition(3), known)
    assert audited(got) == want and got.count() == len(want) == 600 * len({s or "" for _, _, s in rows})


def test_audit_boundaries(spark):
    """Each condition at its bound: 200 words, half of them distinct, two capitals in a hundred code points."""
    filler = [f"w{k}" for k in range(100)]
    rows = [(1, " ".join(filler * 2), "a"), (2, " ".join(filler + ["w0"] * 101), "b"), (3, "AB" + "é" * 98, "c"), (4, "ABC" + "é" * 97, "d")]
    got = {r.part: r.fails for r in filter_audit.failures(docs_of(spark, rows)).collect()}
    assert got == {"a": 0, "b": 2, "c": 1, "d": 5}


def test_audit_of_three_filters(spark):
    flagged = spark.createDataFrame([("p", f, 1) for f in range(8)], "part string, fails int, good int")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.lost, r.shapley) for r in filter_audit.replay(flagged, "XYZ", {"lost": "good"}).collect()}
    assert len(got) == 18 and got["XYZ", 1] == (4, 4, 0, 1, 4, 14) and got["ZXY", 3] == (1, 1, 3, 1, 1, 14)


def test_audit_of_nothing(spark):
    none = docs_of(spark, ODD).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(none, labels).count() == 0
    assert {r[3:] for r in audited(filter_audit.audit(docs_of(spark, ODD[2:3]), labels)) if r[2] == 1 and r[1][0] == "A"} == {(0, 1, 0, 1, 0, 0, 120)}


# 12


def terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_search(rows, items, k=50, once=True):
    found = [(i, Counter(terms(t))) for i, t, *_ in rows]
    found = [(i, c) for i, c in found if c]
    n, length = len(found), sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    asked = {}
    for item, t in items:
        asked.setdefault(item, Counter()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scores = []
        for i, c in found:
            m = 100 - 50 + (50 * c.total() * n) // length
            s = sum((1 if once else x) * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t, x in wanted.items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def searched(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


ITEMS = "item_id long, text string, rank int, score int, term string"


def items_of(spark, items):
    return spark.createDataFrame([(*x, 1, 1, "t") for x in items], ITEMS)


@pytest.fixture(scope="module")
def library():
    rnd = random.Random(8)
    vocabulary = [f"t{k}" for k in range(60)] + ["Été", "漢字", "x9", "I"]
    rows = [(i, rnd.choice((" ", "-", "_")).join(rnd.choices(vocabulary, weights=range(1, len(vocabulary) + 1), k=rnd.randint(0, 60))), "s") for i in range(400)]
    rows += [(1000 + i, "t1 t2 same text", "s") for i in range(70)] + ODD + [(1001, "t1 t2 same text", "s"), (None, "t1 t2 same text", "s")]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randint(1, 12)))) for i in range(12)] + [(12, "T1, t1; T2 same"), (13, None), (14, ""), (15, "nowhere"), (None, "t3 word"), (12, "text"), (16, "x" * 50_000 + " été")]
    return rows, items


@pytest.mark.parametrize("once", [True, False])
def test_search_by_brute_force(spark, library, once):
    rows, items = library
    got = ranked_search.search(docs_of(spark, rows).repartition(5), items_of(spark, items), once=once)
    assert searched(got) == brute_search(rows, items, once=once)


def test_search_in_blocks(spark, library, monkeypatch):
    """Several blocks of items, several blocks of documents a task, several pieces a text, few salts: the same rows."""
    rows, items = library
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", 25)
    monkeypatch.setattr(ranked_search, "BLOCK_DOCS", 37)
    monkeypatch.setattr(ranked_search, "PIECE", 11)
    monkeypatch.setattr(ranked_search, "SALTS", 3)
    assert searched(ranked_search.search(docs_of(spark, rows).repartition(2), items_of(spark, items), k=7)) == brute_search(rows, items, k=7)
    monkeypatch.setattr(ranked_search, "MAX_BLOCK_TERMS", 5)
    with pytest.raises(ValueError, match="more than 5 terms"):
        ranked_search.search(docs_of(spark, rows), items_of(spark, items))


def test_search_of_nothing(spark, library):
    rows, items = library
    assert ranked_search.search(docs_of(spark, rows).limit(0), items_of(spark, items)).count() == 0
    none = ranked_search.search(docs_of(spark, rows), items_of(spark, items).limit(0))
    assert none.count() == 0 and none.columns == ["item_id", "rank", "doc_id", "score"]
    assert ranked_search.search(docs_of(spark, ODD[2:5]), items_of(spark, items)).count() == 0


def test_term_counts_over_pieces(monkeypatch):
    text = "Ab-cd é漢a_b 12x" * 50
    want = Counter(t.encode() for t in terms(text))
    for piece in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(ranked_search, "PIECE", piece)
        assert ranked_search.term_counts(text.encode()) == want


# 13


def brute_lines(rows):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACE))
    place = lambda i: math.inf if i is None else i
    first = {}
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            first[key(line)] = min(place(i), first.get(key(line), math.inf))
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == place(i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def reported(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=repr)


def test_lines_by_brute_force(spark):
    rnd = random.Random(4)
    pool = [f"  Line number {k} of the pool\t" for k in range(30)] + ["short", "", "EXACTLY10!", "exactly10!", "only nine", "é" * 10, "É" * 10]
    rows = [(rnd.randrange(150), "\n".join(rnd.choices(pool, k=rnd.randint(0, 12)) + [f"its own line, number {i}"] * (i % 2)), "s") for i in range(200)] + ODD
    assert reported(line_dedup.report(docs_of(spark, rows).repartition(6))) == brute_lines(rows)


def test_one_line_over_many_tasks(spark):
    """Every document holds one line, which fills all ranges; the smallest doc_id keeps it."""
    rows = [(i, f"the line that all of them hold\nand one of its own: {i}", "s") for i in range(3, 4003)]
    df = docs_of(spark, rows).repartition(7)
    order = ["h1", "h2", "d", "at"]
    hot = line_dedup.hashed_lines(df).repartitionByRange(8, *order).groupBy("h1", "h2").agg({"*": "count"}).where("`count(1)` = 4000")
    assert hot.count() == 1
    assert reported(line_dedup.report(df)) == brute_lines(rows)


def test_ranges_may_break_anywhere():
    """Sorted rows, broken into tasks and batches at random: with the ends of the tasks, the open lines are settled as in one."""
    rnd = random.Random(6)
    rows = sorted((rnd.randrange(3), rnd.randrange(2), rnd.randrange(4), 0, 5, at) for at in range(60))  # h1, h2, d, row, n_lines, at
    first = {}
    for h1, h2, d, *_ in rows:
        first.setdefault((h1, h2), d)
    want = {r[5] for r in rows if r[2] > first[r[:2]]}
    names = ["d", "row", "n_lines", "at", "h1", "h2"]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], t) for k, t in ((2, pa.int64()), (3, pa.int64()), (4, pa.int32()), (5, pa.int32()), (0, pa.int64()), (1, pa.int64()))], names=names)
    for _ in range(200):
        cuts = [0, *sorted(rnd.choices(range(61), k=5)), 60]
        out = []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            mid = rnd.randint(lo, hi)
            out += [r for b in line_dedup.first_occurrences(iter([batch(rows[lo:mid]), batch(rows[mid:hi])])) for r in b.to_pylist()]
        ends = {}
        for r in out:
            if r["kind"] == line_dedup._END:
                ends[r["h1"], r["h2"]] = min(r["d"], ends.get((r["h1"], r["h2"]), r["d"]))
        got = [r["at"] for r in out if r["kind"] == line_dedup._DROP] + [r["at"] for r in out if r["kind"] == line_dedup._OPEN and r["d"] > ends.get((r["h1"], r["h2"]), math.inf)]
        assert set(got) == want and len(got) == len(want)


def test_bitmaps(spark):
    rnd = np.random.default_rng(2)
    for n in (1, 7, 8, 9, 1000):
        gone = np.flatnonzero(rnd.random(n) < 0.3)
        keep = line_dedup.unpack(line_dedup.pack(n, gone), n)
        assert len(keep) == n and list(np.flatnonzero(~keep)) == list(gone)
    rows = [(1, "a line of some length", "s"), (2, "b\nA line of some length \nc", "s"), (3, "nothing of the others", "s")]
    got = line_dedup.keep_bitmaps(docs_of(spark, rows)).collect()
    assert [(r.d, r.n_lines, r.n_dropped, list(line_dedup.unpack(r.keep, 3))) for r in got] == [(2, 3, 1, [True, False, True])]


def test_lines_kept_in_place(spark):
    """apply() keeps docs' other columns, whatever their names, and of their order."""
    docs = docs_of(spark, [(1, "a line of some length", "s"), (2, "b\na line of some length", "s")])
    out = line_dedup.apply(docs, line_dedup.keep_bitmaps(docs))
    assert out.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    assert {(r.doc_id, r.text, r.keep, r.n_lines, r.n_dropped) for r in out.collect()} == {(1, "a line of some length", "k", 1, 0), (2, "b", "k", 2, 1)}


def test_lines_of_nothing(spark):
    assert line_dedup.report(docs_of(spark, ODD).limit(0)).count() == 0

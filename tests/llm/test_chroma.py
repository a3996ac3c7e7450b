import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from shockwire.llm import chroma


def test_align_tones(spark):
    rnd = np.random.default_rng(1)
    t = np.arange(4096) / chroma.RATE
    sound = np.concatenate([60 * np.sin(2 * np.pi * 220 * 2 ** (rnd.integers(0, 24) / 12) * t) for _ in range(20)]).astype(np.int8)
    a = chroma.codes(chroma.frames(sound))
    offset, votes, error = chroma.align(a, chroma.codes(chroma.frames(sound[chroma.HOP * 40 :])))
    assert offset == 40 and error == 0 and votes == len(a) - 40
    assert chroma.align(a, a[:0]) is None and len(chroma.codes(chroma.frames(sound[:100]))) == 0
    rows = [(1, sound.tobytes()), (1, sound.tobytes()), (2, None), (3, b""), (None, b"x" * 50)]
    got = chroma.fingerprints(spark.createDataFrame(rows, "id long, audio binary")).collect()
    assert len(got) == 5 and [r.bit_error for r in got[:2]] == [0.0, 0.0] and all(r.offset is None and r.n_codes == 0 for r in got[2:])


def test_repeated_codes_all_vote():
    a, b = np.array([7, 7, 7, 1, 7, 7, 2], np.uint32), np.array([7, 7, 2], np.uint32)
    assert chroma.align(a, b) == (4, 3, 0.0)
    rnd = np.random.default_rng(2)
    for a, b in ((rnd.integers(0, 3, 90), rnd.integers(0, 3, 40)), (np.zeros(3000, int), np.zeros(2000, int)), (rnd.integers(0, 2, 2000), rnd.integers(0, 9, 1500))):
        votes = [(sum(a[max(0, d) : d + len(b)] == b[max(0, -d) : len(a) - d]), -d) for d in range(1 - len(b), len(a))]
        assert chroma.align(a.astype(np.uint32), b.astype(np.uint32))[:2] == (-max(votes)[1], max(votes)[0])


def test_filters_differ():
    assert len(set(chroma.FILTERS)) == 16


def test_copies_under_other_ids_are_found(spark):
    rnd = np.random.default_rng(3)
    words = [f"w{k}" for k in range(500)]
    text = [" ".join(rnd.choice(words, 400)) for _ in range(3)]
    part = " ".join(text[0].split(" ")[120:])  # 120 words are 30 hops
    rows = [(20, text[0]), (21, text[0]), (7, part), (8, text[1]), (9, "a"), (40, text[2]), (41, text[2] + " " + text[1]), (10, ""), (None, text[0]), (60, None)]
    recordings = spark.createDataFrame(rows, "id long, audio string")
    got = {r.id: r for r in chroma.matches(chroma.fingerprints(recordings, chroma.tones)).collect()}
    assert len(got) == len(rows) and got[21].copy_of == got[None].copy_of == 20 and got[21].matches == []
    assert [(m.id, m.offset, m.bit_error) for m in got[7].matches] == [(20, 30, 0.0)]
    assert [(m.id, m.offset) for m in got[41].matches] == [(40, 0)] and got[8].matches == []
    assert got[9].n_codes == len(got[9].codes) // 4 > 0 and got[9].offset is not None
    assert got[10].matches is None and got[60].copy_of is None and got[10].codes == b""


def _links(rows):
    """The matches of every id to look for with every other code sequence, as {(sequence to look for, other): match}, and the
    smallest such id of each sequence. Knows no keys."""
    asked = {}
    for i, x in rows:
        if i is not None and i % 20 == 0 and x:
            asked[x] = min(i, asked.get(x, i))
    out = {}
    for y in asked:
        for x in {x for _, x in rows if x} - {y}:
            p, q = np.frombuffer(y, "<u4"), np.frombuffer(x, "<u4")
            if set(p.tolist()) & set(q.tolist()):
                offset, _, _ = chroma.align(p, q)
                lo, hi = max(0, offset), min(len(p), offset + len(q))
                bits = [(int(u) ^ int(v)).bit_count() for u, v in zip(p[lo:hi], q[lo - offset : hi - offset], strict=True)]
                best, now, begin, span = 0, 0, 0, (0, 0)
                for k, n in enumerate(bits):  # the largest sum, element by element
                    if now < 0:
                        now, begin = 0, k
                    now += round(32_000 * chroma.BIT_ERROR) - 1000 * n
                    if now > best:
                        best, span = now, (begin, k + 1)
                part = bits[slice(*span)]
                if part.count(0) >= max(2, 1.2 * (np.log10(len(p) * len(q)) - 1)):
                    out[y, x] = (offset, part.count(0), round(sum(part) / len(part) / 32, 9))
    return out, asked


def _smallest(rows, links):
    """The smallest id that links and equal sequences lead to, for each sequence."""
    label = {}
    for i, x in rows:
        if x and i is not None:
            label[x] = min(i, label.get(x, i))
    changed = True
    while changed:
        changed = False
        for y, x in links:
            low = min(label[x], label[y])
            if label[x] != low or label[y] != low:
                label[x] = label[y] = low
                changed = True
    return label


def test_matches_by_brute_force(spark):
    """Loops, silence, shared passages, near copies in number and chance equalities, against all pairs."""
    rnd = np.random.default_rng(11)
    code = lambda n: rnd.integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4")
    passage, family, rows = code(12), code(60), []
    for k in range(200):
        x = rnd.integers(0, 12, rnd.integers(1, 60)).astype("<u4") * np.uint32(268435399)
        if k % 5 == 1:
            x = np.resize(x[:3], rnd.integers(1, 300))  # a loop
        if k % 7 == 0:
            x = np.concatenate([x, np.full(rnd.integers(1, 200), 7, "<u4")])  # silence
        if k % 11 == 0 and rows:
            x = np.concatenate([x[:5], np.frombuffer(rows[-1][1], "<u4"), x[:2]])
        rows.append((k, x.tobytes()))
    for k in range(200, 700):
        rows.append((k, (np.concatenate([code(30), passage, code(9)]) if k % 4 else np.where(rnd.random(60) < 0.1, code(60), family)).astype("<u4").tobytes()))
    for k in range(700, 1000, 5):  # one pair of codes in recordings that match in nothing else
        rows.append((k, np.concatenate([code(20), np.array([5, 6], "<u4"), code(rnd.integers(5, 90))]).astype("<u4").tobytes()))
    rows += [(1000, rows[3][1]), (None, rows[4][1]), (60, rows[8][1]), (2000, b"")]
    known = spark.createDataFrame([(i, len(x) // 4, x, hashlib.sha256(x).hexdigest()) for i, x in rows], "id long, n_codes long, codes binary, codes_sha256 string").repartition(3)
    got = chroma.matches(known).collect()
    want, asked = _links(rows)
    assert len(got) == len(rows) and want
    direct = {(m.id, bytes(r.codes), m.offset, m.votes, round(m.bit_error, 9)) for r in got if r.matches for m in r.matches}
    assert direct == {(asked[y], x, *m) for (y, x), m in want.items()}
    label = _smallest(rows, want)
    for r in got:
        assert r.copy_of == min((j for j, y in rows if y == bytes(r.codes) and j is not None), default=None) if r.codes else r.matches is None and r.copy_of is None
        assert r.component_id == (label.get(bytes(r.codes), r.id) if r.codes else r.id)


def test_links_that_no_leader_tells(spark):
    """9 recordings to look for start alike; 9 others hold the second half of one each and 4 lone codes apart of the next. The
    smallest ids match all starts, but not those halves, nor do pairs of neighbouring codes lead to the lone ones."""
    rnd = np.random.default_rng(5)
    code = lambda n: rnd.integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4")
    start, key = code(40), code(2)
    asked = [np.concatenate([start, key, code(40)]) for _ in range(9)]
    rows = [(20 * k, x) for k, x in enumerate(asked)]
    rows += [(1000 + 20 * k + 1, np.concatenate([key, x[42:], code(30)])) for k, x in enumerate(asked)]
    rows += [(2001 + 20 * k, np.where(np.arange(40) % 2, x[42:] ^ np.uint32(1), x[42:])) for k, x in enumerate(asked)]
    known = spark.createDataFrame([(i, len(x), x.astype("<u4").tobytes(), hashlib.sha256(x.tobytes()).hexdigest()) for i, x in rows], "id long, n_codes long, codes binary, codes_sha256 string")
    got = {r.id: {m.id for m in r.matches} for r in chroma.matches(known).collect()}
    for k in range(9):
        assert got[20 * k] == {20 * j for j in range(9) if j != k} and got[1001 + 20 * k] == {20 * k} and got[2001 + 20 * k] == {20 * k}


def test_no_link_is_lost_on_the_given_table(spark):
    """Every id divisible by 20 against all rows of documents: each link is told directly."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("audio"))
    got = chroma.matches(chroma.fingerprints(docs, chroma.tones)).collect()
    rows = [(r.id, bytes(r.codes)) for r in got]
    want, asked = _links(rows)
    direct = {(m.id, bytes(r.codes)) for r in got if r.matches for m in r.matches}
    component = {bytes(r.codes): r.component_id for r in got}
    assert want and direct == {(asked[y], x) for y, x in want} and all(component[y] == component[x] for y, x in want)


def test_noise_does_not_match(spark):
    rnd = np.random.default_rng(0)
    rows = [(20 * k, rnd.integers(-100, 100, 44_100).astype(np.int8).tobytes()) for k in range(30)]
    rows += [(2000 + k, rnd.integers(-100, 100, 441_000).astype(np.int8).tobytes()) for k in range(0, 240, 20)]
    got = chroma.matches(chroma.fingerprints(spark.createDataFrame(rows, "id long, audio binary"))).collect()
    assert len(got) == 42 and all(r.matches == [] and r.component_id == r.id for r in got)


def test_no_other_codes_are_exchanged(spark):
    """Of the classes, those that may match alone are dealt with their codes: a bit a number tells them, exactly."""
    rnd = np.random.default_rng(6)
    numbers = [int(k) << 33 | int(r) for k in range(3) for r in rnd.integers(0, 70_000, 300)] + [0, 1, 7, 8, 32_767, 32_768, 32_769]
    classes = spark.createDataFrame([(n, b"x") for n in sorted(set(numbers))], "n long, codes binary")
    some = sorted(set(rnd.choice(numbers, 200).tolist()) | {0, 8, 32_768})
    needed = spark.createDataFrame([(k, n) for k in range(2) for n in some], "at long, n long")
    assert sorted(r.n for r in chroma._among(classes, needed).collect()) == some
    assert chroma._among(classes, needed.limit(0)).count() == 0


def _shuffled(spark, f):
    """Bytes that f's stages write for exchanges."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def written():
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    before = written()
    out = f()
    return out, written() - before


def test_codes_of_a_group_do_not_go_to_each_bucket(spark):
    """1,000 near copies, 50 of them to look for, and 64 partitions: codes went once to each of 256 buckets, and once to find
    classes. Lone codes that many others hold, often in one recording of a pair and once in the other, need no alignment."""
    rnd = np.random.default_rng(8)
    code = lambda n: rnd.integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4")
    family, lone = code(30), code(1)
    rows = [(k, np.concatenate([family, code(70)])) for k in range(1000)]
    rows += [(1000 + k, np.concatenate([code(100), lone.repeat(1 if k % 20 else 12)])) for k in range(400)]
    rows = [(i, x.astype("<u4").tobytes()) for i, x in rows]
    known = spark.createDataFrame([(i, len(x) // 4, x, hashlib.sha256(x).hexdigest()) for i, x in rows], "id long, n_codes long, codes binary, codes_sha256 string").repartition(4)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got, shuffled = _shuffled(spark, lambda: chroma.matches(known).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    told = {r.id: {m.id for m in r.matches} for r in got}
    want = lambda k: set(range(0, 1000, 20)) if k < 1000 else set() if k % 20 else set(range(1000, 1400, 20))
    assert len(told) == 1400 and all(told[k] == want(k) - {k} for k in told)
    assert shuffled < 9 * sum(len(x) for _, x in rows)  # 7.0 times; 12.5 when they went to each bucket


def test_tiles_hold_every_pair_once(monkeypatch):
    """Pairs of three groups and lone ones, in many pieces, with sums in between: each pair with enough votes is in one tile, with
    both classes, and none other is."""
    monkeypatch.setattr(chroma, "PAIRS", 50)
    monkeypatch.setattr(chroma, "TILE", 4)
    rnd = np.random.default_rng(9)
    pairs = {(a, b): int(rnd.integers(1, 6)) for g in range(3) for a in range(1000 * g, 1000 * g + 400, 20) for b in range(1000 * g, 1000 * g + 400) if a != b and rnd.random() < 0.7}
    pairs |= {(20 * int(rnd.integers(300)), int(b)): 3 for b in range(5000, 5100)}
    pieces, at = [], {}
    for (a, b), votes in pairs.items():
        pieces += [(b, a)] * votes
    rnd.shuffle(pieces)
    for k in range(0, len(pieces), 90):
        b, a, votes, enough = chroma._summed(*np.array(pieces[k : k + 90]).T, np.ones(len(pieces[k : k + 90]), np.uint8), np.full(len(pieces[k : k + 90]), 3, np.uint8))
        for part in range(2):
            x = b % 2 == part
            at.setdefault(part, []).append(chroma._pack(b[x], a[x].astype("<i8"), votes[x], enough[x]))
    batch = pa.RecordBatch.from_arrays([pa.array([k for k in at for _ in at[k]], pa.int64()), pa.array([d for k in at for d in at[k]], pa.binary())], names=["at", "data"])
    rows = [tuple(r.values()) for out in chroma._candidates(iter([batch]), 20) for r in out.to_pylist()]
    held = {r[:3] for r in rows if r[3] is None}
    told = [(int(a), n, leader, tile) for leader, tile, n, others in rows if others is not None for a in chroma._unpack(others)[0]]
    assert sorted(t[:2] for t in told) == sorted(p for p, votes in pairs.items() if votes >= 3)
    assert {(leader, tile, a) for a, _, leader, tile in told} == held and len({t[2:] for t in told}) > 20


def test_packed_columns_come_back():
    rnd = np.random.default_rng(7)
    for n in (0, 1, 1000):
        a, b, c = np.sort(rnd.integers(0, 1 << 40, n)), rnd.integers(0, 1 << 33, n), rnd.integers(0, 256, n).astype(np.uint8)
        packed = chroma._pack(a, b.astype("<i8"), c)
        assert all((x == y).all() for x, y in zip(chroma._unpack(packed, "<i8", "u1"), (a, b, c), strict=True))
    # numbers of many partitions that lie far apart: the bytes that they share take no room
    assert len(chroma._pack(np.arange(1000), (rnd.integers(0, 1 << 12, 1000) + (5 << 33)).astype("<i8"), np.zeros(1000, np.uint8))) < 2300


def test_names_that_clash(spark):
    """Columns of these names beside the table's own are not read."""
    rows = [(20, "a b " * 300, 1, "x", "y"), (21, "a b " * 200, 2, "x", "y"), (22, None, 3, None, None)]
    got = chroma.matches(chroma.fingerprints(spark.createDataFrame(rows, "id long, audio string, codes int, matches string, class string"), chroma.tones)).collect()
    assert {r.id: r.component_id for r in got} == {20: 20, 21: 20, 22: 22}


def test_no_recordings(spark):
    none = spark.createDataFrame([], "id long, audio string, codes int, matches int")
    assert chroma.matches(chroma.fingerprints(none, chroma.tones)).count() == 0


def test_long_loop_is_linear_enough(spark):
    """Two recordings of one repeated word, 100,000 and 60,000 words: 375 million pairs of equal positions."""
    rows = [(20, "la " * 100_000), (21, "la " * 60_000), (22, "la lo " * 30_000)]
    got = {r.id: r for r in chroma.matches(chroma.fingerprints(spark.createDataFrame(rows, "id long, audio string"), chroma.tones)).collect()}
    assert [m.id for m in got[21].matches] == [20] and got[21].n_codes > 14_000

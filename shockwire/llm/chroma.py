"""Chroma audio fingerprints: filters over an integral image of pitch-class frames, packed to integers; recordings are
aligned by offset histograms and bit errors, each with its own tail and with those whose id is divisible by EVERY.

Recordings with equal codes are one class. A class's keys are its distinct codes, dealt by a hash and packed; each class that
holds an id to look for meets every class that shares a key with it. A match holds some equal codes at one offset (see `_enough`),
so pairs that share fewer, each code counted as often as the recording that has it less often, are none; all others are aligned on whole codes: every
equal position votes for its offset (loops by convolution), and at the offset with most votes (the smallest of a tie) the stretch of
codes that differ least is taken: a match where its bit error is small and it holds more equal codes than recordings of these
lengths share by chance. Every match is told, and `component_id` joins them. A class is told by one of its rows, whose codes stay
where they are until pairs are known. Pairs travel packed. Classes whose pairs have the same smallest class to look for are aligned
together, in tiles of about TILE times TILE, so that a group's codes travel once a tile and not once a bucket; a group of n near
copies makes n * n / EVERY alignments and matches.

Defined results: null, empty and short recordings (fewer frames than a filter's window) have no codes, no alignment, no
matches (null) and no frames or fewer than WINDOW; rows that repeat and null ids go row by row, and null ids are not looked
for; an empty table gives no rows; further columns are not read. Recordings are mono samples, one signed byte each.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockwire.llm.common import cut, map_rows, small_batches
from shockwire.llm.neardup import components

RATE, FRAME, HOP = 11_025, 1024, 256
#: Frames that a code looks at; filters (first pitch class, classes, kind), all different: two bits each, 32 in all.
WINDOW = 16
FILTERS = [((k * 3 + k // 4) % 12, 1 + (k + k // 4) % 4, k % 4) for k in range(16)]
_HZ = np.fft.rfftfreq(FRAME, 1 / RATE)
_USED = slice(int(np.searchsorted(_HZ, 60)), int(np.searchsorted(_HZ, 5000)))
_TO_CLASS = np.eye(12)[np.round(12 * np.log2(_HZ[_USED] / 440)).astype(int) % 12]
_HANN = np.hanning(FRAME).astype(np.float32)
#: Parts of a unit energy that frames are rounded to, so that sums of an image are exact and a code depends on its window alone.
PARTS = 1 << 20
#: The quotients of 1 + energy at which a filter's response goes from one step to the next, beside 1.
_STEPS = (float(np.exp(-0.2)), float(np.exp(0.2)))
#: Recordings whose id this divides are looked for among all; the stretch of a match has as large a bit error at most, and as
#: many equal codes at least (see `_enough`).
EVERY, VOTES, BIT_ERROR = 20, 2, 0.1
#: Pairs that a task makes at once.
PAIRS = 1 << 20
#: Buckets over which the classes of one key are dealt; buckets a task; codes packed at once; classes at each side of a tile.
SALT, BUCKETS, PACKED, TILE = 4, 4, 1 << 20, 512
#: Stand-in recordings: samples of a word's tone; a shorter recording is repeated to as many samples as give it codes and its
#: tail too.
TONE, SHORTEST = 64, 26 * HOP
_TONES = np.round(100 * np.sin(2 * np.pi * 1100 * 2 ** (np.arange(24) / 12)[:, None] * np.arange(1, TONE + 1) / RATE)).astype(np.int8)


def tones(text: bytes) -> bytes:
    """A stand-in recording of a text: a tone for each word between spaces, its pitch by a hash of the word."""
    if not text:
        return b""
    words = text.split(b" ")
    pitches = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % len(_TONES)
    sound = _TONES.take(pitches, axis=0).ravel()
    return (sound if len(sound) >= SHORTEST else np.resize(sound, SHORTEST)).tobytes()


def frames(samples: np.ndarray) -> np.ndarray:
    """Unit pitch-class energies, a row a frame."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    out, windows = [], np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    for at in range(0, len(windows), 128):
        z = np.fft.rfft(windows[at : at + 128] * _HANN, axis=1)
        # squares of both parts in one run over memory
        x = np.square(z.view(z.real.dtype)[:, 2 * _USED.start : 2 * _USED.stop])
        out.append((x[:, 0::2] + x[:, 1::2]) @ _TO_CLASS)
    x = np.concatenate(out)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def codes(chroma: np.ndarray) -> np.ndarray:
    """32-bit codes, one for each window of frames: filter responses from the integral image, in four steps (Gray code)."""
    n = len(chroma) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    whole = np.rint(chroma * PARTS).astype(np.int64)
    # a row a pitch class, so that what a filter reads of all windows lies in one run
    image = np.zeros((25, len(chroma) + 1), np.int64)
    image[1:, 1:] = np.concatenate([whole, whole], axis=1).T.cumsum(0)
    np.cumsum(image, axis=1, out=image)
    half = WINDOW // 2
    area = lambda t0, t1, c0, c1: image[c1, t1 : t1 + n] - image[c1, t0 : t0 + n] - image[c0, t1 : t1 + n] + image[c0, t0 : t0 + n]
    packed = np.zeros(n, np.uint32)
    for c, wide, kind in FILTERS:
        whole, other = area(0, WINDOW, c, c + wide), area(0, WINDOW, c + 6, c + 6 + wide)
        first, middle = area(0, half, c, c + wide), area(half // 2, half // 2 + half, c, c + wide)
        a, b = [(whole, other), (first, whole - first), (middle, whole - middle), (first, other / 2)][kind]
        a, b = a + PARTS, b + PARTS
        step = (a >= b * _STEPS[0]).astype(np.uint8) + (a >= b) + (a >= b * _STEPS[1])
        packed = (packed << np.uint32(2)) | np.array([0, 1, 3, 2], np.uint32)[step]
    return packed


def commonest(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> tuple[int, int] | None:
    """The commonest offset of equal codes of b in a, all pairs of equal positions voting, and its votes; None without equal
    codes. in_a and in_b are the orders of a and b (stable)."""
    by_a, by_b = a[in_a], b[in_b]
    at = np.searchsorted(by_a, by_b)
    many = np.searchsorted(by_a, by_b, "right") - at
    pairs = int(many.sum())
    if not pairs:
        return None
    most = 64 * (len(a) + len(b))
    votes = np.zeros(len(a) + len(b) - 1, np.int64)
    if pairs > most:
        # codes that repeat much vote by a convolution, so that a loop's pairs are not made one by one
        first = np.concatenate([[0], np.flatnonzero(np.diff(by_b)) + 1])
        n_b = np.diff(np.append(first, len(b)))
        much = many[first] * n_b > most
        size = 1 << (len(votes) - 1).bit_length()
        for k in np.flatnonzero(much):
            x, y = np.zeros(size), np.zeros(size)
            x[in_a[at[first[k]] : at[first[k]] + many[first[k]]]] = 1
            y[len(b) - 1 - in_b[first[k] : first[k] + n_b[k]]] = 1
            votes += np.rint(np.fft.irfft(np.fft.rfft(x) * np.fft.rfft(y), size)[: len(votes)]).astype(np.int64)
        many = np.where(np.repeat(much, n_b), 0, many)
    votes += np.bincount(in_a[_runs(at, many)] - np.repeat(in_b, many) + len(b) - 1, minlength=len(votes))
    best = int(np.argmax(votes))
    return best - len(b) + 1, int(votes[best])


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, float] | None:
    """The commonest offset of equal codes of b in a, its votes, and the share of unequal bits there; None without equal codes."""
    found = commonest(a, b, np.argsort(a, kind="stable"), np.argsort(b, kind="stable"))
    if not found:
        return None
    lo, hi = max(0, found[0]), min(len(a), found[0] + len(b))
    return *found, float(np.bitwise_count(a[lo:hi] ^ b[lo - found[0] : hi - found[0]]).mean() / 32)


def stretch(a: np.ndarray, b: np.ndarray, offset: int, bit_error: float = BIT_ERROR) -> tuple[int, int, int, float]:
    """Of the overlap at an offset, the stretch with the most bits to spare under the bit error (the first of a tie): its start in
    a, its codes, the equal ones among them, and its bit error (1 where no stretch keeps to the limit)."""
    lo, hi = max(0, offset), min(len(a), offset + len(b))
    bits = np.bitwise_count(a[lo:hi] ^ b[lo - offset : hi - offset]).astype(np.int64)
    spare = np.concatenate([[0], (round(32_000 * bit_error) - 1000 * bits).cumsum()])  # in thousandths, so that ties are exact
    end = int(np.argmax(spare - np.minimum.accumulate(spare)))
    start = int(np.argmin(spare[: end + 1]))
    found = bits[start:end]
    return lo + start, end - start, int((found == 0).sum()), float(found.mean() / 32) if len(found) else 1.0


def _enough(n_a: int, n_b: int) -> float:
    """Equal codes that a stretch of two recordings has to hold: chance makes longer ones by the logarithm of the position pairs."""
    return max(VOTES, 1.2 * (np.log10(max(n_a * n_b, 1)) - 1))


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one run after the other."""
    return np.arange(lengths.sum()) + np.repeat(starts - (lengths.cumsum() - lengths), lengths)


def fingerprints(recordings: DataFrame, decode: Callable[[bytes], bytes] = bytes) -> DataFrame:
    """id, n_frames, n_codes, codes (32-bit integers, lowest byte first), codes_sha256, and the offset and bit error of the recording without its first fourth (in
    whole hops) against the whole. recordings: id, audio (binary), which `decode` turns into samples."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        sounds = [np.frombuffer(decode(data) if data else b"", np.int8) for data in batch.column(1).to_pylist()]
        # one run of frames for all, each recording from a whole hop on; what lies across two is not looked at
        hops = np.array([-(-len(x) // HOP) for x in sounds], np.int64)
        joined = np.zeros(int(hops.sum()) * HOP, np.int8)
        starts = hops.cumsum() - hops
        for x, at in zip(sounds, starts, strict=True):
            joined[at * HOP : at * HOP + len(x)] = x
        every = codes(frames(joined))
        rows = []
        for x, at in zip(sounds, starts, strict=True):
            n = max(0, (len(x) - FRAME) // HOP + 1)
            whole = every[at : at + max(0, n - WINDOW + 1)]
            offset, _, error = align(whole, whole[len(x) // 4 // HOP :]) or (None, None, None)
            rows.append((n, len(whole), whole.astype("<u4").tobytes(), hashlib.sha256(whole.tobytes()).hexdigest(), offset, error))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["id", "n_frames", "n_codes", "codes", "codes_sha256", "offset", "bit_error"])

    source = recordings.select(F.col("id").cast("long").alias("id"), F.col("audio").cast("binary").alias("audio"))
    return map_rows(source, lambda: f, "id long, n_frames long, n_codes long, codes binary, codes_sha256 string, offset long, bit_error double", rows=128)


def keys(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, ascending, and a byte for each: how often it stands there (15: as often or more), and in the upper half
    the whole logarithm of the number of codes (15 at most)."""
    found, often = np.unique(codes, return_counts=True)
    return found, (np.minimum(often, 15) | min(15, len(codes).bit_length() - 1) << 4).astype(np.uint8)


def _pack(numbers: np.ndarray, *columns: np.ndarray) -> bytes:
    """Ascending numbers and columns as long, compressed: a column's first bytes, then its second ones, as the high ones repeat, each
    with a code of its own; runs alone are looked for."""
    coder, out = zlib.compressobj(1, zlib.DEFLATED, 15, 8, zlib.Z_RLE), []
    for c in (np.diff(numbers, prepend=0).astype("<i8"), *columns):
        for plane in np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T:
            out.append(coder.compress(plane.tobytes()))
            if plane.any():
                out.append(coder.flush(zlib.Z_SYNC_FLUSH))
    return b"".join([*out, coder.flush()])


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    x, out, at = np.frombuffer(zlib.decompress(data), np.uint8), [], 0
    kinds = [np.dtype(k) for k in ("<i8", *kinds)]
    n = len(x) // sum(k.itemsize for k in kinds)
    for kind in kinds:
        out.append(np.ascontiguousarray(x[at : at + n * kind.itemsize].reshape(kind.itemsize, n).T).view(kind).ravel())
        at += n * kind.itemsize
    return [out[0].cumsum(), *out[1:]]


def _split(bucket: np.ndarray) -> list[np.ndarray]:
    """The places of each value of bucket, in order."""
    order = np.argsort(bucket, kind="stable")
    return [g for g in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(g)]


def _postings(batches: Iterator[pa.RecordBatch], buckets: int, of: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, of, data) of the keys of classes (n, codes): of 1 for all classes, each in one of a key's SALT buckets, and 0
    for those to look for, in all of these."""

    def flush(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        rows.sort(key=lambda r: r[0])
        found = [keys(np.frombuffer(c, "<u4")) for _, c in rows]
        key, byte = np.concatenate([k for k, _ in found]), np.concatenate([x for _, x in found])
        numbers = np.repeat(np.array([r[0] for r in rows], np.int64), [len(k) for k, _ in found])
        home = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
        out = []
        for salt in [numbers % SALT] if of else range(SALT):
            bucket = (home + salt) % buckets
            out += [(int(bucket[g[0]]), of, _pack(numbers[g], key[g], byte[g])) for g in _split(bucket)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "of", "data"])

    held, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
            held.append(row)
            size += len(row[1]) // 4
            if size >= PACKED:
                yield flush(held)
                held, size = [], 0
    if held:
        yield flush(held)


def _summed(a: np.ndarray, b: np.ndarray, votes: np.ndarray, *same: np.ndarray) -> list[np.ndarray]:
    """Each pair (a, b) once, ascending, with the sum of its votes (255 at most), and the columns that are the same in all its rows."""
    order = np.lexsort((b, a))
    a, b, votes = a[order], b[order], votes[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (np.diff(a) != 0) | (np.diff(b) != 0)])) if len(a) else np.zeros(0, np.int64)
    return [a[first], b[first], np.minimum(np.add.reduceat(votes, first) if len(a) else votes, 255).astype(np.uint8), *(x[order][first] for x in same)]


def _least() -> np.ndarray:
    """Equal codes that a match holds at least, by the logarithms of both numbers of codes, as keys() tells them: these lower bounds
    ask for no more than the true numbers do."""
    return np.array([np.ceil(_enough(1 << (x >> 4), 1 << (x & 15))) for x in range(256)]).astype(np.uint8)


def _meet(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows (at, data) of the pairs of classes (b, a to look for) that share a key of a bucket, dealt by b,
    with the equal codes that one offset may have (a position has one partner there) and those that a match holds. Rows are sorted
    by bucket, classes to look for first; a task holds these of one bucket, and PAIRS pairs, or those of one key and class, at once."""
    bucket, kept, led, least = None, [], None, _least()
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        b, a, votes, enough = _summed(*(np.concatenate(c) for c in zip(*held, strict=True)))
        rows = [(int(b[g[0]] % parts), _pack(b[g], a[g].astype("<i8"), votes[g], enough[g])) for g in _split(b % parts)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["at", "data"])

    for batch in batches:
        for at, of, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if at != bucket:
                bucket, kept, led = at, [], None
            if of == 0:
                kept.append(data)
                continue
            if not kept:
                continue
            if led is None:
                leader, led, leading = (np.concatenate(c) for c in zip(*(_unpack(x, "<u4", "u1") for x in kept), strict=True))
                order = np.argsort(led, kind="stable")
                leader, led, leading = leader[order], led[order], leading[order]
            numbers, key, byte = _unpack(data, "<u4", "u1")
            first = np.searchsorted(led, key)
            many = np.searchsorted(led, key, "right") - first
            numbers, first, many, byte = (x[many > 0] for x in (numbers, first, many, byte))
            part = many.cumsum() // PAIRS
            for k in np.unique(part):
                now = part == k
                of_a = _runs(first[now], many[now])
                of_b, byte_b, byte_a = np.repeat(numbers[now], many[now]), np.repeat(byte[now], many[now]), leading[of_a]
                often = np.minimum(byte_a & 15, byte_b & 15)
                often[often == 15] = 255
                other = leader[of_a] != of_b
                held.append([x[other] for x in (of_b, leader[of_a], often, least[(byte_a & 240) | byte_b >> 4])])
                size += int(other.sum())
                if size >= PAIRS:
                    yield flush()
                    held, size = [], 0
    if size:
        yield flush()


def _spread(numbers: np.ndarray, over: np.ndarray) -> np.ndarray:
    """Each number's place among so many, by a hash."""
    return (numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % over


def _tiles(a: np.ndarray, b: np.ndarray, every: int) -> Iterator[tuple[int, int, int, bytes | None]]:
    """Rows (leader, tile, n, others) of all pairs of some classes b, sorted by b and a: others are the a that n is aligned with, or
    null and n one of these. The leader is b's smallest a, which near copies have in common; b has about one `every`th of its group
    as a, which tells the group's size."""
    first = np.flatnonzero(np.diff(b, prepend=-1))
    many = np.diff(np.append(first, len(b)))
    # powers of two, so that classes of one group have the same tiles where their numbers of pairs differ
    power = lambda x: np.repeat(np.exp2(np.ceil(np.log2(np.maximum(x, 1)))).astype(np.int64), many)
    leader, tile = np.repeat(a[first], many), _spread(b, power(every * many / TILE)) << 32 | _spread(a, power(many / TILE))
    for n, other in ((b, a), (a, None)):
        order = np.lexsort((a, n, tile, leader))
        now = [x[order] for x in (leader, tile, n)]
        starts = np.flatnonzero(np.concatenate([[True], np.any([np.diff(x) != 0 for x in now], axis=0)]) if len(n) else [])
        packed = [None] * len(starts) if other is None else [_pack(x) for x in np.split(other[order], starts[1:]) if len(x)]
        yield from zip(*(x[starts].tolist() for x in now), packed, strict=True)


def _candidates(batches: Iterator[pa.RecordBatch], every: int) -> Iterator[pa.RecordBatch]:
    """The rows of _tiles() of the pairs of rows (at, data), sorted by at, that share as many codes as a match holds. A task holds
    the different pairs of one `at`, and PAIRS others or as many again."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    summed = lambda held: _summed(*(np.concatenate(c) for c in zip(*held, strict=True)))

    def told(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        b, a, votes, enough = summed(held)
        rows = list(_tiles(a[votes >= enough], b[votes >= enough], every))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["leader", "tile", "n", "others"])

    now, held, size, most = None, [], 0, PAIRS
    for batch in batches:
        for at, data in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
            if at != now and held:
                yield told(held)
                held, size, most = [], 0, PAIRS
            now = at
            held.append(_unpack(data, "<i8", "u1", "u1"))
            size += len(held[-1][0])
            if size > most:
                held = [summed(held)]
                size = len(held[0][0])
                most = size + max(size, PAIRS)
    if held:
        yield told(held)


def _aligned(batches: Iterator[pa.RecordBatch], bit_error: float) -> Iterator[pa.RecordBatch]:
    """Matches (b, a, id, offset, votes, bit_error, start, length) of rows (leader, tile, n, others, codes, asked), sorted by leader
    and tile, those without others first: a task holds the codes of these of one tile."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
    now, held = None, {}
    for batch in batches:
        rows = []
        for r in range(batch.num_rows):
            *at, n, others = (batch.column(k)[r].as_py() for k in range(4))
            y = np.frombuffer(batch.column(4)[r].as_py(), "<u4")
            in_y = np.argsort(y, kind="stable")
            if at != now:
                now, held = at, {}
            if others is None:
                held[n] = y, in_y, batch.column(5)[r].as_py()
                continue
            for a in _unpack(others)[0].tolist():
                x, in_x, asked = held[a]
                if found := commonest(x, y, in_x, in_y):
                    start, length, equal, error = stretch(x, y, found[0], bit_error)
                    if equal >= _enough(len(x), len(y)):
                        rows.append((n, a, asked, found[0], equal, error, start, length))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["b", "a", "id", "offset", "votes", "bit_error", "start", "length"])


def _among(classes: DataFrame, needed: DataFrame) -> DataFrame:
    """The rows of classes (n, ...) whose number needed (n) has, so that no other codes are exchanged: a bit a number is broadcast."""
    bits = needed.groupBy(F.bitmap_bucket_number("n").alias("_of")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("_bits"))
    at = F.bitmap_bit_position("n")
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (at % 8).cast("int") + 1)
    found = classes.join(F.broadcast(bits), F.bitmap_bucket_number("n") == F.col("_of"))
    return found.where(byte.bitwiseAND(there) != 0).select(*classes.columns)


def matches(known: DataFrame, every: int = EVERY, bit_error: float = BIT_ERROR) -> DataFrame:
    """known (rows of fingerprints()) with copy_of, the smallest id with equal codes, component_id, the smallest id that equal
    codes and matches lead to (a row's own id without them), and `matches`: all ids to look for (the smallest of equal codes) whose
    codes differ but align, with the position of this recording's start in them, and of the stretch that matches the equal
    codes, the bit error, the start in that recording and the length. Empty where nothing aligns, null without codes."""
    known = known.withColumn("class", F.when(F.col("n_codes") > 0, F.xxhash64("codes_sha256")))
    known = cut(known.withColumn("_row", F.monotonically_increasing_id()))  # numbers near each other, which pack well
    parts = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(SALT, BUCKETS * parts)
    # a class has the number of one of its rows, so that neither are its codes exchanged to find it, nor written again
    classes = cut(known.where("class is not null").groupBy("class").agg(F.min("id").alias("copy_of"), F.min(F.when(F.col("id") % every == 0, F.col("id"))).alias("asked"), F.min("_row").alias("n")))
    coded = small_batches(known).select(F.col("_row").alias("n"), "codes")
    posted = lambda of, rows: _among(coded, rows).mapInArrow(partial(_postings, buckets=buckets, of=of), "bucket long, of int, data binary")
    postings = posted(1, classes).union(posted(0, classes.where("asked is not null")))
    met = postings.repartition(parts, "bucket").sortWithinPartitions("bucket", "of").mapInArrow(partial(_meet, parts=parts), "at long, data binary")
    needed = cut(met.repartition(parts, "at").sortWithinPartitions("at").mapInArrow(partial(_candidates, every=every), "leader long, tile long, n long, others binary"))
    asked = needed.where("others is null").distinct().join(classes.select("n", "asked"), "n")
    dealt = asked.unionByName(needed.where("others is not null"), allowMissingColumns=True).join(_among(coded, needed), "n")
    dealt = dealt.select("leader", "tile", "n", "others", "codes", "asked").repartition(parts, "leader", "tile").sortWithinPartitions("leader", "tile", F.col("others").isNotNull())
    found = dealt.mapInArrow(partial(_aligned, bit_error=bit_error), "b long, a long, id long, offset long, votes long, bit_error double, start long, length long")
    lists = cut(found.groupBy("b").agg(F.sort_array(F.collect_list(F.struct("id", "offset", "votes", "bit_error", "start", "length"))).alias("matches"), F.min("a").alias("a"), F.collect_list("a").alias("all")))
    # a class and all that it matches are one component: each is joined with the smallest of these, so that edges grow with rows
    edges = lists.select("a", "b").union(lists.select("a", F.explode("all").alias("b")).where("a != b")).distinct()
    linked = components(edges).withColumnRenamed("id", "_n")
    lists = lists.select("b", "matches")
    told = classes.select("class", "n", "copy_of").join(linked, F.col("n") == F.col("_n"), "left").withColumn("label", F.coalesce("label", "n"))
    smallest = told.groupBy("label").agg(F.min("copy_of").alias("component_id"))
    told = told.join(smallest, "label").join(lists, F.col("n") == F.col("b"), "left").select(F.col("class").alias("_class"), "copy_of", "component_id", "matches")
    empty = F.array().cast("array<struct<id:bigint,offset:bigint,votes:bigint,bit_error:double,start:bigint,length:bigint>>")
    whole = known.join(told, F.col("class") == F.col("_class"), "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return whole.withColumn("matches", F.when(F.col("n_codes") > 0, F.coalesce("matches", empty))).drop("class", "_class", "_row")

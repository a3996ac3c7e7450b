"""Byte-level BPE over a corpus by a global shuffle of distinct words; decoding by the token-byte table.

1. Pre-tokens are taken in place: the documents of an input split form blocks, each with a dictionary of its distinct
   words, and a document becomes the positions' dictionary numbers (one to three bytes a word).
2. The blocks' distinct words are dealt by a hash of the word, packed: one row a block and bucket. All rows of a bucket
   meet in one task, which encodes each distinct word of the corpus once (its cache starts anew beyond CACHE words). A
   word stands once a block, not once an occurrence, so a word that makes up a third of the corpus deals like any other.
3. The ids go back to their blocks, where documents are put together by position.

Memory follows a block: MAX_WORDS distinct words. The two passes over a split number its words alike, because a file
split is read in one order; each document carries a checksum of its bytes, and one that comes back unlike it raises.

Defined results: a null text is empty and has no ids; an empty table gives no rows; rows that repeat a doc_id, and null
doc_ids, are encoded row by row; further columns of docs are not read. Special-token strings are ordinary text.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockwire.llm.common import small_batches, text_of

RANKS = "byte_bpe_50k.tiktoken"
#: Distinct words of a block.
MAX_WORDS = 250_000
#: Words whose ids a task keeps.
CACHE = 400_000
#: White space as the library's engine has it (Unicode's White_Space; Python's \s also has \x1c-\x1f).
_WS = r"\t-\r \x85\xa0  -     　"
_ANY = regex.compile(public_tokenizers.PATTERN.replace(r"[^\s", f"[^{_WS}").replace(r"\S", f"[^{_WS}]").replace(r"\s", f"[{_WS}]"))
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
#: The same for texts within Latin-1, where letters and numbers are few enough to list.
_LATIN = re.compile(rf" ?[{_L}]+| ?[{_N}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^{_L}{_N}\t-\r \x85\xa0]+|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+")


def pretokens(text: str) -> list[str]:
    """The matches of the tokenizer's pattern, in order; together they are the text."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _ANY.findall(text)
    return _LATIN.findall(text)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_loaded: dict[str, tuple] = {}


def tokenizer(path: str) -> tuple[tiktoken.Encoding, list[bytes]]:
    """The encoding and its token-byte table, loaded once a worker. The table is as long as the vocabulary."""
    if path not in _loaded:
        ranks = load_ranks(path)
        table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        _loaded[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), table
    return _loaded[path]


class Numbered(dict):
    """Gives each new key the next number."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def pack(codes: np.ndarray) -> bytes:
    """Numbers below 2**21 in one to three bytes each, seven bits a byte, low bits first."""
    size = 1 + (codes >= 1 << 7) + (codes >= 1 << 14)
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    start = end - size
    out[start] = (codes & 127) | ((size > 1) << 7)
    for k in (1, 2):
        at = size > k
        out[start[at] + k] = ((codes[at] >> (7 * k)) & 127) | ((size[at] > k + 1) << 7)
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    last = raw < 128
    start = np.concatenate(([0], np.flatnonzero(last)[:-1] + 1))
    shift = 7 * (np.arange(len(raw)) - np.repeat(start, np.diff(np.append(start, len(raw)))))
    return np.add.reduceat((raw & 127).astype(np.int64) << shift, start)


_SCHEMA = "block long, kind int, n long, doc_id long, size long, data binary"


def _rows(block: list, kind: int, n: list, doc_id: list, size: list, data: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(block, pa.int64()), pa.array([kind] * len(block), pa.int32()), pa.array(n, pa.int64()), pa.array(doc_id, pa.int64()), pa.array(size, pa.int64()), pa.array(data, pa.binary())],
        names=["block", "kind", "n", "doc_id", "size", "data"],
    )


def pack_lists(numbers: np.ndarray, items: list[bytes]) -> bytes:
    """Ascending numbers and an item for each, compressed."""
    parts = [pack(np.diff(numbers, prepend=0)), pack(np.fromiter(map(len, items), np.int64, len(items)))]
    return zlib.compress(b"".join((len(p).to_bytes(4, "little") + p for p in parts)) + b"".join(items), 3)


def unpack_lists(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    data, parts = zlib.decompress(data), []
    for _ in range(2):
        end = 4 + int.from_bytes(data[:4], "little")
        parts.append(unpack(data[4:end]))
        data = data[end:]
    ends = np.cumsum(parts[1]).tolist()
    return np.cumsum(parts[0]), [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _split(buckets: int | None, max_words: int):
    """Over the rows of a split, in order: with buckets, the words of each block by bucket (kind 0), else the documents as
    numbers (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seen, count = None, Numbered(), 0

        def flush() -> Iterator[pa.RecordBatch]:
            words = list(map(str.encode, seen))
            bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
            order = np.argsort(bucket, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                yield _rows([block], 0, [int(bucket[some[0]])], [None], [None], [pack_lists(some, [words[k] for k in some.tolist()])])

        for batch in batches:
            if block is None and batch.num_rows:
                block = batch.column(2)[0].as_py() << 24
            for at in range(0, batch.num_rows, 256):
                ids, texts = (batch.slice(at, 256).column(k).to_pylist() for k in (0, 1))
                out: tuple[list, list, list, list, list] = ([], [], [], [], [])
                for doc_id, text in zip(ids, texts, strict=True):
                    found = pretokens(text)
                    codes = np.fromiter(map(seen.__getitem__, found), np.int64, len(found))
                    if not buckets:
                        for column, value in zip(out, (block, count, doc_id, zlib.crc32(text.encode()), pack(codes)), strict=True):
                            column.append(value)
                    count += 1
                    if len(seen) >= max_words:
                        if buckets:
                            yield from flush()
                        seen.clear()
                        block += 1
                if not buckets:
                    yield _rows(out[0], 1, *out[1:])
        if buckets and seen:
            yield from flush()

    return run


class _Encoder(dict):
    """A word's ids as bytes, encoded when first asked for."""

    def __init__(self, path: str):
        super().__init__()
        encoding, table = tokenizer(path)
        self.encode, self.kind = encoding.encode_ordinary, _kind(table)

    def __missing__(self, word: bytes) -> bytes:
        ids = self[word] = np.array(self.encode(word.decode()), self.kind).tobytes()  # a pre-token by itself is one match again
        return ids


def _kind(table: list[bytes]) -> type:
    return np.uint16 if len(table) <= 1 << 16 else np.uint32


def _encode_words(path: str):
    """The words of a bucket's blocks to their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Encoder(path)
        for batch in batches:
            for block, n, data in zip(*(batch.column(k).to_pylist() for k in (0, 2, 5)), strict=True):
                numbers, words = unpack_lists(data)
                if len(known) > CACHE:
                    known.clear()
                yield _rows([block], 0, [n], [None], [None], [pack_lists(numbers, list(map(known.__getitem__, words)))])

    return run


def _reassemble(path: str, decoded: bool):
    """Rows sorted by block, words first: each document's ids, by position, and their bytes if these are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tokenizer(path)[1]
        kind, block, word_ids = _kind(table), None, {}
        for batch in batches:
            blocks, kinds, ids, checks, data = (batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5))
            doc_ids, rows, texts, held = [], [], [], 0
            for b, k, doc_id, check, x in zip(blocks, kinds, ids, checks, data, strict=True):
                if b != block:
                    block, word_ids = b, {}
                if k == 0:
                    numbers, items = unpack_lists(x)
                    word_ids.update(zip(numbers.tolist(), items, strict=True))
                    continue
                tokens = np.frombuffer(b"".join(map(word_ids.__getitem__, unpack(x).tolist())), kind)
                text = join_bytes(tokens, table)
                if zlib.crc32(text) != check:
                    raise ValueError(f"document {doc_id} does not come back from its words: its split was not read twice alike")
                doc_ids.append(doc_id)
                rows.append(tokens)
                texts.append(text)
                held += len(tokens)
                if held > 1 << 20:
                    yield _ids(doc_ids, rows, texts if decoded else None)
                    doc_ids, rows, texts, held = [], [], [], 0
            if rows:
                yield _ids(doc_ids, rows, texts if decoded else None)

    return run


def join_bytes(ids: np.ndarray, table: list[bytes]) -> bytes:
    """Decoding: each id's bytes from the token-byte table, joined."""
    return b"".join(map(table.__getitem__, ids.tolist()))


def _ids(doc_ids: list, rows: list[np.ndarray], texts: list[bytes] | None) -> pa.RecordBatch:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    values = np.concatenate(rows).astype(np.int32)
    columns = [pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))]
    if texts is not None:
        columns.append(pa.array(texts, pa.binary()))
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "bytes"][: len(columns)])


def encode(docs: DataFrame, ranks: str | None = None, max_words: int = MAX_WORDS, decoded: bool = False) -> DataFrame:
    """doc_id and ids (array of int) of every row of docs (doc_id, text); with decoded, also what decode() would add, from
    the ids and in the same task. docs has to read the same rows in the same
    order twice, as tables and files do; a document for which it didn't raises."""
    path = ranks or public_tokenizers.path(RANKS)
    if max_words > 1 << 20:
        raise ValueError("max_words: 2**20 at most, so that numbers fit three bytes")
    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"), F.spark_partition_id().alias("split"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = texts.mapInArrow(_split(parts, max_words), _SCHEMA).repartition(parts, "n")
    encoded = words.mapInArrow(_encode_words(path), _SCHEMA)
    numbers = texts.mapInArrow(_split(None, max_words), _SCHEMA)
    return encoded.unionByName(numbers).repartition(parts, "block").sortWithinPartitions("block", "kind", "n").mapInArrow(_reassemble(path, decoded), "doc_id long, ids array<int>" + ", bytes binary" * decoded)


def decode(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """Adds `bytes`: each id's bytes from the token-byte table, joined. Null ids give null."""
    path = ranks or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tokenizer(path)[1]
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = part.column(at)
                values, offsets, null = ids.values.to_numpy(), ids.offsets.to_numpy(), ids.is_null().to_pylist()
                out = [None if none else join_bytes(values[a:b], table) for a, b, none in zip(offsets[:-1], offsets[1:], null, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=[*part.schema.names, "bytes"])

    fields = [f for f in encoded.schema.fields]
    schema = type(encoded.schema)([*fields]).add("bytes", "binary")
    return small_batches(encoded).mapInArrow(run, schema)


def digests(decoded: DataFrame, *also: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the columns named, of what decode() gives."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("bytes"), 256).alias("decoded_sha256"), *also)

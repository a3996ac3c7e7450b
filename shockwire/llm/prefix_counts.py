"""Token counts of every prefix of a text by dynamic programming over prefixes.

BPE gives the token sequence in which every two neighbours are what BPE gives for the two alone. So the last token of a
prefix is the one piece t that ends there and stands in BPE's own result beside the last token of the prefix before t;
count[i] = count[i - len(t)] + 1. One pass over a text fills the counts of all its prefixes, and truncation and budget
questions are then look-ups, without encoding again.

No piece holds a space mark after another character, so tokens never cross into the next word: the programme runs over
a distinct word once and a document's table is its words' tables laid end to end, one signed byte a code point (the
change of the count). Words are kept in a bounded per-worker cache.

A character outside the vocabulary costs its UTF-8 bytes (byte fallback), as in the library.

Defined results: a null text is empty, with 0 tokens; an empty table gives no rows; repeated rows and null doc_ids are
counted row by row; further columns of docs are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockwire.llm.common import map_rows, small_batches, text_of

MODEL = "piece_bpe_32k.model"
MARK = "▁"
_SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Words of a worker's cache, in each of two generations.
CACHE = 300_000


class PrefixCounter:
    """Prefix counts under one sentencepiece BPE model (identity normaliser, dummy prefix, byte fallback)."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not special(i)}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.score):
            raise ValueError("a piece crosses words; this model can't be counted word by word")
        self.longest = max(map(len, self.score))
        if self.longest > 120:
            raise ValueError("a piece is too long for one byte a change")
        #: Pieces that BPE gives for their own text, by last character: what can end a prefix.
        self.stands = {p for p in self.score if len(p) == 1 or len(self.merge(p)) == 1}
        #: Lengths of the pieces that end with three given characters, longest first.
        ends: dict[str, set[int]] = {}
        for p in self.stands:
            if len(p) > 2:
                ends.setdefault(p[-3:], set()).add(len(p))
        self.lengths = {c: tuple(sorted(x, reverse=True)) + (2, 1) for c, x in ends.items()}
        #: For a token, the tokens asked about so far and whether they can stand after it.
        self.after: dict[str, dict[str, bool]] = {}
        self.asked = 0
        self.table: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def merge(self, text: str) -> list[str]:
        """BPE by its definition: merge the neighbours whose union scores highest, the leftmost of equals, until none."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        self.asked += 1
        ok = self.after[left][right] = self.merge(left + right) == [left, right]
        return ok

    def word(self, segment: str) -> bytes:
        """The changes of the count at each character of a segment."""
        n, stands, lengths, after = len(segment), self.stands, self.lengths, self.after
        if self.asked > 1_000_000:
            after.clear()
            self.asked = 0
        count, last, change = [0] * (n + 1), [""] * (n + 1), bytearray(n)
        beside: list[dict[str, bool] | None] = [None] * (n + 1)
        for i in range(1, n + 1):
            for size in lengths.get(segment[i - 3 : i], (2, 1)) if i > 2 else (2, 1):
                at = i - size
                if at < 0:
                    continue
                token = segment[at:i]
                if token not in stands:
                    if size > 1:
                        continue
                    cost = len(token.encode())
                else:
                    cost = 1
                if at:
                    ok = beside[at].get(token)
                    if ok is None:
                        ok = self.fits(last[at], token)
                    if not ok:
                        continue
                last[i] = token
                if token not in after:
                    after[token] = {}
                beside[i] = after[token]
                count[i] = count[at] + cost
                change[i - 1] = (count[i] - count[i - 1]) & 255
                break
            else:
                raise AssertionError(f"no last token in {segment[:i]!r}")
        return bytes(change)

    def changes(self, text: str) -> bytes:
        """One signed byte a code point of text: the count of text[: i + 1] less that of text[: i]."""
        if not text:
            return b""
        table, parts = self.table, _SEGMENT.findall(MARK + text.replace(" ", MARK))
        try:
            found = list(map(table.__getitem__, parts))
        except KeyError:
            for p in parts:
                if p not in table:
                    table[p] = self.before.pop(p, None) or self.word(p)
            found = list(map(table.__getitem__, parts))
        if len(table) > CACHE:
            self.before, self.table = table, {}
        first = found[0]  # its first character is the mark that the library puts before a text
        found[0] = bytes([(first[0] + first[1]) & 255]) + first[2:]
        return b"".join(found)


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def prefix_counts(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and changes (binary, one signed byte a code point) of every row of docs (doc_id, text)."""
    path = model or public_tokenizers.path(MODEL)

    def make():
        c = counter(path)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            changes = [c.changes(t) for t in batch.column(2).to_pylist()]
            totals = [int(np.frombuffer(x, np.int8).sum(dtype=np.int64)) for x in changes]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(totals, pa.int64()), pa.array(changes, pa.binary())], names=["doc_id", "n_bytes", "n_tokens", "changes"])

        return f

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text_of("text")).cast("long").alias("n_bytes"), text_of("text").alias("text"))
    return map_rows(texts, make, "doc_id long, n_bytes long, n_tokens long, changes binary")


def tokens_at(counted: DataFrame, length: str) -> DataFrame:
    """Adds `tokens_at`: the tokens of the prefix of so many code points (column `length`; beyond the text: all)."""
    return _ask(counted, length, "tokens_at", lambda sums, n: int(sums[min(n, len(sums)) - 1]) if n > 0 and len(sums) else 0)


def longest_within(counted: DataFrame, budget: str) -> DataFrame:
    """Adds `longest_within`: code points of the longest prefix of at most so many tokens (column `budget`)."""

    def longest(sums: np.ndarray, most: int) -> int:
        fits = np.flatnonzero(sums <= most)
        return int(fits[-1]) + 1 if len(fits) else 0

    return _ask(counted, budget, "longest_within", longest)


def _ask(counted: DataFrame, column: str, name: str, answer) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, of = (batch.schema.get_field_index(c) for c in ("changes", column))
            out = [None if x is None or q is None else answer(np.cumsum(np.frombuffer(x, np.int8), dtype=np.int64), q) for x, q in zip(batch.column(at).to_pylist(), batch.column(of).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, name])

    return small_batches(counted).mapInArrow(run, type(counted.schema)(list(counted.schema.fields)).add(name, "long"))

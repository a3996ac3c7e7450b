"""WARC archives with a two-level capture index.

Writing: equal payloads of at least MIN_REVISIT bytes keep one response record, that of the smallest page_id; the others
are revisit records without payload that refer to it. Each record is a gzip member of its own; tasks lay members end to
end into .warc.gz files of about ARCHIVE_BYTES in the shared folder. A file's name is its task attempt's own, and only the
captures of attempts that succeed are kept, so a lost or repeated attempt leaves files that nothing points to.

Index: a line a capture, keyed by the URL with its host reversed and the page_id, range-partitioned and sorted, cut into
compressed blocks; the directory keeps each block's first key. A block has at least BLOCK_LINES lines and enough of them
that the directory stays below MAX_DIRECTORY entries of KEY_CHARS characters: that bounds what is broadcast.

Look-up: binary search in the directory, then in the block, then a range read of the archive: a task reads the bytes of
the records asked for, and no others. Keys and blocks meet sorted by block, so a task holds one block, whatever the
number of its keys; places meet sorted by archive, so that a file is opened once and read forwards.

Defined results: a null html is the empty payload; a null url is written without target and keyed as the empty text; a
null page_id comes last (it is a response only where no other record has its payload); rows that repeat page_id and
payload are written and read back row by row; an empty table gives no rows; further columns are not read. Control
characters in a URL are percent-encoded, so that a record's header can't be broken.
"""

from __future__ import annotations

import bisect
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shockwire.llm.common import cut, file_system, shared_folder, small_batches, text_of

MIN_REVISIT = 100
ARCHIVE_BYTES = 4_000_000
BLOCK_LINES = 512
MAX_DIRECTORY = 65_536
KEY_CHARS = 200
LEVEL = 4
#: Bytes that are read at once when an archive is read forwards.
CHUNK = 16_384
DATE = "1970-01-01T00:00:00Z"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def url_key(url: str | None) -> str:
    """The URL with its host reversed: http://www.example.com:80/a?b -> com,example,www:80)/a?b."""
    if not url:
        return ""
    url = _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return url
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + rest


def capture_key(url: str | None, page_id: int | None) -> str:
    return f"{url_key(url)} {'-' if page_id is None else page_id}"


def plan(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, refers_to of every row of pages (page_id, url, html). Groups of equal payloads are
    found on rows without payload; payloads move once, by page_id."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    ids = base.where(F.octet_length("payload") >= MIN_REVISIT).select("page_id", "digest")
    first = ids.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null").drop("n")
    revisits = ids.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()
    revisits = revisits.select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), "refers_to")
    return base.join(revisits, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("digest") == F.col("_d")), "left").select("page_id", "url", "payload", "digest", "refers_to")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC record as a gzip member."""
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>".encode(), f"WARC-Date: {DATE}".encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url).encode())
    head.append(f"WARC-Payload-Digest: sha256:{digest}".encode())
    if refers_to is None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    else:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>".encode(), b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse(source: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload of each record of gzip members laid end to end, read forwards in small pieces."""
    rest = source.read(CHUNK)
    while rest:
        unpacker, text = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not rest:
                raise ValueError("the archive ends within a record")
            text.append(unpacker.decompress(rest))
            rest = unpacker.unused_data or source.read(CHUNK)
        head, _, body = b"".join(text).partition(b"\r\n\r\n")
        names = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield names, body[: int(names["Content-Length"])].partition(b"\r\n\r\n")[2]


def write(planned: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives of planned records into a folder that all executors share (a new one in the shared folder, if
    none is named) and returns their captures: key, archive, offset, length."""
    folder = folder or f"{shared_folder(planned.sparkSession)}/warc-{uuid.uuid4().hex}"
    files, path = file_system(folder)
    files.create_dir(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        files, path = file_system(folder)
        name, n, size, out = f"{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}", 0, 0, None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                captures: tuple[list, list, list, list] = ([], [], [], [])
                for page_id, url, payload, digest, refers_to in zip(*(batch.slice(at, 256).column(k).to_pylist() for k in range(5)), strict=True):
                    if out is None:
                        archive = f"{folder}/{name}-{n:04d}.warc.gz"
                        out, size, n = files.open_output_stream(f"{path}/{name}-{n:04d}.warc.gz", compression=None), 0, n + 1
                    member = record(page_id, url, payload, digest, refers_to)
                    out.write(member)
                    for column, value in zip(captures, (capture_key(url, page_id), archive, size, len(member)), strict=True):
                        column.append(value)
                    size += len(member)
                    if size >= archive_bytes:
                        out.close()
                        out = None
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(captures, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "archive", "offset", "length"])
        if out is not None:
            out.close()

    return cut(small_batches(planned).mapInArrow(run, "key string, archive string, offset long, length long"))


def build_index(captures: DataFrame) -> DataFrame:
    """The index's blocks (block, first_key, lines): sorted lines of key, archive, offset, length, compressed."""
    rows = captures.count()
    size = max(BLOCK_LINES, -(-rows // (MAX_DIRECTORY // 2)))
    parts = max(1, min(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // size)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held = TaskContext.get().partitionId(), 0, []

        def row(some: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + n], pa.int64()), pa.array([some[0].split("\t", 1)[0]]), pa.array([zlib.compress("\n".join(some).encode(), LEVEL)], pa.binary())], names=["block", "first_key", "lines"])

        for batch in batches:
            held += map("\t".join, zip(*(map(str, batch.column(k).to_pylist()) for k in range(4)), strict=True))
            while len(held) >= size:
                yield row(held[:size])
                n, held = n + 1, held[size:]
        if held:
            yield row(held)

    order = ["key", "archive", "offset"]
    return cut(small_batches(captures).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, "block long, first_key string, lines binary"))


def look_up(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """The captures of wanted (page_id, url), read by range from the archives: page_id, record_type, refers_to,
    payload_bytes, payload_digest (both of the record's own payload, null for revisits), said_digest."""
    directory = sorted((r["first_key"][:KEY_CHARS], r["block"]) for r in index.select("first_key", "block").toLocalIterator())
    if len(directory) > MAX_DIRECTORY:
        raise ValueError("the directory is longer than its bound")
    shared = index.sparkSession.sparkContext.broadcast(([k for k, _ in directory], [b for _, b in directory]))

    def find_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, blocks = shared.value
        for batch in batches:
            keys, found = [], []
            for page_id, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key = capture_key(url, page_id)
                low, high = (f(firsts, key[:KEY_CHARS]) for f in (bisect.bisect_left, bisect.bisect_right))
                for at in range(max(0, low - 1), high):
                    keys.append(key)
                    found.append(blocks[at])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(keys, pa.string())], names=["block", "key"])

    def find_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by block, its lines first and then keys."""
        held, known, rows = None, [], []
        for batch in batches:
            places: tuple[list, list, list] = ([], [], [])
            for block, data, key in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if data is not None:
                    held, rows = block, [line.split("\t") for line in zlib.decompress(data).decode().split("\n")]
                    known = [r[0] for r in rows]
                    continue
                at = bisect.bisect_left(known, key) if block == held else len(rows)
                while at < len(rows) and known[at] == key:
                    for column, value in zip(places, (rows[at][1], int(rows[at][2]), int(rows[at][3])), strict=True):
                        column.append(value)
                    at += 1
            yield pa.RecordBatch.from_arrays([pa.array(places[0], pa.string()), pa.array(places[1], pa.int64()), pa.array(places[2], pa.int64())], names=["archive", "offset", "length"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by archive and offset."""
        opened, source = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for archive, offset, length in zip(*(batch.slice(at, 256).column(k).to_pylist() for k in range(3)), strict=True):
                    if archive != opened:
                        files, path = file_system(archive)
                        opened, source = archive, files.open_input_file(path)
                    out += map(_facts, parse(io.BytesIO(source.read_at(length, offset))))
                yield _fact_rows(out)

    keys = small_batches(wanted).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).distinct().mapInArrow(find_blocks, "block long, key string").distinct()
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = index.select("block", "lines", F.lit(None).cast("string").alias("key")).unionByName(keys.select("block", F.lit(None).cast("binary").alias("lines"), "key"))
    places = met.repartition(parts, "block").sortWithinPartitions("block", F.col("lines").isNull(), "key").mapInArrow(find_places, "archive string, offset long, length long")
    return places.repartition(parts, "archive").sortWithinPartitions("archive", "offset").mapInArrow(read, _FACTS)


_FACTS = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, said_digest string"


def _number(urn: str | None) -> int | None:
    return None if urn is None or urn == "<urn:page:none>" else int(urn[len("<urn:page:") : -1])


def _facts(parsed: tuple[dict[str, str], bytes]) -> tuple:
    names, payload = parsed
    kind, said = names["WARC-Type"], names["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "revisit":
        return _number(names["WARC-Record-ID"]), kind, _number(names["WARC-Refers-To"]), None, None, said
    digest = hashlib.sha256(payload).hexdigest()
    if digest != said:
        raise ValueError(f"{names['WARC-Record-ID']}: the payload is not the one that was written")
    return _number(names["WARC-Record-ID"]), kind, None, len(payload), digest, said


def _fact_rows(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) if out else [[]] * 6
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    names = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "said_digest"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def resolve(facts: DataFrame) -> DataFrame:
    """Gives revisits the size and digest of the payload they refer to. A revisit without its response gets nulls."""
    held = facts.where("record_type = 'response'").select(F.col("page_id").alias("_p"), F.col("payload_digest").alias("_d"), F.col("payload_bytes").alias("_n")).distinct()
    joined = facts.join(held, (F.col("refers_to") == F.col("_p")) & (F.col("said_digest") == F.col("_d")), "left")
    return joined.select("page_id", F.coalesce("payload_bytes", "_n").alias("payload_bytes"), F.coalesce("payload_digest", "_d").alias("payload_digest"), "record_type", "refers_to")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages, indexes the archives, and reads every capture back through the index."""
    return resolve(look_up(pages, build_index(write(plan(pages)))))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The facts of every record of the .warc.gz files under path, streamed, one record at a time in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                files, path = file_system(archive)
                with files.open_input_stream(path, compression=None) as source:
                    for parsed in parse(source):
                        yield _fact_rows([_facts(parsed)])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("path").mapInArrow(run, _FACTS)


ORACLE = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
q AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= {MIN_REVISIT} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id = page_id THEN NULL ELSE first_id END AS refers_to FROM r
"""

"""S2 to S4 as a data source: CSV files and workbooks, one partition a file, read as streams of rows.

A workbook's sheet is parsed element by element and a row is forgotten once it is sent, so a task's memory follows a batch of rows
(and the workbook's table of shared texts), not the sheet. Only the columns asked for are decoded. CSV files are tried in
each of ENCODINGS by one decoding pass, then read in pieces.

Defined results: all columns are text; columns that a file lacks and empty cells are null; a column name that stands twice is its
first; files that can't be read (no workbook, no encoding fits, no rows) give no rows; the file's name is in `file`.
"""

from __future__ import annotations

import codecs
import json
import posixpath
import re
import zipfile
from collections.abc import Iterator
from typing import IO
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from shockwire.sources.shared import file_system

#: Tried in order on a file's bytes.
ENCODINGS = ("utf-8-sig", "utf-8", "cp949", "euc-kr")
#: Rows of a batch, bytes of a piece of a file.
ROWS, PIECE = 4096, 1 << 20
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def encoding_of(file: IO[bytes]) -> str | None:
    """The first of ENCODINGS that decodes the whole file, read in pieces; None where none does."""
    for name in ENCODINGS:
        decoder = codecs.getincrementaldecoder(name)()
        file.seek(0)
        try:
            while piece := file.read(PIECE):
                decoder.decode(piece)
            decoder.decode(b"", True)
            return name
        except UnicodeDecodeError:
            continue
    return None


def csv_rows(file: IO[bytes], columns: list[str]) -> Iterator[list[list[str | None]]]:
    """Batches of the columns' values."""
    name = encoding_of(file)
    file.seek(0)
    if name is None:
        return
    first: list[str] = []  # read too: a file that lacks all columns has rows of nulls

    def wanted(column: str) -> bool:
        if not first:
            first.append(column)
        return column in columns or column == first[0]

    try:
        for frame in pd.read_csv(file, dtype=str, chunksize=ROWS, encoding=name, usecols=wanted):
            frame = frame.reindex(columns=columns).astype(object)
            if len(frame):
                yield frame.where(frame.notna(), None).values.tolist()
    except pd.errors.EmptyDataError:
        return


def _elements(stream: IO[bytes], tag: str) -> Iterator[ElementTree.Element]:
    """Elements of a name as they end; what they and their elder siblings held is let go after each."""
    parents: list[ElementTree.Element] = []
    for event, element in ElementTree.iterparse(stream, ("start", "end")):
        if event == "start":
            parents.append(element)
            continue
        parents.pop()
        if element.tag == f"{_NS}{tag}":
            yield element
            if parents:
                parents[-1].clear()


def _column(reference: str) -> int:
    """The number of a cell's column, from 0; -1 where the reference has none."""
    n = 0
    for c in re.match(r"[A-Z]*", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_names(book: zipfile.ZipFile) -> list[str]:
    """The sheets' members, in the workbook's order."""
    try:
        order = [s.get(f"{_REL}id") for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_NS}sheet")]
        links = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        found = [posixpath.normpath(posixpath.join("xl", links[i].lstrip("/").removeprefix("xl/"))) for i in order if i in links]
    except KeyError:  # a book without its parts' list
        found = []
    there = set(book.namelist())
    return [n for n in found if n in there] or sorted((n for n in there if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))


def _cell(cell: ElementTree.Element, shared: pa.Array) -> str | None:
    value = cell.find(f"{_NS}v")
    if cell.get("t") == "s" and value is not None:
        return shared[int(value.text)].as_py()
    if cell.get("t") == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_NS}t"))
    return None if value is None else value.text


def sheet_rows(file: IO[bytes], columns: list[str], every_sheet: bool = False) -> Iterator[list[list[str | None]]]:
    """Batches of the columns' values of a workbook's first sheet, or of all its sheets; each has a header."""
    if file.seek(0, 2) < 22:  # shorter than an empty archive
        raise zipfile.BadZipFile("no workbook")
    with zipfile.ZipFile(file) as book:
        shared = pa.array([], pa.string())
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as stream:  # texts once each, as Arrow's bytes
                shared = pa.array(("".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in _elements(stream, "si")), pa.string())
        for sheet in sheet_names(book)[: None if every_sheet else 1]:
            with book.open(sheet) as stream:
                place: dict[int, list[int]] | None = None  # a sheet's column -> where its values go
                batch: list[list[str | None]] = []
                for row in _elements(stream, "row"):
                    at, out = -1, [None] * len(columns)
                    header: dict[str, int] = {}
                    for cell in row.iter(f"{_NS}c"):
                        known = _column(cell.get("r", ""))
                        at = known if known >= 0 else at + 1
                        if place is None:
                            header.setdefault(_cell(cell, shared) or "", at)
                        elif at in place:
                            value = _cell(cell, shared)
                            for k in place[at]:
                                out[k] = value
                    if place is None:
                        place = {}
                        for k, c in enumerate(columns):
                            if c in header:
                                place.setdefault(header[c], []).append(k)
                        continue
                    batch.append(out)
                    if len(batch) == ROWS:
                        yield batch
                        batch = []
                if batch:
                    yield batch


class FilePartition(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class TableReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.schema, self.files, self.every = schema, json.loads(options["files"]), options.get("sheets", "first") == "all"

    def partitions(self) -> list[FilePartition]:
        return [FilePartition(f) for f in self.files]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in self.schema.fields]
        columns, name = [n for n in names if n != "file"], partition.path.rsplit("/", 1)[-1]
        system, path = file_system(partition.path)
        with system.open_input_file(path) as file:
            try:
                for rows in sheet_rows(file, columns, self.every) if name.lower().endswith(".xlsx") else csv_rows(file, columns):
                    values = dict(zip(columns, zip(*rows, strict=True), strict=True)) | {"file": [name] * len(rows)}
                    yield pa.RecordBatch.from_arrays([pa.array(list(values[n]), pa.string()) for n in names], names=names)
            except (zipfile.BadZipFile, KeyError, IndexError, ElementTree.ParseError, pd.errors.ParserError):
                return  # what was read so far stands


class TableFiles(DataSource):
    """Format `table_files`: option files (a JSON list of paths), sheets (first or all), and a schema of text columns."""

    @classmethod
    def name(cls) -> str:
        return "table_files"

    def reader(self, schema: StructType) -> TableReader:
        return TableReader(schema, self.options)


def read_tables(spark: SparkSession, path: str, columns: list[str], pattern: str = "*.{csv,xlsx}", sheets: str = "first") -> DataFrame:
    """The columns of every file under path that the pattern names, and `file`. Spark lists the files."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path")
    files = sorted(r[0] for r in found.collect())  # names of files
    spark.dataSource.register(TableFiles)
    schema = StructType()
    for c in [*dict.fromkeys(columns), "file"]:
        schema = schema.add(c, "string")
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.format("table_files").schema(schema).option("files", json.dumps(files)).option("sheets", sheets).load()

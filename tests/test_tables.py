"""The data source of CSV files and workbooks, and the cache of a service."""

import random
import tracemalloc
import zipfile

import pytest

from shockwire.sources import files, tables

HEAD = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'


def letters(n):
    out = ""
    while n >= 0:
        out, n = chr(65 + n % 26) + out, n // 26 - 1
    return out


def book(path, sheets, shared=(), order=None):
    """A workbook of sheets (name of the member -> rows of (kind, value) or None); order: their place in the book."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        if shared:
            z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">' + "".join(f"<si><r><t>{s[:2]}</t></r><r><t>{s[2:]}</t></r></si>" for s in shared) + "</sst>")
        if order:
            z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{i}" r:id="r{i}"/>' for i in range(len(order))) + "</sheets></workbook>")
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="{"/xl/" if i % 2 else ""}worksheets/{n}.xml"/>' for i, n in enumerate(order)) + "</Relationships>")
        for name, rows in sheets.items():
            cell = lambda r, c, x: "" if x is None else f'<c r="{letters(c)}{r}" t="inlineStr"><is><t>{x[1]}</t></is></c>' if x[0] == "text" else f'<c r="{letters(c)}{r}" t="s"><v>{x[1]}</v></c>' if x[0] == "shared" else f'<c r="{letters(c)}{r}"><v>{x[1]}</v></c>'
            z.writestr(f"xl/worksheets/{name}.xml", HEAD + "".join("<row>" + "".join(cell(i + 1, c, x) for c, x in enumerate(row)) + "</row>" for i, row in enumerate(rows)) + "</sheetData></worksheet>")


def text(*values):
    return [None if v is None else ("text", v) for v in values]


def test_workbooks(spark, tmp_path):
    wide = text(*[f"h{k}" for k in range(40)])
    book(tmp_path / "a.xlsx", {"sheet1": [wide, text(*[f"v{k}" for k in range(40)]), [*[None] * 30, ("number", "4.5")]], "sheet2": [text("h30", "h0"), [("shared", 1), None]]}, ["one", "two texts"], ["sheet2", "sheet1"])
    got = lambda **o: sorted(map(tuple, tables.read_tables(spark, f"file://{tmp_path}", ["h30", "h0", "none"], "*.xlsx", **o).collect()), key=repr)
    assert got() == [("two texts", None, None, "a.xlsx")]  # the book's first sheet, not the first member
    assert got(sheets="all") == sorted([("two texts", None, None, "a.xlsx"), ("v30", "v0", None, "a.xlsx"), ("4.5", None, None, "a.xlsx")], key=repr)
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    book(tmp_path / "empty.xlsx", {"sheet1": []})
    book(tmp_path / "twice.xlsx", {"sheet1": [text("h0", "h0"), text("first", "second")]})
    assert got() == sorted([("two texts", None, None, "a.xlsx"), (None, "first", None, "twice.xlsx")], key=repr)
    assert tables.read_tables(spark, f"file://{tmp_path}", ["a"], "*.nothing").count() == 0


def test_one_partition_a_file(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"{k}.csv").write_bytes("name,날짜\n".encode("cp949") + "".join(f"r{k}-{i},하나\n" for i in range(k)).encode("cp949"))
    df = tables.read_tables(spark, f"file://{tmp_path}", ["날짜", "name"])
    assert df.rdd.getNumPartitions() == 5
    assert {tuple(r) for r in df.collect()} == {("하나", f"r{k}-{i}", f"{k}.csv") for k in range(5) for i in range(k)}
    (tmp_path / "none.csv").write_bytes(b"name\n\xff\xfe\xff\x81")  # no encoding fits
    (tmp_path / "0.csv").write_bytes(b"")
    assert tables.read_tables(spark, f"file://{tmp_path}", ["name"]).count() == 10
    assert {tuple(r) for r in tables.read_tables(spark, f"file://{tmp_path}", ["other"]).where("file = '2.csv'").collect()} == {(None, "2.csv")}


def test_encodings_of_long_files(tmp_path):
    """A character of several bytes over the end of a piece, and a bad byte after the first piece."""
    path = tmp_path / "a.csv"
    path.write_bytes(b"a" * (tables.PIECE - 1) + "é".encode())
    with path.open("rb") as f:
        assert tables.encoding_of(f) == "utf-8-sig"
    path.write_bytes(b"a" * tables.PIECE + "하나".encode("cp949"))
    with path.open("rb") as f:
        assert tables.encoding_of(f) == "cp949"


def test_memory_follows_a_batch(tmp_path):
    """A sheet of 40 MB is read within 10 MB, and only the columns asked for are decoded."""
    path, n = tmp_path / "long.xlsx", 80_000
    rnd = random.Random(1)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z, z.open("xl/worksheets/sheet1.xml", "w") as f:
        f.write((HEAD + "<row>" + "".join(f'<c t="inlineStr"><is><t>h{c}</t></is></c>' for c in range(8)) + "</row>").encode())
        for i in range(n):
            f.write(("<row>" + "".join(f'<c t="inlineStr"><is><t>{i}-{c}-{rnd.random()}</t></is></c>' for c in range(8)) + "</row>").encode())
        f.write(b"</sheetData></worksheet>")
    with zipfile.ZipFile(path) as z:
        assert z.getinfo("xl/worksheets/sheet1.xml").file_size > 38_000_000
    tracemalloc.start()
    with path.open("rb") as f:
        rows = 0
        for batch in tables.sheet_rows(f, ["h7", "h2"]):
            assert batch[0][0].startswith(f"{rows}-7-") and batch[0][1].startswith(f"{rows}-2-")
            rows += len(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == n and peak < 10_000_000


def test_cache_without_a_key(spark, tmp_path):
    cache, schema = f"file://{tmp_path}/cache", "year_month string, value double"

    def no_key():
        raise files.MissingKey("no key")

    rows = spark.createDataFrame([("2024-01", 1.0)], schema)
    assert files.read_through(spark, cache, no_key, schema=schema).count() == 0
    with pytest.raises(files.MissingKey):
        files.read_through(spark, cache, no_key)
    assert files.read_through(spark, cache, lambda: rows.limit(0)).count() == 0 and not files.exists(spark, cache)
    assert files.read_through(spark, cache, lambda: rows).count() == 1
    assert files.read_through(spark, cache, no_key, refresh=True).first().value == 1.0

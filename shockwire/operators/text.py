"""Cleaning, projection and de-duplication of articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The vendor's headers, and the names they get.
HEADERS = {"뉴스 식별자": "article_id", "일자": "date", "언론사": "source", "제목": "title", "본문": "body", "분석제외 여부": "excluded"}


#: The ends of sentences, in the order in which they are tried.
SENTENCE_MARKS = (".", "다.", "요.", "음.")


def rename_headers(df: DataFrame, headers: dict[str, str] = HEADERS) -> DataFrame:
    """Vendor columns renamed; without an exact header, the first one that contains it once spaces are gone."""
    bare = {c: c.replace(" ", "") for c in df.columns}
    found: dict[str, str] = {}
    for header, name in headers.items():
        plain = header.replace(" ", "")
        match = next((c for c in df.columns if c == header), None) or next((c for c, b in bare.items() if plain in b and c not in found), None)
        if match:
            found[match] = name
    return df.withColumnsRenamed(found)


def iso_date(c: Column) -> Column:
    """A date from 20240131, 20240131.0 or 2024-01-31; null otherwise."""
    s = F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")
    return F.coalesce(F.try_to_timestamp(s, F.lit("yyyyMMdd")), F.try_to_timestamp(s, F.lit("yyyy-MM-dd"))).cast("date")


def lead_sentences(body: Column, chars: int = 200, sentences: int = 2) -> Column:
    """The first sentences of the first characters."""
    return F.array_join(F.slice(F.split(F.trim(F.substring(body, 1, chars)), r"(?<=[.!?。다])\s+"), 1, sentences), " ")


def lead_cut(body: Column, chars: int = 200, least: int = 50) -> Column:
    """P5: the first characters, cut after the last sentence mark beyond `least`; marks are tried in order."""
    head = F.substring(F.trim(body), 1, chars)
    cuts = []
    for mark in SENTENCE_MARKS:
        back = F.locate(mark[::-1], F.reverse(head))
        at = F.char_length(head) - back - len(mark) + 1
        cuts.append(F.when((back > 0) & (at > least), F.substring(head, F.lit(1), at + len(mark))))
    return F.coalesce(*cuts, head)


def normalize_text(c: Column) -> Column:
    """White space collapsed, characters other than letters, digits, space and plain punctuation removed, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"""(?U)[^\w\s가-힣.,!?·\-()"']""", ""))


def fill_leads(df: DataFrame) -> DataFrame:
    """An empty lead becomes the title; rows without a title go."""
    empty = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    return df.where(~empty("title")).withColumn("lead", F.when(empty("lead"), F.col("title")).otherwise(F.col("lead")))


def article_text(title: str = "title", lead: str = "lead") -> Column:
    """Title and lead with a space between, null as empty."""
    return F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" "), F.coalesce(F.col(lead), F.lit("")))


def daily_ids(df: DataFrame, order: str) -> DataFrame:
    """article_id daily_<date>_<n>, n from 0 in the order of a column within each date."""
    n = F.row_number().over(Window.partitionBy("date").orderBy(order)) - 1
    return df.withColumn("article_id", F.concat_ws("_", F.lit("daily"), F.col("date").cast("string"), n.cast("string")))


def tag_lines(c: Column, most: int = 5) -> Column:
    """One tag a line without leading digits and bullets, empty ones dropped, the first `most`."""
    tags = F.transform(F.split(c, "\n"), lambda line: F.trim(F.regexp_replace(F.trim(line), r"^[0-9.\-*•)\s]+", "")))
    return F.slice(F.filter(tags, lambda t: t != ""), 1, most)


def file_dates(name: Column) -> tuple[Column, Column]:
    """The two dates in a file name such as news_20240101-20240131.xlsx."""
    part = lambda k: F.try_to_timestamp(F.nullif(F.regexp_extract(name, r"(\d{8})\D+(\d{8})", k), F.lit("")), F.lit("yyyyMMdd")).cast("date")
    return part(1), part(2)


def coverage_gaps(ranges: DataFrame) -> DataFrame:
    """Gaps and overlaps between sorted ranges (name, start, end): each against the furthest end before it, and, as
    `adjacent_days`, against its immediate predecessor."""
    w = Window.partitionBy(F.lit(0)).orderBy("start", "end", "name")
    furthest = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    days = F.datediff("start", furthest)
    kind = F.when(days > 1, "gap").when(days < 1, "overlap")
    return ranges.withColumns({"kind": kind, "days": days, "adjacent_days": F.datediff("start", F.lag("end").over(w))}).where("kind is not null")


def first_of(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key in the given order (a leading - reverses)."""
    by = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("_n = 1").drop("_n")


def deduplicate_titles(df: DataFrame, *order: str, prefix: int = 20, scope: str = "global") -> DataFrame:
    """One article for each title start; equal titles share it. Over all events, or within each (scope per_event)."""
    keys = ["_start"] + (["ref_id"] if scope == "per_event" else [])
    return first_of(df.withColumn("_start", F.substring("title", 1, prefix)), keys, *order).drop("_start")

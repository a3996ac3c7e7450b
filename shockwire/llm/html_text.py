"""Main text of HTML pages by line-block distribution.

1. Markup is stripped into lines, one a block element; each line keeps its text, how much of it stands in links, and
   whether it stands in a part that is never main text (menus, headers, footers, sidebars, notices, adverts, forms,
   reader comments: by element or role, or by the class and id words of containers) or in the page's own article element.
2. A line weighs its characters; lines of those parts, and lines that are mostly links, weigh nothing. Where the page
   names its main part (main, or else article), a line inside weighs NAMED times as much and a line outside the NAMED-th part.
3. The distribution is the sum of weights over a sliding window of lines; the main part's bounds end a window. A surge is
   where it rises to SURGE, or to the page's largest sum if that is smaller; the dive is where it falls to nothing;
   stretches from surge to dive keep their lines, and those right before the surge without a gap.

Character references are decoded, white space inside a block becomes one space, blocks are joined in page order by a
line feed. Nothing is capped. Work is linear in the page, whatever its quotes and open elements.

Defined results: a null or empty page gives the empty text; an empty table gives no rows; rows that repeat, and null ids
or urls, are extracted row by row; further columns are not read. Elements that are never closed end with the page, but
a boilerplate element that is never closed ends at the next article, main or footer.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockwire.llm.common import map_rows, text_of

#: Lines of the sliding window, and the characters in it that make a surge.
WINDOW, SURGE = 3, 80
#: Share of a line's characters that stand in links, from which it is a menu's.
LINKS = 0.6
#: Times that a line of a named article weighs more, and one outside it less.
NAMED = 4

_START, _END = re.compile(r"<(?=[!?]|/?[a-zA-Z])"), re.compile(r"""[>"']""")
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTR = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Elements whose content is never text.
RAW = frozenset("script style noscript template svg math iframe object canvas audio video map head title textarea select".split())
#: Elements that are never main text.
SIDE = frozenset("nav footer aside form button dialog menu".split())
#: Elements that start and end a line.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li legend main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose class and id can mark a part that is never main text; others are marked by element, role or being hidden.
CONTAINERS = frozenset("div section table tr td ul ol dl dir center span header fieldset details".split())
#: Words of class, id and role that mark parts that are never main text. Inside the main part, all words of a name have to be
#: of these or of NEUTRAL.
SIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs footer sidebar aside comment comments reply replies disqus respond cookie cookies consent gdpr notice notices alert newsletter subscribe subscription popup modal overlay share sharing social related recommended widget login signup search masthead copyright pagination pager toolbar complementary contentinfo".split()
)


NEUTRAL = frozenset("area bar block blocks bottom box col column container content form group head header inner item items left link links list main outer panel post posts right row section site top wrap wrapper".split())


def _side(name: str, tag: str, inside: bool) -> bool:
    if name in SIDE or name == "header" and not inside:
        return True
    for attr, value in _ATTR.findall(tag[len(name) + 1 :]):
        attr, value = attr.lower(), value.strip("\"'")
        if attr == "hidden" or attr == "aria-hidden" and value.lower() == "true" or attr == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if attr == "role" and value.lower() in SIDE_WORDS:
            return True
        if attr in ("class", "id") and (name in CONTAINERS or name == "article" and "omment" in value):
            for words in ({w.lower() for w in _WORDS.findall(v)} for v in value.split()):
                if words & SIDE_WORDS and (not inside or words <= SIDE_WORDS | NEUTRAL):
                    return True
    return False


def tokens(page: str) -> Iterator[tuple[int, int]]:
    """Start and end of each tag, comment and declaration. A tag ends at the first > outside quotes, or at the first > where
    its quotes are never closed. `dead` holds the places outside quotes from which no > follows outside quotes, so that no
    stretch is gone over again and again."""
    last = {c: page.rfind(c) for c in ">\"'"}
    dead: set[int] = set()
    m = _START.search(page)
    while m:
        at = end = m.start()
        if page.startswith("<!--", at) or page.startswith("<![CDATA[", at):
            close = "-->" if page[at + 2] == "-" else "]]>"
            end = page.find(close, at + 4) + 3
            end = len(page) if end == 2 else end
        elif at > last[">"]:  # text; only a comment can come yet
            m = _START.search(page, at + 1)
            continue
        elif page[at + 1] in "!?":
            end = page.find(">", at) + 1
        else:
            seen = [at + 1]
            while end <= at and seen[-1] not in dead:
                k = _END.search(page, seen[-1])
                if k is None:
                    break
                if k[0] == ">":
                    end = k.end()
                elif k.start() == last[k[0]]:
                    break
                else:
                    seen.append(page.find(k[0], k.end()) + 1)
            if end <= at:
                dead.update(seen)
                end = page.find(">", at) + 1
        yield at, end
        m = _START.search(page, end)


def lines(page: str) -> list[tuple[str, float, bool, bool]]:
    """The page's lines in order: text, share in links, in a side part, in the main part."""
    out: list[tuple[str, float, bool, bool, bool]] = []
    parts: list[str] = []
    linked, in_link = 0, 0
    depth = {"article": 0, "main": 0}
    #: Open elements from the outermost side part on, and how many of each; empty outside side parts.
    side: list[str] = []
    opened: Counter[str] = Counter()
    closes: dict[str, int] = {}
    raw, at = "", 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, min(1.0, linked / len(text)), bool(side), depth["article"] > 0, depth["main"] > 0))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text and not raw:
            parts.append(text)
            if in_link:
                linked += len(text.strip())

    def closed_after(name: str, at: int) -> bool:
        if name not in closes:
            closes[name] = max((m.start() for m in re.finditer(rf"</{name}\b", page, re.I)), default=-1)
        return closes[name] >= at

    for start, end in tokens(page):
        add(page[at:start])
        at = end
        tag = page[start:end]
        if tag[1] in "!?":
            if tag.startswith("<![CDATA["):
                add(html.escape(tag[9:-3]))
            continue
        name, closing = _NAME.match(tag)[1].lower(), tag[1] == "/"
        if raw:
            if name == raw and closing or raw == "head" and name == "body":
                raw = ""
            if raw or closing:
                continue
        if name in RAW:
            if not closing and not tag.endswith("/>"):
                raw = name
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCK:
            flush()
        if name == "a":
            in_link = 0 if closing else 1
        if closing:
            if side:
                if opened[name]:
                    while side:
                        opened[gone := side.pop()] -= 1
                        if gone == name:
                            break
            elif name in depth:
                depth[name] = max(0, depth[name] - 1)
            continue
        if side and name in ("article", "main", "footer") and side[0] in ("nav", "header", "form", "div", "ul") and not closed_after(side[0], end):
            side.clear()
            opened.clear()
        if side:
            if name not in VOID and not tag.endswith("/>"):
                side.append(name)
                opened[name] += 1
        elif _side(name, tag, depth["article"] + depth["main"] > 0):
            if name not in VOID and not tag.endswith("/>"):
                flush()
                side.append(name)
                opened[name] += 1
        elif name in depth:
            depth[name] += 1
    add(page[at:])
    flush()
    main = any(in_main and not sided for _, _, sided, _, in_main in out)
    return [(text, links, sided, in_main if main else in_article) for text, links, sided, in_article, in_main in out]


def weights(found: list[tuple[str, float, bool, bool]]) -> list[float]:
    """What each line weighs."""
    named = any(inside and not side for _, _, side, inside in found)
    scale = lambda inside: 1 if not named else NAMED if inside else 1 / NAMED
    return [0 if side or links >= LINKS else len(t) * scale(inside) for t, links, side, inside in found]


def stretches(weight: list[float], inside: list[bool]) -> list[int]:
    """The lines kept: those that weigh anything, in stretches from surge to dive of the window's sums."""
    block = [sum(weight[n] for n in range(k, min(k + WINDOW, len(weight))) if all(inside[m] == inside[k] for m in range(k, n + 1))) for k in range(len(weight))]
    surge, keep, k = min(SURGE, max(block, default=0)), set(), 0
    while k < len(block):
        if block[k] and block[k] >= surge:
            end = k
            while end < len(block) and block[end] and inside[end] == inside[k]:
                end += 1
            start = k
            while start and weight[start - 1] and inside[start - 1] == inside[k]:
                start -= 1
            keep.update(range(start, end))
            k = end
        else:
            k += 1
    return [k for k in sorted(keep) if weight[k]]


def main_text(page: str) -> str:
    found = lines(page)
    return "\n".join(found[k][0] for k in stretches(weights(found), [inside for *_, inside in found]))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html)."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([main_text(p) for p in batch.column(2).to_pylist()], pa.string())], names=["page_id", "url", "text"])

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("html"))
    return map_rows(source, lambda: f, "page_id long, url string, text string").select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))

"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, small_batches

_DROP = re.compile(r"<!--|<(script|style|noscript|template|svg|title|iframe|textarea)\b[^>]*>|<!\[CDATA\[|\]\]>|<[!?][^>]*>", re.I)
#: What else than their own end tags ends elements that were left open: for a title what follows it in a head, for an svg the tags that HTML doesn't allow there.
_ENDS = {"title": r"|(?=</?(?:head|body|meta|link|base|script|style)\b)", "svg": r"|(?=</?(?:p|div|h[1-6]|ul|ol|li|dl|table|blockquote|pre|body|article|section|main|footer|nav)\b)|<foreignObject\b"}
_CLOSE = {n: re.compile(rf"</{n}\s*>{_ENDS.get(n, '')}", re.I) for n in ("script", "style", "noscript", "template", "svg", "title", "iframe", "textarea")}
_SVG_END = re.compile(r"</svg\s*>", re.I)
#: Elements of raw text: left open, they run to the end of the page.
_RAW = ("script", "style", "textarea")
_SECTIONS = "nav|header|footer|main|article|section|aside|form|body"
_BLOCKS = "p|div|li|ul|ol|dl|dt|dd|table|tr|td|th|h[1-6]|option|select|blockquote|pre|figure|figcaption|html|head|title|br|hr"
_SECTION = re.compile(rf"<(/?)({_SECTIONS})\b[^>]*>", re.I)
_RUN = re.compile(rf"(?:</?(?:{_SECTIONS}|{_BLOCKS})\b[^>]*>\s*+)++", re.I)
_INLINE = re.compile(rf"</?(?!(?:{_SECTIONS}|{_BLOCKS})\b)[a-zA-Z][^>]*>", re.I)
#: A tag, comment or declaration that begins.
_OPEN = re.compile(r"<[a-zA-Z/!?]")
_NBSP = re.compile("&nbsp;|&#160;|&#xa0;", re.I)
#: White space that isn't one blank already.
_SPACE = re.compile(r"[^\S\n ][^\S\n]*| [^\S\n]+")


def visible(page: str) -> str:
    """The page without comments, declarations and elements that aren't text of it.

    A tag or declaration that never ends runs to the end of the page, as do comments, scripts, styles and text areas that
    are left open. So after the last '>' no tag is looked for, and the time is linear in the page whatever it holds. A title left open ends at the head's next
    tag, an svg at the first tag of a text, and of other elements the tag alone goes. An svg may close itself. Heads need
    no end: what isn't text of the page there goes by itself.
    """
    if open_ := _OPEN.search(page, page.rfind(">") + 1):
        page = page[: open_.start()]
    out, at, missing = [], 0, set()
    while m := _DROP.search(page, at):
        name = (m[1] or "").lower()
        out += [page[at : m.start()], "\n" if name else " "]
        at = m.end()
        if m[0] == "<!--":
            end = page.find("-->", at)
            at = end + 3 if end >= 0 else len(page)
        if not name or name == "svg" and m[0].endswith("/>"):
            continue
        close = None if name in missing else _CLOSE[name].search(page, at)
        if close and close[0].lower() == "<foreignobject":  # texts may stand in it
            close = _SVG_END.search(page, close.end())
        if close:
            at = close.end()
        elif name in _RAW:
            at = len(page)
        else:
            missing.add(name)
            if name == "title":
                end = page.find("<", at)
                at = end if end >= 0 else len(page)
    return "".join(out) + page[at:]


def lines_of(page: str, gap: int = 3) -> list[str]:
    """The page's lines of text: markup is gone, entities are resolved.

    A run of adjacent block tags, with nothing but white space between, ends one line, however many they are; so tables,
    lists and nested divs leave no empty lines. If a section begins or ends in it, `gap` empty lines follow. Sections
    are nav, main, article, aside, form and body, and outside articles also header, footer and section.
    """
    text = _NBSP.sub(" ", _INLINE.sub("", visible(page)).replace("\r\n", "\n").replace("\r", "\n"))
    parts, at, within = [], 0, 0
    for m in _RUN.finditer(text):
        apart = False
        for end, name in _SECTION.findall(m[0]):
            name = name.lower()
            apart |= not within or name not in ("header", "footer", "section")
            if name in ("article", "main"):
                within = max(0, within - 1) if end else within + 1
        parts += [text[at : m.start()].rstrip(), "\n" * (gap + 1 if apart else 1)]
        at = m.end()
    return [x.strip() for x in _SPACE.sub(" ", html.unescape("".join(parts) + text[at:]).replace("\xa0", " ")).split("\n")]


#: Of `whole`: the least share of the largest run's text that a run without a surge has, and of the page's mean line that its own has.
SHARE, LINE_SHARE = 1 / 4, 1 / 2


def main_text(page: str, width: int = 3, surge: int = 86, whole: bool = False) -> tuple[str, int, int]:
    """(text, passages, kept lines) of a page.

    Block i is the text length (white space not counted) of lines i .. i + width - 1. A passage surges at the first block
    of more than `surge` characters outside a passage, if the next block isn't empty either, and begins at that block's
    first line of text; it dives at the next block that is empty. All lines between are kept. A page whose text never
    surges keeps its one densest run of lines between empty blocks, so that short pages aren't lost.

    With `whole`, what is short isn't lost either: passages are whole runs of lines between empty blocks. A run is one if
    it surges, if it is the page's largest, or if, measured by the page itself, it is no small part: at least SHARE of
    the largest run's text, in lines of at least LINE_SHARE of the page's mean length (links of a menu are shorter).
    """
    lines = lines_of(page, width)
    lengths = np.array([len(x) - x.count(" ") for x in lines], np.int64)
    padded = np.concatenate([lengths, np.zeros(width, np.int64)])
    sums = np.concatenate([[0], np.cumsum(padded)])
    blocks = sums[width:] - sums[:-width]
    blocks = blocks[: len(lines) + 1]
    blocks[-1] = 0
    high, empty = np.flatnonzero(blocks > surge), np.flatnonzero(blocks == 0)
    gaps = np.concatenate([[-1], empty])
    runs = [(int(a) + 1, int(b)) for a, b in zip(gaps[:-1], gaps[1:]) if b > a + 1]
    spans, at = [], 0
    if whole and runs:
        begin, end = np.array(runs).T
        count = np.concatenate([[0], np.cumsum(lengths > 0)])
        size, n = sums[end] - sums[begin], count[end] - count[begin]
        good = high[(blocks[high + 1] > 0) | (lengths[high] > surge)]
        keep = (size >= SHARE * size.max()) & (size / n >= LINE_SHARE * lengths.sum() / count[-1])
        keep |= np.searchsorted(good, end) > np.searchsorted(good, begin)
        keep[np.argmax(size)] = True
        spans = [r for r, k in zip(runs, keep) if k]
    while not whole:
        i = np.searchsorted(high, at)
        while i < len(high) and blocks[high[i] + 1] == 0 and lengths[high[i]] <= surge:
            i += 1
        if i >= len(high):
            break
        start = int(high[i])
        end = int(empty[np.searchsorted(empty, start)])
        spans.append((start, end))
        at = end
    if not spans and lengths.any():
        spans = [max(runs, key=lambda r: (int(sums[r[1]] - sums[r[0]]), -r[0]))]
    kept = [x for a, b in spans for x in lines[a:b] if x]
    return "\n".join(kept), len(spans), len(kept)


def extract(pages: DataFrame, width: int = 3, surge: int = 86, column: str = "html", whole: bool = False) -> DataFrame:
    """Adds `text`, `passages` and `kept_lines` to every page (main_text).

    Null pages have a null text and no passage; empty pages, and pages of markup alone, have an empty text. Unclosed tags,
    comments, scripts, styles and text areas run to the end of the page. Whole pages are read, however long, in linear
    time. Of runs of equal size, where one only is kept, it is the first. Repeated rows are extracted each. No rows: no
    rows. Names that pages already has get a leading underscore. Map-only.
    """

    def run(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages_ in columns:
            got = [(None, 0, 0) if p is None else main_text(p, width, surge, whole) for p in pages_]
            yield pd.DataFrame(got, columns=["text", "passages", "kept_lines"])

    got = fresh(pages, "__got")
    names = [fresh(pages, n) for n in ("text", "passages", "kept_lines")]
    done = small_batches(pages).withColumn(got, F.pandas_udf(run, "text string, passages int, kept_lines int").asNondeterministic()(F.col(column)))
    return done.select(*[F.col(f"`{c}`") for c in pages.columns], *[F.col(got)[n].alias(as_) for n, as_ in zip(("text", "passages", "kept_lines"), names)])

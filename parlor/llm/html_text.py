"""Main text of HTML pages from the distribution of text over line blocks.

Markup is stripped block by block, so that every block element is a line; menus, scripts, forms, adverts,
notices, comments and the like, which the markup names as such, leave an empty line. A line's weight is its number of
visible characters outside links. If the page declares an article or else a main part that has text outside links, the declaration
sets the weights: a line outside is empty, and one inside weighs at least 1, also if all of it is a link. Sums of weights over
sliding windows of ``window`` lines rise from zero at surge points and fall back to zero at dive points. The stretches
between them are the main text, all their lines, short ones included: every one of a declared part, else those whose
highest sum reaches ``least`` (and the highest of all in any case).

Results, all cases included:
* outside an article a word of a class, id or role marks furniture (``related-work``); inside one a whole name must: all its
  words are marks or say what kind of box it is (``related-links``, but not ``related-work``);
* a null or empty page, and one without any weight, has an empty text;
* an article or main part of nothing but links is the main text if no stretch of the page reaches ``least``;
* an ``a`` without ``href`` or ending in ``/>`` is no link; a link ends with its end tag, also one inside
  furniture, and where the next ``a`` tag is a start tag or missing, at the end of its block;
* character references are decoded, white space inside a block becomes one space, blocks are joined in page
  order by one space; nothing is cut off, however long a page is;
* markup that doesn't end (comments, scripts, quotes) ends with the page; a ``<`` that starts no tag is text;
* every row gives one row, repeated rows too; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^<>]*>",
    re.DOTALL,
)
NAMES = re.compile(r"""\b(class|id|role|style)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?<![\w-])(hidden)(?![\w-])|aria-hidden\s*=\s*["']?true""", re.IGNORECASE)
EMPTY = re.compile(r"(?:\A|[\s\"'])/\Z")
HREF = re.compile(r"(?<![\w-])href\s*=", re.IGNORECASE)
LINK_TAG = re.compile(r"<(/?)a(?=[\s/>])", re.IGNORECASE)
LANG = re.compile(r"""(?<![^\s"'])lang\s*=\s*["']?\s*([a-z]+)""", re.IGNORECASE)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

RAW = {"script", "style", "textarea", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
    "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img",
}
FURNITURE = {
    "head", "nav", "footer", "aside", "form", "menu", "dialog", "select", "button", "svg", "math", "object", "canvas",
    "audio", "video", "fieldset", "title",
}
#: Words in a class, id or role that mark an element as furniture.
MARKS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion",
    "sidebar", "sidenav", "nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "pagination", "pager", "footer",
    "comment", "comments", "respond", "disqus", "replies", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification",
    "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social",
    "related", "recommended", "widget", "toolbar", "search", "copyright", "disclaimer", "skip", "complementary", "contentinfo", "dialog",
    "paywall", "teaser", "teasers", "outbrain", "taboola", "hidden",
}
#: Words that, beside a mark, only say what kind of box it is.
BOXES = {
    "area", "articles", "bar", "block", "box", "btn", "button", "buttons", "container", "content", "form", "group", "holder", "icons", "inner",
    "item", "items", "link", "links", "list", "outer", "panel", "post", "posts", "section", "slot", "stories", "thread", "unit", "wrap", "wrapper",
}
#: The same, but only outside an article, whose own header holds its title.
OUTER_MARKS = {"header", "banner", "masthead", "topbar", "head"}
COMMENT_MARKS = {"comment", "comments", "reply", "replies"}
ARTICLE_MARKS = {"article", "post", "entry", "story"}
MAIN_MARKS = {"content", "main"}
BODIES = {"html", "body", "main"}
OPEN_ENDED = {"li", "dt", "dd", "td", "th", "tr", "option"}
PARENTS = {"ul", "ol", "dl", "table", "select"}


def _marks(attrs: str) -> tuple[set[str], bool, bool]:
    """Words of class, id and role, whether one of their names is nothing but marks and boxes, and whether the element is hidden."""
    words: set[str] = set()
    named = hidden = False
    for match in NAMES.finditer(attrs):
        if not match[1]:
            hidden = True
        elif match[1].lower() == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", match[2], re.IGNORECASE))
        else:
            for name in match[2].strip("\"'").split():
                own = {w.lower() for w in WORDS.findall(name)}
                words |= own
                named |= bool(own & MARKS) and all(w in MARKS or w in BOXES or w.isdigit() for w in own)
    return words, named, hidden


class _Lines:
    """Lines of a page: text, weight, and whether they stand in its article (2) or main part (1)."""

    def __init__(self):
        self.rows: list[tuple[str, int, int]] = []
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.in_link = False
        self.link_ends = False

    def link(self, page: str, at: int, attrs: str) -> None:
        """A link starts. Without an end tag of its own it ends with its block."""
        self.in_link = bool(HREF.search(attrs)) and not EMPTY.search(attrs)
        if self.in_link:
            tag = LINK_TAG.search(page, at)
            self.link_ends = tag is not None and bool(tag[1])

    def text(self, raw: str) -> None:
        if raw:
            self.parts.append(raw)
            if self.in_link:
                self.linked.append(raw)

    def flush(self, inside: int) -> None:
        if self.parts:
            line = " ".join(unescape("".join(self.parts)).split())
            if line:
                links = len("".join(unescape("".join(self.linked)).split()))
                self.rows.append((line, len(line.replace(" ", "")) - links, inside))
            self.parts, self.linked = [], []
        self.in_link = self.in_link and self.link_ends

    def blank(self, inside: int) -> None:
        self.flush(inside)
        self.rows.append(("", 0, inside))


def page_lines(page: str) -> list[tuple[str, int, int]]:
    """Lines ``(text, characters outside links, 2 in an article, 1 in the main part of the page)``."""
    out, at, end = _Lines(), 0, len(page)
    # Names of the open elements that hold the article, with those of the same name inside; the same for the main part.
    articles: list[str] = []
    mains: list[str] = []
    skip, skip_depth, nested, outer = "", 0, 0, 0
    while at < end:
        match = TOKEN.search(page, at)
        if match is None:
            if not skip:
                out.text(page[at:])
            break
        if not skip:
            out.text(page[at : match.start()])
        at = match.end()
        name = (match["name"] or "").lower()
        if not name:
            continue
        closing, attrs = bool(match["end"]), match["attrs"] or ""
        if name in RAW and not closing and not attrs.endswith("/"):
            close = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = close.end() if close else end
            continue
        if skip:
            if name == "a":
                out.in_link = False
            # Elements whose end tag may be left out end with what can't stand inside them.
            if skip == "p":
                ends = name not in INLINE and name not in VOID
            else:
                nested += (name in PARENTS) * (-1 if closing else 1)
                if name == skip and (closing or skip not in OPEN_ENDED or nested):
                    skip_depth += -1 if closing else 1
                    ends = skip_depth <= 0
                else:
                    ends = skip in OPEN_ENDED and (nested < 0 or (name == skip and not nested))
            ends = ends or (skip == "head" and name == "body") or (closing and name == "body")
            ends = ends or (closing and outer and name == "article" and articles[-1] == name and skip not in ("article", "section", "div", "aside"))
            if not ends:
                continue
            was, skip = skip, ""
            if name == was and closing:
                continue
        if name == "a":
            if closing:
                out.in_link = False
            else:
                out.link(page, at, attrs)
            continue
        if name in INLINE and (closing or not attrs):
            continue
        words, named, hidden = _marks(attrs) if attrs and not closing else (set(), False, False)
        inside = 2 if articles else 1 if mains else 0
        if not closing and name not in VOID:
            header = name == "header" or words & OUTER_MARKS
            furniture = name in FURNITURE or hidden or (name not in BODIES and name != "article" and (named if articles else words & MARKS))
            furniture = furniture or (name == "article" and words & COMMENT_MARKS) or (header and not articles and name not in BODIES)
            if furniture and not attrs.endswith("/"):
                out.blank(inside)
                skip, skip_depth, nested, outer = name, 1, 0, len(articles)
                continue
        if name in INLINE:
            continue
        out.flush(inside)
        if name == "article" or (articles and name == articles[-1]) or (name in ("div", "section") and words & ARTICLE_MARKS and not articles):
            if closing:
                if articles:
                    articles.pop()
            else:
                articles.append(name)
        elif name == "main" or (mains and name == mains[-1]) or (name in ("div", "section") and words & MAIN_MARKS and not mains):
            if closing:
                if mains:
                    mains.pop()
            else:
                mains.append(name)
    out.flush(2 if articles else 1 if mains else 0)
    return out.rows


def main_text(page: str, window: int = 3, least: int = 86) -> str:
    """The main text of a page, see the module's text."""
    lines = page_lines(page)
    declared = max((inside for _, weight, inside in lines if weight > 0), default=0)
    linked = max((inside for text, _, inside in lines if text), default=0)
    weights = np.array([max(0, weight) for _, weight, _ in lines], dtype=np.int64)
    if not declared and linked and (not weights.any() or np.convolve(weights, np.ones(window, dtype=np.int64)).max() < least):
        declared = linked
    if declared:
        lines = [(text, max(1, weight), inside) if text and inside >= declared else ("", 0, inside) for text, weight, inside in lines]
        weights, least = np.array([weight for _, weight, _ in lines], dtype=np.int64), 1
    if not weights.any():
        return ""
    # sums[i] covers the lines i - window + 1 to i; a stretch of sums above zero is one of text and its gaps.
    sums = np.convolve(weights, np.ones(window, dtype=np.int64))
    edges = np.flatnonzero(np.diff((sums > 0).astype(np.int8), prepend=0, append=0))
    surges, dives = edges[::2], edges[1::2]
    peaks = [int(sums[a:b].max()) for a, b in zip(surges, dives, strict=True)]
    bound = min(least, max(peaks))
    kept = []
    for surge, dive, peak in zip(surges, dives, peaks, strict=True):
        if peak >= bound:
            stop = dive - window + 1
            kept += [text for text, _, _ in lines[surge:stop] if text]
    return " ".join(kept)


def page_language(page: str) -> str | None:
    """The language that the first ``html`` tag with one declares, wherever it stands outside comments and scripts."""
    at, end = 0, len(page)
    while at < end and (match := TOKEN.search(page, at)):
        at, name = match.end(), (match["name"] or "").lower()
        if match["end"]:
            continue
        if name == "html" and (found := LANG.search(match["attrs"])):
            return found[1]
        if name in RAW and not match["attrs"].endswith("/"):
            close = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = close.end() if close else end
    return None


def _extract(id_type: pa.DataType, window: int, least: int, languages: bool):
    fields = [("id", id_type), ("url", pa.string()), ("text", pa.string())]
    schema = pa.schema([*fields, ("lang", pa.string())] if languages else fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = [], []
            for value in batch.column("html"):
                page = value.as_py() or ""
                texts.append(main_text(page, window, least))
                if languages:
                    found.append(page_language(page))
            columns = [batch.column("id"), batch.column("url"), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.string())] if languages else columns, schema=schema)

    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, window: int = 3,
            least: int = 86, languages: bool = False) -> DataFrame:
    """One row per page: ``id, url, text`` and, if asked for, ``lang``. Pages are read one by one, without a shuffle."""
    from pyspark.sql.pandas.types import to_arrow_type

    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    kind = source.schema["id"].dataType
    schema = f"id {kind.simpleString()}, url string, text string" + (", lang string" if languages else "")
    return source.mapInArrow(_extract(to_arrow_type(kind), window, least, languages), schema)

"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element; an empty block is an empty line. Lines inside menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments, lines of links and lines that read
like a legal notice count as empty. The text lengths are summed over sliding windows of lines; the text surges where a
window first exceeds a threshold and dives where a window falls to nothing. What lies between a surge and its dive is
kept; a page may surge several times. Where one article element of the page holds half of its text or more, lines
outside articles count as empty, boilerplate inside is no line, and a surge begins with the article's first line.
Pages are scanned once from front to back, whatever they hold.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import arrow_rows

_ATTR = re.compile(r"""(class|id|role|aria-label|itemprop|hidden|style)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")
#: What ends a tag, or begins an attribute's value in quotes.
_END = re.compile(r">|=\s*([\"'])")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ZEROS, _HUGE = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{7,});?")
# Element names by what the HTML standard says of them.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "audio", "video", "select", "noframes", "noembed", "xmp"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
SKIPPED = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "head", "search", "fieldset", "label", "input"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: An open one of these ends where a block begins.
IMPLIED = {"p": BLOCKS, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "menubar", "form"}
# Words in class names and ids that mark what is not the article.
MARKS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "adbox", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "disqus", "discussion", "dropdown", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "pagination", "popup", "promo", "promotion", "related", "replies", "respond", "search", "share", "sharing", "sidebar", "sidenav", "signup", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "topbar", "widget", "widgets"}
WINDOW, SURGE = 3, 60
# How short legal notices begin, and short lines that are one as a whole.
_NOTICE = re.compile(r"(?:©|\(c\) ?\d|copyright\b|all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|alle rechte vorbehalten|nutzungsbedingungen|datenschutz|tous droits réservés|mentions légales|todos los derechos|aviso legal)|(?:legal(?: notice)?|terms|privacy|imprint|impressum|cookies)\W*\Z", re.I)
NOTICE_CHARS = 200


def marked(name: str, attributes: str) -> bool:
    """Whether an element is boilerplate by its name, role, class or id."""
    if name in SKIPPED:
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    for m in _ATTR.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "role" and value.strip() in ROLES:
            return True
        if key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if key in ("class", "id") and not MARKS.isdisjoint(re.split(r"[^a-z0-9]+", value)):
            return True
    return False


def decoded(text: str) -> str:
    """Character references decoded; numbers beyond Unicode become the replacement character."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = _HUGE.sub("\ufffd", _ZEROS.sub("&#", text))
    return entities.unescape(text)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) in order: kind is ``text``, ``open``, ``close`` or ``single``.

    Comments, declarations and raw elements are left out. A quote counts within a tag behind an equals sign only; once
    one is left open to the page's end, quotes count no more, so each character is looked at a bounded number of times.
    """
    at, end, quotes = 0, len(page), True
    while at < end:
        mark = page.find("<", at)
        if mark < 0:
            yield "text", page[at:], ""
            return
        if mark > at:
            yield "text", page[at:mark], ""
        at = mark
        if page.startswith("<!--", at) or page.startswith("<![CDATA[", at):
            close = "-->" if page[at + 2] == "-" else "]]>"
            found = page.find(close, at + 4)
            at = found + 3 if found >= 0 else end
            continue
        if page.startswith(("<!", "<?"), at):
            found = page.find(">", at)
            at = found + 1 if found >= 0 else end
            continue
        m = _NAME.match(page, at)
        if not m:
            yield "text", "<", ""
            at += 1
            continue
        stop, look = -1, m.end()
        while quotes:
            e = _END.search(page, look)
            if not e:
                quotes = False
            elif e[1] is None:
                stop = e.start()
                break
            else:
                look = page.find(e[1], e.end()) + 1
                quotes = look > 0
        if stop < 0:
            stop = page.find(">", m.end())
        if stop < 0:  # no tag ends any more: the rest is text
            yield "text", page[at:], ""
            return
        name, inner = m[1].lower(), page[m.end() : stop]
        closing, single = page[at + 1] == "/", inner.endswith("/")
        at = stop + 1
        if name in RAW:
            if not closing and not single:
                found = _CLOSE[name].search(page, at)
                at = (page.find(">", found.start()) + 1 or end) if found else end
            continue
        yield "close" if closing else "single" if single else "open", name, inner


_CLOSE = {name: re.compile(rf"</{name}[\s/>]", re.I) for name in RAW}


def lines(page: str) -> list[tuple[str, bool, int, float]]:
    """The page's blocks as (text, is boilerplate, number of its outermost article or 0, share of text in links)."""
    out: list[tuple[str, bool, int, float]] = []
    held: list[str] = []
    linked = skip_depth = inside = links = articles = nested = 0
    skip_name = opened = ""

    def flush(empty: bool = False) -> None:
        nonlocal linked
        text = _SPACE.sub(" ", "".join(held)).strip()
        if text or empty:
            out.append((text, bool(skip_depth), articles if inside else 0, linked / max(1, len(text))))
        held.clear()
        linked = 0

    for kind, name, inner in tokens(page):
        if kind == "text":
            text = decoded(name)
            held.append(text)
            if links:
                linked += len(text.strip())
            if opened and not text.isspace():
                opened = ""
            continue
        closing = kind == "close"
        if name == "br":
            held.append(" ")
            continue
        if name in BLOCKS or name in SKIPPED:
            flush(empty=closing and name == opened)
            opened = "" if closing or kind == "single" else name
        if name == "a":
            links = max(0, links + (-1 if closing else 1))
        elif name in BLOCKS:
            links = 0
        if skip_depth:
            if skip_name in IMPLIED and not closing and name in IMPLIED[skip_name] or closing and name != skip_name and skip_name in ("p", "li") and name in BLOCKS:
                skip_depth = 0
            elif name == skip_name and name not in VOID:
                skip_depth += -1 if closing else 1
                continue
            elif name in ("body", "html", "article", "main"):
                # an end tag whose element began inside belongs there; else an element around the skipped one ends
                if not closing or nested:
                    nested += -1 if closing else 1
                    continue
                skip_depth = 0
            else:
                continue
        skips = not closing and marked(name, inner)
        if name in ("article", "main") and not skips:
            articles += not closing and not inside
            inside = max(0, inside + (-1 if closing else 1))
        elif skips and name not in VOID and kind != "single":
            if name not in BLOCKS and name not in SKIPPED:
                flush()
            skip_depth, skip_name, nested = 1, name, 0
    flush()
    return out


def main_text(page: str | None) -> str:
    """The article's blocks, each with single spaces, joined by two line feeds; empty where the page has none."""
    if not page:
        return ""
    found = [(t, skip or len(t) < NOTICE_CHARS and bool(_NOTICE.match(t)), article, share) for t, skip, article, share in lines(page)]
    held: dict[int, int] = {}
    for text, skip, article, _ in found:
        if article and not skip:
            held[article] = held.get(article, 0) + len(text)
    sizes = [0 if skip or share > 0.6 else len(t) for t, skip, _, share in found]
    if held and 2 * max(held.values()) >= sum(sizes):
        found = [f for f in found if f[0] and not (f[2] and f[1])]
        sizes = [len(t) if article and not skip else 0 for t, skip, article, _ in found]
    threshold = max(1, min(SURGE, max(sizes, default=0)))
    kept, first = [], 0  # the lines from ``first`` on are not kept yet
    surged = False
    for k, n in enumerate(sizes):
        block = sum(sizes[k : k + WINDOW])
        if surged and not block:
            surged, first = False, k
        elif not surged and block >= threshold:
            surged, start = True, k
            while start > first and sizes[start - 1] and found[start - 1][2] == found[k][2] > 0:
                start -= 1
            kept += [found[j][0] for j in range(start, k)]
        if surged and n:
            kept.append(found[k][0])
    return "\n\n".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row id, url, text and n_chars (code points); no shuffle.

    Null or empty html, and pages without main text, give an empty text. Repeated rows are judged each; other
    columns are not read; an empty table gives no rows. Nothing is cut, whatever a page's length.
    """
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        return {"id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    source = pages.select(pages[id_col].cast("long").alias("id"), pages[url_col].cast("string").alias("url"), pages[html_col].alias("html"))
    out = source.mapInArrow(arrow_rows(work, schema, 64), "id long, url string, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")

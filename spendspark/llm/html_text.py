"""Main text of web pages by the distribution of text over line blocks.

Method: markup is stripped and every block element becomes a line. A line weighs its text
outside links. Markup changes weights: lines of menus, headers, footers, sidebars, notices,
adverts, forms and comments, as their element, class, id or role names them, weigh nothing, nor
do lines outside an article or main part where the page marks one; a line inside that mark weighs
its links too, and at least what a surge needs. Weights are summed over sliding windows of WINDOW
lines. A stretch runs from where windows rise above zero to the dive, where they fall back to it;
it is text if it has a surge, a window of at least SURGE of the strongest one. Its lines of weight are
kept, and lines of links alone between them. An advert of a line or two inside the text
thus doesn't end it, and a short paragraph of a marked article isn't lost.

Names on headings and paragraphs say what the text is about and don't count. Names that an
article's own parts also bear (FAINT: a related or a search part) only take a line's links out of
its weight and its mark's least weight away, so that a line of links alone goes.

Character references are decoded once, white space within a block (a line break element too)
becomes one space, blocks are joined by a line feed in page order.

Cases: null or empty html, or html without text, gives an empty text. Unclosed elements end
with their parent, an unclosed script, style or comment runs to the end, a tag cut off at the
end is dropped. Pages are read one by one, so repeated rows give equal rows; other columns
pass through.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendspark.llm.frames import with_batches

WINDOW = 3  # lines
SURGE = 0.25

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^<>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
SPACE = re.compile(r"\s+")
NAME = re.compile(r"[a-z0-9]+")

# Elements by their part in a page.
RAW = {"script", "style", "textarea", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
AROUND = {"head", "nav", "aside", "footer", "form", "menu", "dialog", "button", "select"}
MAIN = {"article", "main"}
BLOCKS = {"address", "article", "blockquote", "body", "caption", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
          "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li",
          "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul", "aside"}
# Names that classes, ids and roles give to parts around the text, whole words.
NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "banner", "sidebar", "nav",
         "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "comment", "comments", "reply", "replies",
         "respond", "disqus", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal",
         "newsletter", "subscribe", "subscription", "signup", "login", "pagination", "pager", "contentinfo",
         "complementary", "dialog"}
FAINT = {"share", "sharing", "social", "related", "recommended", "widget", "toolbar", "search"}
TITLED = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "a", "span", "b", "i", "em", "strong"}  # ids there are anchors
HEADS = {"header", "masthead", "topbar"}  # only outside the article


CLEAR, FADED, AROUND_TEXT = range(3)


def part_of(name: str, attributes: str, inside_main: bool) -> int:
    """Whether an element's own markup places it around the text, or fades its lines."""
    if name in AROUND or (name == "header" and not inside_main):
        return AROUND_TEXT
    if name in ("html", "body") or name in MAIN and "comment" not in attributes.lower():
        return CLEAR
    found = CLEAR
    for match in ATTRIBUTE.finditer(attributes):
        kind, value = match[1].lower(), (match[2] or "").strip("\"'").lower()
        if kind == "hidden" or kind == "aria-hidden" and value == "true":
            return AROUND_TEXT
        if kind == "style":
            if "display:none" in value.replace(" ", ""):
                return AROUND_TEXT
        elif kind != "id" or name not in TITLED:
            words = set(NAME.findall(value))
            if words & NAMES or (not inside_main and words & HEADS):
                return AROUND_TEXT
            if words & FAINT:
                found = FADED
    return found


def lines_of(page: str) -> tuple[list[tuple[str, int, int, bool]], bool]:
    """Lines as (text, its length outside links, part, inside the marked main part), and whether
    the page marks a main part. Time is in proportion to the page: a closing tag without an
    open element is passed over, any other search ends at what it closes."""
    lines: list[tuple[str, int, int, bool]] = []
    stack: list[tuple[str, int, bool, bool]] = []  # name, part, main, link
    open_names: Counter[str] = Counter()
    open_blocks: list[int] = []  # depths of the block elements
    part, main, link, marked = CLEAR, False, False, False
    parts: list[str] = []
    linked = at = 0

    def flush() -> None:
        nonlocal parts, linked
        text = SPACE.sub(" ", "".join(parts)).strip()
        if text:
            lines.append((text, max(0, len(text) - linked), part, main))
        parts, linked = [], 0

    def cut(depth: int) -> None:
        nonlocal part, main, link
        for entry in stack[depth:]:
            open_names[entry[0]] -= 1
        while open_blocks and open_blocks[-1] >= depth:
            open_blocks.pop()
        del stack[depth:]
        _, part, main, link = stack[-1] if stack else ("", CLEAR, False, False)

    def add(text: str) -> None:
        nonlocal linked
        text = html.unescape(text) if "&" in text else text
        parts.append(text)
        if link:
            linked += len(text.strip())

    while at < len(page):
        tag = TAG.search(page, at)
        if tag is None:
            add(page[at:])
            break
        if tag.start() > at:
            add(page[at:tag.start()])
        at = tag.end()
        if tag[2] is None:
            continue
        name = tag[2].lower()
        if tag[1]:  # closing
            if name in BLOCKS:
                flush()
            if open_names[name] > 0:
                depth = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name)
                if open_blocks and open_blocks[-1] >= depth:
                    flush()
                cut(depth)
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            if not tag[3].rstrip().endswith("/"):
                at = close.end() if close else len(page)
            continue
        if name in BLOCKS or name in ("br", "td", "th"):
            parts.append(" ")
        if name in BLOCKS:
            flush()
            # a paragraph or list item that was left open ends here
            if open_blocks and (stack[open_blocks[-1]][0] == "p" or stack[open_blocks[-1]][0] == name and name in ("li", "dd", "dt", "tr")):
                cut(open_blocks[-1])
        if name in VOID or tag[3].rstrip().endswith("/"):
            continue
        own = max(part, part_of(name, tag[3], main))
        main_here = main or (name in MAIN and own < AROUND_TEXT)
        marked = marked or main_here
        if name in BLOCKS:
            open_blocks.append(len(stack))
        open_names[name] += 1
        stack.append((name, own, main_here, link or name == "a"))
        _, part, main, link = stack[-1]
    flush()
    return lines, marked


def window_sums(weights: list[float]) -> list[float]:
    return [sum(weights[i:i + WINDOW]) for i in range(len(weights))]


def main_text(page: str | None) -> str:
    lines, marked = lines_of(page or "")
    inside = [part != AROUND_TEXT and (main or not marked) for _, _, part, main in lines]
    weights: list[float] = [0 if not inside[k] else len(text) if main and part == CLEAR else outside_links
                            for k, (text, outside_links, part, main) in enumerate(lines)]
    surge = SURGE * max(window_sums(weights), default=0)
    weights = [max(w, surge) if inside[k] and main and part == CLEAR else w for k, (w, (_, _, part, main)) in enumerate(zip(weights, lines, strict=True))]
    sums = window_sums(weights)
    kept: list[str] = []
    i = 0
    while i < len(sums):
        if not sums[i]:
            i += 1
            continue
        dive = next((k for k in range(i, len(sums)) if not sums[k]), len(sums))
        if max(sums[i:dive]) >= surge:
            heavy = [k for k in range(i, dive) if weights[k]]
            kept += [lines[k][0] for k in range(heavy[0], heavy[-1] + 1)
                     if weights[k] or inside[k] and lines[k][2] == CLEAR]
        i = dive
    return "\n".join(kept)


def extract(pages: DataFrame, page: str = "html", text: str = "text", keep_html: bool = True) -> DataFrame:
    """pages with the main text of each page in a new column."""
    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {text: pa.array([main_text(p) for p in batch.column(page).to_pylist()], pa.string())}

    return with_batches(pages.drop(text), run, [T.StructField(text, T.StringType())], drop=() if keep_html else (page,))


def report(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html"), keep_html=False).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

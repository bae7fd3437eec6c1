"""Main text of web pages by line-block distribution.

Markup is stripped so that a block element is a line.  What is no article by its element, role,
class or exact id (scripts, styles, menus, headers, footers, sidebars, notices, adverts, forms, reader comments)
leaves empty lines in its place.  A class token counts as a whole or as a compound of known names; inside
an article such an element stays if it reads as text (long, mostly no links), save adverts, comments
and the like.  The lengths of the lines are summed over sliding windows of
``WINDOW`` lines; where the sums surge above the threshold text begins, where they dive to nothing it
ends, and the lines between surge and dive are kept.

A page that marks its article (``article``, else ``main``) has length 0 on all lines outside the mark
and the threshold 0: every line of the article is kept, however short.  On other pages the threshold is
``THRESHOLD`` characters (or ``SHARE`` of the largest sum, if that is less), and link text does not count.

Character references are decoded after the markup is gone, white space within a line becomes one
space, lines are joined by one space.

Defined results: null, empty or text-less pages give the empty text; unclosed elements end with what
holds them; repeated rows stay rows of their own; an empty table gives an empty result; further
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempest.llm.batches import run_batches
from tempest.session import run_folder

WINDOW = 3
THRESHOLD = 86
SHARE = 0.3

#: Comments, CDATA, declarations, tags (1: slash, 2: name, 3: attributes), tags with a lone quote.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(?=/?[a-zA-Z])[^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[a-z0-9]+")

RAW = {"script", "style", "textarea", "title", "xmp", "noscript", "noframes", "iframe", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = set("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option
p pre section summary table tbody td tfoot th thead title tr ul""".split())
#: What the next block start or the end of its parent closes.
LOOSE = {"p", "li", "dt", "dd", "td", "th", "tr", "option"}
NO_ARTICLE = set("""head nav aside footer form button select input object embed svg canvas audio video map dialog menu
applet frame frameset""".split()) | RAW
NO_ARTICLE_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search tablist toolbar".split())
#: Class tokens, also joined to compounds with ``HOLDERS``, and exact ids.
NO_ARTICLE_PARTS = set("""ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs captcha comment comments
consent cookie cookies disclaimer disqus footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice
notices outbrain pager pagination popup promo promoted promotion related respond share sharing sidebar signup skip social
sponsor sponsored subscribe taboola toolbar widget widgets""".split())
HOLDERS = set("""area article articles bar block box btn button buttons container content bottom icons inner item items left
links list main message outer page panel post posts primary right secondary section side site slot small text top unit wrap
wrapper""".split())
#: Names that need no look at the text, as its kind does not tell.
CERTAIN = set("""ad ads advert advertisement advertising adverts captcha comment comments consent cookie cookies disqus gdpr
outbrain respond sponsor sponsored taboola""".split())
COMMENTS = {"comment", "comments", "disqus", "respond"}
HEADERS = {"header", "site-header", "page-header", "top-header", "main-header", "siteheader", "pageheader"}


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(text)}


def boilerplate_parts(token: str) -> set[str]:
    """The parts of a class token that name what is no article, if the whole token does."""
    parts = set(_PART.findall(token))
    found = parts & NO_ARTICLE_PARTS
    return found if parts <= NO_ARTICLE_PARTS | HOLDERS else set()


def no_article(name: str, attrs: str, within: bool) -> int:
    """Whether an element, by its start tag, is none of the article: 0 no, 1 if its text agrees, 2 yes.
    ``within``: inside article or main."""
    if name in NO_ARTICLE or name == "header" and not within:
        return 2
    if not attrs or attrs.isspace() or name in ("html", "body", "main"):
        return 0
    a = attributes(attrs)
    if "hidden" in a or a.get("role", "").lower() in NO_ARTICLE_ROLES or re.search(r"display\s*:\s*none", a.get("style", ""), re.I):
        return 2
    tokens, own = a.get("class", "").lower().split(), a.get("id", "").lower().strip()
    found = set().union(*map(boilerplate_parts, tokens))
    # ids of headings are made from their titles
    if own in NO_ARTICLE_PARTS and not re.fullmatch("h[1-6]", name):
        found.add(own)
    if name == "article":
        return 0 if COMMENTS.isdisjoint(found) else 2
    if not CERTAIN.isdisjoint(found) or not HEADERS.isdisjoint([*tokens, own]):
        return 2
    return (1 if within else 2) if found else 0


def reads_as_text(html: str, tokens: list[re.Match], at: int, end: int) -> bool:
    """Whether the markup from ``at`` to ``end`` holds more than ``THRESHOLD`` characters of text, most of it no links."""
    free = linked = link = 0
    for start, m in [*((t.start(), t) for t in tokens), (end, None)]:
        n = len(" ".join(html[at:start].split()))
        free, linked = free + (0 if link else n), linked + (n if link else 0)
        if m is not None:
            at = m.end()
            if m[2] is not None and m[2].lower() == "a":
                link = 0 if m[1] else 1
    return free > THRESHOLD and free > linked


class Lines:
    """The lines of a page: text, its length without links, whether in article and in main."""

    def __init__(self):
        self.rows: list[tuple[str, int, bool, bool]] = []
        self.parts: list[str] = []
        self.linked = 0

    def text(self, raw: str, in_link: bool) -> None:
        if raw:
            self.parts.append(raw)
            self.linked += len(raw) if in_link else 0

    def end(self, in_article: bool, in_main: bool) -> None:
        if self.parts:
            raw = "".join(self.parts)
            line = " ".join(unescape(raw).split())
            free = max(0, len(raw) - self.linked) / len(raw)
            self.rows.append((line, round(len(line) * free), in_article, in_main))
            self.parts, self.linked = [], 0

    def gap(self) -> None:
        self.rows += [("", 0, False, False)] * WINDOW


def page_lines(html: str) -> list[tuple[str, int, bool, bool]]:
    """Strip the markup of a page."""
    tokens = list(_TOKEN.finditer(html))
    out, stack, at, i = Lines(), [], 0, 0
    article = main = link = 0

    def close(name: str) -> None:
        """Take elements from the stack up to the last one of that name."""
        nonlocal article, main, link
        while stack:
            last = stack.pop()
            article, main, link = article - (last == "article"), main - (last == "main"), link - (last == "a")
            if last == name:
                return

    while i < len(tokens):
        m = tokens[i]
        out.text(html[at:m.start()], link > 0)
        at, i = m.end(), i + 1
        if m[0].startswith("<![CDATA["):
            out.text(m[0][9:].removesuffix("]]>").replace("&", "&amp;"), link > 0)
        if m[2] is None:
            continue
        name, opening = m[2].lower(), not m[1]
        block = name in BLOCK
        if block:
            out.end(article > 0, main > 0)
        if not opening:
            if name in stack:
                close(name)
            continue
        if name in LOOSE and stack and stack[-1] == name:
            close(name)
        dropped = no_article(name, m[3], article + main > 0)
        if dropped == 1 and name not in RAW and name not in VOID and not m[3].endswith("/"):
            k, stop = end_of(tokens, i, name, stack, len(html))
            last = k - 1 if k > i and tokens[k - 1].end() == stop else k
            dropped = 0 if reads_as_text(html, tokens[i:last], at, tokens[last].start() if last < k else stop) else 2
        if name in RAW:
            # markup inside is text: look for the end tag in the page itself
            end = re.compile(rf"</{re.escape(name)}\s*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else len(html)
            while i < len(tokens) and tokens[i].start() < at:
                i += 1
            if i and tokens[i - 1].end() > at:  # a token that began inside and runs on
                tokens = tokens[:i] + list(_TOKEN.finditer(html, at))
        elif dropped:
            if name not in VOID and not m[3].endswith("/"):
                i, at = end_of(tokens, i, name, stack, len(html))
        elif name not in VOID and not m[3].endswith("/"):
            stack.append(name)
            article, main, link = article + (name == "article"), main + (name == "main"), link + (name == "a")
        if dropped and block:
            out.gap()
    out.text(html[at:], link > 0)
    out.end(article > 0, main > 0)
    return out.rows


def end_of(tokens: list[re.Match], i: int, name: str, stack: list[str], length: int) -> tuple[int, int]:
    """The next token and place after the element that starts before token ``i``: after its end tag
    or, if that is missing, at the end tag of an element around it (loose elements: at the next
    block)."""
    depth, held = 1, set(stack)
    inner: dict[str, int] = {}
    for k in range(i, len(tokens)):
        m = tokens[k]
        if m[2] is None:
            continue
        n, opening = m[2].lower(), not m[1]
        if n == name:
            if opening and name in LOOSE:
                return k, m.start()
            depth += 1 if opening else -1
            if not depth:
                return k + 1, m.end()
        elif opening:
            if name == "p" and n in BLOCK and n != "br":
                return k, m.start()
            if n in held and n not in VOID:
                inner[n] = inner.get(n, 0) + 1
        elif inner.get(n, 0):
            inner[n] -= 1
        elif n in held:
            return k, m.start()
    return len(tokens), length


def line_blocks(lengths: list[int], window: int = WINDOW) -> list[int]:
    """Sums of the lengths over the windows that start at each line."""
    out, total = [], sum(lengths[:window])
    for i in range(len(lengths)):
        out.append(total)
        total += (lengths[i + window] if i + window < len(lengths) else 0) - lengths[i]
    return out


def surges(lengths: list[int], threshold: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """(surge, dive): lines from the surge on and before the dive hold text.

    Text begins with the first line of length in a window whose sum exceeds the threshold and ends
    where a window sums to nothing.
    """
    blocks, out, i = line_blocks(lengths, window), [], 0
    while i < len(blocks):
        if blocks[i] <= threshold:
            i += 1
            continue
        start = next(k for k in range(i, len(lengths)) if lengths[k])
        # lines just before, in the same run of text
        while start and lengths[start - 1]:
            start -= 1
        end = i
        while end < len(blocks) and blocks[end]:
            end += 1
        out.append((start, end))
        i = end + 1
    return out


def extract(html: str) -> str:
    """The main text of a page."""
    rows = page_lines(html)
    marked = 2 if any(r[2] and r[0] for r in rows) else 3 if any(r[3] and r[0] for r in rows) else 0
    if marked:
        lengths = [len(r[0]) if r[marked] else 0 for r in rows]
        threshold = 0.0
    else:
        lengths = [r[1] for r in rows]
        threshold = min(float(THRESHOLD), SHARE * max(line_blocks(lengths), default=0))
    keep = [rows[k][0] for a, b in surges(lengths, threshold) for k in range(a, b) if rows[k][0] and (not marked or rows[k][marked])]
    return " ".join(keep)


def main_text(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    return run_batches(rows.mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long"),
                       folder or run_folder(pages.sparkSession, "pages"), "text")

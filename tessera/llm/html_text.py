"""Operator 3: main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. Elements whose name, role, class
or id says that they are not the article (menus, headers, footers, sidebars,
notices, adverts, forms, reader comments) are left out with all they hold;
scripts, styles and comments in the markup never become text.

First pass: a block with many links is boilerplate; a block that is long
enough and has enough stop words is text; a long one almost without stop words
is boilerplate; all others (short, or in between) stay open. Second pass: an
open block takes the label of its nearest decided neighbour in the same region
(a ``main`` or ``article`` element, or else the whole page); between two
equally near ones text wins. A region without any decided block is text, and in a
page without any text by the first pass only links make boilerplate. If a page has an article region with text, blocks outside
of it are boilerplate. A form that holds the only text of a page (first pass) wraps the
page and is read.

Words of a class, id or role tell noise by grades. Headings are never noise by their id.
Inside an article region a word of ordinary language (``share``, ``legal``, ``notice``)
counts only where it comes first in a name, and ``market-share`` stays.

Semantics: null or empty html gives the empty text. Broken markup is read to its
end in linear time: unclosed elements end with their parent, an unfinished tag at the end is
dropped, attribute values may hold ``>`` in quotes. Where quotes would leave a tag without an end,
they count no more from there to the end of the page. Whole pages are read whatever
their length; repeated rows get equal texts. ``text`` gives way to the result where the
input has another column of that name."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset("""
a an and are as at be been but by for from had has have he her his i in is it its not of on only or she so that the their
there they this to was we were what which who will with you
aber als am an auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im in ist mit nach
nicht noch nur oder sich sie sind so über um und von war was werden wie wird zu zum zur
au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui mais ne nous on ou par pas plus pour
qu que qui sa se ses son sont sur un une vous
al como con de del el en entre era es esta este ha la las lo los más mi muy no o para pero por porque que se sin sobre su sus
también un una y ya
""".split())

SKIPPED = frozenset("script style noscript template title iframe svg canvas object textarea select button".split())
LEFT_OUT = frozenset("nav footer aside form menu dialog fieldset".split())
REGIONS = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th
thead tr ul""".split())
ENDS_P = BLOCKS - {"br", "option"}
#: Words in a class, id or role that name what is not the article.
NOISE = frozenset("""ad ads adv advert advertisement adverts advertising sponsor sponsored promo promotion banner nav navbar
navigation menu breadcrumb breadcrumbs sidebar aside complementary footer contentinfo masthead header cookie cookies consent
gdpr notice notification alert popup modal overlay dialog newsletter subscribe subscription signup login register comment
comments commentlist disqus respond reply replies discussion share sharing social related recommended recommendations widget
toolbar pagination pager copyright legal disclaimer search form skip toast""".split())
#: Those that articles use as ordinary words.
ORDINARY = frozenset("""promo promotion banner navigation menu aside complementary header consent notice notification alert
dialog subscription login register respond reply replies discussion share sharing social related recommended
recommendations legal copyright disclaimer search form skip toast""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

LONG, ENOUGH = 70, 0.15        # characters and share of stop words that make a block text
EMPTY = 0.05                   # a long block with a smaller share is boilerplate
LINKED = 0.5                   # share of characters in links that makes a block boilerplate

_OPEN = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)|/)")
#: Attributes up to the end of the tag; a quote counts only where a value begins.
_REST = re.compile(r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_ATTRIBUTE = re.compile(r"([^\s=>/\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
_ZEROS = re.compile(r"(&#[xX]?)0{3,}+")
_HUGE = re.compile(r"&#[0-9]{12,}+;?")         # beyond any character
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    region: int                # number of the article region, 0 outside of any
    text: str
    linked: int                # characters in links


def _names_noise(value: str, strict: bool) -> bool:
    """Does a class, id or role name noise? ``strict``: an ordinary word must come first in a name."""
    for name in value.split():
        for i, part in enumerate(_PART.findall(name)):
            part = part.lower()
            if part in NOISE and not (strict and i and part in ORDINARY):
                return True
    return False


def _says_noise(tag: str, rest: str, inside: bool) -> bool:
    for name, a, b, c in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" \
                or name == "style" and re.search(r"display\s*+:\s*+none", value, re.I):
            return True
        if (name in ("class", "role") or name == "id" and tag not in HEADINGS) and _names_noise(value, inside):
            return True
    return False


def unescape(raw: str) -> str:
    """Character references decoded; numbers of any length, those beyond any character as U+FFFD."""
    if "&#" in raw:
        raw = _HUGE.sub("\ufffd", _ZEROS.sub(r"\g<1>0", raw))
    return html.unescape(raw)


def _markup(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """(start, end, name, is an end tag, attributes) of every piece of markup in
    order; the name is None for comments and the like, and empty for CDATA, whose text stands in
    place of attributes. A piece may be sent a position to go on from."""
    at, last, quotes = 0, page.rfind(">"), True
    while m := _OPEN.search(page, at):
        start, at, name, rest, is_end = m.start(), m.end(), None, "", False
        if m[0] == "<!--" or m[0] == "<![CDATA[":
            close = "-->" if m[0] == "<!--" else "]]>"
            end = page.find(close, at)
            if m[0] != "<!--":
                name, rest = "", page[at:end if end >= 0 else len(page)]
            at = len(page) if end < 0 else end + 3
        elif m[0] in ("<!", "<?"):
            at = len(page) if start > last else page.index(">", at) + 1
        elif start > last:                               # no tag ends from here on
            if page.find("<", at) >= 0:
                continue
            at = len(page)                               # the unfinished one at the end goes
        elif not m["name"]:
            continue
        else:
            name, is_end = m["name"].lower(), bool(m["end"])
            found = _REST.match(page, at) if quotes else None
            if found:
                rest, at = found[1], found.end()
            else:
                end = page.index(">", at)
                quotes, rest, at = False, page[at:end], end + 1
        to = yield start, at, name, is_end, rest
        at = at if to is None else to


def blocks(page: str, forms: bool = False) -> list[Block]:
    """Blocks of a page in order, without the elements that are left out;
    with ``forms`` an element is not left out for being a form."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int]] = []             # open elements: name, left out, region
    where: dict[str, list[int]] = {}                    # their places in the stack by name
    region_at: list[int] = []                           # places of article and main elements
    text: list[str] = []
    unclosed: set[str] = set()                          # skipped elements without an end tag from here on
    linked = links = regions = at = 0
    out_of = 0                                          # open elements that are left out

    def region() -> int:
        return stack[-1][2] if stack else 0

    def flush() -> None:
        nonlocal linked
        joined = " ".join("".join(text).split())
        if joined:
            out.append(Block(region(), joined, linked))
        text.clear()
        linked = 0

    def close(to: int) -> None:
        nonlocal links, out_of
        while len(stack) > to:
            name, left, _ = stack.pop()
            where[name].pop()
            if name in REGIONS:
                region_at.pop()
            out_of -= left
            links -= name == "a"

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not out_of:
            raw = unescape(raw)
            text.append(raw)
            if links:
                linked += len(raw.strip())

    pieces, to = _markup(page), None
    while True:
        try:
            start, end, name, is_end, rest = pieces.send(to)
        except StopIteration:
            break
        to = None
        add(page[at:start])
        at = end
        if not name:
            if name is not None and rest:
                add(html.escape(rest))
            continue
        if is_end:
            if name in BLOCKS:
                flush()
            # a stray end tag does not end the article
            if where.get(name) and (name in ("body", "html") or not region_at or region_at[-1] <= where[name][-1]):
                close(where[name][-1])
            continue
        if name in SKIPPED and not (name == "svg" and rest.endswith("/")):
            stop = None if name in unclosed else re.compile(rf"</{re.escape(name)}\s*+>", re.I).search(page, at)
            if stop:
                at = to = stop.end()
            elif name in ("script", "style", "textarea", "title"):
                at = to = len(page)
            else:
                unclosed.add(name)
            continue
        if name in BLOCKS:
            flush()
        if name in ENDS_P and where.get("p") and where["p"][-1] >= len(stack) - 6:
            close(where["p"][-1])
        if name in VOID or rest.endswith("/"):
            continue
        inside = region()
        noise = name in LEFT_OUT and not (forms and name == "form") or name == "header" and not inside or \
            name not in ("html", "body", "main") and bool(rest.strip()) and _says_noise(name, rest, bool(inside)) \
            and not (forms and name == "form")
        if name in REGIONS and not inside and not noise and not out_of:
            regions += 1
            inside = regions
        if name in REGIONS:
            region_at.append(len(stack))
        where.setdefault(name, []).append(len(stack))
        stack.append((name, noise, inside))
        out_of += noise
        links += name == "a"
    add(page[at:])
    flush()
    return out


def first_pass(b: Block) -> bool | None:
    """True: text, False: boilerplate, None: open."""
    if b.linked > LINKED * len(b.text):
        return None if b.region else False
    words = _WORD.findall(b.text.lower())
    share = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    if len(b.text) >= LONG and share >= ENOUGH:
        return True
    if len(b.text) >= LONG and share < EMPTY and not b.region:
        return False
    return None


def second_pass(found: list[Block], labels: list[bool | None]) -> list[bool]:
    """Open blocks take the label of the nearest decided block of their region."""
    n = len(found)
    before, after = [None] * n, [None] * n
    for order, near in ((range(n), before), (range(n - 1, -1, -1), after)):
        last: dict[int, int] = {}
        for i in order:
            near[i] = last.get(found[i].region)
            if labels[i] is not None:
                last[found[i].region] = i
    out = []
    for i, label in enumerate(labels):
        a, b = before[i], after[i]
        if label is None:
            if a is None and b is None:
                label = True
            elif a is None or b is None:
                label = labels[b if a is None else a]
            elif i - a == b - i:
                label = labels[a] or labels[b]
            else:
                label = labels[a if i - a < b - i else b]
        out.append(bool(label))
    return out


def main_text(page: str | None) -> str:
    page = page or ""
    found = blocks(page)
    labels = [first_pass(b) for b in found]
    if True not in labels and "<form" in page.lower():
        wrapped = blocks(page, forms=True)
        if True in (read := [first_pass(b) for b in wrapped]):
            found, labels = wrapped, read
    if True not in labels:                              # no text to compare with: only links speak against a block
        labels = [None if label is False and b.linked <= LINKED * len(b.text) else label for b, label in zip(found, labels)]
    labels = second_pass(found, labels)
    article = any(b.region for b, good in zip(found, labels) if good)
    return " ".join(b.text for b, good in zip(found, labels) if good and (b.region or not article))


def extract(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text in place of the html."""
    keep = [c for c in pages.columns if c != html_col and c.lower() != out.lower()]
    schema = T.StructType([*[pages.schema[c] for c in keep], T.StructField(out, T.StringType(), False)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(x) for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(text, pa.string())], names=schema.names)

    return pages.select(*keep, html_col).mapInArrow(work, schema)

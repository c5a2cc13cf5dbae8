"""HTML extraction by two-pass block rules.

A page is cut into blocks at block-level tags. Blocks of boilerplate containers (menus, headers, footers,
sidebars, notices, adverts, forms, comments) and, where the page marks an article, blocks outside it are no
candidates. All others go by two passes, on every page. The first asks length, link density and stop-word
density: a block is good, bad or ambiguous. In the second, ambiguous blocks inherit the label of their nearest
decided neighbour. Markup is a feature of the first pass: inside an article, a block that would be bad is
ambiguous, and where no block of an article is decided, the article's mark decides; inside a
container whose name only hints at boilerplate (related, share), and on pages without an article, densities
alone decide. Each page stands alone, so the operator is a narrow pass.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import put, slices
from lexloom.llm.quality import STOP_WORDS

_STOP = frozenset(" ".join(STOP_WORDS.values()).split())

#: Fixed lists of tags, by what they mean here.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose content is no text of the page; those of the first line run to the page's end where their end tag is missing.
RAW_TO_END = ("script", "style", "textarea")
RAW_TAGS = ("title", "noscript", "iframe", "xmp", "noembed", "noframes", "template", "svg", "object", "canvas", "audio", "video", "select", "datalist")
BAD_TAGS = frozenset("nav footer aside form menu dialog head search".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE_TAGS = frozenset(("article", "main"))
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of a class or id that tell a boilerplate container, those that only hint at one, and those that tell an article.
BAD_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright "
    "disqus footer gdpr masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo "
    "promoted reply replies respond sharing sidebar sidenav signup sponsor sponsored subscribe teaser toolbar topbar".split()
)
#: Those of them that name a place in a layout, and so are found on wrappers of whole pages too.
PLACE_WORDS = frozenset("banner footer masthead menu menubar modal nav navbar navigation overlay pager pagination sidebar sidenav toolbar topbar".split())
HINT_WORDS = frozenset("header promotion recommended related share social widget widgets".split())
#: Next to these such a word tells of a layout, not of the element.
MODIFIERS = frozenset("has with no without".split())
ARTICLE_WORDS = frozenset("article articlebody content entry post story maincontent".split())

_ATTRIBUTES = r"(?>[^>\"']|\"[^\"]*\"|'[^']*')*+"
_TOKEN = re.compile(
    rf"<!--(?:.*?-->|.*)"  # comments
    rf"|<({'|'.join(RAW_TO_END)})(?=[\s/>]){_ATTRIBUTES}>(?:.*?</\1(?=[\s/>])[^>]*>|.*)"
    rf"|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})>"  # tags
    rf"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)"  # tags with odd quotes, or cut off
    rf"|<[!?/][^>]*(?:>|$)",  # declarations and the like
    re.S | re.I,
)
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW_TAGS}
_NAMES = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_HREF = re.compile(r"(?:^|\s)href(?=[\s=]|$)", re.I)
#: A notice of rights: the mark at the begin, or before a year.
_RIGHTS = re.compile(r"^\W*(?:copyright\b|©)|©\s*(?:19|20)\d\d", re.I)
_WORD = re.compile(r"[^\W\d_]+|\d+")
_LETTERS = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass(frozen=True)
class Rules:
    """Thresholds of the first pass: lengths in code points, densities as shares of words (of letters) or of code points."""

    short: int = 70
    long: int = 200
    stop_low: float = 0.15
    stop_high: float = 0.25
    max_links: float = 0.4


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    region: int = 0  # 0: outside an article, 1: inside, 2: inside, in what hints at boilerplate, -1: in a boilerplate container
    wrapper: int = 0  # the outermost container that may be a mere wrapper, if that is what makes the region -1
    within: int = 0  # the region without that container
    heading: bool = False
    text: str = ""
    label: int = 0  # 1 good, -1 bad, 0 ambiguous
    decided: str = ""  # what decided: container, density, neighbour or article


def _region(tag: str, attributes: str, inside: int) -> tuple[int, bool]:
    """What an element makes of its content, given what it stands in, and whether it may be a wrapper all the same: a
    form, or an element outside articles whose name tells a place in a layout and nothing worse.
    """
    if inside < 0:
        return -1, False
    if tag in BAD_TAGS or (tag == "header" and inside == 0):
        return -1, tag == "form" and not inside
    found, wrapper = inside, False
    if attributes and tag not in ("body", "html"):
        for name, value in _NAMES.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                return -1, False
            if name == "role":
                if value.lower() in BAD_ROLES:
                    return -1, False
                if value.lower() in ARTICLE_TAGS and not inside:
                    found = 1
            elif name in ("class", "id") and tag not in ARTICLE_TAGS:
                words = {w.lower() for w in _WORD.findall(_CAMEL.sub(" ", value))}
                if words & BAD_WORDS and not words & MODIFIERS:
                    if words & BAD_WORDS - PLACE_WORDS:
                        return -1, False
                    if inside:  # in an article a place's name alone drops nothing: densities are asked
                        found = 2
                    else:
                        wrapper = True
                elif found and words & HINT_WORDS:
                    found = 2
                elif not inside and words & HINT_WORDS == {"header"}:
                    return -1, False
                elif not inside and words & ARTICLE_WORDS:
                    found = 1
    if wrapper:
        return -1, True
    return (1 if tag in ARTICLE_TAGS else found), False


def blocks(page: str) -> list[Block]:
    """The blocks with text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, int, int, int]] = []  # open elements that can change the region, with region, wrapper and region without it
    links, at, wrappers = 0, 0, 0
    now = Block()

    def close(tag: str = "") -> None:
        nonlocal now
        if now.parts:
            now.text = " ".join(html.unescape("".join(now.parts)).split())
            if now.text:
                out.append(now)
        region, wrapper, within = stack[-1][1:] if stack else (0, 0, 0)
        now = Block(region=region, wrapper=wrapper, within=within, heading=tag[:1] == "h" and tag[1:].isdigit())

    def text(piece: str) -> None:
        now.parts.append(piece)
        if links:
            now.linked += len(piece.strip())

    never: set[str] = set()  # tags that nothing closes from here on
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        closing = bool(m[2] or m[5])
        attributes = (m[4] if m[3] else m[7]) or ""
        if tag in _END and not closing and not attributes.endswith("/"):  # one that closes itself, or is never closed, holds nothing
            end = None if tag in never else _END[tag].search(page, at)
            if end:
                at = end.end()
                continue
            never.add(tag)
            if tag == "title":
                at = page.find("<", at) if "<" in page[at:] else len(page)
        if tag == "a":
            links = 0 if closing else int(bool(_HREF.search(attributes)))  # one without is an anchor, no link
        elif tag == "br":
            now.parts.append(" ")
        elif closing:
            if tag in BLOCK_TAGS:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
                links = 0
                close()
        elif tag in BLOCK_TAGS:
            if tag == "p" and stack and stack[-1][0] == "p":
                stack.pop()
            inside, wrapper, within = stack[-1][1:] if stack else (0, 0, 0)
            if tag not in VOID_TAGS:
                region, may_wrap = _region(tag, attributes, inside)
                if wrapper:
                    own = _region(tag, attributes, within)[0]
                elif may_wrap:
                    wrappers += 1
                    wrapper, own = wrappers, inside
                else:
                    own = region
                if tag != "p" or (region, own) != (inside, within):  # a plain paragraph often stays open
                    stack.append((tag, region, wrapper, own))
            close(tag)
    if at < len(page):
        text(page[at:])
    close()
    return out


def first_pass(text: str, linked: int, region: int, rules: Rules) -> int:
    """Good, bad or ambiguous, by length, link density and stop-word density."""
    n = len(text)
    if linked > rules.max_links * n:
        return 0 if region == 1 else -1
    if n < rules.long and region != 1 and _RIGHTS.search(text):
        return -1
    if n < rules.short:
        return 0
    words = _LETTERS.findall(text.lower())
    stop = sum(w in _STOP for w in words) / max(1, len(words))
    if stop >= rules.stop_high or (stop >= rules.stop_low and n >= rules.long):
        return 1
    return 0 if stop >= rules.stop_low or region == 1 else -1


def unwrap(found: list[Block], rules: Rules) -> None:
    """A container that may be a wrapper, and holds over half of the page's prose while no article is marked outside it, is
    no boilerplate: its blocks take the region that they have without it. Prose: blocks that densities call good.
    """
    if not any(b.wrapper for b in found) or any(b.region > 0 for b in found):
        return
    prose: dict[int, int] = {}
    for b in found:
        if (b.within if b.wrapper else b.region) >= 0 and first_pass(b.text, b.linked, 0, rules) > 0:
            prose[b.wrapper] = prose.get(b.wrapper, 0) + len(b.text)
    for b in found:
        if b.wrapper and 2 * prose.get(b.wrapper, 0) > sum(prose.values()):
            b.region = b.within


def classify(found: list[Block], rules: Rules = Rules()) -> None:
    """Sets the labels of a page's blocks."""
    unwrap(found, rules)
    marked = any(b.region > 0 for b in found)
    asked = []
    for b in found:
        if b.region < 0 or (marked and b.region == 0):
            b.label, b.decided = -1, "container"
            continue
        b.label = first_pass(b.text, b.linked, b.region, rules)
        b.decided = "density" if b.label else ""
        asked.append(b)
    # second pass: the nearest decided blocks before and after, among those that were asked; what surely stands in an article asks its like
    n = len(asked)
    before, after = [(0, 0)] * n, [(0, 0)] * n
    for order, near in ((range(n), before), (range(n - 1, -1, -1), after)):
        last = {True: (0, 0), False: (0, 0)}  # label and place of the nearest decided block; True: of an article
        for at, i in enumerate(order):
            sure = asked[i].region == 1
            label, place = last[sure]
            near[i] = (label, at - place)
            if asked[i].decided == "density":
                last[False] = (asked[i].label, at)
                if sure:
                    last[True] = (asked[i].label, at)
    for b, (p, dp), (q, dq) in zip(asked, before, after, strict=True):
        if b.label:
            continue
        b.decided = "neighbour"
        if not p and not q:
            b.label, b.decided = int(marked), "article" if marked else ""
        elif not p or not q:
            b.label = p or q
        elif b.heading:
            b.label = q  # a heading goes with what it heads
        else:
            b.label = p if dp < dq else q if dq < dp else max(p, q)
    if not any(b.label > 0 for b in asked) and not marked:  # stop words tell nothing here: keep what is no boilerplate
        for b in asked:
            b.label, b.decided = (1 if b.linked <= rules.max_links * len(b.text) else -1), "density"


def main_text(page: str | None, rules: Rules = Rules()) -> str:
    found = blocks(page or "")
    classify(found, rules)
    return "\n".join(b.text for b in found if b.label > 0)


def extract(pages: DataFrame, column: str = "html", rules: Rules = Rules()) -> DataFrame:
    """pages with text (the main text) and n_chars (its code points).

    A null or empty page has the empty text. Pages of any length are taken whole, cut-off markup at a
    page's end is markup, repeated rows are read alike, an empty table gives an empty result, and input
    columns named text or n_chars give way.
    """
    held = put(pages, __page=F.col(f"`{column}`"))
    held = held.select(*[c for c in held.columns if c.lower() not in ("text", "n_chars")])
    names = held.columns[:-1]
    at = len(names)
    drop = column in names and column not in ("text", "n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at, 256):
                texts = [main_text(p, rules) for p in part.column(at).to_pylist()]
                cols = [part.column(i) for i in range(at)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    from pyspark.sql.types import LongType, StringType, StructField, StructType

    if drop:  # the page itself need not travel twice
        held = held.drop(column)
        names.remove(column)
        at -= 1
    schema = StructType([held.schema[c] for c in names] + [StructField("text", StringType()), StructField("n_chars", LongType())])
    return held.mapInArrow(run, schema)

"""Main text of web pages by two-pass block rules."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataguild.llm.common import map_batches

#: Bounds of the first pass: characters of short and long blocks, shares of stop words and of text in links.
SHORT, LONG = 70, 200
STOPS_LOW, STOPS_HIGH = 0.30, 0.32
LINKS = 0.2
#: With fewer known stop words than this a page is in another language, and blocks are judged by length and links.
KNOWN = 0.02
#: In the part that the page itself marks as its article only blocks that are mostly links are menus.
ARTICLE_LINKS = 0.5

#: Common words of the languages at hand, and names that HTML and its authors give to parts of a page.
STOP_WORDS = frozenset(
    (
        "a about all also an and are as at be been but by can could did do for from had has have he her his how i if in into is it its "
        "more no not of on one or our out she so some than that the their them then there these they this to up was we were what when "
        "which who will with would you your "
        "au aux avec ce ces dans de des du elle en est et eux il je la le les leur lui ma mais me mes mon ne nos notre nous on ou par pas "
        "pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous sont être été plus "
        "aber alle als am an auch auf aus bei bin bis bist da dann das dass dem den der des die dies diese doch dort du durch ein eine "
        "einem einen einer er es für hat haben hier ich ihr im in ist ja kann man mit nach nicht noch nur oder sein sich sie sind so "
        "über um und uns von vor war was wenn wer wie wir wird zu zum zur "
        "al algo como con cual cuando de del desde donde el ella ellos en entre era es esa ese esta este esto fue ha hay la las le les "
        "lo los me mi muy más ni nos o para pero por porque que quien se ser si sin sobre son su sus también te tiene todo un una uno y ya"
    ).split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Elements whose content is no markup, up to their end tag; and elements whose content is dropped with its markup.
RAW = "script|style|iframe|textarea|title"
HOLLOW = frozenset("noscript template object svg canvas".split())
#: Elements that end a hollow one without an end tag.
FLOW = frozenset(
    "address article aside blockquote body center details div dl dt dd fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td th tr ul".split()
)
BOILER_TAGS = frozenset("nav header footer aside form button select option label fieldset legend dialog menu".split())
ARTICLE_TAGS = frozenset("article main".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
BOILER_NAMES = frozenset(
    (
        "ad ads advert advertisement adverts alert author-box banner breadcrumb breadcrumbs byline comment comments consent cookie cookies "
        "copyright disclaimer disqus footer form header legal login masthead menu modal nav navbar navigation newsletter notice notices "
        "pager pagination popup promo promotion recommended related reply replies respond search share sharing sidebar signup social "
        "sponsor sponsored subscribe subscription teaser toolbar widget"
    ).split()
)
ARTICLE_NAMES = frozenset("article content entry main post story".split())

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[a-zA-Z/!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
HOLLOW_TAG = re.compile(rf"<(/?)({'|'.join(sorted(HOLLOW))})\b[^>]*>", re.I)
ATTR = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    """A run of text between block tags."""

    text: str
    link_chars: int
    boiler: bool
    article: int
    heading: bool
    label: str = ""


def _traits(tag: str, attrs: str) -> tuple[bool, bool]:
    """Whether an element is a page part that is no article text, or one that is marked as the article."""
    boiler, article = tag in BOILER_TAGS, tag in ARTICLE_TAGS
    if attrs.strip(" /"):
        for name, *values in ATTR.findall(attrs):
            name, value = name.lower(), "".join(values).lower()
            if name in ("class", "id"):
                names = set(value.split())
                parts = names | {p for n in names for p in re.split(r"[-_]+", n)}
                boiler |= not BOILER_NAMES.isdisjoint(parts) and tag not in ("html", "body", "article", "main")
                article |= tag not in INLINE and not ARTICLE_NAMES.isdisjoint(parts)
            elif name == "role":
                boiler |= value in BOILER_ROLES
                article |= value in ("main", "article")
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                boiler = tag not in ("html", "body")
    return boiler, article and not boiler


def _hollow_ends(html: str) -> dict[int, int]:
    """Where hollow elements with an end tag of their own end, by where they start."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for m in HOLLOW_TAG.finditer(html):
        starts = opened.setdefault(m[2].lower(), [])
        if not m[1]:
            if not m[0].endswith("/>"):
                starts.append(m.start())
        elif starts:
            ends[starts.pop()] = m.end()
    return ends


def blocks_of(html: str) -> list[Block]:
    """The blocks of a page in order, with white space and character references settled.

    Nothing hangs on the end of ``head``: its elements have no text or drop their own, and other text belongs to the
    body.  A hollow element without an end tag ends with the element around it or at the first block in it.
    """
    out: list[Block] = []
    stack: list[tuple[str, bool, int, bool, bool, bool]] = []
    boiler, article, link, heading, hollow = False, 0, False, False, False
    articles, parts, links = 0, [], 0
    ends: dict[int, int] | None = None

    def flush() -> None:
        nonlocal parts, links
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, links, boiler, article, heading))
        parts, links = [], 0

    def add(raw: str) -> None:
        nonlocal links
        if hollow:
            return
        text = unescape(raw) if "&" in raw else raw
        parts.append(text)
        if link:
            links += len(text.strip())

    def pop(to: int) -> None:
        nonlocal boiler, article, link, heading, hollow
        _, boiler, article, link, heading, hollow = stack[to]
        del stack[to:]

    at = 0
    while m := TOKEN.search(html, at):
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "head":
            flush()
            continue
        if tag in HOLLOW and not m["end"]:
            ends = _hollow_ends(html) if ends is None else ends
            if m.start() in ends:
                at = ends[m.start()]
                continue
        if hollow and tag in FLOW and not m["end"]:
            pop(next(i for i, x in enumerate(stack) if x[0] in HOLLOW))
        if tag == "br":
            parts.append(" ")
        elif m["end"]:
            inline = tag in INLINE
            if not inline:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if inline and any(x[0] not in INLINE for x in stack[i:]):
                        break
                    pop(i)
                    break
                if inline and stack[i][0] not in INLINE:
                    break
        else:
            inline = tag in INLINE
            if not inline:
                flush()
                # A new paragraph or item ends the open one, with what is left open in it.
                if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option") or re.fullmatch("h[1-6]", tag):
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == (tag if tag[0] != "h" else "p") or stack[i][0] == "p":
                            pop(i)
                            break
                        if stack[i][0] not in INLINE:
                            break
            if tag not in VOID and not m["attrs"].rstrip().endswith("/"):
                stack.append((tag, boiler, article, link, heading, hollow))
                hollow |= tag in HOLLOW
                now, inside = _traits(tag, m["attrs"])
                boiler |= now
                if inside and not article:
                    articles += 1
                    article = articles
                link |= tag == "a"
                heading |= bool(re.fullmatch("h[1-6]", tag))
            elif not inline and tag not in VOID:
                flush()
    add(html[at:])
    flush()
    return out


def classify(blocks: list[Block]) -> None:
    """Label the blocks ``good`` or ``bad`` in two passes.

    First, blocks of page parts that are no article, and blocks with much text in links, are bad.  Where the page
    marks an article, other blocks in it are good if they are not short, and blocks outside are bad.  Elsewhere long
    blocks with many stop words are good, those with few are bad, and the rest stays open; on a page without known stop
    words long blocks are good and middling ones nearly.  Then open blocks take the
    label of their nearest decided neighbours: those of one label on both sides get it; between a good and a bad
    neighbour, nearly good blocks are good and short ones follow the closer neighbour, headings the one below.  Inside
    a marked article only neighbours in it count, and without any the block is good.
    """
    marked = any(b.article and not b.boiler for b in blocks)
    told: dict[int, tuple[int, int]] = {}
    if not marked:
        for i, b in enumerate(blocks):
            if not b.boiler and len(b.text) >= SHORT and b.link_chars / len(b.text) <= LINKS:
                words = WORD.findall(b.text.lower())
                told[i] = (sum(w in STOP_WORDS for w in words), len(words))
    known = sum(x for x, _ in told.values()) >= KNOWN * sum(n for _, n in told.values())
    for i, b in enumerate(blocks):
        n = len(b.text)
        share = b.link_chars / n
        if b.boiler or marked and not b.article:
            b.label = "bad"
        elif marked:
            b.label = "bad" if share > ARTICLE_LINKS else "good" if n >= SHORT else "short"
        elif share > LINKS:
            b.label = "bad"
        elif n < SHORT:
            b.label = "bad" if b.link_chars else "short"
        else:
            stops = told[i][0] / max(1, told[i][1])
            if not known:
                b.label = "good" if n > LONG else "near"
            elif stops >= STOPS_HIGH:
                b.label = "good" if n > LONG else "near"
            else:
                b.label = "near" if stops >= STOPS_LOW else "bad"
    decided = [b.label if b.label in ("good", "bad") else "" for b in blocks]
    before: list[tuple[str, int]] = []
    last = ("", -1)
    for i, b in enumerate(blocks):
        before.append(last if last[1] >= 0 and (not b.article or blocks[last[1]].article == b.article) else ("", -1))
        if decided[i] and not b.boiler:
            last = (decided[i], i)
    after: list[tuple[str, int]] = []
    last = ("", -1)
    for i in range(len(blocks) - 1, -1, -1):
        b = blocks[i]
        after.append(last if last[1] >= 0 and (not b.article or blocks[last[1]].article == b.article) else ("", -1))
        if decided[i] and not b.boiler:
            last = (decided[i], i)
    after.reverse()
    for i, b in enumerate(blocks):
        if decided[i]:
            continue
        (up, at), (down, to) = before[i], after[i]
        if not up or not down or up == down:
            label = up or down or ("good" if marked or b.label == "near" else "bad")
        elif b.label == "near":
            label = "good"
        elif b.heading:
            label = down
        else:
            label = up if i - at <= to - i else down
        b.label = label


def main_text(html: str | None) -> str:
    """The good blocks of a page, one a line; empty if there are none or ``html`` is null."""
    if not html:
        return ""
    blocks = blocks_of(html)
    classify(blocks)
    return "\n".join(b.text for b in blocks if b.label == "good")


def extract(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """``keys`` with ``text, n_chars`` for every page; whole pages, row by row, no shuffle.

    Null and empty pages, and pages without main text, have an empty text.  Broken or cut-off markup is read as far as
    it goes.  Repeated rows are read one by one; other columns are ignored.
    """
    n = len(keys)

    def step(batch: pa.RecordBatch) -> dict:
        texts = [main_text(h) for h in batch.column(n).to_pylist()]
        return {k: batch.column(i) for i, k in enumerate(keys)} | {"text": texts, "n_chars": [len(t) for t in texts]}

    kinds = ", ".join(f"{k} {pages.schema[k].dataType.simpleString()}" for k in keys)
    return map_batches(pages.select(*keys, F.col(html).cast("string").alias("page")), step, f"{kinds}, text string, n_chars long")

"""Main text of web pages by two-pass block rules (operator 7).

A page is read as a stream of tags and character data. Elements that hold no text for a reader (scripts,
styles, forms, ...) are skipped, block elements end a block, inline ones don't. A block knows its length,
the share of its characters inside links, its stop-word density, and its place: inside an element of
the page's frame (navigation, header, footer, aside, or a class or role that says so) or inside the
article. Inside an article names say less: its header belongs to it, a heading or paragraph is never frame by
its name, and other elements only by a name that is a frame word or has a part that an article doesn't use.

Pass one decides blocks: the frame is boilerplate, whatever it holds; link-heavy blocks are; long blocks
are text if stop words are frequent, boilerplate if they are rare, and headings, short and in-between
ones stay open. An article element decides nothing: it only shifts the limits in favour of its blocks,
and those in which stop words are rare stay open, as tables and other languages have few of them; blocks
outside of one go by the same limits as those of a page without any.
Pass two gives open blocks the label of their nearest decided neighbours: text if both sides are text,
or the nearer one is; headings look forward first. Inside an article only its own blocks outside the
frame are neighbours.

Defined cases: null and empty html give an empty text; unclosed and stray tags are tolerated, end tags
close what they match and an end tag without a match is ignored; undecided blocks without any decided
neighbour are text; rows with equal page_id are each their own, further columns are left out; an empty table
gives an empty one; time grows with a page's length, however its tags are nested; nothing is cut.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.common import batch, map_arrow

# Element names of HTML by their role.
SKIPPED = frozenset("script style noscript template head title form select button textarea input svg math iframe object embed canvas audio video dialog menu option datalist".split())
FRAME = frozenset("nav header footer aside".split())
ARTICLE = frozenset("article main".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FLOW = frozenset("p blockquote pre figure figcaption table thead tbody tr td th article main".split())

# Words in a class, id or role that name parts of a page other than its article.
FRAME_WORDS = frozenset("ad ads advert adverts advertisement advertising banner banners sponsor sponsored promo promotion nav navbar navigation menu menus breadcrumb breadcrumbs header masthead footer sidebar aside widget widgets related recommended share sharing social newsletter subscribe subscription signup login cookie cookies consent gdpr notice notices popup modal overlay comment comments respond reply replies disqus pagination pager toolbar complementary contentinfo search copyright legal disclaimer outbrain taboola".split())
# Those that an article's own parts aren't named after.
ALIEN_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation breadcrumb breadcrumbs sidebar widget widgets related recommended share sharing social newsletter subscribe subscription signup cookie cookies consent gdpr popup comment comments disqus pagination pager outbrain taboola".split())
ARTICLE_WORDS = frozenset("article main".split())

# The most frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to in a is that for it on with as was be by this are from or an at not have his her they you we but had has which were their been all will would can if when who what there "
    "der die das und ist nicht von mit den dem des ein eine zu im auf für sich auch als an es er sie wir aus bei nach wird werden oder aber wie war sind "
    "le la les de des du un une et est que qui dans pour pas sur au aux avec il elle ce par plus ne se sont ou mais son sa ses nous vous leur "
    "el los las del y en un una que por con no se para es al lo como más o pero sus le ha me si sin sobre este ya entre".split()
)

MAX_LINKS = 0.5
LONG = 140
SHORT = 50
HIGH_STOPS = 0.30
LOW_STOPS = 0.15
# The same inside an article.
ARTICLE_MAX_LINKS = 0.75
ARTICLE_LONG = 70
ARTICLE_HIGH_STOPS = 0.15
ARTICLE_LOW_STOPS = 0.05

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*\Z|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PARTS = re.compile(r"[a-z]+")
_WORD = re.compile(r"[^\W\d_]+")


class Block:
    __slots__ = ("pieces", "link", "frame", "article", "heading", "text", "label")

    def __init__(self, frame: bool, article: int, heading: bool):
        self.pieces: list[str] = []
        self.link = 0
        self.frame, self.article, self.heading = frame, article, heading
        self.text = ""
        self.label: bool | None = None


def _names(attributes: str) -> tuple[set[str], set[str], bool]:
    """Words of class, id and role, the names themselves, and whether the element is hidden."""
    words: set[str] = set()
    whole: set[str] = set()
    hidden = False
    if attributes and not attributes.isspace():
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id", "role"):
                words.update(_PARTS.findall(value))
                whole.update(value.split())
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                hidden = True
    return words, whole, hidden


def _frames(name: str, words: set[str], whole: set[str], inside: bool) -> bool:
    """Whether an element begins a part of the frame; inside: it lies in an article."""
    if not inside:
        return name in FRAME or bool(words & FRAME_WORDS)
    if name in FRAME:
        return name != "header"
    return name not in HEADINGS and name not in FLOW and ("header" not in whole and bool(whole & FRAME_WORDS) or bool(words & ALIEN_WORDS))


def blocks(page: str) -> list[Block]:
    """The blocks of a page, in order, empty ones left out."""
    found: list[Block] = []
    # (name, skips, frame, article, heading, link) of the open elements; an article is its outermost element's number
    open_: list[tuple[str, bool, bool, int, bool, bool]] = []
    depth: dict[str, int] = {}
    skips = frame = heading = link = False
    article = articles = 0
    now = Block(False, 0, False)
    at, end = 0, len(page)

    def close() -> None:
        nonlocal now
        if now.pieces:
            text = " ".join(html.unescape("".join(now.pieces)).split())
            if text:
                now.text = text
                found.append(now)
        now = Block(frame, article, heading)

    while at < end:
        m = _TAG.search(page, at)
        piece = page[at : m.start() if m else end]
        if piece and not skips:
            now.pieces.append(piece)
            if link:
                now.link += len(piece.strip())
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if depth.get(name):
                while True:
                    top = open_.pop()
                    depth[top[0]] -= 1
                    if top[0] == name:
                        break
                if open_:
                    _, skips, frame, article, heading, link = open_[-1]
                else:
                    skips = frame = heading = link = False
                    article = 0
            if name in BLOCKS:
                close()
            continue
        if name in VOID:
            if name == "hr":
                close()
            elif name in ("br", "wbr") and not skips:
                now.pieces.append(" " if name == "br" else "")
            continue
        words, whole, hidden = _names(m[3])
        inside = bool(article) or name in ARTICLE or bool(words & ARTICLE_WORDS and not words & FRAME_WORDS)
        closed = m[3].endswith("/") and name in ("svg", "math")
        if name in RAW and not closed:
            # what these hold is not markup
            over = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = over.end() if over else end
            continue
        if name in ("p", *HEADINGS) and open_ and open_[-1][0] == "p" or name == "li" and open_ and open_[-1][0] == "li":
            depth[open_.pop()[0]] -= 1
            if open_:
                _, skips, frame, article, heading, link = open_[-1]
            else:
                skips = frame = heading = link = False
                article = 0
            inside = bool(article)
        if name == "body" or name == "html":
            words = whole = set()
        skips = skips or hidden or name in SKIPPED
        frame = frame or _frames(name, words, whole, bool(article))
        if inside and not article:
            article = articles = articles + 1
        heading, link = heading or name in HEADINGS, link or name == "a"
        if name in BLOCKS:
            close()
        open_.append((name, skips, frame, article, heading, link))
        depth[name] = depth.get(name, 0) + 1
    close()
    return found


def _stops(b: Block) -> float:
    words = _WORD.findall(b.text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def _decide(b: Block, stops: float) -> bool | None:
    """Pass one: True is text, False boilerplate, None open."""
    if b.article:
        max_links, long, high, low = ARTICLE_MAX_LINKS, ARTICLE_LONG, ARTICLE_HIGH_STOPS, ARTICLE_LOW_STOPS
    else:
        max_links, long, high, low = MAX_LINKS, LONG, HIGH_STOPS, LOW_STOPS
    n = len(b.text)
    if b.frame or b.link / n > max_links:
        return False
    if b.heading or n < SHORT:
        return None
    if n >= long and stops >= low or stops >= high:
        return True
    return None if stops >= low or n < long or b.article else False


def _neighbours(found: list[Block], own: list[int], labels: list[bool | None]) -> None:
    """Pass two over the blocks at the places `own`, which are neighbours of each other."""
    before, after, last = [-1] * len(own), [-1] * len(own), -1
    for k, i in enumerate(own):
        before[k] = last
        last = k if labels[i] is not None else last
    decided, last = last >= 0, -1
    for k in range(len(own) - 1, -1, -1):
        after[k] = last
        last = k if labels[own[k]] is not None else last
    for k, i in enumerate(own):
        label = labels[i]
        if label is None:
            p, n = before[k], after[k]
            if not decided:
                label = True
            elif found[i].heading and n >= 0:
                label = labels[own[n]]
            elif p < 0 or n < 0:
                label = labels[own[max(p, n)]]
            elif labels[own[p]] == labels[own[n]]:
                label = labels[own[p]]
            else:
                label = labels[own[p if k - p <= n - k else n]]
        found[i].label = label


def main_text(page: str | None) -> str:
    """The main text's blocks, joined by an empty line."""
    found = blocks(page or "")
    labels = [_decide(b, _stops(b)) for b in found]
    _neighbours(found, [i for i, b in enumerate(found) if not b.article or b.frame], labels)
    inside: dict[int, list[int]] = {}
    for i, b in enumerate(found):
        if b.article and not b.frame:
            inside.setdefault(b.article, []).append(i)
    for own in inside.values():
        _neighbours(found, own, labels)
    return "\n\n".join(b.text for b in found if b.label)


def _run(b: pa.RecordBatch):
    texts = [main_text(x) for x in b.column(2).to_pylist()]
    yield batch(page_id=b.column(0).cast(pa.int64()), url=b.column(1).cast(pa.string()), text=pa.array(texts, pa.string()), n_chars=pa.array([len(t) for t in texts], pa.int64()))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    return map_arrow(pages.select("page_id", "url", "html"), _run, "page_id long, url string, text string, n_chars long")

"""Main text of raw HTML by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides blocks by stop-word
density, length and link density. Containers shift these thresholds: inside an article that
carries the page, short blocks and few stop words are enough; beside one, only long and dense blocks
are text. What stands in menus, footers, forms, adverts, comments and the like is what extraction
leaves out, and is bad. All blocks that the thresholds leave open take, in the second pass, the label of the
nearest decided blocks, first of those of their own section. One linear scan for each page; nothing is parsed twice.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloft.llm.common import slices

#: Bytes of HTML that one batch of work holds.
BATCH_BYTES = 4 << 20

# Element names, class words and frequent words.
RAW = frozenset("script style noscript template textarea title iframe svg math object video audio canvas select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
BOILER_TAGS = frozenset("nav header footer aside form button menu dialog head fieldset".split())
MAIN_TAGS = frozenset("article main".split())
BOILER_WORDS = frozenset("ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay sidebar aside menu nav navbar navigation breadcrumb breadcrumbs pagination pager header masthead footer foot copyright legal share sharing social related recommended newsletter subscribe signup login comment comments reply replies disqus widget toolbar".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you were their all we can her has there been if more when will would who so no "
    "de la le et les des en un une du que est pour qui dans par sur pas plus au avec il ne se ce sont mais ou son elle "
    "el los las y del se por con una su para es al lo como más o pero sus este sí entre cuando muy sin sobre "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über".split()
)

#: Parts of class names that go with any of BOILER_WORDS: "site-header", "share-buttons"; other parts ("comment-enabled") make it another word.
NEUTRAL = frozenset("site page main top bottom left right bar bars box boxes list lists link links wrapper wrap container content area section block blocks inner outer item items button buttons unit slot primary secondary global mobile desktop fixed sticky form panel group row col column text icon icons".split())
#: Elements that make a section: blocks of one section are nearer to one another than to any other.
SECTIONS = frozenset("html body div section article main nav header footer aside form center".split())
#: Elements that end where the next block of the kind in the value begins.
CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"])}

#: Blocks under SHORT characters are open. DENSE stop words make a block text, under SPARSE it is none (in a language of the list; else length and links decide alone).
SHORT, DENSE, SPARSE = 70, 0.15, 0.05
#: The same inside a container of the main text, and least length and density beside one that carries the page.
MAIN_SHORT, MAIN_DENSE = 25, 0.05
LONG, OUTER_DENSE = 200, 0.30
LINKS = 0.33
#: So many link blocks on end are a menu wherever they stand.
MENU = 3

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|math|object|video|audio|canvas|select)(?=[\s/>]).*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<name2>[a-z][^\s/>]*)(?P<attrs2>[^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_LABEL = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORDS = re.compile(r"[^\W_]+")


class Block:
    __slots__ = ("text", "links", "boiler", "main", "heading", "section", "label", "_stops")

    def __init__(self, text: str, links: int, boiler: bool, main: bool, heading: str, section: int):
        self.text, self.links, self.boiler, self.main, self.heading, self.section, self.label = text, links, boiler, main, heading, section, ""
        self._stops = -1.0

    @property
    def stops(self) -> float:
        """The share of its words that are stop words, counted when first asked for."""
        if self._stops < 0:
            self._stops = _stop_density(self.text)
        return self._stops


def _is_boiler(token: str) -> bool:
    """Whether a class or id is one of BOILER_WORDS, or is made of them and NEUTRAL parts."""
    parts = [w.lower() for w in _WORDS.findall(token)]
    return any(w in BOILER_WORDS for w in parts) and all(w in BOILER_WORDS or w in NEUTRAL for w in parts)


def _container(name: str, attrs: str) -> tuple[bool, bool]:
    """Whether an element holds what is not text, and whether it holds the main text."""
    boiler, main = name in BOILER_TAGS, name in MAIN_TAGS
    if attrs and not boiler and name not in ("html", "body", "main"):
        for kind, *value in _LABEL.findall(attrs):
            tokens = html.unescape("".join(value)).split()
            if kind.lower() == "role":
                roles = {t.lower() for t in tokens}
                boiler, main = boiler or bool(roles & BOILER_ROLES), main or "main" in roles
            else:
                boiler = boiler or any(map(_is_boiler, tokens))
    return boiler, main and not boiler


def blocks(page: str) -> list[Block]:
    """The blocks of a page with text, in order; unclosed elements end with their parent or the next of their kind, a cut tag at the end is dropped."""
    out: list[Block] = []
    open_: list[tuple[str, bool, bool]] = []
    sections = [0]
    boiler = main = number = 0
    parts: list[str] = []
    in_link: list[str] = []
    anchors, heading, breaks, at = 0, "", 0, 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, len(" ".join(html.unescape("".join(in_link)).split())), boiler > 0, main > 0, heading, sections[-1]))
        parts.clear()
        in_link.clear()

    def leave(k: int) -> None:
        nonlocal boiler, main
        for name, b, mn in open_[k:]:
            boiler -= b
            main -= mn
            if name in SECTIONS:
                sections.pop()
        del open_[k:]

    for m in _TAG.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if anchors:
                in_link.append(piece)
            if not piece.isspace():
                breaks = 0
        at = m.end()
        name = m["name"] or m["name2"]
        if name is None:
            continue
        name, end = name.lower(), m["end"] or m["end2"]
        if name == "br":
            breaks += 1
            if breaks > 1:
                flush()
            parts.append(" ")
            continue
        inline = name in INLINE
        if not inline:
            flush()
            breaks = 0
            heading = name if not end and len(name) == 2 and name[0] == "h" and name[1].isdigit() else ""
        if name == "a":
            anchors = max(0, anchors + (-1 if end else 1))
        if name in VOID:
            continue
        if not end:
            if inline:
                continue
            while open_ and open_[-1][0] in CLOSES.get(name, ("p",)):
                leave(len(open_) - 1)
            b, mn = _container(name, m["attrs"] or m["attrs2"] or "")
            open_.append((name, b, mn))
            boiler += b
            main += mn
            if name in SECTIONS:
                number += 1
                sections.append(number)
        elif not inline:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == name:
                    leave(k)
                    anchors = 0
                    break
    if at < len(page):
        parts.append(page[at:])
        if anchors:
            in_link.append(page[at:])
    flush()
    return out


def carries(found: list[Block]) -> bool:
    """Whether the blocks in containers of the main text carry the page: a first-level heading is among them, or at least half of all that may be text."""
    own = [b for b in found if b.main and not b.boiler]
    if any(b.heading == "h1" for b in own):
        return True
    rest = sum(len(b.text) for b in found if not b.main and not b.boiler and b.links <= LINKS * len(b.text))
    return sum(len(b.text) for b in own) >= max(1, rest)


def known_language(found: list[Block]) -> bool:
    """Whether the stop words are those of the page: a tenth at least of its longer text without links has them."""
    longer = [b for b in found if not b.boiler and not b.links and len(b.text) >= SHORT]
    return sum(len(b.text) for b in longer if b.stops >= SPARSE) >= 0.1 * sum(len(b.text) for b in longer)


def first_pass(found: list[Block]) -> None:
    """Labels each block good or bad, or leaves it open: near (almost good), short, or linked (a link in the main text)."""
    carried = carries(found)
    dense, sparse = (DENSE, SPARSE) if carried or known_language(found) else (0.0, 0.0)  # not asked where a container carries the page
    for b in found:
        n, inside = len(b.text), b.main and carried
        if b.boiler:
            b.label = "bad"
        elif b.links > LINKS * n:
            b.label = "linked" if inside else "bad"
        elif inside:
            b.label = "short" if n < MAIN_SHORT else "good" if b.stops >= MAIN_DENSE else "near"
        elif carried:
            b.label = "good" if n >= LONG and not b.links and b.stops >= OUTER_DENSE else "bad"
        elif n < SHORT:
            b.label = "bad" if b.links else "short"
        else:
            b.label = "good" if b.stops >= dense else "near" if b.stops >= sparse else "bad"
    start = 0
    for k, b in enumerate([*found, None]):
        if b is None or b.label != "linked" or b.section != found[start].section:
            if k - start >= MENU:
                for x in found[start:k]:
                    x.label = "bad" if x.label == "linked" else x.label
            start = k if b is not None and b.label == "linked" else k + 1


def _stop_density(text: str) -> float:
    words = _WORDS.findall(text.lower())
    return sum(map(STOP_WORDS.__contains__, words)) / max(1, len(words))


def _decided(found: list[Block], by_section: bool) -> tuple[list[int], list[int]]:
    """The positions of the decided blocks before and after each block (-1 where there is none), of the same section only or of all; before a heading none is looked for."""
    sides = []
    for order in (range(len(found)), range(len(found) - 1, -1, -1)):
        last, side = {}, [-1] * len(found)
        for k in order:
            b = found[k]
            key = b.section if by_section else 0
            if order.step == 1 and b.heading:
                last.pop(key, None)
            side[k] = last.get(key, -1)
            if b.label in ("good", "bad"):
                last[key] = k
        sides.append(side)
    return sides[0], sides[1]


def second_pass(found: list[Block]) -> list[bool]:
    """Whether each block is text: open ones take the label of the nearest decided block, a heading that of the one after it.

    Decided blocks of the same section come first, then those of the page; what stands before the last
    heading does not count, unless nothing else does. At equal distance, or with one side only, a near or linked block is text if
    either neighbour is; a short one only if both are, or the only one. Open blocks of a
    container of the main text without any decided one are text. On a page without a good block, the open
    blocks of the section with most open text are.
    """
    if not any(b.label == "good" for b in found):
        size: dict[int, int] = {}
        for b in found:
            if b.label != "bad":
                size[b.section] = size.get(b.section, 0) + len(b.text)
        most = max(size, key=size.get, default=None)
        return [b.label != "bad" and b.section == most for b in found]
    near, far = _decided(found, True), _decided(found, False)
    decided = [k for k, b in enumerate(found) if b.label in ("good", "bad")]
    out = []
    for k, b in enumerate(found):
        if b.label in ("good", "bad"):
            out.append(b.label == "good")
            continue
        before, after = near[0][k], near[1][k]
        if before < 0 and after < 0:
            if b.main and not b.boiler:
                out.append(True)
                continue
            before, after = far[0][k], far[1][k]
        if before < 0 and after < 0 and decided:  # all that is decided stands before the last heading
            before = decided[bisect_left(decided, k) - 1]
        left = found[before].label == "good" if before >= 0 else None
        right = found[after].label == "good" if after >= 0 else None
        if b.heading and right is not None:
            out.append(right)
        elif left is None or right is None or left == right:
            out.append(bool(right if left is None else left))
        elif k - before != after - k and b.label == "short":
            out.append(left if k - before < after - k else right)
        else:
            out.append(b.label != "short")
    return out


def main_text(page: str | None) -> str:
    """The main text: character references decoded, white space inside a block as one space, blocks joined by a newline."""
    found = blocks(page or "")
    first_pass(found)
    return "\n".join(b.text for b, keep in zip(found, second_pass(found)) if keep)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row.

    A null or empty page gives an empty text; rows with null ids or urls and repeated
    rows are kept; an empty table gives none; other columns are not read. Nothing of
    the text is capped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(2), BATCH_BYTES):
                texts = [main_text(t) for t in batch.column(2).slice(a, b - a).to_pylist()]
                yield pa.record_batch([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col(column).cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")

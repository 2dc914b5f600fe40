"""Main text of HTML pages by scoring a tree.

Each paragraph's points (one, one for each comma, up to three for its length) go to its parent in full and to each
further ancestor by half of what the one below got; a container's points are discounted by the share of its text in
links. The best container is kept, with those of its siblings that score a fifth of it or read like paragraphs.

Menus, headers, footers, sidebars, notices, adverts, forms, reader comments, scripts and styles are known by
element, role, class or id, and give and receive no points; a page of nothing else has no main text. Elements that
hold what a page only shows (formulas, embedded objects' own text) are text like other.

Time is linear in a page's length, whatever its nesting: open elements are found by name, and points and lengths
are summed from the leaves up, once a node.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp noembed noframes svg select annotation annotation-xml".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr object output q rp rt "
    "ruby s samp small span strike strong sub sup time tt u var wbr math menclose merror mfenced mfrac mi mmultiscripts mn mo "
    "mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul dd dt".split()
)
#: An open element of the value ends where the key begins, up to the nearest of its scope.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}

#: What is no main text: elements, roles, and words of classes and ids.
BOILER_TAGS = set("nav header footer aside form menu button dialog fieldset search".split())
BOILER_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
BOILER_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar rail menu "
    "nav navbar navigation breadcrumb breadcrumbs header masthead footer foot cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription share sharing social related recommended recommendations widget "
    "toolbar pagination pager login signup form search disqus respond replies reply copyright".split()
)
SPARED_TAGS = set("html body main article".split())
SPARED_FIRST = set("has with no without page layout is".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>""")
_LOOSE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Za-z]+|[0-9]+")


class Node:
    """An element: what stands above it is settled when it is opened, its points and lengths when the page is read."""

    __slots__ = ("tag", "parent", "boiler", "block", "in_link", "heads", "points", "text", "linked", "direct", "kept")

    def __init__(self, tag: str, parent: Node | None, boiler: bool):
        self.tag, self.parent, self.boiler = tag, parent, boiler
        self.block = parent.block if parent and tag in INLINE else self
        self.in_link = tag == "a" or parent is not None and parent.in_link
        #: A header, or headers in headers, of an article: their headings are part of it if nothing else hides them.
        self.heads = tag == "header" and parent is not None and (parent.heads if parent.boiler else parent.tag in ("article", "main"))
        self.points, self.text, self.linked, self.direct, self.kept = 0.0, 0, 0, False, False


def _is_boiler(tag: str, attributes: str) -> bool:
    if tag in BOILER_TAGS:
        return True
    if not attributes or tag in SPARED_TAGS:
        return False
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return True
    if found.get("role", "").lower() in BOILER_ROLES:
        return True
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        parts = [w.lower() for w in _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name))]
        if parts and parts[0] not in SPARED_FIRST and any(p in BOILER_WORDS or p.startswith("comment") for p in parts):
            return True
    return False


class Page:
    """Blocks of a page, each with its innermost block element and the length of its linked text."""

    def __init__(self, source: str):
        self.blocks: list[tuple[Node, str, int]] = []
        root = Node("html", None, False)
        #: All elements, parents before children; those open, and where each name is among them.
        self.nodes, self.stack, self.places = [root], [root], {}
        self.pieces, self.links = [], 0
        self._read(source)
        self._end_block()

    def _read(self, source: str) -> None:
        at, n, low = 0, len(source), None
        while at < n:
            lt = source.find("<", at)
            if lt < 0:
                lt = n
            if lt > at:
                self._text(source[at:lt])
            if lt == n:
                return
            if source.startswith("<!--", lt):
                end = source.find("-->", lt + 4)
                at = n if end < 0 else end + 3
                continue
            if source.startswith(("<!", "<?"), lt):
                end = source.find(">", lt)
                at = n if end < 0 else end + 1
                continue
            m = _TAG.match(source, lt) or _LOOSE_TAG.match(source, lt)
            if not m:
                if re.match(r"</?[A-Za-z]", source[lt : lt + 3]):
                    return  # a tag that never ends
                self._text("<")
                at = lt + 1
                continue
            at, tag = m.end(), m[2].lower()
            if m[1]:
                self._close(tag)
            elif tag in RAW:
                low = source.lower() if low is None else low
                if len(low) != n:  # lower case changed lengths
                    low = "".join(c.lower() if c < "\x80" else c for c in source)
                end = low.find(f"</{tag}", at)
                if not m[3].endswith("/"):
                    end = n if end < 0 else low.find(">", end) + 1 or n
                    at = end
            else:
                self._open(tag, m[3])

    def _text(self, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        self.pieces.append(text)
        if self.stack[-1].in_link:
            self.links += len(" ".join(text.split()))

    def _end_block(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.blocks.append((self.stack[-1].block, text, min(self.links, len(text))))
            self.pieces, self.links = [], 0

    def _pop_to(self, index: int) -> None:
        for x in self.stack[index:]:
            self.places[x.tag].pop()
        del self.stack[index:]

    def _last(self, tags: set[str]) -> int:
        """Where the innermost open element of these names stands; 0 if there is none."""
        return max((at[-1] for t in tags if (at := self.places.get(t))), default=0)

    def _open(self, tag: str, attributes: str) -> None:
        if tag == "br" or tag in VOID and tag in INLINE:
            self.pieces.append(" ")
            return
        inline = tag in INLINE
        if not inline:
            self._end_block()
        if tag in VOID or tag in ("html", "body") and self.places.get(tag):
            return
        if tag in CLOSES_P:
            self._imply({"p"}, {"button", "table", "td", "th", "body"})
        if tag in IMPLIED:
            self._imply(*IMPLIED[tag])
        parent = self.stack[-1]
        boiler = parent.boiler or _is_boiler(tag, attributes)
        if boiler and not inline:
            self._end_block()
        if not attributes.endswith("/") or tag not in ("path", "circle"):
            self.places.setdefault(tag, []).append(len(self.stack))
            self.stack.append(Node(tag, parent, boiler))
            self.nodes.append(self.stack[-1])

    def _imply(self, ends: set[str], scope: set[str]) -> None:
        while (at := self._last(ends)) > self._last(scope - ends):
            self._pop_to(at)

    def _close(self, tag: str) -> None:
        if tag not in INLINE:
            self._end_block()
        if not self.places.get(tag):
            return
        if tag not in INLINE:
            self._pop_to(self.places[tag][-1])
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                self._pop_to(i)
                return
            if self.stack[i].tag not in INLINE and (tag == "a" or self.stack[i].tag not in ("p", "li", "td", "th")):
                return


#: Text that stands right in one of these counts for it as a paragraph of its own.
CONTAINERS = set("div section article main body html td center".split())


def _score(page: Page) -> None:
    """Points, lengths and linked lengths of all nodes, from the leaves up."""
    for owner, text, linked in page.blocks:
        owner.text += len(text)
        owner.linked += linked
        if not owner.boiler:
            owner.direct = True
            receiver = owner if owner.tag in CONTAINERS else owner.parent or owner
            receiver.points += (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text))
    for x in reversed(page.nodes):
        if x.parent is not None:
            x.parent.text += x.text
            x.parent.linked += x.linked
            x.parent.points += x.points / 2


def _density(node: Node) -> float:
    return node.linked / node.text if node.text else 0.0


def _keep(page: Page) -> None:
    """Marks what is in the best container and the siblings that belong to it."""
    worth = lambda x: x.points * (1 - _density(x))
    able = [x for x in page.nodes if x.text and not x.boiler]
    if not able:
        return
    best = max(able, key=worth)
    best.kept = True
    if best.parent is not None:
        for x in able:
            if x.parent is best.parent and not x.kept:
                paragraph = x.direct and x.tag in ("p", "pre", "blockquote", *HEADINGS) and _density(x) < 0.25
                x.kept = paragraph or worth(x) >= max(1.0, 0.2 * worth(best))
    for x in page.nodes:
        x.kept = x.kept or x.parent is not None and x.parent.kept


def main_text(source: str | None) -> str:
    """Blocks of the main text, a line each; empty for a page without any."""
    if not source:
        return ""
    page = Page(source)
    _score(page)
    _keep(page)
    titled = lambda x: x.tag in HEADINGS and x.parent is not None and x.parent.heads
    return "\n".join(text for owner, text, _ in page.blocks if owner.kept and (not owner.boiler or titled(owner)))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of `pages` (page_id, url, html).

    Null and empty pages, and pages without main text, have an empty text. Repeated rows and nulls are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            arrays = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")

"""Pages as trees of block elements, and figures about every block.

A block is an element that breaks text: paragraphs, headings, lists, divisions and so on.
Elements inside a line (links, bold text) belong to the block around them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import numpy as np

# ------------------------------------------------------------- fixed values

#: Elements whose content is no text of the page.
UNSEEN = frozenset(
    "head script style noscript template iframe object svg canvas math audio video textarea select button title".split()
)
#: Elements whose content is not parsed.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp"
    " small span strike strong sub sup time tt u var".split()
)
CONTROLS = frozenset("input textarea select button option".split())
#: A start tag of these ends an open paragraph.
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr li listing main menu nav ol p pre section summary table ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Of an element on the left, the start tag ends an open one on the right, unless a list or table lies between.
ENDS_SIBLING = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "tbody": ("tr", "td", "th", "thead", "tbody"),
    "tfoot": ("tr", "td", "th", "thead", "tbody"),
}
SCOPES = frozenset("html body table ul ol dl td th".split())

#: Tags by what they are for, as features.
KINDS = {
    "heading": HEADINGS,
    "paragraph": frozenset(["p"]),
    "list": frozenset("ul ol dl menu dir".split()),
    "item": frozenset("li dd dt".split()),
    "table": frozenset("table thead tbody tfoot tr td th caption".split()),
    "quote": frozenset("blockquote pre figure figcaption address".split()),
    "group": frozenset("div section center details fieldset".split()),
}
#: Roles by tag and by words in class, id, role and label.
ROLE_TAGS = {
    "article": "content", "main": "content", "nav": "menu", "header": "header", "footer": "footer",
    "aside": "sidebar", "form": "form", "dialog": "notice", "menu": "menu",
}
ROLE_WORDS = {
    "content": "article content main post entry story body text prose page single hentry blogpost",
    "menu": "menu nav navigation navbar breadcrumb breadcrumbs crumbs pagination pager toc tabs toolbar topbar skip",
    "header": "header masthead logo branding banner hero site",
    "footer": "footer foot copyright colophon legal bottom credits",
    "sidebar": "sidebar side aside widget widgets rail complementary related recommended more popular trending tags share social follow teaser teasers",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay warning privacy toast message newsflash announcement",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted adsense dfp commercial",
    "form": "form search login signin signup subscribe newsletter subscription register contact survey poll",
    "comment": "comment comments reply replies respond disqus discussion feedback responses reviews commentlist remark remarks",
}
ROLES = tuple(ROLE_WORDS)
_ROLE_OF = {word: role for role, words in ROLE_WORDS.items() for word in words.split()}

# ------------------------------------------------------------------ parsing

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_KEY = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(\s*=\s*)?")
_VALUE = re.compile(r"[^\s>]*")
_TAG_END = re.compile(r"[\s/]*>")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SENTENCE = re.compile(r"[.,!?;:]")
_TOLD_BY = ("class", "id", "role", "aria-label", "itemprop")


@dataclass
class Page:
    """Blocks in page order. A block's children come after it.

    ``runs`` are pieces of text without a block's start or end inside: (block, text),
    white space already one space.
    """

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    roles: list[frozenset[str]] = field(default_factory=list)
    marks: list[str | None] = field(default_factory=list)
    link_chars: list[int] = field(default_factory=list)
    controls: list[int] = field(default_factory=list)
    runs: list[tuple[int, str]] = field(default_factory=list)


def roles_of(tag: str, told: str) -> frozenset[str]:
    """Roles an element's tag and attribute words speak for."""
    found = {_ROLE_OF[w] for w in map(str.lower, _WORD.findall(told)) if w in _ROLE_OF}
    if tag in ROLE_TAGS:
        found.add(ROLE_TAGS[tag])
    return frozenset(found)


def _attributes(html: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes from ``at`` and where the tag ends; -1 if the page ends inside it."""
    found: dict[str, str] = {}
    while True:
        end = _TAG_END.match(html, at)
        if end:
            return found, end.end()
        key = _KEY.match(html, at)
        if key is None:
            return found, -1
        at, value = key.end(), ""
        if key[2]:
            quote = html[at : at + 1]
            if quote in ('"', "'") and quote:
                stop = html.find(quote, at + 1)
                if stop < 0:
                    return found, -1
                value, at = html[at + 1 : stop], stop + 1
            else:
                plain = _VALUE.match(html, at)
                value, at = plain[0], plain.end()
        found.setdefault(key[1].lower(), value)


class _Builder:
    """The open blocks while a page is read."""

    def __init__(self, mark: str | None):
        self.page = Page()
        self.mark = mark
        self.open: list[int] = []
        self.pieces: list[str] = []
        self.links = 0
        self.unseen: list[str] = []
        self.start("body", {})

    def end_run(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.page.runs.append((self.open[-1], text))
            self.pieces.clear()

    def text(self, raw: str) -> None:
        if self.unseen or not raw:
            return
        text = unescape(raw) if "&" in raw else raw
        self.pieces.append(text)
        if self.links:
            self.page.link_chars[self.open[-1]] += len(text)

    def close_to(self, depth: int) -> None:
        self.end_run()
        del self.open[depth:]
        if depth < self.links:  # a link ends with the block it began in
            self.links = 0

    def close_sibling(self, tags: tuple[str, ...], beyond: frozenset[str] = SCOPES) -> None:
        """End the outermost open block of ``tags`` above the nearest scope."""
        depth = None
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.page.tag[self.open[k]]
            if tag in tags:
                depth = k
            elif tag in beyond:
                break
        if depth is not None:
            self.close_to(depth)

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        if self.open:
            if tag in ENDS_PARAGRAPH:
                self.close_sibling(("p",))
            if tag in HEADINGS and self.page.tag[self.open[-1]] in HEADINGS:
                self.close_to(len(self.open) - 1)
            if tag in ENDS_SIBLING:
                self.close_sibling(ENDS_SIBLING[tag], SCOPES - frozenset(ENDS_SIBLING[tag]))
            self.end_run()
        page = self.page
        told = " ".join(attributes[a] for a in _TOLD_BY if a in attributes) if attributes else ""
        page.tag.append(tag)
        page.parent.append(self.open[-1] if self.open else -1)
        page.depth.append(len(self.open))
        page.roles.append(roles_of(tag, told))
        page.marks.append(attributes.get(self.mark) if self.mark else None)
        page.link_chars.append(0)
        page.controls.append(0)
        self.open.append(len(page.tag) - 1)

    def end(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            here = self.page.tag[self.open[k]]
            if here == tag or (tag in HEADINGS and here in HEADINGS):
                self.close_to(k)
                return
            if here in ("table", "td", "th") and tag not in KINDS["table"]:
                return


def parse(html: str | None, mark: str | None = None) -> Page:
    """The blocks of a page and their text, whatever the markup.

    Start tags end what they must (a paragraph, a list item, a table cell), end tags
    without a start are passed over, open elements end with the page. Script, style
    and the like have no text. ``mark`` names an attribute kept with each block.
    """
    html = html or ""
    build = _Builder(mark)
    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            build.text(html[at:])
            break
        if lt > at:
            build.text(html[at:lt])
        at = lt + 1
        name = _NAME.match(html, at)
        if name:
            tag = name[0].lower()
            attributes, at = _attributes(html, name.end())
            if at < 0:
                break
            if tag in RAW:
                raw = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
                stop = raw.start() if raw else n
                build.page.controls[build.open[-1]] += tag in CONTROLS
                if tag not in UNSEEN:
                    build.text(html[at:stop])
                end = html.find(">", stop)
                at = end + 1 if end >= 0 else n
            elif tag in UNSEEN:
                build.page.controls[build.open[-1]] += tag in CONTROLS
                build.unseen.append(tag)
            elif build.unseen:
                if tag == "body":  # whatever the head left open
                    build.unseen.clear()
            elif tag in VOID:
                build.page.controls[build.open[-1]] += tag in CONTROLS
                if tag == "hr":
                    build.end_run()
                elif tag != "wbr":
                    build.pieces.append(" ")
            elif tag in INLINE:
                if tag == "a":
                    build.links = len(build.open)
            elif tag not in ("html", "body"):
                build.start(tag, attributes)
        elif html.startswith("/", at) and (name := _NAME.match(html, at + 1)):
            tag = name[0].lower()
            end = html.find(">", name.end())
            at = end + 1 if end >= 0 else n
            if build.unseen:
                if tag in build.unseen:
                    while build.unseen.pop() != tag:
                        pass
                elif tag == "head":
                    build.unseen.clear()
            elif tag == "a":
                build.links = 0
            elif tag not in INLINE and tag not in ("html", "body"):
                build.end(tag)
        elif html.startswith("!--", at):
            # An empty comment may end with the dashes it begins with.
            end = html.find("-->", at + 1)
            at = end + 3 if end >= 0 else n
        elif at < n and html[at] in "!?/":
            end = html.find(">", at)
            at = end + 1 if end >= 0 else n
        else:
            build.text("<")
    build.close_to(1)
    return build.page


# ----------------------------------------------------------------- features

SHAPE = (
    "depth", "chars", "own_chars", "link_share", "blocks", "chars_per_block", "page_share", "marks_per_char", "chars_per_run",
    "paragraphs", "items", "controls", "children", "place", "siblings", "siblings_share", "before_links", "after_links",
    "before_chars", "after_chars", "parent_links", "parent_chars_per_block",
)
FEATURES = (*SHAPE, *KINDS, *(f"is_{r}" for r in ROLES), *(f"in_{r}" for r in ROLES))


@dataclass
class Blocks:
    """All blocks of some pages, page after page; ``first`` tells where each page begins."""

    first: np.ndarray
    parent: np.ndarray
    depth: np.ndarray
    features: np.ndarray


def _levels(depth: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.searchsorted(depth[order], np.arange(1, depth.max(initial=0) + 1)))


def blocks_of(pages: list[Page]) -> Blocks:
    """Features of every block: sizes and densities of its subtree, place among siblings, roles."""
    sizes = np.array([len(p.tag) for p in pages], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    n = int(first[-1])
    page = np.repeat(np.arange(len(pages)), sizes)
    parent = np.fromiter((q for p in pages for q in p.parent), np.int64, n)
    root = parent < 0
    parent += np.where(root, 0, first[page])
    own = np.zeros((n, 4))  # characters, punctuation, runs, characters in links
    for k, p in enumerate(pages):
        for block, text in p.runs:
            own[first[k] + block, :3] += (len(text), len(_SENTENCE.findall(text)), 1)
    own[:, 3] = np.fromiter((c for p in pages for c in p.link_chars), np.float64, n)
    own[:, 3] = np.minimum(own[:, 3], own[:, 0])
    tags = [t for p in pages for t in p.tag]
    controls = np.fromiter((c for p in pages for c in p.controls), np.float64, n)
    kinds = np.zeros((n, len(KINDS)))
    kind_of = {t: k for k, group in enumerate(KINDS.values()) for t in group}
    for i, t in enumerate(tags):
        if t in kind_of:
            kinds[i, kind_of[t]] = 1
    role_number = {r: k for k, r in enumerate(ROLES)}
    is_role = np.zeros((n, len(ROLES)))
    for i, found in enumerate(r for p in pages for r in p.roles):
        for r in found:
            is_role[i, role_number[r]] = 1

    depth = np.fromiter((d for p in pages for d in p.depth), np.int64, n)
    names = list(KINDS)
    counted = [kinds[:, names.index("paragraph")], kinds[:, names.index("item")], controls, np.ones(n)]
    total = np.column_stack([own, *counted])
    in_role = np.zeros_like(is_role)
    levels = _levels(depth)
    for level in levels[:0:-1]:
        np.add.at(total, parent[level], total[level])
    for level in levels[1:]:
        in_role[level] = np.maximum(in_role[parent[level]], is_role[parent[level]])
    chars, links, count = total[:, 0], total[:, 3] / (total[:, 0] + 1), total[:, 7]
    density = chars / count

    # Siblings in order: blocks by parent, which keeps page order.
    child = np.flatnonzero(~root)
    by_parent = child[np.argsort(parent[child], kind="stable")]
    group = parent[by_parent]
    begins = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
    starts = np.flatnonzero(begins)
    lengths = np.diff(np.append(starts, len(group)))
    place, siblings = np.zeros(n), np.ones(n)
    place[by_parent] = np.arange(len(group)) - np.repeat(starts, lengths)
    siblings[by_parent] = np.repeat(lengths, lengths)
    beside = np.zeros((n, 4))
    same = ~begins[1:] if len(begins) else begins
    left, right = by_parent[:-1][same], by_parent[1:][same]
    beside[right, 0], beside[right, 2] = links[left], np.log1p(chars[left])
    beside[left, 1], beside[left, 3] = links[right], np.log1p(chars[right])
    children = np.bincount(parent[child], minlength=n)
    up = np.where(root, np.arange(n), parent)
    shape = np.column_stack(
        [
            depth,
            np.log1p(chars),
            np.log1p(own[:, 0]),
            links,
            np.log1p(count),
            np.log1p(density),
            chars / (chars[first[:-1]][page] + 1),
            total[:, 1] / (chars + 1),
            np.log1p(chars / np.maximum(total[:, 2], 1)),
            np.log1p(total[:, 4]),
            np.log1p(total[:, 5]),
            total[:, 6],
            np.log1p(children),
            place / siblings,
            np.log1p(siblings),
            chars / (chars[up] + 1),
            beside[:, 0],
            beside[:, 1],
            beside[:, 2],
            beside[:, 3],
            links[up],
            np.log1p(density[up]),
        ]
    )
    return Blocks(first, np.where(root, -1, parent), depth, np.column_stack([shape, kinds, is_role, in_role]).astype(np.float32))

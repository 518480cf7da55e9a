"""Labelled pages to learn from: the parts of a page set in layouts of many kinds.

Few pages say which of their blocks are the article, and those that do look alike. So the
text of such a page is set again with other wrappers, menus, side columns, notices, adverts,
forms and comments around and between it, and every part carries what it is in ``MARK``.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from html import escape

from flightlag.llm.dom import Page

#: Attribute that says whether a block and what is in it is main text: "1" or "0".
MARK = "data-main-text"


@dataclass(frozen=True)
class Parts:
    """Texts of a page by what they were: blocks of the article, other lines, link texts."""

    title: str
    blocks: tuple[str, ...]
    lines: tuple[str, ...]
    links: tuple[str, ...]


def silver_labels(page: Page) -> list[bool] | None:
    """Which blocks are main text by the page's own markup; None where it does not say.

    Main text is what an ``article`` or ``main`` element holds that no block with
    another role comes between.
    """
    if not {"article", "main"} & set(page.tag):
        return None
    out: list[bool] = []
    for tag, parent, roles in zip(page.tag, page.parent, page.roles):
        above = parent >= 0 and out[parent]
        other = roles - {"content", "header"}
        out.append((above or tag in ("article", "main")) and not other)
    return out


def marked_labels(page: Page) -> list[bool]:
    """Which blocks are main text by ``MARK``, inherited from the block around."""
    out: list[bool] = []
    for parent, mark in zip(page.parent, page.marks):
        out.append(mark == "1" if mark is not None else parent >= 0 and out[parent])
    return out


def parts_of(page: Page, main: list[bool]) -> Parts | None:
    blocks, lines, links, title = [], [], [], ""
    for block, text in page.runs:
        if main[block]:
            if not title and page.tag[block].startswith("h"):
                title = text
            else:
                blocks.append(text)
        elif page.tag[block] == "li":
            links.append(text)
        else:
            lines.append(text)
    if not blocks:
        return None
    return Parts(title or blocks[0][:60], tuple(blocks), tuple(lines or blocks[:1]), tuple(links or ("Home", "About")))


class _Writer:
    """Draws one layout; the same seed draws the same."""

    def __init__(self, parts: Parts, seed: int):
        self.parts = parts
        self.rnd = random.Random(seed)

    def chance(self, p: float) -> bool:
        return self.rnd.random() < p

    def line(self) -> str:
        """Some text that is not the article's, as long as a sentence or a paragraph."""
        if self.chance(0.3):
            words = self.rnd.choice(self.parts.blocks).split()
            return escape(" ".join(words[: self.rnd.randint(4, 40)]))
        return escape(self.rnd.choice(self.parts.lines))

    def link(self) -> str:
        return f'<a href="/{self.rnd.randint(1, 99)}">{escape(self.rnd.choice(self.parts.links))}</a>'

    def link_list(self, low: int = 2, high: int = 9) -> str:
        return "<ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(self.rnd.randint(low, high))) + "</ul>"

    def other(self, openings: list[str], inside: str) -> str:
        """``inside`` in one of the elements, marked as not main text."""
        opening = self.rnd.choice(openings)
        tag = opening.split()[0]
        return f'<{opening} {MARK}="0">{inside}</{tag}>'

    # ------------------------------------------------------------ around it

    def menu(self) -> str:
        bar = " | ".join(self.link() for _ in range(self.rnd.randint(2, 7)))
        inside = self.rnd.choice([self.link_list(), bar, f"<p>{bar}</p>"])
        return self.other(["nav", 'div class="menu"', 'div id="navigation"', 'nav class="navbar"', 'div class="breadcrumbs"', "div"], inside)

    def header(self) -> str:
        name = self.rnd.choice([f"<h2>{self.link()}</h2>", f'<div class="logo">{self.link()}</div>', f"<p>{self.line()}</p>"])
        menu = self.menu() if self.chance(0.5) else ""
        return self.other(["header", 'div id="header"', 'header class="site-header"', 'div class="masthead"'], name + menu)

    def footer(self) -> str:
        inside = self.rnd.choice([f"&copy; {self.line()}", f"<p>&copy; {self.line()}</p>{self.link_list()}", self.link_list()])
        return self.other(["footer", 'div id="footer"', 'footer class="site-footer"', 'div class="copyright"'], inside)

    def sidebar(self) -> str:
        teasers = "".join(f"<p>{self.line()}</p>" for _ in range(self.rnd.randint(0, 3)))
        inside = f"<h3>{self.line()[:30]}</h3>" * self.chance(0.7) + self.link_list() + teasers
        return self.other(["aside", 'div class="sidebar"', 'div id="side-column"', 'aside class="widget"', 'div class="related-posts"'], inside)

    def notice(self) -> str:
        inside = self.rnd.choice([f"<p>{self.line()}</p><button>OK</button>", self.line(), f"{self.line()} {self.link()}"])
        kinds = ['div class="cookie-banner"', 'div id="consent"', 'div class="alert"', 'div role="alert"', 'section class="notice"', "dialog"]
        return self.other(kinds, inside)

    def advert(self) -> str:
        inside = self.rnd.choice([self.line(), f"<p>{self.line()}</p>", f"{self.line()} {self.link()}"])
        return self.other(['div class="ad"', 'div class="advertisement"', 'aside class="sponsored"', 'div id="promo-box"', 'section class="ads"'], inside)

    def form(self) -> str:
        label = f"<label>{self.line()[:30]}</label><input name=q>"
        inside = self.rnd.choice([label, f"<p>{self.line()}</p>{label}<button>Go</button>", f"<h3>{self.line()[:30]}</h3>{label}"])
        return self.other(["form", 'form class="newsletter"', 'div class="search-box"', 'div id="subscribe"'], inside)

    def comments(self) -> str:
        n = self.rnd.randint(1, 5)
        kind = self.rnd.choice(['div class="comment"', 'article class="comment"', "li", "div"])
        tag = kind.split()[0]
        each = [f"<{kind}><p>{self.line()[:20]}</p><p>{self.line()}</p></{tag}>" for _ in range(n)]
        title = f"<h3>{n} comments</h3>" if self.chance(0.6) else ""
        form = self.form() if self.chance(0.3) else ""
        body = "<ol>" + "".join(each) + "</ol>" if tag == "li" else "".join(each)
        return self.other(['div class="comments"', 'section id="comments"', 'div id="disqus_thread"', 'section class="replies"'], title + body + form)

    # ------------------------------------------------------------ the article

    def block(self, text: str) -> str:
        words, safe = text.split(), escape(text)
        if len(words) <= 12 and self.chance(0.3):
            return self.rnd.choice([f"<h2>{safe}</h2>", f"<h3>{safe}</h3>"])
        kind = self.rnd.random()
        if kind < 0.05 and len(words) > 12:
            cut = [" ".join(words[i : i + 8]) for i in range(0, min(len(words), 48), 8)]
            return "<ul>" + "".join(f"<li>{escape(c)}</li>" for c in cut) + "</ul>"
        if kind < 0.09:
            return f"<blockquote><p>{safe}</p></blockquote>"
        if kind < 0.12:
            return f"<div><p>{safe}</p></div>"
        if kind < 0.15:
            return f"<p><b>{safe}<br>"
        if kind < 0.18:
            return f"<p>{safe} {self.link()}</p>"
        if kind < 0.20:
            return f"<figure><img src=x><figcaption>{safe}</figcaption></figure>"
        if kind < 0.22:
            return f"<pre>{safe}</pre>"
        if kind < 0.25:
            return f"<div>{safe}</div>"
        return f"<p>{safe}</p>"

    def article(self) -> str:
        chosen = list(self.parts.blocks)
        if len(chosen) > 3 and self.chance(0.5):
            start = self.rnd.randrange(len(chosen))
            chosen = chosen[start : start + self.rnd.randint(1, 12)]
        title = f"<h1>{escape(self.parts.title)}</h1>"
        if self.chance(0.2):
            title = f"<header>{title}</header>"
        pieces = [title if self.chance(0.9) else ""]
        for text in chosen:
            pieces.append(self.block(text))
            if self.chance(0.06):
                pieces.append(self.rnd.choice([self.advert, self.form, self.sidebar, self.notice])())
        if self.chance(0.15):
            pieces.append(self.comments())
        kinds = [
            "article", "article", "article", "main", 'div class="post-content"', 'div id="content"', 'section class="entry"',
            'div class="story-body"', 'div role="main"', "div", "section", 'div class="text"',
        ]
        opening = self.rnd.choice(kinds)
        return f'<{opening} {MARK}="1">' + "".join(pieces) + f"</{opening.split()[0]}>"

    def wrapped(self, inside: str) -> str:
        for _ in range(self.rnd.choice([0, 0, 0, 1, 1, 2])):
            opening = self.rnd.choice(['div class="container"', 'div id="wrapper"', "div", 'div class="row"', 'div class="page"'])
            inside = f"<{opening}>{inside}</div>"
        return inside

    def page(self) -> str:
        before = [self.header] * self.chance(0.4) + [self.menu] * self.chance(0.7)
        before += [f for f in (self.notice, self.advert, self.form, self.sidebar) if self.chance(0.25)]
        after = [f for f in (self.comments, self.advert, self.sidebar, self.form, self.notice) if self.chance(0.25)]
        self.rnd.shuffle(after)
        body = "".join(f() for f in before) + self.wrapped(self.article()) + "".join(f() for f in after)
        return "<html><body>" + self.wrapped(body) + (self.footer() if self.chance(0.8) else "") + "</body></html>"


def layout(parts: Parts, seed: int) -> str:
    """A page of these parts in a layout drawn by ``seed``, with ``MARK`` on its blocks."""
    return _Writer(parts, seed).page()

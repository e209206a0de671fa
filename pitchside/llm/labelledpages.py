"""Labelled pages for the content model: templates in which every part is known to be article or not.

Pages are written by rule from a seed, so training is the same everywhere; nothing of the tables
that are extracted later is used.
"""

from __future__ import annotations

import random

#: Names that sites give to the parts of a page.
CONTENT_NAMES = ["content", "post", "entry", "article", "story", "body", "text", "main", "maincontent", "articlebody"]
OTHER_NAMES = {
    "nav": ["nav", "menu", "navbar", "navigation", "topnav", "breadcrumb", "breadcrumbs", "tabs"],
    "header": ["header", "masthead", "topbar", "banner", "branding", "logo"],
    "footer": ["footer", "bottom", "copyright", "legal", "colophon", "sitemap"],
    "aside": ["sidebar", "aside", "related", "widget", "recommended", "trending", "popular", "more", "tags"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "sponsor", "adsense"],
    "notice": ["cookie", "consent", "notice", "gdpr", "popup", "modal", "overlay", "subscribe", "newsletter", "alert", "paywall", "cookies"],
    "form": ["form", "search", "login", "signup", "searchform"],
    "comments": ["comments", "comment", "responses", "discussion", "disqus", "replies", "reply", "respond"],
    "share": ["share", "social", "sharing", "follow", "sharebar", "buttons"],
}
TAGS = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div", "section"], "ad": ["div", "aside", "section"], "notice": ["div", "section", "dialog"], "form": ["form", "div"], "comments": ["section", "div", "ol"], "share": ["div", "ul"]}


class Writer:
    """Writes a page; text nodes carry their label as an attribute of the element that holds them."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        return " ".join("".join(self.r.choice("abcdefghilmnoprstu") for _ in range(self.r.randint(1, 9))) for _ in range(self.r.randint(low, high)))

    def sentences(self, n: int) -> str:
        return " ".join(self.words(5, 18).capitalize() + self.r.choice(".....!?") for _ in range(n))

    def links(self, n: int, listed: bool) -> str:
        found = [f'<a href="/{i}">{self.words(1, 3)}</a>' for i in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in found) + "</ul>" if listed else " | ".join(found)

    def element(self, tag: str, names: list[str], label: int, inside: str) -> str:
        attrs = f' {self.r.choice(["class", "class", "id"])}="{self.r.choice(names)}"' if names else ""
        return f'<{tag}{attrs} data-label="{label}">{inside}</{tag}>'

    def other(self, kind: str) -> str:
        r = self.r
        if kind in ("nav", "share"):
            inside = self.links(r.randint(2, 9), r.random() < 0.7)
        elif kind == "header":
            inside = r.choice([self.words(1, 4), f"<h1>{self.words(1, 4)}</h1><p>{self.words(2, 8)}</p>", self.links(3, False)])
        elif kind == "footer":
            inside = f"&copy; {self.words(1, 5)}. " + r.choice(["", self.links(r.randint(1, 6), r.random() < 0.5), f"<p>{self.sentences(1)}</p>"])
        elif kind == "aside":
            inside = f"<h3>{self.words(1, 3)}</h3>" + r.choice([self.links(r.randint(2, 8), True), f"<p>{self.sentences(r.randint(1, 2))}</p>"])
        elif kind == "ad":
            inside = r.choice([self.sentences(1), f"<p>{self.sentences(1)}</p>", self.links(1, False)])
        elif kind == "notice":
            inside = f"<p>{self.sentences(r.randint(1, 2))}</p><button>{self.words(1, 2)}</button>"
        elif kind == "form":
            inside = f"<label>{self.words(1, 3)}</label><input name=q><button>{self.words(1, 1)}</button>" + r.choice(["", f"<p>{self.words(2, 9)}</p>"])
        else:
            inside = f"<h3>{self.words(1, 3)}</h3>" + "".join(f'<div class="comment"><p>{self.sentences(r.randint(1, 4))}</p></div>' for _ in range(r.randint(1, 4)))
        tag = r.choice(TAGS[kind])
        if tag in ("ul", "ol"):
            inside = f"<li>{inside}</li>" if kind != "nav" else "".join(f'<li><a href="/x">{self.words(1, 2)}</a></li>' for _ in range(r.randint(2, 8)))
        named = tag == "div" or r.random() < 0.5
        return self.element(tag, OTHER_NAMES[kind] if named else [], 0, inside)

    def article(self) -> str:
        r = self.r
        parts = [f"<h1>{self.words(3, 10)}</h1>"] if r.random() < 0.8 else []
        if r.random() < 0.3:
            parts.append(f"<p>{self.words(2, 5)}</p>")
        for _ in range(r.randint(1, 9)):
            kind = r.random()
            if kind < 0.72:
                text = self.sentences(r.randint(1, 6)) if r.random() < 0.9 else self.words(1, 4) + "."
                if r.random() < 0.2:
                    text += f' <a href="/y">{self.words(1, 3)}</a> {self.words(2, 9)}.'
                parts.append(f"<p>{text}</p>")
            elif kind < 0.82:
                parts.append(f"<h2>{self.words(2, 6)}</h2>")
            elif kind < 0.9:
                parts.append("<ul>" + "".join(f"<li>{self.words(3, 12)}.</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.95:
                parts.append(f"<blockquote><p>{self.sentences(1)}</p></blockquote>")
            else:
                parts.append(f"<pre>{self.words(3, 12)}</pre>" if r.random() < 0.5 else f"<table><tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr></table>")
        if r.random() < 0.25:
            parts.insert(r.randint(1, len(parts)), self.other(r.choice(["ad", "share", "aside"])))
        tag = r.choice(["article", "article", "main", "div", "section"])
        return self.element(tag, CONTENT_NAMES if tag in ("div", "section") or r.random() < 0.4 else [], 1, "".join(parts))

    def loose(self) -> str:
        """An article whose text stands directly in the body, between line breaks, paragraphs or headings, with short notes before or after."""
        r = self.r
        parts = []
        for _ in range(r.randint(1, 6)):
            text = self.sentences(r.randint(2, 7))
            parts.append(text if r.random() < 0.6 else f'<p data-label="1">{text}</p>' if r.random() < 0.8 else f'<h2 data-label="1">{self.words(2, 6)}</h2>')
        note = lambda: "<!--label 0-->" + r.choice([self.words(1, 5), self.links(r.randint(2, 5), False), f"&copy; {self.words(1, 4)}"]) + "<hr>" if r.random() < 0.4 else ""
        return note() + "<!--label 1-->" + r.choice(["<br><br>", "\n", "<br>"]).join(parts) + "<hr>" + note() + "<!--label 0-->"

    def page(self) -> str:
        r = self.r
        before = [self.other(k) for k in ("notice", "header", "nav", "form", "ad") if r.random() < (0.75 if k == "nav" else 0.4)]
        after = [self.other(k) for k in ("comments", "aside", "ad", "share", "footer", "notice") if r.random() < (0.75 if k == "footer" else 0.35)]
        body = self.article()
        if r.random() < 0.06:  # an article without an element of its own
            body = "".join(f'<{t} data-label="1">{x}</{t}>' for t, x in [("h1", self.words(2, 8)), *(("p", self.sentences(r.randint(2, 6))) for _ in range(r.randint(2, 8)))])
        elif r.random() < 0.1:
            body = self.loose()
        if r.random() < 0.4:
            side = self.other("aside")
            body = self.element("div", ["wrapper", "container", "page", "row", "layout"], 0, r.choice([body + side, side + body]))
        return "<html><head><title>t</title></head><body data-label=\"0\">" + "".join(before) + body + "".join(after) + "</body></html>"


def labelled_pages(n: int = 600, seed: int = 20240) -> list[str]:
    """Pages whose data-label attributes give the label of each element and all below it, up to the next such attribute."""
    return [Writer(seed + i).page() for i in range(n)]

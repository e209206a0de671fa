"""Block elements of an HTML page as a tree; each run of text between block tags is a leaf of it.

Open elements are also listed by tag, so that every tag and its implied ends take constant time, however deep the page.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

MATHML = frozenset("math annotation annotation-xml maction menclose merror mfenced mfrac mi mlabeledtr mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
#: Other notations of a formula, which the page does not show beside it.
NOTES = frozenset(("annotation", "annotation-xml"))
INLINE = MATHML | frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose character data is no text of the page.
SILENT = frozenset("script style noscript template svg iframe title head".split())
#: A start tag of these ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: A start tag of the key ends an open element of these, up to the nearest of the others.
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}


#: Words of a class or id, also in camelCase.
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    """An element, or with the tag #text a block of text: its pieces, and how many characters of them are inside links."""

    __slots__ = ("tag", "names", "parent", "silent", "pieces", "linked")

    def __init__(self, tag: str, names: tuple[str, ...], parent: int, silent: bool):
        self.tag, self.names, self.parent, self.silent = tag, names, parent, silent
        self.pieces: list[str] = []
        self.linked = 0

    def text(self) -> str:
        """White space is one space, none at the ends."""
        return " ".join("".join(self.pieces).split())


def attribute_words(attrs: list[tuple[str, str | None]]) -> tuple[str, ...]:
    """Lower-case words of class, id and role."""
    found = []
    for name, value in attrs:
        if name in ("class", "id", "role", "itemprop") and value:
            found += [w.lower() for w in WORD.findall(value)]
    return tuple(found)


class Tree(HTMLParser):
    """nodes[0] is the page; parents come before their children, blocks of text in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("#page", (), -1, False)]
        self.open: list[tuple[str, int]] = [("#page", 0)]  # inline elements stand for their block's node
        self.places: dict[str, list[int]] = {}  # where in `open` the elements of a tag are
        self.blocks = [0]  # where in `open` block elements are
        self.links = self.notes = 0
        self.leaf: Node | None = None  # the block of text that goes on

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i, report)

    def unknown_decl(self, data):
        pass

    def _push(self, tag: str, node: int) -> None:
        self.places.setdefault(tag, []).append(len(self.open))
        if tag not in INLINE:
            self.blocks.append(len(self.open))
        self.open.append((tag, node))
        self.links += tag == "a"
        self.notes += tag in NOTES

    def _close(self, at: int) -> None:
        for tag, _ in self.open[at:]:
            self.places[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()
            self.links -= tag == "a"
            self.notes -= tag in NOTES
        del self.open[at:]

    def _last(self, tags: tuple[str, ...]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def _close_to(self, tags: tuple[str, ...], walls: tuple[str, ...]) -> None:
        at = self._last(tags)
        if at > self._last(walls):
            self._close(at)

    def _append(self, node: Node) -> int:
        self.nodes.append(node)
        return len(self.nodes) - 1

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._close_to(("p",), ("button", "table", "td", "th"))
        if tag in ENDS:
            self._close_to(*ENDS[tag])
        if tag == "body":
            self._close_to(("head",), ())
        node = self.open[-1][1]
        if tag not in INLINE:
            self.leaf = None
            if tag not in VOID:
                self._push(tag, self._append(Node(tag, attribute_words(attrs), node, self.nodes[node].silent or tag in SILENT)))
            return
        if tag in VOID:
            if tag == "br":
                self._add(" ")
            return
        self._push(tag, node)
        if tag in ("mtr", "mtd"):
            self._add(" ")  # cells of a matrix

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1][0] == tag and tag in INLINE:
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag):
        at = self._last((tag,))
        if not at or tag in VOID or (tag in INLINE and at < self.blocks[-1]):
            return  # a stray inline end tag closes no block
        if tag not in INLINE:
            self.leaf = None
        self._close(at)

    def _add(self, data: str) -> None:
        if self.leaf is not None:
            self.leaf.pieces.append(data)

    def handle_data(self, data):
        node = self.open[-1][1]
        if self.nodes[node].silent or self.notes:
            return
        shown = len(data.strip())
        if self.leaf is None and shown:
            self.leaf = Node("#text", (), node, False)
            self._append(self.leaf)
        self._add(data)
        if self.links > 0 and self.leaf is not None:
            self.leaf.linked += shown


def parse(html: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Nodes, and the page's blocks of text: (node, text) in page order."""
    tree = Tree()
    tree.feed(html)
    tree.close()
    return tree.nodes, [(i, n.text()) for i, n in enumerate(tree.nodes) if n.tag == "#text"]

"""HTML extraction by a tree-structured graphical model over the DOM.

Every block element and, below it, every block of text has a hidden label, article or not. Its
features (tag, words of class, id and role, share of links; for text its amount, share of links and
punctuation) give evidence as log-likelihood ratios; a potential, one for each kind of node, couples
each label to the parent's. Sum-product messages upward and then downward give every node's marginal,
and the blocks of text with a marginal over one half are the article, wherever they stand, also
directly in the body. Features and potentials are counted on labelled pages.

Evidence and potentials are those of a directed tree: P(label of the page) times the product of
P(child | parent) and of P(feature | label).

Defined cases: null and empty html give an empty text, as do pages without article text. Repeated
rows give the same row each. Null ids and urls are kept. An empty table gives an empty result. Other
columns are ignored. Scripts, styles and other silent elements never hold text.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchside.llm.common import texts
from pitchside.llm.dom import Node, Tree, parse
from pitchside.llm.labelledpages import labelled_pages

#: Elements of running text, which follow their parent more closely than sections do.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th figure figcaption".split())


def kind(nodes: list[Node], i: int) -> str:
    """Which potential couples a node to its parent."""
    n = nodes[i]
    loose = "loose " if nodes[n.parent].tag in ("#page", "html", "body") else ""
    return f"{loose}text" if n.tag == "#text" else f"{loose}flow" if n.tag in FLOW else "section"


KINDS = ("flow", "section", "text", "loose flow", "loose text")


def features(nodes: list[Node]) -> list[list[str]]:
    """The features of each node, the most telling first, then what stands for it where that was never seen. Link shares are of the whole element."""
    texts = [n.text() if n.tag == "#text" else "" for n in nodes]
    total, linked = list(map(len, texts)), [n.linked for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        total[nodes[i].parent] += total[i]
        linked[nodes[i].parent] += linked[i]
    out = []
    for i, n in enumerate(nodes):
        share = linked[i] / total[i] if total[i] else 0
        links = "none" if share == 0 else "few" if share < 0.3 else "half" if share < 0.7 else "all"
        if n.tag == "#text":
            size = "1" if total[i] < 12 else "2" if total[i] < 40 else "3" if total[i] < 120 else "4" if total[i] < 400 else "5"
            shape = f"{links} {size} {'stop' if texts[i][-1] in '.!?…' else 'open'}"
            out.append([f"text {nodes[n.parent].tag} {shape}", f"text {shape}"])  # one joint feature, as its parts depend on each other
        else:
            out.append([f"tag {n.tag} {links}", f"any {n.tag}", *(f"name {x}" for x in n.names)])
    return out


class LabelledTree(Tree):
    """A tree whose nodes have the labels of labelled pages; a comment with a label is for the text after it in the same element."""

    def __init__(self):
        super().__init__()
        self.labels = [0]
        self.given: str | None = None
        self.of_text: dict[int, int] = {}

    def _append(self, node):
        label = self.of_text.get(node.parent) if node.tag == "#text" else self.given
        self.labels.append(self.labels[node.parent] if label is None else int(label))
        return super()._append(node)

    def handle_comment(self, data):
        if data.startswith("label "):
            self.of_text[self.open[-1][1]] = int(data[6:])

    def handle_starttag(self, tag, attrs):
        self.given = dict(attrs).get("data-label")
        super().handle_starttag(tag, attrs)


class ContentModel:
    """Counted potentials, and inference with them."""

    def __init__(self, pages: list[str], smooth: float = 0.5):
        seen: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
        classes, steps = [smooth, smooth], {k: [[smooth, smooth], [smooth, smooth]] for k in KINDS}
        for page in pages:
            tree = LabelledTree()
            tree.feed(page)
            tree.close()
            for i, (node, label, found) in enumerate(zip(tree.nodes, tree.labels, features(tree.nodes))):
                classes[label] += 1
                if i:
                    steps[kind(tree.nodes, i)][tree.labels[node.parent]][label] += 1
                for f in found:
                    seen[f][label] += 1
        self.ratio = {f: math.log((one + smooth) / classes[1]) - math.log((zero + smooth) / classes[0]) for f, (zero, one) in seen.items()}
        self.step = {k: [[math.log(x / sum(row)) for x in row] for row in table] for k, table in steps.items()}

    def evidence(self, found: list[str]) -> float:
        """Log-likelihood ratio of a node's features; the second alone where the first was never seen."""
        shape, tag, *names = found
        return self.ratio.get(shape, self.ratio.get(tag, 0.0)) + sum(self.ratio.get(f, 0.0) for f in names)

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(article) of each node, by messages from the leaves to the page and back."""
        n = len(nodes)
        up = [[0.0, 0.0] for _ in range(n)]  # evidence at and below a node, by its label
        for i, found in enumerate(features(nodes)):
            up[i][1] += self.evidence(found)
        message = [(0.0, 0.0)] * n
        steps = [self.step[kind(nodes, i)] if i else None for i in range(n)]
        for i in range(n - 1, 0, -1):
            a, b = up[i]
            (s00, s01), (s10, s11) = steps[i]
            message[i] = (_add(s00 + a, s01 + b), _add(s10 + a, s11 + b))
            parent = up[nodes[i].parent]
            parent[0] += message[i][0]
            parent[1] += message[i][1]
        up[0][1] -= 1e9  # the page as a whole is not the article; its blocks of text have labels of their own
        down = [(0.0, 0.0)] * n
        out = [0.0] * n
        for i in range(1, n):
            p = nodes[i].parent
            (s00, s01), (s10, s11) = steps[i]
            # the parent's belief without what this child told it
            a = up[p][0] + down[p][0] - message[i][0]
            b = up[p][1] + down[p][1] - message[i][1]
            down[i] = (_add(s00 + a, s10 + b), _add(s01 + a, s11 + b))
            zero, one = up[i][0] + down[i][0], up[i][1] + down[i][1]
            out[i] = 1 / (1 + math.exp(min(700.0, zero - one)))
        return out

    def extract(self, html: str) -> str:
        nodes, blocks = parse(html)
        share = self.marginals(nodes)
        return "\n\n".join(t for n, t in blocks if share[n] > 0.5)


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


@cache
def default_model() -> ContentModel:
    """Trained once, on 600 labelled pages."""
    return ContentModel(labelled_pages())


def main_text(pages: DataFrame, model: ContentModel | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages. The model is fitted once, on the driver, and broadcast: a few hundred ratios."""
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [m.extract(h) for h in texts(batch, "html")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")

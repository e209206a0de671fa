import random

import pytest

#: Texts for every operator: nulls, empty, blank, ties, repeated rows, long ones, other scripts.
EDGE = [(None, "no id here and some words"), (1, None), (2, ""), (3, " \t\n "), (4, "word"), (5, "ÄÖ Straße\n\nİstanbul ǅ"), (6, "a\x1cb \x85 x　y"), (7, "dup line\ndup line\n"), (8, "same"), (8, "same"), (9, "w " * 30_000)]


def words(r: random.Random, n: int) -> str:
    return " ".join(r.choice("alpha Beta gamma. delta, épsilon zeta eta theta iota kappa lambda mu nu xi".split()) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): copies, near copies, shared passages and lines, and the edge cases."""
    r = random.Random(7)
    passage, line = words(r, 60), "This line of boilerplate stands in many documents, with Ä."
    rows = list(EDGE)
    for i in range(100, 190):
        text = words(r, r.randrange(1, 150))
        if i % 6 == 0:
            text = f"{words(r, 20)}\n{line if i % 12 else '  ' + line.upper().replace('Ä', 'Ä') + ' '}\n{text}"
        if i % 7 == 0:
            text += " " + passage + " " + words(r, 5)
        rows.append((i, text))
    base = words(r, 400)
    for i in range(200, 212):
        w = base.split()
        for _ in range(i % 4):
            w[r.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w)))
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """With further columns whose names clash with those of operators."""
    rows = [(i, t, "x", 5, None) for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, n_lines string, fp int, word string").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.filter("false")

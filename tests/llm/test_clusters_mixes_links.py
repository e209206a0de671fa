"""Centroid clustering, source mixing and tokenizer alignment against brute force, and their edge cases."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchside.llm import alignment, elkan, mixing
from pitchside.llm.vocabulary import default_vocabulary

# ---- centroid clustering


def slow_clusters(rows, k, rounds, size, scale=1024, seed=3):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)].append(v)
        centroids = [[sum(x) // len(groups[c]) for x in zip(*groups[c])] if groups[c] else old for c, old in enumerate(centroids)]
    return sorted(((i, c, far(v, centroids[c])) for i, v in kept for c in [nearest(v)]), key=repr), centroids


def vectors(n=300, size=5, grid=False, seed=1):
    r = random.Random(seed)
    draw = (lambda: r.choice([-1.0, 0.0, 1.0])) if grid else (lambda: float(np.float32(r.gauss(0, 1))))
    rows = [(i, [draw() for _ in range(size)]) for i in range(n)]
    return rows + [(7, rows[7][1]), (None, rows[3][1]), (900, None), (901, []), (902, [1.0] * (size - 1)), (903, [math.nan] * size), (904, [math.inf] * size), (905, [None] * size)]


@pytest.mark.parametrize("grid", [False, True])
def test_clusters_equal_plain_rounds(spark, grid):
    """On a grid of three values nearly everything ties."""
    rows = vectors(grid=grid)
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, cluster string, n int").repartition(3)
    got, centroids, inertia, asked = elkan.cluster(frame, k=8, rounds=4, size=5)
    want, slow = slow_clusters(rows, 8, 4, 5)
    assert sorted(map(tuple, got.collect()), key=repr) == want and centroids == slow
    assert sum(inertia) == sum(d for *_, d in want) and inertia == [sum(d for _, c, d in want if c == x) for x in range(8)]
    assert grid or asked[-1] < asked[0]  # bounds save distances


def test_clusters_of_huge_components(spark):
    rows = [(i, [float(np.float32(x)) for x in (1e30 * (-1) ** i, i, 2.0**40)]) for i in range(20)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got, centroids, *_ = elkan.cluster(frame, k=2, rounds=3, size=3)
    want, slow = slow_clusters(rows, 2, 3, 3)
    assert centroids == slow and sorted(map(tuple, got.collect())) == sorted((i, c, d if d < 1 << 63 else None) for i, c, d in want)


def test_clusters_of_few_equal_and_no_vectors(spark):
    same = spark.createDataFrame([(i, [0.5, 0.5]) for i in range(5)], "vec_id long, embedding array<float>")
    rows = elkan.clustered(same, k=8, size=2).collect()
    assert [(r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid) for r in rows] == [(0, 0, 0, 0, "512,512")] * 5
    assert elkan.clustered(same.filter("false"), size=2).collect() == []


def test_bounds_are_conservative():
    r = np.random.default_rng(0)
    v, c = r.integers(-2000, 2000, (200, 6)), r.integers(-2000, 2000, (4, 6))
    near = lambda a: elkan.below(np.array([elkan.root(elkan.squares(a, x)) for x in a]) / 2).astype(float)
    cluster, _, upper, lower, _ = elkan.assign(v, c, np.zeros(4), near(c), np.full(200, -1, np.int32), np.zeros(200, np.float32), np.zeros((200, 4), np.float32))
    moved = c + r.integers(-3, 4, c.shape)
    by = elkan.above(elkan.root(elkan.squares(c, moved))).astype(float)
    cluster, _, upper, lower, _ = elkan.assign(v, moved, by, near(moved), cluster, upper, lower)
    exact = np.array([[math.dist(x, y) for y in moved] for x in v])
    assert (lower <= exact).all() and (upper >= exact[np.arange(200), cluster]).all()
    assert cluster.tolist() == np.argmin([elkan.squares(v, x) for x in moved], axis=0).tolist()


@pytest.mark.parametrize("x", [0, -1, 5, -(1 << 31), (1 << 32) + 7, -(3**80)])
def test_limbs(x):
    assert elkan.value(elkan.limbs(x)) == x


# ---- mixing


def slow_targets(size, weights=(1, 2, 3), most=3):
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, total, stopped = {s: weights[i % len(weights)] for i, s in enumerate(order)}, sum(size.values()), set()
    while True:
        rest = [s for s in order if s not in stopped]
        left = total - sum(most * size[s] for s in stopped)
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = {s for s in rest if share[s] > most * size[s]}
        if not over:
            return {s: float(most * size[s]) for s in stopped} | share
        stopped |= over


@pytest.fixture(scope="module")
def mixed(spark):
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * int(r.paretovariate(0.9))), f"s{int(20 * r.random() ** 4)}") for i in range(6000)]
    rows += [(i, "tiny text", "é" if i % 2 else "z") for i in range(9000, 9010)] + [(i, "a b c", None) for i in range(9100, 9300)]
    rows += [(None, "same words here", "s0")] * 50 + [(1, None, "s1"), (2, "", "s1"), (3, " \t\n", "s1"), (5, "w " * 20_000, "s3"), (None, None, None), (8, "", "void")]
    return spark.createDataFrame([(i, t, s, 1, "x") for i, t, s in rows], "doc_id long, text string, source string, size int, part string").repartition(4), rows


def test_mix(spark, mixed):
    docs, rows = mixed
    out = mixing.mix(docs, block=300)
    got = out.collect()
    count = lambda t: len((t or "").split())
    size = Counter()
    for _, t, s in rows:
        size[s] += count(t)
    want = slow_targets(size)
    assert sorted(((r.doc_id, r.source, r["size"]) for r in got), key=repr) == sorted(((i, s, count(t)) for i, t, s in rows), key=repr)
    assert all(r.source_size == size[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 3 for r in got)
    taken, copies, many = Counter(), Counter(), Counter(s for *_, s in rows)
    for r in got:
        taken[r.source] += r["size"] * r.copies
        copies[r.source] += r.copies
    largest = {s: max(r["size"] for r in got if r.source == s) for s in size}
    for s, t in want.items():  # one very long document can only be taken or left
        assert abs(taken[s] - t) <= max(3, 0.02 * t, largest[s] / 2), (s, taken[s], t)
        assert abs(copies[s] - many[s] * (t / size[s] if size[s] else 0)) <= 4
    again = mixing.mix(docs.repartition(7), block=300)
    assert out.exceptAll(again).count() == 0 == again.exceptAll(out).count()
    assert out.exceptAll(mixing.mix(docs, block=300, small=0)).count() == 0  # sources by salted join


def test_mix_of_nothing(spark, mixed):
    docs, _ = mixed
    assert mixing.mix(docs.filter("false")).collect() == []
    blank = mixing.mix(docs.filter("source = 'void'")).collect()
    assert [(r["size"], r.target, r.copies) for r in blank] == [(0, 0.0, 0)]


def test_flight_keeps_both_totals():
    r = random.Random(5)
    for n in (1, 2, 3, 17, 400):
        size = [r.choice([1, 1, 2, 5, 5, 40, 9000]) for _ in range(n)]
        chance = [r.random() for _ in range(n)]
        out = mixing.flight(size, chance, r, 2)
        assert sum(0 < p < 1 for p in out) <= 2 and all(0 <= p <= 1 for p in out)
        assert sum(out) == pytest.approx(sum(chance)) and out @ size == pytest.approx(np.dot(size, chance))


def test_flight_keeps_chances():
    """Over many runs a document is taken as often as its chance says."""
    size, chance = [1, 2, 3, 5, 8, 13], [0.1, 0.3, 0.5, 0.5, 0.7, 0.9]
    mean = np.mean([mixing.flight(size, chance, random.Random(i), 2) for i in range(4000)], axis=0)
    assert np.abs(mean - chance).max() < 0.03


# ---- alignment

TEXTS = ["Hello, world!", "  two  blanks\n and\tmore \n", " lead", "trail ", "\n", "naïve café 北京 🏈🏈", "<|endoftext|> and </s> <0x41>", "a▁b", "tokenization untokenizable", "x" * 300, "　wide", "it's we'll 1234567 ...", "\x00\x7f", "é", "word " * 3000]


def reference_spans(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(default_vocabulary("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=default_vocabulary("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in own)}
    out = []
    for text in texts:
        both = [[], []]
        if text:
            found = [[(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]]
            pieces = [(i, b.id_to_piece(i)) for i in b.encode(text)]
            found.append([(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces])
            if all(b"".join(x for _, x in f) == (" " + text).encode() for f in found):
                for side, f in zip(both, found):
                    at = 0
                    for i, x in f:
                        side.append((i, at, at + len(x)))
                        at += len(x)
        out.append(both)
    return out


def slow_rows(ids, texts):
    rows, links = [], Counter()
    for key, (a, b) in zip(ids, reference_spans(texts)):
        own = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        links.update(own)
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups = [[[x[0] for x in side if lo < x[2] <= hi] for side in (a, b)] for lo, hi in zip([0, *cuts], cuts)]
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        rows.append((key, len(a), len(b), len(cuts), own, hashlib.sha256(text.encode()).hexdigest() if a else ""))
    best = Counter()
    for (_, y), n in links.items():
        best[y] = max(best[y], n)
    return sorted(((k, na, nb, g, len(own), sum(links[p] == best[p[1]] for p in own), sum(links[p] for p in own), h) for k, na, nb, g, own, h in rows), key=repr)


@pytest.mark.parametrize("most_broadcast", [alignment.MOST_BROADCAST, 5])
def test_alignment(spark, most_broadcast):
    texts = [*TEXTS[:-1], "word " * 300, None, "", "again", "again"]
    ids = [*range(len(texts) - 3), None, 8, 8]
    docs = spark.createDataFrame([(i, t, "x", 2) for i, t in zip(ids, texts)], "doc_id long, text string, links string, n int").repartition(3)
    out = alignment.alignment(docs, default_vocabulary("byte_bpe_50k.json"), default_vocabulary("piece_bpe_32k.model"), most_broadcast)
    assert sorted(map(tuple, out.collect()), key=repr) == slow_rows(ids, texts)
    assert alignment.alignment(docs.filter("false"), default_vocabulary("byte_bpe_50k.json"), default_vocabulary("piece_bpe_32k.model")).collect() == []


def test_units_give_the_tokens_of_whole_texts():
    """Texts of random pieces, blanks and signs: what is put together from units equals what whole texts give."""
    import pyarrow as pa

    r, enc = random.Random(9), alignment.Both(default_vocabulary("byte_bpe_50k.json"), default_vocabulary("piece_bpe_32k.model"))
    bits = [" ", " ", "  ", "\n", " a", " the", "ing", "'s", "é", "北", "1", "99", "...", "-", "\t", "\x1c", "\u00a0", "▁", "<s>", "X", "ſ", "🏈", "<|endoftext|>"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(12))) for _ in range(3000)] + ["y" * 1500 + " z", "é 北" * 700]
    units, of_text, starts = enc.units(pa.array(texts))
    sides, good = enc.encode(units)
    for i, spans in enumerate(reference_spans(texts)):
        own = of_text[starts[i] : starts[i + 1]]
        assert "".join(" " + units[u] for u in own) == (" " + texts[i] if texts[i] else "")
        if not all(good[own]):
            assert spans == [[], []], texts[i]
            continue
        for want, (flat, ends, at) in zip(spans, sides):
            base = np.cumsum([0, *[len((" " + units[u]).encode()) for u in own]])
            got = [(x, b + e) for u, b in zip(own, base) for x, e in zip(flat[at[u] : at[u + 1]].tolist(), ends[at[u] : at[u + 1]].tolist())]
            assert [(x[0], x[2]) for x in want] == got, texts[i]


def test_groups_and_links(spark):
    """A cuts ab|c|de, B cuts a|bc|d|e."""
    found = spark.createDataFrame([(1, [10, 11, 12], [2, 3, 5], [20, 21, 22, 23], [1, 3, 4, 5])], "doc_id long, a array<int>, a_ends array<int>, b array<int>, b_ends array<int>")
    row = found.select(alignment.aligned(F.struct("a", "a_ends", "b", "b_ends")).alias("x")).select("x.*").withColumn("pairs", F.transform("links", lambda x: F.concat_ws("-", F.shiftright(x, 32), x.bitwiseAND(F.lit((1 << 32) - 1))))).first()
    assert [(g.a, g.b) for g in row.groups] == [([10, 11], [20, 21]), ([12], [22, 23])]
    assert row.pairs == ["10-20", "10-21", "11-21", "12-22", "12-23"]

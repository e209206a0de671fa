"""Every operator against a brute-force version on a small corpus with all edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from pitchside.llm import contexttree, decontaminate, htmlcontent, linededup, lmscore, packing, pii, quality, simhash, substrings, textcells
from pitchside.llm.components import components
from pitchside.llm.cuttingstock import solve
from pitchside.llm.dom import parse
from pitchside.llm.labelledpages import labelled_pages
from pitchside.llm.tokens import encoder
from pitchside.llm.vocabulary import default_vocabulary

SPACE = " \t\n\x0b\f\r"


def lower(s):
    return re.sub("[A-Z]", lambda m: m.group().lower(), s or "")


def split(s):
    return re.findall(r"[^\x20\x09-\x0D]+", s or "")


def rows_of(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)


# ---- op1


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def slow_pii(text):
    def good(kind, s):
        d = [int(c) for c in s if c.isdigit()]
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            return 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0
        return kind == "email" or 8 <= len(d) <= 15

    return {k: [m.span() for m in re.finditer(p, text) if good(k, m.group())] for k, p in BASE.items()}


def test_base_spans_equal_the_patterns():
    r = random.Random(1)
    for _ in range(3000):
        text = "".join(r.choice(["1", "23", "255", ".", ".", "@", "a", "b-", "+", " ", "(", ")", "-", "4111 1111 1111 1111", "é", "x@y.zz", "\n"]) for _ in range(r.randrange(40)))
        assert pii.find(text)[0] == slow_pii(text), text


@pytest.mark.parametrize(
    "text,kind,span",
    [
        ("write john [at] mail (dot) example (dot) org now", "email", "john [at] mail (dot) example (dot) org"),
        ("jane.doe at mail dot example dot com", "email", "jane.doe at mail dot example dot com"),
        ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("plus four nine one seven zero five five five one two", "phone", "plus four nine one seven zero five five five one two"),
        ("one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
    ],
)
def test_disguises_map_back(text, kind, span):
    assert [text[s:e] for s, e in pii.find(text)[1][kind]] == [span]


@pytest.mark.parametrize("text", ["look at this dot matrix", "one two", "we met at ten (at) the door", "Привет, как дела", "un dos tres", "[.] and (at)"])
def test_clean_text_has_no_spans(text):
    assert pii.joined(pii.find(text)[1]) == ""


def test_pii_rows(docs, corpus, empty):
    got = rows_of(pii.personal_data(docs), "doc_id", "base_sha256")
    want = sorted(((i, hashlib.sha256(pii.joined(slow_pii(t or "")).encode()).hexdigest()) for i, t in corpus), key=repr)
    assert got == want and pii.personal_data(empty).count() == 0


# ---- op2


def test_line_dedup(docs, corpus, empty):
    holders = defaultdict(list)
    for i, t in corpus:
        for k in {lower(x.strip(SPACE)) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                holders[k].append(i)
    common = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    assert common
    want = []
    for i, t in corpus:
        lines = (t or "").split("\n")
        kept = [x for x in lines if common.get(lower(x.strip(SPACE)), i) == i]
        want.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    out = linededup.dedup_lines(docs)
    assert rows_of(out, "doc_id", "n_lines", "n_dropped", "text") == sorted(want, key=repr)
    assert "fp" in out.columns and linededup.dedup_lines(empty).count() == 0


# ---- op3


def slow_fingerprint(text):
    w = [x.encode() for x in split(lower(text))]
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def slow_groups(fps):
    label = {i: i for i in range(len(fps))}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_near_groups(docs, corpus, empty):
    fps = [slow_fingerprint(t) for _, t in corpus]
    root = slow_groups(fps)
    low = {g: min((i for (i, _), x in zip(corpus, root) if x == g and i is not None), default=None) for g in set(root)}
    want = sorted(((i, f - (1 << 64) if f >> 63 else f, low[g]) for (i, _), f, g in zip(corpus, fps, root)), key=repr)
    assert rows_of(simhash.near_groups(docs), "doc_id", "fp", "component_id") == want
    assert simhash.near_groups(empty).count() == 0
    assert simhash.one_of_each(docs).count() == len(set(root))


def test_ball_links_lose_nothing(spark):
    r = random.Random(3)
    fps = set()
    for _ in range(40):
        f = r.getrandbits(64)
        fps.add(f)
        for _ in range(8):
            g = f
            for _ in range(r.randrange(5)):
                g ^= 1 << r.randrange(64)
            fps.add(g)
            f = r.choice([f, g])
    fps = sorted(fps)
    frame = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    got = {r.node: r.component for r in components(simhash.ball_links(simhash.crowded(frame))).collect()}
    want = slow_groups(fps)
    groups = defaultdict(set)
    for f, g in zip(fps, want):
        groups[g].add(got.get(simhash._signed(f), simhash._signed(f)))
    assert all(len(v) == 1 for v in groups.values()) and len({next(iter(v)) for v in groups.values()}) == len(groups)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}}


# ---- op4


def test_packing(docs, corpus, empty):
    enc, cut = encoder(default_vocabulary()), defaultdict(list)
    out = packing.pack(docs, default_vocabulary()).collect()
    for r in out:
        cut[r.sequence_id].append((r.offset, r.length))
    for parts in cut.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 4096
    want = Counter()
    for i, t in corpus:
        ids = enc.tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        for s in range(0, len(ids), 4096):
            part = np.array(ids[s : s + 4096], dtype="<u4")
            want[(i, s, len(part), zlib.crc32(part.tobytes()), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == want
    assert packing.pack(empty, default_vocabulary()).count() == 0


def test_cutting_stock_holds_each_piece_once_and_wastes_little():
    r = random.Random(5)
    histogram = {s: r.randrange(1, 400) for s in r.sample(range(1, 257), 120)}
    patterns = solve(histogram, 256)
    held = Counter()
    for p, n in patterns:
        assert sum(s * c for s, c in p.items()) <= 256
        for s, c in p.items():
            held[s] += c * n
    assert held == histogram
    assert sum(n for _, n in patterns) <= 1.02 * sum(s * n for s, n in histogram.items()) / 256 + 1


# ---- op5


def folded(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def slow_hits(text, items):
    w = folded(text)
    hit, found = set(), set()
    for item, t in items:
        v = folded(t)
        n = min(13, len(v))
        windows = {tuple(v[s : s + n]) for s in range(len(v) - n + 1)} if n else set()
        for s in range(len(w) - n + 1 if n else 0):
            if tuple(w[s : s + n]) in windows:
                hit |= set(range(s, s + n))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_one_block_of_the_benchmark_at_a_time(spark, docs, corpus, monkeypatch):
    """Three blocks: one table is alive at a time, and the result's plan searches none of them again."""
    live, most, begin = [0], [0], decontaminate.Searcher.__init__

    def counted(self, block):
        begin(self, block)
        live[0] += 1
        most[0] = max(most[0], live[0])

    monkeypatch.setattr(decontaminate.Searcher, "__init__", counted)
    monkeypatch.setattr(decontaminate.Searcher, "__del__", lambda self: live.__setitem__(0, live[0] - 1), raising=False)
    texts = [t for _, t in corpus if t and len(t.split()) > 60][:3]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")
    out = decontaminate.contamination(docs.withColumn("_row0", docs.doc_id), bench, 50)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1 and (most[0], live[0]) == (1, 0)
    whole = decontaminate.contamination(docs, bench)
    assert rows_of(out, *out.columns) == rows_of(whole, *out.columns) and sum(r.contaminated for r in out.collect()) >= 3


@pytest.mark.parametrize("block_chars", [10_000_000, 300])
def test_contamination(spark, docs, corpus, empty, block_chars):
    texts = dict(corpus)
    items = [(1, " ".join(texts[100 + 7 * 4].split()[3:40])), (2, "alpha1"), (3, None), (4, ""), (10, "same"), (11, texts[203]), (12, texts[203]), (13, "w w w")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(((i, *slow_hits(t, items)) for i, t in corpus), key=repr)
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert rows_of(decontaminate.contamination(docs, bench, block_chars), *columns) == want
    clean = decontaminate.contamination(docs, bench, block_chars, only_clean=True)
    assert clean.count() == sum(not x[-1] for x in want) and clean.columns == docs.columns
    assert decontaminate.contamination(empty, bench, block_chars).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(docs, bench.filter("false"), block_chars).collect()} == {0}


# ---- op7


def slow_repeats(corpus):
    seen = Counter()
    words = [split(t) for _, t in corpus]
    for w in words:
        seen.update(tuple(w[s : s + 35]) for s in range(len(w) - 34))
    out = []
    for (i, _), w in zip(corpus, words):
        gone = {p for s in range(len(w) - 34) if seen[tuple(w[s : s + 35])] > 1 for p in range(s, s + 35)}
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("group_segments", [20_000, 1])
def test_substrings(docs, corpus, empty, group_segments):
    got = rows_of(substrings.drop_repeats(docs, group_segments), "doc_id", "n_words", "n_removed", "text")
    assert got == slow_repeats(corpus) and any(x[2] for x in got)
    assert substrings.drop_repeats(empty).count() == 0


# ---- op8


def test_blocks_and_references():
    _, blocks = parse("<p>a &amp; b<br>c<p><b>d</b>e</p>&copy;<script>x<p>y</script><ul><li>1<li>2</ul><!-- no --><![odd[z]]>")
    assert [t for _, t in blocks] == ["a & b c", "de", "©", "1", "2"]


def test_held_out_pages():
    model = htmlcontent.default_model()
    wrong = total = 0
    for page in labelled_pages(200, seed=10**7):
        tree = htmlcontent.LabelledTree()
        tree.feed(page)
        tree.close()
        share = model.marginals(tree.nodes)
        for node, _ in parse(page)[1]:
            total += 1
            wrong += (share[node] > 0.5) != bool(tree.labels[node])
    assert wrong < 0.03 * total


def test_marginals_equal_enumeration():
    from itertools import product

    model = htmlcontent.default_model()
    nodes, _ = parse("<body><div class=menu><a href=x>m</a></div><div><p>Some words stand here, and more.</p><p>x</p></div></body>")
    found = htmlcontent.features(nodes)
    total, one = 0.0, [0.0] * len(nodes)
    for labels in product((0, 1), repeat=len(nodes) - 1):
        labels = (0, *labels)
        weight = sum(model.evidence(f) for f, y in zip(found, labels) if y) + sum(model.step[htmlcontent.kind(nodes, i)][labels[n.parent]][labels[i]] for i, n in enumerate(nodes) if i)
        total += math.exp(weight)
        for i, y in enumerate(labels):
            one[i] += y * math.exp(weight)
    assert np.allclose(model.marginals(nodes), [x / total for x in one])


def test_pages(spark):
    body = "<nav><a href=/>Home</a></nav><article><h1>Title</h1><p>First text, with words.</p><p>More text.</p></article><footer>&copy; x</footer>"
    rows = [(1, "u", body), (2, None, None), (3, "u", ""), (None, "u", body)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    text = "Title\n\nFirst text, with words.\n\nMore text."
    assert rows_of(htmlcontent.main_text(pages), "page_id", "url", "text", "n_chars") == sorted([(1, "u", text, len(text)), (2, None, "", 0), (3, "u", "", 0), (None, "u", text, len(text))], key=repr)
    assert htmlcontent.main_text(pages.filter("false")).count() == 0


# ---- op9


def slow_tree(units):
    """Weighted probabilities by the definition, one node at a time, over bits of one byte after up to eight bytes of its text.

    A context that reaches the start of its text ends there, with None.
    """
    counts = defaultdict(lambda: [0, 0])

    def context(before):
        return (*reversed(before), None)[:8]

    cells = Counter()
    for u, n in units.items():
        for i, byte in enumerate(u):
            cells[context(u[max(0, i - 8) : i]), byte] += n
    for (ctx, byte), n in cells.items():
        for d in range(len(ctx) + 1):
            for level in range(8):
                counts[(ctx[:d], byte >> (8 - level), level)][byte >> (7 - level) & 1] += n

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    is_leaf = lambda ctx: len(ctx) == 8 or ctx[-1:] == (None,)
    children = defaultdict(set)
    for ctx, prefix, level in counts:
        if ctx:
            children[(ctx[:-1], prefix, level)].add(ctx)
    weighted = {}
    for key in sorted(counts, key=lambda k: -len(k[0])):
        own = kt(*counts[key])
        weighted[key] = own if is_leaf(key[0]) else np.logaddexp(own, sum(weighted[(c, *key[1:])] for c in children[key])) + math.log(0.5)

    def one(ctx, prefix, level, d=0):
        key = (ctx[:d], prefix, level)
        if key not in counts:
            # the node of the whole context exists with no bits at this prefix, or does not exist: 1/2 either way
            return 0.5
        a, b = counts[key]
        own = (b + 0.5) / (a + b + 1)
        if is_leaf(ctx[:d]):
            return own
        share = math.exp(kt(a, b) + math.log(0.5) - weighted[key])
        return share * own + (1 - share) * one(ctx, prefix, level, d + 1)

    @cache
    def cell(ctx, byte):
        out = 0.0
        for level in range(8):
            p = one(ctx, byte >> (8 - level), level)
            out += math.log10(p if byte >> (7 - level) & 1 else 1 - p)
        return out

    return lambda u: math.fsum(cell(context(u[max(0, i - 8) : i]), byte) for i, byte in enumerate(u))


@pytest.mark.parametrize("hot_units,run_bytes,wave_bytes,batch_rows", [(500_000, 32_000_000, 8_000_000, 200_000), (3, 20_000, 8000, 3000)])
def test_scores(docs, corpus, empty, hot_units, run_bytes, wave_bytes, batch_rows):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    raw = [[lower(t).encode() + b"\0"] for _, t in corpus]  # contexts go on across words to the start of the text
    tokens, units = Counter(), Counter()
    for (i, t), x in zip(corpus, raw):
        if not held(i):
            tokens.update([*split(lower(t)), None])
            units.update(x)
    total, kinds = sum(tokens.values()), len(tokens)
    of = slow_tree(units)
    score = {u: of(u) for u in {u for x in raw for u in x}}
    want = []
    for (i, t), x in zip(corpus, raw):
        w = [*split(lower(t)), None]
        want.append((i, held(i), len(w), sum(tokens[y] > 0 for y in w), total, math.fsum(math.log10((tokens[y] + 1) / (total + kinds + 1)) for y in w), math.fsum(score[u] for u in x)))
    got = rows_of(lmscore.score_documents(docs, hot_units, run_bytes, wave_bytes, batch_rows), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    order = lambda x: (repr(x[0]), x[2], round(x[5], 6))
    for a, b in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:], rtol=1e-8, atol=1e-7), (a, b)
    assert lmscore.score_documents(empty).count() == 0


def test_texts_are_dealt_once_for_counting_and_shuffles_go(spark, monkeypatch):
    dealt, name = [], "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, deal = spark.conf.get(name), lmscore.in_runs
    monkeypatch.setattr(lmscore, "in_runs", lambda *a: dealt.append(spark.conf.get(name)) or deal(*a))
    rows = spark.createDataFrame([(i, f"some text {i * i}") for i in range(300)], "doc_id long, text string")
    assert lmscore.score_documents(rows, run_bytes=2000, wave_bytes=250).filter("score < 0").count() == 300
    assert dealt == ["true"] and spark.conf.get(name) == before  # eight waves dealt them sixteen times


def test_buckets_are_never_cut(spark):
    bucket, size = np.repeat(np.arange(40), 5), np.tile([3, 0, 4, 1, 2], 40)
    batches = [pa.RecordBatch.from_arrays([pa.array(bucket[i : i + 7]), pa.array(size[i : i + 7])], names=["bucket", "size"]) for i in range(0, 200, 7)]
    got = list(lmscore.batched(iter(batches), 25))
    assert np.array_equal(np.concatenate([t.column("bucket").to_numpy() for t in got]), bucket)
    assert [t.num_rows for t in got] == [15] * 13 + [5]


def test_scores_keep_eleven_digits():
    x = -np.abs(np.random.default_rng(3).standard_normal(1000)) ** 9
    assert np.allclose(textcells.unpacked_scores(textcells.packed_scores(x)), x, rtol=1e-11, atol=0)


def test_a_word_costs_less_after_the_word_that_it_follows(spark):
    train = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 != 2]
    apart = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows = [(i, ("red fox", "big cat")[i % 2]) for i in train] + list(zip(apart, ["red fox", "red cat"]))
    got = {r.doc_id: r.score for r in lmscore.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[apart[0]] - got[apart[1]] > 1  # by words alone both cost the same but for how often each word is there


def test_cells_of_texts_are_those_of_the_definition():
    few, many = pa.array(["ab ab", None, "", "Ab\0b é"]), pa.array(["".join(map(chr, np.random.default_rng(1).integers(1, 0xD000, 60_000)))])
    for column in (few, many):  # the second has more pairs of bytes than numbers of 63 bits have room for
        data, sizes = textcells.padded(column)
        want = Counter()
        for t in column.to_pylist():
            raw = lower(t or "").encode() + b"\0"
            want.update((bytes(raw[i - d] if i >= d else 255 for d in range(1, 9)), raw[i]) for i in range(len(raw)))
        run, got = textcells.Run(data), Counter()
        for wave in range(3):
            ctx, byte, n = textcells.counted(run, np.ones(len(data), dtype=bool), wave, 3)
            for _, i, j in textcells.by_bucket(ctx):
                ctx_, byte_, n_ = textcells.unpacked(*textcells.packed(ctx[i:j], byte[i:j], n[i:j]))
                assert list(zip(ctx_, byte_)) == sorted(zip(ctx_, byte_))
                got.update({(int(c).to_bytes(8, "big"), int(b)): int(k) for c, b, k in zip(ctx_, byte_, n_)})
        assert got == want


def test_rows_without_ids_are_told_apart(spark):
    texts = [f"word{i}" * (1 + i % 3) for i in range(3000)]
    got = lmscore.score_documents(spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string"))
    assert got.filter("score < 0 AND n_tokens = 2").count() == 3000


def test_without_training_rows_every_bit_is_a_half(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = lmscore.score_documents(spark.createDataFrame([(i, "ab c") for i in ids], "doc_id long, text string"))
    assert {(r.n_known, r.train_tokens, r.base_score, round(r.bits_per_byte, 9)) for r in got.collect()} == {(0, 0, 0.0, 8.0)}


def test_byte_probabilities_sum_to_one():
    every = np.arange(256)
    ctx = np.repeat(np.array([0x6162FFFFFFFFFFFF, 0x61FFFFFFFFFFFFFF], dtype=np.uint64), 256)[np.argsort(np.repeat([1, 0], 256), kind="stable")]
    n = np.where(np.tile(every, 2) == 101, 7, 0)
    levels, *_ = contexttree.grown(ctx, np.tile(every, 2), n)
    top = levels[0]
    key = (ctx[top.first] >> np.uint64(32)).astype(np.int64) << 8 | top.heap(np.tile(every, 2))
    half = np.full(len(key), 0.25)
    found = contexttree.log_probabilities(ctx, np.tile(every, 2), n, (key, half, half, np.full(len(key), 0.5)))
    assert np.allclose((10.0 ** found.reshape(2, 256)).sum(axis=1), 1)


def test_rare_byte_after_a_frequent_context_keeps_a_probability():
    ctx = np.full(2, int.from_bytes(b"ht\xff\xff\xff\xff\xff\xff", "big"), dtype=np.uint64)
    byte, n = np.array([ord("]"), ord("e")]), np.array([3, 200_000_000])
    levels, *_ = contexttree.grown(ctx, byte, n)
    key = (ctx[levels[0].first] >> np.uint64(32)).astype(np.int64) << 8 | levels[0].heap(byte)
    none = np.zeros(len(key))
    found = contexttree.log_probabilities(ctx, byte, n, (key, none, none, none + 1))
    # the bits before the one that differs, that one, and five that follow
    assert math.isclose(found[0], 2 * math.log10((n.sum() + 0.5) / (n.sum() + 1)) + math.log10(3.5 / (n.sum() + 1)) + 5 * math.log10(3.5 / 4), abs_tol=1e-6)


# ---- op10


def slow_base(text):
    text = text or ""
    w = split(text)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {p for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if split(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_quality(spark, docs, corpus, empty):
    labels = spark.createDataFrame([(i, 0 if i % 5 == 0 else 1, None if i % 3 else 0) for i in range(100, 190)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    out = quality.quality_rules(docs, model)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert rows_of(out, *columns) == sorted(((i, *slow_base(t)) for i, t in corpus), key=repr)
    rows = out.collect()
    assert all(r.kept == (not r.base_failed and r.llr >= model.threshold) for r in rows)
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in rows)
    assert quality.quality_rules(empty, quality.fit(empty, labels)).count() == 0
    none = quality.fit(docs, labels.filter("false"))
    assert all(r.kept != r.base_failed for r in quality.quality_rules(docs, none).collect())


def test_threshold_rejects_bad_and_keeps_good():
    scores, good = np.array([-2.0, -1.9, -0.2, 0.0, 0.1]), np.array([False, False, True, True, True])
    assert -1.9 < quality._threshold(scores, good, 50) < -0.2
    assert quality._threshold(np.array([1.0, 1.0]), np.array([True, False]), 50) == -np.inf


# ---- repeated rows and ids, against the SQL


@pytest.mark.parametrize("name", ["op2_line_dedup", "op5_decontamination", "op7_substring_dedup"])
def test_sql_on_repeated_ids(spark, tmp_path, name):
    """Rows that repeat an id are documents of their own, in the query and in its SQL."""
    import duckdb

    from pitchside.llm import registry

    line = "A line of forty characters or more, which repeats."
    passage = " ".join(f"w{i}" for i in range(50))
    rows = [(1, f"{line}\na"), (1, f"{line}\nb"), (2, line), (2, line), (3, f"x\n{line}"), (3, passage), (4, f"{passage} more"), (None, f"{line}\nc"), (None, passage), (5, None)]
    if name == "op5_decontamination":
        rows = [r for r in rows if r not in ((2, line),)]
        rows = [(k, t) for k, (_, t) in enumerate(rows)]
    if name == "op7_substring_dedup":
        rows = [(k, t) for k, (_, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("i1", passage), ("i2", "short item"), (None, "x"), ("i3", None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    con_rows = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in con_rows.description]
    want = sorted(con_rows.fetchall(), key=repr)
    assert rows_of(registry.queries()[name](spark, str(tmp_path)), *columns) == want

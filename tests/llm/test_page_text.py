import time

from pitchside.llm.dom import attribute_words, parse
from pitchside.llm.htmlcontent import default_model
from pitchside.llm.warc import plain_text


def blocks(html):
    return [t for _, t in parse(html)[1]]


def test_formulas_are_text_within_their_block():
    assert blocks("<p>Let <math><mi>x</mi></math> be</p>") == ["Let x be"]
    tex = "<math><semantics><mrow><mi>a</mi><mo>=</mo><mfrac><mn>1</mn><mi>b</mi></mfrac></mrow><annotation encoding='application/x-tex'>a=\\frac1b</annotation></semantics></math>"
    assert blocks(f"<p>So {tex}, <math><mspace/><mtext>done</mtext></math>.</p><p>End</p>") == ["So a=1b, done.", "End"]
    assert blocks("<math><mtable><mtr><mtd>1</mtd><mtd>2</mtd></mtr></mtable></math>") == ["1 2"]


def test_text_inside_embedded_objects_stays():
    assert blocks("<p>a</p><object data=x><param name=y><p>the chart</p></object><video src=v>the film</video><audio>the song</audio><canvas>the drawing</canvas>") == ["a", "the chart", "the film", "the song", "the drawing"]
    assert blocks("<p>a</p><script>x</script><style>y</style><svg><text>z</text></svg>") == ["a"]


def test_names_at_the_end_of_a_long_class_list_are_read():
    assert attribute_words([("class", "px-4 " * 200 + "sidebar")])[-1] == "sidebar"


def test_text_without_an_element_of_its_own():
    extract = default_model().extract
    loose = "Loose article text stands here, with more than one sentence. It goes on for a while, as articles do, and ends here."
    assert extract(f"<body>{loose}</body>") == extract(loose) == extract(f"<html>\n{loose}\n</html>") == loose
    assert extract(f"<body>{loose}<p>{loose}</p><hr>{loose}</body>") == "\n\n".join([loose] * 3)
    assert extract(f"<nav><ul><li><a href=/>Home</a><li><a href=/b>News</a></ul></nav>{loose}<footer>&copy; Someone</footer>") == loose


def test_pages_not_from_the_generator():
    """Hand-written pages with what is to stay."""
    extract = default_model().extract
    story = "The council met on Monday and decided to build the bridge, after years of talk. Work is to begin in spring."
    more = "Residents had asked for it since the flood of 2013, which took the old one away."
    pages = {
        f"<div id=top class='site-header'><a href=/>Daily</a></div><div class='row'><div class='col-8 post-content'><h1>A bridge at last</h1><p>{story}<p>{more}</div><div class='col-4 sidebar'><h3>Most read</h3><ul><li><a href=/1>One</a></li><li><a href=/2>Two</a></li></ul></div></div><div class='site-footer'>&copy; Daily. <a href=/imprint>Imprint</a></div>": ["A bridge at last", story, more],
        f"<main><article><header><h1>A bridge at last</h1></header><section><p>{story}</p><blockquote><p>{more}</p></blockquote></section></article><section class=comments><h2>Comments</h2><div class=comment><p>First one here, and I think that it is too late for it.</p></div></section></main>": ["A bridge at last", story, more],
        f"<body><table><tr><td><p>{story}</p><p>{more}</p></td></tr></table><form action=/s><input name=q><button>Go</button></form></body>": [story, more],
    }
    got = [(extract(page).split("\n\n"), want) for page, want in pages.items()]
    assert sum(a == b for a, b in got) >= 2, got


def test_deep_pages_take_linear_time():
    began = time.time()
    for page in ("<div>" * 100_000 + "deep", "<ul><li>" * 50_000 + "<li>" * 50_000, "<b>" * 50_000 + "</i>" * 50_000 + "</b>" * 50_000, "<span>" * 50_000 + "<p>x" * 50_000):
        nodes, blocks = parse(page)
        default_model().marginals(nodes)
    assert time.time() - began < 60


def test_a_late_charset_is_read():
    head = b"<html><head><!--" + b"x" * 9000 + b"--><meta name='a' content='" + b"y" * 500 + b"' charset=windows-1251></head><body>"
    assert plain_text("text/html", head + "Привет".encode("cp1251")) == "Привет"
    assert plain_text("text/html", "<body><p>charset <meta charset=cp1251>ü</p>".encode()) == "charset\nü"

import base64
import gzip
import hashlib

from pitchside.llm import warc

BODY = b"<nav>Menu</nav><p>A &amp; b</p><script>x</script>"


def http(body, *fields, status=200):
    return f"HTTP/1.1 {status} X\r\n".encode() + b"".join(f.encode() + b"\r\n" for f in fields) + b"\r\n" + body


def response(spark, rows):
    return spark.createDataFrame([(i, "response", f"http://x/{i}", "2024-01-01T00:00:00Z", None, b) for i, b in rows], "record_id string, warc_type string, target_uri string, warc_date string, payload_digest string, block binary")


def test_records_are_linked_and_keep_headers_and_digests(spark):
    block = http(BODY, "Content-Type: text/html", "Server: s")
    got = {r.warc_type: r for r in warc.derivatives(response(spark, [("<urn:a>", block)])).collect()}
    meta, text = got["metadata"], got["conversion"]
    assert meta.refers_to == text.refers_to == "<urn:a>" and meta.concurrent_to == text.record_id != meta.record_id
    payload = "sha1:" + base64.b32encode(hashlib.sha1(BODY).digest()).decode()
    assert meta.payload_digest == text.payload_digest == payload and text.block == b"Menu\nA & b"
    lines = bytes(meta.block).decode().split("\r\n")
    assert "http-status: 200" in lines and "http-header-server: s" in lines and f"source-payload-digest: {payload}" in lines
    assert text.block_digest == warc.digest(b"Menu\nA & b")


def test_encodings_and_odd_blocks(spark):
    rows = [
        ("gz", http(gzip.compress(BODY), "Content-Type: text/html", "Content-Encoding: gzip")),
        ("chunked", http(b"5\r\nab cd\r\n0\r\n\r\n", "Content-Type: text/plain", "Transfer-Encoding: chunked")),
        ("latin", http("<p>é".encode("latin-1"), "Content-Type: text/html; charset=latin-1")),
        ("broken", http(b"zz", "Content-Type: text/html", "Content-Encoding: gzip")),
        ("image", http(b"\x89PNG", "Content-Type: image/png")),
        ("bare", b"<p>no head"),
        ("null", None),
    ]
    out = warc.derivatives(response(spark, rows)).collect()
    texts = {r.refers_to: bytes(r.block).decode() for r in out if r.warc_type == "conversion"}
    assert texts == {"gz": "Menu\nA & b", "chunked": "ab cd", "latin": "é", "bare": "no head", "null": ""}
    assert sum(r.warc_type == "metadata" for r in out) == len(rows)


def test_round_trip_and_only_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://x/1", "<p>é and\r\n\r\nmore"), (2, None, None), (2, None, None)], "page_id long, url string, html string")
    both = warc.page_responses(pages)
    records = both.drop("page_id").union(warc.derivatives(both))
    warc.write_records(records, str(tmp_path / "w"))
    key = lambda r: tuple(str(r[c]) for c in warc.NAMES)
    assert sorted(map(key, warc.read_records(spark, str(tmp_path / "w")).collect())) == sorted(map(key, records.collect()))
    assert warc.derivatives(warc.read_records(spark, str(tmp_path / "w"))).count() == 6
    assert warc.derivatives(both.filter("false")).count() == 0


def test_bodies_that_do_harm(monkeypatch):
    """Negative and huge sizes of chunks, bombs and charsets that are none of text end in a defined result."""
    chunked, zipped = [("Transfer-Encoding", "chunked")], [("Content-Encoding", "gzip")]
    for body in (b"-6\r\nabc\r\n0\r\n\r\n", b"+3\r\nabc", b"0x3\r\nabc", b"zz\r\n", b"\r\n\r\n", b"F" * 40 + b"\r\nabc"):
        assert warc.decoded(chunked, body) is None, body
    assert warc.decoded(chunked, b"3;x=y\r\nabc\r\n1\r\nd\r\n0\r\n\r\n") == b"abcd"
    assert warc.decoded(chunked, b"FFFFFFFFFFFF\r\nabc") == b"abc" and warc.decoded(chunked, b"") == b""
    two = gzip.compress(b"a" * 10) + gzip.compress(b"b")
    assert warc.decoded(zipped, two) == b"a" * 10 + b"b" and warc.decoded(zipped, two[:-3]) is None and warc.decoded(zipped, b"") == b""
    monkeypatch.setattr(warc, "MOST_BYTES", 1000)
    assert warc.decoded(zipped, gzip.compress(b"a" * 1000)) == b"a" * 1000 and warc.decoded(zipped, gzip.compress(b"a" * 1001)) is None
    for name in ("undefined", "idna", "punycode", "rot13", "base64", "zip", "no-such", "unicode_escape", "utf-16"):
        assert warc.plain_text(f"text/plain; charset={name}", b"caf\xc3\xa9 \\x41") is not None
    assert warc.plain_text("text/plain; charset=undefined", "é".encode()) == "é" == warc.plain_text("text/plain; charset=latin-1", b"\xe9")
    assert warc.plain_text("text/html", b"<meta charset=undefined><p>x") == "x"


def slow_records(record_id, block):
    """(warc_type, refers_to, payload digest, text, block digest) of a response, with the standard library alone."""
    import html.parser
    from email.parser import BytesParser

    sha1 = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    head, _, body = block.partition(b"\r\n\r\n")
    fields = BytesParser().parsebytes(head.split(b"\r\n", 1)[1] + b"\r\n\r\n")
    data = gzip.decompress(body) if fields["Content-Encoding"] == "gzip" else body

    class Text(html.parser.HTMLParser):
        out = ""

        def handle_data(self, x):
            self.out += x

    parser = Text()
    parser.feed(data.decode(fields.get_content_charset("utf-8")))
    text = parser.out.encode()
    return {("metadata", record_id, sha1(body)), ("conversion", record_id, sha1(body), text, sha1(text))}


def test_records_equal_those_of_the_standard_library(spark):
    """Pages of one block, over odd charsets and encodings; extra columns whose names clash; a null id and a very long body."""
    rows = [(f"<urn:{i}>", http(f"<p>caf\u00e9 {i}</p>".encode(c), f"Content-Type: text/html; charset={c}")) for i, c in enumerate(["utf-8", "latin-1", "utf-16", "cp1252", "koi8-u"][:4])]
    rows += [("<urn:z>", http(gzip.compress(b"<p>zipped</p>"), "Content-Type: text/html", "Content-Encoding: gzip")), (None, http(b"<p>none</p>", "Content-Type: text/html")), ("<urn:long>", http(b"<p>" + b"long " * 400_000 + b"end</p>", "Content-Type: text/html"))]
    from pyspark.sql import functions as F

    frame = response(spark, rows).withColumns({"text": F.lit(1), "status": F.lit("x"), "refers_to": F.lit("clash")})
    got = warc.derivatives(frame).collect()
    for key, block in rows:
        own = [r for r in got if r.refers_to == (key or "")]  # a null id is the empty one
        found = {(r.warc_type, r.refers_to, r.payload_digest) if r.warc_type == "metadata" else (r.warc_type, r.refers_to, r.payload_digest, bytes(r.block), r.block_digest) for r in own}
        assert found == slow_records(key or "", block), key

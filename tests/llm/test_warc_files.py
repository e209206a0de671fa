import pytest

from pitchside.llm import warc


def record(name, block, version="1.0", **more):
    head = {"WARC-Type": "resource", "WARC-Record-ID": name, "Content-Length": str(len(block)), **more}
    return f"WARC/{version}\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def read(spark, tmp_path, **files):
    for name, data in files.items():
        (tmp_path / f"{name}.warc").write_bytes(data)
    return sorted((r.record_id, bytes(r.block)) for r in warc.read_records(spark, str(tmp_path)).collect())


INNER = record("<inner>", b"kept \xff as it is")
BLOCKS = [("<a>", b"one"), ("<b>", b""), ("<c>", b"a page about WARC/1.0\r\nand WARC/1.1\r\n\r\n"), ("<d>", INNER + record("<inner2>", b"WARC/1.WARC/1.")), ("<e>", b"last\r\n\r\n")]


def test_records_of_version_1_1(spark, tmp_path):
    blocks = [("<a>", b"one"), ("<b>", b"two\r\n\r\n"), ("<c>", b"")]
    assert read(spark, tmp_path, new=b"".join(record(n, b, "1.1") for n, b in blocks)) == blocks


@pytest.mark.parametrize("version", ["1.0", "1.1"])
def test_record_starts_in_a_payload_or_a_head(spark, tmp_path, version):
    data = b"".join(record(n, b, version, **{"WARC-Target-URI": "http://x/WARC/1.1/y"} if n == "<b>" else {}) for n, b in BLOCKS)
    assert read(spark, tmp_path, odd=data, plain=record("<p>", b"plain")) == [*BLOCKS, ("<p>", b"plain")]


def test_many_splits_of_one_file(spark, tmp_path):
    want = [(f"<{i:05}>", (BLOCKS[i % 5][1] + b"x" * (i % 700))) for i in range(2000)]
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert read(spark, tmp_path, big=b"".join(record(n, b) for n, b in want)) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_a_file_that_is_cut_off(spark, tmp_path):
    assert read(spark, tmp_path, a=record("<a>", b"WARC/1.0\r\n12345")[:-8], b=record("<b>", b"whole")) == [("<a>", b"WARC/1.0\r\n1"), ("<b>", b"whole")]

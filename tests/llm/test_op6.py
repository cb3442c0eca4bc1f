import base64
import hashlib

from graphloom.llm import op6
from graphloom.llm.common import table


def sha1(b):
    return "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_tables(spark, sf):
    pages = {r.page_id: r for r in table(spark, sf, "pages").collect()}
    got = op6.op6_warc_derivatives(spark, sf).collect()
    assert len(got) == 2 * len(pages) == 2 * len({r.record_id for r in got}) / 2
    for r in got:
        page = pages[r.page_id]
        assert r.target_uri == page.url and r.source_payload_digest == sha1(page.html.encode())
        block = r.block.encode()
        assert r.block_digest == sha1(block) and r.content_length == len(block)
        fields = dict(x.split(": ", 1) for x in r.header.strip().split("\r\n")[1:])
        assert r.header.startswith("WARC/1.1\r\n") and fields["WARC-Refers-To"] == r.refers_to and fields["WARC-Record-ID"] == r.record_id
        if r.warc_type == "metadata":
            assert f"source-record-id: {r.refers_to}\r\n" in r.block and f"source-payload-digest: {sha1(page.html.encode())}" in r.block
        else:
            assert "<script" not in r.block and "track(" not in r.block and "margin" not in r.block
    by = {}
    for r in got:
        by.setdefault(r.page_id, set()).add((r.warc_type, r.refers_to))
    assert all({t for t, _ in v} == {"metadata", "conversion"} and len({s for _, s in v}) == 1 for v in by.values())


def test_text_of_pages():
    page = "<html><head><title>A &amp; B</title><style>x</style></head><body><p>one <b>two</b><p>three&nbsp;4 &lt;5<br>six<script>no</p></script><!-- no --> a < b <ul><li><a href='/x?a=1&amp;b=2'>L</a></ul> tail <!-- open"
    assert op6.plain_text(page) == "one two\nthree 4 <5\nsix a < b\nL\ntail"
    meta, text = op6.derive("<urn:uuid:1>", "http://h/", None, b"HTTP/1.1 404 Not Found\r\nServer: x:y\r\nX\r\n\r\n" + page.encode() + b"\xff")
    assert "source-status-line: HTTP/1.1 404 Not Found\r\n" in meta[-1] and "source-header-server: x:y\r\n" in meta[-1]
    assert "title: A & B\r\n" in meta[-1] and "outlink: /x?a=1&b=2\r\n" in meta[-1] and "WARC-Date" not in text[-2]


def test_awkward_rows(spark):
    rows = [(1, None, None, 5), (2, "http://a", "", 5), (None, "http://b", "<p>x", 5), (3, "http://c", "<p>" + "y" * 3_000_000, 5), (3, "http://c", "z", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, block int")
    got = op6.derivatives(op6.responses(pages), "page_id", "record", "target", "date", "block").collect()
    assert len(got) == 10
    texts = sorted(r.block for r in got if r.warc_type == "conversion")
    assert texts == ["", "", "x", "y" * 3_000_000, "z"]
    assert op6.derivatives(op6.responses(pages.limit(0)), "page_id", "record", "target", "date", "block").collect() == []

"""Records read from WARC files, and what is derived from them, against a plain reader."""

import gzip
import re
import time
import zlib

from graphloom.llm import op6


def record(kind, name, target, date, block, extra=""):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Target-URI: {target}\r\nWARC-Date: {date}\r\n{extra}Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def http(body, *headers):
    return "\r\n".join(["HTTP/1.1 200 OK", *headers]).encode() + b"\r\n\r\n" + body


PAGE = "<html><head><title>Tür</title></head><body><p>Größe <a href='/x'>x</a></body></html>"
CHUNKED = b"5;x=1\r\n<p>ab\r\n3\r\nc d\r\n0\r\n\r\n"
BLOCKS = {
    "plain": http(PAGE.encode(), "Content-Type: text/html; charset=utf-8"),
    "latin": http(PAGE.encode("latin-1"), "Content-Type: text/html; charset=ISO-8859-1"),
    "meta": http(b"<meta charset=latin-1>" + PAGE.encode("latin-1"), "Content-Type: text/html"),
    "gzip": http(gzip.compress(PAGE.encode()), "Content-Type: text/html", "Content-Encoding: gzip"),
    "deflate": http(zlib.compress(PAGE.encode())[2:-4], "Content-Encoding: deflate"),
    "chunked": http(CHUNKED, "Transfer-Encoding: chunked"),
    "odd": http(b"<p>a page about files\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\nend</p>", "Content-Type: text/html; charset=no-such"),
    "empty": b"",
}
TEXTS = {"plain": "Größe x", "latin": "Größe x", "meta": "Größe x", "gzip": "Größe x", "deflate": "Größe x", "chunked": "abc d", "odd": "a page about files\nWARC/1.0\nWARC-Type: response\nend", "empty": ""}


def write(folder):
    folder.mkdir()
    parts = [record("warcinfo", "i", "", "2024-01-01T00:00:00Z", b"software: x\r\n")]
    parts += [record("response", n, f"http://h/{n}", f"2024-02-0{k + 1}T00:00:00Z", b, "WARC-IP-Address: 192.0.2.7\r\nWARC-Payload-Digest: sha1:AAAA\r\n") for k, (n, b) in enumerate(BLOCKS.items())]
    (folder / "a.warc").write_bytes(b"".join(parts[:4]))
    (folder / "b.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts[4:]))
    (folder / "c.warc").write_bytes(record("response", "cut", "http://h/cut", "2024-03-01T00:00:00Z", b"x" * 50)[:-20])


def test_records_are_read_whole(spark, tmp_path):
    write(tmp_path / "in")
    got = {r.record: r for r in op6.read_warc(spark, str(tmp_path / "in")).collect()}
    assert len(got) == len(BLOCKS) + 2
    for n, b in BLOCKS.items():
        r = got[f"<urn:uuid:{n}>"]
        assert (r.warc_type, r.target, bytes(r.block), r.error) == ("response", f"http://h/{n}", b, None) and "WARC-IP-Address: 192.0.2.7" in r.header
    assert got["<urn:uuid:cut>"].error and got["<urn:uuid:i>"].warc_type == "warcinfo"


def test_derived_records_keep_what_the_source_says(spark, tmp_path):
    write(tmp_path / "in")
    got = op6.from_warc(spark, str(tmp_path / "in"))
    rows = got.collect()
    by = {(r.refers_to, r.warc_type): r for r in rows}
    assert len(by) == len(rows) == 2 * (len(BLOCKS) + 1)
    for k, (n, b) in enumerate(BLOCKS.items()):
        meta, text = by[f"<urn:uuid:{n}>", "metadata"], by[f"<urn:uuid:{n}>", "conversion"]
        assert text.block == TEXTS[n]
        assert f"WARC-Refers-To: <urn:uuid:{n}>\r\nWARC-Refers-To-Target-URI: http://h/{n}\r\nWARC-Refers-To-Date: 2024-02-0{k + 1}T00:00:00Z\r\n" in text.header
        assert f"WARC-Concurrent-To: {text.record_id}\r\n" in meta.header and f"WARC-Concurrent-To: {meta.record_id}\r\n" in text.header
        assert "source-warc-ip-address: 192.0.2.7\r\n" in meta.block and "source-warc-payload-digest: sha1:AAAA\r\n" in meta.block
        payload = b.partition(b"\r\n\r\n")[2]
        assert f"source-payload-digest: {op6.digest(payload)}\r\n" in meta.block and meta.source_payload_digest == op6.digest(payload)
        assert n in ("chunked", "odd", "empty") or "title: Tür\r\noutlink: /x\r\n" in meta.block
    # written and read back
    op6.write_warc(got, str(tmp_path / "out"))
    again = {r.record: r for r in op6.read_warc(spark, str(tmp_path / "out")).collect()}
    assert len(again) == len(rows) and all(again[r.record_id].error is None and bytes(again[r.record_id].block) == r.block.encode() for r in rows)


def test_records_without_a_name_differ():
    a, b, c = (op6.derive(None, t, None, x)[0] for t, x in (("http://a", b"1"), ("http://b", b"1"), ("http://a", b"2")))
    assert len({a[1], b[1], c[1]}) == 3 and op6.derive(None, "http://a", None, b"1")[0] == a


def test_hostile_pages_take_time_in_proportion():
    for piece in ("<title", "<a ", "<a href=", "<title>", "<p", "<noscript ", "<!--", "<script>", "<head"):
        began = time.time()
        op6.derive("s", None, None, b"HTTP/1.1 200 OK\r\n\r\n" + piece.encode() * 60_000)
        assert time.time() - began < 3, piece
    assert re.fullmatch(r"a < b", op6.plain_text("a < b"))

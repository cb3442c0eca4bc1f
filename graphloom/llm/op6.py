"""WARC derivatives: metadata and plain-text conversion records of responses, linked to them.

A response record (identifier, target, date, HTTP block, header lines) gives two records. Both name it in WARC-Refers-To, with
its target and date, keep its target and date, and name each other in WARC-Concurrent-To; the metadata record keeps the
source's WARC header lines, HTTP status, headers, digests, title and links as warc-fields, the conversion record holds the
text of its page. Chunked and compressed payloads (gzip, deflate) are undone and the page's charset is followed before text
is taken; digests are those of the stored bytes. Identifiers of new records are made from the source's identifier and the
record's type, so a retried task writes the same records.

``read_warc`` reads records of WARC files, also compressed ones, a record at a time; ``write_warc`` writes derived ones.

Defined results: a null block is an empty response (no status, empty text); null targets and dates are left out of headers;
a record without an identifier gets one from its target, date and block; rows that repeat give the same records again; extra
columns are ignored; an empty table gives an empty result. Bytes that are not of the page's charset are replaced; an unknown
charset is UTF-8; what is compressed and broken is kept as far as it can be read. Pages of any length are taken whole, in
time that grows with their length.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import html
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps, text_batches

VERSION, NAMESPACE, DATE = "WARC/1.1", uuid.NAMESPACE_URL, "2024-01-01T00:00:00Z"
COLUMNS = ("warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "source_payload_digest", "block_digest", "content_length", "header", "block")
SCHEMA = "source_id long, " + ", ".join(f"{c} {'long' if c == 'content_length' else 'string'}" for c in COLUMNS)

RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)", re.I | re.S)
CLOSED = re.compile(r"<(/?)(noscript|template)\b[^>]*>", re.I)
#: The start of a head, what ends it, and what it may hold where its end tag is left out.
HEAD, HEAD_END = re.compile(r"<head\b[^>]*>", re.I), re.compile(r"<(?:(/head)\s*|body\b[^>]*)>", re.I)
HEAD_ITEMS = re.compile(r"(?:\s|<(?:meta|link|base|basefont|bgsound)\b[^>]*>|<title\b[^>]*>.*?</title\s*>)*+", re.I | re.S)
TITLE, TITLE_END = re.compile(r"<title\b[^>]*>", re.I), re.compile(r"</title", re.I)
LINK = re.compile(r"""<a\b[^<>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
BREAKS = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*>", re.I)
TAG = re.compile(r"<[a-zA-Z/!?][^>]*>")


def closed(page: str) -> str:
    """A page up to its last '>', after which no tag ends, and the rest without '<': no search for an end runs in vain."""
    end = page.rfind(">") + 1
    return page[:end] + page[end:].replace("<", "\0")


def visible(page: str) -> str:
    """A page without comments, scripts, styles, head, and what <noscript> and <template> enclose.

    Scripts and styles without an end tag go to the end of the page. An unclosed <noscript> or <template> is a tag only; a
    head without its end tag ends at the first thing that no head holds.
    """
    page = closed(RAW.sub(" ", page))
    opened, cut = {"noscript": [], "template": []}, []
    for m in CLOSED.finditer(page):
        starts = opened[m[2].lower()]
        if not m[1]:
            starts.append(m.start())
        elif starts:
            cut.append((starts.pop(), m.end()))
    out, at = [], 0
    for i, j in sorted(cut):
        if j > at:
            out.append(page[at : max(i, at)])
            at = j
    page = " ".join([*out, page[at:]])
    if head := HEAD.search(page):
        end = HEAD_END.search(page, head.end())
        end = end.end() if end and end[1] else HEAD_ITEMS.match(page, head.end()).end()
        page = page[: head.start()] + " " + page[end:]
    return page


def plain_text(page: str) -> str:
    """The text of a page: hidden parts out, block elements on lines of their own, entities decoded."""
    text = TAG.sub("", BREAKS.sub("\n", closed(visible(page)))).replace("\0", "<")
    lines = (" ".join(x.split()) for x in html.unescape(text).split("\n"))
    return "\n".join(x for x in lines if x)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*about: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, '|'.join(about))}>"


def parse_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload."""
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    headers = [(k.strip(), v.strip()) for k, s, v in (x.partition(":") for x in lines[1:]) if s]
    return lines[0], headers, payload


def decoded(headers: list[tuple[str, str]], payload: bytes) -> bytes:
    """A payload without the transfer and content coding that its headers name."""
    told = {k.lower(): v.lower() for k, v in headers}
    if "chunked" in told.get("transfer-encoding", ""):
        out, at = [], 0
        while (end := payload.find(b"\r\n", at)) >= 0:
            size = payload[at:end].split(b";")[0].strip()
            if not re.fullmatch(rb"[0-9a-fA-F]{1,8}", size) or not (n := int(size, 16)):
                break
            out.append(payload[end + 2 : end + 2 + n])
            at = end + 4 + n
        payload = b"".join(out) if out or payload[:1] == b"0" else payload
    coding = told.get("content-encoding", "")
    for bits in {"gzip": (47,), "x-gzip": (47,), "deflate": (15, -15)}.get(coding.strip(), ()):
        undo = zlib.decompressobj(bits)
        try:
            return undo.decompress(payload)
        except zlib.error:
            continue
    return payload


CHARSET, META = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I), re.compile(rb"<meta\b[^<>]*?charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)


def page_text(headers: list[tuple[str, str]], payload: bytes) -> str:
    """A payload as text, by the charset of its headers, else of its first <meta>, else UTF-8."""
    raw = decoded(headers, payload)
    found = CHARSET.search(next((v for k, v in headers if k.lower() == "content-type"), ""))
    name = found[1] if found else (m[1].decode() if (m := META.search(raw[:4096])) else "utf-8")
    try:
        if not codecs.lookup(name)._is_text_encoding:
            name = "utf-8"
    except LookupError:
        name = "utf-8"
    return raw.decode(name, "replace")


def title_of(page: str) -> str | None:
    start = TITLE.search(closed(page))
    end = TITLE_END.search(page, start.end()) if start else None
    return " ".join(html.unescape(page[start.end() : end.start()]).split()) if end else None


def _record(kind: str, other: str, source: str, target, date, content_type: str, payload_digest: str, block: bytes) -> tuple:
    own = record_id(source, kind)
    fields = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", target), ("WARC-Refers-To-Date", date), ("WARC-Concurrent-To", record_id(source, other))]
    fields += [("WARC-Target-URI", target), ("WARC-Date", date), ("WARC-Block-Digest", digest(block)), ("Content-Type", content_type), ("Content-Length", len(block))]
    header = "\r\n".join([VERSION, *(f"{k}: {v}" for k, v in fields if v is not None)]) + "\r\n\r\n"
    return kind, own, source, target, date, content_type, payload_digest, digest(block), len(block), header, block.decode()


def derive(source: str | None, target: str | None, date: str | None, block: bytes | None, header: str | None = None) -> list[tuple]:
    """The metadata and the conversion record of a response."""
    block = block or b""
    source = source or record_id(target or "", date or "", digest(block))
    status, headers, payload = parse_http(block)
    page = page_text(headers, payload)
    fields = [("source-record-id", source), *((f"source-{k.lower()}", v) for k, s, v in (x.partition(":") for x in (header or "").split("\n")) if s and k.strip() and " " not in k.strip())]
    fields += [("source-status-line", status), *((f"source-header-{k.lower()}", v) for k, v in headers)]
    fields += [("source-block-digest", digest(block)), ("source-payload-digest", digest(payload)), ("source-payload-length", len(payload))]
    if (title := title_of(page)) is not None:
        fields.append(("title", title))
    fields += [("outlink", html.unescape(a or b or c)) for a, b, c in LINK.findall(closed(page))]
    flat = lambda v: " ".join(str(v).split())
    meta = "".join(f"{k.strip()}: {flat(v)}\r\n" for k, v in fields).encode()
    return [
        _record("metadata", "conversion", source, target, date, "application/warc-fields", digest(payload), meta),
        _record("conversion", "metadata", source, target, date, "text/plain; charset=utf-8", digest(payload), plain_text(page).encode()),
    ]


# --- WARC files ------------------------------------------------------------------------------------------------

#: What stands between records, and what a record starts with.
BETWEEN, START = "\r\n\r\nWARC/1.", "WARC/1."
RECORD = "file string, warc_type string, record string, target string, date string, header string, block binary, error string"


def _parsed(file: str, text: bytes) -> tuple[dict, str, bytes, int]:
    """Header fields in lower case, header lines, block so far and the bytes it should have."""
    head, _, block = text.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, s, v in (x.partition(":") for x in lines) if s}
    size = fields.get("content-length", "")
    return fields, "\n".join(lines), block, int(size) if size.isdigit() else -1


def _records(batches):
    """Parts between record starts as records: a block that holds such a start itself is joined again by its length."""
    held: tuple[str, bytes] | None = None

    def told(file: str, raw: bytes) -> dict:
        fields, header, block, size = _parsed(file, raw)
        short = size < 0 or len(block) < size
        return {"file": file, "warc_type": fields.get("warc-type"), "record": fields.get("warc-record-id"), "target": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "header": header, "block": block if short else block[:size], "error": "block is shorter than its length" if short else None}

    def whole(raw: bytes) -> bool:
        _, _, block, size = _parsed("", raw)
        return size < 0 or len(block) >= size

    names = [c.split()[0] for c in RECORD.split(", ")]
    schema = pa.schema([(c, pa.binary() if c == "block" else pa.string()) for c in names])
    for b in batches:
        rows = []
        for file, raw in zip(b.column("file").to_pylist(), b.column("raw").to_pylist(), strict=True):
            raw = raw or b""
            if held and held[0] == file and not whole(held[1]):
                held = (file, held[1] + BETWEEN.encode() + raw)
                continue
            if held:
                rows.append(told(*held))
            held = (file, raw if raw.startswith(START.encode()) else START.encode() + raw) if raw.strip() else None
        yield pa.RecordBatch.from_pylist(rows, schema)
    if held:
        yield pa.RecordBatch.from_pylist([told(*held)], schema)


def read_warc(spark, path: str) -> DataFrame:
    """Records of WARC files (.warc, .warc.gz): file, warc_type, record, target, date, header (lines), block, error.

    Files are cut between records as they are read, so a task holds some records, not a file. A block that is shorter than its
    Content-Length says so in ``error``.
    """
    text_batches(spark)
    parts = spark.read.option("lineSep", BETWEEN).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("raw"))
    return parts.mapInArrow(_records, RECORD)


def from_warc(spark, path: str) -> DataFrame:
    """Derived records of all response records of WARC files."""
    found = read_warc(spark, path).filter("warc_type = 'response'").withColumn("n", F.lit(None).cast("long"))
    return derivatives(found, "n", "record", "target", "date", "block", "header").drop("source_id")


def write_warc(records: DataFrame, path: str) -> None:
    """Derived records as WARC text files: a file per partition, a record after another."""
    records.select(F.concat("header", "block").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "none").text(path)


def derivatives(responses: DataFrame, id_col: str, record_col: str, target_col: str, date_col: str, block_col: str, header_col: str | None = None) -> DataFrame:
    """Two rows per response: the fields, header and block of its derived records."""
    text_batches(responses.sparkSession)

    def run(batches):
        for b in steps(batches, "block"):
            ids, rows = [], []
            for i, *record in zip(*(b.column(c).to_pylist() for c in ("source_id", "record", "target", "date", "block", "header")), strict=True):
                for r in derive(*record):
                    ids.append(i)
                    rows.append(r)
            cols = [pa.array(c, pa.int64() if n == "content_length" else pa.string()) for n, c in zip(COLUMNS, zip(*rows, strict=True), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *cols], ["source_id", *COLUMNS])

    picked = responses.select(F.col(id_col).cast("long").alias("source_id"), F.col(record_col).cast("string").alias("record"), F.col(target_col).cast("string").alias("target"), F.col(date_col).cast("string").alias("date"), F.col(block_col).cast("binary").alias("block"), (F.col(header_col) if header_col else F.lit(None)).cast("string").alias("header"))
    return picked.mapInArrow(run, SCHEMA)


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of crawled pages (page_id, url, html)."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    digest_hex = F.md5(F.concat_ws("|", F.col("page_id").cast("string"), "url"))
    name = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(digest_hex, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))
    return pages.select("page_id", name.alias("record"), F.col("url").alias("target"), F.lit(date).alias("date"), F.encode(F.concat(head, body), "UTF-8").alias("block"))


def op6_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return derivatives(responses(table(spark, sf_dir, "pages")), "page_id", "record", "target", "date", "block").withColumnRenamed("source_id", "page_id")

import hashlib
import zlib

import numpy as np
import pytest
from brute import awkward

from graphloom.llm import op10, webp
from graphloom.llm.common import table
from graphloom.llm.op10 import load, media, media_column, op10_webp_media, store

RNG = np.random.default_rng(4)
PHOTO = (RNG.integers(0, 1 << 32, (21, 37), dtype=np.uint64)).astype(np.uint32)
SMOOTH = (np.add.outer(np.arange(30) * 3, np.arange(45) * 2).astype(np.uint32) & 255) * np.uint32(0x010101) | np.uint32(webp.BLACK)
FEW = np.array([0xFF000000, 0xFF112233, 0x80FFEEDD, 0xFF00FF00], np.uint32)[RNG.integers(0, 4, (13, 19))]


@pytest.mark.parametrize("image", [PHOTO, SMOOTH, FEW, FEW[:1, :1], PHOTO[:1], PHOTO[:, :1], np.repeat(FEW, 90, 1)])
@pytest.mark.parametrize(
    "how",
    [{}, {"predict": 2}, {"cross": 3}, {"green": True}, {"cache_bits": 5}, {"meta_bits": 2}, {"predict": 3, "cross": 2, "green": True, "cache_bits": 8, "meta_bits": 3, "least_run": 3}],
)
def test_round_trip(image, how):
    assert (webp.decode(webp.encode(image, **how)) == image).all()


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 200, 256])
def test_palettes(n):
    colours = RNG.choice(1 << 32, n, replace=False).astype(np.uint32)
    image = colours[RNG.integers(0, n, (11, 23))]
    assert (webp.decode(webp.encode(image, palette=True)) == image).all()
    assert (webp.decode(webp.encode(image, palette=True, cache_bits=3, meta_bits=2)) == image).all()


def test_files_written_by_hand():
    # 1 x 1, no transforms, five codes of one symbol: alpha 255, red 1, green 2, blue 3
    w = webp.Writer()
    for v, n in ((0, 14), (0, 14), (1, 1), (0, 3), (0, 1), (0, 1), (0, 1)):
        w.put(v, n)
    for s in (2, 1, 3, 255, 0):
        for v, n in ((1, 1), (0, 1), (1, 1), (s, 8)):
            w.put(v, n)
    body = b"\x2f" + w.bytes()
    data = b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body
    assert webp.decode(data).tolist() == [[0xFF010203]]
    with pytest.raises(ValueError):
        webp.decode(b"RIFF0000WEBPVP8 " + b"\0" * 20)


def check(d, text, r):
    raw = (text or "").encode()
    pay = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
    assert (r.doc_id, r.n_bytes, r.payload_bytes) == (d, len(raw), len(pay))
    assert r.payload_sha256 == hashlib.sha256(pay).hexdigest() and r.tail_crc32 == zlib.crc32(pay[-32:])


def test_tables(spark, sf):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    got = op10_webp_media(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        check(r.doc_id, texts[r.doc_id], r)


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, "x" * 576), (4, "é" * 1000 + "\U0001f600"), (5, "a" * 6_000_000), (6, bytes(range(128)).decode() * 300), (6, "q"), (None, "q"), (7, "one word")]
    got = media_column(awkward(spark, rows)).collect()
    for (d, t), r in zip(sorted(rows, key=str), sorted(got, key=lambda r: str((r.doc_id, dict(((a, b) for a, b in rows)).get(r.doc_id)))), strict=True):
        assert r.doc_id == d
    by = {}
    for d, t in rows:
        by.setdefault(d, []).append(t)
    for r in got:
        assert any(hashlib.sha256((t or "").encode() + b"\xff" * ((-len((t or "").encode())) % 576 if t else 576)).hexdigest() == r.payload_sha256 for t in by[r.doc_id])
    assert media("q") == media("q")
    assert media_column(awkward(spark, rows).limit(0)).collect() == []


def test_stored_bytes_are_smaller_for_text():
    text = ("the quick brown fox " * 400).encode()
    pay = text + b"\xff" * (-len(text) % 576)
    assert len(store(pay)) < len(pay) * 0.7 and load(store(pay)).tobytes() == pay


def test_every_tool_stores_and_reads_back_texts(monkeypatch):
    import random

    rng = random.Random(3)
    texts = ["", "a", "ab" * 200, "x" * 5000, "line of text\n" * 400, "".join(rng.choice("etaoin shrdlu\n") for _ in range(7000)), "é漢😀" * 300, "".join(chr(rng.randrange(1, 0x2000)) for _ in range(2500)), "0101" * 140]
    for _, tools in [*op10.TOOLS, (0, op10.SMALL)]:
        monkeypatch.setattr(op10, "tools_for", lambda payload, tools=tools: tools)
        for t in texts:
            raw = t.encode()
            payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
            assert op10.load(op10.store(payload)).tobytes() == payload, (tools, t[:20])
    repeated = ("some words that come again and again in a line, " * 90).encode()[: 576 * 7]
    far, near = (webp.encode((np.frombuffer(repeated, np.uint8).astype(np.uint32) * op10.GREY | np.uint32(webp.BLACK)).reshape(-1, 576), green=True, far=f, least_run=48) for f in (True, False))
    assert len(far) < len(near) / 5


def test_tools_are_dealt_by_content(spark, sf):
    from graphloom.llm.common import table

    pad = lambda t: (raw := (t or "").encode()) + b"\xff" * ((-len(raw)) % 576 if raw else 576)
    used = {str(op10.tools_for(pad(r.text))) for r in table(spark, sf, "documents").collect()}
    assert used >= {str(t) for _, t in op10.TOOLS}
    assert op10.tools_for(pad("")) in [t for _, t in op10.TOOLS] + [op10.SMALL]


def test_predictors_by_row_equal_those_by_pixel():
    rng = np.random.default_rng(8)
    x = rng.integers(0, 1 << 32, (9, 41), dtype=np.uint32)
    for modes in ((1, 2), (0, 3, 4), (8, 9, 1), (2,), tuple(range(14)), (5, 11, 12, 13)):
        image = rng.choice(modes, (3, 11)).astype(np.uint32)
        assert (webp.decode(webp.encode(x, predict=2, modes=image)) == x).all(), modes

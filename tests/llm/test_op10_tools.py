"""Every text is stored with every tool, and read back through it, whatever its bytes are dealt to."""

import numpy as np
import pytest

from graphloom.llm import op10, webp, webp_many
from graphloom.llm.common import table

RNG = np.random.default_rng(11)


def tools_in(file: bytes) -> set:
    """The tools that a file of one image holds, read bit by bit."""
    bits = webp.Bits(file[21:])
    w, h = bits.take(14) + 1, bits.take(14) + 1
    bits.take(4)
    got = set()
    while bits.take(1):
        kind = bits.take(2)
        got.add({webp.PREDICT: "predict", webp.CROSS: "cross", webp.GREEN: "green", webp.PALETTE: "palette"}[kind])
        if kind in (webp.PREDICT, webp.CROSS):
            shift = bits.take(3) + 2
            image = webp._pixels(bits, (w + (1 << shift) - 1) >> shift, (h + (1 << shift) - 1) >> shift, False)
            if kind == webp.PREDICT and (image >> 8 & 15).any():
                got.add("modes")
            if kind == webp.CROSS and (image & 0xFFFFFF).any():
                got.add("multipliers")
        elif kind == webp.PALETTE:
            n = bits.take(8) + 1
            webp._pixels(bits, n, 1, False)
            w = w // 8 if n <= 2 else w // 4 if n <= 4 else w // 2 if n <= 16 else w
    if bits.take(1):
        bits.take(4)
        got.add("cache")
    if bits.take(1):
        shift = bits.take(3) + 2
        got.add("groups")
        if webp._pixels(bits, (w + (1 << shift) - 1) >> shift, (h + (1 << shift) - 1) >> shift, False).max() >> 8:
            got.add("two groups")
    return got


def padded(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)


def test_every_text_gets_every_tool(spark, sf):
    payloads = [padded(r.text) for r in table(spark, sf, "documents").collect()]
    stored = op10.store_all(payloads)
    seen = [tools_in(webp.files(m)[0]) for m in stored]
    for tools, payload in zip(seen, payloads, strict=True):
        small = len(payload) == 576 and len(set(payload)) <= 16
        assert tools >= ({"palette", "cache", "groups"} if small else {"green", "cross", "predict", "multipliers", "cache", "groups"})
        assert small or len(payload) == 576 or "modes" in tools  # the first row has no modes
    assert any("two groups" in s for s in seen)
    for payload, samples in zip(payloads, op10.load_all(stored), strict=True):
        assert samples.tobytes() == payload


def test_files_of_many_equal_those_of_one_and_the_single_decoder():
    texts = [b"a", b"word " * 900, RNG.bytes(5000).hex().encode(), b"0123456789" * 100, b"\n".join(b"line %d of many lines" % (i % 50) for i in range(900)), b"z" * 90_000]
    images = [op10.pixels(padded(t.decode())) for t in texts]
    together = webp_many.encode(images)
    assert together == [webp_many.encode([i])[0] for i in images]
    assert len(together[4]) < images[4].size  # a third of its samples
    for file, image, back in zip(together, images, webp_many.decode(together), strict=True):
        assert (back == image).all() and (webp.decode(file) == image).all()


@pytest.mark.parametrize("how", [{}, {"predict": 2}, {"cross": 3}, {"green": True}, {"cache_bits": 5}, {"meta_bits": 2}, {"palette": True}, {"green": True, "far": True}, {"predict": 3, "cross": 2, "green": True, "cache_bits": 8, "meta_bits": 3, "least_run": 3}])
def test_decoder_in_step_reads_what_the_single_encoder_wrote(how, monkeypatch):
    few = np.array([0xFF000000, 0xFF112233, 0x80FFEEDD, 0xFF00FF00], np.uint32)
    images = [few[RNG.integers(0, 4, (h, 37))] for h in (1, 2, 9, 30)] + [np.repeat(few[RNG.integers(0, 4, (5, 1))], 37, 1)]
    if "palette" not in how and "far" not in how:
        images += [RNG.integers(0, 1 << 32, (h, 37), dtype=np.uint64).astype(np.uint32) for h in (3, 14)]
    files = [webp.encode(i, **how) for i in images]
    for least in (0, 3, 24):  # all in step, the last three alone, all alone
        monkeypatch.setattr(webp_many, "FEW", least)
        for image, back in zip(images, webp_many.decode(files), strict=True):
            assert (image == back).all()


def test_wrong_files():
    file = webp_many.encode([op10.pixels(padded("some words " * 200))])[0]
    with pytest.raises(ValueError):
        webp_many.decode([b"RIFF0000WEBPVP8 " + b"\0" * 20])
    with pytest.raises(ValueError):
        webp_many.decode([file[:16] + (len(file) // 2).to_bytes(4, "little") + file[20 : 20 + len(file) // 2]] * 2)

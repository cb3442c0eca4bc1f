"""Media columns: bytes kept as lossless WebP pixels, read back by a full decoder, and features of the pixels.

A text's UTF-8 bytes, filled with 255 to a positive multiple of 576, become the red, green and blue samples of images 192 pixels
wide. Every text is written with all tools of the format but the palette, and read back through them: subtract-green,
cross-colour and predictors by block, each fitted to the text, a colour cache, references at any distance and groups of codes
where two shorten the file. An image of one row and at most 16 byte values gets a packed palette, a colour cache and groups of
codes instead. Images hold at most ``ROWS`` rows; longer texts give several files one after another. Bytes read back come from
the decoded pixel arrays alone.

Defined results: null text is empty text (576 bytes of 255); equal texts give equal values; ids may be
null or repeat; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import webp, webp_many
from .common import steps, text_batches

UNIT, WIDTH, ROWS = 576, 192, 8192
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
GREY = np.uint32(0x00010101)
#: Characters of text whose files are read together.
POOL = 12 << 20


#: What ``webp_many`` writes: every tool that is not the palette.
ALL = {"green": True, "cross": webp_many.SHIFT, "predict": webp_many.SHIFT, "meta_bits": webp_many.SHIFT, "cache_bits": "by size", "far": True}
TOOLS = (("every text", ALL),)
#: Settings of images of one row that a palette packs.
SMALL = {"palette": True, "cache_bits": 3, "meta_bits": 6}


def tools_for(payload: bytes) -> dict:
    """The encoder's settings for a text."""
    return SMALL if len(payload) == UNIT and len(set(payload)) <= 16 else ALL


def pixels(payload: bytes) -> np.ndarray:
    c = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 3).astype(np.uint32)
    return c[..., 0] << np.uint32(16) | c[..., 1] << np.uint32(8) | c[..., 2] | np.uint32(webp.BLACK)


def store_all(payloads: list[bytes]) -> list[bytes]:
    """For each payload its files, one after another."""
    out, together = [], []
    for k, payload in enumerate(payloads):
        tools, parts = tools_for(payload), [pixels(payload[i : i + ROWS * UNIT]) for i in range(0, len(payload), ROWS * UNIT)]
        if "palette" in tools and all(len(np.unique(p)) <= 256 for p in parts):
            out.append([webp.encode(p, **tools) for p in parts])
        else:
            out.append([])
            together += [(k, p) for p in parts]
    for (k, _), file in zip(together, webp_many.encode([p for _, p in together]), strict=True):
        out[k].append(file)
    return [b"".join(files) for files in out]


def load_all(stored: list[bytes]) -> list[np.ndarray]:
    """For each payload its samples, as rows, from the decoded pixels."""
    files = [webp.files(m) for m in stored]
    images = iter(webp_many.decode([f for own in files for f in own]))
    rows = [np.concatenate([next(images) for _ in own]) for own in files]
    return [np.ascontiguousarray(x, "<u4").view(np.uint8).reshape(-1, 4)[:, 2::-1].reshape(-1, UNIT) for x in rows]


def store(payload: bytes) -> bytes:
    """Files of pixels, one after another."""
    return store_all([payload])[0]


def load(media: bytes) -> np.ndarray:
    """The samples of stored files as rows."""
    return load_all([media])[0]


def feature(samples: np.ndarray) -> str:
    """Mean, deviation and a 64-bit hash: which of 64 stretches of samples are brighter than the mean."""
    flat = samples.ravel().astype(np.int64)
    parts = np.add.reduceat(flat, np.arange(64) * len(flat) // 64)
    size = np.diff(np.r_[np.arange(64) * len(flat) // 64, len(flat)])
    bits = parts * len(flat) > flat.sum() * size
    return f"{flat.mean():.4f};{flat.std():.4f};{np.packbits(bits).tobytes().hex()}"


def media_all(texts: list[str | None]) -> list[tuple]:
    raws = [(t or "").encode() for t in texts]
    kept = store_all([raw + b"\xff" * ((-len(raw)) % UNIT if raw else UNIT) for raw in raws])
    out = []
    for raw, stored, samples in zip(raws, kept, load_all(kept), strict=True):
        back = samples.tobytes()
        out.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(samples)))
    return out


def media(text: str | None) -> tuple:
    return media_all([text])[0]


def _rows(ids: list, texts: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    columns = zip(*media_all(texts), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [c.split()[0] for c in SCHEMA.split(", ")])


def _run(batches):
    # texts of several batches, since all are taken in one step
    ids, texts, size = [], [], 0
    for b in steps(batches):
        more = b.column("text").to_pylist()
        length = sum(len(t or "") for t in more)
        if texts and size + length > POOL:
            yield _rows(ids, texts)
            ids, texts, size = [], [], 0
        ids, texts, size = ids + b.column("doc_id").to_pylist(), texts + more, size + length
    if texts:
        yield _rows(ids, texts)


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_run, SCHEMA)


def op10_webp_media(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return media_column(table(spark, sf_dir, "documents"))

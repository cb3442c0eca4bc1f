"""Substring dedup with fixed-block anchors.

A window is ``window`` consecutive words of one document. A word goes if a window that covers it also
starts in a document of smaller id; all windows are judged on the input.

1. Every document is cut into reference blocks of ``(window + 1) // 2`` words that do not overlap. Each
   window holds one whole block of any document that contains it.
2. Every rolling sequence of that length probes the blocks. Hashes go packed to buckets by value, so the
   shuffle carries some bytes per word and a frequent passage spreads over as many buckets as it has words.
   A bucket keeps the smallest and largest document of a hash, never pairs.
3. Hits are extended: the windows around hit blocks and hit probes meet by a 96-bit hash, and the smallest
   document of each is the owner. The union of a document's owned-elsewhere windows is its maximal repeats.

Defined results: null or empty text has no words and the digest of the empty string; null ids and rows
that repeat an id never remove words of that same id; documents shorter than a window stay whole; other
columns are ignored. Equality is by hash (96 bits).
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets as buckets_of
from .common import discard, materialize, steps, text_batches
from .words import Words, grams, mix, place, whole

WINDOW = 13
PACK = "bucket int, hash binary, more binary, doc binary, tag binary, run binary, pos binary, flag binary"
U8, U16, U32, U64, I64 = np.uint8, np.uint16, np.uint32, np.uint64, np.int64


def _heads(*columns) -> np.ndarray:
    """Where a row differs from the one before it."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _ends(heads: np.ndarray, n: int) -> np.ndarray:
    return np.append(heads[1:], n)[: len(heads)]


def _packed(where, doc, tag, pos, **more) -> pa.RecordBatch:
    """One row per bucket ``where``: the documents (as runs), positions and further columns of its entries."""
    order = np.argsort(where, kind="stable")
    where, doc, pos = where[order], doc[order], pos[order]
    tag = np.zeros(len(doc), U32) if tag is None else tag[order]
    small = U16 if not len(pos) or pos.max() < 65536 else U32
    runs, heads = _heads(where, doc, tag), _heads(where)
    ends, size = _ends(heads, len(where)), np.diff(np.append(runs, len(where))).astype(U32)
    run_at = np.searchsorted(runs, np.append(heads, len(where)))
    columns = {"pos": pos.astype(small)} | {k: v[order] for k, v in more.items()}
    by_run = {"doc": doc[runs].astype(I64), "tag": tag[runs].astype(U32), "run": size.astype(U16 if not len(size) or size.max() < 65536 else U32)}
    out = {"bucket": pa.array(where[heads], pa.int32())}
    for k in ("hash", "more", "doc", "tag", "run", "pos", "flag"):
        if k in by_run:
            got = [by_run[k][i:j].tobytes() for i, j in zip(run_at[:-1], run_at[1:], strict=True)]
        else:
            got = [columns[k][i:j].tobytes() for i, j in zip(heads, ends, strict=True)] if k in columns else [b""] * len(heads)
        out[k] = pa.array(got[: len(heads)], pa.binary())
    return pa.RecordBatch.from_pydict(out)


def _unpacked(t: pa.Table) -> dict[str, np.ndarray]:
    def joined(name, kind):
        return np.frombuffer(b"".join(t.column(name).to_pylist()), kind)

    docs = [len(d) // 8 for d in t.column("doc").to_pylist()]
    runs = [np.frombuffer(r, U16 if len(r) == 2 * n else U32) for r, n in zip(t.column("run").to_pylist(), docs, strict=True)]
    size, run = [int(r.sum(dtype=I64)) for r in runs], np.concatenate([r.astype(I64) for r in runs])
    pos = [np.frombuffer(p, U16 if len(p) == 2 * n else U32).astype(U32) for p, n in zip(t.column("pos").to_pylist(), size, strict=True)]
    out = {"doc": np.repeat(joined("doc", I64), run), "tag": np.repeat(joined("tag", U32), run), "pos": np.concatenate(pos)}
    return out | {"hash": joined("hash", U32), "more": joined("more", U64), "flag": joined("flag", U8)}


def _replies(x: dict, keep: np.ndarray, flag: np.ndarray, buckets: int) -> pa.Table:
    """Entries on their way back to their documents, packed by document bucket."""
    doc = x["doc"][keep]
    batch = _packed(place(mix(doc.astype(U64)), buckets), doc, x["tag"][keep], x["pos"][keep], flag=flag[keep].astype(U8))
    return pa.Table.from_batches([batch])


def _ranges(doc, tag, pos) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of consecutive positions of sorted entries: index of the first entry, length."""
    n = len(doc)
    new = np.ones(n, bool)
    if n:
        new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (pos[1:] != pos[:-1] + 1)
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, n))


def _merge(block: int):
    """Replies of a document bucket as one row per document: stretches of flag 1 positions and of flag 2 blocks."""

    def run(t: pa.Table) -> pa.Table:
        x = _unpacked(t)
        out: dict[tuple, list[bytes]] = {}
        for bit, name in ((1, 0), (2, 1)):
            got = x["flag"] & bit > 0
            doc, tag, pos = x["doc"][got], x["tag"][got], x["pos"][got].astype(I64) // (block if bit == 2 else 1)
            order = np.lexsort((pos, tag, doc))
            doc, tag, pos = doc[order], tag[order], pos[order]
            keep = _heads(doc, tag, pos)
            doc, tag, pos = doc[keep], tag[keep], pos[keep]
            first, size = _ranges(doc, tag, pos)
            pairs = np.stack([pos[first], size], 1).astype(U32)
            heads = _heads(doc[first], tag[first])
            for i, j in zip(heads, _ends(heads, len(first)), strict=True):
                out.setdefault((int(doc[first[i]]), int(tag[first[i]])), [b"", b""])[name] = pairs[i:j].tobytes()
        keys = list(out)
        return pa.table({"doc_id": pa.array([k[0] for k in keys], pa.int64()), "tag": pa.array([k[1] for k in keys], pa.int64()), "late": pa.array([out[k][0] for k in keys], pa.binary()), "ref": pa.array([out[k][1] for k in keys], pa.binary())})

    return run


MERGED = "doc_id long, tag long, late binary, ref binary"


def _cover(ranges: bytes | None, n: int, reach: int, step: int = 1, back: int = 0) -> np.ndarray:
    """Which of n places lie in a stretch [start - back, last + reach) of the ranges."""
    edge = np.zeros(n + 1, I64)
    if ranges:
        r = np.frombuffer(ranges, U32).reshape(-1, 2).astype(I64)
        if step > 1:  # places of blocks, one by one
            start = np.repeat(r[:, 0], r[:, 1]) + np.arange(r[:, 1].sum()) - np.repeat(np.cumsum(r[:, 1]) - r[:, 1], r[:, 1])
            r = np.stack([start * step, np.ones_like(start)], 1)
        np.add.at(edge, np.clip(r[:, 0] - back, 0, n), 1)
        np.add.at(edge, np.clip(r[:, 0] + r[:, 1] - 1 + reach, 0, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _ids(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return b.column("doc_id").to_numpy(zero_copy_only=False).astype(I64), b.column("tag").to_numpy(zero_copy_only=False).astype(U32)


def _probes(block: int, window: int, buckets: int):
    def run(batches):
        for b in steps(batches):
            w = Words(b.column("text"))
            g = grams(w.hashes(), block)
            row = w.rows()[: len(g)]
            ok = whole(w.first, block) & (w.counts[row] >= window)
            row, g = row[ok], g[ok]
            if len(g):
                ids, _ = _ids(b)
                yield _packed(place(g, buckets), ids[row], None, np.flatnonzero(ok) - w.first[row], hash=g.astype(U32))

    return run


def _meet(block: int, buckets: int):
    def run(t: pa.Table) -> pa.Table:
        """Probes that hit a block of a smaller document (1), and blocks that a larger document hits (2)."""
        x = _unpacked(t)
        order = np.lexsort((x["doc"], x["hash"]))
        x = {k: x[k][order] for k in ("hash", "doc", "tag", "pos")}
        head = _heads(x["hash"])
        size = np.diff(np.append(head, len(order)))
        is_block = x["pos"] % block == 0
        least = np.repeat(np.minimum.reduceat(np.where(is_block, x["doc"], np.iinfo(I64).max), head), size)
        most = np.repeat(x["doc"][_ends(head, len(order)) - 1], size)
        flag = (least < x["doc"]) + 2 * (is_block & (most > x["doc"]))
        return _replies(x, flag > 0, flag, buckets)

    return run


def _windows(block: int, window: int, buckets: int):
    def run(batches):
        for b in steps(batches):
            w = Words(b.column("text"))
            hashes = w.hashes()
            g, g2 = grams(hashes, window), grams(hashes, window, seed=1)
            flag = np.zeros(len(g), U8)
            for i, (late, ref) in enumerate(zip(b.column("late").to_pylist(), b.column("ref").to_pylist(), strict=True)):
                n = int(w.counts[i]) - window + 1
                if n > 0:
                    mine = flag[w.first[i] : w.first[i] + n]
                    mine[_cover(late, n, 1, 1, window - block)] |= 1
                    mine[_cover(ref, n, 1, block, window - block)] |= 2
            pick = np.flatnonzero(flag)
            if len(pick):
                ids, tags = _ids(b)
                row = w.rows()[pick]
                yield _packed(place(g[pick], buckets), ids[row], tags[row], pick - w.first[row], hash=g[pick].astype(U32), more=g2[pick], flag=flag[pick])

    return run


def _owned(buckets: int):
    def run(t: pa.Table) -> pa.Table:
        """Windows that also start in a smaller document."""
        x = _unpacked(t)
        order = np.lexsort((x["doc"], x["more"], x["hash"]))
        x = {k: v[order] for k, v in x.items()}
        head = _heads(x["hash"], x["more"])
        least = np.repeat(x["doc"][head], np.diff(np.append(head, len(order))))
        return _replies(x, (least < x["doc"]) & (x["flag"] & 1 > 0), np.ones(len(order), U8), buckets)

    return run


def _kept(window: int, text_out: bool):
    def run(batches):
        for b in steps(batches):
            out, removed, counts, texts = [], [], [], []
            for text, late in zip(b.column("text").to_pylist(), b.column("late").to_pylist(), strict=True):
                words = (text or "").encode().split()
                gone = _cover(late, len(words), window) if late else None
                counts.append(len(words))
                removed.append(0 if gone is None else int(gone.sum()))
                kept = b" ".join(compress(words, ~gone) if removed[-1] else words)
                out.append(hashlib.sha256(kept).hexdigest())
                if text_out:
                    texts.append(kept.decode())
            cols = {"doc_id": b.column("doc_id"), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(out, pa.string())}
            yield pa.RecordBatch.from_pydict(cols | ({"text": pa.array(texts, pa.string())} if text_out else {}))

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, text_out: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and the kept text on request), one row per input row."""
    text_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    block, buckets = (window + 1) // 2, buckets_of(docs)
    back = max(1, buckets // 2)  # a bucket answers with a row for each of these
    docs = docs.withColumn("tag", F.crc32("text"))
    named = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")

    def merged(found: DataFrame, name: str) -> DataFrame:
        return materialize(found.groupBy("bucket").applyInArrow(_merge(block), MERGED), name)

    probes = named.mapInArrow(_probes(block, window, buckets), PACK)
    # hits are by id alone: for rows that share an id they only name more windows to look at
    hits = merged(probes.groupBy("bucket").applyInArrow(_meet(block, back), PACK), "op3-hits")
    # hits and marks grow with the corpus: never broadcast
    near = named.join(hits.drop("tag").hint("merge"), "doc_id").select("doc_id", "tag", "text", "late", "ref").mapInArrow(_windows(block, window, back), PACK)
    marks = merged(near.groupBy("bucket").applyInArrow(_owned(back), PACK), "op3-marks")
    discard(hits)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * text_out
    return docs.join(marks.hint("merge"), ["doc_id", "tag"], "left").select("doc_id", "text", "late").mapInArrow(_kept(window, text_out), schema)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return substring_dedup(table(spark, sf_dir, "documents"))

"""Benchmark decontamination: training passages query a BM25 index of test items with block-max WAND.

The index holds the test items: postings with the BM25 impact of each term in each item as a share of the item's own
score (the item as its own query), in blocks of ``BLOCK`` items, and for each term the blocks that it occurs in with its
largest impact there. All of it is sparse: it grows with the words of the items, not with terms times blocks. Every passage
of every document is a query:

1. Its list bound, the sum of each term's largest impact anywhere, drops most passages.
2. Pivot: of the others' terms, in order of their largest impact, those before the pivot could not reach the threshold
   without one after it. Only blocks in the lists of the terms up to the pivot are looked at; all others are skipped.
3. The bound of each such block is the sum of the passage's largest impacts in it. Only blocks that can reach the threshold
   are scored, and all items at or above it are retrieved.

A retrieved pair counts if ``overlap`` of the five-word sequences of the question and of the answer occur in
the passage; an item text without columns for them is split before its last sentence.

Passages depend on the length of the item alone. Items of up to 64 words, up to 256, and so on by fours are classes, each
with passages ``2 * stride`` words long every ``stride`` words, with a stride of one and a half times the class: an item,
also with half as many words again put in between, lies whole in one passage.

The index travels as a broadcast of at most ``INDEX_BYTES`` of item text; more items are taken in several such parts,
one pass over the documents each. Item statistics are those of all items, so the parts make no difference. No shuffle of the
documents.

Defined results: null or empty texts and items match nothing; rows that repeat a document give a row each; items with
equal text all match; a null id stays null; extra columns are ignored; long items and long texts are taken whole; empty
tables give an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps, text_batches
from .op4 import APART
from .words import U, Words, grams

SHINGLE, OVERLAP, SHARE, K1, B = 5, 0.8, 0.5, 1.2, 0.75
BLOCK, INDEX_BYTES = 16, 8 << 20
#: Words of the items of the first class, and list entries that a step looks at.
CLASS, STEP = 64, 1 << 18
SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, passages int"


def parted(text: str) -> tuple[str, str]:
    """Question and answer of an item that is one text: all before the last sentence, and that."""
    cut = [m.end() for m in re.finditer(r"[.!?\n]+\s*", text.rstrip(" .!?\n\t"))]
    return (text[: cut[-1]], text[cut[-1] :]) if cut else (text, "")


def _terms(texts: list[str]) -> list[np.ndarray]:
    w = Words(pa.array(texts, pa.large_string()), lower=True, space=APART)
    h = w.hashes()
    return [h[i:j] for i, j in zip(w.first[:-1], w.first[1:], strict=True)]


def _sequences(words: np.ndarray) -> np.ndarray:
    return np.unique(grams(words, min(SHINGLE, len(words)))) if len(words) else np.empty(0, U)


def strides(sizes: np.ndarray) -> np.ndarray:
    """The stride of the passages that items of these many words are looked for in."""
    least = CLASS * 4 ** np.maximum(0, np.ceil(np.log2(np.maximum(sizes, 1) / CLASS) / 2)).astype(np.int64)
    return 3 * least // 2


def _spread(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places first, first + 1, ... of each run, and which run each is of."""
    run = np.repeat(np.arange(len(size)), size)
    return np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size) + first[run], run


class Index:
    """Items of one part of the benchmark. ``df``: items with each term, ``total`` and ``mean``: of all items."""

    def __init__(self, items: list[tuple], df: dict[int, int], total: int, mean: float):
        words = _terms([f"{q}\n{a}" for _, q, a in items])
        # items of a class share blocks
        step = strides(np.array([len(w) for w in words]))
        order = np.argsort(step, kind="stable")
        items, words, self.stride = [items[i] for i in order], [words[i] for i in order], step[order]
        self.ids = np.array([i for i, _, _ in items], np.int64)
        self.question, self.answer = ([_sequences(w) for w in _terms([x[k] for x in items])] for k in (1, 2))
        self.sizes = [(len(q), len(a)) for q, a in zip(_terms([x[1] for x in items]), _terms([x[2] for x in items]), strict=True)]
        terms, impact, item, self.own = [], [], [], np.zeros(len(items))
        for i, w in enumerate(words):
            t, tf = np.unique(w, return_counts=True)
            n = np.array([df[int(x)] for x in t.view(np.int64)], float)
            one = np.log(1 + (total - n + 0.5) / (n + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean))
            self.own[i] = one.sum()
            terms.append(t)
            impact.append(one / one.sum())
            item.append(np.full(len(t), i))
        terms, impact, item = np.concatenate(terms), np.concatenate(impact), np.concatenate(item)
        self.vocabulary, tid = np.unique(terms, return_inverse=True)
        self.parts = [Postings(s, tid[keep], impact[keep], item[keep], len(self.vocabulary)) for s in np.unique(self.stride) if (keep := self.stride[item] == s).any()]

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)


class Postings:
    """Postings of the items of one class: an entry for each term and block with its largest impact, in order of both."""

    def __init__(self, stride: int, tid: np.ndarray, impact: np.ndarray, item: np.ndarray, width: int):
        order = np.lexsort((item, tid))
        self.stride, self.item, self.impact = int(stride), item[order], impact[order]
        self.blocks = int(item.max()) // BLOCK + 1
        key = tid[order] * self.blocks + self.item // BLOCK
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        self.key, self.at, self.end = key[at], at, np.append(at[1:], len(key))
        # sums of bounds may come out a little low
        self.top = np.maximum.reduceat(self.impact, at) * (1 + 1e-9)
        self.most = np.zeros(width)
        np.maximum.at(self.most, tid, impact)
        self.first = np.searchsorted(self.key, np.arange(width) * self.blocks)
        self.lists = np.searchsorted(self.key, (np.arange(width) + 1) * self.blocks) - self.first

    def entries(self, tid: np.ndarray, block: np.ndarray) -> np.ndarray:
        """The entry of each term and block, -1 where there is none."""
        key = tid * self.blocks + block
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, at, -1)


def retrieve(index: Postings, window: np.ndarray, tid: np.ndarray, share: float) -> list[tuple[int, int, float]]:
    """(window, item, share of the item's own score) at or above ``share``, for distinct (window, term) pairs by window."""
    least, out = share - 1e-9, []
    if not len(window):
        return out
    heads = np.flatnonzero(np.append(True, window[1:] != window[:-1]))
    size = np.diff(np.append(heads, len(window)))
    keep = np.add.reduceat(index.most[tid], heads) >= least
    inside = np.repeat(keep, size)
    window, tid, size = window[inside], tid[inside], size[keep]
    ends, spread = np.cumsum(size), np.cumsum(index.lists[tid])
    lo = 0
    while lo < len(size):  # some windows a step, so that what their lists spread to stays bounded
        a = int(ends[lo] - size[lo])
        most = int(np.searchsorted(spread, (spread[a - 1] if a else 0) + STEP, side="right"))
        hi = min(max(lo + 1, int(np.searchsorted(ends, most, side="right"))), lo + max(1, STEP // index.blocks))
        b = int(ends[hi - 1])
        out += _retrieved(index, window[a:b], tid[a:b], size[lo:hi], least)
        lo = hi
    return out


def _retrieved(index: Postings, window, tid, size, least) -> list[tuple[int, int, float]]:
    n = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((index.most[tid], n))  # within a window by largest impact, the pivot's side last
    window, tid = window[order], tid[order]
    first = np.cumsum(size) - size
    below = np.cumsum(index.most[tid])
    below = below - np.repeat((below - index.most[tid])[first], size)
    lead = below >= least  # all terms before the pivot together stay under the threshold
    width = len(size) * index.blocks

    def listed(term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window and block of each entry of these terms' lists, and the entry."""
        entry, run = _spread(index.first[tid[term]], index.lists[tid[term]])
        return n[term][run] * index.blocks + index.key[entry] % index.blocks, entry

    at, entry = listed(np.flatnonzero(lead))
    touched = np.zeros(width, bool)
    touched[at] = True
    # the other terms count in these blocks only: by their lists, or block by block where that is less
    left = touched.reshape(len(size), -1).sum(1)
    short = index.lists[tid] <= 8 * left[n]
    more = [(at, entry), listed(np.flatnonzero(~lead & short))]
    rest = np.flatnonzero(~lead & ~short)
    if len(rest):
        pair = np.flatnonzero(touched)
        of = np.searchsorted(n[rest], np.arange(len(size) + 1))
        term, which = _spread(of[:-1][pair // index.blocks], np.diff(of)[pair // index.blocks])
        entry = index.entries(tid[rest[term]], pair[which] % index.blocks)
        more.append((pair[which[entry >= 0]], entry[entry >= 0]))
    at, entry = (np.concatenate(x) for x in zip(*more, strict=True))
    good = touched & (np.bincount(at, weights=index.top[entry], minlength=width) >= least)
    keep = good[at]
    at, entry = at[keep], entry[keep]
    place, run = _spread(index.at[entry], index.end[entry] - index.at[entry])
    if not len(place):
        return []
    own = at[run] // index.blocks
    items = int(index.item.max()) + 1
    key = own * items + index.item[place]
    order = np.argsort(key, kind="stable")
    key, impact = key[order], index.impact[place][order]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    key, score = key[head], np.add.reduceat(impact, head)
    hit = score >= least
    return [(int(w), int(i), float(s)) for w, i, s in zip(window[first[key[hit] // items]], key[hit] % items, score[hit], strict=True)]


def found_in(index: Index, column: pa.Array, overlap: float, share: float) -> dict[tuple[int, int], list]:
    """(row, item) of each verified leak: largest score and overlaps, and how many passages."""
    w = Words(column, lower=True, space=APART)
    h = w.hashes()
    tid = index.look_up(h)
    row = w.rows()
    at = np.flatnonzero(tid >= 0)
    found: dict[tuple[int, int], list] = {}
    for part in index.parts:
        stride = part.stride
        last = np.maximum(0, -(-w.counts // stride) - 2)  # of each row's passages
        base = np.cumsum(last + 1) - (last + 1)
        k = np.minimum((at - w.first[row[at]]) // stride, last[row[at]])
        early = (k > 0) & ((at - w.first[row[at]]) < (k + 1) * stride)
        key = np.concatenate([base[row[at]] + k, (base[row[at]] + k - 1)[early]]) * len(index.vocabulary) + np.concatenate([tid[at], tid[at][early]])
        key = np.unique(key)
        seen: dict[int, np.ndarray] = {}
        for win, item, ratio in retrieve(part, key // len(index.vocabulary), key % len(index.vocabulary), share):
            r = int(np.searchsorted(base, win, side="right")) - 1
            if win not in seen:
                begin = w.first[r] + (win - base[r]) * stride
                seen[win] = h[begin : min(w.first[r + 1], begin + 2 * stride)]
            got = []
            for sequences, n in ((index.question[item], index.sizes[item][0]), (index.answer[item], index.sizes[item][1])):
                got.append(1.0 if not n else float(np.isin(sequences, grams(seen[win], min(SHINGLE, n))).mean()))
            if min(got) >= overlap:
                old = found.setdefault((r, item), [0.0, 0.0, 0.0, 0])
                found[r, item] = [max(old[0], round(ratio * index.own[item], 9)), max(old[1], got[0]), max(old[2], got[1]), old[3] + 1]
    return found


def _search(shared, overlap: float, share: float):
    def run(batches):
        index: Index = shared.value
        for batch in steps(batches):
            found = found_in(index, batch.column("text"), overlap, share)
            ids = batch.column("doc_id").to_pylist()
            if found:
                keys = list(found)
                cols = list(zip(*found.values(), strict=True))
                kinds = (pa.float64(), pa.float64(), pa.float64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([ids[r] for r, _ in keys], pa.int64()), pa.array(index.ids[[i for _, i in keys]], pa.int64()), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], [c.split()[0] for c in SCHEMA.split(", ")])

    return run


def _clean(shared, at: int, overlap: float, share: float):
    def run(batches):
        for batch in batches:
            for part in steps([batch], batch.schema.names[at]):
                keep = np.ones(part.num_rows, bool)
                keep[[r for r, _ in found_in(shared.value, part.column(at), overlap, share)]] = False
                yield part.filter(pa.array(keep))

    return run


def _item_terms(batches):
    for b in batches:
        w = _terms([f"{q}\n{a}" for q, a in zip(b.column("q").to_pylist(), b.column("a").to_pylist(), strict=True)])
        yield pa.RecordBatch.from_pydict({"item_id": b.column("item_id"), "n": pa.array([len(x) for x in w], pa.int64()), "terms": pa.array([np.unique(x).view(np.int64).tolist() for x in w], pa.list_(pa.int64()))})


def _split_items(batches):
    for b in batches:
        pairs = [parted(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_pydict({"item_id": b.column("item_id"), "q": pa.array([p[0] for p in pairs], pa.string()), "a": pa.array([p[1] for p in pairs], pa.string())})


def indexes(items: DataFrame, question: str | None = None, answer: str | None = None):
    """Broadcast indexes over blocks of the items, each of about ``INDEX_BYTES`` of text, with statistics of all items."""
    spark = items.sparkSession
    if question is None:
        parts = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).dropna().mapInArrow(_split_items, "item_id long, q string, a string")
    else:
        parts = items.select(F.col("item_id").cast("long"), F.coalesce(F.col(question), F.lit("")).alias("q"), F.coalesce(F.col(answer), F.lit("")).alias("a")).dropna()
    parts = parts.dropDuplicates(["item_id", "q", "a"])
    terms = parts.mapInArrow(_item_terms, "item_id long, n long, terms array<long>").filter("n > 0")
    total, mean = terms.agg(F.count(F.lit(1)), F.avg("n")).first()
    size = parts.agg(F.sum(F.length("q") + F.length("a"))).first()[0]
    blocks = -(-int(size) // INDEX_BYTES) if total else 0
    for b in range(blocks):
        some = parts.filter(F.expr(f"pmod(xxhash64(item_id), {blocks}) = {b}"))
        rows = sorted((r.item_id, r.q, r.a) for r in some.collect())  # about INDEX_BYTES of text
        rows = [r for r, w in zip(rows, _terms([f"{q}\n{a}" for _, q, a in rows]), strict=True) if len(w)]
        if rows:
            own = some.mapInArrow(_item_terms, "item_id long, n long, terms array<long>").select(F.explode("terms").alias("t")).distinct()
            df = {r.t: r.n for r in terms.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).join(own, "t", "left_semi").collect()}
            yield spark.sparkContext.broadcast(Index(rows, df, total, mean))


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", question: str | None = None, answer: str | None = None, overlap: float = OVERLAP, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, score (BM25), question_overlap, answer_overlap, passages: one row per document and item that leaks."""
    text_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for shared in indexes(items, question, answer):
        got = docs.mapInArrow(_search(shared, overlap, share), SCHEMA)
        out = got if out is None else out.unionByName(got)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", overlap: float = OVERLAP, share: float = SHARE) -> DataFrame:
    """The documents, with all their columns, in which no item leaks."""
    text_batches(docs.sparkSession)
    for shared in indexes(items):
        docs = docs.mapInArrow(_clean(shared, docs.columns.index(text_col), overlap, share), docs.schema)
    return docs


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

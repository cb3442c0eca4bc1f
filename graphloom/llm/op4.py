"""Toxicity by noisy-channel deobfuscation and a learned score.

1. A character language model: trigram counts over every text of the corpus, 28 classes (a to z, other letters,
   anything else), so at most 28^3 numbers reach the driver.
2. Suspicious stretches (words with a look-alike digit or symbol anywhere, letters repeated three times or more, three or
   more letters spaced out by any number of signs, words parted or masked by a sign inside; of any length) become lattices:
   each sign may stand for itself, for its look-alikes, be noise, or hide any letter. Viterbi decoding under the
   language model picks the reading, for spaced letters also one with word breaks, for words that end in punctuation
   also one without it; the restored words join the text's own.
3. A logistic regression over words and word beginnings, learned from labelled rows of the training folds only, scores
   the restored text. Features are chosen by class frequencies counted in Spark.

The classifier is fitted on at most ``SAMPLE`` labelled rows, chosen by a hash of their id; the language model and the
scores use every row. Ids, language and source are never inputs of a score.

Defined results: null and empty text score as a text without words; ids may be null (never held out) or repeat (each
row is scored); rows that repeat a label count once, labels that differ by their mean; labels that are null are left
out; without labels of both classes every score is the share of toxic labels (0 if there are none); extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import copy
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, steps, text_batches
from .words import LOWER, Words, buffer, mix

SAMPLE, FEATURES, THRESHOLD, FOLDS, HELD = 30_000, 3000, 0.3, 4, 2
#: Standard errors by which a feature's class frequencies must differ.
SURE = 4.5
CLASSES, OTHER = 28, 27
# Letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c"}
#: Class of each byte: 0 for what is no letter.
CLASS = np.zeros(256, np.int64)
CLASS[97:123] = np.arange(1, 27)
CLASS[65:91] = np.arange(1, 27)
CLASS[128:] = OTHER
#: What separates words for features.
APART = np.ones(256, bool)
APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: Log costs of the channel: a look-alike, a repeated letter kept once, noise between letters; gain for each letter kept.
SWAP, REPEAT, NOISE, KEPT = -0.7, -0.4, -0.5, 2.2
#: Signs that may hide a letter inside a word, and the log cost of each letter that they may hide.
MASKS, HIDDEN = "*#", -2.5
#: What may stand between spaced letters, and the log cost of reading it as the end of a word.
GAPS, BREAK = " ._*-", -1.0
SUSPECT = re.compile(
    r"(?P<spaced>(?<![\w!|+(])[!|+(]*(?:[a-z0-9@$!|+(][ ._*-]++){2,}[a-z0-9@$!|+(](?!\w))"
    r"|(?<![\w@$!|+(])[^\W0-9]*+[0-9@$!|+(][\w@$!|+(]*+(?:[-*#]++[\w@$!|+(]++)*+"
    r"|(?<!\w)[^\W0-9_]++(?:[-*#]++[\w@$!|+(]++)++"
    r"|\b\w*([a-z])\2\2\w*"
)
#: Look-alikes that are punctuation at the end of a word as often, and what a stretch must hold.
EDGE, LETTER, ALIKE = "!|+(", re.compile("[a-z]"), re.compile(r"[0-9@$!|+(]")
#: Stretches up to this length are kept decoded.
KNOWN = 64
#: 1: letter, 2: look-alike, 4: what may stand between spaced letters.
SIGN = np.zeros(256, np.uint8)
SIGN[[*range(65, 91), *range(97, 123)]] = 1
SIGN[[ord(c) for c in LEET]] = 2
SIGN[[ord(c) for c in " ._*-#"]] = 4


def suspicious(column: pa.Array) -> np.ndarray:
    """Which rows can hold a suspicious stretch: a look-alike beside a letter, a letter three times, or letters spaced out."""
    raw, at = buffer(column)
    if len(raw) < 3:
        return np.zeros(len(column), bool)
    kind, low = SIGN[raw], LOWER[raw]
    found = np.zeros(len(raw), bool)
    letter = kind == 1
    beside = letter | (raw == 95) | (raw >= 128)
    found[:-1] = ((kind[:-1] == 2) & beside[1:]) | (beside[:-1] & (kind[1:] == 2))
    found[:-2] |= letter[:-2] & (low[:-2] == low[1:-1]) & (low[1:-1] == low[2:])
    # runs of gaps count as one
    once = np.flatnonzero(np.append(True, (kind[1:] != 4) | (kind[:-1] != 4)))
    kind, raw, beside = kind[once], raw[once], beside[once]
    sign, gap = kind & 3 > 0, kind == 4
    inner = gap & (raw != 32) & (raw != 46) & (raw != 95)
    found[once[:-2]] |= beside[:-2] & inner[1:-1] & (beside[2:] | sign[2:])
    if len(once) > 4:
        found[once[:-4]] |= sign[:-4] & gap[1:-3] & sign[2:-2] & gap[3:-1] & sign[4:]
    seen = np.append(0, np.cumsum(found))
    return seen[at[1:]] > seen[at[:-1]]


# --- language model ------------------------------------------------------------------------------------------


def _trigrams(batches):
    total = np.zeros(CLASSES**3, np.int64)
    for b in steps(batches):
        raw, at = buffer(b.column("text"))
        c = CLASS[np.insert(raw, at[:-1], 32)]  # a boundary before each text
        c = c[(c > 0) | np.r_[True, c[:-1] > 0][: len(c)]]  # runs of other signs are one boundary
        if len(c) > 2:
            total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
    got = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"code": pa.array(got, pa.int32()), "n": pa.array(total[got], pa.int64())})


def language_model(docs: DataFrame) -> np.ndarray:
    """Log probability of a class after two others, interpolated with lower orders; at most 28^3 counts are collected."""
    rows = docs.select("text").mapInArrow(_trigrams, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(CLASSES**3)
    for r in rows:
        n[r.code] = r.n
    n = n.reshape(CLASSES, CLASSES, CLASSES)
    one = (n.sum((0, 1)) + 1) / (n.sum() + CLASSES)
    two = n.sum(0) + 20 * one
    two /= two.sum(1, keepdims=True)
    three = n + 20 * two
    return np.log(three / three.sum(2, keepdims=True))


# --- decoding ------------------------------------------------------------------------------------------------


def _readings(text: str, i: int) -> list[tuple[str, float]]:
    """Letters that the sign at i may stand for, '' for noise, and the channel's log cost."""
    c = text[i]
    if "a" <= c <= "z":
        out = [(c, 0.0)]
        run = i
        while run and text[run - 1] == c:
            run -= 1
        if run < i:  # a repeated letter: the third and later ones are rarely meant
            out = [(c, 0.0 if i - run == 1 else -8.0), ("", REPEAT if i - run > 1 or text[i + 1 : i + 2] == c else REPEAT - KEPT - 1.0)]
        return out
    if c in LEET:
        return [(x, SWAP) for x in LEET[c]] + [("", NOISE - 6.0)]
    if c in MASKS:
        return [(chr(x), HIDDEN) for x in range(97, 123)] + [("", NOISE)]
    return [("", NOISE)] if not c.isalpha() else [(c, 0.0)]


def decode(text: str, model: np.ndarray, breaks: bool = False) -> str:
    """The most likely letters of a suspicious stretch: states are the last two classes. With ``breaks`` what stands
    between letters may be the end of a word."""
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for i in range(len(text)):
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        readings = _readings(text, i)
        if breaks and text[i] in GAPS:
            readings = [*readings, (" ", BREAK)]
        for letter, cost in readings:
            k = (ord(letter) - 96 if "a" <= letter <= "z" else 0 if letter == " " else OTHER) if letter else 0
            for (a, b), (score, said) in states.items():
                if letter == " " and not b:
                    continue
                s = score + cost + (float(model[a, b, k]) + KEPT if letter else 0.0)
                key = (b, k) if letter else (a, b)
                if key not in after or s > after[key][0]:
                    after[key] = (s, (said, letter) if letter else said)
        states = after
    _, said = max(((s + float(model[a, b, 0]), said) for (a, b), (s, said) in states.items()), key=lambda x: x[0])
    out = []
    while said:
        said, letter = said
        out.append(letter)
    return "".join(reversed(out))


class Restorer:
    def __init__(self, model: np.ndarray):
        self.model = model
        self.known = lru_cache(50_000)(lambda t, breaks: decode(t, model, breaks))

    def read(self, stretch: str, breaks: bool = False) -> str:
        if len(stretch) > KNOWN:  # repeated letters in it come down to three first
            stretch = re.sub(r"([a-z])\1{2,}", r"\1\1\1", stretch)
        return (self.known if len(stretch) <= KNOWN else lambda t, breaks: decode(t, self.model, breaks))(stretch, breaks)

    def __call__(self, text: str) -> str:
        """The restored words of a text, joined by spaces. A stretch without a letter is a number."""
        out = []
        for m in SUSPECT.finditer(text.lower()):
            if not LETTER.search(m[0]):
                continue
            out.append(self.read(m[0]))
            core = m[0].strip(EDGE + GAPS if m["spaced"] else EDGE)
            if core != m[0] and ALIKE.search(core) and LETTER.search(core) or m["spaced"] and core != m[0]:
                out.append(self.read(core))
            if m["spaced"]:
                out.append(self.read(core, True))
        return " ".join(out)


# --- features and classifier ---------------------------------------------------------------------------------


def _hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each feature: words and word beginnings of 4, 5 and 6 bytes."""
    w = Words(column, lower=True, space=APART)
    row = w.rows()
    out = [w.hashes()]
    rows = [row]
    size = w.ends - w.starts
    for n in (4, 5, 6):
        pick = size > n
        short = Words.__new__(Words)
        short.data, short.starts, short.ends = w.data, w.starts[pick], w.ends[pick]
        out.append(mix(short.hashes(n) + np.uint64(n)))
        rows.append(row[pick])
    return np.concatenate(rows), np.concatenate(out)


def features(column: pa.Array, restore: Restorer) -> tuple[np.ndarray, np.ndarray, list[str]]:
    restored = [""] * len(column)
    for i in np.flatnonzero(suspicious(column)).tolist():
        restored[i] = restore(column[i].as_py())
    row, got = _hashes(column)
    if any(restored):
        more = _hashes(pa.array(restored, pa.string()))
        row, got = np.r_[row, more[0]], np.r_[got, more[1]]
    return row, got, restored


def _distinct(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[keep], value[keep]


def _class_counts(lm: np.ndarray):
    def run(batches):
        restore = Restorer(lm)
        for b in steps(batches):
            row, got = _distinct(*features(b.column("text"), restore)[:2])
            y = b.column("toxic").to_numpy(zero_copy_only=False)[row] >= 0.5
            value, at = np.unique(got, return_inverse=True)
            yes = np.bincount(at, weights=y, minlength=len(value)).astype(np.int64)
            n = np.bincount(at, minlength=len(value))
            yield pa.RecordBatch.from_pydict({"f": pa.array(value.view(np.int64)), "yes": pa.array(yes), "n": pa.array(n.astype(np.int64))})

    return run


def _look_up(vocabulary: np.ndarray, row: np.ndarray, got: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(vocabulary, got), len(vocabulary) - 1)
    hit = vocabulary[at] == got
    return _distinct(row[hit], at[hit])


def _examples(lm: np.ndarray, vocabulary: np.ndarray):
    def run(batches):
        restore = Restorer(lm)
        for b in steps(batches):
            row, at = _look_up(vocabulary, *features(b.column("text"), restore)[:2])
            cut = np.searchsorted(row, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_pydict({"toxic": b.column("toxic"), "at": pa.array([at[i:j].astype(np.uint16).tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})

    return run


def fit(y: np.ndarray, rows: list[np.ndarray], width: int, rounds: int = 400, ridge: float = 0.1) -> tuple[float, np.ndarray]:
    """Logistic regression with a small ridge, by accelerated gradient steps."""
    r, c = np.repeat(np.arange(len(rows)), [len(x) for x in rows]), np.concatenate(rows).astype(np.int64)
    each = np.bincount(c, minlength=width) + 1.0
    bias, w = float(np.log(y.mean() / (1 - y.mean()))), np.zeros(width)
    look, step, before = w.copy(), 1.0, bias
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(r, weights=look[c], minlength=len(y)), -30, 30)))
        grad = np.bincount(c, weights=(p - y)[r], minlength=width) + ridge * look
        new = look - 0.5 * grad / (each**0.5 * 4 + 1)
        look, w = new + k / (k + 3) * (new - w), new
        bias -= 0.5 * (p - y).mean() * 4
        if k > 20 and abs(bias - before) < 1e-6 and np.abs(grad).max() < 1e-3:
            break
        before = bias
    return bias, w


class Model:
    """Language model, vocabulary (sorted hashes) and weights; bounded by its parameters."""

    def __init__(self, lm, vocabulary, bias, weights):
        self.lm, self.vocabulary, self.bias, self.weights = lm, vocabulary, bias, weights

    def scores(self, column: pa.Array, restore: Restorer) -> tuple[np.ndarray, list[str]]:
        total, restored = np.full(len(column), self.bias), [""] * len(column)
        if len(self.vocabulary):
            row, got, restored = features(column, restore)
            row, at = _look_up(self.vocabulary, row, got)
            total += np.bincount(row, weights=self.weights[at], minlength=len(column))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30))), restored


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, n_features: int = FEATURES) -> Model:
    """Learn from labelled rows outside the held-out fold, at most ``sample`` of them."""
    text_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    lm = language_model(docs)
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("double").alias("toxic")).dropna()
    told = told.filter(F.crc32(F.col("doc_id").cast("string")) % FOLDS != HELD).groupBy("doc_id").agg(F.avg("toxic").alias("toxic"))
    told = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # the sample has at most ``sample`` rows of two numbers
    some = docs.join(F.broadcast(told), "doc_id")
    # an id that several rows have is one example, the least of its texts
    some = materialize(some.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic"), "op4-sample")
    n, yes = some.agg(F.count(F.lit(1)), F.sum(F.when(F.col("toxic") >= 0.5, 1).otherwise(0))).first()
    yes = yes or 0
    share_only = float(np.clip(np.log((yes + 1e-9) / (n - yes + 1e-9)), -30, 30)) if n else -30.0
    nothing = Model(lm, np.empty(0, np.uint64), share_only, np.empty(0))
    if not n or not yes or yes == n:
        return nothing
    counts = some.mapInArrow(_class_counts(lm), "f long, yes long, n long").groupBy("f").agg(F.sum("yes").alias("yes"), F.sum("n").alias("n"))
    share = F.col("n") / float(n)
    z = F.abs(F.col("yes") / float(yes) - (F.col("n") - F.col("yes")) / float(n - yes)) / F.sqrt(share * (1 - share) * (1 / yes + 1 / (n - yes)) + 1e-9)
    best = [r.f for r in counts.filter("n >= 3").withColumn("z", z).filter(F.col("z") >= SURE).orderBy(F.desc("z"), "f").limit(n_features).select("f").collect()]
    if not best:
        return nothing
    vocabulary = np.sort(np.array(best, np.int64).view(np.uint64))
    rows = some.mapInArrow(_examples(lm, vocabulary), "toxic double, at binary").collect()
    y = np.array([r.toxic for r in rows])
    bias, weights = fit(y, [np.frombuffer(r.at, np.uint16) for r in rows], len(vocabulary))
    return Model(lm, vocabulary, bias, weights)


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", name: str = "tox_score") -> DataFrame:
    """All columns of ``docs`` and the score."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        restore = Restorer(shared.value.lm)
        for b in batches:
            for part in steps([b], b.schema.names[at]):
                got, _ = shared.value.scores(part.column(at).cast(pa.string()), restore)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got)], [*part.schema.names, name])

    schema = copy.deepcopy(docs.schema).add(name, "double")
    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row."""
    model = train(docs, labels, id_col, text_col)
    rows = with_scores(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), model, name="score")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

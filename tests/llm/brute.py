"""Plain single-machine versions of the operators, and fixtures with awkward rows."""

import hashlib
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    raw = (text or "").encode()
    if lower:
        raw = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
    return WORD.findall(raw)


def substring_dedup(rows, window=13):
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def jaccard(rows, k=3, num=90, den=100):
    sets = []
    for _, t in rows:
        w = words(t, lower=True)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                both = len(sets[i] & sets[j])
                if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                    top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = d if r not in least or (d is not None and d < least[r]) else least[r]
    return [(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)]


def awkward(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long, score double, hits string, bucket int"):
    """Documents with clashing extra columns."""
    return spark.createDataFrame([(d, t, None, None, None, None, "x", 3) for d, t in rows], schema)

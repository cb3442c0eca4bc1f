import random

import numpy as np
from brute import awkward
from brute import jaccard as plain

from graphloom.llm import op7
from graphloom.llm.common import table
from graphloom.llm.components import connected


def test_equals_brute_force_on_the_tables(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in op7.op7_jaccard_join(spark, sf).collect()) == sorted(plain(rows))


def noisy(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return words


def family(seed):
    """Texts around the threshold: chains and clusters of near copies of several sizes."""
    rng = random.Random(seed)
    rows, i = [], 0
    for size in (4, 12, 25, 60, 130, 400):
        for _ in range(4):
            words = [f"w{rng.randrange(60)}" for _ in range(size)]
            for _ in range(14):
                rows.append((i, " ".join(words)))
                i += 1
                words = noisy(rng, words, rng.choice([0, 1, max(1, size // 60), max(1, size // 40)]))
    rng.shuffle(rows)
    return rows


def test_chains_of_near_copies(spark):
    rows = family(1)
    got = op7.jaccard_components(awkward(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(plain(rows))


def test_five_words_and_four_fifths(spark):
    rows = family(3)
    got = op7.jaccard_components(awkward(spark, rows), k=5, num=80).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(plain(rows, 5, 80))


def test_awkward_rows(spark):
    rows = family(2)[:60] + [(900, None), (901, ""), (902, " \n"), (903, "One"), (904, "one"), (905, "one two"), (906, "two one"), (None, "one"), (907, "É b c d"), (908, "é b c d"), (909, "a " * 90_000), (910, "a " * 70_000), (911, "z"), (911, "z")]
    rows += [(1000 + i, "an exact copy of the same text") for i in range(40)]
    rows += [(1100, "one id with two texts, the first"), (1100, "quite another text of one id"), (1050, "quite another text of one id")]
    got = op7.jaccard_components(awkward(spark, rows)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = [(d, n, None if d is None else 1050 if d == 1100 else c) for d, n, c in plain(rows)]
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(want, key=key)
    assert op7.jaccard_components(awkward(spark, rows).limit(0)).collect() == []


def test_signatures_meet_for_every_linked_pair():
    rng = np.random.default_rng(0)
    for n in (8, 10, 11, 19, 20, 57, 100, 333):
        for _ in range(60):
            base = rng.integers(0, 1 << 62, 2 * n).astype(np.uint64)
            cut = int(rng.integers(0, n // 10 + 1))
            a, b = base[:n], base[cut : n + int(rng.integers(0, n // 10 + 1))]
            both = len(np.intersect1d(a, b))
            for num in (80, 90):
                if not op7.enough(both, len(a), len(b), num, 100) or len(a) == len(b) == both:
                    continue
                row, value = np.r_[np.zeros(len(a), int), np.ones(len(b), int)], np.r_[np.sort(a), np.sort(b)]
                r, s = op7.signatures(row, value, np.array([len(a), len(b)]), num, 100)
                assert set(s[r == 0]) & set(s[r == 1])


def test_rtree_pages_lose_no_pair():
    rng = np.random.default_rng(1)
    points = np.minimum(rng.poisson(3, (400, 256)), 9).astype(np.uint8)
    points[200:] = points[:200]
    for i in range(200, 400):
        points[i, rng.integers(0, 256, 24)] += 1
    n, comp, tile = points.sum(1), np.arange(400) % 7, np.zeros(400, int)
    want = {(a, b) for a in range(400) for b in range(a) if comp[a] != comp[b] and op7.enough(np.minimum(points[a], points[b]).sum(), n[a], n[b], 90, 100)}
    got = op7.rtree_pairs([p.tobytes() for p in points], n, comp, tile, 90, 100)
    assert {(max(a, b), min(a, b)) for a, b in got.tolist()} == want and want
    points[5, 3] = op7.FULL  # a count that no longer fits bounds nothing
    got = {(max(a, b), min(a, b)) for a, b in op7.rtree_pairs([p.tobytes() for p in points], n, comp, tile, 90, 100).tolist()}
    assert {(max(5, b), min(5, b)) for b in range(400) if comp[b] != comp[5] and abs(int(n[b]) - int(n[5])) < 30} <= got


def test_points_bound_intersections_at_every_size():
    rng = np.random.default_rng(2)
    for n in (1, 3, 64, 65, 130, 1000, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.r_[a[: n - n // 5], rng.integers(0, 1 << 63, n, dtype=np.uint64)])
        row, value = np.r_[np.zeros(len(a), int), np.ones(len(b), int)], np.r_[a, b]
        p, q = op7.points(row, value, np.array([len(a), len(b)]))
        assert len(p) == max(64, op7.FINE << (len(a) - 1).bit_length())
        x, y = (op7.folded([z], min(len(p), len(q)))[0] for z in (p, q))
        assert x.sum() == len(a) and op7._minima(x, y) >= len(np.intersect1d(a, b))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (200, 100), (300, 300)] + [(500, i) for i in range(501, 560)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[200] == 100 and got[559] == 500 and 300 not in got

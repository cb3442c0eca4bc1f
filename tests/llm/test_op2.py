import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from brute import awkward
from tokenizers import Tokenizer

from graphloom.llm.common import table
from graphloom.llm.op2 import bins, best_fit, cross, evolve, fit_in, op2_best_fit_packing, pack, plan_bins, slots

CAP = 2048


def held(rows, got):
    """Pieces are the tokeniser's ids in order, and sequences are gapless from 0."""
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    want = []
    for d, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(d, k, at, len(ids[at : at + CAP]), zlib.crc32(ids[at : at + CAP].tobytes())) for k, at in enumerate(range(0, len(ids), CAP))]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    room = defaultdict(list)
    for r in got:
        room[r.sequence_id].append((r.offset, r.length))
    for spans in room.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= CAP
    total = sum(r.length for r in got)
    return len(room), -(-total // CAP)


def test_tables(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    used, least = held(rows, op2_best_fit_packing(spark, sf).collect())
    assert used <= least + 1


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "x" * 20_000), (3, "x" * 20_000), (4, "It's DON'T é É \x1c   naïve<|endoftext|> 12.5\t\r\n!!"), (5, "ha " * 9000)]
    rows += [(6, "İstanbul ΣΑΣ. ß ÿ. É, é. x.. x. ., a.b 'S. it's, don't. ×a ﬁ. Ǆ, 你好. a b. \x85  c. --. a1. 1. ª. µ, . K Å ẞ"), (7, "A.B.C, ȩ́x.\n\ny x.. e\u0301a. e\u0301")]
    held(rows, pack(awkward(spark, rows)).collect())
    assert pack(awkward(spark, rows).limit(0)).collect() == []


def test_plans_use_every_piece_once(spark):
    rng = random.Random(3)
    counts = {rng.randrange(300, CAP): rng.randrange(1, 40) for _ in range(200)}

    def used(plan):
        out = defaultdict(int)
        for p, n in plan:
            assert sum(p) <= CAP
            for s in p:
                out[s] += n
        return out

    a, b = best_fit(counts, CAP), best_fit(counts, CAP, rng)
    c = cross(a, b, counts, CAP, rng)
    assert used(a) == used(b) == used(c) == counts
    best = plan_bins(spark, counts)
    assert used(best) == counts and bins(best) <= bins(a)
    assert bins(evolve([], counts, CAP, 1, 2)[0]) <= bins(a)
    assert slots(best)[:, 0].tolist() == sorted(slots(best)[:, 0])


def triplets(n, seed):
    """Pieces that fill n sequences by threes, and hardly any other way."""
    rng, counts = random.Random(seed), {}
    for _ in range(n):
        a, b = rng.randrange(CAP // 4 + 20, CAP // 2 - 100), rng.randrange(CAP // 4 + 20, CAP // 2 - 100)
        for s in (a, b, CAP - a - b):
            counts[s] = counts.get(s, 0) + 1
    return counts


def test_evolution_wins_sequences_where_best_fit_alone_cannot(spark):
    for n in (40, 120):
        counts = triplets(n, n)
        greedy = bins(best_fit(counts, CAP))
        first = bins(evolve([], counts, CAP, 0, 0)[0])  # a population without generations
        best = plan_bins(spark, counts)
        assert n <= bins(best) < first <= greedy
        used = defaultdict(int)
        for p, k in best:
            assert sum(p) <= CAP
            for s in p:
                used[s] += k
        assert used == counts


def test_migration_brings_the_elite(spark):
    counts = triplets(60, 4)
    good = plan_bins(spark, counts)
    poor = evolve([], counts, CAP, 9, 0)
    assert bins(good) < bins(poor[0]) and bins(evolve([*poor, good], counts, CAP, 9, 1)[0]) <= bins(good)


def test_displaced_pieces_take_the_tightest_room():
    left = {100: 3, 60: 1, 900: 1}
    plan = fit_in([((CAP - 120,), 2), ((CAP - 100,), 1), ((CAP - 500, 300), 1)], left, CAP)
    assert sorted(plan) == sorted([((CAP - 100, 100), 1), ((CAP - 120, 100), 2), ((CAP - 500, 300, 60), 1)]) and left == {100: 0, 60: 0, 900: 1}

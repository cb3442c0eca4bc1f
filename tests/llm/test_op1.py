import random
import re

import numpy as np
from brute import awkward

from graphloom.llm import op1
from graphloom.llm.common import table

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(t):
    return WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))


def runs(w, k):
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def plain(rows, items):
    """Pairs whose question and answer overlap some passage, over all pairs."""
    items = [(i, *op1.parted(t)) for i, t in items if t and words(t)]
    out = set()
    for d, t in rows:
        w = words(t)
        for i, q, a in items:
            stride = 96
            while stride < 1.5 * len(words(q + "\n" + a)):
                stride *= 4
            last = max(0, -(-len(w) // stride) - 2)
            for k in range(last + 1):
                own = w[k * stride : (k + 2) * stride]
                ok = True
                for x in (words(q), words(a)):
                    n = min(5, len(x))
                    ok = ok and (not n or len(runs(x, n) & runs(own, n)) >= 0.8 * len(runs(x, n)))
                    if not ok:
                        break
                if ok:
                    out.add((d, i))
    return out


def test_equals_brute_force_on_the_tables(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    got = op1.op1_decontamination(spark, sf).collect()
    assert {(r.doc_id, r.item_id) for r in got} == plain(rows, items) and len(got)
    assert all(r.question_overlap >= 0.8 and r.answer_overlap >= 0.8 and r.score > 0 for r in got)


def test_awkward_rows(spark, monkeypatch):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, some(rng.randrange(20, 50)) + ". " + some(rng.randrange(1, 9)) + ".") for i in range(60)] + [(70, "tiny"), (71, None), (72, ""), (73, "two parts. ok"), (73, "two parts. ok"), (80, some(400) + ". " + some(5) + "."), (81, some(120) + ". yes")]
    rows = []
    for i in range(120):
        text = some(rng.randrange(0, 400)).split()
        if i % 3 == 0:
            leak = items[rng.randrange(60)][1].upper().split()
            for _ in range(rng.randrange(0, 4)):
                leak[rng.randrange(len(leak))] = "zz"
            at = rng.randrange(len(text) + 1)
            text[at:at] = leak
        rows.append((i, " ".join(text)))
    rows += [(500, None), (501, ""), (None, items[3][1]), (502, items[4][1]), (502, items[4][1]), (503, "x " * 100_000 + items[5][1])]
    rows += [(504, some(90) + " " + next(t for i, t in items if i == 80)), (505, next(t for i, t in items if i == 81) + " " + some(300))]
    docs, bench = awkward(spark, rows), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = op1.leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == plain(rows, items)
    assert len([r for r in got if r.doc_id == 502 and r.item_id == 4]) == 2
    assert op1.leaks(docs.limit(0), bench).collect() == [] and op1.leaks(docs, bench.limit(0)).collect() == []
    assert len({i for _, i in plain(rows, items)} & {80, 81}) == 2
    want = sorted(map(str, got))
    for size in (700, 3000, 20_000):  # many parts, some, and one
        monkeypatch.setattr(op1, "INDEX_BYTES", size)
        assert sorted(map(str, op1.leaks(docs, bench).collect())) == want
        assert op1.without_leaks(docs, bench).count() == len(rows) - len({str((r.doc_id)) for r in got}) - 1


def test_block_bounds_lose_no_item(monkeypatch):
    rng = np.random.default_rng(0)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 200, n))
    items = [(i, text(30), text(5)) for i in range(70)]
    terms = op1._terms([f"{q}\n{a}" for _, q, a in items])
    df = {}
    for w in terms:
        for t in np.unique(w).view(np.int64).tolist():
            df[t] = df.get(t, 0) + 1
    mean = np.mean([len(w) for w in terms])
    index = op1.Index(items, df, 70, mean)
    win, tid = [], []
    for k in range(50):
        w = np.unique(index.look_up(op1._terms([text(90) + " " + items[k][1]])[0]))
        w = w[w >= 0]
        win += [k] * len(w)
        tid += w.tolist()
    win, tid = np.array(win), np.array(tid)
    want = set()
    for k in range(50):
        mine = set(tid[win == k].tolist())
        for i in range(70):
            w = terms[i]
            t, tf = np.unique(w, return_counts=True)
            n = np.array([df[x] for x in t.view(np.int64).tolist()], float)
            one = np.log(1 + (70 - n + 0.5) / (n + 0.5)) * tf * (op1.K1 + 1) / (tf + op1.K1 * (1 - op1.B + op1.B * len(w) / mean))
            score = sum(x for j, x in zip(index.look_up(t).tolist(), one, strict=True) if j in mine) / one.sum()
            if score >= 0.5:
                want.add((k, i))
    (part,) = index.parts
    for step in (1 << 20, 50, 1):
        monkeypatch.setattr(op1, "STEP", step)
        got = op1.retrieve(part, win, tid, 0.5)
        assert {(k, i) for k, i, _ in got} == want and len(want) >= 50 and len(got) == len(want)

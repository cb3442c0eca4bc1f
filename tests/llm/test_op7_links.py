import numpy as np
from brute import awkward, words

from graphloom.llm import op7
from graphloom.llm.common import table
from test_op7 import family


def links(rows, k=3, num=90, den=100):
    sets = []
    for d, t in rows:
        w = words(t, lower=True) if d is not None else []
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    n = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                n[i] += 1
                n[j] += 1
    return [(d, x) for (d, _), x in zip(rows, n, strict=True)]


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.n_links) for r in got), key=key) == sorted(want, key=key)


def test_links_equal_brute_force(spark, sf, monkeypatch):
    same(op7.op7_jaccard_join(spark, sf).collect(), links([(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]))
    rows = family(1) + [(900, None), (901, ""), (902, "One"), (903, "one"), (None, "one")] + [(1000 + i, "an exact copy of the same text") for i in range(40)]
    rows += [(2000, rows[7][1]), (2000, rows[7][1] + " more")]  # two near texts of one id
    got = op7.jaccard_components(awkward(spark, rows), links=True).collect()
    same(got, links(rows))
    monkeypatch.setattr(op7, "LINK_BYTES", 2000)  # several tiles of a component
    same(op7.jaccard_components(awkward(spark, rows), links=True).collect(), links(rows))
    few = op7.linked_copies
    sets = [np.arange(i, i + 40, dtype=np.uint64) for i in (0, 1, 2, 30, 31, 100)]
    copies, one = np.array([1, 2, 3, 4, 5, 6]), np.zeros(6, int)
    whole = few(sets, copies, one, 90, 100)
    assert whole.tolist() == [2 + 3, 1 + 3, 1 + 2, 5, 4, 0]
    for i, j in ((2, 3), (1, 4)):  # in two tiles: what is within one is counted there
        own = (np.arange(6) >= i).astype(int)
        within = np.r_[few(sets[:i], copies[:i], one[:i], 90, 100), few(sets[i:], copies[i:], one[i:], 90, 100)]
        assert (few(sets, copies, own, 90, 100) + within).tolist() == whole.tolist()
    # links between different texts of one component, which a search between components leaves out
    assert any(r.n_links >= r.n_copies for r in got) and op7.jaccard_components(awkward(spark, rows).limit(0), links=True).collect() == []

import numpy as np
import pyarrow as pa
import pytest
from brute import awkward

from graphloom.llm import op4
from graphloom.llm.common import table


@pytest.fixture(scope="module")
def lm(spark):
    return op4.language_model(table(spark, "/root/testdata/sf0.01", "documents").select("text"))


def test_language_model_is_counted_over_all_texts(spark, sf, lm):
    assert np.allclose(np.exp(lm).sum(2), 1)
    texts = [r.text for r in table(spark, sf, "documents").collect()]
    n = np.zeros(op4.CLASSES**3, np.int64)
    for t in texts:
        c, k = [0], b" " + t.encode()
        for b in k[1:]:
            x = int(op4.CLASS[b])
            if x or c[-1]:
                c.append(x)
        for i in range(len(c) - 2):
            n[(c[i] * 28 + c[i + 1]) * 28 + c[i + 2]] += 1
    got = np.zeros_like(n)
    for r in table(spark, sf, "documents").select("text").repartition(1).mapInArrow(op4._trigrams, "code int, n long").groupBy("code").sum("n").collect():
        got[r[0]] = r[1]
    assert abs(int(got.sum()) - int(n.sum())) <= 2 * len(texts)


@pytest.mark.parametrize("noisy, word", [("you 1d10t", "idiot"), ("m0r0n!", "moron"), ("i d i o t", "idiot"), ("looooser", "loser"), ("w0rthl3ss", "worthless"), ("p@thetic", "pathetic"), ("$tupid", "stupid"), ("cl0wn", "clown"), ("i.d.i.o.t", "idiot"), ("iiidddiiiooottt", "idiot")])
def test_decoding(lm, noisy, word):
    assert word in op4.Restorer(lm)(noisy).split()
    assert op4.suspicious(pa.array([noisy]))[0]


def test_clean_text_is_left_alone(lm):
    assert op4.Restorer(lm)("A good committee will meet, all told, in room 12.") == ""
    assert not op4.suspicious(pa.array(["A good committee will meet, all told, in room 12."]))[0]
    assert op4.Restorer(lm)("a" * 100_000)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in op4.op4_toxicity(spark, sf).collect()}
    labels = [(r.doc_id, r.toxic) for r in table(spark, sf, "labels").collect()]
    held = [(got[d].score, t) for d, t in labels if got[d].held_out]
    toxic, clean = [s for s, t in held if t], [s for s, t in held if not t]
    assert np.mean([a > b for a in toxic for b in clean]) > 0.95
    assert np.mean(np.array(clean) >= 0.3) < 0.02
    assert len(got) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_obfuscated_words_are_caught_and_only_training_folds_are_used(spark):
    import zlib

    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    rows = [(i, ("such an idiot here " if i % 3 == 0 else "such a nice person here ") + "and the other words are the same " * 3) for i in range(300)]
    labels = [(i, int(i % 3 == 0) if not held(i) else int(i % 3 != 0)) for i, _ in rows]
    rows += [(1000, "such an 1d10t here"), (1001, "i d i o t"), (1002, None), (1003, ""), (None, "nice"), (1004, "IDIOT " * 20_000), (1004, "same id")]
    docs, told = awkward(spark, rows), spark.createDataFrame(labels + [(None, 1), (7, None)], "doc_id long, toxic int")
    got = {}
    for r in op4.toxicity(docs, told).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert all(got[i][0].predicted == (i % 3 == 0) for i in range(300))
    assert got[1000][0].predicted and got[1001][0].predicted and len(got[1004]) == 2 and got[1002][0].score == got[1003][0].score
    assert not got[None][0].held_out
    assert op4.toxicity(docs.limit(0), told).collect() == []
    assert {round(r.score, 9) for r in op4.toxicity(docs, told.limit(0)).collect()} == {0.0}  # no labels: none is toxic
    assert {round(r.score, 9) for r in op4.toxicity(docs, told.filter("toxic = 1")).collect()} == {1.0}

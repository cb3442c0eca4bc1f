import pyarrow as pa
import pytest
from test_op4 import lm  # noqa: F401

from graphloom.llm import op4

FORMS = [("idio7", "idiot"), ("a$$", "as"), ("h473", "hate"), ("w0rthl355", "worthless"), ("idio7!", "idiot"), ("s c u m.", "scum"), ("(m o r o n)", "moron"), ("i-d-i-o-t!", "idiot"), ("i d i o t,", "idiot"), ("d i e", "die"), ("1 d 1 0 t", "idiot"), ("y o u a r e a n i d i o t", "idiot"), ("idi-ot", "idiot"), ("st*pid", "stupid"), ("m#ron", "moron"), ("i  d  i  o  t", "idiot"), ("i - d - i - o - t", "idiot"), ("1d-10t", "idiot"), ("antidisestablishm3ntarianism", "antidisestablishmentarianism"), ("x" + "!" * 100_000 + " 1d10t", "idiot")]


@pytest.mark.parametrize("noisy, word", FORMS)
def test_trailing_punctuated_and_spaced_forms(lm, noisy, word):  # noqa: F811
    assert op4.suspicious(pa.array([noisy]))[0]
    assert word in op4.Restorer(lm)(noisy).split()


def test_long_stretches_are_read_in_one(lm):  # noqa: F811
    long = "w0rthless" * 20
    assert op4.Restorer(lm)(long).split() == ["worthles" * 19 + "worthless"]  # the model drops one s between the words
    spaced = " ".join("idiot" * 30)
    assert "idiot" * 30 in op4.Restorer(lm)(spaced).split()
    assert op4.Restorer(lm)("455 1 2 3 4") == ""


def likely(text, model, said, breaks=False):
    """The score of one choice of readings."""
    score, a, b = 0.0, 0, 0
    for i, letter in enumerate(said):
        readings = op4._readings(text, i) + ([(" ", op4.BREAK)] if breaks and text[i] in op4.GAPS else [])
        score += dict(readings)[letter]
        if letter:
            k = ord(letter) - 96 if "a" <= letter <= "z" else 0 if letter == " " else op4.OTHER
            if letter == " " and not b:
                return None
            score += float(model[a, b, k]) + op4.KEPT
            a, b = b, k
    return score + float(model[a, b, 0])


@pytest.mark.parametrize("breaks", [False, True])
def test_viterbi_equals_enumeration(lm, breaks):  # noqa: F811
    import itertools
    import random

    rng = random.Random(5)
    for _ in range(120):
        text = "".join(rng.choice("aidot10$5!é *-") for _ in range(rng.randrange(1, 6)))
        options = [[x for x, _ in op4._readings(text, i)] + ([" "] if breaks and text[i] in op4.GAPS else []) for i in range(len(text))]
        every = {}
        for said in itertools.product(*options):
            score = likely(text, lm, said, breaks)
            if score is not None:
                every["".join(said)] = max(score, every.get("".join(said), -1e9))
        assert every[op4.decode(text, lm, breaks)] >= max(every.values()) - 1e-9


def test_an_id_with_many_rows_is_one_example(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    rows = [(i, ("nasty", "kind")[i % 2] + " text") for i in range(40)]
    once, often = (op4.train(spark.createDataFrame(r, "doc_id long, text string"), labels) for r in (rows, rows + [rows[1]] * 500))
    assert len(once.weights) and abs(once.bias - often.bias) < 1e-6 and abs(once.weights - often.weights).max() < 1e-6

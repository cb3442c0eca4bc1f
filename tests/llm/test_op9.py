import hashlib
import re

from brute import awkward

from graphloom.llm.common import table
from graphloom.llm.op9 import detect, op9_pii, reliabilities

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def plain(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    got = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    got += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    got += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    got += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    said = ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{s}:{e}" for s, k, e in sorted(got))
    return (*(sum(k == i for _, k, _ in got) for i in range(4)), hashlib.sha256(said.encode()).hexdigest(), said)


def check(rows, got):
    want = sorted((d is None, d or 0, plain(t)[:5]) for d, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)) for r in got) == want
    texts = {}
    for d, t in rows:
        texts.setdefault(d, []).append(set(plain(t)[5].split(",")) - {""})
    for r in got:
        assert any(s <= set(r.spans.split(",")) for s in texts[r.doc_id])


HARD = [
    (1, None), (2, ""), (3, "a@b.c_d@e.f x@y @z.w a@b. q@r.s.t."), (4, "é\U0001f600 1.2.3.4.5 256.1.1.1 001.02.003.0004 1.2.3 99999999999.1.1.1"),
    (5, "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 5500 0000 0000 0004x"), (6, "+1 (415) 555-2671 +33 1 23 45 67 89 +44) 12 +1234567890123456"),
    (7, "call 415-555-2671 or 123-45-6789 IBAN DE89 3704 0044 0532 0130 00"), (7, "call 415-555-2671 or 123-45-6789 IBAN DE89 3704 0044 0532 0130 00"), (None, "me@here.org"),
    (8, "x" * 100_000), (9, "a.b@c.de " * 300), (10, "1 " * 30 + "- 2"), (11, "١٢.1.1.1 +١123456789"),
]


def test_tables(spark, sf):
    check([(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()], op9_pii(spark, sf).collect())


def test_awkward_rows(spark):
    got = detect(awkward(spark, HARD)).collect()
    check(HARD, got)
    assert detect(awkward(spark, HARD).limit(0)).collect() == []


def test_method_adds_spans(spark):
    rows = [(i, f"please call 415-555-{1000 + i} now") for i in range(40)] + [(100 + i, f"order 1{i:02d}.999.3.4 page") for i in range(40)]
    got = {r.doc_id: r for r in detect(awkward(spark, rows)).collect()}
    assert got[3].spans == "other:12:24" and got[3].n_other == 1
    assert got[103].spans == ""


def test_expectation_maximisation_finds_the_bad_labeler():
    patterns = [(0, (1, 1, 1, 1), 70), (0, (1, 1, -1, 1), 60), (0, (-1, -1, 1, -1), 60), (0, (-1, -1, -1, -1), 70)]
    posterior, told = reliabilities(patterns)
    assert posterior[(0, (1, 1, -1, 1))] > 0.9 and posterior[(0, (-1, -1, 1, -1))] < 0.1
    rate = told[0][1]
    assert rate[0][0][1] > 0.9 > 0.7 > rate[2][0][1]


def iban(rng, country, n):
    body = "".join(rng.choice("0123456789") for _ in range(n - 4))
    digits = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{country}{98 - int(digits) % 97:02}{body}"


def test_added_spans_have_recall_and_precision(spark):
    """Other forms planted among decoys of the same looks, with and without cue words."""
    import random

    rng = random.Random(4)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows, want = [], {}
    words = "the quick brown fox meets a lazy dog near old water mill and goes on".split()
    for i in range(600):
        kind = i % 6
        if kind == 0:
            value, cue = f"{rng.randrange(2, 10)}{rng.randrange(9)}{number(1)}-{rng.randrange(2, 10)}{number(2)}-{number(4)}", rng.choice(["call ", "tel ", "phone ", ""])
        elif kind == 1:
            value, cue = f"{rng.randrange(100, 600):03}-{rng.randrange(1, 99):02}-{rng.randrange(1, 9999):04}", rng.choice(["ssn ", "social ", ""])
        elif kind == 2:
            c = rng.choice([("DE", 22), ("GB", 22), ("FR", 27), ("NL", 18), ("ES", 24)])
            value, cue = iban(rng, *c), rng.choice(["iban ", "account ", ""])
        elif kind == 3:
            value, cue = f"{rng.choice('01')}{number(2)}-{rng.choice('01')}{number(2)}-{number(4)}", rng.choice(["order ", "invoice ", ""])
        elif kind == 4:
            value, cue = f"{rng.choice(['000', '666', '9' + number(2)])}-{number(2)}-{number(4)}", rng.choice(["part ", "order ", "page "])
        else:
            bad = iban(rng, rng.choice(["DE", "QQ", "ZX"]), 22)
            value, cue = bad[:2] + f"{(int(bad[2:4]) + 3) % 97:02}" + bad[4:], rng.choice(["version ", "order ", ""])
        said = [rng.choice(words) for _ in range(8)]
        text = " ".join(said[:4]) + " " + cue + value + " " + " ".join(said[4:])
        at = len(" ".join(said[:4]) + " " + cue)
        rows.append((i, text))
        if kind < 3:
            want[i] = f"other:{at}:{at + len(value)}"
    got = {r.doc_id: r.spans for r in detect(awkward(spark, rows)).collect()}
    hit = sum(got[i] == s for i, s in want.items())
    false = sum(bool(s) and want.get(i) != s for i, s in got.items())
    assert hit / len(want) >= 0.9 and hit / (hit + false) >= 0.9, (hit, len(want), false)


def test_account_numbers_and_example_numbers(spark):
    rows = [(i, "iban DE89 3704 0044 0532 0130 00 here") for i in range(30)] + [(100 + i, "code DE88 3704 0044 0532 0130 00 here") for i in range(30)] + [(200 + i, f"ssn 12{i % 9 + 1}-4{i % 10}-678{i % 9 + 1} x") for i in range(30)] + [(300 + i, "order 000-45-6789 x") for i in range(30)]
    got = {r.doc_id: r.n_other for r in detect(awkward(spark, rows)).collect()}
    assert got[0] == 1 and got[100] == 0 and got[200] == 1 and got[300] == 0

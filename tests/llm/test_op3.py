import random

from brute import awkward, substring_dedup as plain

from graphloom.llm.common import table
from graphloom.llm.op3 import op3_substring_dedup, substring_dedup


def test_equals_brute_force_on_the_tables(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert sorted(map(tuple, op3_substring_dedup(spark, sf).collect())) == sorted(plain(rows))


def test_awkward_rows(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(6)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 90)))) for i in range(40)]
    rows += [(41, None), (42, ""), (None, rows[5][1]), (7, rows[7][1]), (43, "a" * 300_000), (44, " \n".join(["x"] * 60)), (-3, " ".join(["x"] * 30))]
    rows += [(100 + i, "same passage " * 20) for i in range(50)]
    got = substring_dedup(awkward(spark, rows)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(plain(rows), key=key)
    assert substring_dedup(awkward(spark, rows).limit(0)).collect() == []

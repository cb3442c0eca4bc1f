import duckdb
from brute import awkward

from graphloom.llm import op5


def test_oracle(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cols = "doc_id, digest, license_id, n_notices, notices"
    want = con.execute(f"SELECT {cols} FROM ({op5.oracle()})").fetchall()
    assert sorted(want, key=str) == sorted((tuple(r) for r in op5.op5_license_scan(spark, sf).select(*cols.split(", ")).collect()), key=str)
    assert any(r[3] for r in want)


def test_equal_up_to_spelling(spark):
    mit = op5.KNOWN[0][1]
    rows = [(1, mit), (2, mit.upper()), (3, mit.replace("2024 The Authors", "1999-2003, Someone Else").replace("\n\n", "\n")), (4, mit.replace("License", "Licence").replace('"', "'")), (5, mit + " more"), (6, None), (7, ""), (None, mit), (8, "text\nReleased under the MIT licence\nlicensed under cc-by-nc 4.0\nx"), (9, "x " * 200_000), (9, "Released under the MIT License.")]
    got = op5.licenses(awkward(spark, rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert all(by[i][0].license_id == "MIT" for i in (1, 2, 3, 4, None)) and all(by[i][0].license_id is None for i in (5, 6, 7))
    assert by[8][0].notices == "CC-BY-NC-4.0 notice,MIT notice" and sorted(r.n_notices for r in by[9]) == [0, 1]
    assert op5.licenses(awkward(spark, rows).limit(0)).collect() == []


def test_a_notice_needs_no_certain_word(spark, monkeypatch):
    monkeypatch.setattr(op5, "KNOWN", (*op5.KNOWN, ("WTFPL notice", "Do what you want to.")))
    rows = [(1, "a\nDO WHAT you want, to!\nb"), (2, "Do what you want"), (3, "line\rnot split"), (4, "Copyright (c) 2020 X\nReleased under the MIT License.\ncopyright 2021 Y")]
    got = {r.doc_id: r.notices for r in op5.licenses(awkward(spark, rows)).collect()}
    assert got == {1: "WTFPL notice", 2: "", 3: "", 4: "MIT notice"}

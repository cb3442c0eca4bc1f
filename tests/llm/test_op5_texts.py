from brute import awkward

from graphloom.llm import op5


def test_whole_texts_and_the_callers_own(spark):
    folder = op5.Path(op5.__file__).parent / "licenses"
    texts = {f.name.removesuffix(".txt"): f.read_text() for f in sorted(folder.glob("*.txt"))}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0", "Unlicense"} <= set(texts)
    names = list(texts)
    rows = [(i, texts[n].upper()) for i, n in enumerate(names)]
    rows += [(100, texts["Apache-2.0"].split("END OF TERMS")[0]), (101, op5.KNOWN[0][1].partition("\n\n")[2]), (102, "Our own terms, 1."), (103, texts["GPL-3.0"] + " more"), (104, "")]
    docs = awkward(spark, rows)
    got = {r.doc_id: r.license_id for r in op5.licenses(docs).collect()}
    assert [got[i] for i in range(len(names))] == names
    assert (got[100], got[101], got[102], got[103], got[104]) == ("Apache-2.0", "MIT", None, None, None)
    more = spark.createDataFrame([("Own-1", "our own terms 1"), ("Else", op5.KNOWN[0][1]), ("Nil", "")], "license_id string, body string")
    for m in (more, op5.digests(more)):
        got = op5.licenses(docs, more=m)
        assert got.count() == len(rows) and {r.doc_id: r.license_id for r in got.collect() if r.doc_id > 100} == {101: "MIT", 102: "Own-1", 103: None, 104: None}

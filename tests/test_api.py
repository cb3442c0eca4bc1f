"""What the engine answers: order of hits, empty rankings, odd vectors, branches, bounded chains, reports."""

import pytest

from graphloom.api import Engine
from graphloom.operators import changes as C
from graphloom.operators import search as H
from graphloom.operators import traverse as G

FUNCTION = "id string, name string, qualifiedName string, filePath string, domain string, branch string, signature string, lineStart int, lineEnd int"
CALL = "src string, dst string, confidence int, callSite int, calleeRaw string, resolved boolean"


def functions(spark, rows):
    return spark.createDataFrame([(i, n, f"T.{n}", f, "d", b, f"func {n}()", k, k + 4) for k, (i, n, f, b) in enumerate(rows)], FUNCTION)


def calls(spark, pairs):
    return spark.createDataFrame([(a, b, 80 + k % 10, k, "x", True) for k, (a, b) in enumerate(pairs)], CALL)


@pytest.fixture(scope="module")
def engine(spark):
    f = functions(spark, [("a", "loadPage", "A", "master"), ("b", "loadPageTwice loadPage", "B", "master"), ("c", "savePage", "C", "master"), ("d", "nothing", "D", "master"), ("e", "more", "E", "master")])
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [1.0]), ("e", [0.5, 0.5])], "id string, embedding array<double>")
    return Engine(f, calls(spark, [("a", "b"), ("b", "c")]), vectors=v)


def test_hits_come_best_first(engine):
    got = engine.search("load page", 5).collect()
    assert [r.score for r in got] == sorted((r.score for r in got), reverse=True) and len(got) >= 2
    assert [r.bm25_rank for r in got] == sorted(r.bm25_rank for r in got)


def test_string_ids_without_a_text_hit(engine):
    got = engine.search("zzz", 5, [1.0, 0.0]).collect()
    assert [(r.id, r.bm25_rank, r.vec_rank) for r in got] == [("a", None, 1), ("e", None, 2)]
    assert engine.search("", 5, [1.0, 0.0]).count() == 2
    # neither words nor vectors: substrings
    assert [r.id for r in engine.search("othin", 5, [1.0, 2.0, 3.0]).collect()] == ["d"]
    assert [r.id for r in engine.search("othin", 5).collect()] == ["d"] and engine.search("zzz", 5).collect() == []


def test_vectors_that_point_nowhere(spark, engine):
    got = H.nearest(engine.vectors, "id", "embedding", [1.0, 0.0], 9).collect()
    assert [(r.id, r.cos) for r in got] == [("a", 1.0), ("e", 0.707107)]
    assert H.nearest(engine.vectors, "id", "embedding", [0.0, 0.0], 9).collect() == []


def test_branches_do_not_leak(spark):
    f = functions(spark, [("m", "one", "A", "master"), ("both", "two", "B", "master"), ("both", "twoOnX", "B", "x"), ("x", "three", "C", "x"), ("y", "four", "D", "y")])
    c = calls(spark, [("m", "both"), ("m", "x"), ("x", "m"), ("y", "m"), ("both", "y"), ("m", "func:unresolved::z")])
    told = {b: (Engine(f, c, branch=b).functions.collect(), Engine(f, c, branch=b).calls.collect()) for b in ("master", "x", None)}
    seen = {b: ({(r.id, r.name) for r in fs}, {(r.src, r.dst) for r in cs}) for b, (fs, cs) in told.items()}
    assert seen["master"] == ({("m", "one"), ("both", "two")}, {("m", "both"), ("m", "func:unresolved::z")})
    assert seen["x"] == ({("m", "one"), ("both", "twoOnX"), ("x", "three")}, {("m", "both"), ("m", "x"), ("x", "m"), ("m", "func:unresolved::z")})
    assert len(seen[None][0]) == 5 and len(seen[None][1]) == 6


def test_classes_are_found_too(spark, engine):
    k = spark.createDataFrame([("class:A", "Page", "master"), ("class:Z", "Page", "y")], "id string, name string, branch string")
    e = Engine(engine.functions, engine.calls, classes=k)
    assert [(r.id, r.kind) for r in e.symbol("Page").collect()] == [("class:A", "class")]
    assert [(r.id, r.kind) for r in e.symbol("loadPage").collect()] == [("a", "function")] and engine.symbol("Page").collect() == []


def test_first_trails_equal_all_trails(spark):
    import random

    rng = random.Random(3)
    for nodes, edges in ((8, 20), (12, 26), (6, 30)):
        pairs = sorted({(f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}") for _ in range(edges)})
        c = calls(spark, pairs)
        for start in ("n0", "n1"):
            one = spark.createDataFrame([(start,)], "id string")
            want = sorted((r.depth, ">".join(r.path)) for r in G.call_chain(c, one, 4, None).collect())
            assert [(r.depth, ">".join(r.path)) for r in G.call_chain(c, one, 4, 5).collect()] == want[:5]
        want = sorted((r.depth, ">".join(r.call_path)) for r in G.impact_scope(c, one, 3, None).collect())
        assert [(r.depth, ">".join(r.call_path)) for r in G.impact_scope(c, one, 3, 7).collect()] == want[:7]


def test_chains_of_a_dense_graph_at_depth_ten(spark, engine):
    """Every node calls every other one: no list of all trails is ever made."""
    c = calls(spark, [(f"n{i:02}", f"n{j:02}") for i in range(30) for j in range(30)])
    e = Engine(functions(spark, [(f"n{i:02}", f"f{i}", "A", "master") for i in range(30)]), c)
    got = e.call_chain("f0", 10).collect()
    assert len(got) == 20 and all(r.depth == 10 and len(r.edges) == 10 for r in got)
    assert got[0].path[:3] == ["n00", "n00", "n01"] and e.impact_scope("f0", 5).count() == 50


def test_report_of_a_change(spark, engine):
    diff = [(1, i, t) for i, t in enumerate(["+++ b/C", "@@ -1 +2 @@", "+++ b/A", "@@ -1 +1 @@"])]
    e = Engine(engine.functions, engine.calls, spark.createDataFrame([("c", "p1"), ("c", "p0")], "id string, process string"))
    got = {r.id: (r.callers, r.shown, r.processes) for r in e.detect_changes(spark.createDataFrame(diff, "diff_id int, n int, line string")).collect()}
    assert got == {"a": (0, [], []), "c": (2, ["loadPageTwice loadPage", "loadPage"], ["p0", "p1"])}
    assert e.change_summary(spark.createDataFrame(diff, "diff_id int, n int, line string")).first().processes == "p0, p1"


def test_near_callers_stop_when_there_are_enough(spark):
    c = calls(spark, [(f"s{i}", "hot") for i in range(12)] + [("far", "s0"), ("u", "cold"), ("v", "u"), ("w", "v"), ("x", "w")])
    got = C.callers_near(c, spark.createDataFrame([("hot",), ("cold",), ("alone",)], "id string"), 3, 10).collect()
    assert sum(r.start == "hot" for r in got) == 12 and {(r.node, r.depth) for r in got if r.start == "cold"} == {("u", 1), ("v", 2), ("w", 3)}


def test_stored_index(spark, tmp_path):
    docs = spark.createDataFrame([("a", "red fox"), ("b", "red red dog"), ("c", "blue cat"), ("d", None), ("e", "the cat")], "id string, text string")
    index = H.Index.build(docs, "id", "text", str(tmp_path / "i"))
    same = lambda i, d, q: [tuple(r) for r in i.search(q, 3).collect()] == [tuple(r) for r in H.bm25(d, "id", "text", q, 3).collect()]
    assert all(same(index, docs, q) for q in ("red", "blue cat", "nothing", "", "red cat cat"))
    new = spark.createDataFrame([("a", "green cat"), ("f", "red bird")], "id string, text string")
    later = index.update(new, "id", "text", spark.createDataFrame([("e",)], "id string"))
    now = docs.filter("id NOT IN ('a', 'e')").unionByName(new)
    again = H.Index(spark, str(tmp_path / "i"))
    assert later.version == again.version == 2
    assert all(same(again, now, q) for q in ("red", "cat", "green", "the fox"))
    with pytest.raises(FileNotFoundError):
        H.Index(spark, str(tmp_path / "none"))

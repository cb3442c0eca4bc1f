"""Extraction of source text, resolution and the write rules on small graphs worked out by hand."""

import pytest

from graphloom.operators import resolve as R
from graphloom.operators import search as H
from graphloom.operators import store as W
from graphloom.operators import traverse as G
from graphloom.sources import extract as X

SWIFT = """// A small sample.
import Kit

protocol Loading {
    func load(path: String) -> String
}

// CIGTerms: alpha, beta gamma */
public class Store: Base, Loading {
    // CIGTerms: cache , disk
    public static func load(path: String) -> String {
        let x = parse(path)
        return helper.clean(x)
    }

    private func parse(_ raw: String) -> String {
        if (raw.isEmpty) { return fatalError() }
        return parse(raw)
    }
}

struct Tail { }
func free<T>(x: T) { Store.load(path: "a"); load(x) }
"""

OBJC = """#import <UIKit/UIKit.h>
#import "Thing.h"
@interface Thing : NSObject
@end
@implementation Thing
- (void)run:(int)a with:(int)b {
    [self stop];
    [helper go];
}
+ (id)make { return [[Thing alloc] init]; }
@end
@implementation Other
- (void)stop
{
    [super run];
}
@end
"""


@pytest.fixture(scope="module")
def swift(spark):
    return X.swift(spark.createDataFrame([("app/Modules/Core/Store.swift", SWIFT), ("empty.swift", "")], "path string, source string")).cache()


def test_swift_records(swift):
    r = swift.filter("path <> 'empty.swift'").first()
    assert [(i.module, i.lineNo) for i in r.imports] == [("Kit", 2)]
    # a start that follows blank lines is reported at the first of them
    assert [(c.name, c.kind, c.lineStart, c.lineEnd, c.isPublic, c.inherits, c.implements) for c in r.classes] == [
        ("Loading", "protocol", 3, 53, False, [], []),
        ("Store", "class", 9, 59, True, ["Base"], ["Loading"]),
        ("Tail", "struct", 21, 71, False, [], []),
    ]
    assert [(f.qualifiedName, f.lineStart, f.lineEnd, f.isPublic, f.isStatic, f.cigTerms) for f in r.functions] == [
        ("Loading.load", 5, 10, False, False, []),
        ("Store.load", 11, 14, True, True, ["alpha", "beta gamma", "cache", "disk"]),
        ("Store.parse", 15, 22, False, False, ["cache", "disk"]),
        ("Tail.free", 23, 23, False, False, []),
    ]
    assert r.functions[1].signature == "public static func load("
    assert swift.filter("path = 'empty.swift'").first().functions == []


def test_swift_calls(swift):
    got = {(r.callerQualified, r.calleeName, r.calleeReceiver, r.lineNo) for r in X.swift_calls(swift).collect()}
    assert got == {
        ("Loading.load", "load", None, 5),
        ("Store.load", "load", None, 11),
        ("Store.load", "parse", None, 12),
        ("Store.load", "clean", "helper", 13),
        ("Store.parse", "parse", None, 16),
        ("Store.parse", "fatalError", None, 17),
        ("Tail.free", "load", "Store", 23),
    }


def test_objc_records(spark):
    p = X.objc(spark.createDataFrame([("T.m", OBJC)], "path string, source string"))
    r = p.first()
    assert [(i.module, i.lineNo) for i in r.imports] == [("UIKit", 1), ("Thing", 2)]
    assert [(c.name, c.lineStart, c.inherits) for c in r.classes] == [("Thing", 3, ["NSObject"])]
    assert [(f.qualifiedName, f.lineStart, f.lineEnd, f.isStatic) for f in r.functions] == [("Thing.run:with:", 6, 9, False), ("Thing.make", 10, 12, True), ("Other.stop", 13, 18, False)]
    assert r.functions[0].signature == "- (void)run:(int)a with:(int)b"
    calls = {(c.callerQualified, c.calleeName, c.calleeReceiver, c.lineNo, c.confidence) for c in X.objc_calls(p).collect()}
    assert calls == {("Thing.run:with:", "stop", None, 7, 50), ("Thing.run:with:", "go", "helper", 8, 50), ("Other.stop", "run", None, 15, 50)}


def test_graph_rows(spark, swift):
    mapping = spark.createDataFrame([("app/", "application"), ("Modules/Core", "core"), ("zzz", "no")], "prefix string, domain string")
    g = X.graph_rows(swift, X.swift_calls(swift), mapping, "main")
    assert {(r.id, r.module, r.domain) for r in g["files"].collect()} == {("file:app/Modules/Core/Store.swift", "Core", "core"), ("file:empty.swift", "app", "unknown")}
    count = {(r.rel): r["count"] for r in g["edges_raw"].groupBy("rel").count().collect()}
    assert count == {"CONTAINS": 7, "INHERITS": 1, "IMPLEMENTS": 1, "IMPORTS": 1, "CALLS": 6}
    kept = {(r.rel): r["count"] for r in g["edges"].groupBy("rel").count().collect()}
    assert kept == {"CONTAINS": 7, "CALLS": 6}
    edges = g["edges"].filter("rel = 'CALLS'").select("src", "dst", "calleeRaw", "confidence", "resolved")
    got = {(r.src.split("::")[1], r.newDst.split("::")[1], r.confidence) for r in R.resolve(edges, g["functions"], "main").collect()}
    assert ("Store.load", "Store.parse", 90) in got and ("Loading.load", "Store.load", 90) in got and len(got) == 5


def test_scan_and_json(spark, tmp_path):
    for name in ("a.swift", "Pods/b.swift", "c.txt", "sub/d.m"):
        f = tmp_path / name
        f.parent.mkdir(exist_ok=True)
        f.write_bytes(b"func x() \xff")
    got = X.scan(spark, str(tmp_path), ["Pods/"]).collect()
    assert sorted(r.path.split("/")[-1] for r in got) == ["a.swift", "d.m"] and all("func x()" in r.source for r in got)
    rows = X.parsed_json(spark.createDataFrame([('{"filePath": "a", "classes": [], "functions": [{"name": "f", "lineStart": 3}], "calls": [], "imports": [], "errors": []}',), ("broken",)], "value string")).collect()
    assert rows[0].functions[0].lineStart == 3 and rows[1].errors == ["broken"]


CYCLE = [("a", "b", 50), ("b", "c", 60), ("c", "a", 70), ("a", "c", 80), ("c", "c", 0), ("c", "d", 90)]


@pytest.fixture(scope="module")
def cycle(spark):
    return spark.createDataFrame(CYCLE, "src string, dst string, confidence int")


def plain_trails(start, depth):
    out, front = [], [(start, (start,), frozenset())]
    for d in range(1, depth + 1):
        front = [(t, (*p, t), e | {(s, t)}) for n, p, e in front for s, t, _ in CYCLE if s == n and (s, t) not in e]
        out += [(d, p) for _, p, _ in front]
    return sorted(out)


def test_trails_repeat_no_edge(spark, cycle):
    start = spark.createDataFrame([("a",)], "id string")
    got = sorted((r.depth, tuple(r.path)) for r in G.trails(cycle, start, 6).collect())
    assert got == plain_trails("a", 6)
    least = {r.node: r.depth for r in G.levels(cycle, start, 6).collect()}
    assert least == {n: min(d for d, p in plain_trails("a", 6) if p[-1] == n) for n in "abcd"}
    chain = G.call_chain(cycle, start, 2).collect()
    assert {tuple(r.path) for r in chain} == {p for d, p in plain_trails("a", 2) if d == 2 or p[-1] == "d"}
    # what a node reaches forwards is what reaches it backwards
    back = {(r.caller) for r in G.impact_scope(cycle, spark.createDataFrame([("d",)], "id string"), 6, None).collect()}
    assert back == {"a", "b", "c"}


def test_process_trace(spark, cycle):
    f = spark.createDataFrame([("a", "x", "master"), ("b", "unknown", "master"), ("c", "y", "master"), ("d", "z", "other"), ("e", "unknown", "master"), ("f", "unknown", "master")], "id string, domain string, branch string")
    more = cycle.unionByName(spark.createDataFrame([("c", "e", 1), ("e", "f", 1)], cycle.schema))
    got = {(r.start, r.node, r.depth) for r in G.process_trace(more, f, spark.createDataFrame([("a",), ("d",)], "id string")).collect()}
    # b leads on to c; e and f lead nowhere known; d is on another branch
    assert got == {("a", "a", 0), ("a", "b", 1), ("a", "c", 1)}


def test_ladder(spark):
    cols = "id string, name string, qualifiedName string, filePath string, lineStart int, domain string, branch string"
    f = spark.createDataFrame(
        [("s", "s", "s", "F", 1, "d", "x"), ("1", "n1", "q", "F", 2, "z", "master"), ("2", "n2", "q", "G", 1, "d", "x"), ("3", "n3", "q", "G", 1, "e", "x"), ("4", "n4", "q", "G", 1, "d", "master"), ("5", "n5", "q", "G", 1, "e", "master"), ("6", "n2", "q", "G", 1, "d", "master"), ("7", "n7", "q", "G", 1, "e", "other")], cols
    )
    e = spark.createDataFrame([("s", "t", n, c, False) for n, c in (("n1", 50), ("n2", 0), ("n3", 95), ("n4", 95), ("n5", 60), ("n7", 60), ("print", 60), ("", 60))], "src string, dst string, calleeRaw string, confidence int, resolved boolean")
    got = {r.calleeRaw: (r.newDst, r.rung, r.confidence) for r in R.best_candidate(R.unresolved(e), f, "x").collect()}
    assert got == {"n1": ("1", 1, 50), "n2": ("2", 2, 80), "n3": ("3", 3, 95), "n4": ("4", 4, 100), "n5": ("5", 5, 60)}


def test_intervals_equal_brute_force(spark):
    import random

    rng = random.Random(1)
    spans = [(str(i), rng.choice("AB"), a := rng.randrange(1, 400), a + rng.randrange(0, 200)) for i in range(60)]
    points = [(i, rng.choice("AB"), rng.randrange(1, 600)) for i in range(80)]
    got = {(r.p, r.id) for r in R.containing(spark.createDataFrame(points, "p int, filePath string, line int"), spark.createDataFrame(spans, "id string, filePath string, lineStart int, lineEnd int")).collect()}
    assert got == {(p, i) for p, f, n in points for i, g, a, b in spans if f == g and a <= n <= b}


def test_overlays_and_upserts(spark):
    rows = spark.createDataFrame([("a", "master", "f"), ("a", "x", "f"), ("b", "master", "g"), ("c", "master", "f"), ("d", "y", "h")], "id string, branch string, filePath string")
    assert {(r.id, r.branch) for r in W.overlay_view(rows, "x").collect()} == {("a", "x"), ("b", "master"), ("c", "master")}
    assert {(r.id, r.branch) for r in W.overlay_by_path(rows, "x").collect()} == {("a", "x"), ("b", "master")}
    assert W.delete_overlay(rows, "master").count() == 5 and W.delete_overlay(rows, "x").count() == 4
    once = W.replace_files(rows, rows.filter("filePath = 'f' AND branch = 'master'"))
    assert sorted(map(tuple, once.select(rows.columns).collect())) == sorted(map(tuple, rows.collect()))


def test_bm25_by_hand(spark):
    import math

    docs = spark.createDataFrame([(1, "red red fox"), (2, "red dog"), (3, "blue fox jumps"), (4, "nothing")], "id long, text string")
    n, mean = 4, (3 + 2 + 3 + 1) / 4
    df = {"red": 2, "fox": 2, "dog": 1, "blue": 1, "jumps": 1, "nothing": 1}
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)

    def score(words, query):
        return sum((floor if raw[t] < 0 else raw[t]) * words.count(t) * 2.5 / (words.count(t) + 1.5 * (0.25 + 0.75 * len(words) / mean)) for t in query if t in df)

    got = {r.id: r.score for r in H.bm25(docs, "id", "text", "dog dog blue", 5).collect()}
    assert got == {2: round(score(["red", "dog"], ["dog", "dog", "blue"]), 6), 3: round(score(["blue", "fox", "jumps"], ["blue"]), 6)}
    assert H.bm25(docs, "id", "text", "zzz", 5).collect() == [] and H.bm25(docs, "id", "text", "", 5).collect() == []
    left, right = spark.createDataFrame([(1, 1), (2, 2)], "id long, rank long"), spark.createDataFrame([(2, 1), (3, 2)], "id long, rank long")
    assert [(r.id, r.bm25_rank, r.vec_rank) for r in H.fuse(left, right, 5).collect()] == [(2, 2, 1), (1, 1, None), (3, None, 2)]


def test_terms(spark):
    from pyspark.sql import functions as F

    from graphloom.functions.text import terms

    said = {"filterCameraMarkers": ["filter", "camera", "markers"], "URLSession": ["session"], "snake_case x": ["snake", "case"], "相机视图 é1": ["相机视图"], "": []}
    got = spark.createDataFrame([(k,) for k in said], "t string").select("t", terms(F.col("t")).alias("w")).collect()
    assert {r.t: r.w for r in got} == said

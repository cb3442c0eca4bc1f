"""Builds: whole ones, updates, communities, embeddings, the watcher, and the HTTP service that connects them."""

import json
import threading
import time
import urllib.error
import urllib.request

import pytest

from graphloom import build, cli
from graphloom.operators import resolve as R
from graphloom.operators import stats as A
from graphloom.operators import store as W
from graphloom.server import http_server
from graphloom.sources import workspace as P
from graphloom.streaming.watch import Watcher

FILES = {
    "Net/Client.swift": "import Kit\npublic class Client: Base {\n    public func fetch() {\n        parse(x)\n    }\n    func parse(y: Int) {\n        save(y)\n    }\n}\n",
    "Data/Store.swift": "public class Store {\n    public func save(y: Int) {\n        write(y)\n    }\n    func write(y: Int) { return }\n}\n",
    "Old/Gone.swift": "class Gone {\n    func lost() { save(1) }\n}\n",
}


def tables(spark, at):
    at = build.current(spark, at)
    return {k: sorted(map(str, spark.read.parquet(f"{at}/{k}").collect())) for k in ("files", "classes", "functions", "edges_raw", "edges", "calls", "members")}


def test_update_equals_build(spark, tmp_path):
    src, at = tmp_path / "src", str(tmp_path / "graph")
    for name, text in FILES.items():
        (src / name).parent.mkdir(parents=True, exist_ok=True)
        (src / name).write_text(text)
    first = cli.build(spark, str(src), at, mapping={"Net": "networking"})
    assert first["files"] == 3 and first["functions"] == 5 and first["communities"] >= 1
    meta = spark.read.parquet(f"{build.current(spark, at)}/meta").first()
    assert meta.functions == 5 and meta.files == 3 and meta.branch == "master"
    (src / "Data/Store.swift").write_text(FILES["Data/Store.swift"].replace("write", "flush"))
    (src / "Old/Gone.swift").unlink()
    changed = [str(src / "Data/Store.swift"), str(src / "Old/Gone.swift")]
    for _ in range(2):  # again: nothing changes
        assert cli.update(spark, changed, at, mapping={"Net": "networking"})["functions"] == 4
    cli.build(spark, str(src), str(tmp_path / "whole"), mapping={"Net": "networking"})
    assert tables(spark, at) == tables(spark, str(tmp_path / "whole"))
    engine = cli.load(spark, type("Args", (), {"tables": None, "graph": at, "branch": "master"}))
    assert [r.name for r in engine.search("flush", 3).collect()] == ["flush"] and engine.search("write", 3).collect() == []
    assert engine.symbol("Store").first().kind == "class"


def test_http_watcher_rebuilds(spark, tmp_path):
    src, at = tmp_path / "src", str(tmp_path / "graph")
    src.mkdir()
    (src / "a.swift").write_text("public class A {\n    public func one() { return }\n}\n")
    cli.build(spark, str(src), at)
    args = type("Args", (), {"tables": None, "graph": at, "branch": "master"})
    server = http_server(cli.load(spark, args), 0, rebuild=lambda path, branch: cli.update(spark, [path], at, branch), reload=lambda: cli.load(spark, args))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"
    get = lambda p: json.load(urllib.request.urlopen(base + p))
    post = lambda p, **a: json.load(urllib.request.urlopen(urllib.request.Request(base + p, json.dumps(a).encode())))
    assert post("/api/watcher/heartbeat", repo="r", branch="x") == {"status": "ok"} and post("/api/watcher/branch-switch", branch="x") == {"status": "ok", "branch": "x"}
    (src / "a.swift").write_text("public class A {\n    public func one() { two() }\n    func two() { return }\n}\n")
    assert post("/api/watcher/file-changed", filePath=str(src / "a.swift"), branch="master")["status"] == "queued"
    for _ in range(240):
        health = get("/api/stats/health")
        if not health["building"]:
            break
        time.sleep(0.5)
    assert health["failed"] == [] and health["totals"]["functions"] == 2 and [w["repo"] for w in health["watchers"]] == ["r"] and health["overlays"][0]["branch"] == "x"
    graph = get("/api/graph/subgraph?name=one&depth=2")
    assert {n["name"] for n in graph["nodes"]} == {"one", "two"} and len(graph["links"]) >= 1 and sum(n["isCenter"] for n in graph["nodes"]) == 1
    assert set(get("/api/stats/risk")) == {"fan_in", "coupling", "low_confidence"}
    told = post("/api/mcp/detect-changes", diff_hunks=f"+++ b/{src}/a.swift\n@@ -1 +3 @@\n")
    assert told["summary"]["n_changed"] == 1 and [f["name"] for f in told["functions"]] == ["two"]
    with pytest.raises(urllib.error.HTTPError):
        post("/api/watcher/nothing")
    server.shutdown()


def test_louvain_finds_planted_groups(spark):
    import random

    rng = random.Random(1)
    pairs = set()
    for g in range(4):
        own = [f"{g}-{i:02}" for i in range(12)]
        pairs |= {(a, b) for a in own for b in own if a != b and rng.random() < 0.5}
    pairs |= {(f"{rng.randrange(4)}-{rng.randrange(12):02}", f"{rng.randrange(4)}-{rng.randrange(12):02}") for _ in range(25)}
    calls = spark.createDataFrame([(a, b, 80) for a, b in sorted(pairs)], "src string, dst string, confidence int")
    got = {r.id: r.communityId for r in A.louvain(calls).collect()}
    assert len(got) == 48 and all(len({got[f"{g}-{i:02}"] for i in range(12)}) == 1 for g in range(4)) and len(set(got.values())) == 4
    frame = spark.createDataFrame(sorted(got.items()), "id string, communityId string")
    apart = A.modularity(calls, frame).first().modularity
    assert apart > 0.5 and apart >= A.modularity(calls, A.label_propagation(calls)).first().modularity
    functions = spark.createDataFrame([(i, "d" if i < "1" else None, "master") for i in got], "id string, domain string, branch string")
    nodes, belongs = A.communities(functions, frame, "master")
    assert {(r.communityId, r.domain, r.memberCount) for r in nodes.collect()} == {(f"{g}-00", "d" if g == 0 else "unknown", 12) for g in range(4)} and belongs.count() == 48
    alone = spark.createDataFrame([("a", "a", 0)], calls.schema)
    assert A.louvain(alone).collect() == []


def test_index_resolver_by_hand(spark):
    f = spark.createDataFrame([("m", "F", 1, 9), ("t", "G", 5, 8), ("u", "G", 20, 25)], "id string, filePath string, lineStart int, lineEnd int")
    definitions = spark.createDataFrame([("T", "Load(path:)", "G", 4), ("U", "other", "G", 21), ("X", "loadX", "H", 3)], "usr string, name string, filePath string, line int")
    sites = spark.createDataFrame([("F", 3, "T"), ("F", 3, "U"), ("F", 5, "sdk"), ("F", 7, "X"), ("F", 6, "U")], "filePath string, line int, usr string")
    stub = "func:unresolved::"
    edges = [("a", "load", 2), ("b", "load", 5), ("c", "load", 7), ("d", "load", 100), ("e", "", 4), ("g", "zzz", 3)]
    stubs = spark.createDataFrame([(s, stub + (c or s), "F", n, c) for s, c, n in edges], "src string, dst string, srcFile string, callSite int, calleeRaw string")
    got = {r.src: (r.newDst, r.outcome) for r in R.from_index(stubs, sites, definitions, f).collect()}
    assert got == {"a": ("t", "resolved"), "b": (None, "callee_in_sdk_or_external"), "c": (None, "callee_not_in_our_graph"), "d": (None, "no_call_site_in_indexstore"), "e": (None, "callee_in_sdk_or_external"), "g": (None, "callee_in_sdk_or_external")}
    calls = spark.createDataFrame([("a", stub + "load", 70, 2, "load", False), ("a", "t", 80, 9, "z", True), ("b", stub + "load", 70, 5, "load", False)], "src string, dst string, confidence int, callSite int, calleeRaw string, resolved boolean")
    new = R.redirected(calls, R.from_index(stubs, sites, definitions, f))
    assert {(r.src, r.dst, r.confidence, r.callSite, r.resolved) for r in new.collect()} == {("a", "t", 99, 2, True), ("b", stub + "load", 70, 5, False)}
    more = spark.createDataFrame([("a", "t", 75, "protocol_dispatch"), ("b", "u", 75, "protocol_dispatch")], "src string, dst string, confidence int, via string")
    both = {(r.src, r.dst): (r.confidence, r.via) for r in R.with_dispatch(new, more).collect()}
    assert both == {("a", "t"): (99, "protocol_dispatch"), ("b", "u"): (75, "protocol_dispatch"), ("b", stub + "load"): (70, None)}


def test_embeddings_in_batches(spark, tmp_path):
    failed = str(tmp_path / "failed")

    def client(texts, marker=failed):
        import os

        assert len(texts) <= 3
        if not os.path.exists(marker):  # the first call fails
            open(marker, "w").close()
            raise OSError("busy")
        return [[float(len(t)), 1.0] for t in texts]

    texts = spark.createDataFrame([(f"i{i}", "x" * i) for i in range(1, 8)], "id string, text string").coalesce(1)
    got = {r.id: tuple(r.embedding) for r in W.embed(texts, client, batch=3, wait=0.01).collect()}
    assert got == {f"i{i}": (float(i), 1.0) for i in range(1, 8)}


def test_watcher_sees_files_written_again(spark, tmp_path):
    import os

    src = tmp_path / "src"
    src.mkdir()
    for n in "ab":
        (src / f"{n}.swift").write_text(n)
    w = Watcher(spark, str(src), str(tmp_path / "seen"), P.listing)
    assert w.poll().collect() == []
    (src / "a.swift").write_text("again")
    os.utime(src / "a.swift", (time.time() + 60, time.time() + 60))
    (src / "b.swift").unlink()
    (src / "c.swift").write_text("c")
    assert {(r.path.rsplit("/", 1)[1], r.change) for r in w.poll().collect()} == {("a.swift", "changed"), ("b.swift", "gone"), ("c.swift", "new")}
    assert w.poll().collect() == []


def test_unreadable_bytes_are_told(spark, tmp_path):
    from graphloom.sources import extract as X

    (tmp_path / "a.swift").write_bytes(b"func x() {} \xff")
    (tmp_path / "b.swift").write_bytes(b"func y() {}")
    got = {r.path.rsplit("/", 1)[1]: r.error for r in X.scan(spark, str(tmp_path), []).collect()}
    assert got == {"a.swift": "bytes that are no UTF-8 were replaced", "b.swift": None}

"""Streams against their batch results, the engine and the command line."""

import datetime as dt
import json

import pytest

from graphloom.api import Engine
from graphloom.operators import changes as C
from graphloom.operators import store as W
from graphloom.plans import fixture as D
from graphloom.streaming import watch as S


def test_stream_of_files_equals_batch(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    (src / "Pods").mkdir(parents=True)
    out.mkdir()
    seen = []

    def apply(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/{number}")
        seen.append(number)

    for k in range(3):
        (src / f"f{k}.swift").write_text(f"func f{k}() {{}}")
        (src / "Pods" / f"p{k}.swift").write_text("func no() {}")
        S.replace_each_batch(S.new_files(spark, str(src)), str(tmp_path / "check"), apply).awaitTermination(60)
    got = spark.read.parquet(f"{out}/*").collect()
    assert sorted(r.path.split("/")[-1] for r in got) == ["f0.swift", "f1.swift", "f2.swift"] and len(set(seen)) == len(seen) == 3


def test_heartbeat_windows(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(f"r{i % 2}", "main" if i < 5 else "dev", base + dt.timedelta(seconds=20 * i)) for i in range(10)]
    spark.createDataFrame(rows, "repo string, branch string, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("repo string, branch string, ts timestamp").parquet(str(tmp_path / "in"))
    q = S.heartbeats(stream).writeStream.format("memory").queryName("beats").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sum(r.beats for r in spark.sql("SELECT beats FROM beats").collect()) == 10


def test_snapshots(spark):
    old = spark.createDataFrame([("a", 5), ("b", 5), ("gone", 1)], "path string, mtime long")
    new = spark.createDataFrame([("a", 6), ("b", 4), ("first", 9)], "path string, mtime long")
    assert [tuple(r) for r in S.changed_files(old, new).collect()] == [("a", 6)]
    from pyspark.sql import functions as F

    heads = spark.createDataFrame([("ref: refs/heads/feature/x\n",), ("0123456789abcdef\n",)], "h string")
    assert [r[0] for r in heads.select(S.head_branch(F.col("h"))).collect()] == ["feature/x", "01234567"]


def test_diff_parsing(spark):
    text = ["--- a/x", "+++ b/src/a.swift", "@@ -1,3 +10,2 @@", "@@ -9 +40 @@ f()", "@@ -50,2 +49,0 @@", "--- a/y", "+++ /dev/null", "@@ -1,2 +0,0 @@", "@@ -1 +7 @@", "+++ b/b.swift", "@@ -0,0 +1,3 @@"]
    diff = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "diff_id int, n int, line string")
    got = sorted((r.filePath, r.line) for r in C.changed_lines(diff).collect())
    assert got == [("b.swift", 1), ("b.swift", 2), ("b.swift", 3), ("src/a.swift", 10), ("src/a.swift", 11), ("src/a.swift", 40)]


def test_cascade(spark):
    nodes = spark.createDataFrame([("a", "F", "master"), ("b", "F", "x"), ("c", "G", "master")], "id string, filePath string, branch string")
    edges = spark.createDataFrame([("a", "c"), ("c", "a"), ("c", "b"), ("c", "c")], "src string, dst string")
    left, kept = W.delete_file(nodes, edges, "F", "master")
    assert {r.id for r in left.collect()} == {"b", "c"} and {tuple(r) for r in kept.collect()} == {("c", "b"), ("c", "c")}


@pytest.fixture(scope="module")
def engine(spark, sf):
    f = D.functions(spark, sf)
    from pyspark.sql import functions as F

    return Engine(f, D.calls(spark, sf), D.members(spark, sf), f.select("id", F.col("domain").alias("communityId")))


def test_engine(engine):
    name = engine.functions.filter(engine.functions.id == engine.calls.first().src).first().qualifiedName
    assert engine.find(name).count() == 1
    assert engine.call_chain(name, 3).count() >= 1 and engine.impact_scope(name, 2).count() >= 0
    ctx = engine.context(name)
    assert ctx["outgoing"].count() >= 1 and set(ctx) == {"outgoing", "incoming", "processes", "community"}
    assert engine.search("red steel", 5).count() >= 1
    nodes, links = engine.subgraph(name, 2)
    assert links.count() >= 1 and nodes.count() >= 2
    assert engine.stats().first().functions == engine.functions.count()
    assert set(engine.risk()) == {"fan_in", "coupling", "low_confidence"}
    assert engine.sql("SELECT count(*) AS n FROM calls WHERE confidence >= :c", c=0).first().n == engine.calls.count()


def test_command_line_and_rpc(engine, spark, sf, capsys):
    from graphloom import cli
    from graphloom.server import answer

    assert cli.main(["stats", "--tables", sf], spark) == 0
    assert "functions" in capsys.readouterr().out
    tools = answer(engine, {"jsonrpc": "2.0", "id": 1, "method": "tools/list"})
    assert {t["name"] for t in tools["result"]["tools"]} >= {"search", "context", "impact", "call_chain", "stats"}
    name = engine.functions.first().qualifiedName
    got = answer(engine, {"jsonrpc": "2.0", "id": 2, "method": "tools/call", "params": {"name": "context", "arguments": {"symbol": name}}})
    assert "outgoing" in json.loads(got["result"]["content"][0]["text"])
    assert answer(engine, {"jsonrpc": "2.0", "id": 3, "method": "nope"})["error"]["code"] == -32601


def test_http(engine):
    import threading
    import urllib.error
    import urllib.request

    from graphloom.server import http_server

    server = http_server(engine, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"
    assert json.load(urllib.request.urlopen(f"{base}/health")) == {"status": "ok"}
    got = json.load(urllib.request.urlopen(urllib.request.Request(f"{base}/api/mcp/search", json.dumps({"query": "red steel", "limit": 3}).encode())))
    assert got and got[0]["score"] > 0
    with pytest.raises(urllib.error.HTTPError):
        urllib.request.urlopen(urllib.request.Request(f"{base}/api/mcp/nothing", b"{}"))
    server.shutdown()


def test_workspace(spark, tmp_path):
    from graphloom.sources import workspace as P

    for name in ("Net/Api/a.swift", "Pods/x.swift", "One/Two/Three/Four/deep.m", "Login Flow/l.h", "top.swift", "docs/readme.md"):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x")
    got = P.generate_mapping(P.listing(spark, str(tmp_path)), str(tmp_path))
    assert {(r.prefix, r.domain) for r in got.collect()} == {("Net/Api/", "networking"), ("Login Flow/", "auth")}
    P.write_mapping(got, str(tmp_path / "m.yaml"))
    assert P.load_mapping(str(tmp_path / "m.yaml")) == {"Net/Api/": "networking", "Login Flow/": "auth"}
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "id string, embedding array<float>")
    nodes = W.set_embeddings(spark.createDataFrame([("a", 1), ("c", 2)], "id string, n int"), vectors)
    assert {(r.id, r.n, tuple(r.embedding or ())) for r in nodes.collect()} == {("a", 1, (1.0, 2.0)), ("c", 2, ())}
    assert W.one_dimension(vectors) == 2
    over = W.upsert_overlay(spark.createDataFrame([("x", "1", "2024")], "branch string, commitHash string, lastUpdated string"), "y", "2", "2025")
    assert [r.branch for r in W.upsert_overlay(over, "x", "3", "2026").collect()] == ["x", "y"]


def test_git_diff(spark, tmp_path):
    import subprocess

    from graphloom.sources import workspace as P

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.swift").write_text("one\ntwo\nthree\n")
    git("add", "-A")
    git("commit", "-qm", "first")
    (tmp_path / "a.swift").write_text("one\n2\nthree\nfour\n")
    got = sorted((r.filePath, r.line) for r in C.changed_lines(P.git_diff(spark, str(tmp_path), "HEAD")).collect())
    assert got == [("a.swift", 2), ("a.swift", 4)]

"""JSON-RPC over standard input and output: the engine's queries as tools."""

from __future__ import annotations

import json
import sys
from typing import Any

from pyspark.sql import DataFrame

from .api import Engine

SHOWN = 200


def _tool(name: str, about: str, *needed: str, **numbers: int) -> dict:
    fields = {n: {"type": "string"} for n in needed} | {n: {"type": "integer", "default": d} for n, d in numbers.items()}
    return {"name": name, "description": about, "inputSchema": {"type": "object", "properties": fields, "required": list(needed)}}


TOOLS = [
    _tool("search", "Functions that match a text, best first.", "query", limit=10),
    _tool("context", "What a symbol calls, what calls it, its processes and community.", "symbol"),
    _tool("impact", "Callers of a symbol by depth.", "symbol", depth=5),
    _tool("call_chain", "Call chains from a symbol.", "symbol", depth=5),
    _tool("process", "Members of the first process whose name holds a text.", "query"),
    _tool("detect_changes", "Functions that a diff touches, their callers and processes, and a summary.", "diff_hunks"),
    _tool("subgraph", "Nodes and links around a symbol.", "symbol", depth=2),
    _tool("sql", "Read-only SQL over functions and calls.", "query"),
    _tool("stats", "Counts, coverage and most called functions."),
]


def rows(df: DataFrame, most: int = SHOWN) -> list[dict]:
    """The first rows as plain values: answers are shown, not stored."""
    return [json.loads(x) for x in df.limit(most).toJSON().take(most)]


def call(engine: Engine, name: str, args: dict[str, Any]) -> Any:
    if name == "search":
        return rows(engine.search(args["query"], int(args.get("limit", 10))))
    if name == "context":
        return {k: rows(v) for k, v in engine.context(args["symbol"]).items()}
    if name == "impact":
        return rows(engine.impact_levels(args["symbol"], int(args.get("depth", 5))).orderBy("depth", "caller"))
    if name == "call_chain":
        return rows(engine.call_chain(args["symbol"], int(args.get("depth", 5))))
    if name == "process":
        return rows(engine.process(args["query"]))
    if name == "detect_changes":
        lines = [(1, i, x) for i, x in enumerate(args["diff_hunks"].split("\n"))]
        diff = engine.spark.createDataFrame(lines, "diff_id int, n int, line string")
        return {"functions": rows(engine.detect_changes(diff).orderBy("id")), "summary": rows(engine.change_summary(diff))[0]}
    if name == "subgraph":
        nodes, links = engine.subgraph(args["symbol"], int(args.get("depth", 2)))
        center = [r["id"] for r in rows(engine.find(args["symbol"]).select("id"))]
        named = nodes.join(engine.functions.select("id", "name", "qualifiedName", "domain", "filePath", "lineStart"), "id", "left")
        return {"nodes": [r | {"isCenter": r["id"] in center} for r in rows(named)], "links": [{"source": r["src"], "target": r["dst"], "confidence": r["confidence"]} for r in rows(links, 2000)], "center": center[0] if center else None}
    if name == "sql":
        return rows(engine.sql(args["query"]))
    if name == "stats":
        return {"totals": rows(engine.stats()), **{k: rows(v) for k, v in engine.risk().items()}}
    raise KeyError(name)


def answer(engine: Engine, request: dict) -> dict | None:
    """The response to a request; None to a notification."""
    method, number = request.get("method"), request.get("id")
    if number is None:
        return None
    reply = {"jsonrpc": "2.0", "id": number}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "graphloom", "version": "1"}}}
    if method == "tools/list":
        return reply | {"result": {"tools": TOOLS}}
    if method == "tools/call":
        params = request.get("params") or {}
        try:
            got, failed = call(engine, params.get("name"), params.get("arguments") or {}), False
        except Exception as e:  # told to the caller
            got, failed = f"{type(e).__name__}: {e}", True
        return reply | {"result": {"content": [{"type": "text", "text": json.dumps(got)}], "isError": failed}}
    return reply | {"error": {"code": -32601, "message": f"no method {method}"}}


def serve(engine: Engine, lines=sys.stdin, out=sys.stdout) -> None:
    for line in lines:
        if line.strip() and (reply := answer(engine, json.loads(line))) is not None:
            print(json.dumps(reply), file=out, flush=True)


def http_server(engine: Engine, port: int = 8080, host: str = "127.0.0.1", rebuild=None, reload=None):
    """The same tools over HTTP, what watchers report, and counts. The caller runs and closes it.

    POST /api/mcp/<tool> with its arguments; POST /api/watcher/file-changed (filePath, branch), which runs ``rebuild`` in the
    background and then ``reload`` for a new engine, branch-switch (branch) and heartbeat (repo, branch); GET /health,
    /api/stats/health, /api/stats/risk, /api/graph/subgraph?name=&depth=.
    """
    import threading
    from concurrent.futures import ThreadPoolExecutor
    from datetime import datetime, timezone
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from urllib.parse import parse_qs, urlsplit

    now = lambda: datetime.now(timezone.utc).isoformat()
    state = {"engine": engine, "watchers": {}, "overlays": {}, "jobs": [], "failed": []}
    lock, work = threading.Lock(), ThreadPoolExecutor(1)  # builds of one graph come one after another

    def changed(path: str, branch: str) -> None:
        try:
            rebuild(path, branch)
            if reload is not None:
                state["engine"] = reload()
        except Exception as e:  # told by the counts
            with lock:
                state["failed"].append({"file": path, "error": f"{type(e).__name__}: {e}"})

    def watcher(what: str, args: dict) -> dict:
        branch = args.get("branch") or "master"
        if what == "file-changed":
            if rebuild is None:
                return {"status": "ignored", "file": args["filePath"]}
            with lock:
                state["jobs"] = [j for j in state["jobs"] if not j.done()] + [work.submit(changed, args["filePath"], branch)]
            return {"status": "queued", "file": args["filePath"]}
        with lock:
            if what == "branch-switch":
                state["overlays"][branch] = {"branch": branch, "commitHash": "unknown", "lastUpdated": now()}
                return {"status": "ok", "branch": branch}
            if what == "heartbeat":
                state["watchers"][args.get("repo") or "unknown"] = {"branch": args.get("branch"), "lastSeen": now()}
                return {"status": "ok"}
        raise KeyError(what)

    def counted(what: str) -> dict:
        e = state["engine"]
        if what == "risk":
            return {k: rows(v) for k, v in e.risk().items()}
        if what == "health":
            with lock:
                lists = {"watchers": [{"repo": k, **v} for k, v in state["watchers"].items()], "overlays": list(state["overlays"].values()), "failed": state["failed"][-20:], "building": sum(not j.done() for j in state["jobs"])}
            return {"totals": rows(e.stats())[0], **lists}
        raise KeyError(what)

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, body: Any) -> None:
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _answer(self, said) -> None:
            try:
                self._send(200, said())
            except KeyError as e:
                self._send(404, {"error": f"unknown {e}"})
            except Exception as e:  # told to the caller
                self._send(400, {"error": f"{type(e).__name__}: {e}"})

        def do_GET(self) -> None:
            url = urlsplit(self.path)
            asked = {k: v[0] for k, v in parse_qs(url.query).items()}
            if url.path == "/health":
                self._send(200, {"status": "ok"})
            elif url.path.startswith("/api/stats/"):
                self._answer(lambda: counted(url.path.removeprefix("/api/stats/")))
            elif url.path == "/api/graph/subgraph":
                self._answer(lambda: call(state["engine"], "subgraph", {"symbol": asked["name"], "depth": asked.get("depth", 2)}))
            else:
                self._send(404, {"error": "not found"})

        def do_POST(self) -> None:
            try:
                args = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
            except ValueError as e:
                self._send(400, {"error": f"{type(e).__name__}: {e}"})
                return
            if self.path.startswith("/api/watcher/"):
                self._answer(lambda: watcher(self.path.removeprefix("/api/watcher/"), args))
            else:
                name = self.path.removeprefix("/api/mcp/").replace("-", "_").replace("impact_scope", "impact")
                self._answer(lambda: call(state["engine"], name, args))

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)

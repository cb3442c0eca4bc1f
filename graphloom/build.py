"""Builds of a graph from source files: the whole of it, or the files that have changed.

A graph is a folder of versions, each a folder of tables. A build writes a new version and marks it when it is whole, so a build
that fails leaves the graph as it was, and who reads the version before can go on until the build after next. Only extraction
looks at texts; all that follows is derived from its tables.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import resolve, search, stats, traverse
from .operators.store import last_wins
from .sources import extract

EXCLUDE = ["Pods/", ".build/", "DerivedData/"]
# Names that mark entry points.
ENTRY_POINTS = ["viewDidLoad", "viewDidAppear", "viewWillAppear", "application:didFinishLaunchingWithOptions", "applicationDidBecomeActive", "scene:willConnectTo", "didReceiveRemoteNotification", "handleDeepLink"]
#: Tables of extraction, with the SQL of each row's file; the rest is derived.
OWN = {"files": "path", "classes": "filePath", "functions": "filePath", "edges_raw": "split(regexp_replace(src, '^[a-z]+:', ''), '::')[0]"}
DERIVED = ("edges", "calls", "communities", "belongs", "members", "meta")


def extracted(files: DataFrame, branch: str, mapping: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """files, classes, functions, edges_raw of source files (path, source)."""
    pairs = files.sparkSession.createDataFrame(list((mapping or {}).items()), "prefix string, domain string")
    swift = extract.swift(files.filter(F.col("path").endswith(".swift")))
    objc = extract.objc(files.filter(~F.col("path").endswith(".swift")))
    parts = [extract.graph_rows(swift, extract.swift_calls(swift), pairs, branch), extract.graph_rows(objc.drop("messages"), extract.objc_calls(objc), pairs, branch)]
    return {k: parts[0][k].unionByName(parts[1][k]) for k in OWN}


def _versions(spark: SparkSession, out: str) -> tuple[list[int], object, object]:
    """Whole versions under ``out``, the folder and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    at = path(out)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [p.getPath().getName() for p in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(path(f"{out}/{n}/_DONE"))), at, fs


def current(spark: SparkSession, out: str) -> str:
    """The folder of the newest whole version of a graph."""
    done = _versions(spark, out.rstrip("/"))[0]
    if not done:
        raise FileNotFoundError(f"no graph in {out}")
    return f"{out.rstrip('/')}/v{done[-1]}"


class _Folder:
    """A new version of a graph."""

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out = spark, out.rstrip("/")
        self.version = max(_versions(spark, self.out)[0], default=0) + 1
        self.at = f"{self.out}/v{self.version}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.at}/{name}")
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.at}/{name}")

    def done(self) -> None:
        """Mark the version as whole; versions before the last one go."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        versions, _, fs = _versions(self.spark, self.out)
        fs.create(path(f"{self.at}/_DONE")).close()
        for v in versions[:-1]:
            fs.delete(path(f"{self.out}/v{v}"), True)


def derive(folder: _Folder, branch: str, commit: str | None, grouping: str = "louvain", index: search.Index | None = None, changed: DataFrame | None = None, gone: DataFrame | None = None) -> dict[str, int]:
    """All tables that follow from those of extraction, and the search index: a new one, or one with what has changed."""
    files, classes, functions, raw = (folder.read(k) for k in OWN)
    edges = folder.write(extract.kept_edges(raw, files.select("id").unionByName(classes.select("id")).unionByName(functions.select("id"))), "edges")
    todo = edges.filter("rel = 'CALLS'")
    found = resolve.resolve(todo, functions, branch)
    told = todo.join(found.select("src", "calleeRaw", "newDst", F.col("confidence").alias("c")), ["src", "calleeRaw"], "left")
    calls = told.select("src", F.coalesce("newDst", "dst").alias("dst"), F.coalesce("c", "confidence").alias("confidence"), "callSite", "calleeRaw", F.col("newDst").isNotNull().alias("resolved"))
    calls = folder.write(last_wins(calls, ["src", "dst"], [F.col("callSite"), F.col("calleeRaw")]), "calls")
    known = calls.join(functions.select(F.col("id").alias("dst")), "dst", "left_semi")
    if grouping == "domain" or known.isEmpty():
        nodes, belongs = stats.domain_communities(functions, branch), functions.filter("domain <> 'unknown'").select("id", F.concat(F.lit(f"community:{branch}:"), "domain").alias("communityId"))
    else:
        nodes, belongs = stats.communities(functions, stats.louvain(known), branch)
    folder.write(nodes, "communities")
    folder.write(belongs, "belongs")
    trace = traverse.process_trace(calls, functions, traverse.entry_points(functions, ENTRY_POINTS, branch), branch=branch)
    folder.write(trace.select(F.col("node").alias("id"), F.concat(F.lit("process:"), "start").alias("process")), "members")
    total = stats.totals(files=files, classes=classes, functions=functions, edges=raw, calls=calls).crossJoin(stats.coverage(functions, calls).select("percent"))  # one row each
    folder.write(total.withColumns({"lastUpdated": F.lit(datetime.now(timezone.utc).isoformat()), "commitHash": F.lit(commit).cast("string"), "branch": F.lit(branch)}), "meta")
    doc = lambda f: f.select("id", extract.search_text().alias("text"))
    if index is None:
        search.Index.build(doc(functions), "id", "text", f"{folder.at}/index")
    else:
        index.update(doc(functions.join(changed, "filePath", "left_semi")), "id", "text", gone, f"{folder.at}/index")
    return {k: folder.read(k).count() for k in ("files", "classes", "functions", "calls", "communities", "members")}


def build(files: DataFrame, out: str, branch: str = "master", mapping: dict[str, str] | None = None, commit: str | None = None, grouping: str = "louvain") -> dict[str, int]:
    """A graph of source files (path, source) under ``out``; counts of what was written.

    Functions are grouped by Louvain's method, or by their domains if asked for or where no call leads to a known function.
    """
    folder = _Folder(files.sparkSession, out)
    for k, df in extracted(files, branch, mapping).items():
        folder.write(df, k)
    counts = derive(folder, branch, commit, grouping)
    folder.done()
    return counts


def update(files: DataFrame, out: str, branch: str = "master", mapping: dict[str, str] | None = None, commit: str | None = None, removed: list[str] | None = None, grouping: str = "louvain") -> dict[str, int]:
    """The graph under ``out`` with files that come anew (path, source) and without ``removed`` paths.

    Only these files are extracted; their rows replace what the graph had of them, so that updating again changes nothing. Calls
    are resolved anew, since any of them may lead to a new function, and the search index takes the changed functions.
    """
    spark = files.sparkSession
    folder, was = _Folder(spark, out), current(spark, out)
    new = extracted(files, branch, mapping)
    changed = files.select(F.col("path").alias("filePath")).distinct()
    gone = changed.unionByName(spark.createDataFrame([(p,) for p in removed or []], "filePath string")).distinct()
    for k, where in OWN.items():
        old = spark.read.parquet(f"{was}/{k}")
        kept = old.withColumn("_f", F.expr(where)).join(gone.withColumnRenamed("filePath", "_f"), "_f", "left_anti")
        folder.write(kept.select(old.columns).unionByName(new[k]), k)
    ids = spark.read.parquet(f"{was}/functions").join(gone, "filePath", "left_semi").select("id")
    counts = derive(folder, branch, commit, grouping, search.Index(spark, f"{was}/index"), changed, ids)
    folder.done()
    return counts

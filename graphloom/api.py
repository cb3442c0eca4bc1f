"""One engine over functions, calls and what is derived from them: the queries that tools ask."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import changes, search, stats, store, traverse


class Engine:
    """functions and calls as in ``model``; classes, members (id, process), communities (id, communityId), vectors (id,
    embedding) and a stored search index where there are any. A branch sees its own functions and master's that it has not;
    without a branch all rows are seen."""

    def __init__(self, functions: DataFrame, calls: DataFrame, members: DataFrame | None = None, communities: DataFrame | None = None, vectors: DataFrame | None = None, branch: str | None = "master", classes: DataFrame | None = None, index: search.Index | None = None):
        self.spark: SparkSession = functions.sparkSession
        if branch is not None:
            every, functions = functions.select("id").distinct(), store.overlay_view(functions, branch)
            classes = store.overlay_view(classes, branch) if classes is not None else None
            known = every.join(functions.select("id", F.lit(True).alias("s")), "id", "left").select("id", F.coalesce("s", F.lit(False)).alias("seen"))
            calls = store.branch_edges(calls, known)
        self.functions, self.calls, self.members, self.classes = functions, calls, members, classes
        self.communities, self.vectors, self.branch, self.index = communities, vectors, branch, index

    def find(self, symbol: str) -> DataFrame:
        """The function of a name or qualified name, the branch's own first, then the least id."""
        hit = self.functions.filter((F.col("name") == symbol) | (F.col("qualifiedName") == symbol))
        return hit.orderBy(F.when(F.col("branch") == self.branch, 0).otherwise(1), "id").limit(1)

    def find_class(self, name: str) -> DataFrame:
        """id, name of the class of a name, the least id."""
        if self.classes is None:
            return self.functions.limit(0).select("id", "name")
        return self.classes.filter(F.col("name") == name).select("id", "name").orderBy("id").limit(1)

    def symbol(self, name: str) -> DataFrame:
        """id, name, kind: the function of a name, or else the class."""
        both = self.find(name).select("id", "name", F.lit("function").alias("kind")).unionByName(self.find_class(name).select("id", "name", F.lit("class").alias("kind")))
        return both.orderBy(F.desc("kind")).limit(1)

    def call_chain(self, symbol: str, depth: int = 10) -> DataFrame:
        """The first 20 call chains with confidence and call site of each step."""
        return traverse.with_call_sites(traverse.call_chain(self.calls, self.find(symbol).select("id"), depth), self.calls)

    def impact_scope(self, symbol: str, depth: int = 5) -> DataFrame:
        return traverse.impact_scope(self.calls, self.find(symbol).select("id"), depth)

    def affected_processes(self, symbol: str) -> DataFrame:
        return self.members.join(self.find(symbol).select("id"), "id").select("process").distinct()

    def impact_levels(self, symbol: str, depth: int = 5) -> DataFrame:
        return traverse.impact_levels(self.calls, self.find(symbol).select("id"), depth)

    def context(self, symbol: str) -> dict[str, DataFrame]:
        """outgoing, incoming, processes and community of a symbol."""
        one = self.symbol(symbol).select("id")
        named = self.functions.select("id", "name")
        out = self.calls.join(one.withColumnRenamed("id", "src"), "src").join(named.withColumnRenamed("id", "dst"), "dst").orderBy(F.desc("confidence"), "callSite", "dst").limit(200)
        into = self.calls.join(one.withColumnRenamed("id", "dst"), "dst").filter("src <> dst").join(named.withColumnRenamed("id", "src"), "src").orderBy("src").limit(20)
        got = {"outgoing": out, "incoming": into}
        if self.members is not None:
            got["processes"] = self.members.join(one, "id")
        if self.communities is not None:
            got["community"] = self.communities.join(one, "id").orderBy("communityId").limit(1)
        return got

    def search(self, query: str, k: int = 10, vector: list[float] | None = None) -> DataFrame:
        """id, ranks, score, name, filePath, best first. Names of at most k hits are joined, then put in order again."""
        from .functions.text import search_doc

        docs = self.functions.select("id", search_doc(F.col("name"), F.col("qualifiedName"), F.col("domain"), F.col("signature")).alias("text"))
        hits = search.hybrid(docs, "id", "text", query, k, self.vectors, "id", "embedding", vector, self.index)
        return hits.join(self.functions.select("id", "name", "filePath"), "id").orderBy(F.desc("score"), "id")

    def process(self, text: str) -> DataFrame:
        """Members of the first process whose name holds a text."""
        first = self.members.filter(F.contains("process", F.lit(text))).agg(F.min("process").alias("process"))
        return self.members.join(first, "process").orderBy("id").limit(50)

    def detect_changes(self, diff: DataFrame, whole_range: bool = False) -> DataFrame:
        """Functions a diff (diff_id, n, line) touches, by hunk or by each file's whole range: how many callers within three
        calls, the first of them, and the processes they are part of."""
        return changes.report(self.functions, self.calls, self._touched(diff, whole_range), self.members)

    def change_summary(self, diff: DataFrame, whole_range: bool = False) -> DataFrame:
        """One row for a whole diff: functions, processes and domains that it touches."""
        touched = self._touched(diff, whole_range).join(self.functions.select("id", "domain"), "id")
        return changes.summary(touched, self.members if self.members is not None else self.functions.limit(0).select("id", F.lit("").alias("process")))

    def _touched(self, diff: DataFrame, whole_range: bool) -> DataFrame:
        by = ["diff_id", "filePath"] + ([] if whole_range else ["hunk"])
        return changes.changed_functions(changes.line_ranges(changes.changed_lines(diff), by), self.functions).select("id", "name").distinct()

    def subgraph(self, symbol: str, depth: int = 2) -> tuple[DataFrame, DataFrame]:
        nodes = traverse.subgraph_nodes(self.calls, self.find(symbol).select("id"), depth)
        return nodes, traverse.induced(self.calls, nodes)

    def stats(self) -> DataFrame:
        return stats.totals(functions=self.functions, edges=self.calls).crossJoin(stats.coverage(self.functions, self.calls).drop("functions"))  # one row each

    def risk(self, low_confidence: int = 50) -> dict[str, DataFrame]:
        low = self.calls.filter(F.col("confidence") < low_confidence).orderBy("confidence", "src", "dst").limit(30)
        return {"fan_in": stats.fan_in(self.calls, self.functions, 2, 20), "coupling": stats.coupling(self.calls, self.functions), "low_confidence": low}

    def sql(self, text: str, **args) -> DataFrame:
        """Read-only SQL over the views functions and calls, with named parameters."""
        self.functions.createOrReplaceTempView("functions")
        self.calls.createOrReplaceTempView("calls")
        return self.spark.sql(text, args=args)

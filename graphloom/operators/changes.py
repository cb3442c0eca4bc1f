"""Diffs to functions: changed lines, the functions they touch, who is affected."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialize


def changed_lines(diff: DataFrame, group: str = "diff_id") -> DataFrame:
    """group, filePath, hunk, line of a unified diff given as (group, n, line): the file carries forward to its hunks.

    ``+++ b/`` names the file; ``@@ -a,b +c,d @@`` adds lines c to c + d - 1 (d is 1 where left out, 0 adds none). Only
    headers of files and hunks are shuffled, never the lines of a diff.
    """
    head = diff.filter(F.col("line").startswith("+++ ") | F.col("line").startswith("@@")).select(group, "n", "line")
    w = Window.partitionBy(group).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    file = F.when(F.col("line").startswith("+++ "), F.regexp_extract("line", "^\\+\\+\\+ b/(.*)$", 1))
    rows = head.withColumn("filePath", F.last(file, ignorenulls=True).over(w)).filter(F.col("line").startswith("@@") & (F.col("filePath") != ""))
    p = "^@@ -[0-9]+(?:,[0-9]+)? \\+([0-9]+)(?:,([0-9]+))? @@"
    start, count = F.regexp_extract("line", p, 1), F.regexp_extract("line", p, 2)
    rows = rows.filter(start != "").withColumn("s", start.cast("int")).withColumn("c", F.when(count == "", 1).otherwise(count.cast("int"))).filter("c > 0")
    return rows.select(group, "filePath", F.col("n").alias("hunk"), F.explode(F.expr("sequence(s, s + c - 1)")).alias("line"))


def line_ranges(lines: DataFrame, by: list[str]) -> DataFrame:
    return lines.groupBy(*by).agg(F.min("line").alias("first"), F.max("line").alias("last"))


def changed_functions(ranges: DataFrame, functions: DataFrame, bucket: int = 64) -> DataFrame:
    """Functions whose span meets a range (filePath, first, last), each once per range's other columns.

    Both sides are repeated for the stretches of lines they touch and joined on (file, stretch)."""
    keys = [c for c in ranges.columns if c not in ("first", "last")]
    cut = ranges.withColumn("_b", F.explode(F.sequence(F.expr(f"first div {bucket}"), F.expr(f"last div {bucket}"))))
    spans = functions.select("id", "name", "filePath", "lineStart", "lineEnd").withColumn("_b", F.explode(F.sequence(F.expr(f"lineStart div {bucket}"), F.expr(f"lineEnd div {bucket}"))))
    return cut.join(spans, ["filePath", "_b"]).filter("lineStart <= last AND lineEnd >= first").select(*keys, "id", "name").distinct()


def callers_near(calls: DataFrame, starts: DataFrame, hops: int, most: int) -> DataFrame:
    """start, node, depth: distinct callers within ``hops`` calls of each start (id), nearest first.

    A start that has ``most`` of them goes no further, so a much-called function costs its direct callers only.
    """
    step = calls.select(F.col("dst").alias("node"), F.col("src").alias("_s")).distinct()
    front = materialize(starts.select(F.col("id").alias("start"), F.col("id").alias("node")).distinct(), "near")
    seen = None
    for d in range(1, hops + 1):
        new = front.join(step, "node").select("start", F.col("_s").alias("node")).distinct()
        if seen is not None:
            new = new.join(seen, ["start", "node"], "left_anti")
        new = materialize(new.withColumn("depth", F.lit(d)), "near")
        seen = new if seen is None else seen.unionByName(new)
        if d < hops:
            done = seen.groupBy("start").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= most).select("start")
            front = new.select("start", "node").join(done, "start", "left_anti")
    return seen


def affected(functions: DataFrame, calls: DataFrame, changed: DataFrame, hops: int = 3, most: int = 10) -> DataFrame:
    """id, name, callers: distinct functions within ``hops`` calls of each changed function, counted up to ``most``."""
    near = callers_near(calls, changed.select("id"), hops, most).groupBy(F.col("start").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return changed.select("id", "name").distinct().join(near, "id", "left").select("id", "name", F.least(F.coalesce("n", F.lit(0)), F.lit(most)).cast("long").alias("callers"))


def report(functions: DataFrame, calls: DataFrame, changed: DataFrame, members: DataFrame | None = None, hops: int = 3, most: int = 10, shown: int = 5) -> DataFrame:
    """id, name, callers, shown, processes of each changed function.

    ``callers`` counts the distinct functions within ``hops`` calls up to ``most``, ``shown`` has the names of the nearest by
    depth, name and id, ``processes`` those that the function is part of. Only what is shown is gathered.
    """
    one = changed.select("id", "name").distinct()
    near = callers_near(calls, one.select("id"), hops, most).withColumnRenamed("start", "id")
    named = near.join(functions.select(F.col("id").alias("node"), F.col("name").alias("c")), "node")
    first = named.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("depth", "c", "node"))).filter(F.col("r") <= shown)
    first = first.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "c"))), lambda x: x["c"]).alias("shown"))
    counts = near.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    out = one.join(counts, "id", "left").join(first, "id", "left")
    if members is not None:
        part = members.join(one.select("id"), "id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("process")).alias("processes"))
        out = out.join(part, "id", "left")
    else:
        out = out.withColumn("processes", F.lit(None).cast("array<string>"))
    none = F.array().cast("array<string>")
    return out.select("id", "name", F.least(F.coalesce("n", F.lit(0)), F.lit(most)).cast("long").alias("callers"), F.coalesce("shown", none).alias("shown"), F.coalesce("processes", none).alias("processes"))


def summary(changed: DataFrame, members: DataFrame) -> DataFrame:
    """One row: how many functions changed, their first names, the processes and domains they belong to.

    changed (id, name, domain), members (id, process). Only the shown few are gathered: each list is cut before it is collected.
    """
    some = changed.orderBy("id").limit(5).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "name"))), lambda x: x["name"]), ", ").alias("names"))
    touched = changed.join(members, "id").select("process").distinct()
    shown = touched.orderBy("process").limit(5).agg(F.array_join(F.array_sort(F.collect_list("process")), ", ").alias("processes"))
    domains = changed.select("domain").distinct().agg(F.array_join(F.array_sort(F.collect_list("domain")), ", ").alias("domains"))
    counts = changed.agg(F.count(F.lit(1)).alias("n_changed")).crossJoin(touched.agg(F.count(F.lit(1)).alias("n_processes")))
    return counts.crossJoin(some).crossJoin(shown).crossJoin(domains)  # one row each

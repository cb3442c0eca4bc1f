"""Bounded traversals over an edge table (src, dst): trails, which repeat no edge, and breadth-first levels.

Frontiers are tables. A trail carries its edges as an array; a level keeps nodes only. Steps are joins on the node; the
optimiser broadcasts whichever side is small when it runs. Few levels are one plan, whose equal exchanges run once; deeper
searches drop what was seen by an anti join and cut lineage every level. Where only the first trails in order are asked for,
no more than a beam of them is ever held: see ``first_trails``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialize

#: Levels that one plan takes.
FEW = 4


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(*[F.col(c).alias({"src": "dst", "dst": "src"}.get(c, c)) for c in edges.columns])


def trails(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """start, node, depth, path (nodes), steps (edges as 'src>dst'): every trail of 1 to ``depth`` edges from ``starts`` (id)."""
    step = edges.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), F.concat_ws(">", "src", "dst").alias("_e"))
    level = starts.join(step, F.col("id") == F.col("_s")).select(
        F.col("id").alias("start"), F.col("_d").alias("node"), F.lit(1).alias("depth"), F.array("_s", "_d").alias("path"), F.array("_e").alias("steps")
    )
    out = level
    for d in range(2, depth + 1):
        level = level.join(step, (F.col("node") == F.col("_s")) & ~F.array_contains("steps", F.col("_e"))).select(
            "start", F.col("_d").alias("node"), F.lit(d).alias("depth"), F.concat("path", F.array("_d")).alias("path"), F.concat("steps", F.array("_e")).alias("steps")
        )
        out = out.unionByName(level)
    return out


def levels(edges: DataFrame, starts: DataFrame, depth: int, keep_start: bool = False) -> DataFrame:
    """start, node, depth: least number of edges (1 to ``depth``) from each start to each node.

    A start is a node of itself only by a cycle, or at depth 0 with ``keep_start``.
    """
    step = edges.select(F.col("src").alias("_s"), F.col("dst").alias("_d")).distinct()
    front = starts.select(F.col("id").alias("start"), F.col("id").alias("node"))
    next_ = lambda df: df.join(step, F.col("node") == F.col("_s")).select("start", F.col("_d").alias("node")).distinct()
    seen = front.withColumn("depth", F.lit(0)).limit(0) if not keep_start else front.withColumn("depth", F.lit(0))
    if depth <= FEW:
        for d in range(1, depth + 1):
            front = next_(front)
            seen = seen.unionByName(front.withColumn("depth", F.lit(d)))
        return seen.groupBy("start", "node").agg(F.min("depth").alias("depth"))
    for d in range(1, depth + 1):
        new = materialize(next_(front).join(seen, ["start", "node"], "left_anti"), "level")
        if new.isEmpty():
            break
        seen, front = seen.unionByName(new.withColumn("depth", F.lit(d))), new
    return seen


def steps_left(edges: DataFrame, goals: DataFrame, depth: int) -> DataFrame:
    """node, left: that some walk of exactly ``left`` edges (0 to ``depth``) leads from the node to a goal (id)."""
    step = edges.select(F.col("src").alias("_s"), F.col("dst").alias("node")).distinct()
    level = materialize(goals.select(F.col("id").alias("node")).distinct(), "goals")
    out = level.withColumn("left", F.lit(0))
    for d in range(1, depth + 1):
        level = materialize(level.join(step, "node").select(F.col("_s").alias("node")).distinct(), "goals")
        out = out.unionByName(level.withColumn("left", F.lit(d)))
    return out


def first_trails(edges: DataFrame, starts: DataFrame | None, left: DataFrame, length: int, most: int) -> DataFrame:
    """path, steps of the first ``most`` trails of exactly ``length`` edges that end at a goal, in order of 'a>b>c'.

    left (node, left) as in ``steps_left``: a beginning whose node cannot reach a goal in what is left is dropped. Of the
    others only the first stay: whatever extends a later one is later itself. A beginning may still fail, since trails
    repeat no edge; if too few are found, a wider beam is tried, until one holds all. Without ``starts`` any node starts.
    """
    step = edges.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), F.concat_ws(">", "src", "dst").alias("_e"))
    can = lambda df, k: df.join(left.filter(F.col("left") == length - k).select("node"), "node", "left_semi")
    text = lambda p: F.concat(F.array_join(p, ">"), F.lit(">"))
    begin = can((starts if starts is not None else left.filter(F.col("left") == length).select(F.col("node").alias("id"))).select(F.col("id").alias("node")).distinct(), 0)
    begin = begin.select("node", F.array("node").alias("path"), F.array().cast("array<string>").alias("steps"))
    beam = 4 * most
    while True:
        now, full = begin.orderBy(text("path")).limit(beam), False
        for k in range(1, length + 1):
            now = now.join(step, (F.col("node") == F.col("_s")) & ~F.array_contains("steps", F.col("_e")))
            now = can(now.select(F.col("_d").alias("node"), F.concat("path", F.array("_d")).alias("path"), F.concat("steps", F.array("_e")).alias("steps")), k)
            now = materialize(now.orderBy(text("path")).limit(beam), "trails")
            n = now.count()
            full = full or n >= beam
            if not n:
                break
        # a beam that was full has left out later ones only
        if n >= most or not full:
            return now.orderBy(text("path")).limit(most).select("path", "steps")
        beam *= 16


def leaves(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes (id) without an outgoing edge."""
    return nodes.join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_anti")


def _first(edges: DataFrame, starts: DataFrame | None, leaving: list[tuple[int, DataFrame]], limit: int) -> DataFrame:
    """path, steps, depth of the first trails in order of depth and path; ``leaving`` has each depth and its ``steps_left``."""
    out, found = None, 0
    for d, left in leaving:
        if found >= limit:
            break
        got = first_trails(edges, starts, left, d, limit - found).withColumn("depth", F.lit(d))
        out = got if out is None else out.unionByName(got)
        found += got.count()  # at most ``limit``
    return out


def call_chain(calls: DataFrame, starts: DataFrame, depth: int, limit: int | None = 20) -> DataFrame:
    """start, node, depth, path, steps: trails that end at a node without callees or are ``depth`` long, in order of depth and path."""
    if limit is None:
        t = trails(calls, starts, depth)
        ends = calls.select(F.col("src").alias("node"), F.lit(True).alias("goes_on")).distinct()
        return t.join(ends, "node", "left").filter(F.col("goes_on").isNull() | (F.col("depth") == depth)).drop("goes_on").select("start", "node", "depth", "path", "steps")
    nodes = calls.select(F.col("src").alias("id")).unionByName(calls.select(F.col("dst").alias("id"))).distinct()
    to_leaf = steps_left(calls, leaves(calls, nodes), depth - 1)
    got = _first(calls, starts, [(d, to_leaf) for d in range(1, depth)] + [(depth, steps_left(calls, nodes, depth))], limit)
    return got.select(F.col("path")[0].alias("start"), F.element_at("path", -1).alias("node"), "depth", "path", "steps").orderBy("depth", F.array_join("path", ">"))


def with_call_sites(chains: DataFrame, calls: DataFrame) -> DataFrame:
    """Chains (path) with ``edges``: confidence and call site of each step."""
    each = chains.select("path", F.posexplode(F.expr("transform(sequence(1, size(path) - 1), i -> named_struct('src', path[i - 1], 'dst', path[i]))")).alias("k", "e")).select("path", "k", "e.*")
    told = each.join(calls.select("src", "dst", "confidence", "callSite"), ["src", "dst"]).groupBy("path", "k").agg(F.min(F.struct("confidence", "callSite")).alias("e"))
    lists = told.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "e"))), lambda x: x["e"]).alias("edges"))
    return chains.join(lists, "path", "left").orderBy("depth", F.array_join("path", ">"))


def impact_scope(calls: DataFrame, target: DataFrame, depth: int = 5, limit: int | None = 50) -> DataFrame:
    """Callers of the target, one row per trail: caller, depth, call_path from caller to target, in order of depth and path."""
    if limit is None:
        return trails(reverse(calls), target, depth).select(F.col("start").alias("target"), F.col("node").alias("caller"), "depth", F.reverse("path").alias("call_path"))
    got = _first(calls, None, [(d, left) for left in [steps_left(calls, target, depth)] for d in range(1, depth + 1)], limit)
    return got.select(F.element_at("path", -1).alias("target"), F.col("path")[0].alias("caller"), "depth", F.col("path").alias("call_path")).orderBy("depth", F.array_join("call_path", ">"))


def impact_levels(calls: DataFrame, target: DataFrame, depth: int = 5) -> DataFrame:
    """Callers by least depth, the target itself left out."""
    got = levels(reverse(calls), target, depth).filter("node <> start")
    return got.select(F.col("start").alias("target"), F.col("node").alias("caller"), "depth")


def subgraph_nodes(calls: DataFrame, center: DataFrame, depth: int, back: int = 2, limit: int = 80) -> DataFrame:
    """id, fan_in of the nodes around a center: up to ``depth`` (1 to 6) steps out and ``back`` in."""
    depth = max(1, min(depth, 6))
    near = levels(calls, center, depth).select(F.col("node").alias("id")).unionByName(levels(reverse(calls), center, back).select(F.col("node").alias("id"))).unionByName(center.select("id")).distinct()
    fan = calls.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("fan_in"))
    return near.join(fan, "id", "left").select("id", F.coalesce("fan_in", F.lit(0)).cast("long").alias("fan_in")).orderBy(F.desc("fan_in"), "id").limit(limit)


def induced(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between nodes of a set, confidence 0 or null shown as 90."""
    got = calls.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return got.select("src", "dst", F.expr("CAST(coalesce(nullif(confidence, 0), 90) AS INT)").alias("confidence"))


def entry_points(functions: DataFrame, patterns: list[str], branch: str = "master", limit: int = 200) -> DataFrame:
    """Functions of the branch or master that are public or named like an entry point."""
    named = F.exists(F.array(*map(F.lit, patterns)), lambda p: F.contains(F.col("name"), p))
    return functions.filter(F.col("branch").isin(branch, "master") & (F.col("isPublic") | named)).orderBy("id").limit(limit)


def process_trace(calls: DataFrame, functions: DataFrame, entries: DataFrame, depth: int = 15, most: int = 50, branch: str = "master") -> DataFrame:
    """start, node, depth: the nodes on an entry's ways to functions of a known domain on the branch, nearest first.

    Only the end of a way must be such a function: a node of unknown domain counts if it leads on to one within ``depth``. At most
    ``most`` nodes with the entry; entries that reach nothing are left out.
    """
    from pyspark.sql import Window

    valid = functions.filter("domain <> 'unknown'").filter(F.col("branch").isin(branch, "master")).select(F.col("id").alias("node"))
    all_ = materialize(levels(calls, entries.select("id"), depth), "trace")
    kept = all_.join(valid, "node", "left_semi").select("start", "node", "depth")
    rest = all_.join(valid, "node", "left_anti").select("start", "node", "depth")
    step = calls.select(F.col("src").alias("node"), F.col("dst").alias("next")).distinct()
    front = kept.select("start", F.col("node").alias("next"))
    for k in range(1, depth):
        if rest.isEmpty():
            break
        more = materialize(rest.filter(F.col("depth") + k <= depth).join(step, "node").join(front, ["start", "next"], "left_semi").select("start", "node", "depth").distinct(), "trace")
        if more.isEmpty():
            break
        kept, rest = kept.unionByName(more), rest.join(more.select("start", "node"), ["start", "node"], "left_anti")
        front = more.select("start", F.col("node").alias("next"))
    rank = F.row_number().over(Window.partitionBy("start").orderBy("depth", "node"))
    got = kept.filter("node <> start").withColumn("r", rank).filter(F.col("r") < most).select("start", "node", "depth")
    first = got.select("start").distinct().select("start", F.col("start").alias("node"), F.lit(0).alias("depth"))
    return first.unionByName(got)

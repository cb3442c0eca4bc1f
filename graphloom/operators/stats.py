"""Counts over the graph: totals, coverage, risk lists, communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def totals(**tables: DataFrame) -> DataFrame:
    """One row with the count of each table; a missing kind is 0, not nothing."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out


def coverage(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """functions, calling, percent of functions with at least one call out, also to stubs."""
    got = functions.join(calls.select(F.col("src").alias("id")).distinct().withColumn("c", F.lit(1)), "id", "left").agg(F.count(F.lit(1)).alias("functions"), F.count("c").alias("calling"))
    return got.select("functions", "calling", F.when(F.col("functions") > 0, F.round(100.0 * F.col("calling") / F.col("functions"), 1)).otherwise(0.0).alias("percent"))


def fan_in(calls: DataFrame, functions: DataFrame, above: int, limit: int) -> DataFrame:
    """id, name, filePath, fanIn of the functions most called: counted by key before names are joined."""
    top = calls.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("fanIn")).filter(F.col("fanIn") > above)
    return top.join(functions.select("id", "name", "filePath"), "id").orderBy(F.desc("fanIn"), "id").limit(limit)


def coupling(calls: DataFrame, functions: DataFrame, limit: int = 10) -> DataFrame:
    """filePath, coupling: edges that leave each file."""
    f = functions.select("id", "filePath")
    joined = calls.join(f.select(F.col("id").alias("src"), F.col("filePath").alias("sf")), "src").join(f.select(F.col("id").alias("dst"), F.col("filePath").alias("df")), "dst")
    return joined.filter("sf <> df").groupBy(F.col("sf").alias("filePath")).agg(F.count(F.lit(1)).alias("coupling")).orderBy(F.desc("coupling"), "filePath").limit(limit)


def domain_communities(functions: DataFrame, branch: str) -> DataFrame:
    """id, domain, memberCount, source: functions grouped by known domain."""
    known = functions.filter("domain IS NOT NULL AND domain <> 'unknown'")
    got = known.groupBy("domain").agg(F.count(F.lit(1)).alias("memberCount"))
    return got.select(F.concat(F.lit(f"community:{branch}:"), "domain").alias("id"), "domain", "memberCount", F.lit("domain_fallback").alias("source"))


def top_domains(members: DataFrame) -> DataFrame:
    """communityId, domain, n: the most frequent domain of each community (communityId, domain)."""
    counts = members.groupBy("communityId", "domain").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("communityId").agg(F.min(F.struct((-F.col("n")).alias("m"), "domain")).alias("b"))
    return best.select("communityId", F.col("b.domain").alias("domain"), (-F.col("b.m")).alias("n"))


def modularity(calls: DataFrame, members: DataFrame, weight: str = "confidence") -> DataFrame:
    """communities, modularity of a grouping (id, communityId) of the undirected weighted call graph."""
    m = members.select(F.col("id").alias("src"), F.col("communityId").alias("a"))
    e = calls.filter("src <> dst").select("src", "dst", F.col(weight).cast("double").alias("w"))
    both = e.join(m, "src").join(m.select(F.col("src").alias("dst"), F.col("a").alias("b")), "dst").select("a", "b", "w")
    each = both.select(F.col("a").alias("c"), (F.col("a") == F.col("b")).cast("int").alias("i"), "w").unionByName(both.select(F.col("b").alias("c"), F.lit(0).alias("i"), "w"))
    by = each.groupBy("c").agg(F.sum(F.col("w") * F.col("i")).alias("inside"), F.sum("w").alias("degree"))
    total = both.agg(F.sum("w").alias("m"))
    q = F.col("inside") / F.col("m") - F.pow(F.col("degree") / (2 * F.col("m")), F.lit(2))
    return by.crossJoin(total).agg(F.count(F.lit(1)).alias("communities"), F.round(F.sum(q), 6).alias("modularity"))


def label_propagation(calls: DataFrame, rounds: int = 5) -> DataFrame:
    """id, communityId: each node takes the label of largest total weight around it, least label on ties; fixed rounds.

    Labels are counted by (node, label), so a hub is one row per distinct label around it.
    """
    from ..sources.tables import materialize

    e = calls.filter("src <> dst").select("src", "dst", F.col("confidence").cast("long").alias("w"))
    both = materialize(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w")), "lpa-edges")
    labels = both.select(F.col("src").alias("id"), F.col("src").alias("communityId")).distinct()
    for _ in range(rounds):
        around = both.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "communityId").agg(F.sum("w").alias("w"))
        stay = around.unionByName(labels.withColumn("w", F.lit(1).cast("long"))).groupBy("id", "communityId").agg(F.sum("w").alias("w"))
        labels = materialize(stay.groupBy("id").agg(F.min_by("communityId", F.struct((-F.col("w")).alias("m"), "communityId")).alias("communityId")), "lpa-labels")
    return labels


def undirected(calls: DataFrame) -> DataFrame:
    """src, dst, w: each pair of nodes in both directions with the confidence of its calls; a call to oneself once."""
    e = calls.select("src", "dst", F.coalesce(F.col("confidence"), F.lit(0)).cast("double").alias("w")).filter("w > 0")
    return e.unionByName(e.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def _quality(edges: DataFrame, labels: DataFrame, total: float) -> float:
    """Modularity of labels (id, c) of symmetric edges (src, dst, w); a loop has its weight once in each end's degree."""
    own = edges.join(labels.select(F.col("id").alias("src"), F.col("c").alias("a")), "src").join(labels.select(F.col("id").alias("dst"), F.col("c").alias("b")), "dst")
    by = own.groupBy("a").agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("i"), F.sum("w").alias("d"))
    return float(by.agg(F.sum(F.col("i") / total - (F.col("d") / total) ** 2)).first()[0] or 0.0)


def louvain(calls: DataFrame, rounds: int = 10, levels: int = 5, least: float = 1e-4) -> DataFrame:
    """id, communityId by Louvain's method on the undirected graph weighted by confidence; a community is named by its least id.

    In a round all nodes weigh their neighbours' communities by the gain in modularity from counts by (node, community), so a
    hub is a row per community around it. Those whose hash is on turn move to the best, the least on ties: neighbours that
    swap places every time don't. A round counts only if modularity rises by ``least``; then communities become the
    nodes of the next level. Rounds and levels are bounded; modularity never falls.
    """
    from ..sources.tables import discard, materialize

    edges = materialize(undirected(calls), "louvain-edges")
    total = edges.agg(F.sum("w")).first()[0]
    nodes = edges.select(F.col("src").alias("id")).distinct()
    told = materialize(nodes.select("id", F.col("id").alias("c")), "louvain")
    if not total:
        return told.select("id", F.col("c").alias("communityId"))
    for level in range(levels):
        degree = materialize(edges.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")), "louvain-degrees")
        labels = materialize(degree.select("id", F.col("id").alias("c")), "louvain-labels")
        quality, moved, idle = _quality(edges, labels, total), False, 0
        for r in range(rounds):
            sums = labels.join(degree, "id").groupBy("c").agg(F.sum("k").alias("s"))
            around = edges.filter("src <> dst").join(labels.select(F.col("id").alias("dst"), "c"), "dst").groupBy(F.col("src").alias("id"), "c").agg(F.sum("w").alias("w"))
            own = labels.select("id", F.col("c").alias("own")).join(degree, "id")
            stay = labels.select("id", "c", F.lit(0.0).alias("w"))
            weighed = around.unionByName(stay).groupBy("id", "c").agg(F.sum("w").alias("w")).join(sums, "c").join(own, "id")
            gain = F.col("w") - F.col("k") * (F.col("s") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)) / total
            best = weighed.groupBy("id").agg(F.min(F.struct(F.round(-gain, 9).alias("g"), (F.col("c") != F.col("own")).cast("int").alias("o"), "c")).alias("b"), F.first("own").alias("own"))
            turn = F.pmod(F.xxhash64("id", F.lit(r)), F.lit(2)) == 0
            new = materialize(best.select("id", F.when(turn, F.col("b.c")).otherwise(F.col("own")).alias("c")), "louvain-labels")
            now = _quality(edges, new, total)
            if now < quality + least:
                discard(new)
                idle += 1
                if idle == 2:
                    break
                continue
            discard(labels)
            labels, quality, moved, idle = new, now, True, 0
        if not moved:
            break
        told = materialize(told.join(labels.select(F.col("id").alias("c"), F.col("c").alias("_c")), "c").select("id", F.col("_c").alias("c")), "louvain")
        edges = edges.join(labels.select(F.col("id").alias("src"), F.col("c").alias("a")), "src").join(labels.select(F.col("id").alias("dst"), F.col("c").alias("b")), "dst")
        edges = materialize(edges.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")), "louvain-edges")
    names = told.groupBy("c").agg(F.min("id").alias("communityId"))
    return told.join(names, "c").select("id", "communityId")


def communities(functions: DataFrame, members: DataFrame, branch: str, source: str = "louvain") -> tuple[DataFrame, DataFrame]:
    """Nodes (id, communityId, domain, memberCount, branch, source) of communities (id, communityId) of a branch's functions,
    with the domain most of them have, and their links (id, communityId) to those nodes."""
    own = functions.filter(F.col("branch") == branch).select("id", F.coalesce("domain", F.lit("unknown")).alias("domain")).join(members, "id")
    count = own.groupBy("communityId").agg(F.count(F.lit(1)).alias("memberCount"))
    name = F.concat(F.lit(f"community:{branch}:"), F.col("communityId"))
    nodes = count.join(top_domains(own).select("communityId", "domain"), "communityId")
    return nodes.select(name.alias("id"), "communityId", "domain", "memberCount", F.lit(branch).alias("branch"), F.lit(source).alias("source")), own.select("id", name.alias("communityId"))


def top_per_group(rows: DataFrame, group: str, order: list, n: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")

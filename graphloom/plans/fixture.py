"""The star tables read as a property graph, so that every graph operator runs over whole tables.

Parts are functions, brands files, types domains; a call leads from each line item to the next one of its order. Trails and
leaves are asked of a thinner graph, of line items of quantity 40 or more: the whole one has no leaf, and too many trails for
another engine to list them all. Derived tables are written once per session and folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import materialize, read

_built: dict[tuple, DataFrame] = {}


def _once(spark: SparkSession, sf: str, name: str, make) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _built:
        _built[key] = materialize(make(), name)
    return _built[key]


def functions(spark: SparkSession, sf: str) -> DataFrame:
    """id, pk, name, qualifiedName, filePath, lineStart, lineEnd, isPublic, domain, branch, signature."""

    def make():
        p = read(spark, sf, "part")
        rank = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
        p = p.withColumn("lineStart", (10 * rank).cast("int"))
        return p.select(
            F.concat(F.lit("func:"), F.col("p_partkey")).alias("id"),
            F.col("p_partkey").alias("pk"),
            F.col("p_name").alias("name"),
            F.concat("p_brand", F.lit("."), "p_name", F.lit("#"), "p_partkey").alias("qualifiedName"),
            F.col("p_brand").alias("filePath"),
            "lineStart",
            (F.col("lineStart") + 9).alias("lineEnd"),
            (F.col("p_size") <= 10).alias("isPublic"),
            F.lower("p_type").alias("domain"),
            F.when(F.col("p_size") > 40, "feature").otherwise("master").alias("branch"),
            F.concat(F.lit("func "), "p_name", F.lit("()")).alias("signature"),
            F.col("p_size").alias("size"),
        )

    return _once(spark, sf, "functions", make)


def calls(spark: SparkSession, sf: str, thin: bool = False) -> DataFrame:
    """src, dst, confidence, callSite, calleeRaw: the call graph."""

    def make():
        w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
        line = read(spark, sf, "lineitem").filter("l_quantity >= 40" if thin else "true").select(F.col("l_partkey").alias("s"), F.lead("l_partkey").over(w).alias("d"))
        pairs = line.filter("d IS NOT NULL").distinct()
        f = functions(spark, sf)
        return (
            pairs.join(f.select(F.col("pk").alias("s"), F.col("id").alias("src"), F.col("lineStart").alias("a")), "s")
            .join(f.select(F.col("pk").alias("d"), F.col("id").alias("dst"), F.col("name").alias("calleeRaw")), "d")
            .select("src", "dst", F.expr("CAST(50 + (s * 7 + d * 3) % 50 AS INT)").alias("confidence"), F.expr("CAST(a + d % 9 AS INT)").alias("callSite"), "calleeRaw")
        )

    return _once(spark, sf, "thin" if thin else "calls", make)


def unresolved(spark: SparkSession, sf: str) -> DataFrame:
    """The calls before resolution: target a stub of the callee's name, confidence 0 on every tenth; one edge per caller and name."""
    c = calls(spark, sf).groupBy("src", "calleeRaw").agg(F.min("confidence").alias("confidence"))
    return c.select("src", F.concat(F.lit("func:unresolved::"), "calleeRaw").alias("dst"), "calleeRaw", F.when(F.col("confidence") % 10 == 0, 0).otherwise(F.col("confidence")).alias("confidence"), F.lit(False).alias("resolved"))


def hub(spark: SparkSession, sf: str, thin: bool = False) -> DataFrame:
    """id of the most called function, the least id on ties."""
    return calls(spark, sf, thin).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id").limit(1).select("id")


def caller(spark: SparkSession, sf: str, thin: bool = False) -> DataFrame:
    """id of the function with most callees, the least id on ties."""
    return calls(spark, sf, thin).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id").limit(1).select("id")


def members(spark: SparkSession, sf: str, thin: bool = False) -> DataFrame:
    """id, process: a process per domain and entry brand, of the functions that its files' public functions call."""
    f = functions(spark, sf)
    entry = f.filter("isPublic").select(F.col("id").alias("src"), F.concat(F.lit("process:"), "filePath").alias("process"))
    out = calls(spark, sf, thin).join(entry, "src").select(F.col("dst").alias("id"), "process")
    return out.unionByName(entry.select(F.col("src").alias("id"), "process")).distinct()


def sources(spark: SparkSession, sf: str) -> DataFrame:
    """path, source: a Swift file per brand with a class, and a function per part that calls the parts that its line items lead to.

    A function takes six lines: annotation, head, body, calls, return, brace; every third callee is called on a receiver.
    """

    def make():
        digits = "replace(filePath, 'Brand#', '')"
        to = calls(spark, sf).select(F.col("src").alias("id"), F.regexp_extract("dst", "([0-9]+)$", 1).cast("long").alias("d"))
        said = to.groupBy("id").agg(F.expr("array_join(transform(array_sort(collect_set(d)), d -> concat(IF(d % 3 = 0, 'obj.', ''), 'f', d, '(x)')), '; ')").alias("said"))
        f = functions(spark, sf).join(said, "id", "left")
        head = "concat('    ', IF(isPublic, 'public ', ''), IF(size % 2 = 0, 'static ', ''), 'func f', pk, '(x: Int) {')"
        body = f"concat_ws('\\n', concat('    // CIGTerms: ', domain, ', b', {digits}, ' */'), {head}, '        let y = x', concat('        ', coalesce(said, '_ = y')), '        return', '    }}')"
        text = f.groupBy("filePath").agg(F.array_sort(F.collect_list(F.struct("pk", F.expr(body).alias("t")))).alias("b"))
        start = f"concat('import Kit', {digits}, '\\npublic class Brand', {digits}, ': Base, Loading {{\\n')"
        return text.select(F.expr(f"concat('app/Modules/M', {digits}, '/Brand', {digits}, '.swift')").alias("path"), F.expr(f"concat({start}, array_join(transform(b, x -> x.t), '\\n'), '\\n}}')").alias("source"))

    return _once(spark, sf, "sources", make)

"""Secret scan with corpus-wide ownership frequency. DataFrame and SQL functions only.

Every candidate is hashed; hashes are counted by distinct repositories and owners over the whole corpus.
A value that many owners or many repositories hold is a widely copied example; one that ``few_owners`` or fewer hold, in
``few_repositories`` or fewer, is owner-specific and looks live. Both are numbers and no shares, so that a verdict
does not hang on the size of the corpus. Spans of the three base kinds always stay. The method adds spans of kind ``owned``: long
tokens of letters and digits that no base kind covers and that are owner-specific.

Counting goes repository, owner, value, each level with map-side combining, so one value in a third of all
rows costs one row per task and level. Verdicts go back by a join on the value whose verdict side has one
row per value; a frequent value is split by adaptive execution.

Defined results: null text is empty text without spans; a null owner is an owner of its own; rows that repeat
id and text get the same result each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .native import listed, quoted, spans

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The same spans as runs of the class that are long enough: a run that is too short holds no match.
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
#: A whole run with a digit in it.
OWNED = r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{20,}+"
KINDS = ("assign", "access", "hex", "owned")
FEW_OWNERS, FEW_REPOSITORIES = 2, 2


def _kind(k: int, column: str, value: str, keep: str) -> str:
    return f"transform(filter({column}, x -> {keep}), x -> named_struct('s', x.s, 'k', {k}, 'e', x.e, 'v', md5({value})))"


def candidates(docs: DataFrame, id_col: str, text_col: str, owner: str, repository: str, whole: bool = False) -> DataFrame:
    """One row per document: id, key of its text, owner, repository, base spans and other candidates; and ``row``, all
    columns of the document, if it is wanted whole."""
    group = f"regexp_extract(x.v, {quoted(ASSIGN)}, 1)"
    kept = ["row"] if whole else []
    found = docs.select(
        *([F.struct("*").alias("row")] if whole else []),
        F.col(id_col).cast("long").alias("doc_id"),
        F.expr(f"coalesce(CAST({text_col} AS STRING), '')").alias("text"),
        F.expr(f"coalesce(CAST({owner} AS STRING), '')").alias("owner"),
        F.expr(f"coalesce(CAST({repository} AS STRING), '')").alias("repository"),
    ).select(
        *kept,
        "doc_id",
        "owner",
        "repository",
        F.xxhash64("text").alias("key"),
        spans("text", ASSIGN, 0).alias("a"),
        spans("text", ACCESS, 0).alias("b"),
        spans("text", HEX, 0).alias("c"),
        spans("text", OWNED, 0).alias("d"),
    )
    base = f"concat({_kind(0, 'a', group, f'length({group}) >= 6')}, {_kind(1, 'b', 'x.v', 'true')}, {_kind(2, 'c', 'x.v', 'true')})"
    mixed = "x.v RLIKE '[0-9]' AND x.v RLIKE '[A-Za-z]' AND NOT exists(base, y -> y.s < x.e AND x.s < y.e)"
    return found.withColumn("base", F.expr(base)).select(*kept, "doc_id", "owner", "repository", "key", "base", F.expr(_kind(3, "d", "x.v", mixed)).alias("more"))


def ownership(found: DataFrame) -> DataFrame:
    """Value, repositories, owners: distinct counts over the whole corpus."""
    each = found.select("owner", "repository", F.explode(F.concat("base", "more")).alias("x")).select("owner", "repository", F.col("x.v").alias("v"))
    by_repository = each.groupBy("v", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repository.groupBy("v", "owner").agg(F.count(F.lit(1)).alias("r"), F.sum("n").alias("n"))
    return by_owner.groupBy("v").agg(F.sum("r").alias("repositories"), F.count(F.lit(1)).alias("owners"), F.sum("n").alias("seen"))


def verdicts(counts: DataFrame, few_owners: int = FEW_OWNERS, few_repositories: int = FEW_REPOSITORIES) -> DataFrame:
    """The counts and whether a value is owner-specific."""
    return counts.withColumn("few", (F.col("owners") <= few_owners) & (F.col("repositories") <= few_repositories))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: str = "source", repository: str = "concat_ws('/', source, lang)", few_owners: int = FEW_OWNERS, few_repositories: int = FEW_REPOSITORIES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_live, n_shared, live, held: one row per input row.

    ``live`` lists the owner-specific spans, ``n_shared`` counts widely copied ones; ``held`` has the distinct owners and
    repositories of each candidate.
    """
    found = materialize(candidates(docs, id_col, text_col, owner, repository), "op8-candidates")
    few = verdicts(ownership(found), few_owners, few_repositories).select("v", "few", "owners", "repositories")
    each = found.filter("size(base) + size(more) > 0").select("doc_id", "key", F.explode(F.concat("base", "more")).alias("x"))
    told = (
        each.withColumn("v", F.col("x.v"))
        .join(few, "v")
        .groupBy("doc_id", "key")
        .agg(F.collect_set(F.struct("x.s", "x.k", "x.e", "few", "owners", "repositories")).alias("told"))
        .select(F.col("doc_id").alias("d"), F.col("key").alias("q"), "told")
    )
    rows = found.join(told, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("q")), "left")
    rows = rows.withColumn("told", F.expr("coalesce(told, array())")).withColumn("owned", F.expr("filter(told, x -> x.k = 3 AND x.few)"))
    plain = "transform(base, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e))"
    return rows.select(
        "doc_id",
        *[F.expr(f"CAST(size(filter(base, x -> x.k = {k})) AS LONG)").alias(f"n_{KINDS[k]}") for k in range(3)],
        F.expr(f"sha2({listed('base', KINDS)}, 256)").alias("base_sha256"),
        F.expr(listed(f"concat({plain}, transform(owned, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e)))", KINDS)).alias("spans"),
        F.expr("CAST(size(owned) AS LONG)").alias("n_owned"),
        F.expr("CAST(size(filter(told, x -> x.few)) AS LONG)").alias("n_live"),
        F.expr("CAST(size(filter(told, x -> NOT x.few AND x.k < 3)) AS LONG)").alias("n_shared"),
        F.expr(listed("filter(told, x -> x.few)", KINDS)).alias("live"),
        F.expr("transform(array_sort(told), x -> named_struct('s', x.s, 'k', x.k, 'e', x.e, 'owners', x.owners, 'repositories', x.repositories))").alias("held"),
    )


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: str = "source", repository: str = "concat_ws('/', source, lang)", few_owners: int = FEW_OWNERS, few_repositories: int = FEW_REPOSITORIES) -> DataFrame:
    """The documents, with all their columns, and stars in place of owner-specific secrets. Widely copied ones stay.

    Documents are written once with their candidates. Those without any pass as they are; only the others meet verdicts. Rows
    without an id, and rows that share one, are starred by their texts; null text stays null.
    """
    found = materialize(candidates(docs, id_col, text_col, owner, repository, whole=True), "op8-documents")
    few = materialize(verdicts(ownership(found), few_owners, few_repositories).filter("few").select("v"), "op8-live")
    some = "size(base) + size(more) > 0"
    each = found.filter(some).select("doc_id", "key", F.explode(F.concat("base", "more")).alias("x")).select("doc_id", "key", "x.s", "x.e", "x.v")
    # values that grow with the corpus: never broadcast
    live = each.join(few.hint("merge"), "v").groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("live"))
    live = live.select(F.col("doc_id").alias("d"), F.col("key").alias("q"), "live")
    rows = found.filter(some).join(live.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("q")), "left")
    at = docs.columns.index(text_col)
    text = F.expr(f"CASE WHEN live IS NULL THEN row.`{text_col}` ELSE aggregate(live, row.`{text_col}`, (t, x) -> overlay(t PLACING repeat('*', x.e - x.s) FROM x.s + 1 FOR x.e - x.s)) END")
    own = [F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    starred = [*own[:at], text.alias(text_col), *own[at + 1 :]]
    return found.filter(f"NOT ({some})").select(own).unionByName(rows.select(starred))


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return scan(table(spark, sf_dir, "documents")).drop("held")

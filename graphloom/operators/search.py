"""Ranking: BM25 over postings, exact nearest vectors, reciprocal rank fusion."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import cosine, terms
from ..sources.tables import materialize

K1, B, FLOOR, FUSE = 1.5, 0.75, 0.25, 60
#: Stands in postings for the document itself: no term is empty.
SELF = ""


def lengths(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.size(terms(F.col(text_col))).alias("dl"))


def term_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """term, df: documents with each term. Terms are made distinct in their row, so only terms are shuffled, combined first."""
    return docs.select(F.explode(F.array_distinct(terms(F.col(text_col)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _raw_idf(n: float, df):
    return F.log(F.lit(float(n)) - df + 0.5) - F.log(df + 0.5)


def mean_idf(docs: DataFrame, text_col: str, n: int) -> float:
    """Mean raw idf over all terms of the corpus."""
    return float(term_counts(docs, text_col).agg(F.avg(_raw_idf(n, F.col("df")))).first()[0] or 0)


def corpus_stats(docs: DataFrame, id_col: str, text_col: str) -> tuple[int, float, float]:
    """Documents, mean length, mean raw idf over all terms: three numbers."""
    n, mean = lengths(docs, id_col, text_col).agg(F.count(F.lit(1)), F.avg("dl")).first()
    return n, float(mean or 0), mean_idf(docs, text_col, n)


def postings(docs: DataFrame, id_col: str, text_col: str, only: list[str] | None = None) -> DataFrame:
    """id, row, dl, term, tf: each term of each row, and one entry with the empty term for the row itself.

    With ``only`` other terms are dropped before anything is counted or shuffled. Each text is cut into terms once.
    """
    t = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.coalesce(terms(F.col(text_col)), F.array().cast("array<string>")).alias("t"))
    each = t.select("id", "row", F.size("t").alias("dl"), F.explode(F.concat(F.array(F.lit(SELF)), F.col("t"))).alias("term"))
    if only is not None:
        each = each.filter(F.col("term").isin([SELF, *only]))
    return each.groupBy("id", "row", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def asked(spark: SparkSession, query: str) -> dict[str, int]:
    """The terms of a query and how often each occurs in it."""
    out: dict[str, int] = {}
    for t in spark.range(1).select(terms(F.lit(query))).first()[0]:
        out[t] = out.get(t, 0) + 1
    return out


def empty_ranking(entries: DataFrame) -> DataFrame:
    """id, score, rank without rows; ids have the type that they have in ``entries``."""
    return entries.select("id", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rank")).limit(0)


def scored(entries: DataFrame, words: dict[str, int], n: int, mean: float, df: dict[str, int], floor, k: int) -> DataFrame:
    """id, score, rank: the k best documents above 0. ``floor`` gives the idf of terms in more than half of the documents."""
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items() if d}
    if not raw:
        return empty_ranking(entries)
    low = floor() if any(v < 0 for v in raw.values()) else 0.0
    weights = entries.sparkSession.createDataFrame([(t, (low if v < 0 else v) * words[t]) for t, v in raw.items()], "term string, w double")
    norm = K1 * (1 - B + B * F.col("dl") / F.lit(mean))
    # as many weights as the query has terms
    each = entries.join(F.broadcast(weights), "term").select("id", "row", (F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)).alias("s"))
    total = each.groupBy("id", "row").agg(F.round(F.sum("s"), 6).alias("score")).drop("row")
    # the filter comes after the limit: scores above 0 come first anyway
    return ranked(total, "score", k).filter("score > 0")


def bm25(docs: DataFrame, id_col: str, text_col: str, query: str, k: int) -> DataFrame:
    """id, score, rank: the k best documents above 0 for a query; terms of the query count as often as they occur.

    One pass over the texts writes the entries of the query's terms; statistics and scores come from them. The mean idf, which
    takes all terms of the corpus, is only worked out if a query term needs it.
    """
    words = asked(docs.sparkSession, query)
    if not words:
        return empty_ranking(docs.select(F.col(id_col).alias("id")))
    entries = materialize(postings(docs, id_col, text_col, list(words)), "bm25-entries")
    counts = {r.term: (r.n, r.mean) for r in entries.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean")).collect()}  # the query's terms
    n, mean = counts.pop(SELF, (0, 0.0))
    return scored(entries, words, n, float(mean), {t: d for t, (d, _) in counts.items()}, lambda: FLOOR * mean_idf(docs, text_col, n), k)


class Index:
    """A stored BM25 index: ``entries`` (by term, so that a query reads few row groups) and ``df`` (term, df) under a folder.

    Several versions may lie in one folder; the newest that is complete counts. ``update`` writes a new version: entries of the
    documents that come anew or go are left out, theirs are added, the rest is taken over without its texts.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        at = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        done = [p.getPath().getName() for p in fs.listStatus(at) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p.getPath(), "df/_SUCCESS"))] if fs.exists(at) else []
        self.version = max((int(x[1:]) for x in done if x.startswith("v")), default=0)
        if not self.version:
            raise FileNotFoundError(f"no index in {folder}")
        self.entries, self.df = (spark.read.parquet(f"{self.folder}/v{self.version}/{x}") for x in ("entries", "df"))

    @staticmethod
    def _write(entries: DataFrame, folder: str, version: int) -> Index:
        spark, at = entries.sparkSession, f"{folder.rstrip('/')}/v{version}"
        entries.repartitionByRange("term", "id").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{at}/entries")
        spark.read.parquet(f"{at}/entries").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.avg("dl").alias("mean")).write.mode("overwrite").parquet(f"{at}/df")
        return Index(spark, folder)

    @staticmethod
    def build(docs: DataFrame, id_col: str, text_col: str, folder: str) -> Index:
        return Index._write(postings(docs, id_col, text_col), folder, 1)

    def update(self, changed: DataFrame, id_col: str, text_col: str, removed: DataFrame | None = None, folder: str | None = None) -> Index:
        """The index with documents that come anew (by id) and without ``removed`` (id), as a new version or in another folder."""
        gone = changed.select(F.col(id_col).alias("id"))
        gone = gone.unionByName(removed.select("id")) if removed is not None else gone
        kept = self.entries.join(gone.distinct(), "id", "left_anti")
        return Index._write(kept.unionByName(postings(changed, id_col, text_col).select(kept.columns)), folder or self.folder, self.version + 1)

    def search(self, query: str, k: int = 10) -> DataFrame:
        words = asked(self.spark, query)
        if not words:
            return empty_ranking(self.entries)
        counts = {r.term: (r.df, r.mean) for r in self.df.filter(F.col("term").isin([SELF, *words])).collect()}
        n, mean = counts.pop(SELF, (0, 0.0))
        every = lambda: FLOOR * float(self.df.filter(F.col("term") != SELF).agg(F.avg(_raw_idf(n, F.col("df")))).first()[0] or 0)
        return scored(self.entries.filter(F.col("term").isin(list(words))), words, n, float(mean), {t: d for t, (d, _) in counts.items()}, every, k)


def ranked(scored: DataFrame, by: str, k: int) -> DataFrame:
    """The k best by score, then id, with their rank. The window sees k rows."""
    top = scored.orderBy(F.desc(by), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), "id")).cast("long"))


def nearest(vectors: DataFrame, id_col: str, vector_col: str, query: list[float], k: int) -> DataFrame:
    """id, cos, score ((1 + cos) / 2), rank: exact nearest vectors.

    Vectors that are null, of another length than the query's, or all zeros point nowhere and are left out.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    some = vectors.filter(F.size(vector_col) == len(query))
    got = some.select(F.col(id_col).alias("id"), F.round(cosine(F.col(vector_col), q), 6).alias("cos")).filter("cos IS NOT NULL")
    return ranked(got, "cos", k).select("id", "cos", F.round((1 + F.col("cos")) / 2, 6).alias("score"), "rank")


def fuse(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """id, bm25_rank, vec_rank, score: reciprocal rank fusion of two rankings (id, rank)."""
    both = left.select("id", F.col("rank").alias("bm25_rank")).join(right.select("id", F.col("rank").alias("vec_rank")), "id", "full")
    part = lambda c: F.coalesce(1 / (FUSE + F.col(c)), F.lit(0.0))
    return both.withColumn("score", F.round(part("bm25_rank") + part("vec_rank"), 9)).orderBy(F.desc("score"), "id").limit(k)


def contains(docs: DataFrame, id_col: str, text_col: str, query: str, k: int) -> DataFrame:
    """Substring search without regard to case, in order of id, each with score 1."""
    hit = docs.filter(F.contains(F.lower(F.col(text_col)), F.lower(F.lit(query))))
    return hit.select(F.col(id_col).alias("id"), F.lit(1.0).alias("score")).orderBy("id").limit(k)


def hybrid(docs: DataFrame, id_col: str, text_col: str, query: str, k: int, vectors: DataFrame | None = None, vector_id: str = "id", vector_col: str = "embedding", query_vector: list[float] | None = None, index: Index | None = None) -> DataFrame:
    """id, bm25_rank, vec_rank, score: fused search over pools of 3 k; BM25 alone without a query vector; substrings, with
    score 1 and no ranks, if both are empty. A stored ``index`` saves reading the texts."""
    left = index.search(query, 3 * k) if index is not None else bm25(docs, id_col, text_col, query, 3 * k)
    # rankings of at most 3 k rows, used twice: written once
    left = materialize(left, "bm25-ranking")
    if vectors is not None and query_vector is not None:
        right = materialize(nearest(vectors, vector_id, vector_col, query_vector, 3 * k), "vector-ranking")
    else:
        right = left.limit(0)
    if left.isEmpty() and right.isEmpty():
        none = F.lit(None).cast("long")
        return contains(docs, id_col, text_col, query, k).select("id", none.alias("bm25_rank"), none.alias("vec_rank"), "score")
    return fuse(left, right, k)

"""The corpus pipeline: toxic documents go, one document of each group of near copies stays, leaking documents go,
owner-specific secrets are starred out, and what is left is packed into sequences.

Every stage but the last returns the columns of its documents, takes texts of any length whole, and leaves further columns, also
with clashing names, as they are; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import fresh, materialize, table
from graphloom.llm.op1 import without_leaks
from graphloom.llm.op2 import pack
from graphloom.llm.op4 import THRESHOLD, train, with_scores
from graphloom.llm.op7 import jaccard_components
from graphloom.llm.op8 import masked


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold. The model is learned on these documents and the labels table.

    Null and empty texts score as texts without words; rows without an id, and rows that share one, are scored each by
    itself; rows that repeat stay or go together; a score equal to the threshold goes.
    """
    model = train(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs.columns, "_toxicity")
    return with_scores(docs, model, name=score).filter(F.col(score) < THRESHOLD).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle similarity 0.8 or more: the one of least id.

    Null and empty texts are like nothing and stay; rows without an id stay; rows that share an id are one document and stay or
    go together.
    """
    keep = jaccard_components(docs, k=5, num=80, den=100).filter("doc_id = component_id").select("doc_id").distinct()
    named = docs.filter("doc_id IS NOT NULL").join(keep.hint("merge"), "doc_id", "left_semi").select(docs.columns)
    return named.unionByName(docs.filter("doc_id IS NULL"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item leaks.

    Null and empty texts hold no item and stay; rows without an id, and rows that share one, are searched each by itself; rows that
    repeat stay or go together; an overlap equal to the least one counts.
    """
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, owner-specific secrets starred out.

    Null texts stay null; rows without an id, and rows that share one, are starred by their own texts; rows that repeat are starred
    alike; a value that as many owners as allowed hold is still owner-specific.
    """
    return masked(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences.

    Null and empty texts are one piece that holds the end token; rows without an id, and rows that share one or repeat, have
    pieces of their own; which of several equal pieces takes which place is left open.
    """
    return pack(docs)


STAGES = [("toxicity", toxicity), ("near_copies", near_copies), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]

#: Learned scores, decoding and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

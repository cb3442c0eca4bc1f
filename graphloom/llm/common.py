"""What the operators share: tables, buckets, batch limits; scratch tables come from the library."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import discard, materialize, shared_dir  # noqa: F401

#: Rows of text an Arrow batch holds; a batch of whole documents stays at a few MB.
BATCH_ROWS = 512
#: Bytes of text that one vectorised step takes at once.
STEP_BYTES = 4 << 20
#: Bytes of input for a bucket of a packed shuffle, and the most buckets (an input without statistics counts as huge).
BUCKET_BYTES, MOST_BUCKETS = 16 << 20, 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of text small, so that long documents cannot fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def fresh(columns: list[str], name: str) -> str:
    """A column name like ``name`` that is not among ``columns``."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets(docs: DataFrame) -> int:
    """Buckets for what documents send: one for each ``BUCKET_BYTES`` that the optimiser takes the input to have, and at
    least two for each shuffle partition, so that what a task holds does not grow with the input."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(MOST_BUCKETS, max(2 * parts(docs.sparkSession), math.ceil(size / BUCKET_BYTES)))


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` has at most ``limit`` bytes in each, or one row."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to

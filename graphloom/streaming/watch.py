"""Change and liveness streams: what a watcher reports, as batch queries and as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ONLINE = 60


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, mtime of files seen before whose time has moved on; first sightings and deletions are not reported."""
    return new.alias("n").join(old.alias("o"), "path").filter("n.mtime > o.mtime").select("path", F.col("n.mtime").alias("mtime"))


def branch_switches(events: DataFrame, key: str, branch: str, order: list[str]) -> DataFrame:
    """Events whose branch differs from the one before, per repository."""
    w = Window.partitionBy(key).orderBy(*order)
    return events.withColumn("_was", F.lag(branch).over(w)).filter(F.col("_was") != F.col(branch)).drop("_was")


def head_branch(head: Column) -> Column:
    """Branch named by the text of a HEAD file, else the first eight signs of a detached commit."""
    return F.when(F.contains(head, F.lit("refs/heads/")), F.regexp_extract(head, "refs/heads/(\\S+)", 1)).otherwise(F.left(F.trim(head), F.lit(8)))


def heartbeat_status(beats: DataFrame, now: datetime, within: int = ONLINE) -> DataFrame:
    """repo, branch, lastSeen, online of the last beat of each repository (repo, branch, ts, event_id)."""
    last = beats.groupBy("repo").agg(F.max_by("branch", F.struct("ts", "event_id")).alias("branch"), F.max("ts").alias("lastSeen"))
    return last.withColumn("online", F.col("lastSeen") > F.lit(now - timedelta(seconds=within)).cast("timestamp_ntz"))


def new_files(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """A stream of source files as they appear: path, modificationTime, source."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    s = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.{swift,m,h}").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(folder)
    return s.filter(~F.contains(F.col("path"), F.lit("Pods/")) & ~F.contains(F.col("path"), F.lit(".build/"))).select("path", "modificationTime", F.make_valid_utf8(F.col("content").cast("string")).alias("source"))


def replace_each_batch(stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None], once: bool = True):
    """Run ``apply`` on each batch of changed files; a replayed batch has the same number, so replacing by file is idempotent."""
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def heartbeats(stream: DataFrame, lateness: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """Beats per repository and minute with the last one, late ones dropped past the watermark (repo, branch, ts)."""
    return stream.withWatermark("ts", lateness).groupBy(F.window("ts", window), "repo").agg(F.count(F.lit(1)).alias("beats"), F.max("ts").alias("lastSeen"), F.max_by("branch", "ts").alias("branch"))


class Watcher:
    """Snapshots of a folder's listing in a table: each poll tells what has changed since the last one.

    A stream of files sees new ones only; a poll also sees files that were written again (path, modificationTime later) and
    those that are gone.
    """

    def __init__(self, spark: SparkSession, folder: str, snapshot: str, listing: Callable[[SparkSession, str], DataFrame]):
        self.spark, self.folder, self.snapshot, self.listing = spark, folder, snapshot.rstrip("/"), listing

    def poll(self) -> DataFrame:
        """path, change: 'new', 'changed' or 'gone'. The first poll tells nothing; what it tells is known from then on."""
        from ..sources.tables import materialize

        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        at = fs_path(self.snapshot)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        now = materialize(self.listing(self.spark, self.folder).select("path", F.col("modificationTime").alias("mtime")), "listing")
        old = self.spark.read.parquet(self.snapshot) if fs.exists(at) else now
        both = now.alias("n").join(old.alias("o"), "path", "full")
        change = F.when(F.col("o.mtime").isNull(), "new").when(F.col("n.mtime").isNull(), "gone").when(F.col("n.mtime") > F.col("o.mtime"), "changed")
        told = materialize(both.select("path", change.alias("change")).filter("change IS NOT NULL"), "changes")
        now.write.mode("overwrite").parquet(f"{self.snapshot}.next")
        fs.delete(at, True)
        fs.rename(fs_path(f"{self.snapshot}.next"), at)
        return told

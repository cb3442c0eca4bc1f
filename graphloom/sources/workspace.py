"""What is read from a workspace besides source text: listings, domain mappings, diffs."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import heuristic_domain

# Folders that hold no sources of the project, and suffixes of sources.
SKIP = ["Pods", ".git", ".build", "build", "DerivedData", ".xcodeproj", ".xcworkspace", ".framework", ".xcframework", "__pycache__", "node_modules"]
SUFFIXES = ["swift", "m", "mm", "h"]


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path, modificationTime of the source files under a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}").load(folder)
    return files.select(F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^[a-z]+:/+", "/").alias("path"), "modificationTime")


def newest(files: DataFrame) -> DataFrame:
    """The path modified last."""
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def generate_mapping(files: DataFrame, root: str, depth: int = 3) -> DataFrame:
    """prefix, domain of each folder with sources up to ``depth`` below the root; the domain comes from its last part."""
    rel = F.split(F.substring("path", len(root.rstrip("/")) + 2, 1 << 30), "/")
    dirs = files.select(rel.alias("p")).select(F.expr("slice(p, 1, size(p) - 1)").alias("d"))
    dirs = dirs.filter(F.size("d").between(1, depth) & ~F.exists("d", lambda x: x.isin(SKIP) | x.startswith("."))).distinct()
    return dirs.select(F.concat(F.array_join("d", "/"), F.lit("/")).alias("prefix"), heuristic_domain(F.element_at("d", -1)).alias("domain"))


def write_mapping(mapping: DataFrame, path: str) -> None:
    """A mapping as a flat YAML file on the driver: one row per folder, a configuration."""
    rows = sorted((r.prefix, r.domain) for r in mapping.collect())
    with open(path, "w") as f:
        f.write("".join(f'"{p}": {d}\n' for p, d in rows))


def load_mapping(path: str) -> dict[str, str]:
    """prefix to domain of a flat YAML file; comments, quotes and a heading line are allowed."""
    out = {}
    for line in open(path):
        key, colon, value = line.split("#", 1)[0].strip().rpartition(":")
        if colon and value.strip():
            out[key.strip().strip("\"'")] = value.strip().strip("\"'")
    return out


def git_diff(spark: SparkSession, repository: str, base: str, timeout: int = 60) -> DataFrame:
    """(diff_id, n, line) of the difference from a revision to the working tree, without context, sources only."""
    said = subprocess.run(["git", "-C", repository, "diff", "--unified=0", base, "--", "*.swift", "*.m", "*.h"], capture_output=True, text=True, timeout=timeout, check=True)
    return spark.createDataFrame([(1, i, x) for i, x in enumerate(said.stdout.split("\n"))], "diff_id int, n int, line string")

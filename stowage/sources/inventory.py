"""Which files belong to the catalogue, and which of them changed since the last snapshot."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.functions import paths
from stowage.session import settle_observed

# Schemes of folders that tasks can list themselves; a plain path has none.
LISTED_IN_TASKS = ("", "file", "hdfs", "gs", "s3")
ENTRIES = "path string, is_folder boolean, mtime bigint, length bigint"
LISTING_ROWS = 4096
# Folders that one task lists in a round.
TASK_FOLDERS = 64


@dataclass(frozen=True)
class IgnoreRule:
    pattern: str
    negate: bool = False


def parse_ignore_lines(lines: list[str]) -> list[IgnoreRule]:
    """One rule per line; `#` starts a comment line, `!` takes matching files back in."""
    rules = []
    for raw in lines:
        line = raw.strip()
        if line and not line.startswith("#"):
            negate = line.startswith("!")
            pattern = line[1:].strip() if negate else line
            if pattern:
                rules.append(IgnoreRule(pattern, negate))
    return rules


@dataclass(frozen=True)
class ScanRules:
    """Job configuration: a handful of patterns, folded into the query as expressions."""

    exclude_paths: list[str] = field(default_factory=list)
    ignore: list[IgnoreRule] = field(default_factory=list)

    def prefix_excluded(self, rel: Column) -> Column:
        """Segment-aware: `Content/Dev` covers `Content/Dev/x` but not `Content/Development/x`."""
        prefixes = [p if p.endswith("/") else p + "/" for p in self.exclude_paths if p and not paths.is_glob(p)]
        return paths.starts_with_any(rel, prefixes)

    def glob_excluded(self, rel: Column) -> Column:
        hit = F.lit(False)
        for pattern in self.exclude_paths:
            if paths.is_glob(pattern):
                hit = hit | paths.matches_glob(rel, pattern, star_stops_at_slash=True)
        return hit

    def ignored(self, rel: Column) -> Column:
        """The last matching rule decides, so test the rules from the last to the first."""
        verdict = None
        for rule in reversed(self.ignore):
            if paths.is_glob(rule.pattern):
                hit = paths.matches_glob(rel, rule.pattern, star_stops_at_slash=True)
            else:
                hit = rel.startswith(rule.pattern)
            verdict = F.when(hit, F.lit(not rule.negate)) if verdict is None else verdict.when(hit, F.lit(not rule.negate))
        return F.lit(False) if verdict is None else verdict.otherwise(F.lit(False))

    def excluded_by(self, rel: Column) -> Column:
        """'exclude_paths', 'ignore_rules' or NULL for a file that is taken."""
        return F.when(self.prefix_excluded(rel) | self.glob_excluded(rel), F.lit("exclude_paths")).when(
            self.ignored(rel), F.lit("ignore_rules")
        )


def _entries(folder: str) -> Iterator[tuple]:
    """What lies in one folder. Links to folders are not followed; a folder that is gone by now is empty."""
    if "://" in folder:
        system, path = fs.FileSystem.from_uri(folder)
        for found in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            is_folder = found.type == fs.FileType.Directory
            yield folder.removesuffix(path) + found.path, is_folder, (found.mtime_ns or 0) // 10**9, found.size or 0
        return
    try:
        with os.scandir(folder) as listed:
            for found in listed:
                if found.is_dir(follow_symlinks=False):
                    yield found.path, True, 0, 0
                elif found.is_file():
                    about = found.stat()
                    yield found.path, False, about.st_mtime_ns // 10**9, about.st_size
    except (FileNotFoundError, NotADirectoryError):
        return


def _list(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [part.split()[0] for part in ENTRIES.split(", ")]
    rows = []
    for batch in batches:
        for folder in batch["path"]:
            for entry in _entries(folder):
                rows.append(entry)
                if len(rows) == LISTING_ROWS:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
    if rows:
        yield pd.DataFrame(rows, columns=names)


def discover(spark: SparkSession, root: str) -> DataFrame:
    """Package files below `root`: (file_path, mtime, length). File contents are not read.

    Tasks list the folders of one depth after the other; the driver sees how many there are.
    Folders of a scheme that they cannot open are listed by Spark's file source in the driver.
    """
    scheme = root.split(":", 1)[0] if "://" in root or root.startswith("file:") else ""
    if scheme not in LISTED_IN_TASKS:
        return _discover_by_reader(spark, root)
    top = "/" + root.removeprefix("file:").lstrip("/") if scheme == "file" else root
    levels, number = [], 1
    below = spark.createDataFrame([(top,)], "path string")
    while number:
        spread = below.repartition(max(1, -(-number // TASK_FOLDERS)), "path")
        level, seen = settle_observed(spread.mapInPandas(_list, ENTRIES), folders=F.count_if("is_folder"))
        levels.append(level.where("not is_folder"))
        below, number = level.where("is_folder").select("path"), int(seen["folders"])
    listing = reduce(DataFrame.unionAll, levels)
    return listing.where(paths.is_package_file(F.col("path"))).select(F.col("path").alias("file_path"), "mtime", "length")


def _discover_by_reader(spark: SparkSession, root: str) -> DataFrame:
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", "modificationTime", "length")
    )
    return listing.where(paths.is_package_file(F.col("path"))).select(
        # Local files come with a scheme; paths of the catalogue do not have it.
        F.regexp_replace("path", "^file:/+", "/").alias("file_path"),
        F.col("modificationTime").cast("bigint").alias("mtime"),
        "length",
    )


def ingest_plan(files: DataFrame, rules: ScanRules, root: str = "") -> DataFrame:
    """Every package file with the decision about it and the rule source that made it."""
    rel = paths.relative_path(F.col("file_path"), root) if root else F.col("file_path")
    return files.withColumn("excluded_by", rules.excluded_by(rel)).withColumn(
        "status", F.when(F.col("excluded_by").isNull(), F.lit("scanned")).otherwise(F.lit("ignored"))
    )


def taken(files: DataFrame, rules: ScanRules, root: str = "") -> DataFrame:
    rel = paths.relative_path(F.col("file_path"), root) if root else F.col("file_path")
    return files.where(rules.excluded_by(rel).isNull())


def changed_files(on_disk: DataFrame, index: DataFrame, full_scan: bool = False) -> DataFrame:
    """Files that are new or whose modification time differs in either direction."""
    if full_scan:
        return on_disk
    known = index.select("file_path", "last_modified")
    return (
        on_disk.join(known, "file_path", "left")
        .where(~F.col("mtime").eqNullSafe(F.col("last_modified")))
        .drop("last_modified")
    )


def stale_files(on_disk: DataFrame, index: DataFrame) -> DataFrame:
    """Indexed files that are gone from disk."""
    return index.join(on_disk, "file_path", "left_anti")


def ingest_delta(on_disk: DataFrame, index: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """One row: new / updated / removed / unchanged and the total afterwards.

    Files that failed to decode (`skipped`) count neither as new nor as updated; a skipped
    file that was known before keeps its old row.
    """
    disk = on_disk.select("file_path", "mtime", F.lit(True).alias("on_disk"))
    both = disk.join(index.select("file_path", "last_modified", F.lit(True).alias("indexed")), "file_path", "full")
    if skipped is None:
        both = both.withColumn("failed", F.lit(False))
    else:
        both = both.join(skipped.select("file_path", F.lit(True).alias("failed")), "file_path", "left")
    here = F.coalesce("on_disk", F.lit(False))
    known = F.coalesce("indexed", F.lit(False))
    failed = F.coalesce("failed", F.lit(False))
    same = known & here & F.col("mtime").eqNullSafe(F.col("last_modified"))
    return both.agg(
        F.count_if(here & ~known & ~failed).alias("new_count"),
        F.count_if(here & known & ~same & ~failed).alias("updated_count"),
        F.count_if(known & ~here).alias("removed_count"),
        F.count_if(same).alias("unchanged_count"),
        F.count_if(here & (known | ~failed)).alias("total_after"),
    )

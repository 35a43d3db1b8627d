"""Change events of a folder, found by comparing each listing with the one before.

A poll lists the folder in tasks, writes the listing, and publishes the differences as raw change
events by renaming their finished folder into the one that the stream reads. A poll that fails
before is done again under the same number; after it, nothing is left to do. So a restarted poller
neither loses nor repeats a change. There is one poller per home folder, which all executors share.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.sources import inventory

RAW_EVENTS = "event_id bigint, ts timestamp, file_path string, action string"
LISTING = "file_path string, mtime bigint, length bigint"


def events_between(before: DataFrame, after: DataFrame, at: datetime, number: int = 0) -> DataFrame:
    """Raw events (event_id, ts, file_path, action) that lead from one listing to the next.

    A file is modified when its time or its length differs, in either direction.
    """
    old = before.select("file_path", F.struct("mtime", "length").alias("old"))
    new = after.select("file_path", F.struct("mtime", "length").alias("new"))
    action = (
        F.when(F.col("old").isNull(), "create")
        .when(F.col("new").isNull(), "remove")
        .when(~F.col("old").eqNullSafe(F.col("new")), "modify")
    )
    return (
        old.join(new, "file_path", "full")
        .select(
            F.xxhash64("file_path", F.lit(number)).alias("event_id"),
            F.lit(at).cast("timestamp").alias("ts"),
            "file_path",
            action.alias("action"),
        )
        .where(F.col("action").isNotNull())
    )


class FolderEvents:
    def __init__(self, spark: SparkSession, root: str, home: str):
        """Watch `root`; listings and events are kept below `home`."""
        self.spark, self.root, self.home = spark, root, home.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.home).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._files.mkdirs(self._path(f"{self.home}/events"))

    def polls(self) -> list[int]:
        """Numbers of the published polls."""
        names = (found.getPath().getName() for found in self._files.listStatus(self._path(f"{self.home}/events")))
        return sorted(int(name) for name in names if name.isdigit())

    def _listing(self, number: int) -> str:
        return f"{self.home}/listings/{number:020d}"

    def poll(self, at: datetime | None = None) -> int:
        """List once more and publish what changed since the last poll; the first poll has no events.

        Returns the poll's number.
        """
        done = self.polls()
        number = done[-1] + 1 if done else 1
        at = at or datetime.now(timezone.utc)
        read = self.spark.read.schema(LISTING).parquet
        inventory.discover(self.spark, self.root).write.mode("overwrite").parquet(self._listing(number))
        now = read(self._listing(number))
        before = read(self._listing(done[-1])) if done else now
        staged = f"{self.home}/staged/{number:020d}"
        events_between(before, now, at, number).write.mode("overwrite").parquet(staged)
        target = self._path(f"{self.home}/events/{number:020d}")
        if self._files.exists(target) or not self._files.rename(self._path(staged), target):
            raise FileExistsError(f"poll {number} of {self.home} has been published by someone else")
        self._files.delete(self._path(self._listing(number - 1)), True)
        return number

    def stream(self) -> DataFrame:
        """The events of all polls as a stream, for `changes.normalise` and `Watch.writer`."""
        return (
            self.spark.readStream.schema(RAW_EVENTS)
            .option("recursiveFileLookup", "true")
            .parquet(f"{self.home}/events")
        )

"""Versioned catalogue snapshots in Parquet.

A full version is a folder with all tables. A version of changes holds the rows of the assets it
touched and the list of those assets; reading it puts it on top of the versions before, back to
the last full one. A version exists once its marker has been written, which happens last, so
readers never see half a version. The marker names the version's folder, which no other writer
has, and tells the last batch of every stream that went into it, so that a replayed batch is
recognised whatever has been published since. Of two writers of one version the second fails.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage import __version__, schema
from stowage.operators import compare, tables
from stowage.session import settle
from stowage.sources import inventory, packages


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._staged: dict[int, str] = {}  # folders of versions that are not published yet
        self._markers: dict[int, dict] = {}

    def _name(self, version: int) -> str:
        return f"v={version:020d}"

    def _folder(self, version: int) -> str:
        name = self._staged.get(version) or self._marker(version).get("folder", self._name(version))
        return f"{self.root}/{name}"

    def _path(self, text: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(text)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Published versions, oldest first."""
        root, files = self._path(self.root)
        if not files.exists(root):
            return []
        # A marker without contents belongs to a writer that has not come to its end.
        names = [status.getPath().getName() for status in files.listStatus(root) if status.getLen() > 0]
        published = [int(name[2:-3]) for name in names if name.startswith("v=") and name.endswith(".ok")]
        return sorted(published)

    def _save(self, version: int, contents: dict[str, DataFrame]) -> None:
        published = self.versions()
        if version in published:
            raise FileExistsError(f"version {version} is published already")
        self._staged[version] = f"{self._name(version)}-{uuid.uuid4().hex}"
        for name, columns in schema.CARRIED_TABLES.items():
            table = contents.get(name)
            if table is None:  # as it was
                table = self.small(name, published[-1]) if published else self.spark.createDataFrame([], columns)
            table = table.select(*[F.col(f.name).cast(f.dataType) for f in columns])
            table.coalesce(1).write.mode("overwrite").parquet(f"{self._folder(version)}/{name}")
        for name, columns in schema.SNAPSHOT_TABLES.items():
            table = contents.get(name)
            if table is None:
                table = self.spark.createDataFrame([], columns)
            # Casting to the declared schema keeps every version readable alike.
            table = table.select(*[F.col(f.name).cast(f.dataType) for f in columns])
            if name == "deps":
                # Both directions of a walk start from a key; keep rows of a target together.
                table = table.repartitionByRange("to_path").sortWithinPartitions("to_path", "from_path")
            table.write.mode("overwrite").parquet(f"{self._folder(version)}/{name}")

    def _publish(self, version: int, marker: dict, batch: tuple[str, int] | None) -> None:
        newest = self.versions()[-1:]
        streams = self._marker(newest[0]).get("streams", {}) if newest else {}
        marker |= {"folder": self._staged.pop(version), "streams": streams | (dict([batch]) if batch else {})}
        path, files = self._path(f"{self.root}/{self._name(version)}.ok")
        unfinished = files.exists(path) and files.getFileStatus(path).getLen() == 0
        try:
            out = files.create(path, unfinished)
        except Py4JJavaError as error:
            if files.exists(path):
                raise FileExistsError(f"version {version} has been published by another writer") from error
            raise
        out.write(bytearray(json.dumps(marker).encode()))
        out.close()

    def _marker(self, version: int) -> dict:
        """A published version's marker, which never changes."""
        if version not in self._markers:
            path, files = self._path(f"{self.root}/{self._name(version)}.ok")
            source = files.open(path)
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
            finally:
                source.close()
            self._markers[version] = json.loads(text)
        return self._markers[version]

    def applied(self, stream: str) -> int | None:
        """The last batch of a stream that any version up to the newest holds."""
        newest = self.versions()[-1:]
        return self._marker(newest[0]).get("streams", {}).get(stream) if newest else None

    def write(self, version: int, contents: dict[str, DataFrame], batch: tuple[str, int] | None = None) -> None:
        """Write all tables, then publish. `batch`: the stream and the number of the batch behind it."""
        self._save(version, contents)
        self._publish(version, {}, batch)

    def stage_changes(self, version: int, fresh: dict[str, DataFrame], touched: DataFrame) -> dict[str, DataFrame]:
        """Write what a version changes without publishing it; returns the catalogue as it would be."""
        self._save(version, fresh)
        touched.select("asset_path").distinct().write.mode("overwrite").parquet(f"{self._folder(version)}/touched")
        return self._stacked([*self.chain(self.versions()[-1]), version])

    def publish_changes(self, version: int, batch: tuple[str, int] | None = None) -> None:
        self._publish(version, {"below": self.versions()[-1]}, batch)

    def small(self, name: str, version: int | None = None) -> DataFrame:
        """History, baselines or properties as of a version, by default the newest."""
        published = [version] if version is not None else self.versions()[-1:]
        columns = schema.CARRIED_TABLES[name]
        if published:
            folder = f"{self._folder(published[0])}/{name}"
            path, files = self._path(folder)
            if files.exists(path):  # versions of the first schema have none
                return self.spark.read.schema(columns).parquet(folder)
        return self.spark.createDataFrame([], columns)

    def chain(self, version: int) -> list[int]:
        """The versions that make up this one: a full one, then changes in order."""
        found = [version]
        while (below := self._marker(found[0]).get("below")) is not None:
            found.insert(0, below)
        return found

    def read(self, version: int | None = None) -> dict[str, DataFrame]:
        """Tables of a version, by default the newest; empty tables when there is none."""
        if version is None:
            published = self.versions()
            if not published:
                return {n: self.spark.createDataFrame([], s) for n, s in schema.SNAPSHOT_TABLES.items()}
            version = published[-1]
        return self._stacked(self.chain(version))

    def _stacked(self, chain: list[int]) -> dict[str, DataFrame]:
        base, *changes = chain
        load = lambda v, name, columns: self.spark.read.schema(columns).parquet(f"{self._folder(v)}/{name}")
        tables_ = {name: load(base, name, columns) for name, columns in schema.SNAPSHOT_TABLES.items()}
        if not changes:
            return tables_
        # The last version that touched an asset holds all its rows, if it still has any.
        touches = None
        for v in changes:
            rows = load(v, "touched", "asset_path string").withColumn("__last", F.lit(v))
            touches = rows if touches is None else touches.unionByName(rows)
        last = touches.groupBy("asset_path").agg(F.max("__last").alias("__last"))
        for name, columns in schema.SNAPSHOT_TABLES.items():
            key = "from_path" if name == "deps" else "asset_path"
            rows = tables_[name].withColumn("__v", F.lit(base))
            for v in changes:
                rows = rows.unionByName(load(v, name, columns).withColumn("__v", F.lit(v)))
            joined = rows.join(last.withColumnRenamed("asset_path", key), key, "left")
            current = joined.where(F.col("__v") == F.coalesce("__last", F.lit(base)))
            tables_[name] = current.select(*columns.fieldNames())
        return tables_


def apply_changes(
    current: dict[str, DataFrame], fresh: dict[str, DataFrame], gone: DataFrame
) -> dict[str, DataFrame]:
    """The next state: `gone` assets deleted first, then the rescanned ones replaced."""
    kept = tables.delete_assets({n: current[n] for n in schema.SNAPSHOT_TABLES}, gone)
    touched = fresh["assets"].select("asset_path")
    out = {}
    for name in schema.SNAPSHOT_TABLES:
        key = "from_path" if name == "deps" else "asset_path"
        out[name] = tables.upsert(kept[name], fresh[name], key, touched)
    return out


def scan(
    store: SnapshotStore,
    project: str,
    content_root: str,
    rules: inventory.ScanRules | None = None,
    full_scan: bool = False,
    now: int | None = None,
    save_baseline: str | None = None,
    files: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Scan a project into the next version: list, decode what changed, merge, record, publish.

    `files` is an inventory (file_path, mtime, length) that some other job has listed; without
    one tasks list the project's folders. Every version gets its row in the history, and with `save_baseline` a name.

    Returns one-row `delta` counts, the `skipped` files, and what the scan changed: `added` and
    `deleted` assets, `grown` files. A package that changed but no longer decodes keeps its
    previous row and is tried again next time.
    """
    spark = store.spark
    rules = rules or inventory.ScanRules()
    now = int(time.time()) if now is None else now
    current = store.read()
    found = inventory.discover(spark, project) if files is None else files
    listed, _ = settle(inventory.taken(found, rules, project))
    index = current["assets"]
    changed = inventory.changed_files(listed, index, full_scan)
    decoded, _ = settle(packages.decode(changed))
    fresh = packages.extract(decoded, content_root)
    gone = inventory.stale_files(listed, index).select("asset_path")
    delta, _ = settle(inventory.ingest_delta(listed, index, fresh["skipped"]))
    published = store.versions()
    version = (published[-1] + 1) if published else 1
    after = {name: settle(table)[0] for name, table in apply_changes(current, fresh, gone).items()}
    row = tables.scan_snapshot(after["assets"], after["blueprint_metrics"]).select(
        F.lit(version).alias("id"), F.lit(now).alias("scanned_at"), "*"
    )
    names = store.small("baselines")
    if save_baseline is not None:
        names = tables.save_baseline(names, save_baseline, version, now)
    known = [("schema_version", schema.SCHEMA_VERSION), ("writer_version", __version__)]
    carried = {
        "scan_history": store.small("scan_history").unionByName(row.select(*schema.SCAN_HISTORY.fieldNames())),
        "baselines": names,
        "properties": spark.createDataFrame(known, schema.PROPERTIES),
    }
    store.write(version, after | carried)
    return {
        "delta": delta,
        "skipped": fresh["skipped"],
        "added": compare.added(current["assets"], after["assets"]),
        "deleted": compare.deleted(current["assets"], after["assets"]),
        "grown": compare.size_increases(current["assets"], after["assets"]),
    }

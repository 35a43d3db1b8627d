"""Following a stream of package changes and reporting only problems that are new.

Each micro-batch that changes something becomes one catalogue version: deletes first, then
rescanned packages. Only the rows of touched assets are written, and every so often a full
version. The version's marker names stream and batch, so a batch that is replayed after a failure
changes nothing, and a restarted stream goes on from the newest version.

New problems are looked for only where the batch can have made any. An asset can only have
become unreferenced if it was touched or lost a reference. A cycle can only be new if an edge
was added to it or an edge was taken out of the one before it; the vertices of all such cycles
lie between the ends of those edges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from stowage import schema
from stowage.functions import paths
from stowage.operators import graph
from stowage.session import settle
from stowage.sources.snapshots import SnapshotStore
from stowage.streaming import changes

# (asset_path) of packages to read again, to their catalogue tables.
Rescan = Callable[[DataFrame], dict[str, DataFrame]]
# Versions of changes that lie on one another before a full version is written.
FULL_EVERY = 16


def problems(tables: dict[str, DataFrame], external_roots: tuple[str, ...] = graph.EXTERNAL_ROOTS) -> dict[str, DataFrame]:
    """All unreferenced assets (no type exclusion) and members of reported cycles."""
    edges, _ = settle(graph.internal_edges(tables["deps"], external_roots))
    nodes = graph.vertices(tables["assets"], edges)
    return {
        "dead": graph.unreferenced(nodes, edges, excluded_types=()).select("asset_path"),
        "cycles": graph.cycle_members(graph.strong_components(edges)).select("asset_path", "component", "size"),
    }


def _dead_among(candidates: DataFrame, assets: DataFrame, edges: DataFrame) -> DataFrame:
    """Those of a few candidates that are vertices nothing points at."""
    sources = edges.select(F.col("from_path").alias("asset_path"))
    present = candidates.join(assets.select("asset_path").union(sources), "asset_path", "left_semi")
    hit = edges.select(F.col("to_path").alias("asset_path")).join(candidates, "asset_path", "left_semi").distinct()
    return present.join(hit, "asset_path", "left_anti")


def _between(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Vertices on walks that leave the end of a changed edge and come to the start of one."""
    onward = graph.reach_any(
        graph.Adjacency(edges, "from_path", "to_path"), changed.select(F.col("from_path").alias("vertex"))
    )
    back = graph.reach_any(graph.Adjacency(edges, "to_path", "from_path"), changed.select(F.col("to_path").alias("vertex")))
    return onward.join(back, "vertex", "left_semi")


def _cycles_within(edges: DataFrame, region: DataFrame) -> DataFrame:
    inner = edges.join(region.withColumnRenamed("vertex", "from_path"), "from_path", "left_semi").join(
        region.withColumnRenamed("vertex", "to_path"), "to_path", "left_semi"
    )
    return graph.cycle_members(graph.strong_components(inner))


def new_problems(
    before: dict[str, DataFrame],
    after: dict[str, DataFrame],
    touched: DataFrame,
    external_roots: tuple[str, ...] = graph.EXTERNAL_ROOTS,
) -> DataFrame:
    """(problem, asset_path, size) of what `after` has and `before` had not; `touched` assets differ."""
    old, new = (graph.internal_edges(t["deps"], external_roots).select("from_path", "to_path") for t in (before, after))
    sources = touched.select(F.col("asset_path").alias("from_path"))
    was, _ = settle(old.join(sources, "from_path", "left_semi"))
    now, _ = settle(new.join(sources, "from_path", "left_semi"))
    added, _ = settle(now.exceptAll(was).distinct())
    removed, _ = settle(was.exceptAll(now).distinct())

    candidates = touched.select("asset_path").union(removed.select("to_path")).distinct()
    candidates, _ = settle(candidates.where(~paths.is_per_actor_file(F.col("asset_path"))))
    dead = _dead_among(candidates, after["assets"], new).join(
        _dead_among(candidates, before["assets"], old), "asset_path", "left_anti"
    )
    region, rows = settle(_between(new, added).union(_between(old, removed)).distinct())
    reports = dead.select(F.lit("new dead asset").alias("problem"), "asset_path", F.lit(1).cast("bigint").alias("size"))
    if rows:
        loops = graph.new_cycles(_cycles_within(old, region), _cycles_within(new, region))
        reports = reports.unionByName(
            loops.select(F.lit("new cycle").alias("problem"), F.col("component").alias("asset_path"), "size")
        )
    return reports


class Watch:
    def __init__(self, store: SnapshotStore, rescan: Rescan, external_roots: tuple[str, ...] = graph.EXTERNAL_ROOTS):
        self.store = store
        self.rescan = rescan
        self.external_roots = external_roots

    def process(self, batch: DataFrame, batch_id: int, stream: str) -> None:
        """Apply one batch of (asset_path, kind, …) and write the new problems it caused."""
        if not self.store.versions():
            self.store.write(1, {})
        newest = self.store.versions()[-1]
        # Only a stream's last batch is ever replayed, however much others have published since.
        if self.store.applied(stream) == batch_id:
            return
        # A path may occur in several windows of a batch: its latest kind counts.
        latest, rows = settle(
            batch.groupBy("asset_path").agg(F.max_by("kind", F.struct("window_start", "kind")).alias("kind"))
        )
        if not rows:
            return
        before = self.store.read(newest)
        gone = latest.where(F.col("kind") == "Deleted").join(before["assets"], "asset_path", "left_semi")
        fresh = self.rescan(latest.where(F.col("kind") != "Deleted").select("asset_path"))
        touched, rows = settle(gone.select("asset_path").union(fresh["assets"].select("asset_path")).distinct())
        if not rows:
            return
        after = self.store.stage_changes(newest + 1, fresh, touched)
        found = new_problems(before, after, touched, self.external_roots)
        found.write.mode("overwrite").parquet(f"{self.store.root}/reports/v={newest + 1:020d}")
        # Publishing the version comes last: until then a replay redoes all of the above.
        if len(self.store.chain(newest)) < FULL_EVERY:
            self.store.publish_changes(newest + 1, (stream, batch_id))
        else:
            whole = {name: settle(table)[0] for name, table in after.items()}
            self.store.write(newest + 1, whole, (stream, batch_id))

    def reports(self, version: int) -> DataFrame:
        return self.store.spark.read.parquet(f"{self.store.root}/reports/v={version:020d}")

    def writer(
        self, events: DataFrame, checkpoint: str, lateness: str = "1 minute", length_ms: int = 300
    ) -> DataStreamWriter:
        """Stream writer over change events; a path's first event opens its window of `length_ms`, and
        events later than `lateness` are dropped."""
        batches = changes.stream_debounce_from_first(events, lateness, length_ms)
        return (
            batches.writeStream.outputMode("append")
            .option("checkpointLocation", checkpoint)
            .foreachBatch(lambda batch, batch_id: self.process(batch, batch_id, checkpoint))
        )


def rescan_from(truth: dict[str, DataFrame]) -> Rescan:
    """Rescan by looking packages up in already decoded tables, such as a decode job's output."""

    def rescan(again: DataFrame) -> dict[str, DataFrame]:
        out = {}
        for name in schema.SNAPSHOT_TABLES:
            key = "from_path" if name == "deps" else "asset_path"
            wanted = again.select(F.col("asset_path").alias(key))
            out[name] = truth[name].join(wanted, key, "left_semi")
        return out

    return rescan

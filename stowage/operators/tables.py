"""Upserts, deletes, snapshot rows and baselines over the catalogue tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedup_edges(raw: DataFrame) -> DataFrame:
    """One row per (from, to); a hard reference wins over a soft one."""
    return raw.groupBy("from_path", "to_path").agg(F.min("is_soft").alias("is_soft"))


def upsert(old: DataFrame, new: DataFrame, key: str, touched: DataFrame | None = None) -> DataFrame:
    """`old` with the rows of every touched key replaced by those in `new`.

    `touched` lists the assets that were rewritten; an asset rewritten without, say, metrics
    loses its old metrics row. By default the keys of `new` count as touched.
    """
    keys = (new if touched is None else touched).select(F.col(key if touched is None else "asset_path").alias(key))
    return old.join(keys.distinct(), key, "left_anti").unionByName(new)


def delete_assets(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Drop assets with their outgoing edges and side tables; incoming edges stay, dangling."""
    paths = gone.select("asset_path").distinct()
    kept = {}
    for name, table in tables.items():
        if name == "deps":
            kept[name] = table.join(paths, table.from_path == paths.asset_path, "left_anti")
        else:
            kept[name] = table.join(paths, "asset_path", "left_anti")
    return kept


def scan_snapshot(assets: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row of project aggregates; zeros when the catalogue is empty."""
    size = F.col("file_size")
    of_assets = assets.agg(
        F.count(F.lit(1)).alias("asset_count"),
        F.coalesce(F.sum(size), F.lit(0)).alias("total_size"),
        F.count_if(F.col("asset_type") == "Blueprint").alias("blueprint_count"),
        F.count_if(F.col("asset_type") == "Texture2D").alias("texture_count"),
        F.coalesce(F.sum(F.when(F.col("asset_type") == "Texture2D", size)), F.lit(0)).alias("texture_size"),
    )
    # The average is over every metrics row, whatever the asset's type.
    mean = metrics.agg(F.coalesce(F.avg("node_count"), F.lit(0.0)).alias("v")).scalar()
    return of_assets.withColumn("avg_node_count", mean)


def load_baseline(baselines: DataFrame, history: DataFrame, name: str) -> DataFrame:
    return (
        baselines.where(F.col("name") == name)
        .join(history, baselines.snapshot_id == history.id)
        .drop("snapshot_id")
    )


def save_baseline(baselines: DataFrame, name: str, snapshot_id: int, saved_at: int) -> DataFrame:
    """The baseline table with `name` pointing at another snapshot."""
    row = baselines.sparkSession.createDataFrame([(name, snapshot_id, saved_at)], baselines.schema)
    return baselines.where(F.col("name") != name).unionByName(row)


def recent_snapshots(history: DataFrame, limit: int = 20) -> DataFrame:
    """Newest first."""
    return history.orderBy(F.desc("scanned_at"), F.desc("id")).limit(limit)


def previous_snapshot(history: DataFrame) -> DataFrame:
    """The second newest."""
    return history.orderBy(F.desc("scanned_at"), F.desc("id")).offset(1).limit(1)


def asset_metrics(assets: DataFrame, metrics: DataFrame) -> DataFrame:
    return assets.select("asset_path", "asset_type", "file_size").join(metrics, "asset_path")


def asset_textures(assets: DataFrame, textures: DataFrame) -> DataFrame:
    return assets.select("asset_path", "asset_type", "file_size").join(textures, "asset_path")


def lookup(assets: DataFrame, wanted: DataFrame) -> DataFrame:
    """Point lookups for a table of paths."""
    return assets.join(wanted.select("asset_path").distinct(), "asset_path", "left_semi")

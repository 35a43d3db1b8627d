"""Groups of assets that look like copies of each other.

Groups come as one row each with their size, members as one row each with their group: a
group may hold a large share of the catalogue, so members are never gathered into one value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.functions import paths, skew


def _named(assets: DataFrame) -> DataFrame:
    return assets.select("asset_path", "asset_type", "file_size", paths.leaf_name(F.col("asset_path")).alias("name"))


def _groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    return (
        rows.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.sum("file_size").alias("total_bytes"),
            F.min("asset_path").alias("first_path"),
            # The set holds type names, of which there are few, not members.
            F.array_sort(F.collect_set("asset_type")).alias("types"),
        )
        .where(F.col("copies") >= 2)
    )


def same_name_groups(assets: DataFrame) -> DataFrame:
    return _groups(_named(assets), ["name"])


def texture_groups(assets: DataFrame) -> DataFrame:
    """Textures with equal name and equal size."""
    textures = _named(assets).where(F.col("asset_type") == "Texture2D").withColumn("each_bytes", F.col("file_size"))
    return _groups(textures, ["name", "each_bytes"])


def same_name_members(assets: DataFrame, hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """(name, copies, asset_path)"""
    groups = same_name_groups(assets).select("name", "copies")
    return skew.join_sized(
        _named(assets).select("name", "asset_path"), groups, "name", "copies", F.col("asset_path"), hot_rows
    )


def texture_members(assets: DataFrame, hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """(name, each_bytes, copies, asset_path)"""
    keys = ["name", "each_bytes"]
    rows = (
        _named(assets)
        .where(F.col("asset_type") == "Texture2D")
        .select("name", F.col("file_size").alias("each_bytes"), "asset_path")
    )
    groups = texture_groups(assets).select(*keys, "copies")
    return skew.join_sized(rows, groups, keys, "copies", F.col("asset_path"), hot_rows)


def report(assets: DataFrame) -> DataFrame:
    """Texture copies, then same-name groups whose name is not among them already."""
    textures = texture_groups(assets).withColumn("kind", F.lit("texture-dup")).drop("each_bytes")
    plain = (
        same_name_groups(assets)
        .join(textures.select("name").distinct(), "name", "left_anti")
        .withColumn("kind", F.lit("same-name"))
    )
    return textures.unionByName(plain).select(
        "kind",
        "name",
        "copies",
        "total_bytes",
        "first_path",
        F.when(F.size("types") == 1, F.element_at("types", 1)).alias("shared_type"),
        F.array_join("types", ",").alias("types"),
    )

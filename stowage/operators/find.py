"""Searching the asset table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.functions import paths

# Sort orders by name; the path breaks ties so that every order is total.
SORT_ORDERS = {
    "path": lambda: [F.asc("asset_path")],
    "size-desc": lambda: [F.desc("file_size"), F.asc("asset_path")],
    "size-asc": lambda: [F.asc("file_size"), F.asc("asset_path")],
    "type": lambda: [F.asc("asset_type"), F.asc("asset_path")],
}


def find(
    assets: DataFrame,
    asset_type: str | None = None,
    min_size: int | None = None,
    max_size: int | None = None,
    path_glob: str | None = None,
) -> DataFrame:
    """All given conditions hold. The cheap ones reach the Parquet scan, the glob is residual.

    `path_glob` matches the whole file path and its `*` crosses slashes.
    """
    out = assets
    if asset_type is not None:
        out = out.where(F.col("asset_type") == asset_type)
    if min_size is not None:
        out = out.where(F.col("file_size") >= min_size)
    if max_size is not None:
        out = out.where(F.col("file_size") <= max_size)
    if path_glob is not None:
        out = out.where(paths.matches_glob(F.col("file_path"), path_glob, star_stops_at_slash=False))
    return out


def among(assets: DataFrame, result: DataFrame, column: str = "asset_path") -> DataFrame:
    """Assets whose path occurs in another result: unreferenced ones, referrers, dependencies."""
    keys = result.select(F.col(column).alias("asset_path")).distinct()
    return assets.join(keys, "asset_path", "left_semi")


def totals(assets: DataFrame) -> DataFrame:
    return assets.agg(
        F.count(F.lit(1)).alias("asset_count"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_bytes")
    )


def ordered(assets: DataFrame, order: str) -> DataFrame:
    return assets.orderBy(*SORT_ORDERS[order]())


def with_violation(assets: DataFrame, violations: DataFrame, rule: str) -> DataFrame:
    """Assets with a violation of `rule`, given in full or as a leading category."""
    hit = violations.where((F.col("rule") == rule) | F.col("rule").startswith(rule.rstrip("/") + "/"))
    return among(assets, hit)


def narrow_dead(
    dead: DataFrame,
    types: list[str] | None = None,
    min_size: int | None = None,
    exclude_containing: list[str] | None = None,
) -> DataFrame:
    """Any of the types, at least the size, none of the substrings."""
    out = dead
    if types:
        out = out.where(F.col("asset_type").isin(*types))
    if min_size is not None:
        out = out.where(F.col("file_size") >= min_size)
    for text in exclude_containing or []:
        out = out.where(~F.col("asset_path").contains(text))
    return out


def clean_plan(
    dead: DataFrame,
    min_size: int | None = None,
    exclude_containing: list[str] | None = None,
    path_glob: str | None = None,
) -> DataFrame:
    """Unreferenced assets that have a record, largest first. The glob matches the asset path
    and its `*` crosses slashes."""
    out = narrow_dead(dead.where(~F.col("is_placeholder")), None, min_size, exclude_containing)
    if path_glob is not None:
        out = out.where(paths.matches_glob(F.col("asset_path"), path_glob, star_stops_at_slash=False))
    return out.select("asset_path", "asset_type", "file_size").orderBy(F.desc("file_size"), "asset_path")

"""Aggregates for reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions import paths
from stowage.operators import graph
from stowage.session import settle


def by_type(assets: DataFrame) -> DataFrame:
    return assets.groupBy("asset_type").agg(
        F.count(F.lit(1)).alias("asset_count"), F.sum("file_size").alias("total_bytes")
    )


def by_folder(assets: DataFrame) -> DataFrame:
    return assets.groupBy(paths.folder_bucket(F.col("asset_path")).alias("folder")).agg(
        F.count(F.lit(1)).alias("asset_count"), F.sum("file_size").alias("total_bytes")
    )


def type_share(assets: DataFrame) -> DataFrame:
    """Percentage of all bytes per type; 0 when the catalogue holds no bytes."""
    total = assets.agg(F.sum("file_size").alias("v")).scalar()
    share = F.when(total > 0, F.col("total_bytes") * F.lit(100.0) / total).otherwise(F.lit(0.0))
    return by_type(assets).select("asset_type", "total_bytes", share.alias("share_percent"))


def top(rows: DataFrame, by: str, tie: str, limit: int) -> DataFrame:
    """The `limit` largest; 0 means all of them."""
    ordered = rows.orderBy(F.desc(by), F.asc(tie))
    return ordered if limit == 0 else ordered.limit(limit)


def one_row(parts: dict[str, DataFrame]) -> DataFrame:
    """Put one-row, one-column results side by side without joining them."""
    names = list(parts)
    stacked = None
    for name, part in parts.items():
        column = part.columns[0]
        row = part.select(*[(F.col(column) if n == name else F.lit(None)).cast("bigint").alias(n) for n in names])
        stacked = row if stacked is None else stacked.unionAll(row)
    return stacked.agg(*[F.max(n).alias(n) for n in names])


def side_by_side(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two one-row tables as one row."""
    names = [F.col(name) for name in right.columns]
    row = right.select(F.struct(*names).alias("v")).scalar()
    return left.select("*", *(row[name].alias(name) for name in right.columns))


def project_totals(assets: DataFrame, nodes: DataFrame, edges: DataFrame, reported_cycles: DataFrame) -> DataFrame:
    """Totals over asset rows and edges.

    `unreferenced` here is plain in-degree zero over all vertices: no type or per-actor filter.
    """
    row = one_row(
        {
            "total_assets": assets.agg(F.count(F.lit(1)).alias("n")),
            "total_bytes": assets.agg(F.coalesce(F.sum("file_size"), F.lit(0)).alias("n")),
            "total_edges": edges.agg(F.count(F.lit(1)).alias("n")),
            "unreferenced": graph.unreferenced(nodes, edges, excluded_types=(), exclude_per_actor=False).agg(
                F.count(F.lit(1)).alias("n")
            ),
            "cycles": reported_cycles.agg(F.count(F.lit(1)).alias("n")),
        }
    )
    mean = F.when(F.col("total_assets") > 0, F.col("total_edges") / F.col("total_assets")).otherwise(F.lit(0.0))
    return row.withColumn("avg_out_degree", mean)


def graph_summary(nodes: DataFrame, edges: DataFrame, reported_cycles: DataFrame) -> DataFrame:
    """Totals of the graph itself: vertices include placeholders."""
    return one_row(
        {
            "vertices": nodes.agg(F.count(F.lit(1)).alias("n")),
            "placeholders": nodes.agg(F.count_if("is_placeholder").alias("n")),
            "edges": edges.agg(F.count(F.lit(1)).alias("n")),
            "cycles": reported_cycles.agg(F.count(F.lit(1)).alias("n")),
        }
    )


def positions(rows: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Number the rows 1, 2, … in a global order that no single task has to see.

    Rows are range-partitioned and sorted; a row's number is its place in its partition plus
    the sizes of the partitions before. Only that list of sizes, one row per partition, goes
    through one task.
    """
    placed, _ = settle(rows.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()))
    partition = F.shiftright("__id", 33)
    sizes = placed.groupBy(partition.alias("__partition")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("__partition").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__partition", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    within = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("__partition", partition)
        .join(F.broadcast(offsets), "__partition")
        .withColumn(name, F.col("__before") + within + 1)
        .drop("__id", "__partition", "__before")
    )


def complexity_ranking(assets: DataFrame, metrics: DataFrame) -> DataFrame:
    """Metrics per asset, most nodes first."""
    rows = assets.select("asset_path", "asset_type").join(metrics, "asset_path")
    return positions(rows, F.desc("node_count"), F.asc("asset_path"))


def export_table(assets: DataFrame, edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Flat table for other tools: path, type, size and both degrees, ordered by path.

    `assets` may be the result of a search; degrees are those in the whole graph. With stored
    vertices (`nodes`) no edge is read.
    """
    rows = assets.select("asset_path", "asset_type", "file_size")
    if nodes is not None:
        rows = rows.join(nodes.select("asset_path", "in_degree", "out_degree"), "asset_path")
    else:
        rows = graph.degrees(rows, edges)
    return rows.select(
        F.col("asset_path").alias("path"),
        F.col("asset_type").alias("type"),
        "file_size",
        F.col("out_degree").alias("deps_count"),
        "in_degree",
    ).orderBy("path")

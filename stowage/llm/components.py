"""Distributed union-find: the components of a table of links.

Links are kept as (child, parent) with child > parent. A round re-hangs every child to the
smallest neighbour of its parent, then every child and its parents to the child's smallest
parent; smallest neighbours are aggregates, so no neighbourhood is ever gathered. When no child
has two parents and no parent is a child, each tree is a star around its component's smallest
node. The number of rounds grows with the logarithm of the longest path. Every round is a table
in the shared folder; the one before it is deleted. As long as the links are few by count, a round
is one task's work and nothing is shuffled; beyond that Spark spreads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.session import discard, settle


# Links that one task handles in a round: some 2 MB.
TASK_LINKS = 100_000


def _is_forest_of_stars(links: DataFrame) -> bool:
    several = links.groupBy("child").count().where("count > 1").select(F.lit(1).alias("x"))
    deep = links.select(F.col("parent").alias("child")).join(links, "child", "left_semi").select(F.lit(1).alias("x"))
    return several.unionAll(deep).isEmpty()


def _round(links: DataFrame) -> DataFrame:
    ends = links.select(F.col("parent").alias("node"), F.col("child").alias("near"))
    ends = ends.unionAll(links.select(F.col("child").alias("node"), F.col("parent").alias("near")))
    least = ends.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("to"))
    hung = links.join(least, links["parent"] == least["node"]).select("child", F.col("to").alias("parent")).distinct()
    lowest = hung.groupBy("child").agg(F.min("parent").alias("root"))
    return (
        hung.join(lowest, "child")
        .select(F.explode(F.array(F.struct("child", "root"), F.struct(F.col("parent").alias("child"), "root"))))
        .select("col.child", F.col("col.root").alias("parent"))
        .where("child > parent")
        .distinct()
    )


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of a pair that is not its component's smallest node."""

    def kept(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        stored, count = settle(rows)
        return stored, stored.coalesce(1) if count <= TASK_LINKS else stored

    stored, links = kept(
        pairs.select(F.greatest(a, b).alias("child"), F.least(a, b).alias("parent")).where("child > parent").distinct()
    )
    while not _is_forest_of_stars(links):
        before = stored
        stored, links = kept(_round(links))
        discard(before)
    return stored.select(F.col("child").alias("node"), F.col("parent").alias("root"))

"""Walking a graph: one step as a join, repeated by a driver loop that sees row counts only.

Joins inside a loop broadcast the moving side while its counted size allows it, and otherwise
shuffle it against an edge table in which the edges of heavily referenced vertices are split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.functions import skew
from stowage.session import discard, partitions, settle, settle_distinct, settle_laid_out, settle_partitioned

CHAIN_SEPARATOR = " > "
# Rounds after which the pieces of the visited set are rewritten as one.
COMPACT_EVERY = 16


class Adjacency:
    """Edge table laid out for repeated "go one step from these vertices" joins.

    `edges` is read once per step, so it should be a stored or settled table.
    """

    def __init__(
        self,
        edges: DataFrame,
        at: str,
        to: str,
        broadcast_rows: int = skew.BROADCAST_ROWS,
        hot_rows: int = skew.HOT_ROWS,
        carry: tuple[str, ...] = (),
        sizes: DataFrame | None = None,
    ):
        """`carry` names further columns of the edges that a step brings along; `sizes` (vertex, size) say how many
        edges a vertex has, or more, where that is known."""
        self.edges = edges.select(F.col(at).alias("vertex"), F.col(to).alias("next"), *carry)
        self.carry = carry
        self.broadcast_rows = broadcast_rows
        self.hot_rows = hot_rows
        self._sizes = sizes
        self._split: tuple[DataFrame, DataFrame] | None = None

    def step(self, frontier: DataFrame, rows: int) -> DataFrame:
        """Join `frontier` on its `vertex` column; `vertex` becomes the vertex stepped to."""
        if rows <= self.broadcast_rows:
            joined = self.edges.join(F.broadcast(frontier), "vertex")
        else:
            edges, hot = self._split_layout()
            joined = edges.join(skew.repeat(frontier, hot, "vertex"), ["vertex", skew.PART]).drop(skew.PART)
        return joined.drop("vertex").withColumnRenamed("next", "vertex")

    def _split_layout(self) -> tuple[DataFrame, DataFrame]:
        """Edges shuffled once by (vertex, part); hub vertices own several parts."""
        if self._split is None:
            counts = self._sizes
            if counts is None:
                counts = self.edges.groupBy("vertex").agg(F.count(F.lit(1)).alias("size"))
            hot, _ = settle(skew.hot_keys(counts, "vertex", "size", self.hot_rows))
            spread = skew.spread(self.edges, hot, "vertex", F.col("next"))
            self._split = settle_partitioned(spread, "vertex", skew.PART), hot
        return self._split

    def close(self) -> None:
        """Delete what the layout has stored; the edges themselves are the caller's."""
        if self._split is not None:
            discard(self._split[1])
            self._split = None


def reach(adjacency: Adjacency, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Breadth-first walk from every row of `roots` (column `root`) at once.

    Returns (root, vertex, depth >= 1); a root is never in its own result.
    """
    limit = adjacency.broadcast_rows
    start = roots.select("root", F.col("root").alias("vertex"))
    frontier, rows = settle(start.distinct())
    seen, seen_rows, pieces = frontier.select("root", "vertex"), rows, 1
    depth, levels = 0, []
    while rows and depth != max_depth:
        depth += 1
        stepped = adjacency.step(frontier, rows)
        if seen_rows <= limit:
            # Drop known pairs before the shuffle of the grouping.
            stepped = stepped.join(F.broadcast(seen), ["root", "vertex"], "left_anti")
        stepped = stepped.select("root", "vertex").distinct()
        if seen_rows > limit:
            # Grouping and anti join share one shuffle on (root, vertex).
            stepped = stepped.join(seen, ["root", "vertex"], "left_anti")
        frontier, rows = settle(stepped)
        if rows:
            levels.append(frontier.withColumn("depth", F.lit(depth)))
            seen, seen_rows, pieces = seen.union(frontier.select("root", "vertex")), seen_rows + rows, pieces + 1
            if pieces >= COMPACT_EVERY:
                seen, pieces = settle(seen)[0], 1  # the levels themselves stay: they are the result
    if not levels:
        return frontier.withColumn("depth", F.lit(0)).limit(0)
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    return found


def _union(pieces: list[DataFrame]) -> DataFrame:
    every = pieces[0]
    for piece in pieces[1:]:
        every = every.union(piece)
    return every


def edges_reached(adjacency: Adjacency, roots: DataFrame, max_depth: int | None = None) -> list[DataFrame]:
    """Breadth-first walk from every row of `roots` (column `root`) at once, level by level.

    A level has (root, parent, vertex, met, carried columns): every edge out of the vertices first met a
    level before, once, and whether its end was met no later than its start. What was met is kept by
    (root, vertex) once it is large, so that a level is shuffled to it and not the other way round.
    """
    limit = adjacency.broadcast_rows
    frontier, rows = settle(roots.select("root", F.col("root").alias("vertex")).distinct())
    if rows > limit:
        frontier, rows = settle_distinct(frontier)
    seen, seen_rows, levels = [frontier], rows, []
    while rows and len(levels) != max_depth:
        stepped = adjacency.step(frontier.withColumn("parent", F.col("vertex")), rows)
        large = rows > limit
        if large:
            stepped = stepped.repartition(partitions(stepped.sparkSession), "root", "vertex")
        met = F.lit(False)
        # Small pieces are one broadcast table; large ones lie in the same partitions as the level.
        pieces = [_union(seen)] if seen_rows <= limit else seen
        for number, piece in enumerate(pieces):
            known = piece.select("root", "vertex", F.lit(True).alias(f"met_{number}"))
            known = F.broadcast(known) if seen_rows <= limit else known
            stepped = stepped.join(known, ["root", "vertex"], "left")
            met = met | F.col(f"met_{number}").isNotNull()
        level = stepped.select("root", "parent", "vertex", met.alias("met"), *adjacency.carry)
        level, count = settle_laid_out(level, "root", "vertex") if large else settle(level)
        if not count:
            break
        levels.append(level)
        fresh = level.where("not met").select("root", "vertex")
        if large:
            frontier = fresh.distinct()  # within the partitions of the level
            rows = frontier.count()
        else:
            frontier, rows = settle_distinct(fresh) if count > limit else settle(fresh.distinct())
        if rows:
            seen, seen_rows = [*seen, frontier], seen_rows + rows
            if len(seen) >= COMPACT_EVERY:
                seen = [settle_distinct(_union(seen))[0] if seen_rows > limit else settle(_union(seen))[0]]
    adjacency.close()
    return levels


def reach_any(adjacency: Adjacency, starts: DataFrame) -> DataFrame:
    """(vertex) met by walking from all of `starts` (column `vertex`) as one set, each vertex once.

    A start is in the result only if a step leads to it.
    """
    frontier, rows = settle(starts.select("vertex").distinct())
    expanded, met = frontier, frontier.limit(0)
    pieces = 1
    while rows:
        stepped, count = settle(adjacency.step(frontier, rows).select("vertex").distinct())
        if not count:
            break
        met = met.union(stepped)
        frontier, rows = settle(stepped.join(expanded, "vertex", "left_anti"))
        expanded, pieces = expanded.union(frontier), pieces + 1
        if pieces >= COMPACT_EVERY:
            expanded, met, pieces = settle(expanded)[0], settle(met.distinct())[0], 1
    return met.distinct()

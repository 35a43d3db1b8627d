"""Who reaches whom, for many roots at once: bit-parallel breadth-first search over numbered vertices.

An `Index` numbers the vertices in the order of their paths and holds the graph twice: `links` between
vertices, and `dag` between components, each component one vertex that knows how many members and
bytes it stands for. A walk keeps one row per vertex and batch of 64 roots; which of them have come
by is a `bigint` mask, combined by `bit_or`, and a level is what is newly set. Counts need no levels,
so they walk the components and never tell apart the members of a cycle. Roots are batched by their
smallest neighbour, so roots that share a dependency share rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions import skew
from stowage.operators.walks import CHAIN_SEPARATOR, COMPACT_EVERY, Adjacency, reach_any
from stowage.session import partitions, settle, settle_laid_out

BATCH_BITS = 6  # 64 roots fit into a bigint
ROWS_PER_PATHS = 3
# One goal to so many vertices, or fewer, are few.
FEW_GOALS = 8


class Index(NamedTuple):
    """ids: (asset_path, vertex, home, members, bytes, out_links, in_links, out_near, in_near): home is the
    component's least vertex, members and bytes are the component's, links the vertex's, and near is the
    least other component that its links lead to. links: (src, dst). dag: (src, dst, src_members, src_bytes, dst_members,
    dst_bytes) between homes, with what they stand for. An index by hashes has no bytes in its dag, and the
    nearest of a vertex in tables (vertex, near) of their own, which are computed only if many roots ask."""

    ids: DataFrame
    links: DataFrame
    dag: DataFrame
    out_near: DataFrame | None = None
    in_near: DataFrame | None = None


def number(nodes: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Vertices (`asset_path`, `file_size`) in numbers that follow their paths; `members` are the cycles'."""
    order = F.concat("asset_path", F.lit(CHAIN_SEPARATOR))
    named = nodes.select("asset_path", F.coalesce("file_size", F.lit(0)).alias("bytes"), order.alias("order"))
    named = named.repartitionByRange("order").sortWithinPartitions("order")
    named, _ = settle(named.select("asset_path", "bytes", F.monotonically_increasing_id().alias("vertex")))
    if members is None:
        return named.select("asset_path", "vertex", F.col("vertex").alias("home"), F.lit(1).cast("bigint").alias("members"), "bytes")
    inside = members.select("asset_path", "component").join(named, "asset_path")
    groups = inside.groupBy("component").agg(
        F.min("vertex").alias("home"), F.count(F.lit(1)).alias("members"), F.sum("bytes").alias("all_bytes"), F.count(F.lit(1)).alias("size")
    )
    homes = skew.join_sized(inside.select("component", "vertex"), groups, "component", "size", F.col("vertex"))
    return named.join(homes.drop("component", "size"), "vertex", "left").select(
        "asset_path",
        "vertex",
        F.coalesce("home", "vertex").alias("home"),
        F.coalesce("members", F.lit(1)).alias("members"),
        F.coalesce("all_bytes", "bytes").alias("bytes"),
    )


def number_links(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Arcs: distinct edges between different vertices, in numbers, with what each end stands for.

    (src, src_home, src_members, src_bytes, dst, dst_home, dst_members, dst_bytes). The paths are met
    once per end; whatever else is asked of the graph is read off the arcs.
    """
    distinct = edges.where("from_path <> to_path").select("from_path", "to_path").distinct()

    def named(path: str, end: str) -> DataFrame:
        own = [F.col(c).alias(f"{end}_{c}") for c in ("home", "members", "bytes")]
        return ids.select(F.col("asset_path").alias(path), F.col("vertex").alias(end), *own)

    return distinct.join(named("from_path", "src"), "from_path").drop("from_path").join(named("to_path", "dst"), "to_path").drop("to_path")


def links(arcs: DataFrame) -> DataFrame:
    return arcs.select("src", "dst")


WEIGHTS = ("src_members", "src_bytes", "dst_members", "dst_bytes")


def _between_homes(arcs: DataFrame) -> DataFrame:
    return arcs.select(F.col("src_home").alias("src"), F.col("dst_home").alias("dst"), *WEIGHTS)


def bridges(arcs: DataFrame) -> DataFrame:
    """Links between components, one of them a cycle: the only ones that several arcs may stand for."""
    several = (F.col("src_members") > 1) | (F.col("dst_members") > 1)
    return _between_homes(arcs.where(several & (F.col("src_home") != F.col("dst_home")))).distinct()


def condense(arcs: DataFrame, bridges: DataFrame) -> DataFrame:
    """Links between components, with what their ends stand for. Most vertices are their own component."""
    single = (F.col("src_members") == 1) & (F.col("dst_members") == 1)
    return _between_homes(arcs.where(single)).unionByName(bridges)


def mark(named: DataFrame, arcs: DataFrame) -> DataFrame:
    """Numbered vertices with how many others they are linked to, and the least components these lie in."""
    apart = F.col("src_home") != F.col("dst_home")
    one, none, no_home = F.lit(1).cast("bigint"), F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    names = ("vertex", "out_links", "in_links", "out_near", "in_near")
    row = lambda *columns: [column.alias(name) for name, column in zip(names, columns)]
    ends = arcs.select(*row(F.col("src"), one, none, F.when(apart, F.col("dst_home")), no_home)).unionAll(
        arcs.select(*row(F.col("dst"), none, one, no_home, F.when(apart, F.col("src_home"))))
    )
    found = ends.groupBy("vertex").agg(
        *(F.sum(name).alias(name) for name in names[1:3]), *(F.min(name).alias(name) for name in names[3:])
    )
    return named.join(found, "vertex", "left").fillna(0, ["out_links", "in_links"])


def build(edges: DataFrame, nodes: DataFrame | None = None, members: DataFrame | None = None) -> Index:
    """The index of a graph that is not stored. Without `nodes`, vertices are the ends of edges, of no size."""
    ends = edges.select(F.col("from_path").alias("asset_path")).union(edges.select("to_path")).distinct()
    if nodes is None:
        nodes = ends.withColumn("file_size", F.lit(0).cast("bigint"))
    else:
        known = nodes.select("asset_path", "file_size")
        unknown = ends.join(known, "asset_path", "left_anti").withColumn("file_size", F.lit(0).cast("bigint"))
        nodes = known.unionByName(unknown)
    named, _ = settle(number(nodes, members))
    arcs, _ = settle(number_links(edges, named))
    return Index(settle(mark(named, arcs))[0], links(arcs), condense(arcs, settle(bridges(arcs))[0]))


# ---------------------------------------------------------------- by hashes


def path_hash(path: str) -> Column:
    return F.xxhash64(path)


def tells_apart(nodes: DataFrame) -> bool:
    """Whether every vertex has a hash of its own; one that comes twice has not."""
    hashes = nodes.where("asset_path is not null").select(path_hash("asset_path").alias("vertex"))
    return hashes.groupBy("vertex").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def _homes(members: DataFrame) -> DataFrame:
    """(vertex, home, members) of all that lie on cycles: few rows of numbers. A home is the hash of its least path."""
    return members.select(path_hash("asset_path").alias("vertex"), path_hash("component").alias("home"), F.col("size").alias("members"))


def hashed_ids(nodes: DataFrame, members: DataFrame, edges: DataFrame) -> DataFrame:
    """`ids` of vertices that have a hash each, without what is nearest. Degrees count edges that are no links: those come off."""
    one = F.lit(1).cast("bigint")
    odd = edges.where("from_path is null or from_path = to_path").groupBy(F.col("to_path").alias("asset_path"))
    odd, odd_rows = settle(odd.agg(F.count(F.lit(1)).alias("off_in"), F.count("from_path").alias("off_out")))
    named = nodes.where("asset_path is not null").join(skew.bounded(odd, odd_rows), "asset_path", "left").select(
        "asset_path",
        path_hash("asset_path").alias("vertex"),
        F.coalesce("file_size", F.lit(0)).alias("bytes"),
        (F.col("out_degree") - F.coalesce("off_out", F.lit(0))).alias("out_links"),
        (F.col("in_degree") - F.coalesce("off_in", F.lit(0))).alias("in_links"),
    )
    homes, rows = settle(_homes(members))
    few = rows <= ROWS_PER_PATHS * skew.BROADCAST_ROWS
    small = lambda df: F.broadcast(df) if few else df
    sums = named.select("vertex", "bytes").join(small(homes), "vertex").groupBy("home").agg(F.sum("bytes").alias("all_bytes"))
    groups, _ = settle(homes.join(sums, "home"))
    return named.join(small(groups), "vertex", "left").select(
        "asset_path",
        "vertex",
        F.coalesce("home", "vertex").alias("home"),
        F.coalesce("members", one).alias("members"),
        F.coalesce("all_bytes", "bytes").alias("bytes"),
        "out_links",
        "in_links",
    )


def hashed_arcs(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(src, dst, src_home, src_members, dst_home, dst_members), read off the edges; nothing is shuffled while cycles are few.

    What is said of an end is null unless it lies on a cycle: most are their own home.
    """
    homes, rows = settle(_homes(members))
    arcs = edges.where("from_path <> to_path").select(path_hash("from_path").alias("src"), path_hash("to_path").alias("dst"))
    for end in ("src", "dst"):
        own = homes.select(F.col("vertex").alias(end), F.col("home").alias(f"{end}_home"), F.col("members").alias(f"{end}_members"))
        arcs = arcs.join(F.broadcast(own) if rows <= ROWS_PER_PATHS * skew.BROADCAST_ROWS else own, end, "left")
    return arcs.select("src", "dst", "src_home", "src_members", "dst_home", "dst_members")


def hashed(ids: DataFrame, arcs: DataFrame, edges: DataFrame) -> Index:
    """An index whose vertices are hashes of paths: for walks that do not ask for the order of paths."""
    one = F.lit(1).cast("bigint")
    dag = arcs.select(
        F.coalesce("src_home", "src").alias("src"),
        F.coalesce("dst_home", "dst").alias("dst"),
        F.coalesce("src_members", one).alias("src_members"),
        F.coalesce("dst_members", one).alias("dst_members"),
    ).where("src <> dst")
    # What an asset refers to lies together; its least path is the one that many others refer to as well, or as good as any.
    out = edges.groupBy("from_path").agg(F.min("to_path").alias("to_path"))
    out = out.select(path_hash("from_path").alias("vertex"), path_hash("to_path").alias("near"))
    into = arcs.groupBy(F.col("dst").alias("vertex")).agg(F.min("src").alias("near"))
    return Index(ids, links(arcs), dag, out, into)


# ---------------------------------------------------------------- masks


def batched(roots: DataFrame) -> tuple[DataFrame, int]:
    """`roots` (a row per `vertex`, and `near`) with their `batch` and `bit`, and how many they are."""
    ordered = roots.repartition("near").sortWithinPartitions("near", "vertex").drop("near")
    numbered = ordered.withColumn("number", F.monotonically_increasing_id())
    batch, bit = F.shiftright("number", BATCH_BITS), F.col("number").bitwiseAND(F.lit((1 << BATCH_BITS) - 1))
    return settle(numbered.withColumn("batch", batch).withColumn("bit", bit.cast("int")).drop("number"))


def spread(adjacency: Adjacency, seeds: DataFrame, rows: int, max_depth: int | None = None) -> list[DataFrame]:
    """Levels of a walk from `seeds` (vertex, batch, mask, carried columns): what is newly set in each.

    Level 0 are the seeds. Rows of all levels together have every (vertex, batch, bit) once.
    """
    carried, limit, parts = adjacency.carry, adjacency.broadcast_rows, partitions(seeds.sparkSession)
    fresh = lambda mask, had: [F.col("vertex"), F.col("batch"), mask.alias("got"), had.alias("had"), *carried]
    weights = [F.max(c).alias(c) for c in carried]
    none = F.lit(0).cast("bigint")
    frontier = seeds
    levels, known, known_rows, laid_out = [frontier], [frontier], rows, False
    while rows and len(levels) - 1 != max_depth:
        stepped = adjacency.step(frontier.drop(*carried), rows)
        if known_rows <= limit:
            merged = stepped.select(*fresh(F.col("mask"), none)).unionByName(_union(known).select(*fresh(none, F.col("mask"))))
            merged = merged.groupBy("vertex", "batch").agg(F.bit_or("got").alias("got"), F.bit_or("had").alias("had"), *weights)
            new = F.col("got").bitwiseAND(F.bitwise_not("had"))
            frontier, rows = settle(merged.select("vertex", "batch", new.alias("mask"), *carried).where("mask <> 0"))
        else:
            if not laid_out or len(known) >= COMPACT_EVERY:
                # The levels themselves stay: they are the result.
                whole = _union([piece.select("vertex", "batch", "mask") for piece in known]).repartition(parts, "vertex", "batch")
                whole = whole.groupBy("vertex", "batch").agg(F.bit_or("mask").alias("mask"))
                known, laid_out = [settle_laid_out(whole, "vertex", "batch")[0]], True
            # What is known lies in the partitions that the step is shuffled to, and is not shuffled again.
            merged = stepped.repartition(parts, "vertex", "batch").groupBy("vertex", "batch").agg(F.bit_or("mask").alias("got"), *weights)
            new = F.col("got")
            for number, piece in enumerate(known):
                merged = merged.join(piece.select("vertex", "batch", F.col("mask").alias(f"had_{number}")), ["vertex", "batch"], "left")
                new = new.bitwiseAND(F.bitwise_not(F.coalesce(f"had_{number}", none)))
            found = merged.select("vertex", "batch", new.alias("mask"), *carried).where("mask <> 0")
            frontier, rows = settle_laid_out(found, "vertex", "batch")
        if rows:
            levels.append(frontier)
            known, known_rows = [*known, frontier], known_rows + rows
            if not laid_out and len(known) >= COMPACT_EVERY:
                known = [settle(_union(known))[0]]
    return levels


def _union(pieces: list[DataFrame]) -> DataFrame:
    every = pieces[0]
    for piece in pieces[1:]:
        every = every.unionByName(piece)
    return every


def _roots_of(masks: DataFrame) -> DataFrame:
    """A row per bit that is set."""
    every = F.sequence(F.lit(0), F.lit((1 << BATCH_BITS) - 1))
    several = F.filter(every, lambda bit: F.getbit("mask", bit) == 1)
    only = F.when(F.col("mask") < 0, 63).otherwise(F.bit_count(F.expr("mask - 1")).cast("int"))
    bits = F.when(F.bit_count("mask") == 1, F.array(only)).otherwise(several)
    return masks.withColumn("bit", F.explode(bits)).drop("mask")


def _adjacency(table: DataFrame, at: str, to: str, carry: tuple[str, ...] = (), **layout) -> Adjacency:
    """Rows of a few numbers are broadcast up to as many bytes as rows of two paths are."""
    return Adjacency(table, at, to, carry=carry, **({"broadcast_rows": ROWS_PER_PATHS * skew.BROADCAST_ROWS} | layout))


def _seeds(bits: DataFrame, *carried: str) -> DataFrame:
    return bits.select("vertex", "batch", F.expr("shiftleft(1L, bit)").alias("mask"), *carried)


def _hot(index: Index, links: str) -> DataFrame:
    """(vertex, size) of homes, with no fewer links than they have in the dag: only their cycles are grouped."""
    sizes = index.ids.select(F.col("home").alias("vertex"), F.col(links).alias("size"), "members")
    inside = sizes.where("members > 1").groupBy("vertex").agg(F.sum("size").alias("size"))
    return sizes.where("members = 1").drop("members").unionByName(inside)


def _near(index: Index, roots: DataFrame, rows: int, reverse: bool) -> DataFrame:
    """`roots` (vertex) with what is `near` them: it only decides which of them are walked together."""
    table = index.in_near if reverse else index.out_near
    if table is None:
        return roots.withColumnRenamed("in_near" if reverse else "out_near", "near")
    if rows <= 1 << BATCH_BITS:
        return roots.withColumn("near", F.lit(None).cast("bigint"))
    return roots.join(table, "vertex", "left")


def reached(index: Index, homes: DataFrame, reverse: bool = False, sized: bool = True, **layout) -> DataFrame:
    """(home, members, bytes) of everything that each of `homes` (vertex, members, bytes, near) reaches, itself included.

    Bytes only if `sized`.
    """
    at, to = ("dst", "src") if reverse else ("src", "dst")
    weights = ("members", "bytes") if sized else ("members",)
    # Links carry the weight of the vertex they lead to.
    dag = index.dag.withColumnsRenamed({f"{to}_members": "members", f"{to}_bytes": "bytes"})
    if sized and "bytes" not in dag.columns:
        sizes = index.ids.where("vertex = home").select(F.col("vertex").alias(to), "bytes")
        dag, _ = settle(dag.select(at, to, "members").join(sizes, to))
    dag = dag.select(at, to, *weights)
    bits, n = batched(homes)
    adjacency = _adjacency(dag, at, to, weights, sizes=_hot(index, "in_links" if reverse else "out_links"), **layout)
    levels = spread(adjacency, _seeds(bits, *weights), n)
    adjacency.close()
    sums = _roots_of(_union(levels)).groupBy("batch", "bit").agg(*(F.sum(c).alias(c) for c in weights))
    return bits.select(F.col("vertex").alias("home"), "batch", "bit").join(sums, ["batch", "bit"]).drop("batch", "bit")


def counts(index: Index, roots: DataFrame, reverse: bool = False, sized: bool = True, **layout) -> DataFrame:
    """(asset_path, direct_count, transitive_count, total_bytes) of every root, unknown ones included.

    Counts leave the root out; bytes have it in, and come only if `sized`.
    """
    paths = roots.select("asset_path").distinct()
    near, links = ("in_near", "in_links") if reverse else ("out_near", "out_links")
    known = index.ids.withColumnRenamed(links, "direct_count")
    nearest = [near] if near in known.columns else []
    known = known.select("asset_path", "home", "members", "bytes", "direct_count", *nearest)
    wanted, rows = settle(known.join(paths, "asset_path", "left_semi"))
    homes = wanted.groupBy(F.col("home").alias("vertex")).agg(*(F.min(c).alias(c) for c in ("members", "bytes", *nearest)))
    everything = reached(index, _near(index, homes, rows, reverse), reverse, sized, **layout)
    transitive = F.col("members") - 1 - F.col("direct_count")
    found = wanted.select("asset_path", "home", "direct_count").join(everything, "home")
    total = [F.col("bytes").alias("total_bytes")] if sized else []
    found = found.select("asset_path", "direct_count", transitive.alias("transitive_count"), *total)
    return paths.join(found, "asset_path", "left").fillna(0)


def levels(index: Index, roots: DataFrame, reverse: bool = False, max_depth: int | None = None, **layout) -> DataFrame:
    """(asset_path of a root, vertex, depth >= 1), as a walk over `links`; a root is never in its own result."""
    at, to = ("dst", "src") if reverse else ("src", "dst")
    near, links = ("in_near", "in_links") if reverse else ("out_near", "out_links")
    paths = roots.select("asset_path").distinct()
    wanted = index.ids.join(paths, "asset_path", "left_semi")
    wanted, rows = settle(wanted.select("asset_path", "vertex", *([near] if near in wanted.columns else [])))
    bits, n = batched(_near(index, wanted, rows, reverse))
    adjacency = _adjacency(index.links, at, to, sizes=index.ids.select("vertex", F.col(links).alias("size")), **layout)
    found = spread(adjacency, _seeds(bits), n, max_depth)
    adjacency.close()
    rows = found[0].limit(0).withColumn("depth", F.lit(0))
    for depth, level in enumerate(found[1:], 1):
        rows = rows.unionByName(level.withColumn("depth", F.lit(depth)))
    named = skew.bounded(bits.select("asset_path", "batch", "bit"), n)
    return _roots_of(rows).join(named, ["batch", "bit"]).select("asset_path", "vertex", "depth")


def referrers_of_any(index: Index, targets: DataFrame, **layout) -> DataFrame:
    """(asset_path) of everything that reaches a target other than itself: one walk over components."""
    wanted, _ = settle(index.ids.join(targets.select("asset_path").distinct(), "asset_path", "left_semi"))
    homes, rows = settle(wanted.groupBy("home").agg(F.count(F.lit(1)).alias("targets"), F.min("vertex").alias("only")))
    adjacency = _adjacency(index.dag, "dst", "src", sizes=_hot(index, "in_links"), **layout)
    met, n = settle(reach_any(adjacency, homes.select(F.col("home").alias("vertex"))).withColumnRenamed("vertex", "home"))
    adjacency.close()
    beyond = index.ids.join(skew.bounded(met, n), "home", "left_semi").select("asset_path")
    # Within a component everything reaches its targets, but a single target only itself.
    inside = index.ids.join(skew.bounded(homes, rows), "home").where((F.col("targets") > 1) | (F.col("vertex") != F.col("only")))
    return beyond.union(inside.select("asset_path")).distinct()


# ---------------------------------------------------------------- shortest chains


def shortest(index: Index, sources: DataFrame, goals: DataFrame, pairs: DataFrame | None = None, **layout) -> DataFrame:
    """(source, target, hops, chain): fewest-hop referrer chains, the smallest one by its paths.

    `sources` and `goals` have a `vertex`; `pairs` (root, goal) narrows them to single pairs. First few
    goals walk towards the sources as one set, which leaves the vertices that lead to a goal at all; where
    goals are a large part of all vertices that would rule out little, and is left out. The sources then
    walk over those, and with `pairs` a source stops when all its goals are met. Frontiers hold
    numbers: a vertex, the parent it is reached from, and the parent's rank among the smallest chains of
    its level. Chains are read off parents backwards, for wanted pairs alone.
    """
    goals, goal_rows = settle(goals.select("vertex").distinct())
    leading = index.links
    if goal_rows * FEW_GOALS < index.ids.count():
        back = _adjacency(index.links, "src", "dst", **layout)
        useful, useful_rows = settle(reach_any(back, goals).union(goals).distinct())
        back.close()
        ends = skew.bounded(useful.withColumnRenamed("vertex", "src"), useful_rows)
        leading, _ = settle(leading.join(ends, "src", "left_semi"))
    walk = _adjacency(leading, "dst", "src", **layout)

    starts = sources.select(F.col("vertex").alias("root"), "vertex").distinct()
    start = starts.select("root", "vertex", F.lit(0).cast("bigint").alias("rank"), F.lit(None).cast("bigint").alias("parent"))
    frontier, rows = settle(start)
    found, seen, pieces = [frontier], frontier.select("root", "vertex"), 1
    while rows:
        stepped = walk.step(frontier.withColumn("parent", F.col("vertex")), rows)
        best = F.min(F.struct("rank", "parent")).alias("best")
        new = stepped.groupBy("root", "vertex").agg(best).join(seen, ["root", "vertex"], "left_anti")
        # Ranks follow (parent's rank, own path); numbers of vertices follow paths.
        new, _ = settle(new.select("root", "vertex", "best.rank", "best.parent"))  # sampled, then sorted
        ordered = new.repartitionByRange("rank", "vertex")
        ordered = ordered.sortWithinPartitions("rank", "vertex").withColumn("rank", F.monotonically_increasing_id())
        frontier, rows = settle(ordered)
        if not rows:
            break
        found.append(frontier)
        seen, pieces = seen.union(frontier.select("root", "vertex")), pieces + 1
        if pieces >= COMPACT_EVERY:
            seen, pieces = settle(seen)[0], 1
        if pairs is not None:
            open_ = pairs.select("root", F.col("goal").alias("vertex")).join(seen, ["root", "vertex"], "left_anti")
            frontier, rows = settle(frontier.join(open_.select("root").distinct(), "root", "left_semi"))
    walk.close()

    wanted = lambda level: level.join(skew.bounded(goals, goal_rows), "vertex", "left_semi")
    if pairs is not None:
        wanted = lambda level: level.join(pairs.select("root", F.col("goal").alias("vertex")), ["root", "vertex"], "left_semi")
    walkers, steps = None, []
    for depth in range(len(found) - 1, 0, -1):
        level = found[depth]
        ends = wanted(level.select("root", "vertex")).select("root", F.col("vertex").alias("goal"), "vertex", F.lit(depth).alias("hops"))
        at = ends if walkers is None else ends.unionByName(walkers)
        at, _ = settle(at.join(level.select("root", "vertex", "parent"), ["root", "vertex"]))
        steps.append(at.select("root", "goal", "hops", "vertex", F.lit(depth).alias("place")))
        walkers = at.select("root", "goal", F.col("parent").alias("vertex"), "hops")
    if walkers is None:
        return index.ids.sparkSession.createDataFrame([], "source string, target string, hops int, chain string")
    rows = walkers.select("root", "goal", "hops", "vertex", F.lit(0).alias("place"))
    for step in steps:
        rows = rows.unionByName(step)
    named = rows.join(index.ids.select("vertex", "asset_path"), "vertex")
    places = F.array_sort(F.collect_list(F.struct("place", "asset_path")))["asset_path"]  # hops + 1 of them
    chains = named.groupBy("root", "goal").agg(places.alias("paths"), F.first("hops").alias("hops"))
    return chains.select(
        F.get("paths", F.lit(0)).alias("source"),
        F.element_at("paths", -1).alias("target"),
        "hops",
        F.array_join("paths", CHAIN_SEPARATOR).alias("chain"),
    )

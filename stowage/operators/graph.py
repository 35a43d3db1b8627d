"""Questions over the reference graph: plain joins, plus driver loops for the iterative ones.

Every loop follows one pattern: a round is a declarative join, its result is written to the
checkpoint folder together with its row count, and the loop ends on an empty round. The
driver only ever sees row counts. Joins inside a loop broadcast the moving side while its
counted size allows it, and otherwise shuffle it against an edge table in which the edges of
heavily referenced vertices are split into parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.functions import paths, skew
from stowage.operators import reachability
from stowage.operators.reachability import Index
from stowage.operators.walks import Adjacency, edges_reached, reach, reach_any  # noqa: F401
from stowage.session import discard, settle, settle_observed

# Reference roots that are not part of a project.
EXTERNAL_ROOTS = ("/Engine/", "/Script/")
# Sub-object types no other asset can import, so "unreferenced" says nothing.
ENGINE_SUBOBJECT_TYPES = (
    "MetaData",
    "AssetImportData",
    "BillboardComponent",
    "ActorFolder",
    "ArrowComponent",
    "BlueprintGeneratedClass",
    "AnimCurveMetaData",
    "BodySetup",
)


# ---------------------------------------------------------------- building


def internal_edges(
    deps: DataFrame, external_roots: tuple[str, ...] = EXTERNAL_ROOTS, include_soft: bool = True
) -> DataFrame:
    """Edges of the graph. Only the target decides whether an edge leaves the project."""
    kept = deps.where(~paths.starts_with_any(F.col("to_path"), list(external_roots)))
    return kept if include_soft else kept.where(~F.col("is_soft"))


def vertices(assets: DataFrame, edges: DataFrame) -> DataFrame:
    """Assets plus a typeless, zero-sized placeholder for each unknown edge end."""
    ends = edges.select(F.col("to_path").alias("asset_path")).union(edges.select("from_path")).distinct()
    return _with_placeholders(assets, ends)


def _with_placeholders(assets: DataFrame, ends: DataFrame) -> DataFrame:
    known = assets.select("asset_path", "asset_type", "file_size", F.lit(False).alias("is_placeholder"))
    unknown = ends.join(assets.select("asset_path"), "asset_path", "left_anti").select(
        "asset_path",
        F.lit("").alias("asset_type"),
        F.lit(0).cast("bigint").alias("file_size"),
        F.lit(True).alias("is_placeholder"),
    )
    return known.unionByName(unknown)


def pointed_at(edges: DataFrame) -> DataFrame:
    """(asset_path) of every end of an edge. Edges may come several times."""
    return edges.select(F.col("to_path").alias("asset_path")).distinct()


def starts(assets: DataFrame, edges: DataFrame, pointed: DataFrame) -> DataFrame:
    """Those of `vertices` that are not `pointed` at, with an in_degree of 0. Edges may come several times."""
    ends = edges.select(F.col("from_path").alias("asset_path")).distinct()
    nodes = _with_placeholders(assets, ends).join(pointed, "asset_path", "left_anti")
    return nodes.withColumn("in_degree", F.lit(0).cast("bigint"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`nodes` with in_degree and out_degree; stored vertices have them already."""
    if "in_degree" in nodes.columns:
        return nodes
    incoming = edges.groupBy(F.col("to_path").alias("asset_path")).agg(F.count(F.lit(1)).alias("in_degree"))
    outgoing = edges.groupBy(F.col("from_path").alias("asset_path")).agg(F.count(F.lit(1)).alias("out_degree"))
    return (
        nodes.join(incoming, "asset_path", "left")
        .join(outgoing, "asset_path", "left")
        .fillna(0, ["in_degree", "out_degree"])
    )


def analysed(assets: DataFrame, edges: DataFrame) -> DataFrame:
    """`vertices` with their `degrees`, counted for both ends of all edges in one grouping."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    ends = edges.select(F.col("to_path").alias("asset_path"), one.alias("in_degree"), none.alias("out_degree")).unionAll(
        edges.select(F.col("from_path").alias("asset_path"), none.alias("in_degree"), one.alias("out_degree"))
    )
    ends = ends.groupBy("asset_path").agg(F.sum("in_degree").alias("in_degree"), F.sum("out_degree").alias("out_degree"))
    known = assets.select("asset_path", "asset_type", "file_size", F.lit(True).alias("known"))
    nodes = known.join(ends, "asset_path", "full")
    placeholder = F.col("known").isNull()
    # As in joins, a null path is an end of no edge.
    degree = lambda name: F.when(F.col("asset_path").isNull(), none).otherwise(F.coalesce(name, none)).alias(name)
    return nodes.select(
        "asset_path",
        F.when(placeholder, F.lit("")).otherwise(F.col("asset_type")).alias("asset_type"),
        F.when(placeholder, none).otherwise(F.col("file_size")).alias("file_size"),
        placeholder.alias("is_placeholder"),
        degree("in_degree"),
        degree("out_degree"),
    )


# ---------------------------------------------------------------- one-hop questions


def unreferenced(
    nodes: DataFrame,
    edges: DataFrame,
    excluded_types: tuple[str, ...] = ENGINE_SUBOBJECT_TYPES,
    exclude_per_actor: bool = True,
) -> DataFrame:
    """Vertices nothing points at. A self-reference counts as a reference.

    Stored vertices know their degrees, so for them this is a scan.
    """
    kept = nodes
    if excluded_types:
        kept = kept.where(~F.col("asset_type").isin(*excluded_types))
    if exclude_per_actor:
        kept = kept.where(~paths.is_per_actor_file(F.col("asset_path")))
    if "in_degree" in kept.columns:
        return kept.where(F.col("in_degree") == 0).drop("in_degree", "out_degree")
    # Distinct first: a hub with a third of all edges shrinks to one row before the shuffle.
    referenced = edges.select(F.col("to_path").alias("asset_path")).distinct()
    return kept.join(referenced, "asset_path", "left_anti")


def direct_dependencies(
    wanted: DataFrame, edges: DataFrame, nodes: DataFrame, hot_rows: int = skew.HOT_ROWS
) -> DataFrame:
    """(asset_path, dep_path, dep_type) for a table of assets. What many of them point at is split."""
    out = edges.join(wanted.select(F.col("asset_path").alias("from_path")).distinct(), "from_path", "left_semi")
    types = nodes.select(F.col("asset_path").alias("to_path"), F.col("asset_type").alias("dep_type"))
    sizes = out.groupBy("to_path").agg(F.count(F.lit(1)).alias("size"))
    typed = skew.join_sized(out, sizes.join(types, "to_path"), "to_path", "size", F.col("from_path"), hot_rows)
    return typed.select(F.col("from_path").alias("asset_path"), F.col("to_path").alias("dep_path"), "dep_type")


def direct_referrers(wanted: DataFrame, edges: DataFrame) -> DataFrame:
    """(asset_path, referrer) for a table of assets."""
    into = edges.join(wanted.select(F.col("asset_path").alias("to_path")).distinct(), "to_path", "left_semi")
    return into.select(F.col("to_path").alias("asset_path"), F.col("from_path").alias("referrer"))


def redirectors(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("asset_type") == "ObjectRedirector")


# ---------------------------------------------------------------- reach


def referrers_of_any(edges: DataFrame, targets: DataFrame, index: Index | None = None, **layout) -> DataFrame:
    """(asset_path) of everything that reaches a target other than itself, in one walk."""
    index = index or reachability.build(edges, members=strong_components(edges, **layout))
    return reachability.referrers_of_any(index, targets, **layout)


def impact(edges: DataFrame, targets: DataFrame, index: Index | None = None, **layout) -> DataFrame:
    """Who is affected by each target: (target, asset_path, depth, kind)."""
    index = index or reachability.build(edges)
    found = reachability.levels(index, targets, reverse=True, **layout).withColumnRenamed("asset_path", "target")
    kind = F.when(F.col("depth") == 1, "direct").otherwise("transitive").alias("kind")
    return found.join(index.ids.select("vertex", "asset_path"), "vertex").select("target", "asset_path", "depth", kind)


def impact_counts(edges: DataFrame, targets: DataFrame, index: Index | None = None, **layout) -> DataFrame:
    """Per target: how many assets refer to it directly and through others, itself left out."""
    index = index or reachability.build(edges)
    return reachability.counts(index, targets, reverse=True, sized=False, **layout)


def closure_stats(edges: DataFrame, nodes: DataFrame, roots: DataFrame, index: Index | None = None, **layout) -> DataFrame:
    """Per root: direct and transitive dependency counts, and bytes including the root."""
    index = index or reachability.build(edges, nodes)
    return reachability.counts(index, roots, **layout)


def shortest_chains(edges: DataFrame, pairs: DataFrame, index: Index | None = None, **layout) -> DataFrame:
    """Fewest-hop referrer chain from `source` to `target`; pairs without one are absent."""
    index = index or reachability.build(edges)
    numbered = (
        pairs.select("source", "target")
        .distinct()
        .join(index.ids.select(F.col("asset_path").alias("source"), F.col("vertex").alias("root")), "source")
        .join(index.ids.select(F.col("asset_path").alias("target"), F.col("vertex").alias("goal")), "target")
    )
    numbered, _ = settle(numbered.select("root", "goal"))
    sources, goals = (numbered.select(F.col(c).alias("vertex")) for c in ("root", "goal"))
    return reachability.shortest(index, sources, goals, numbered, **layout)


def shortest_chains_to(edges: DataFrame, sources: DataFrame, goals: DataFrame, index: Index | None = None, **layout) -> DataFrame:
    """Chains from every source to every goal (`asset_path`) that it is reached from."""
    index = index or reachability.build(edges)
    numbered = lambda paths: index.ids.join(paths.distinct(), "asset_path", "left_semi")
    starts = numbered(sources.select(F.col("source").alias("asset_path")))
    return reachability.shortest(index, starts, numbered(goals.select("asset_path")), **layout)


def reference_tree(
    edges: DataFrame,
    members: DataFrame,
    roots: DataFrame,
    max_depth: int | None = None,
    reverse: bool = False,
    **layout,
) -> DataFrame:
    """Everything below each root, one row per edge reached: (root, parent, asset_path, depth, is_cycle, hidden_children).

    A printed tree repeats a subtree under every path that leads to it; here each edge comes
    once, at its parent's least depth plus one, so rows grow with edges, not with paths. The
    walk ends by itself. An edge closes a cycle if it leads to a vertex of its parent's cycle
    (`members`, the strong components) that was met no later than the parent. With a depth,
    `hidden_children` counts what lies below a vertex on the last level.
    """
    at, to = ("to_path", "from_path") if reverse else ("from_path", "to_path")
    hops = edges.select(F.col(at).alias("parent"), F.col(to).alias("asset_path"))
    # Edges inside a cycle are looked up once per edge, not once per root.
    inside = members.select("asset_path", "component")
    closing = (
        hops.join(inside.withColumnsRenamed({"asset_path": "parent", "component": "c"}), "parent")
        .join(inside, "asset_path")
        .where(F.col("c") == F.col("component"))
        .select("parent", "asset_path", F.lit(True).alias("inside"))
        .distinct()
    )
    closing, rows = settle(closing)
    tinted = hops.join(skew.bounded(closing, rows), ["parent", "asset_path"], "left")
    starts = roots.select(F.col("asset_path").alias("root")).distinct()
    levels = edges_reached(Adjacency(tinted, at="parent", to="asset_path", carry=("inside",), **layout), starts, max_depth)
    is_cycle = (F.col("parent") == F.col("vertex")) | (F.col("inside").isNotNull() & F.col("met"))
    none = F.lit(0).cast("bigint")
    rows = [
        level.select(
            "root",
            "parent",
            F.col("vertex").alias("asset_path"),
            F.lit(depth).alias("depth"),
            is_cycle.alias("is_cycle"),
            (F.lit(depth == max_depth) & ~F.col("met")).alias("last"),
        )
        for depth, level in enumerate(levels, 1)
    ]
    upper = rows[:-1] if len(rows) == max_depth else rows
    found = [level.drop("last").withColumn("hidden_children", none) for level in upper]
    if len(rows) == max_depth:
        below = hops.groupBy(F.col("parent").alias("asset_path")).agg(F.count(F.lit(1)).alias("n"))
        hidden = F.when(F.col("last"), F.coalesce("n", none)).otherwise(none).alias("hidden_children")
        lowest = rows[-1].join(below, "asset_path", "left")
        found.append(lowest.select("root", "parent", "asset_path", "depth", "is_cycle", hidden))
    if not found:
        kinds = "root string, parent string, asset_path string, depth int, is_cycle boolean, hidden_children bigint"
        return edges.sparkSession.createDataFrame([], kinds)
    every = found[0]
    for level in found[1:]:
        every = every.unionByName(level)
    return every


# ---------------------------------------------------------------- cycles


def _ends(edges: DataFrame, column: str) -> DataFrame:
    return edges.select(F.col(column).alias("vertex")).distinct()


def _trim_once(edges: DataFrame, rows: int | None) -> tuple[DataFrame, int]:
    """Keep edges that start where some edge ends and end where some edge starts."""
    if rows is not None and rows <= skew.BROADCAST_ROWS:
        targets, sources = F.broadcast(_ends(edges, "dst")), F.broadcast(_ends(edges, "src"))
    else:
        # The vertices with both kinds of edges are usually few. Counting them first decides
        # whether the edge table has to be shuffled at all.
        inner, count = settle(_ends(edges, "dst").join(_ends(edges, "src"), "vertex", "left_semi"))
        targets = sources = skew.bounded(inner, count)
    kept = settle(
        edges.join(targets.withColumnRenamed("vertex", "src"), "src", "left_semi")
        .join(sources.withColumnRenamed("vertex", "dst"), "dst", "left_semi")
        .select("src", "dst")
    )
    if rows is None or rows > skew.BROADCAST_ROWS:
        discard(inner)
    return kept


def _trim(edges: DataFrame, rows: int | None = None) -> tuple[DataFrame, int]:
    """Remove edges that cannot lie on a cycle, from both ends inwards, until nothing changes."""
    before = []
    while True:
        kept, left = _trim_once(edges, rows)
        discard(*before)
        if left == 0 or left == rows:
            return kept, left
        edges, rows, before = kept, left, [kept]


def _colour(out: Adjacency, nodes: DataFrame, count: int) -> DataFrame:
    """(vertex, colour): the largest vertex id from which each vertex can be reached.

    Each round pushes colours along edges and then lets a vertex take the colour of its
    colour, so long cycles settle in far fewer rounds than they have vertices.
    """
    colours, ours = nodes.select("vertex", F.col("vertex").alias("colour")), False
    while True:
        pushed = out.step(colours, count).select("vertex", "colour", F.lit(None).cast("bigint").alias("own"))
        kept = colours.select("vertex", "colour", F.col("colour").alias("own"))
        if count <= skew.BROADCAST_ROWS:
            onward = F.broadcast(colours.select(F.col("vertex").alias("colour"), F.col("colour").alias("further")))
            jumped = colours.join(onward, "colour")
        else:
            sizes = colours.groupBy("colour").agg(F.count(F.lit(1)).alias("size"))
            onward = sizes.join(
                colours.select(F.col("vertex").alias("colour"), F.col("colour").alias("further")), "colour"
            )
            jumped = skew.join_sized(colours, onward, "colour", "size", F.col("vertex"))
        jumped = jumped.where(F.col("further") > F.col("colour")).select(
            "vertex", F.col("further").alias("colour"), F.lit(None).cast("bigint").alias("own")
        )
        merged = (
            kept.union(pushed)
            .union(jumped)
            .groupBy("vertex")
            .agg(F.max("colour").alias("colour"), F.max("own").alias("own"))
        )
        merged, seen = settle_observed(merged, changed=F.count_if(F.col("colour") != F.col("own")))
        if ours:
            discard(colours)
        colours, ours = merged.select("vertex", "colour"), True
        if not seen["changed"]:
            return colours


def strong_components(
    edges: DataFrame, from_col: str = "from_path", to_col: str = "to_path", pointed: DataFrame | None = None, **layout
) -> DataFrame:
    """Strongly connected components of two or more vertices: (asset_path, component, size).

    `component` is the smallest member path. Trimming removes the acyclic bulk; what is left
    gets numeric ids and is split by colouring (Orzan 2004): all vertices reached from the
    largest id share its colour, and those that also reach back to it are one component.
    Edges may come several times; `pointed` (asset_path) are their ends, if they are stored.
    """
    pairs = edges.where(F.col(from_col) != F.col(to_col)).select(F.col(from_col).alias("src"), F.col(to_col).alias("dst"))
    # All edges are read once for their ends alone, and once for what starts at one of them.
    ends = edges.select(F.col(to_col).alias("asset_path")).distinct() if pointed is None else pointed
    ends, count = settle(ends)
    ends = ends.withColumnRenamed("asset_path", "src")
    near = []
    if count > skew.BROADCAST_ROWS:
        # Settled, or the semi join would be planned below the screen.
        pairs, _ = settle(skew.screened(pairs, "src", ends, "src", count))
        near = [pairs]
    led, rows = settle(pairs.join(skew.bounded(ends, count), "src", "left_semi"))
    core, rows = _trim(led, rows)
    discard(ends, led, *near)
    spark = edges.sparkSession
    if rows == 0:
        return spark.createDataFrame([], "asset_path string, component string, size bigint")

    # Ids follow the order of hashes, not of paths, so colouring does not meet sorted chains.
    ends = core.select(F.col("src").alias("path")).union(core.select("dst")).distinct()
    names, count = settle(
        ends.sortWithinPartitions(F.xxhash64("path"), "path").select(
            F.monotonically_increasing_id().alias("vertex"), "path"
        )
    )
    lookup = skew.bounded(names, count)
    trimmed = core
    core, rows = settle(
        core.join(lookup.select(F.col("path").alias("src"), F.col("vertex").alias("s")), "src")
        .join(lookup.select(F.col("path").alias("dst"), F.col("vertex").alias("d")), "dst")
        .select(F.col("s").alias("src"), F.col("d").alias("dst"))
    )
    discard(trimmed)
    nodes = names.select("vertex")

    found = []
    while rows:
        onward = Adjacency(core, "src", "dst", **layout)
        colours = _colour(onward, nodes, count)
        tint = skew.bounded(colours, count)
        # A component never spans two colours, so only edges inside one colour matter from here.
        inside, _ = settle(
            core.join(tint.select(F.col("vertex").alias("src"), "colour"), "src")
            .join(tint.select(F.col("vertex").alias("dst"), F.col("colour").alias("c")), "dst")
            .where(F.col("colour") == F.col("c"))
            .select("src", "dst")
        )
        # Seen from the largest id of a colour: a vertex that reaches it, within the colour,
        # belongs to its component. That is the same question on reversed edges.
        backward = Adjacency(inside, "dst", "src", **layout)
        back = _colour(backward, nodes, count)
        done, done_rows = settle(
            colours.join(skew.bounded(back.withColumnRenamed("colour", "back"), count), "vertex")
            .where(F.col("colour") == F.col("back"))
            .select(F.col("colour").alias("root"), "vertex")
        )
        found.append(done)
        over = skew.bounded(done.select("vertex"), done_rows)
        rest = inside.join(over.withColumnRenamed("vertex", "src"), "src", "left_anti").join(
            over.withColumnRenamed("vertex", "dst"), "dst", "left_anti"
        )
        old = [colours, back, inside, core, *([nodes] if len(found) > 1 else [])]
        core, rows = _trim(rest)
        discard(*old)
        onward.close()
        backward.close()
        if rows:
            nodes, count = settle(core.select(F.col("src").alias("vertex")).union(core.select("dst")).distinct())

    members = found[0]
    for more in found[1:]:
        members = members.union(more)
    members, total = settle(members.join(names, "vertex").select("root", F.col("path").alias("asset_path")))
    discard(names, core, *found)
    groups = (
        members.groupBy("root")
        .agg(F.min("asset_path").alias("component"), F.count(F.lit(1)).alias("size"))
        .where(F.col("size") >= 2)
    )
    named = skew.join_sized(members, groups, "root", "size", F.col("asset_path"), total=total)
    result, _ = settle(named.select("asset_path", "component", "size"))
    discard(members)
    return result


def cycles(members: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One row per reported cycle from the component members.

    A component with a per-actor file in it is an artefact of the engine and is left out.
    `fingerprint` stands for the member set in any order: a sum of path digests, of fixed
    size however long the cycle is. With `nodes`, `types` lists the distinct member types.
    """
    # 15 hex digits of MD5 make a 60-bit number; decimal sums of those cannot overflow.
    digest = F.conv(F.substring(F.md5("asset_path"), 1, 15), 16, 10).cast("decimal(38,0)")
    parts = [
        F.max("size").alias("size"),
        F.max("asset_path").alias("last_member"),
        F.sum(digest).cast("string").alias("fingerprint"),
        F.bool_or(paths.is_per_actor_file(F.col("asset_path"))).alias("per_actor"),
    ]
    rows = members
    if nodes is not None:
        rows = members.join(nodes.select("asset_path", "asset_type"), "asset_path", "left")
        parts.append(F.array_join(F.array_sort(F.collect_set("asset_type")), ",").alias("types"))
    return rows.groupBy("component").agg(*parts).where(~F.col("per_actor")).drop("per_actor")


def cycle_members(members: DataFrame) -> DataFrame:
    """Members of the reported cycles."""
    left_out = members.where(paths.is_per_actor_file(F.col("asset_path"))).select("component").distinct()
    return members.join(left_out, "component", "left_anti").select("asset_path", "component", "size")


def new_cycles(before: DataFrame, after: DataFrame) -> DataFrame:
    """Cycles of `after` (component, size) whose exact member set was not a cycle in `before`.

    Both inputs are reported cycle members. A vertex lies in at most one cycle on each side,
    so matching members pairwise gives at most one row per vertex.
    """
    shared = (
        after.select("asset_path", "component", "size")
        .join(
            before.select("asset_path", F.col("component").alias("old"), F.col("size").alias("old_size")), "asset_path"
        )
        .groupBy("component", "size", "old", "old_size")
        .agg(F.count(F.lit(1)).alias("common"))
        .where((F.col("common") == F.col("size")) & (F.col("common") == F.col("old_size")))
    )
    return after.select("component", "size").distinct().join(shared.select("component"), "component", "left_anti")


def soft_cycles(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Cycles of the combined graph that contain at least one soft edge."""
    reported = cycles(members).select("component", "size")
    tint = members.select("asset_path", "component").join(reported.select("component"), "component", "left_semi")
    soft_inside = (
        edges.where(F.col("is_soft"))
        .join(tint.select(F.col("asset_path").alias("from_path"), "component"), "from_path")
        .join(tint.select(F.col("asset_path").alias("to_path"), F.col("component").alias("c")), "to_path")
        .where((F.col("component") == F.col("c")) & (F.col("from_path") != F.col("to_path")))
        .groupBy("component")
        .agg(F.count(F.lit(1)).alias("soft_edges"))
    )
    return reported.join(soft_inside, "component")


# ---------------------------------------------------------------- material chains


def _parents(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Next hop of each material instance: its smallest material-like dependency."""
    like = nodes.where(F.col("asset_type").isin("Material", "MaterialInstance")).select("asset_path", "asset_type")
    instances = like.where(F.col("asset_type") == "MaterialInstance").select(F.col("asset_path").alias("from_path"))
    out = edges.join(instances, "from_path", "left_semi").select("from_path", "to_path")
    # One master material may be the parent of most instances: its hops are split.
    sizes = out.groupBy("to_path").agg(F.count(F.lit(1)).alias("size"))
    kinds = like.select(F.col("asset_path").alias("to_path"), F.col("asset_type").alias("to_type"))
    hops = skew.join_sized(out, sizes.join(kinds, "to_path"), "to_path", "size", F.col("from_path"))
    return (
        hops.groupBy(F.col("from_path").alias("vertex"))
        .agg(F.min(F.struct("to_path", "to_type")).alias("hop"))
        .select("vertex", F.col("hop.to_path").alias("pointer"), (F.col("hop.to_type") == "Material").alias("ended"))
    )


def _double(chains: DataFrame, table: DataFrame, rows: int) -> DataFrame:
    """Let every open pointer skip ahead by what its target has already walked."""
    ahead = skew.bounded(
        table.select(
            F.col("vertex").alias("pointer"),
            F.col("pointer").alias("further"),
            F.col("hops").alias("more"),
            F.col("ended").alias("end"),
        ),
        rows,
    )
    return chains.join(ahead, "pointer", "left").select(
        "vertex",
        F.coalesce("further", "pointer").alias("pointer"),
        (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"),
        F.coalesce("end", F.lit(True)).alias("ended"),
    )


def _walk_to_end(chains: DataFrame, rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Pointer doubling: (finished, still open). What stays open leads into a loop."""
    table, _ = settle(chains)
    reached = 1
    while True:
        open_rows = table.where(~F.col("ended"))
        left = open_rows.count()
        if left == 0:
            return table, None
        if reached > rows:
            return table.where(F.col("ended")), open_rows
        moved = _double(open_rows, table, rows)
        table, _ = settle(table.where(F.col("ended")).unionByName(moved))
        reached *= 2


def material_chain(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(asset_path, chain_depth) of every material instance.

    Counts hops over instances until a Material, a missing parent, or a vertex already
    visited. Each instance has one next hop, so the distance is found by pointer doubling in
    a logarithmic number of rounds.
    """
    instances = nodes.where(F.col("asset_type") == "MaterialInstance").select("asset_path")
    hops, rows = settle(_parents(edges, nodes).withColumn("hops", F.lit(1).cast("bigint")))
    finished, looping = _walk_to_end(hops, rows)
    depth = finished.select(F.col("vertex").alias("asset_path"), F.col("hops").alias("chain_depth"))
    if looping is not None:
        depth = depth.unionByName(_loop_depths(hops, looping, rows))
    return instances.join(depth, "asset_path", "left").fillna(0, ["chain_depth"])


def _loop_depths(hops: DataFrame, looping: DataFrame, rows: int) -> DataFrame:
    """Depth for instances whose chain runs into a loop: way to the loop + loop length - 1."""
    # After more jumps than there are vertices every pointer rests on a loop, and all loop
    # vertices are pointed at.
    on_loop, _ = settle(looping.select(F.col("pointer").alias("vertex")).distinct())
    step = hops.select("vertex", F.col("pointer").alias("next"))
    ring = step.join(on_loop, "vertex", "left_semi").select(
        "vertex", F.col("next").alias("pointer"), F.least("vertex", "next").alias("label")
    )
    ring, count = settle(ring)
    reached = 1
    while reached <= count:
        ahead = ring.select(F.col("vertex").alias("pointer"), F.col("pointer").alias("p2"), F.col("label").alias("l2"))
        ring, _ = settle(
            ring.join(skew.bounded(ahead, count), "pointer").select(
                "vertex", F.col("p2").alias("pointer"), F.least("label", "l2").alias("label")
            )
        )
        reached *= 2
    lengths = ring.groupBy("label").agg(F.count(F.lit(1)).alias("length"))
    ring = skew.join_sized(
        ring.select("vertex", "label"), lengths, "label", "length", F.col("vertex"), total=count
    )
    # Walk the tails again, this time stopping at the first loop vertex.
    tails = (
        looping.select("vertex")
        .join(on_loop, "vertex", "left_anti")
        .join(step, "vertex")
        .join(on_loop.select(F.col("vertex").alias("next"), F.lit(True).alias("hit")), "next", "left")
        .select(
            "vertex",
            F.col("next").alias("pointer"),
            F.coalesce("hit", F.lit(False)).alias("ended"),
            F.lit(1).cast("bigint").alias("hops"),
        )
    )
    tails, _ = _walk_to_end(tails, rows)
    loop_length = ring.select(F.col("vertex").alias("pointer"), "length")
    tails = tails.join(loop_length, "pointer").select(
        F.col("vertex").alias("asset_path"), (F.col("hops") + F.col("length") - 1).alias("chain_depth")
    )
    return tails.unionByName(
        ring.select(F.col("vertex").alias("asset_path"), (F.col("length") - 1).alias("chain_depth"))
    )


def material_metrics(assets: DataFrame, samples: DataFrame, chains: DataFrame) -> DataFrame:
    """Texture samples for materials, chain depth for instances, no row for anything else."""
    kind = F.col("asset_type")
    return (
        assets.where(kind.isin("Material", "MaterialInstance"))
        .join(samples, "asset_path", "left")
        .join(chains, "asset_path", "left")
        .select(
            "asset_path",
            F.when(kind == "Material", F.coalesce("texture_sample_count", F.lit(0)))
            .otherwise(F.lit(0))
            .cast("bigint")
            .alias("texture_sample_count"),
            F.when(kind == "MaterialInstance", F.coalesce("chain_depth", F.lit(0)))
            .otherwise(F.lit(0))
            .cast("bigint")
            .alias("instance_chain_depth"),
        )
    )

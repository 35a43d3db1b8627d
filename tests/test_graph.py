import os
import random

import pytest
from pyspark.sql import functions as F

from stowage.functions import skew
from stowage.operators import graph
from stowage.session import working_folder


def paths_of(df, column="asset_path"):
    return sorted(r[column] for r in df.select(column).collect())


def cycles_of(edges, **layout):
    groups = {}
    for r in graph.cycle_members(graph.strong_components(edges, **layout)).collect():
        groups.setdefault(r.component, set()).add(r.asset_path)
        assert r.component == min(r.component, r.asset_path)
    return sorted(sorted(g) for g in groups.values())


@pytest.fixture(params=["broadcast", "shuffle"])
def layout(request, monkeypatch):
    """Run the loops on both of their physical paths; the second also splits hub vertices."""
    if request.param == "broadcast":
        return {}
    monkeypatch.setattr(skew, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(skew.bounded, "__defaults__", (-1,))
    monkeypatch.setattr(skew.join_sized, "__defaults__", (3, None))
    return {"broadcast_rows": -1, "hot_rows": 3}


def test_without_edges_every_vertex_is_unreferenced(make_assets, make_edges):
    assets = make_assets(("/Game/A", "Material"), ("/Game/B", "World"))
    edges = make_edges().limit(0)
    assert paths_of(graph.unreferenced(graph.vertices(assets, edges), edges)) == ["/Game/A", "/Game/B"]


def test_unreferenced_skips_engine_types_and_per_actor_files(make_assets, make_edges):
    assets = make_assets(
        ("/Game/A", "MetaData"), ("/Game/__ExternalActors__/B", "World"), ("/Game/C", "World"), ("/Game/D", "World")
    )
    edges = make_edges(("/Game/C", "/Game/D"), ("/Game/C", "/Game/C"))
    nodes = graph.vertices(assets, edges)
    # A self-reference keeps C alive.
    assert paths_of(graph.unreferenced(nodes, edges)) == []
    assert paths_of(graph.unreferenced(nodes, edges, excluded_types=())) == ["/Game/A"]
    assert len(paths_of(graph.unreferenced(nodes, edges, (), exclude_per_actor=False))) == 2


def test_unknown_ends_become_placeholders(make_assets, make_edges):
    assets = make_assets(("/Game/A", "World", 7))
    edges = make_edges(("/Game/A", "/Game/Gone"), ("/Game/Ghost", "/Game/A"))
    rows = {r.asset_path: r for r in graph.vertices(assets, edges).collect()}
    assert rows["/Game/Gone"].is_placeholder and rows["/Game/Gone"].file_size == 0
    assert not rows["/Game/A"].is_placeholder
    dead = graph.unreferenced(graph.vertices(assets, edges), edges)
    assert paths_of(dead) == ["/Game/Ghost"]


def test_external_roots_drop_edges_by_target_only(make_edges):
    edges = make_edges(("/Engine/X", "/Game/A"), ("/Game/A", "/Engine/X"), ("/Game/A", "/Script/Y"), ("/Game/A", "/Game/B", True))
    assert graph.internal_edges(edges).count() == 2
    assert graph.internal_edges(edges, include_soft=False).count() == 1


CYCLE_CASES = [
    ([("/A", "/B"), ("/B", "/A")], [["/A", "/B"]]),
    ([("/A", "/B"), ("/B", "/C"), ("/C", "/A")], [["/A", "/B", "/C"]]),
    ([("/A", "/B"), ("/B", "/A"), ("/C", "/D"), ("/D", "/C"), ("/B", "/C")], [["/A", "/B"], ["/C", "/D"]]),
    ([("/A", "/A")], []),
    ([("/A", "/B"), ("/B", "/C"), ("/A", "/C")], []),
    ([("/A", "/g/__ExternalActors__/B"), ("/g/__ExternalActors__/B", "/A"), ("/X", "/Y"), ("/Y", "/X")], [["/X", "/Y"]]),
]


@pytest.mark.parametrize("pairs,expected", CYCLE_CASES)
def test_cycles(make_edges, pairs, expected):
    assert cycles_of(make_edges(*pairs)) == expected


def reference_components(pairs):
    reach = {}
    nodes = {n for p in pairs for n in p}
    out = {n: {b for a, b in pairs if a == n} for n in nodes}
    for start in nodes:
        seen, stack = set(), list(out[start])
        while stack:
            n = stack.pop()
            if n not in seen:
                seen.add(n)
                stack += out[n]
        reach[start] = seen
    groups = {frozenset({n} | {m for m in reach[n] if n in reach[m]}) for n in nodes}
    return sorted(sorted(g) for g in groups if len(g) > 1)


@pytest.mark.parametrize("seed,vertices,edges", [(1, 12, 18), (2, 30, 34), (3, 40, 70)])
def test_cycles_match_brute_force_on_random_graphs(make_edges, layout, seed, vertices, edges):
    rng = random.Random(seed)
    pairs = list({(f"/v{rng.randrange(vertices)}", f"/v{rng.randrange(vertices)}") for _ in range(edges)})
    assert cycles_of(make_edges(*pairs), **layout) == reference_components(pairs)


def test_long_ring_with_tails(make_edges):
    ring = [(f"/r{i:03d}", f"/r{(i + 1) % 60:03d}") for i in range(60)]
    tails = [("/in1", "/in0"), ("/in0", "/r000"), ("/r030", "/out0"), ("/out0", "/out1")]
    assert cycles_of(make_edges(*ring, *tails)) == [sorted(a for a, _ in ring)]


def reference_depths(pairs, root):
    depth, level, seen = 0, {root}, {root}
    found = {}
    while level:
        depth += 1
        level = {a for a, b in pairs if b in level} - seen
        seen |= level
        found.update(dict.fromkeys(level, depth))
    return found


@pytest.mark.parametrize("seed", [5, 6])
def test_impact_matches_brute_force(spark, make_edges, layout, seed):
    rng = random.Random(seed)
    pairs = list({(f"/v{rng.randrange(25)}", f"/v{rng.randrange(25)}") for _ in range(45)})
    # A hub with many referrers.
    pairs += [(f"/h{i}", "/v1") for i in range(20)]
    targets = spark.createDataFrame([("/v1",), ("/v2",), ("/unknown",)], "asset_path string")
    got = {}
    for r in graph.impact(make_edges(*pairs), targets, **layout).collect():
        got.setdefault(r.target, {})[r.asset_path] = r.depth
        assert r.kind == ("direct" if r.depth == 1 else "transitive")
    expected = {t: reference_depths(pairs, t) for t in ("/v1", "/v2")}
    assert got == {t: d for t, d in expected.items() if d}


def test_impact_never_lists_the_target(spark, make_edges):
    targets = spark.createDataFrame([("/T",)], "asset_path string")
    edges = make_edges(("/X", "/Y"), ("/Y", "/T"), ("/T", "/X"))
    rows = sorted((r.asset_path, r.kind) for r in graph.impact(edges, targets).collect())
    assert rows == [("/X", "transitive"), ("/Y", "direct")]
    counts = graph.impact_counts(edges, targets.union(spark.createDataFrame([("/none",)], "asset_path string")))
    assert sorted(tuple(r) for r in counts.collect()) == [("/T", 1, 1), ("/none", 0, 0)]


def test_referrers_of_a_set_leave_out_targets_that_only_reach_themselves(spark, make_edges, layout):
    edges = make_edges(("/x", "/t"), ("/t", "/x"), ("/y", "/x"), ("/s", "/t"), ("/u", "/u"), ("/q", "/r"))
    targets = spark.createDataFrame([("/t",), ("/s",), ("/u",), ("/none",)], "asset_path string")
    got = sorted(r.asset_path for r in graph.referrers_of_any(edges, targets, **layout).collect())
    assert got == ["/s", "/x", "/y"]


def test_long_chain_passes_the_compaction_of_seen_vertices(spark, make_edges):
    edges = make_edges(*[(f"/c{i + 1:03d}", f"/c{i:03d}") for i in range(20)])
    targets = spark.createDataFrame([("/c000",)], "asset_path string")
    assert graph.impact(edges, targets).agg(F.max("depth")).first()[0] == 20


def test_closure_counts_shared_dependencies_once(make_assets, make_edges):
    assets = make_assets(("/r", "World", 1), ("/a", "X", 10), ("/b", "X", 100), ("/c", "X", 1000))
    edges = make_edges(("/r", "/a"), ("/r", "/b"), ("/a", "/c"), ("/b", "/c"), ("/c", "/r"))
    nodes = graph.vertices(assets, edges)
    roots = assets.where(F.col("asset_path") == "/r")
    assert tuple(graph.closure_stats(edges, nodes, roots).first()) == ("/r", 2, 1, 1111)


def tree(edges, roots, **options):
    rows = graph.reference_tree(edges, graph.strong_components(edges), roots, **options).collect()
    return {(r.root, r.parent, r.asset_path): (r.depth, r.is_cycle, r.hidden_children) for r in rows}


def test_hubs_are_split(make_assets, make_edges, layout):
    hot = layout.get("hot_rows", skew.HOT_ROWS)
    assets = make_assets(("/hub", "World", 7), ("/top", "World", 1), *[(f"/a{i}", "X", 10) for i in range(30)])
    edges = make_edges(*[(f"/a{i}", "/hub") for i in range(30)], ("/hub", "/top"), ("/a0", "/a1"))
    nodes = graph.vertices(assets, edges)
    roots = assets.where("asset_type = 'X'").select("asset_path")
    direct = graph.direct_dependencies(roots, edges, nodes, hot_rows=hot).collect()
    assert len(direct) == 31 and {r.dep_type for r in direct if r.dep_path == "/hub"} == {"World"}
    stats = {r.asset_path: tuple(r)[1:] for r in graph.closure_stats(edges, nodes, roots, **layout).collect()}
    assert stats["/a5"] == (1, 1, 18) and stats["/a0"] == (2, 1, 28) and len(stats) == 30


def test_trees_mark_cycles_and_hidden_children(make_assets, make_edges):
    edges = make_edges(("/a", "/b"), ("/b", "/a"), ("/b", "/c"), ("/c", "/d"), ("/d", "/d"))
    roots = make_assets(("/a", "World")).select("asset_path")
    two = {("/a", "/a", "/b"): (1, False, 0), ("/a", "/b", "/a"): (2, True, 0), ("/a", "/b", "/c"): (2, False, 1)}
    assert tree(edges, roots, max_depth=2) == two
    four = {("/a", "/c", "/d"): (3, False, 0), ("/a", "/d", "/d"): (4, True, 0)}
    assert tree(edges, roots) == {k: (d, c, 0) for k, (d, c, _) in two.items()} | four


def test_tree_of_a_long_chain_a_diamond_and_a_hub(make_assets, make_edges, layout):
    chain = [(f"/c{i:03d}", f"/c{i + 1:03d}") for i in range(150)]
    diamond = [("/r", "/x"), ("/r", "/y"), ("/x", "/z"), ("/y", "/z"), ("/z", "/w")]
    hub = [("/hub", f"/leaf{i}") for i in range(60)] + [("/r", "/hub")]
    edges = make_edges(*chain, *diamond, *hub)
    got = tree(edges, make_assets(("/c000", "World"), ("/r", "World")).select("asset_path"), **layout)
    assert len(got) == 150 + 5 + 61
    assert got[("/c000", "/c149", "/c150")] == (150, False, 0) and got[("/r", "/z", "/w")] == (3, False, 0)


def test_shortest_chain_breaks_ties_by_text(spark, make_edges):
    edges = make_edges(("/z", "/b"), ("/z", "/a"), ("/a", "/s"), ("/b", "/s"), ("/y", "/z"))
    pairs = spark.createDataFrame([("/s", "/y"), ("/y", "/s")], "source string, target string")
    assert [tuple(r) for r in graph.shortest_chains(edges, pairs).collect()] == [("/s", "/y", 3, "/s > /a > /z > /y")]


def chain_depths(make_assets, make_edges, assets, pairs):
    nodes_edges = make_edges(*pairs)
    nodes = graph.vertices(make_assets(*assets), nodes_edges)
    return {r.asset_path: r.chain_depth for r in graph.material_chain(nodes_edges, nodes).collect()}


def test_material_chain(make_assets, make_edges, layout):
    kind = "MaterialInstance"
    assets = [("/M", "Material"), ("/T", "Texture2D")] + [(f"/{n}", kind) for n in "abcdefgxyz"]
    pairs = [
        ("/c", "/b"), ("/b", "/a"), ("/a", "/M"),  # three hops
        ("/d", "/T"),  # no parent at all
        ("/e", "/f"), ("/f", "/e"), ("/g", "/e"),  # loop of two with a tail
        ("/x", "/x"),  # loop of one
        ("/y", "/z"),  # ends at an instance without a parent
    ]
    got = chain_depths(make_assets, make_edges, assets, pairs)
    assert got == {
        "/a": 1, "/b": 2, "/c": 3, "/d": 0, "/e": 1, "/f": 1, "/g": 2, "/x": 0, "/y": 1, "/z": 0,
    }


def test_long_material_chain(make_assets, make_edges):
    assets = [("/M", "Material")] + [(f"/i{n:02d}", "MaterialInstance") for n in range(30)]
    pairs = [("/i00", "/M")] + [(f"/i{n + 1:02d}", f"/i{n:02d}") for n in range(29)]
    got = chain_depths(make_assets, make_edges, assets, pairs)
    assert got == {f"/i{n:02d}": n + 1 for n in range(30)}


def test_new_cycles_compare_exact_member_sets(make_edges):
    def members(*pairs):
        return graph.cycle_members(graph.strong_components(make_edges(*pairs)))

    before = members(("/a", "/b"), ("/b", "/a"), ("/x", "/y"), ("/y", "/x"))
    after = members(("/a", "/b"), ("/b", "/c"), ("/c", "/a"), ("/x", "/y"), ("/y", "/x"), ("/p", "/q"), ("/q", "/p"))
    assert sorted(tuple(r) for r in graph.new_cycles(before, after).collect()) == [("/a", 3), ("/p", 2)]


def test_loops_leave_only_their_result(spark, make_edges, layout):
    def settled():
        folder = working_folder(spark).removeprefix("file:")
        return {name for name in os.listdir(folder) if name.startswith("settled-")} if os.path.isdir(folder) else set()

    before = settled()
    pairs = [(f"/a{i}", f"/a{(i + 1) % 40}") for i in range(40)] + [(f"/t{i}", f"/t{i + 1}") for i in range(9)]
    members = graph.strong_components(make_edges(*pairs, ("/x", "/y"), ("/y", "/x"), ("/a3", "/x")), **layout)
    assert members.count() == 42
    assert len(settled() - before) == 1


def test_soft_cycles_need_a_soft_edge_inside(make_edges):
    edges = make_edges(("/a", "/b"), ("/b", "/a", True), ("/x", "/y"), ("/y", "/x"), ("/a", "/x", True))
    rows = graph.soft_cycles(graph.strong_components(edges), edges).collect()
    assert [(r.component, r.size, r.soft_edges) for r in rows] == [("/a", 2, 1)]


def test_material_metrics(spark, make_assets):
    assets = make_assets(("/M", "Material"), ("/I", "MaterialInstance"), ("/T", "Texture2D"))
    samples = spark.createDataFrame([("/M", 4)], "asset_path string, texture_sample_count bigint")
    chains = spark.createDataFrame([("/I", 2)], "asset_path string, chain_depth bigint")
    rows = sorted(tuple(r) for r in graph.material_metrics(assets, samples, chains).collect())
    assert rows == [("/I", 0, 2), ("/M", 4, 0)]

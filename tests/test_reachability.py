"""Bit-parallel walks against plain Python, with roots in several batches."""

import random

import pytest

from stowage.functions import skew
from stowage.operators import graph, reachability


def below(pairs, root, seen=None):
    """{vertex: least depth} of what `root` reaches, itself left out."""
    depth, level, found = 0, {root}, {root: 0}
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    while level:
        depth += 1
        level = {b for a in level for b in out.get(a, ())} - found.keys()
        found |= dict.fromkeys(level, depth)
    return {v: d for v, d in found.items() if v != root}


@pytest.fixture(scope="module")
def case(spark):
    """Two hundred roots over shared hubs, rings, self-references and doubled edges."""
    rng = random.Random(11)
    pairs = [(f"/r{i}", f"/h{rng.randrange(6)}") for i in range(200)] + [(f"/h{i}", f"/h{(i + 1) % 3}") for i in range(6)]
    pairs += [(f"/v{rng.randrange(40)}", f"/v{rng.randrange(40)}") for _ in range(50)] + [("/h5", "/v1"), ("/r0", "/r1"), ("/r7", "/r7")]
    rows = [(a, b, False) for a, b in pairs + pairs[:20]]
    edges = spark.createDataFrame(rows, "from_path string, to_path string, is_soft boolean")
    names = sorted({n for p in pairs for n in p})
    nodes = spark.createDataFrame([(n, len(n) * 10) for n in names], "asset_path string, file_size bigint")
    members = graph.strong_components(edges)
    return pairs, names, edges, nodes, reachability.build(edges, nodes, members)


@pytest.mark.parametrize("layout", [{}, {"broadcast_rows": -1, "hot_rows": 3}])
def test_counts_and_levels_match_plain_walks(spark, monkeypatch, case, layout):
    pairs, names, edges, nodes, index = case
    if layout:
        monkeypatch.setattr(skew.bounded, "__defaults__", (-1,))
    roots = spark.createDataFrame([(n,) for n in [*names, "/nowhere", names[0]]], "asset_path string")
    got = {r.asset_path: tuple(r)[1:] for r in graph.closure_stats(edges, nodes, roots, index, **layout).collect()}
    want = {}
    for name in names:
        found = below(pairs, name)
        sizes = len(name) * 10 + sum(len(v) * 10 for v in found)
        want[name] = (sum(d == 1 for d in found.values()), sum(d > 1 for d in found.values()), sizes)
    assert got == want | {"/nowhere": (0, 0, 0)}
    back = [(b, a) for a, b in pairs]
    hit = {}
    for r in graph.impact(edges, roots, index, **layout).collect():
        hit.setdefault(r.target, {})[r.asset_path] = r.depth
    assert hit == {name: found for name in names if (found := below(back, name))}


def test_roots_over_one_hub_share_rows(spark, case):
    """A batch of 64 roots has one row per vertex, so state grows with edges and batches, not with pairs."""
    rows = [(f"/r{i:05d}", "/hub", False) for i in range(10_000)] + [("/hub", f"/leaf{i}", False) for i in range(50)]
    index = reachability.build(spark.createDataFrame(rows, "from_path string, to_path string, is_soft boolean"))
    roots = index.ids.where("asset_path like '/r%'").select("vertex", "members", "bytes", "out_near")
    bits, n = reachability.batched(roots.withColumnRenamed("out_near", "near"))
    levels = reachability.spread(graph.Adjacency(index.dag, "src", "dst"), reachability._seeds(bits), n)
    batches = bits.select("batch").distinct().count()
    assert n == 10_000 and batches <= 10_000 // 64 + 8
    assert [level.count() for level in levels[1:]] == [batches, batches * 50]


def test_chains_between_pairs_and_sets(spark, case):
    pairs, names, edges, _, index = case
    back = [(b, a) for a, b in pairs]

    def smallest(source, goal):
        chains = [[source]]
        for _ in range(below(back, source).get(goal, 0)):
            chains = [[*c, b] for c in chains for a, b in set(back) if a == c[-1] and b not in c]
        return min((" > ".join(c) for c in chains if c[-1] == goal and len(c) > 1), default=None)

    asked = [("/h1", "/r3"), ("/v1", "/r9"), ("/h0", "/h5"), ("/r3", "/h1"), ("/h2", "/h2"), ("/v3", "/v9"), ("/v9", "/v3")]
    found = graph.shortest_chains(edges, spark.createDataFrame(asked, "source string, target string"), index).collect()
    got = {(r.source, r.target): (r.hops, r.chain) for r in found}
    want = {(a, b): (chain.count(" > "), chain) for a, b in asked if a != b and (chain := smallest(a, b))}
    assert got == want and len(want) >= 2
    sets = graph.shortest_chains_to(
        edges, spark.createDataFrame([("/v1",), ("/h4",)], "source string"), spark.createDataFrame([(n,) for n in names], "asset_path string"), index
    )
    got = {(r.source, r.target): r.chain for r in sets.collect()}
    assert got == {(s, g): smallest(s, g) for s in ("/v1", "/h4") for g in below(back, s)}


def hashed(edges, nodes):
    vertices, members = graph.analysed(nodes.withColumn("asset_type", nodes.asset_path), edges.distinct()), graph.strong_components(edges)
    assert reachability.tells_apart(vertices) and not reachability.tells_apart(vertices.union(vertices.where("asset_path = '/h1'")))
    edges = edges.distinct()
    ids = reachability.hashed_ids(vertices, members, edges)
    return reachability.hashed(ids, reachability.hashed_arcs(edges, members), edges)


@pytest.mark.parametrize("layout", [{}, {"broadcast_rows": -1, "hot_rows": 3}])
def test_hashed_vertices_match_plain_walks(spark, monkeypatch, case, layout):
    pairs, names, edges, nodes, _ = case
    if layout:
        monkeypatch.setattr(skew.bounded, "__defaults__", (-1,))
    odd = spark.createDataFrame([(None, "/h1", False), (None, "/v1", True), ("/h2", "/h2", False)], edges.schema)
    index = hashed(edges.unionByName(odd), nodes)
    roots = spark.createDataFrame([(n,) for n in [*names, "/nowhere", names[0]]], "asset_path string")
    got = {r.asset_path: tuple(r)[1:] for r in graph.closure_stats(edges, nodes, roots, index, **layout).collect()}
    back = [(b, a) for a, b in pairs]
    above = {r.asset_path: tuple(r)[1:] for r in graph.impact_counts(edges, roots, index, **layout).collect()}
    want, want_above = {}, {}
    for name in names:
        found, referrers = below(pairs, name), below(back, name).values()
        sizes = len(name) * 10 + sum(len(v) * 10 for v in found)
        want[name] = (sum(d == 1 for d in found.values()), sum(d > 1 for d in found.values()), sizes)
        want_above[name] = (sum(d == 1 for d in referrers), sum(d > 1 for d in referrers))
    assert got == want | {"/nowhere": (0, 0, 0)} and above == want_above | {"/nowhere": (0, 0)}
    hit = {}
    for r in graph.impact(edges, roots, index, **layout).collect():
        hit.setdefault(r.target, {})[r.asset_path] = r.depth
    assert hit == {name: found for name in names if (found := below(back, name))}


def test_a_round_shuffles_what_it_steps_to_and_not_what_is_known(spark, monkeypatch):
    rows = [(f"/a{i}", f"/a{i + 1}", False) for i in range(4)]
    index = reachability.build(spark.createDataFrame(rows, "from_path string, to_path string, is_soft boolean"))
    shuffles, settled = [], reachability.settle_laid_out

    def watched(df, *keys):
        shuffles.append(df._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression"))
        plan = df._jdf.queryExecution().executedPlan().toString()
        shuffles[-1] = max(shuffles[-1], plan.count("hashpartitioning(vertex") - plan.count("__part"))
        return settled(df, *keys)

    monkeypatch.setattr(reachability, "settle_laid_out", watched)
    roots = spark.createDataFrame([("/a4",)], "asset_path string")
    found = reachability.levels(index, roots, reverse=True, broadcast_rows=-1).collect()
    assert sorted(r.depth for r in found) == [1, 2, 3, 4]
    assert len(shuffles) == 6 and set(shuffles) == {1}

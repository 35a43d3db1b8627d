"""Stored references are not shuffled again, and numbers of the graph come from one pass over them."""

import os

import pytest
from pyspark.sql import functions as F

from stowage.functions import skew
from stowage.operators import graph, reachability
from stowage.operators.walks import Adjacency, edges_reached
from stowage.plans import derived
from stowage.plans.catalogue import Catalogue
from stowage.plans.queries import QUERIES
from stowage.session import kept_buckets, settle_distinct, settle_partitioned


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_settled_partitions_serve_groupings_and_joins(spark, make_edges):
    names = {t.name for t in spark.catalog.listTables()}
    kept = settle_partitioned(make_edges(("/a", "/b"), ("/a", "/c"), ("/b", "/c"), (None, "/c")), "from_path")
    counts = kept.groupBy("from_path", "to_path").agg(F.count(F.lit(1)).alias("n"))
    assert "Exchange" not in plan(counts) and counts.count() == 4
    assert {t.name for t in spark.catalog.listTables()} == names
    pairs, rows = settle_distinct(kept.select("from_path", "to_path").union(kept.select("from_path", "to_path")))
    assert rows == 4 and "Exchange" not in plan(pairs.distinct())


def test_large_tables_are_read_from_the_store():
    assert derived.stored_parts("prev_deps") == ["deps"]
    assert derived.stored_parts("prev_metrics") == ["blueprint_metrics"]
    assert derived.stored_parts("deps") == []


def test_analysed_vertices_are_vertices_with_degrees(make_assets, make_edges):
    assets = make_assets(("/a", "T", 3), ("/a", None, 4), ("/b", "T", 5)).union(
        make_assets(("/x", "T", 1)).withColumn("asset_path", F.lit(None).cast("string"))
    )
    edges = make_edges(("/a", "/b"), ("/a", "/a"), ("/u", "/b"), ("/b", "/w"), (None, "/a"), (None, "/b"))
    rows = lambda df: sorted(map(repr, map(tuple, df.collect())))
    got = graph.analysed(assets, edges)
    want = graph.degrees(graph.vertices(assets, edges), edges)
    assert rows(got) == rows(want.select(*got.columns))


def test_links_of_a_cycle_are_one_bridge(spark, make_edges):
    edges = make_edges(("/a", "/b"), ("/b", "/a"), ("/a", "/x"), ("/b", "/x"), ("/y", "/b"), ("/y", "/a"), ("/y", "/x"))
    index = reachability.build(edges, members=graph.strong_components(edges))
    number = {r.asset_path: r.vertex for r in index.ids.collect()}
    got = sorted((r.src, r.dst, r.src_members, r.dst_members) for r in index.dag.collect())
    a, x, y = (number[n] for n in ("/a", "/x", "/y"))
    assert got == sorted([(a, x, 2, 1), (y, a, 1, 2), (y, x, 1, 1)])


@pytest.mark.parametrize("limit", [500_000, -1])
def test_every_edge_is_reached_once_and_knows_whether_its_end_was_met(spark, make_edges, limit):
    edges = make_edges(("/r", "/a"), ("/r", "/b"), ("/a", "/b"), ("/b", "/c"), ("/c", "/a"), ("/c", "/r"))
    adjacency = Adjacency(edges, "from_path", "to_path", broadcast_rows=limit)
    levels = edges_reached(adjacency, spark.createDataFrame([("/r",)], "root string"))
    got = [sorted((r.parent, r.vertex, r.met) for r in level.collect()) for level in levels]
    assert got == [
        [("/r", "/a", False), ("/r", "/b", False)],
        [("/a", "/b", True), ("/b", "/c", False)],
        [("/c", "/a", True), ("/c", "/r", True)],
    ]


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    """A few rows of each given table."""
    folder = tmp_path_factory.mktemp("given")
    rows = {
        "region": [(0,)],
        "nation": [(n, 0) for n in range(3)],
        "customer": [(c, c % 3, "AUTOMOBILE") for c in range(9)],
        "supplier": [(s,) for s in range(12)],
        "part": [(p, f"red part{p}", f"Brand#{p % 3}", "LARGE", p % 50) for p in range(120)],
        "orders": [(o, o % 9, "OF"[o % 2]) for o in range(60)],
        "lineitem": [(o, (7 * o + n) % 120, n) for o in range(60) for n in range(1, 6)],
        "events": [],
    }
    for name, table in rows.items():
        spark.createDataFrame(table, derived.BASE_TABLES[name]).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["regressions", "baseline_resolved", "regression_gate"])
def test_comparing_errors_stores_no_references(spark, given, name):
    cat = Catalogue.derive(spark, given)
    rows = QUERIES[name](cat).collect()
    assert rows and not {"deps", "prev_deps"} & set(os.listdir(cat._store.removeprefix("file:")))
    stored = Catalogue.derive(spark, given)
    assert stored.prev_deps.count() and stored.edges.count()
    assert sorted(map(repr, QUERIES[name](stored).collect())) == sorted(map(repr, rows))
    # Whoever reads what is not stored gets the rows that would be.
    for view in ("prev_deps", "edges"):
        ours, theirs = (sorted(map(repr, df.collect())) for df in (cat.unstored(view), stored.table(view)))
        assert ours == theirs


def test_former_references_stay_in_the_buckets_of_the_present_ones(spark, given):
    cat = Catalogue.derive(spark, given)
    assert cat.deps.count()
    parts = cat._partitions()
    with kept_buckets(spark):
        assert "Exchange" not in plan(cat._laid_out("prev_deps", parts))
    lost = cat.deps.join(cat.prev_deps.hint("merge"), ["from_path", "to_path"], "left_anti")
    assert "Exchange" not in plan(lost)
    plain = derived.load(spark, given, "prev_deps")
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(cat.prev_deps) == rows(plain)
    assert rows(lost) == rows(derived.load(spark, given, "deps").join(plain, ["from_path", "to_path"], "left_anti"))


def test_group_sizes_are_computed_once(spark, make_edges):
    edges = make_edges(("/a", "/h"), ("/b", "/h"), ("/c", "/h"), ("/a", "/x"))
    calls = spark.sparkContext.accumulator(0)

    def counted(path):
        calls.add(1)
        return path

    sizes = edges.groupBy("to_path").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("seen", F.udf(counted, "string")("to_path"))
    joined = skew.join_sized(edges.select("from_path", "to_path"), sizes, "to_path", "n", F.col("from_path"), hot_rows=2)
    got = sorted((r.from_path, r.to_path, r.n, r.seen) for r in joined.collect())
    assert got == [("/a", "/h", 3, "/h"), ("/a", "/x", 1, "/x"), ("/b", "/h", 3, "/h"), ("/c", "/h", 3, "/h")]
    assert calls.value == 2


def test_stored_references_are_not_shuffled_to_a_few_wanted_paths(spark, given):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(3 * spark.sparkContext.defaultParallelism))
    try:
        cat = Catalogue.derive(spark, given)
        wanted = cat.assets.select(F.col("asset_path").alias("from_path")).distinct().hint("merge")
        found = cat.deps.join(wanted, "from_path", "left_semi")
        assert plan(found).split("Initial Plan")[0].count("Exchange") == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("name", ["cycle_key", "check_results", "check_violations"])
def test_cycles_and_checks_store_no_references(spark, given, name):
    rows = lambda df: sorted(map(repr, df.collect()))
    cat = Catalogue.derive(spark, given)
    found = rows(QUERIES[name](cat))
    assert found and not {"deps", "nodes"} & set(os.listdir(cat._store.removeprefix("file:")))
    stored = Catalogue.derive(spark, given)
    assert stored.nodes.count() and stored.edges.count()
    assert rows(QUERIES[name](stored)) == found


def test_vertices_that_nothing_points_at(make_assets, make_edges):
    assets = make_assets(("/a", "T", 3), ("/a", None, 4), ("/b", "T", 5), ("/c", "T", 6))
    edges = make_edges(("/a", "/b"), ("/a", "/b"), ("/u", "/b"), ("/b", "/w"), ("/c", "/c"), (None, "/b"))
    rows = lambda df: sorted(map(repr, df.collect()))
    got = graph.unreferenced(graph.starts(assets, edges, graph.pointed_at(edges)), edges)
    assert rows(got) == rows(graph.unreferenced(graph.vertices(assets, edges), edges)) and got.count() == 2


def test_a_screen_keeps_every_key_and_little_else(spark):
    rows = spark.range(20_000).selectExpr("concat('/p', id) AS path", "id")
    keys = rows.where("id % 100 = 7").selectExpr("path AS key")
    kept = {r.id for r in skew.screened(rows, "path", keys, "key", 200).collect()}
    assert kept >= {i for i in range(20_000) if i % 100 == 7} and len(kept) < 2_000
    none = keys.limit(0)
    assert skew.screened(rows, "path", none, "key", 0).count() == 0

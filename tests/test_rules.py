import json

import pytest
from pyspark.sql import functions as F

from stowage.functions import paths
from stowage.operators import checks, compare, duplicates, rules, stats, tables
from stowage.operators.checks import CheckConfig
from stowage.operators.rules import LintConfig, Thresholds
from stowage.sources import inventory


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "pattern,crossing,path,expected",
    [
        ("Content/*.uasset", True, "Content/A.uasset", True),
        ("Content/*.uasset", True, "Content/B/A.uasset", False),
        ("Content/*.uasset", False, "Content/B/A.uasset", True),
        ("Content/**/A.uasset", True, "Content/A.uasset", True),
        ("Content/**/A.uasset", True, "Content/x/y/A.uasset", True),
        ("**/A.uasset", True, "A.uasset", True),
        ("Content/**", True, "Content/x/y", True),
        ("Content/?", True, "Content/x", True),
        ("Content/?", True, "Content//", False),
        ("Content/[!ab]x", True, "Content/cx", True),
        ("Content/[ab]x", True, "Content/cx", False),
        ("Content/{A,B}.umap", True, "Content/B.umap", True),
        ("Content/A.umap", True, "Content/Axumap", False),
    ],
)
def test_globs(spark, pattern, crossing, path, expected):
    assert one(spark, path, lambda c: paths.matches_glob(c, pattern, star_stops_at_slash=crossing)) is expected


@pytest.mark.parametrize(
    "path,expected",
    [("/Game/A/B/C/D", "/Game/A/B/"), ("/Game/A/B", "/Game/A/"), ("/Game/A", "/Game/A"), ("/Game/A/B/C", "/Game/A/B/")],
)
def test_folder_bucket(spark, path, expected):
    assert one(spark, path, paths.folder_bucket) == expected


@pytest.mark.parametrize(
    "size,expected",
    [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1536, "1.5 KB"), (1310720, "1.2 MB"), (1835008, "1.8 MB"), (10**12, "953674.3 MB")],
)
def test_sizes_round_ties_to_even(spark, size, expected):
    frame = spark.createDataFrame([(size,)], "v bigint").select(paths.format_size(F.col("v")).alias("r"))
    assert frame.first().r == expected


def test_path_functions(spark):
    assert one(spark, "/Game/A/B.C.D", paths.package_name) == "/Game/A/B"
    assert one(spark, "/Game/A.x/B", paths.package_name) == "/Game/A.x/B"
    assert one(spark, "", paths.is_valid_asset_path) is False
    assert one(spark, "/p/Content/A/B.v2.uasset", lambda c: paths.asset_path_of_file(c, "/p/Content")) == "/Game/A/B.v2"
    assert one(spark, "/q/A.uasset", lambda c: paths.asset_path_of_file(c, "/p/Content")) is None
    clamp = spark.createDataFrame([(1 << 60,)], "v bigint").select(paths.format_rfc3339(F.col("v")).alias("r"))
    assert clamp.first().r == "9999-12-31T23:59:59Z"


def test_ignore_rules_last_match_wins(spark):
    parsed = inventory.parse_ignore_lines(["# c", "", "Content/Dev", "! Content/Dev/Keep", "**/x.uasset"])
    assert [(r.pattern, r.negate) for r in parsed] == [("Content/Dev", False), ("Content/Dev/Keep", True), ("**/x.uasset", False)]
    rule = inventory.ScanRules(ignore=parsed).ignored
    got = [one(spark, p, rule) for p in ("Content/Dev/A", "Content/Dev/Keep/A", "Content/Dev/Keep/x.uasset", "Content/B")]
    assert got == [True, False, True, False]


def test_budget_boundary_and_default_merge(make_assets):
    limit = 4 * 1024 * 1024
    assets = make_assets(("/Game/a", "Texture2D", limit), ("/Game/b", "Texture2D", limit + 1), ("/Game/c", "World", 10))
    over = rules.over_budget(assets, rules.effective_budgets({"World": 9}))
    assert sorted(r.asset_path for r in over.collect()) == ["/Game/b", "/Game/c"]
    assert rules.over_budget(assets, {}).count() == 0


def test_complexity_limits_are_exclusive_and_depth_can_differ_by_type(spark, make_assets):
    assets = make_assets(("/Game/a", "Blueprint"), ("/Game/b", "AnimBlueprint"))
    metrics = spark.createDataFrame(
        [("/Game/a", 200, 1, 10, 21), ("/Game/b", 201, 2, 11, 21)],
        "asset_path string, node_count bigint, event_tick_count bigint, cast_count bigint, dependency_depth bigint",
    )
    config = LintConfig(thresholds=Thresholds(), depth_by_type={"AnimBlueprint": 30})
    rows = sorted((r.asset_path, r.rule, r.message) for r in rules.complexity(assets, metrics, config).collect())
    assert rows == [
        ("/Game/a", "blueprint/dependency-depth", "dependency depth 21 exceeds limit 20"),
        ("/Game/b", "blueprint/cast-count", "cast count 11 exceeds limit 10"),
        ("/Game/b", "blueprint/event-tick", "event tick count 2 exceeds limit 1"),
        ("/Game/b", "blueprint/node-count", "node count 201 exceeds limit 200"),
    ]


def test_naming_messages(make_assets):
    assets = make_assets(("/Game/Rock", "SkeletalMesh"), ("/Game/SK_Rock", "SkeletalMesh"), ("/Game/X", "Strange"))
    rows = [r.message for r in rules.naming(assets, None, LintConfig()).collect()]
    assert rows == ["asset `Rock` should start with one of: `SKM_`, `SK_`"]


@pytest.mark.parametrize("hot_rows", [1_000_000, 2])
def test_duplicates(make_assets, hot_rows):
    assets = make_assets(
        ("/Game/a/T_X", "Texture2D", 5), ("/Game/b/T_X", "Texture2D", 5), ("/Game/c/T_X", "World", 9),
        ("/Game/a/T_X2", "Texture2D", 5), ("/Game/d/T_X2", "Texture2D", 6), ("/Game/e/T_X2", "World", 1),
        ("/Game/f/T_X", "Texture2D", 7), ("/Game/g/T_X", "Texture2D", 7),
    )
    members = duplicates.same_name_members(assets, hot_rows)
    assert sorted((r.name, r.copies) for r in members.collect()) == [("T_X", 5)] * 5 + [("T_X2", 3)] * 3
    textures = duplicates.texture_members(assets, hot_rows)
    assert sorted((r.each_bytes, r.copies, r.asset_path) for r in textures.collect()) == [
        (5, 2, "/Game/a/T_X"), (5, 2, "/Game/b/T_X"), (7, 2, "/Game/f/T_X"), (7, 2, "/Game/g/T_X"),
    ]
    # One name gives two texture groups and hides its same-name group.
    report = sorted((r.kind, r.name, r.copies, r.shared_type) for r in duplicates.report(assets).collect())
    assert report == [("same-name", "T_X2", 3, None), ("texture-dup", "T_X", 2, "Texture2D"), ("texture-dup", "T_X", 2, "Texture2D")]


def test_positions_number_all_rows_in_order(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 10).alias("v"), F.col("id").cast("string").alias("p"))
    got = [(r.rank, r.v, r.p) for r in stats.positions(rows, F.desc("v"), F.asc("p")).orderBy("rank").collect()]
    want = sorted(((r.v, r.p) for r in rows.collect()), key=lambda r: (-r[0], r[1]))
    assert got == [(n + 1, *r) for n, r in enumerate(want)]


def test_size_growth(make_assets):
    old = make_assets(("/a", "X", 100), ("/b", "X", 100), ("/c", "X", 0), ("/d", "X", 100))
    new = make_assets(("/a", "X", 110), ("/b", "X", 109), ("/c", "X", 50), ("/d", "X", 10))
    assert [(r.asset_path, r.pct_increase) for r in compare.size_increases(old, new).collect()] == [("/a", 10)]
    assert compare.size_increases(old, new, 0).count() == 3


def violations(spark, *rows):
    return spark.createDataFrame(
        [("lint", s, r, p, "m") for s, r, p in rows],
        "check string, severity string, rule string, asset_path string, message string",
    )


def test_regressions_compare_errors_only(spark):
    before = violations(spark, ("error", "r", "/a"), ("warn", "r", "/b"))
    now = violations(spark, ("error", "r", "/a"), ("error", "r", "/b"), ("warn", "r", "/c"))
    assert [r.asset_path for r in checks.regressions(before, now).collect()] == ["/b"]
    assert checks.resolved(now, before).count() == 1
    assert tuple(checks.regression_gate(before, now).first()) == (1, False)


def test_check_selection():
    assert CheckConfig(only=("lint", "cycles"), skip=("lint",)).active() == ["cycles"]
    assert "dead-assets" not in CheckConfig(severity={"dead-assets": "off"}).active()
    with pytest.raises(ValueError):
        CheckConfig(only=("nonsense",)).active()


def test_lint_result_is_a_warning_without_errors(spark, make_assets, make_edges):
    assets = make_assets(("/Game/Rock", "Texture2D"), ("/Game/L", "World"))
    edges = make_edges(("/Game/L", "/Game/Rock"))
    metrics = spark.createDataFrame([], "asset_path string, node_count bigint, event_tick_count bigint, cast_count bigint, dependency_depth bigint")
    found = checks.violations(assets, edges, metrics)
    rows = {r.check: (r.severity, r.finding_count, r.passed) for r in checks.results(found).collect()}
    assert rows["lint"] == ("warn", 1, False)
    assert rows["cycles"] == ("error", 0, True)
    assert rows["dead-assets"] == ("warn", 1, False)
    verdicts = {r.fail_on: r.passed for r in checks.gate(checks.results(found)).collect()}
    assert verdicts == {"error": True, "warn": False, "never": True}


def test_sarif_rows(spark, make_assets):
    found = violations(spark, ("error", "r", "/Game/A"), ("warn", "d", "group"))
    rows = checks.sarif_results(found, make_assets(("/Game/A", "World")))
    documents = sorted((json.loads(r.value) for r in checks.sarif_json(rows).collect()), key=lambda d: d["ruleId"])
    assert documents[0]["locations"] == [] and documents[0]["level"] == "warning"
    place = documents[1]["locations"][0]["physicalLocation"]["artifactLocation"]
    assert place == {"uri": "Content/A.uasset", "uriBaseId": "%SRCROOT%"}
    assert [r.rule_id for r in checks.sarif_rules(rows).collect()] == ["d", "r"]


def test_empty_catalogue_snapshot(spark, make_assets):
    metrics = spark.createDataFrame([], "asset_path string, node_count bigint")
    row = tables.scan_snapshot(make_assets(("/a", "X")).limit(0), metrics).first()
    assert (row.asset_count, row.total_size, row.avg_node_count) == (0, 0, 0.0)


def test_baseline_is_overwritten_by_name(spark):
    saved = spark.createDataFrame([("main", 1, 10), ("b", 2, 20)], "name string, snapshot_id bigint, saved_at bigint")
    assert sorted(tuple(r) for r in tables.save_baseline(saved, "main", 7, 70).collect()) == [("b", 2, 20), ("main", 7, 70)]


def test_ingest_delta_ignores_failed_files(spark):
    disk = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "file_path string, mtime bigint")
    index = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("z", 1)], "file_path string, last_modified bigint")
    failed = spark.createDataFrame([("c",), ("d",)], "file_path string")
    assert tuple(inventory.ingest_delta(disk, index, failed).first()) == (0, 1, 1, 1, 3)


def test_metadata_rules_of_all_kinds(spark):
    def hits(columns, rows, own):
        table = spark.createDataFrame(rows, f"asset_path string, {columns}")
        return sorted((r.asset_path, r.severity, r.rule.rsplit("/", 1)[1]) for r in rules.metadata_lint(table, own).collect())

    skeletal = "lod_count int, bone_count int, triangle_count_lod0 int, has_morph_targets boolean"
    assert hits(skeletal, [("/a", 1, 257, 20001, True), ("/b", 1, 256, 5000, True), ("/c", None, None, None, None)], rules.SKELETAL_MESH_RULES) == [
        ("/a", "warn", "excess-bones"), ("/a", "warn", "high-poly-morph"), ("/a", "warn", "no-lod"),
    ]
    effects = "emitter_count int, has_gpu_simulation boolean, has_lights boolean"
    assert hits(effects, [("/a", 11, True, True), ("/b", 10, True, False), ("/c", 1, None, True)], rules.EFFECT_RULES) == [
        ("/a", "warn", "gpu-sim-with-lights"), ("/a", "warn", "many-emitters"),
    ]
    widgets = "widget_depth int, animation_count int"
    assert hits(widgets, [("/a", 9, 20), ("/b", 8, 21), ("/c", None, None)], rules.WIDGET_RULES) == [
        ("/a", "warn", "deep-hierarchy"), ("/b", "warn", "many-animations"),
    ]
    meshes = "lod_count int, triangle_count_lod0 int, lightmap_resolution int, has_collision boolean, has_nanite boolean"
    assert hits(meshes, [("/a", 2, 99999, 512, True, True), ("/b", 1, 10001, 513, False, False)], rules.STATIC_MESH_RULES) == [
        ("/a", "info", "nanite-no-lod"), ("/b", "warn", "high-lightmap-res"), ("/b", "warn", "no-collision"), ("/b", "warn", "no-lod"),
    ]

"""Every operator as a named query over a catalogue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.functions import paths
from stowage.operators import checks, compare, duplicates, find, graph, rules, stats, tables
from stowage.operators.checks import CheckConfig
from stowage.operators.rules import LintConfig, Thresholds
from stowage.plans.catalogue import Catalogue
from stowage.sources import inventory
from stowage.streaming import changes

Query = Callable[[Catalogue], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters of the registered queries. The oracle repeats them in SQL.
MIB = 1024 * 1024
SCAN_RULES = inventory.ScanRules(
    exclude_paths=["Content/Parts/Brand_1", "Content/Maps/", "Content/Parts/Brand_2?/**", "**/T_red_*.uasset"],
    ignore=inventory.parse_ignore_lines(
        [
            "# generated folders",
            "Content/Parts/Brand_1",
            "!Content/Parts/Brand_12/",
            "Content/Parts/*/P1*/*.uasset",
            "!**/T_blue_*",
        ]
    ),
)
CONFIGURED_BUDGETS = {"StaticMesh": 8 * MIB}
CHECK_BUDGETS = {"Texture2D": 4 * MIB, "StaticMesh": 8 * MIB}
OVERRIDES = LintConfig(
    naming_severity=rules.ERROR,
    blueprint_severity=rules.WARN,
    thresholds=Thresholds(node_count=100, event_tick_count=2, cast_count=12, dependency_depth=20),
    depth_by_type={"Blueprint": 15},
).with_prefixes({"StaticMesh": "T_", "MaterialFunction": "MF_", "SoundWave": "A_"})
NOW = 1707000000


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def of_type(cat: Catalogue, *kinds: str) -> DataFrame:
    return cat.assets.where(F.col("asset_type").isin(*kinds)).select("asset_path")


# ---------------------------------------------------------------- ingest and tables


@query
def exclude_prefix(cat):
    rule = inventory.ScanRules(exclude_paths=["Content/Parts/Brand_1", "Content/Maps/"])
    return inventory.taken(cat.disk_files, rule)


@query
def exclude_glob(cat):
    rule = inventory.ScanRules(exclude_paths=["Content/Parts/Brand_2?/**", "**/T_red_*.uasset"])
    return inventory.taken(cat.disk_files, rule)


@query
def ignore_rules(cat):
    return cat.disk_files.select("file_path", SCAN_RULES.ignored(F.col("file_path")).alias("ignored"))


@query
def ingest_plan(cat):
    return inventory.ingest_plan(cat.disk_files, SCAN_RULES).select("file_path", "status", "excluded_by")


@query
def changed_files(cat):
    return inventory.changed_files(cat.disk_files, cat.index_files)


@query
def stale_assets(cat):
    return inventory.stale_files(cat.disk_files, cat.index_files).select("file_path")


@query
def ingest_delta_counts(cat):
    return inventory.ingest_delta(cat.disk_files, cat.index_files)


@query
def path_convert(cat):
    from_files = cat.disk_files.select(
        "file_path", paths.asset_path_of_file(F.col("file_path"), "Content").alias("asset_path")
    )
    from_assets = cat.assets.select(
        paths.file_of_asset_path(F.col("asset_path"), "Content").alias("file_path"), "asset_path"
    )
    return from_files.unionByName(from_assets)


@query
def path_validity(cat):
    path = F.col("asset_path")
    variants = F.explode(F.array(path, F.concat(path, F.lit(".uasset")), F.expr("substring(asset_path, 2)")))
    return cat.assets.select(variants.alias("candidate")).withColumn(
        "valid", paths.is_valid_asset_path(F.col("candidate"))
    )


@query
def package_name(cat):
    path = F.col("asset_path")
    objects = F.explode(F.array(path, F.concat(path, F.lit("."), paths.leaf_name(path), F.lit("_C"))))
    return cat.assets.select(objects.alias("object_path")).withColumn(
        "package", paths.package_name(F.col("object_path"))
    )


@query
def upsert_assets(cat):
    now = cat.assets.select("asset_path", "asset_type", "file_size")
    rescanned = now.join(cat.prev_assets, ["asset_path", "asset_type", "file_size"], "left_anti")
    return tables.upsert(cat.prev_assets, rescanned, "asset_path")


@query
def edge_dedup(cat):
    return tables.dedup_edges(cat.raw_deps)


@query
def delete_cascade(cat):
    kept = tables.delete_assets(
        {"assets": cat.assets, "deps": cat.deps, "texture_metadata": cat.texture_metadata},
        of_type(cat, "ObjectRedirector", "DataTable"),
    )
    edge = F.concat("from_path", F.lit(" -> "), "to_path")
    return (
        kept["assets"]
        .select(F.lit("assets").alias("table_name"), F.col("asset_path").alias("row_key"))
        .unionAll(kept["texture_metadata"].select(F.lit("texture_metadata"), "asset_path"))
        .unionAll(kept["deps"].select(F.lit("deps"), edge))
    )


@query
def scan_snapshot(cat):
    return tables.scan_snapshot(cat.assets, cat.blueprint_metrics)


@query
def load_baseline(cat):
    return tables.load_baseline(cat.baselines, cat.scan_history, "main")


@query
def recent_snapshots(cat):
    return tables.recent_snapshots(cat.scan_history, 7)


@query
def previous_snapshot(cat):
    return tables.previous_snapshot(cat.scan_history)


@query
def edges(cat):
    return cat.deps


@query
def asset_metrics(cat):
    return tables.asset_metrics(cat.assets, cat.blueprint_metrics)


@query
def asset_textures(cat):
    return tables.asset_textures(cat.assets, cat.texture_metadata)


@query
def asset_lookup(cat):
    return tables.lookup(cat.assets, cat.deps.select(F.col("to_path").alias("asset_path")))


# ---------------------------------------------------------------- find


@query
def find_type_size(cat):
    return find.find(cat.assets, "Texture2D", MIB, 8 * MIB)


@query
def find_glob(cat):
    return find.find(cat.assets, path_glob="*/Brand_1*/T_?l*")


@query
def find_unreferenced(cat):
    return find.among(cat.assets, graph.unreferenced(cat.nodes, cat.edges, excluded_types=()))


@query
def find_refs(cat):
    return find.among(cat.assets, graph.referrers_of_any(cat.edges, of_type(cat, "World"), cat.hashed))


@query
def find_deps(cat):
    found = graph.direct_dependencies(of_type(cat, "Blueprint", "MaterialInstance"), cat.edges, cat.nodes)
    return find.among(cat.assets, found, "dep_path")


@query
def find_totals(cat):
    return find.totals(find.find(cat.assets, "StaticMesh", min_size=2 * MIB))


@query
def find_sorted(cat):
    return find.ordered(cat.assets, "size-desc")


@query
def find_has_violation(cat):
    return find.with_violation(cat.assets, rules.lint(cat.assets, cat.blueprint_metrics, LintConfig()), "blueprint")


@query
def dead_filtered(cat):
    return find.narrow_dead(
        graph.unreferenced(cat.nodes, cat.edges),
        types=["Texture2D", "StaticMesh", "DataAsset"],
        min_size=4096,
        exclude_containing=["/Brand_2", "small"],
    )


@query
def internal_edges(cat):
    return cat.edges


# ---------------------------------------------------------------- statistics


@query
def stats_by_type(cat):
    return stats.by_type(cat.assets)


@query
def stats_by_folder(cat):
    return stats.by_folder(cat.assets)


@query
def stats_totals(cat):
    return stats.project_totals(cat.assets, cat.nodes, cat.edges, graph.cycles(cat.members))


@query
def stats_type_share(cat):
    return stats.type_share(cat.assets)


@query
def largest_assets(cat):
    return stats.top(cat.assets.select("asset_path", "asset_type", "file_size"), "file_size", "asset_path", 10)


@query
def dead_by_type(cat):
    return stats.by_type(graph.unreferenced(cat.nodes, cat.edges)).orderBy(F.desc("total_bytes"), "asset_type")


@query
def dead_by_dir(cat):
    return stats.by_folder(graph.unreferenced(cat.nodes, cat.edges)).orderBy(F.desc("total_bytes"), "folder")


@query
def dup_same_name(cat):
    return duplicates.same_name_members(cat.assets)


@query
def dup_texture(cat):
    return duplicates.texture_members(cat.assets)


@query
def dup_groups(cat):
    return duplicates.report(cat.assets)


@query
def degrees(cat):
    return graph.degrees(cat.nodes, cat.edges).select("asset_path", "in_degree", "out_degree")


@query
def graph_summary(cat):
    return stats.graph_summary(cat.nodes, cat.edges, graph.cycles(cat.members))


@query
def blueprint_rank(cat):
    return stats.complexity_ranking(cat.assets, cat.blueprint_metrics)


@query
def export_table(cat):
    return stats.export_table(cat.assets, cat.edges, cat.nodes)


@query
def export_filtered(cat):
    wanted = find.find(cat.assets, asset_type="Texture2D", min_size=4 * MIB, path_glob="*/T_*")
    return stats.export_table(wanted, cat.edges)


# ---------------------------------------------------------------- scalar functions


@query
def leaf_name(cat):
    return cat.assets.select("asset_path", paths.leaf_name(F.col("asset_path")).alias("leaf"))


@query
def relative_path(cat):
    windows = F.translate(F.concat(F.lit("D:/proj/"), "file_path"), "/", "\\")
    both = F.explode(F.array(windows, F.col("file_path")))
    return cat.assets.select(both.alias("full_path")).withColumn(
        "relative", paths.relative_path(F.col("full_path"), "D:/proj")
    )


@query
def format_size(cat):
    size = F.col("file_size")
    return cat.assets.select("asset_path", paths.format_size(size).alias("size"), paths.format_count(size).alias("bytes"))


@query
def folder_bucket(cat):
    return cat.assets.select("asset_path", paths.folder_bucket(F.col("asset_path")).alias("folder"))


@query
def format_timestamp(cat):
    # Far-future values are clamped.
    stamp = F.col("last_modified") * F.when(F.length("asset_path") > 30, 1000).otherwise(1)
    return cat.assets.select(
        "asset_path", paths.format_utc(stamp).alias("utc"), paths.format_rfc3339(stamp).alias("rfc3339")
    )


@query
def days_since_scan(cat):
    return cat.scan_history.select("id", paths.days_between(F.col("scanned_at"), F.lit(NOW)).alias("days"))


# ---------------------------------------------------------------- graph


@query
def vertices(cat):
    return cat.nodes.drop("in_degree", "out_degree")


@query
def dead_assets(cat):
    return graph.unreferenced(cat.nodes, cat.edges)


@query
def dead_hard_only(cat):
    hard = graph.internal_edges(cat.deps, include_soft=False)
    return graph.unreferenced(graph.vertices(cat.assets, hard), hard)


@query
def direct_deps(cat):
    return graph.direct_dependencies(of_type(cat, "Blueprint", "MaterialInstance", "DataAsset"), cat.edges, cat.nodes)


@query
def direct_refs(cat):
    return graph.direct_referrers(of_type(cat, "DataTable", "World", "Texture2D"), cat.edges)


@query
def cycles(cat):
    return graph.cycles(cat.members).select("component", "size", "last_member")


@query
def cycle_members(cat):
    return graph.cycle_members(cat.members)


@query
def cycle_key(cat):
    return graph.cycles(cat.members).select("component", "fingerprint")


@query
def cycle_types(cat):
    return graph.cycles(cat.members, cat.nodes).select("component", "types")


@query
def soft_cycles(cat):
    return graph.soft_cycles(cat.members, cat.edges)


@query
def impact(cat):
    return graph.impact(cat.edges, of_type(cat, "World"), cat.hashed)


@query
def impact_counts(cat):
    return graph.impact_counts(cat.edges, of_type(cat, "World", "DataTable", "Material", "Texture2D"), cat.hashed)


@query
def deps_closure(cat):
    return graph.closure_stats(cat.edges, cat.nodes, of_type(cat, "DataAsset", "Blueprint", "MaterialInstance"), cat.hashed)


@query
def deps_paths(cat):
    return graph.reference_tree(cat.edges, cat.members, of_type(cat, "DataAsset", "MaterialInstance"))


@query
def deps_paths_capped(cat):
    return graph.reference_tree(cat.edges, cat.members, of_type(cat, "DataAsset", "MaterialInstance"), max_depth=2)


@query
def impact_paths(cat):
    rows = graph.reference_tree(cat.edges, cat.members, of_type(cat, "World", "Material"), reverse=True)
    kind = F.when(F.col("is_cycle"), "cycle").when(F.col("depth") == 1, "direct").otherwise("transitive")
    return rows.select(
        F.col("root").alias("target"),
        "parent",
        "asset_path",
        "depth",
        kind.alias("kind"),
        F.when(kind == "transitive", paths.leaf_name(F.col("parent"))).alias("via"),
    )


@query
def redirectors(cat):
    return graph.redirectors(cat.assets).select("asset_path", "file_size")


@query
def material_chain(cat):
    return graph.material_chain(cat.edges, cat.nodes)


@query
def clean_plan(cat):
    dead = graph.unreferenced(cat.nodes, cat.edges)
    return find.clean_plan(dead, min_size=4096, exclude_containing=["Brand_2"], path_glob="/Game/*/P*/T_*")


@query
def shortest_path(cat):
    sources = of_type(cat, "World").select(F.col("asset_path").alias("source"))
    found = graph.shortest_chains_to(cat.edges, sources, of_type(cat, "DataAsset"), cat.index)
    return found.select("source", "target", F.col("hops").cast("bigint").alias("hops"), "chain")


@query
def rename_impact(cat):
    # Each world and data table is renamed in place; data tables towards a name that exists.
    renames = cat.assets.where(F.col("asset_type").isin("World", "DataTable")).select(
        F.col("asset_path").alias("source"),
        F.when(F.col("asset_type") == "World", F.concat("asset_path", F.lit("_New")))
        .otherwise(F.lit("/Game/World/L_0"))
        .alias("destination"),
    )
    return compare.rename_impact(cat.edges, cat.assets, renames, cat.hashed)


# ---------------------------------------------------------------- rules and checks


@query
def lint_naming(cat):
    return rules.naming(cat.assets, cat.blueprint_metrics, LintConfig())


@query
def lint_blueprint(cat):
    return rules.complexity(cat.assets, cat.blueprint_metrics, LintConfig())


@query
def lint_overrides(cat):
    return rules.lint(cat.assets, cat.blueprint_metrics, OVERRIDES)


@query
def lint_all(cat):
    return rules.lint_report(cat.assets, cat.blueprint_metrics, LintConfig(), CONFIGURED_BUDGETS)


@query
def lint_custom_rule(cat):
    def long_names(assets, metrics):
        name = paths.leaf_name(F.col("asset_path"))
        message = F.concat(F.lit("name has "), F.length(name).cast("string"), F.lit(" characters"))
        return assets.where(F.length(name) > 14).select(*rules.violation("warn", "custom/name-length", message))

    return rules.lint(cat.assets, cat.blueprint_metrics, LintConfig(blueprint_enabled=False), [long_names])


@query
def lint_texture(cat):
    return rules.metadata_lint(cat.texture_details, rules.TEXTURE_RULES)


@query
def lint_metadata(cat):
    families = [
        (cat.mesh_details, rules.STATIC_MESH_RULES),
        (cat.sound_details, rules.SOUND_RULES),
        (cat.material_details, rules.material_rules(max_samples=12, max_chain=2)),
        (cat.table_details, rules.DATA_TABLE_RULES),
    ]
    return rules.union([rules.metadata_lint(table, own) for table, own in families], cat.assets)


@query
def budget(cat):
    over = rules.over_budget(cat.assets, rules.effective_budgets(CONFIGURED_BUDGETS))
    return over.withColumn("rule", paths.budget_rule(F.col("asset_type")))


@query
def budget_by_type(cat):
    return rules.budget_by_type(rules.over_budget(cat.assets, rules.effective_budgets(CONFIGURED_BUDGETS)))


def suite(cat: Catalogue, config: CheckConfig | None = None) -> DataFrame:
    return checks.violations(
        cat.assets,
        cat.references,
        cat.blueprint_metrics,
        config or CheckConfig(budgets=CHECK_BUDGETS),
        nodes=cat.unreferenced_or_all,
        members=cat.members,
    )


@query
def check_violations(cat):
    return suite(cat)


@query
def check_selected(cat):
    return suite(
        cat,
        CheckConfig(
            skip=("cycles", "duplicates"),
            severity={"dead-assets": "error", "redirectors": "off"},
            budgets=CHECK_BUDGETS,
        ),
    )


@query
def check_results(cat):
    config = CheckConfig(budgets=CHECK_BUDGETS)
    return checks.results(suite(cat, config), config)


@query
def check_sample(cat):
    return checks.sample(suite(cat)).select("check", "severity", "rule", "asset_path", "message")


@query
def violation_summary(cat):
    return checks.summary(suite(cat))


@query
def gate(cat):
    config = CheckConfig(budgets=CHECK_BUDGETS)
    return checks.gate(checks.results(suite(cat, config), config))


@query
def sarif_results(cat):
    return checks.sarif_results(suite(cat), cat.assets)


@query
def annotations(cat):
    found = rules.lint_report(cat.assets, cat.blueprint_metrics, LintConfig(), CONFIGURED_BUDGETS)
    return checks.annotations(found, cat.assets)


@query
def health_score(cat):
    found = rules.lint(cat.assets, cat.blueprint_metrics, LintConfig())
    return rules.health_scores(cat.assets, found, rules.effective_budgets(CONFIGURED_BUDGETS))


@query
def health_summary(cat):
    return rules.health_summary(health_score(cat))


@query
def audit(cat):
    found = rules.lint_report(cat.assets, cat.blueprint_metrics, LintConfig(), CONFIGURED_BUDGETS)
    return compare.audit(cat.assets, cat.edges, found, cat.nodes)


# ---------------------------------------------------------------- comparing states


def _error_suite(assets: DataFrame, edge_rows: DataFrame, metrics: DataFrame) -> DataFrame:
    config = CheckConfig(only=("redirectors", "lint", "budget"), severity={"redirectors": "error"}, budgets=CHECK_BUDGETS)
    return checks.violations(assets, edge_rows, metrics, config)


def baseline_and_current(cat: Catalogue) -> tuple[DataFrame, DataFrame]:
    # None of these checks looks at a reference.
    before = _error_suite(cat.prev_assets, cat.unstored("prev_deps"), cat.prev_metrics)
    return before, _error_suite(cat.assets, cat.unstored("edges"), cat.blueprint_metrics)


@query
def baseline_summary(cat):
    """The state before, saved and read back, against the state now."""
    before, now = baseline_and_current(cat)
    saved, totals = cat.saved_violations("before", before)
    verdict = checks.regression_gate(saved, now)
    return stats.side_by_side(totals.select("errors", "warnings"), verdict)


@query
def size_increases(cat):
    return compare.size_increases(cat.prev_assets, cat.assets)


@query
def blueprint_regressions(cat):
    return compare.blueprint_regressions(cat.prev_metrics, cat.blueprint_metrics)


@query
def asset_additions(cat):
    return compare.added(cat.prev_assets, cat.assets)


@query
def asset_deletions(cat):
    return compare.deleted(cat.prev_assets, cat.assets)


@query
def regressions(cat):
    return checks.regressions(*baseline_and_current(cat))


@query
def baseline_resolved(cat):
    return checks.resolved(*baseline_and_current(cat))


@query
def regression_gate(cat):
    return checks.regression_gate(*baseline_and_current(cat))


@query
def asset_diff(cat):
    return compare.asset_diff(
        {"assets": cat.prev_assets, "deps": cat.prev_deps, "blueprint_metrics": cat.prev_metrics},
        {"assets": cat.assets, "deps": cat.deps, "blueprint_metrics": cat.blueprint_metrics},
    )


@query
def stats_diff(cat):
    old_edges = graph.internal_edges(cat.prev_deps)
    before, now = baseline_and_current(cat)
    old = compare.state_summary(
        cat.prev_assets,
        graph.analysed(cat.prev_assets, old_edges),
        old_edges,
        before,
        graph.cycles(graph.strong_components(old_edges)),
    )
    new = compare.state_summary(cat.assets, cat.nodes, cat.edges, now, graph.cycles(cat.members))
    return compare.stats_diff(old, new)


@query
def catalogue_health(cat):
    return compare.catalogue_health(
        cat.assets,
        cat.scan_history,
        cat.properties,
        expected={"schema_version": "1", "writer_version": "0.2.0"},
        now=NOW,
    )


@query
def trend(cat):
    return compare.trend(compare.trend_series(cat.scan_history, cat.baseline_errors, 30))


@query
def trend_series(cat):
    return compare.trend_series(cat.scan_history, cat.baseline_errors, 30)


# ---------------------------------------------------------------- change stream, batch form


@query
def debounced_events(cat):
    return changes.debounce(cat.pkg_events, "2 hours").select(
        F.unix_millis("window_start").alias("window_start_ms"), "asset_path", "kind", "merged"
    )


@query
def debounced_from_first(cat):
    return changes.debounce_from_first(cat.pkg_events, "2 hours").select(
        F.unix_millis("window_start").alias("window_start_ms"), "asset_path", "kind", "merged"
    )


@query
def new_dead(cat):
    return compare.new_dead(cat.prev_assets, graph.internal_edges(cat.prev_deps), cat.assets, cat.edges)


@query
def new_cycles(cat):
    before = graph.cycle_members(graph.strong_components(graph.internal_edges(cat.prev_deps)))
    return graph.new_cycles(before, graph.cycle_members(cat.members))

"""Comparing two states of a catalogue, and reading its history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.operators.reachability import Index
from stowage.operators import graph, rules, stats

# Fixed value: growth in percent from which an asset is listed.
GROWTH_PERCENT = 10
# Fixed value: seconds between a scan and a baseline that still belong together.
BASELINE_TOLERANCE = 300


def size_increases(old: DataFrame, new: DataFrame, threshold: int = GROWTH_PERCENT) -> DataFrame:
    """Whole-number growth, shrinking counts as 0, and the threshold itself is included."""
    before = old.select("asset_path", F.col("file_size").alias("old_size")).where(F.col("old_size") != 0)
    after = new.select("asset_path", F.col("file_size").alias("new_size"))
    grown = F.expr("greatest(new_size - old_size, 0) * 100 div old_size")
    return before.join(after, "asset_path").withColumn("pct_increase", grown).where(F.col("pct_increase") >= threshold)


def blueprint_regressions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Blueprints with more nodes than before; ticks are reported along."""
    before = old.select(
        "asset_path",
        F.col("node_count").alias("old_node_count"),
        F.col("event_tick_count").alias("old_event_tick_count"),
    )
    after = new.select(
        "asset_path",
        F.col("node_count").alias("new_node_count"),
        F.col("event_tick_count").alias("new_event_tick_count"),
    )
    return before.join(after, "asset_path").where(F.col("new_node_count") > F.col("old_node_count"))


def added(old: DataFrame, new: DataFrame) -> DataFrame:
    return new.join(old.select("asset_path"), "asset_path", "left_anti")


def deleted(old: DataFrame, new: DataFrame) -> DataFrame:
    return added(new, old)


def asset_diff(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
    """Changes of every asset present in both revisions: (asset_path, change, old, new).

    One row per changed thing rather than lists per asset, because an asset may have any
    number of dependencies. Only hard references count. Metric deltas need metrics on both
    sides.
    """
    both = old["assets"].select("asset_path", F.col("asset_type").alias("old")).join(
        new["assets"].select("asset_path", F.col("asset_type").alias("new")), "asset_path"
    )
    nothing = F.lit(None).cast("string")

    def hard(tables: dict[str, DataFrame]) -> DataFrame:
        return tables["deps"].where(~F.col("is_soft")).select(F.col("from_path").alias("asset_path"), "to_path")

    def deps_change(left: DataFrame, right: DataFrame) -> DataFrame:
        missing = left.join(right, ["asset_path", "to_path"], "left_anti")
        return missing.join(both.select("asset_path"), "asset_path", "left_semi")

    gained = deps_change(hard(new), hard(old)).select(
        "asset_path", F.lit("dep_added").alias("change"), nothing.alias("old"), F.col("to_path").alias("new")
    )
    lost = deps_change(hard(old), hard(new)).select(
        "asset_path", F.lit("dep_removed").alias("change"), F.col("to_path").alias("old"), nothing.alias("new")
    )
    retyped = both.where(F.col("old") != F.col("new")).select(
        "asset_path", F.lit("type_changed").alias("change"), "old", "new"
    )
    metrics = (
        old["blueprint_metrics"]
        .select("asset_path", F.col("node_count").alias("n0"), F.col("event_tick_count").alias("t0"))
        .join(
            new["blueprint_metrics"].select(
                "asset_path", F.col("node_count").alias("n1"), F.col("event_tick_count").alias("t1")
            ),
            "asset_path",
        )
        .join(both.select("asset_path"), "asset_path", "left_semi")
    )
    deltas = metrics.select(
        "asset_path",
        F.inline(
            F.array(
                F.struct(
                    F.lit("node_count_delta").alias("change"),
                    nothing.alias("old"),
                    (F.col("n1") - F.col("n0")).cast("string").alias("new"),
                ),
                F.struct(
                    F.lit("event_tick_count_delta").alias("change"),
                    nothing.alias("old"),
                    (F.col("t1") - F.col("t0")).cast("string").alias("new"),
                ),
            )
        ),
    )
    return gained.unionByName(lost).unionByName(retyped).unionByName(deltas)


def new_dead(
    old_assets: DataFrame, old_edges: DataFrame, new_assets: DataFrame, new_edges: DataFrame
) -> DataFrame:
    """Assets that became unreferenced. Watching applies no type exclusion."""
    before = graph.unreferenced(graph.analysed(old_assets, old_edges), old_edges, excluded_types=())
    after = graph.unreferenced(graph.analysed(new_assets, new_edges), new_edges, excluded_types=())
    return after.select("asset_path").join(before.select("asset_path"), "asset_path", "left_anti")


def stats_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(metric, old, new, delta) from two one-row summaries."""

    def rows(summary: DataFrame, name: str) -> DataFrame:
        # Number the columns alike on both sides, then compare by metric name.
        entries = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("bigint").alias(name)) for c in summary.columns]
        return summary.select(F.inline(F.array(*entries)))

    return (
        rows(old, "old")
        .join(rows(new, "new"), "metric")
        .select("metric", "old", "new", (F.col("new") - F.col("old")).alias("delta"))
    )


def state_summary(
    assets: DataFrame, nodes: DataFrame, edges: DataFrame, violations: DataFrame, reported_cycles: DataFrame
) -> DataFrame:
    dead = graph.unreferenced(nodes, edges)
    count = F.count(F.lit(1)).alias("n")
    return stats.one_row(
        {
            "assets": assets.agg(count),
            "file_size_total": assets.agg(F.coalesce(F.sum("file_size"), F.lit(0)).alias("n")),
            "violations": violations.where(F.col("severity") == rules.ERROR).agg(count),
            "dead_assets": dead.agg(count),
            "cycles": reported_cycles.agg(count),
        }
    )


# ---------------------------------------------------------------- history


def trend_series(history: DataFrame, baselines: DataFrame, limit: int) -> DataFrame:
    """The newest `limit` snapshots, each with the errors of the baseline saved closest to it.

    Both sides are put into time buckets as wide as the tolerance, a baseline also into the
    two neighbouring ones, so the match is an equi-join instead of a range scan.
    """
    newest = history.orderBy(F.desc("scanned_at"), F.desc("id")).limit(limit)
    bucket = F.floor(F.col("scanned_at") / BASELINE_TOLERANCE)
    saved = baselines.select(
        "name",
        "saved_at",
        "errors",
        F.explode(
            F.array(*[F.floor(F.col("saved_at") / BASELINE_TOLERANCE) + shift for shift in (-1, 0, 1)])
        ).alias("bucket"),
    )
    apart = F.abs(F.col("saved_at") - F.col("scanned_at"))
    matched = (
        newest.select("id", "scanned_at", bucket.alias("bucket"))
        .join(saved, "bucket")
        .where(apart <= BASELINE_TOLERANCE)
        .groupBy("id")
        .agg(F.min_by("errors", F.struct(apart, F.col("saved_at"), F.col("name"))).alias("violations"))
    )
    return newest.join(matched, "id", "left").select(
        "id", "scanned_at", F.col("asset_count").alias("assets"), "violations", F.col("total_size").alias("file_size_total")
    )


def trend(series: DataFrame) -> DataFrame:
    """Newest against oldest snapshot of the window, one row per metric."""
    names = ["assets", "violations", "file_size_total"]
    order = F.struct("scanned_at", "id")
    ends = [F.min_by(n, order).alias(f"{n}_old") for n in names] + [F.max_by(n, order).alias(f"{n}_new") for n in names]
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("metric"), F.col(f"{n}_old").alias("oldest"), F.col(f"{n}_new").alias("newest"))
            for n in names
        ]
    )
    delta = F.col("newest") - F.col("oldest")
    return series.agg(*ends).select(F.inline(rows)).select(
        "metric",
        "oldest",
        "newest",
        delta.alias("delta"),
        F.when(delta > 0, "up").when(delta < 0, "down").when(delta == 0, "unchanged").alias("direction"),
    )


def catalogue_health(
    assets: DataFrame, history: DataFrame, properties: DataFrame, expected: dict[str, str], now: int
) -> DataFrame:
    """One row per check: (check, ok, detail). `properties` are the stored (key, value) pairs."""
    count = assets.agg(F.count(F.lit(1)).alias("v")).scalar()
    last = history.agg(F.max("scanned_at").alias("v")).scalar()
    stored = {
        name: properties.where(F.col("key") == name).agg(F.max("value").alias("v")).scalar()
        for name in ("schema_version", "writer_version")
    }
    base = assets.sparkSession.range(1).select(
        count.alias("n"), last.alias("last"), *(value.alias(name) for name, value in stored.items())
    )
    entries = [("assets", F.col("n") > 0, F.concat(F.col("n").cast("string"), F.lit(" assets")))]
    for name in ("schema_version", "writer_version"):
        have = F.col(name)
        detail = F.concat(F.coalesce(have, F.lit("unknown")), F.lit(f" (expected {expected[name]})"))
        entries.append((name, F.coalesce(have == expected[name], F.lit(False)), detail))
    age = (F.greatest(F.lit(now) - F.col("last"), F.lit(0)) / 86400).cast("bigint")
    entries.append(
        (
            "last_scan",
            F.col("last").isNotNull(),
            F.coalesce(F.concat(age.cast("string"), F.lit(" days ago")), F.lit("no scan recorded")),
        )
    )
    rows = [F.struct(F.lit(n).alias("check"), ok.alias("ok"), detail.alias("detail")) for n, ok, detail in entries]
    return base.select(F.inline(F.array(*rows)))


# ---------------------------------------------------------------- reports over one state


def rename_impact(
    edges: DataFrame, assets: DataFrame, renames: DataFrame, index: Index | None = None
) -> DataFrame:
    """Per (source, destination): referrers to re-save, further dependants, name clash."""
    counts = graph.impact_counts(edges, renames.select(F.col("source").alias("asset_path")), index)
    taken = assets.select(F.col("asset_path").alias("destination"), F.lit(True).alias("taken"))
    return (
        renames.join(counts.withColumnRenamed("asset_path", "source"), "source")
        .join(taken, "destination", "left")
        .select(
            "source",
            "destination",
            F.col("direct_count").alias("direct_references"),
            F.col("transitive_count").alias("transitive_impact_count"),
            F.coalesce("taken", F.lit(False)).alias("destination_exists"),
        )
    )


def audit(assets: DataFrame, edges: DataFrame, violations: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One row per asset: degrees, violations by rule, flags. `nodes`: stored vertices, if any."""
    if nodes is None:
        nodes = assets.select("asset_path", "asset_type", "file_size")
    else:
        nodes = nodes.where(~F.col("is_placeholder"))
    ordered = F.array_sort(
        F.collect_set(
            F.concat(F.when(F.col("severity") == rules.ERROR, "1error ").otherwise("2warn "), F.col("rule"))
        )
    )
    # An asset has at most one finding per rule, and rules are few.
    found = violations.groupBy("asset_path").agg(
        F.count_if(F.col("severity") == rules.ERROR).alias("errors"),
        F.count_if(F.col("severity") != rules.ERROR).alias("warnings"),
        F.array_join(F.transform(ordered, lambda t: F.regexp_replace(t, "^.", "")), "; ").alias("rules"),
    )
    return (
        graph.degrees(nodes, edges)
        .join(found, "asset_path", "left")
        .select(
            "asset_path",
            "asset_type",
            F.col("out_degree").alias("deps_count"),
            F.col("in_degree").alias("referrer_count"),
            F.coalesce("errors", F.lit(0)).alias("errors"),
            F.coalesce("warnings", F.lit(0)).alias("warnings"),
            F.coalesce("rules", F.lit("")).alias("rules"),
            (F.col("asset_type") == "ObjectRedirector").alias("is_redirector"),
        )
    )

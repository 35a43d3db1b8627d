"""The check suite: every finding as a violation row, results per check, and the gate."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions import paths
from stowage.operators import duplicates, graph, rules
from stowage.operators.rules import ERROR, OFF, WARN, LintConfig, violation

# The checks in report order.
ALL_CHECKS = ("dead-assets", "cycles", "redirectors", "lint", "budget", "duplicates")
# Severities of the checks that can be configured. Lint takes its own from its
# findings, and budget findings are errors here.
DEFAULT_SEVERITY = {"dead-assets": WARN, "cycles": ERROR, "redirectors": WARN, "duplicates": WARN}
SAMPLE_LIMIT = 5


@dataclass(frozen=True)
class CheckConfig:
    only: tuple[str, ...] = ()
    skip: tuple[str, ...] = ()
    severity: dict[str, str] = field(default_factory=dict)
    lint: LintConfig = field(default_factory=LintConfig)
    # Taken as configured: the built-in budgets are not merged in for checks.
    budgets: dict[str, int] = field(default_factory=dict)

    def severity_of(self, check: str) -> str:
        return self.severity.get(check, DEFAULT_SEVERITY[check]) if check in DEFAULT_SEVERITY else ERROR

    def active(self) -> list[str]:
        unknown = [name for name in (*self.only, *self.skip) if name not in ALL_CHECKS]
        if unknown:
            raise ValueError(f"unknown check {unknown[0]!r}; valid: {', '.join(ALL_CHECKS)}")
        return [
            name
            for name in ALL_CHECKS
            if (not self.only or name in self.only) and name not in self.skip and self.severity_of(name) != OFF
        ]


def _recorded(severity: str) -> str:
    return ERROR if severity == ERROR else WARN


def violations(
    assets: DataFrame,
    edges: DataFrame,
    metrics: DataFrame,
    config: CheckConfig | None = None,
    nodes: DataFrame | None = None,
    members: DataFrame | None = None,
) -> DataFrame:
    """Findings of all active checks. Inputs of a check that is off are never read.

    `nodes` and `members` are stored vertices and cycle members, if the catalogue has them.
    """
    config = config or CheckConfig()
    nodes = graph.vertices(assets, edges) if nodes is None else nodes
    parts = []
    for name in config.active():
        severity = _recorded(config.severity_of(name))
        if name == "dead-assets":
            dead = graph.unreferenced(nodes, edges)
            parts.append(dead.select(*violation(severity, "dead-assets", F.lit("unreferenced asset"), name)))
        elif name == "cycles":
            # The message names the cycle by size and first member; listing all members in
            # the row of every member would grow with the square of the cycle.
            message = F.concat(
                F.lit("cycle of "), F.col("size").cast("string"), F.lit(" assets from "), F.col("component")
            )
            components = graph.strong_components(edges) if members is None else members
            parts.append(graph.cycle_members(components).select(*violation(severity, "circular-deps", message, name)))
        elif name == "redirectors":
            found = graph.redirectors(assets)
            parts.append(found.select(*violation(severity, "redirectors", F.lit("unresolved redirector"), name)))
        elif name == "lint":
            parts.append(rules.lint(assets, metrics, config.lint))
        elif name == "budget":
            over = rules.over_budget(assets, config.budgets)
            message = F.concat(
                paths.format_size(F.col("file_size")), F.lit(" > "), paths.format_size(F.col("max_size"))
            )
            parts.append(over.select(*violation(severity, paths.budget_rule(F.col("asset_type")), message, name)))
        elif name == "duplicates":
            # A group has no file of its own: its name stands in the path column.
            groups = duplicates.report(assets).withColumn("asset_path", F.col("name"))
            message = F.concat(F.lit("["), F.col("kind"), F.lit("] "), F.col("name"))
            parts.append(groups.select(*violation(severity, "duplicate-assets", message, name)))
    return rules.union(parts, assets)


def results(found: DataFrame, config: CheckConfig | None = None) -> DataFrame:
    """One row per active check. Cycles count as cycles, not as members."""
    config = config or CheckConfig()
    listed = F.array(*[F.struct(F.lit(c).alias("check"), F.lit(config.severity_of(c)).alias("set")) for c in config.active()])
    checks = found.sparkSession.range(1).select(F.inline(listed))
    counts = found.groupBy("check").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(F.when(F.col("check") == "cycles", F.col("message"))).alias("cycles"),
        F.bool_or(F.col("severity") == ERROR).alias("has_error"),
    )
    number = F.when(F.col("check") == "cycles", F.col("cycles")).otherwise(F.col("n"))
    effective = F.when(
        F.col("check") == "lint", F.when(F.coalesce("has_error", F.lit(False)), ERROR).otherwise(WARN)
    ).otherwise(F.col("set"))
    return checks.join(counts, "check", "left").select(
        "check",
        effective.alias("severity"),
        F.coalesce(number, F.lit(0)).alias("finding_count"),
        F.col("n").isNull().alias("passed"),
    )


def summary(found: DataFrame) -> DataFrame:
    return found.agg(
        F.count_if(F.col("severity") == ERROR).alias("errors"), F.count_if(F.col("severity") != ERROR).alias("warnings")
    )


def sample(found: DataFrame, limit: int = SAMPLE_LIMIT) -> DataFrame:
    """The first findings of each check by path.

    Filtering on the row number lets Spark cut each input partition to `limit` rows per check
    before the shuffle, so a check with very many findings stays cheap.
    """
    order = Window.partitionBy("check").orderBy("asset_path", "rule", "message")
    return found.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def gate(check_results: DataFrame) -> DataFrame:
    """Verdicts under each `fail_on` setting, one row per setting."""
    counts = check_results.agg(
        F.count_if(~F.col("passed") & (F.col("severity") == ERROR)).alias("blocking"),
        F.count_if(~F.col("passed") & (F.col("severity") == WARN)).alias("warning"),
    )
    clean = F.col("blocking") == 0
    verdicts = F.array(
        F.struct(F.lit("error").alias("fail_on"), clean.alias("passed")),
        F.struct(F.lit("warn").alias("fail_on"), (clean & (F.col("warning") == 0)).alias("passed")),
        F.struct(F.lit("never").alias("fail_on"), F.lit(True).alias("passed")),
    )
    return counts.select("blocking", "warning", F.inline(verdicts))


def _errors(found: DataFrame) -> DataFrame:
    return found.where(F.col("severity") == ERROR)


def regressions(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Errors of `current` whose (rule, asset_path) was no error in the baseline."""
    known = _errors(baseline).select("rule", "asset_path").distinct()
    return _errors(current).join(known, ["rule", "asset_path"], "left_anti").select(*current.columns)


def resolved(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Errors of the baseline that are gone."""
    return regressions(current, baseline)


def regression_gate(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Replaces the ordinary gate when a baseline is given: any regression fails."""
    found = regressions(baseline, current).agg(F.count(F.lit(1)).alias("regressions"))
    return found.withColumn("passed", F.col("regressions") == 0)


# ---------------------------------------------------------------- output rows


def sarif_results(found: DataFrame, assets: DataFrame) -> DataFrame:
    """One SARIF result per row; `uri` is NULL when no file stands behind the violation."""
    files = assets.select("asset_path", F.col("file_path").alias("uri"))
    return found.join(files, "asset_path", "left").select(
        F.col("rule").alias("rule_id"),
        F.when(F.col("severity") == ERROR, "error").otherwise("warning").alias("level"),
        "message",
        "uri",
    )


def sarif_json(results_rows: DataFrame, keep: list[str] = ()) -> DataFrame:
    """SARIF 2.1.0 result objects as JSON text, one per row, beside the columns to `keep`."""
    location = F.struct(
        F.struct(
            F.struct(F.col("uri").alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation")
        ).alias("physicalLocation")
    )
    empty = F.array().cast(
        "array<struct<physicalLocation:struct<artifactLocation:struct<uri:string,uriBaseId:string>>>>"
    )
    return results_rows.select(
        *keep,
        F.to_json(
            F.struct(
                F.col("rule_id").alias("ruleId"),
                "level",
                F.struct(F.col("message").alias("text")).alias("message"),
                F.when(F.col("uri").isNull(), empty).otherwise(F.array(location)).alias("locations"),
            )
        ).alias("value"),
    )


def sarif_rules(results_rows: DataFrame) -> DataFrame:
    """Distinct rule ids in order: the `rules` list of the document's tool driver."""
    return results_rows.select("rule_id").distinct().orderBy("rule_id")


def annotations(found: DataFrame, assets: DataFrame) -> DataFrame:
    """CI annotation lines, one per violation, never truncated."""
    files = assets.select("asset_path", "file_path")
    level = F.when(F.col("severity") == ERROR, "error").otherwise("warning")
    return found.join(files, "asset_path", "left").select(
        F.concat(
            F.lit("::"),
            level,
            F.lit(" file="),
            F.coalesce("file_path", F.lit("")),
            F.lit(",title="),
            F.col("rule"),
            F.lit("::"),
            F.col("message"),
        ).alias("line")
    )

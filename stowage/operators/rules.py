"""Naming, complexity, size and metadata rules.

A rule set is a handful of configured values, so it is folded into the query as expressions:
no rule costs a join with anything but the table it judges.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions import paths

ERROR, WARN, OFF = "error", "warn", "off"
# Only metadata rules know this one: it is listed and never fails anything.
INFO = "info"

# Accepted name prefixes per asset type.
NAME_PREFIXES = {
    "Texture2D": ["T_"],
    "Material": ["M_"],
    "StaticMesh": ["SM_"],
    "Blueprint": ["BP_"],
    "SkeletalMesh": ["SKM_", "SK_"],
    "AnimBlueprint": ["ABP_"],
    "UserWidget": ["WBP_"],
    "SoundWave": ["SW_", "S_"],
    "NiagaraSystem": ["NS_"],
    "NiagaraEmitter": ["NE_", "NS_"],
}
# Size limits in bytes that hold unless configured otherwise.
SIZE_BUDGETS = {"Texture2D": 4 * 1024 * 1024}


@dataclass(frozen=True)
class Thresholds:
    # Largest accepted counts.
    node_count: int = 200
    event_tick_count: int = 1
    cast_count: int = 10
    dependency_depth: int = 20


@dataclass(frozen=True)
class LintConfig:
    naming_enabled: bool = True
    naming_severity: str = WARN
    prefixes: dict[str, list[str]] = field(default_factory=lambda: dict(NAME_PREFIXES))
    blueprint_enabled: bool = True
    blueprint_severity: str = ERROR
    thresholds: Thresholds = field(default_factory=Thresholds)
    depth_by_type: dict[str, int] = field(default_factory=dict)

    def with_prefixes(self, overrides: dict[str, str]) -> "LintConfig":
        """A configured prefix replaces all accepted prefixes of its type."""
        return replace(self, prefixes={**self.prefixes, **{kind: [p] for kind, p in overrides.items()}})


def effective_budgets(configured: dict[str, int]) -> dict[str, int]:
    return {**SIZE_BUDGETS, **configured}


def by_asset_type(values: dict[str, object], default: object = None) -> Column:
    """CASE over the asset type."""
    column = None
    for kind, value in values.items():
        value = value if isinstance(value, Column) else F.lit(value)
        test = F.col("asset_type") == kind
        column = F.when(test, value) if column is None else column.when(test, value)
    default = default if isinstance(default, Column) else F.lit(default)
    return default if column is None else column.otherwise(default)


def violation(severity: str | Column, rule: str | Column, message: Column, check: str = "lint") -> list[Column]:
    as_column = lambda value: value if isinstance(value, Column) else F.lit(value)
    return [
        F.lit(check).alias("check"),
        as_column(severity).alias("severity"),
        as_column(rule).alias("rule"),
        F.col("asset_path"),
        message.alias("message"),
    ]


# ---------------------------------------------------------------- lint


def naming(assets: DataFrame, metrics: DataFrame, config: LintConfig) -> DataFrame:
    """Names must start with one of the prefixes of their type; other types pass."""
    name = paths.leaf_name(F.col("asset_path"))
    quoted = {kind: ", ".join(f"`{p}`" for p in accepted) for kind, accepted in config.prefixes.items()}
    expected = {
        kind: quoted[kind] if len(accepted) == 1 else f"one of: {quoted[kind]}"
        for kind, accepted in config.prefixes.items()
    }
    accepted = {kind: paths.starts_with_any(name, allowed) for kind, allowed in config.prefixes.items()}
    bad = assets.where(~by_asset_type(accepted, True))
    message = F.concat(F.lit("asset `"), name, F.lit("` should start with "), by_asset_type(expected))
    return bad.select(*violation(config.naming_severity, "naming/prefix", message))


def complexity(assets: DataFrame, metrics: DataFrame, config: LintConfig) -> DataFrame:
    """One violation for each counter above its limit."""
    limits = config.thresholds
    depth_limit = by_asset_type(config.depth_by_type, limits.dependency_depth)
    tests = [
        ("blueprint/node-count", "node count", "node_count", F.lit(limits.node_count)),
        ("blueprint/event-tick", "event tick count", "event_tick_count", F.lit(limits.event_tick_count)),
        ("blueprint/cast-count", "cast count", "cast_count", F.lit(limits.cast_count)),
        ("blueprint/dependency-depth", "dependency depth", "dependency_depth", depth_limit),
    ]
    anything = F.lit(False)
    found = []
    for rule, label, column, limit in tests:
        over = F.col(column) > limit
        anything = anything | over
        text = F.concat(
            F.lit(label + " "), F.col(column).cast("string"), F.lit(" exceeds limit "), limit.cast("string")
        )
        found.append(F.when(over, F.struct(F.lit(rule).alias("rule"), text.alias("message"))))
    judged = assets.select("asset_path", "asset_type").join(metrics, "asset_path").where(anything)
    return (
        judged.select("asset_path", F.explode(F.array_compact(F.array(*found))).alias("hit"))
        .select("asset_path", "hit.*")
        .select(*violation(config.blueprint_severity, F.col("rule"), F.col("message")))
    )


def over_budget(assets: DataFrame, budgets: dict[str, int]) -> DataFrame:
    """Assets strictly larger than the limit of their type."""
    limit = by_asset_type({kind: F.lit(size).cast("bigint") for kind, size in budgets.items()}, F.lit(None).cast("bigint"))
    # The type test alone can be pushed into the scan; the CASE cannot.
    limited = assets.where(F.col("asset_type").isin(*budgets)) if budgets else assets.limit(0)
    return (
        limited.select("asset_path", "asset_type", "file_size")
        .withColumn("max_size", limit)
        .where(F.col("file_size") > F.col("max_size"))
        .withColumn("excess_bytes", F.col("file_size") - F.col("max_size"))
    )


def budget_by_type(violations: DataFrame) -> DataFrame:
    return violations.groupBy("asset_type", "max_size").agg(
        F.count(F.lit(1)).alias("violation_count"),
        F.max("file_size").alias("largest"),
        F.sum("excess_bytes").alias("excess_bytes"),
    )


def budget_lint(assets: DataFrame, budgets: dict[str, int]) -> DataFrame:
    """Budget findings as the lint report words them: warnings, always in megabytes."""
    message = F.concat(
        F.col("asset_type"),
        F.lit(" "),
        paths.leaf_name(F.col("asset_path")),
        F.lit(" exceeds size limit: "),
        paths.megabytes(F.col("file_size")),
        F.lit(" > "),
        paths.megabytes(F.col("max_size")),
    )
    return over_budget(assets, budgets).select(*violation(WARN, paths.budget_rule(F.col("asset_type")), message))


Rule = Callable[[DataFrame, DataFrame], DataFrame]


def lint(assets: DataFrame, metrics: DataFrame, config: LintConfig, extra: list[Rule] | None = None) -> DataFrame:
    """All active rules. An `extra` rule maps (assets, metrics) to violations."""
    parts = []
    if config.naming_enabled and config.naming_severity != OFF:
        parts.append(naming(assets, metrics, config))
    if config.blueprint_enabled and config.blueprint_severity != OFF:
        parts.append(complexity(assets, metrics, config))
    parts += [rule(assets, metrics) for rule in extra or []]
    return union(parts, assets)


def lint_report(
    assets: DataFrame, metrics: DataFrame, config: LintConfig, configured_budgets: dict[str, int]
) -> DataFrame:
    """Lint rules plus the size budgets, with the built-in budgets merged in."""
    sizes = budget_lint(assets, effective_budgets(configured_budgets))
    return lint(assets, metrics, config).unionByName(sizes)


def union(parts: list[DataFrame], like: DataFrame) -> DataFrame:
    if not parts:
        nothing = like.select("asset_path").limit(0)
        return nothing.select(*violation(WARN, "", F.lit("")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# ---------------------------------------------------------------- metadata rules


@dataclass(frozen=True)
class MetadataRule:
    """A SQL condition over one metadata table; NULL means no violation."""

    rule: str
    severity: str
    condition: str


def _not_power_of_two(column: str) -> str:
    return f"({column} <= 0 OR ({column} & ({column} - 1)) <> 0)"


# Rules over texture metadata.
TEXTURE_RULES = [
    MetadataRule(
        "lint/texture/non-power-of-two",
        WARN,
        f"{_not_power_of_two('source_x')} OR {_not_power_of_two('source_y')}",
    ),
    MetadataRule(
        "lint/texture/missing-mip-maps",
        WARN,
        "mip_gen = 'TMGS_NoMipmaps' AND source_x > 64 AND source_y > 64",
    ),
    MetadataRule(
        "lint/texture/uncompressed",
        ERROR,
        "compression = 'TC_None' AND source_x > 512 AND source_y > 512",
    ),
    MetadataRule(
        "lint/texture/has-alpha-but-opaque",
        WARN,
        "has_alpha AND texture_group = 'TEXTUREGROUP_World'",
    ),
]


# Rules over the metadata of the other kinds of assets.
STATIC_MESH_RULES = [
    MetadataRule("lint/static-mesh/no-lod", WARN, "lod_count = 1 AND triangle_count_lod0 > 10000"),
    MetadataRule("lint/static-mesh/high-lightmap-res", WARN, "lightmap_resolution > 512"),
    MetadataRule("lint/static-mesh/no-collision", WARN, "NOT has_collision"),
    MetadataRule("lint/static-mesh/nanite-no-lod", INFO, "has_nanite AND lod_count > 1"),
]
SKELETAL_MESH_RULES = [
    MetadataRule("lint/skeletal-mesh/no-lod", WARN, "lod_count = 1 AND triangle_count_lod0 > 5000"),
    MetadataRule("lint/skeletal-mesh/excess-bones", WARN, "bone_count > 256"),
    MetadataRule("lint/skeletal-mesh/high-poly-morph", WARN, "has_morph_targets AND triangle_count_lod0 > 20000"),
]
SOUND_RULES = [
    MetadataRule("lint/sound/stereo-ambient", WARN, "duration > 10 AND num_channels = 2"),
    MetadataRule("lint/sound/uncompressed", ERROR, "compression_quality = 100 AND file_size > 2097152"),
    MetadataRule("lint/sound/high-sample-rate", WARN, "sample_rate > 48000"),
    MetadataRule("lint/sound/non-streaming-large", WARN, "duration > 30 AND NOT is_streaming"),
]
EFFECT_RULES = [
    MetadataRule("lint/niagara/many-emitters", WARN, "emitter_count > 10"),
    MetadataRule("lint/niagara/gpu-sim-with-lights", WARN, "has_gpu_simulation AND has_lights"),
]
DATA_TABLE_RULES = [
    MetadataRule("lint/data-table/large-table", WARN, "row_count > 10000"),
    MetadataRule("lint/data-table/missing-struct", ERROR, "asset_type = 'DataTable' AND row_struct IS NULL"),
]
WIDGET_RULES = [
    MetadataRule("lint/widget/deep-hierarchy", WARN, "widget_depth > 8"),
    MetadataRule("lint/widget/many-animations", WARN, "animation_count > 20"),
]


def material_rules(max_samples: int, max_chain: int) -> list[MetadataRule]:
    """Fixed values but for the two limits, which are settings."""
    return [
        MetadataRule("lint/material/too-many-texture-samples", WARN, f"texture_sample_count > {int(max_samples)}"),
        MetadataRule("lint/material/deep-instance-chain", WARN, f"instance_chain_depth > {int(max_chain)}"),
        MetadataRule("lint/material/wpo-on-opaque", WARN, "uses_wpo AND blend_mode = 'BLEND_Opaque'"),
        MetadataRule("lint/material/translucent-two-sided", WARN, "blend_mode = 'BLEND_Translucent' AND two_sided"),
        MetadataRule(
            "lint/material/subsurface-high-sample-count",
            ERROR,
            "shading_model = 'MSM_Subsurface' AND texture_sample_count > 16",
        ),
    ]


def metadata_lint(table: DataFrame, rules: list[MetadataRule]) -> DataFrame:
    """One pass over the table for all rules."""
    hits = [
        F.when(F.expr(r.condition), F.struct(F.lit(r.rule).alias("rule"), F.lit(r.severity).alias("severity")))
        for r in rules
    ]
    return (
        table.select("asset_path", F.explode(F.array_compact(F.array(*hits))).alias("hit"))
        .select("asset_path", "hit.*")
        .select(*violation(F.col("severity"), F.col("rule"), F.col("rule")))
    )


# ---------------------------------------------------------------- health


def health_scores(assets: DataFrame, violations: DataFrame, budgets: dict[str, int]) -> DataFrame:
    """0 to 100 per asset from its lint violations and how far it is over its size budget."""
    counts = violations.groupBy("asset_path").agg(
        F.count_if(F.col("severity") == ERROR).alias("errors"), F.count_if(F.col("severity") == WARN).alias("warnings")
    )
    limit = by_asset_type({kind: F.lit(size).cast("bigint") for kind, size in budgets.items()}, F.lit(None).cast("bigint"))
    size = F.col("file_size")
    # Points taken off and their caps.
    size_penalty = F.when(size > limit * 5, 20).when(size > limit * 2, 10).otherwise(0)
    error_penalty = F.least(F.col("errors") * 20, F.lit(60))
    warning_penalty = F.least(F.col("warnings") * 5, F.lit(20))
    score = F.greatest(F.lit(100) - error_penalty - warning_penalty - size_penalty, F.lit(0)).cast("bigint")
    return (
        assets.select("asset_path", "asset_type", "file_size")
        .join(counts, "asset_path", "left")
        .fillna(0, ["errors", "warnings"])
        .select("asset_path", "errors", "warnings", score.alias("score"))
        .withColumn(
            "label",
            F.when(F.col("score") >= 90, "Excellent")
            .when(F.col("score") >= 70, "Good")
            .when(F.col("score") >= 50, "Fair")
            .otherwise("Poor"),
        )
    )


def health_summary(scores: DataFrame) -> DataFrame:
    """Assets per label and the project's average, one row per label."""
    per_label = scores.groupBy("label").agg(F.count(F.lit(1)).alias("asset_count"))
    mean = scores.agg((F.sum("score") / F.count(F.lit(1))).alias("v")).scalar()
    return per_label.withColumn("project_average", mean)

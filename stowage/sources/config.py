"""Settings as data: one nested dictionary, as any settings file gives it, to the rule objects."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from stowage.operators.checks import CheckConfig
from stowage.operators.graph import EXTERNAL_ROOTS
from stowage.operators.rules import ERROR, OFF, WARN, LintConfig, Thresholds
from stowage.sources.inventory import ScanRules, parse_ignore_lines

# Names of settings, and the asset types and checks they stand for.
PREFIX_SETTINGS = {
    "texture_prefix": "Texture2D",
    "material_prefix": "Material",
    "material_function_prefix": "MaterialFunction",
    "static_mesh_prefix": "StaticMesh",
    "skeletal_mesh_prefix": "SkeletalMesh",
    "blueprint_prefix": "Blueprint",
    "widget_prefix": "UserWidget",
    "anim_bp_prefix": "AnimBlueprint",
    "sound_prefix": "SoundWave",
}
LIMIT_SETTINGS = {
    "event_tick_limit": "event_tick_count",
    "cast_limit": "cast_count",
    "node_limit": "node_count",
    "dependency_depth_limit": "dependency_depth",
}
CHECK_SETTINGS = {
    "dead-assets": "dead-assets",
    "circular-deps": "cycles",
    "duplicate-assets": "duplicates",
    "redirectors": "redirectors",
}
SIZE_INCREASE_PERCENT = 10


@dataclass(frozen=True)
class Settings:
    scan: ScanRules = field(default_factory=ScanRules)
    external_roots: tuple[str, ...] = EXTERNAL_ROOTS
    checks: CheckConfig = field(default_factory=CheckConfig)
    size_increase_percent: int = SIZE_INCREASE_PERCENT
    baseline_path: str | None = None

    @property
    def lint(self) -> LintConfig:
        return self.checks.lint


def _section(data: dict, name: str, allowed) -> dict:
    found = data.get(name, {})
    if not isinstance(found, dict):
        raise ValueError(f"{name} must hold settings, not {found!r}")
    for key in found:
        if key not in allowed:
            raise ValueError(f"unknown setting {name}.{key}; known: {', '.join(sorted(allowed))}")
    return found


def _severity(value: object, name: str) -> str:
    if value not in (ERROR, WARN, OFF):
        raise ValueError(f"{name} must be error, warn or off, not {value!r}")
    return value


def _number(value: object, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        raise ValueError(f"{name} must be a whole number from 0, not {value!r}")
    return value


def from_dict(data: dict, ignore_lines: list[str] = ()) -> Settings:
    """Settings of a project. Absent ones keep their defaults; unknown or ill-typed ones are errors.

    `ignore_lines` are those of the project's ignore file.
    """
    for name in data:
        if name not in ("scan", "rules", "lint", "budget", "diff", "check"):
            raise ValueError(f"unknown section {name}")
    scan = _section(data, "scan", ("exclude_paths", "external_roots"))
    rules = _section(data, "rules", CHECK_SETTINGS)
    lint = _section(data, "lint", ("naming", "blueprint"))
    naming = _section(lint, "naming", ("enabled", "severity", *PREFIX_SETTINGS))
    blueprint = _section(lint, "blueprint", ("enabled", "severity", "depth_by_type", *LIMIT_SETTINGS))
    diff = _section(data, "diff", ("size_increase_threshold_pct",))
    check = _section(data, "check", ("baseline_path",))

    config = LintConfig()
    config = replace(
        config,
        naming_enabled=bool(naming.get("enabled", True)),
        naming_severity=_severity(naming.get("severity", config.naming_severity), "lint.naming.severity"),
        blueprint_enabled=bool(blueprint.get("enabled", True)),
        blueprint_severity=_severity(blueprint.get("severity", config.blueprint_severity), "lint.blueprint.severity"),
        thresholds=replace(
            Thresholds(),
            **{own: _number(blueprint[name], name) for name, own in LIMIT_SETTINGS.items() if name in blueprint},
        ),
        depth_by_type={k: _number(v, f"depth_by_type.{k}") for k, v in blueprint.get("depth_by_type", {}).items()},
    ).with_prefixes({kind: str(naming[name]) for name, kind in PREFIX_SETTINGS.items() if name in naming})
    budgets = {}
    for kind, limit in _section(data, "budget", data.get("budget", {})).items():
        known = _section(data["budget"], kind, ("max_size",))
        if "max_size" not in known:
            raise ValueError(f"budget.{kind} needs max_size")
        budgets[kind] = _number(limit["max_size"], f"budget.{kind}.max_size")
    return Settings(
        scan=ScanRules(list(scan.get("exclude_paths", [])), parse_ignore_lines(list(ignore_lines))),
        external_roots=tuple(scan.get("external_roots", EXTERNAL_ROOTS)),
        checks=CheckConfig(
            severity={own: _severity(rules[name], f"rules.{name}") for name, own in CHECK_SETTINGS.items() if name in rules},
            lint=config,
            budgets=budgets,
        ),
        size_increase_percent=_number(
            diff.get("size_increase_threshold_pct", SIZE_INCREASE_PERCENT), "size_increase_threshold_pct"
        ),
        baseline_path=check.get("baseline_path"),
    )

import json
import os

import pytest

from stowage import schema
from stowage.operators import checks, rules
from stowage.sources import config, inventory, results

ROWS = [
    ("lint", "error", "blueprint/node-count", "/Game/A", 'node "count" 5 > 3'),
    ("lint", "warn", "naming/prefix", "/Game/B", "line, with comma"),
    ("duplicates", "warn", "duplicate-assets", "no file", "[same-name] x"),
]


@pytest.fixture
def found(spark):
    return spark.createDataFrame(ROWS, schema.VIOLATIONS)


def lines(folder):
    parts = sorted(name for name in os.listdir(folder) if name.startswith("part-"))
    return "".join(open(f"{folder}/{name}").read() for name in parts)


def test_sarif_parts_make_one_document(spark, found, make_assets, tmp_path):
    assets = make_assets(("/Game/A", "Blueprint"), ("/Game/B", "Texture2D"))
    results.write_sarif(checks.sarif_results(found, assets), str(tmp_path / "sarif"), "stowage", "0.2.0")
    document = json.loads(lines(tmp_path / "sarif"))
    (run,) = document["runs"]
    assert document["version"] == "2.1.0" and run["tool"]["driver"]["name"] == "stowage"
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == sorted(r[2] for r in ROWS)
    by_rule = {r["ruleId"]: r for r in run["results"]}
    assert by_rule["blueprint/node-count"]["level"] == "error"
    location = by_rule["naming/prefix"]["locations"][0]["physicalLocation"]["artifactLocation"]
    assert location == {"uri": "Content/B.uasset", "uriBaseId": "%SRCROOT%"}
    assert by_rule["duplicate-assets"]["locations"] == []

    results.write_sarif(checks.sarif_results(found.limit(0), assets), str(tmp_path / "none"), "stowage", "0.2.0")
    assert json.loads(lines(tmp_path / "none"))["runs"][0]["results"] == []


def test_tables_are_read_back_as_they_were(spark, found, tmp_path):
    results.write_csv(found, str(tmp_path / "csv"))
    back = spark.read.option("header", "true").option("escape", '"').schema(schema.VIOLATIONS).csv(str(tmp_path / "csv"))
    assert sorted(map(tuple, back.collect())) == sorted(ROWS)
    results.write_json(found, str(tmp_path / "json"))
    assert sorted(json.loads(x)["rule"] for x in lines(tmp_path / "json").splitlines()) == sorted(r[2] for r in ROWS)


def test_violations_are_saved_and_gate_later_states(spark, found, tmp_path):
    folder = str(tmp_path / "baseline")
    results.save_violations(found, folder, revision="abc")
    saved, summary = results.load_violations(spark, folder)
    assert tuple(summary.first()) == (1, "abc", 1, 2)
    assert tuple(checks.regression_gate(saved, found).first()) == (0, True)
    worse = found.union(spark.createDataFrame([("budget", "error", "budget/texture2d", "/Game/B", "9 > 4")], schema.VIOLATIONS))
    assert tuple(checks.regression_gate(saved, worse).first()) == (1, False)
    more_warnings = found.union(spark.createDataFrame([("lint", "warn", "x", "/Game/C", "m")], schema.VIOLATIONS))
    assert tuple(checks.regression_gate(saved, more_warnings).first()) == (0, True)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        results.load_violations(spark, str(tmp_path / "nothing"))


def test_settings_from_a_dictionary():
    assert config.from_dict({}) == config.Settings()
    data = {
        "scan": {"exclude_paths": ["Content/Dev"], "external_roots": ["/Engine/"]},
        "rules": {"dead-assets": "error", "circular-deps": "off"},
        "lint": {
            "naming": {"severity": "error", "sound_prefix": "A_"},
            "blueprint": {"node_limit": 7, "depth_by_type": {"Blueprint": 15}},
        },
        "budget": {"StaticMesh": {"max_size": 8}},
        "diff": {"size_increase_threshold_pct": 25},
        "check": {"baseline_path": "base"},
    }
    own = config.from_dict(data, ["# note", "!Content/Keep/*"])
    assert own.scan == inventory.ScanRules(["Content/Dev"], [inventory.IgnoreRule("Content/Keep/*", True)])
    assert own.external_roots == ("/Engine/",) and own.baseline_path == "base" and own.size_increase_percent == 25
    assert own.checks.active() == ["dead-assets", "redirectors", "lint", "budget", "duplicates"]
    assert own.checks.severity_of("dead-assets") == "error" and own.checks.budgets == {"StaticMesh": 8}
    assert own.lint.prefixes["SoundWave"] == ["A_"] and own.lint.prefixes["Material"] == ["M_"]
    assert own.lint.thresholds == rules.Thresholds(node_count=7) and own.lint.depth_by_type == {"Blueprint": 15}


@pytest.mark.parametrize(
    "data",
    [
        {"lints": {}},
        {"lint": {"nameing": {}}},
        {"lint": {"naming": {"texture": "T_"}}},
        {"rules": {"lint": "warn"}},
        {"rules": {"redirectors": "loud"}},
        {"budget": {"Texture2D": {"max": 1}}},
        {"budget": {"Texture2D": {"max_size": "4 MB"}}},
        {"lint": {"blueprint": {"node_limit": -1}}},
        {"scan": ["Content"]},
    ],
)
def test_mistakes_in_settings_are_errors(data):
    with pytest.raises(ValueError):
        config.from_dict(data)


def test_loaded_rules_feed_the_lint(spark, make_assets):
    assets = make_assets(("/Game/S_a", "SoundWave"), ("/Game/A_b", "SoundWave"))
    metrics = spark.createDataFrame([], schema.BLUEPRINT_METRICS)
    own = config.from_dict({"lint": {"naming": {"sound_prefix": "A_", "severity": "error"}}})
    assert [(r.severity, r.asset_path) for r in rules.lint(assets, metrics, own.lint).collect()] == [("error", "/Game/S_a")]

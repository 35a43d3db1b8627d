"""Where results go: JSON and CSV tables, SARIF documents, and violation baselines."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage import schema
from stowage.operators import checks
from stowage.operators.stats import positions

# Fixed values of the SARIF format.
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
SARIF_VERSION = "2.1.0"
BASELINE_VERSION = 1


def write_json(rows: DataFrame, folder: str) -> None:
    """One JSON object per line; nulls are written, so every row has every field."""
    rows.write.option("ignoreNullFields", "false").json(folder)


def write_csv(rows: DataFrame, folder: str) -> None:
    """With a header in every part; texts are quoted where they must be."""
    rows.write.option("header", "true").option("escape", '"').csv(folder)


def sarif_document(results: DataFrame, tool: str, version: str) -> DataFrame:
    """The lines of one SARIF document in order: (line, value).

    Results are numbered in a global order that no single task sees, so that every one but the
    first can start with a comma.
    """
    spark = results.sparkSession
    numbered = positions(results, F.asc("rule_id"), F.asc("uri"), F.asc("message"), F.asc("level"))
    objects = checks.sarif_json(numbered, keep=["rank"])
    comma = F.when(F.col("rank") == 1, "").otherwise(",")
    body = objects.select((F.col("rank") + 2).alias("line"), F.concat(comma, F.col("value")).alias("value"))
    rules = checks.sarif_rules(results).agg(
        F.to_json(F.array_sort(F.collect_list(F.struct(F.col("rule_id").alias("id"))))).alias("rules")
    )
    driver = json.dumps({"name": tool, "version": version})[:-1]
    start = f'{{"$schema": "{SARIF_SCHEMA}", "version": "{SARIF_VERSION}", "runs": [{{"tool": {{"driver": {driver}, "rules": '
    head = rules.select(F.lit(1).cast("bigint").alias("line"), F.concat(F.lit(start), "rules", F.lit("}},")).alias("value"))
    middle = spark.createDataFrame([(2, '"results": [')], "line bigint, value string")
    tail = spark.createDataFrame([((1 << 62), "]}]}")], "line bigint, value string")
    return head.unionByName(middle).unionByName(body).unionByName(tail)


def write_sarif(results: DataFrame, folder: str, tool: str, version: str) -> None:
    """The document as text files; read in the order of their names they are the document."""
    sarif_document(results, tool, version).orderBy("line").select("value").write.text(folder)


def save_violations(found: DataFrame, folder: str, revision: str = "") -> None:
    """Keep a state's violations with their totals; the totals come last and make it complete."""
    stored = found.select(*schema.VIOLATIONS.fieldNames())
    stored.write.mode("overwrite").parquet(f"{folder}/violations")
    kept = found.sparkSession.read.schema(schema.VIOLATIONS).parquet(f"{folder}/violations")
    totals = checks.summary(kept).select(
        F.lit(BASELINE_VERSION).alias("version"), F.lit(revision).alias("revision"), "errors", "warnings"
    )
    totals.write.mode("overwrite").parquet(f"{folder}/summary")


def load_violations(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(violations, one-row summary) of a saved state."""
    summary = spark.read.parquet(f"{folder}/summary")
    version = summary.first()["version"]
    if version != BASELINE_VERSION:
        raise ValueError(f"violations of version {version} cannot be read; known: {BASELINE_VERSION}")
    return spark.read.schema(schema.VIOLATIONS).parquet(f"{folder}/violations"), summary

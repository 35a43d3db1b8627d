"""Times the headline queries on an ingested catalogue; prints one JSON line.

`ingest` is the time to derive and store the catalogue tables from the raw ones, `analyse` the
part of it that stores the graph: edges, vertices with degrees, cycle members. The queries then
run against the stored tables, each evaluated in full into a sink that discards rows.
Everything runs twice in one session: the first pass includes starting up the JVM's code, the
second is what a running session delivers. Both are reported, the second is the headline.
"""

from __future__ import annotations

import json
import os
import time

from stowage.plans.catalogue import Catalogue
from stowage.plans.queries import QUERIES
from stowage.session import local_session

TABLES = [
    "assets",
    "deps",
    "blueprint_metrics",
    "texture_metadata",
    "prev_assets",
    "prev_deps",
    "prev_metrics",
    "index_files",
    "disk_files",
    "pkg_events",
    "edges",
    "nodes",
    "members",
    "named",
    "links",
    "dag",
    "ids",
]
HEADLINE = [
    "dead_assets",
    "dead_by_type",
    "impact",
    "impact_counts",
    "find_refs",
    "deps_closure",
    "cycles",
    "material_chain",
    "stats_by_type",
    "stats_totals",
    "degrees",
    "dup_groups",
    "find_type_size",
    "export_table",
    "blueprint_rank",
    "lint_all",
    "budget",
    "check_violations",
    "gate",
    "size_increases",
    "asset_diff",
    "regressions",
    "new_dead",
    "changed_files",
    "ingest_delta_counts",
    "health_summary",
    "debounced_events",
]


def run(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def one_pass(spark, folder: str) -> dict[str, float]:
    seconds: dict[str, float] = {}
    begin = time.perf_counter()
    catalogue = Catalogue.derive(spark, folder)
    for table in TABLES:
        if table == "edges":
            analysis = time.perf_counter()
        catalogue.table(table)
    seconds["ingest"] = round(time.perf_counter() - begin, 3)
    seconds["analyse"] = round(time.perf_counter() - analysis, 3)
    for name in HEADLINE:
        fresh = catalogue.reopen()
        begin = time.perf_counter()
        run(QUERIES[name](fresh))
        seconds[name] = round(time.perf_counter() - begin, 3)
    return seconds


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session("stowage-bench", cores=cores, shuffle_partitions=cores)
    first = one_pass(spark, folder)
    second = one_pass(spark, folder)
    report = {
        "metric": "headline queries, total of the second pass",
        "value": round(sum(v for k, v in second.items() if k != "analyse"), 3),
        "unit": "sec",
        "queries": second,
        "first_pass": {"value": round(sum(v for k, v in first.items() if k != "analyse"), 3), "queries": first},
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(report))
    spark.stop()


if __name__ == "__main__":
    main()

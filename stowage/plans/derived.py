"""A catalogue derived from the TPC-H-like tables, in SQL that Spark and DuckDB both run.

Parts, customers, suppliers, nations, regions and orders become assets; order lines and
foreign keys become references. Rows therefore grow with the given tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Columns read from the given tables; anything else is pruned at the scan.
BASE_TABLES = {
    "region": "r_regionkey int",
    "nation": "n_nationkey int, n_regionkey int",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "supplier": "s_suppkey bigint",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_linenumber int",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string",
}

VIEWS = {
    "part_assets": """
        SELECT p_partkey, p_size,
               CASE WHEN p_partkey % 60 IN (40, 41, 42) THEN '/Game/Maps/__ExternalActors__/'
                    ELSE '/Game/Parts/' || replace(p_brand, '#', '_') || '/' END
               || 'P' || CAST(p_partkey AS STRING) || '/'
               || CASE WHEN p_partkey % 13 = 0 THEN '' ELSE 'T_' END || replace(p_name, ' ', '_') AS asset_path,
               CASE WHEN p_partkey % 97 = 0 THEN 'ObjectRedirector' WHEN p_type = 'LARGE' THEN 'StaticMesh'
                    WHEN p_type = 'PROMO' THEN 'SoundWave' WHEN p_type = 'SMALL' THEN 'MetaData'
                    ELSE 'Texture2D' END AS asset_type,
               CAST(p_size AS BIGINT) * 262144 AS file_size
        FROM part""",
    "cust_assets": """
        SELECT c_custkey, c_nationkey,
               '/Game/Actors/' || c_mktsegment || '/'
               || CASE WHEN c_custkey % 7 = 0 THEN 'Customer_' ELSE 'BP_Customer_' END
               || CAST(c_custkey AS STRING) AS asset_path,
               CAST(1024 * (c_custkey % 4096) AS BIGINT) AS file_size
        FROM customer""",
    "supp_assets": """
        SELECT s_suppkey,
               '/Game/Materials/' || CASE WHEN s_suppkey % 4 = 0 THEN 'M_' ELSE 'MI_' END
               || CAST(s_suppkey AS STRING) AS asset_path,
               CASE WHEN s_suppkey % 4 = 0 THEN 'Material' ELSE 'MaterialInstance' END AS asset_type
        FROM supplier""",
    "asset_list": """
        SELECT asset_path, asset_type, file_size FROM part_assets
        UNION ALL SELECT asset_path, 'Blueprint', file_size FROM cust_assets
        UNION ALL SELECT asset_path, asset_type, CAST(32768 AS BIGINT) FROM supp_assets
        UNION ALL SELECT '/Game/World/DT_' || CAST(n_nationkey AS STRING), 'DataTable', CAST(65536 AS BIGINT) FROM nation
        UNION ALL SELECT '/Game/World/L_' || CAST(r_regionkey AS STRING), 'World', CAST(1048576 AS BIGINT) FROM region
        UNION ALL SELECT '/Game/Orders/O_' || CAST(o_orderkey AS STRING), 'DataAsset', CAST(4096 AS BIGINT) FROM orders""",
    "assets": """
        SELECT asset_path, 'Content/' || substr(asset_path, 7) || '.uasset' AS file_path, asset_type, file_size,
               CAST(1700000000 + length(asset_path) * 60 AS BIGINT) AS last_modified
        FROM asset_list""",
    "raw_deps": """
        SELECT '/Game/Orders/O_' || CAST(o_orderkey AS STRING) AS from_path, c.asset_path AS to_path, false AS is_soft
        FROM orders JOIN cust_assets c ON o_custkey = c.c_custkey
        UNION ALL
        SELECT '/Game/Orders/O_' || CAST(l_orderkey AS STRING),
               CASE WHEN p_partkey % 5 = 0 THEN '/Game/Moved/P' || CAST(p_partkey AS STRING) ELSE p.asset_path END,
               l_linenumber >= 4
        FROM lineitem JOIN part_assets p ON l_partkey = p.p_partkey
        UNION ALL
        SELECT asset_path, '/Game/World/DT_' || CAST(c_nationkey AS STRING), false FROM cust_assets
        UNION ALL
        SELECT '/Game/World/DT_' || CAST(n_nationkey AS STRING), '/Game/World/L_' || CAST(n_regionkey AS STRING), false
        FROM nation
        UNION ALL
        SELECT a.asset_path, b.asset_path, false
        FROM supp_assets a JOIN supp_assets b ON b.s_suppkey = a.s_suppkey - 1 WHERE a.s_suppkey % 4 <> 0
        UNION ALL
        SELECT a.asset_path, b.asset_path, true
        FROM supp_assets a JOIN supp_assets b ON b.s_suppkey = a.s_suppkey + 1 WHERE a.s_suppkey % 8 = 0
        UNION ALL
        SELECT a.asset_path, b.asset_path, false
        FROM part_assets a JOIN part_assets b
          ON b.p_partkey = CASE WHEN a.p_partkey % 20 < 2 THEN a.p_partkey + 1 ELSE a.p_partkey - 2 END
        WHERE a.p_partkey % 20 IN (0, 1, 2)
        UNION ALL
        SELECT '/Game/Orders/O_' || CAST(o_orderkey AS STRING), '/Engine/Basic/E_' || CAST(o_orderkey % 5 AS STRING), false
        FROM orders WHERE o_orderkey % 10 = 0
        UNION ALL
        SELECT '/Game/Orders/O_' || CAST(o_orderkey AS STRING), '/Game/Missing/X_' || CAST(o_orderkey % 50 AS STRING), true
        FROM orders WHERE o_orderkey % 25 = 0""",
    "deps": """
        SELECT from_path, to_path, min(is_soft) AS is_soft FROM raw_deps GROUP BY from_path, to_path""",
    "blueprint_metrics": """
        SELECT c.asset_path, COUNT(l.l_orderkey) * 3 AS node_count,
               COUNT(DISTINCT o.o_orderstatus) AS event_tick_count, COUNT(DISTINCT o.o_orderkey) AS cast_count,
               CAST(COALESCE(MAX(l.l_linenumber), 0) * 3 AS BIGINT) AS dependency_depth
        FROM cust_assets c LEFT JOIN orders o ON o.o_custkey = c.c_custkey
        LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY c.asset_path""",
    "texture_metadata": """
        SELECT asset_path,
               CASE p_partkey % 4 WHEN 1 THEN 'TC_Default' WHEN 2 THEN 'TC_Normalmap' WHEN 3 THEN 'TC_None' END AS compression,
               CASE p_partkey % 3 WHEN 1 THEN 'TMGS_NoMipmaps' WHEN 2 THEN 'TMGS_FromTextureGroup' END AS mip_gen,
               CASE p_partkey % 5 WHEN 0 THEN 'TEXTUREGROUP_World' ELSE 'TEXTUREGROUP_Character' END AS texture_group
        FROM part_assets WHERE asset_type = 'Texture2D'""",
    "texture_details": """
        SELECT m.asset_path, compression, mip_gen, texture_group, p_partkey % 2 = 0 AS has_alpha,
               CAST(CASE WHEN p_partkey % 7 <> 0 THEN p_size * 16 END AS BIGINT) AS source_x,
               CAST(p_size * 32 AS BIGINT) AS source_y
        FROM texture_metadata m JOIN part_assets p ON p.asset_path = m.asset_path""",
    "mesh_details": """
        SELECT asset_path, p_partkey % 3 + 1 AS lod_count, CAST(p_size * 700 AS BIGINT) AS triangle_count_lod0,
               CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 2 = 0 END AS has_collision, p_partkey % 5 = 0 AS has_nanite,
               CAST(CASE WHEN p_partkey % 11 <> 0 THEN p_size * 32 END AS BIGINT) AS lightmap_resolution
        FROM part_assets WHERE asset_type = 'StaticMesh'""",
    "sound_details": """
        SELECT asset_path, file_size, p_size AS duration, p_partkey % 2 + 1 AS num_channels,
               CASE WHEN p_partkey % 4 = 0 THEN 96000 ELSE 48000 END AS sample_rate,
               CASE WHEN p_partkey % 3 = 0 THEN 100 WHEN p_partkey % 3 = 1 THEN 60 END AS compression_quality,
               p_partkey % 5 = 0 AS is_streaming
        FROM part_assets WHERE asset_type = 'SoundWave'""",
    "material_details": """
        SELECT asset_path, s_suppkey % 24 AS texture_sample_count, s_suppkey % 4 AS instance_chain_depth,
               CASE WHEN s_suppkey % 3 = 0 THEN 'MSM_Subsurface' ELSE 'MSM_DefaultLit' END AS shading_model,
               CASE WHEN s_suppkey % 2 = 0 THEN 'BLEND_Opaque' WHEN s_suppkey % 5 <> 0 THEN 'BLEND_Translucent' END AS blend_mode,
               s_suppkey % 7 < 3 AS two_sided, s_suppkey % 5 < 2 AS uses_wpo
        FROM supp_assets""",
    "table_details": """
        SELECT '/Game/World/DT_' || CAST(n_nationkey AS STRING) AS asset_path, 'DataTable' AS asset_type,
               COUNT(c_custkey) * 200 AS row_count,
               CASE WHEN n_nationkey % 4 <> 0 THEN '/Script/Row_' || CAST(n_nationkey AS STRING) END AS row_struct
        FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey""",
    "prev_assets": """
        SELECT asset_path, CASE WHEN length(asset_path) % 17 = 0 THEN 'DataAsset' ELSE asset_type END AS asset_type,
               CASE WHEN length(asset_path) % 3 = 0 THEN CAST(floor(file_size / 2) AS BIGINT) ELSE file_size END AS file_size
        FROM assets WHERE length(asset_path) % 11 <> 0
        UNION ALL
        SELECT '/Game/Old/O_' || CAST(n_nationkey AS STRING), 'Texture2D', CAST(9437184 AS BIGINT) FROM nation""",
    "prev_deps": """
        SELECT from_path, to_path, is_soft FROM deps WHERE (length(from_path) + length(to_path)) % 13 <> 0
        UNION ALL
        SELECT '/Game/World/DT_' || CAST(n_nationkey AS STRING), '/Game/Old/O_' || CAST(n_nationkey AS STRING), false
        FROM nation
        UNION ALL
        SELECT '/Game/World/DT_' || CAST(n_nationkey AS STRING), '/Game/Orders/O_' || CAST(n_nationkey AS STRING), false
        FROM nation""",
    "prev_metrics": """
        SELECT asset_path, node_count - length(asset_path) % 4 AS node_count, event_tick_count, cast_count, dependency_depth
        FROM blueprint_metrics WHERE length(asset_path) % 11 <> 0""",
    "pkg_events": """
        SELECT event_id, ts, '/Game/Orders/O_' || CAST(user_id AS STRING) AS asset_path,
               CASE event_type WHEN 'signup' THEN 'Created' WHEN 'error' THEN 'Deleted' ELSE 'Changed' END AS kind
        FROM events""",
    "scan_history": """
        SELECT CAST(EXTRACT(DAY FROM ts) AS BIGINT) AS id,
               CAST(1704067200 + (EXTRACT(DAY FROM ts) - 1) * 86400 AS BIGINT) AS scanned_at,
               COUNT(*) AS asset_count, CAST(SUM(event_id) AS BIGINT) AS total_size,
               CAST(SUM(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS BIGINT) AS blueprint_count,
               AVG(user_id) AS avg_node_count,
               CAST(SUM(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS texture_count,
               CAST(SUM(CASE WHEN event_type = 'view' THEN event_id ELSE 0 END) AS BIGINT) AS texture_size
        FROM events GROUP BY EXTRACT(DAY FROM ts)""",
    "baselines": """
        SELECT 'main' AS name, id AS snapshot_id, scanned_at + 120 AS saved_at FROM scan_history WHERE id = 3
        UNION ALL SELECT 'first', id, scanned_at + 240 FROM scan_history WHERE id = 1
        UNION ALL SELECT 'sprint', id, scanned_at + 900 FROM scan_history WHERE id = 17
        UNION ALL SELECT 'newest', id, scanned_at - 60 FROM scan_history WHERE id = (SELECT max(id) FROM scan_history)""",
    "baseline_errors": """
        SELECT name, snapshot_id, saved_at, blueprint_count AS errors
        FROM baselines JOIN scan_history ON snapshot_id = id""",
    "properties": """
        SELECT 'schema_version' AS key, CAST(min(r_regionkey) + 1 AS STRING) AS value FROM region
        UNION ALL SELECT 'writer_version', '0.' || CAST(min(n_nationkey) + 1 AS STRING) || '.0' FROM nation""",
    "index_files": """
        SELECT file_path, last_modified FROM assets""",
    "disk_files": """
        SELECT file_path, last_modified + CASE WHEN length(file_path) % 5 = 0 THEN 30
                                               WHEN length(file_path) % 7 = 0 THEN -30 ELSE 0 END AS mtime
        FROM index_files WHERE length(file_path) % 11 <> 0
        UNION ALL
        SELECT 'Content/New/N_' || CAST(n_nationkey AS STRING) || '.umap', CAST(1800000000 AS BIGINT) FROM nation""",
}


# Large tables that others are derived from: read from the catalogue's store, not derived once more.
STORED = ("assets", "deps", "blueprint_metrics")


def _words(sql: str) -> set[str]:
    return set(sql.replace("(", " ").replace(")", " ").replace(",", " ").split())


def needed(sql: str, views: dict[str, str]) -> list[str]:
    """Names of `views` that `sql` uses, directly or through others, in definition order."""
    words = _words(sql)
    found: set[str] = set()
    waiting = [name for name in views if name in words]
    while waiting:
        name = waiting.pop()
        if name not in found:
            found.add(name)
            inner = _words(views[name])
            waiting += [other for other in views if other in inner and other != name]
    return [name for name in views if name in found]


def stored_parts(view: str) -> list[str]:
    """The tables of `STORED` that `view` is derived from."""
    open_ = {name: text for name, text in VIEWS.items() if name == view or name not in STORED}
    text = " ".join(VIEWS[name] for name in needed(f" {view} ", open_))
    return [name for name in STORED if name != view and name in _words(text)]


def load(spark: SparkSession, folder: str, view: str, stored: dict[str, DataFrame] | None = None) -> DataFrame:
    """One view of the derived catalogue over the Parquet tables in `folder`; `stored` views are not derived again."""
    stored = stored or {}
    chain = needed(f" {view} ", {name: text for name, text in VIEWS.items() if name not in stored})
    text = " ".join(VIEWS[name] for name in chain)
    # The given tables go in as arguments, under names that no view of the caller has to give way to.
    given = {
        f"given_{table}": spark.read.schema(BASE_TABLES[table]).parquet(f"{folder}/{table}.parquet")
        for table in needed(text, BASE_TABLES)
    } | {f"given_{name}": table for name, table in stored.items()}
    ctes = ", ".join(
        [f"{name.removeprefix('given_')} AS (SELECT * FROM {{{name}}})" for name in given]
        + [f"{name} AS ({VIEWS[name]})" for name in chain]
    )
    return spark.sql(f"WITH {ctes} SELECT * FROM {view}", **given)

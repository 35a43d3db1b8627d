"""The same questions in plain SQL, for checking the Spark results with DuckDB."""

from __future__ import annotations

from stowage.plans.derived import VIEWS, needed

# Helper views on top of the derived catalogue.
HELPERS = {
    "iedges": """
        SELECT * FROM deps WHERE NOT starts_with(to_path, '/Engine/') AND NOT starts_with(to_path, '/Script/')""",
    "prev_iedges": """
        SELECT * FROM prev_deps WHERE NOT starts_with(to_path, '/Engine/') AND NOT starts_with(to_path, '/Script/')""",
    "verts": """
        SELECT asset_path, asset_type, file_size, false AS is_placeholder FROM assets
        UNION ALL
        SELECT DISTINCT p, '', CAST(0 AS BIGINT), true
        FROM (SELECT to_path AS p FROM iedges UNION SELECT from_path FROM iedges)
        WHERE p NOT IN (SELECT asset_path FROM assets)""",
    "prev_verts": """
        SELECT asset_path, asset_type, file_size, false AS is_placeholder FROM prev_assets
        UNION ALL
        SELECT DISTINCT p, '', CAST(0 AS BIGINT), true
        FROM (SELECT to_path AS p FROM prev_iedges UNION SELECT from_path FROM prev_iedges)
        WHERE p NOT IN (SELECT asset_path FROM prev_assets)""",
    "not_actor": """
        SELECT * FROM verts WHERE NOT contains(asset_path, '/__ExternalActors__/')
                              AND NOT contains(asset_path, '/__ExternalObjects__/')""",
    "prev_not_actor": """
        SELECT * FROM prev_verts WHERE NOT contains(asset_path, '/__ExternalActors__/')
                                   AND NOT contains(asset_path, '/__ExternalObjects__/')""",
    "dead_all": """
        SELECT * FROM not_actor WHERE asset_path NOT IN (SELECT to_path FROM iedges)""",
    "prev_dead_all": """
        SELECT * FROM prev_not_actor WHERE asset_path NOT IN (SELECT to_path FROM prev_iedges)""",
    "dead": """
        SELECT * FROM dead_all WHERE asset_type NOT IN ('MetaData', 'AssetImportData', 'BillboardComponent',
            'ActorFolder', 'ArrowComponent', 'BlueprintGeneratedClass', 'AnimCurveMetaData', 'BodySetup')""",
    "prev_dead": """
        SELECT * FROM prev_dead_all WHERE asset_type NOT IN ('MetaData', 'AssetImportData', 'BillboardComponent',
            'ActorFolder', 'ArrowComponent', 'BlueprintGeneratedClass', 'AnimCurveMetaData', 'BodySetup')""",
    # Recursion: every pair (a, b) where a reaches b in one or more steps.
    "closure": """
        SELECT from_path AS a, to_path AS b FROM iedges
        UNION SELECT closure.a, iedges.to_path FROM closure JOIN iedges ON closure.b = iedges.from_path""",
    "prev_closure": """
        SELECT from_path AS a, to_path AS b FROM prev_iedges
        UNION SELECT prev_closure.a, prev_iedges.to_path
        FROM prev_closure JOIN prev_iedges ON prev_closure.b = prev_iedges.from_path""",
    "comp": """
        SELECT x.a AS asset_path, least(min(x.b), x.a) AS component
        FROM closure x JOIN closure y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a""",
    "prev_comp": """
        SELECT x.a AS asset_path, least(min(x.b), x.a) AS component
        FROM prev_closure x JOIN prev_closure y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a""",
    "reported": """
        SELECT component, count(*) AS size, string_agg(asset_path, '|' ORDER BY asset_path) AS members FROM comp
        GROUP BY component HAVING NOT bool_or(contains(asset_path, '/__ExternalActors__/')
                                           OR contains(asset_path, '/__ExternalObjects__/'))""",
    "prev_reported": """
        SELECT component, count(*) AS size, string_agg(asset_path, '|' ORDER BY asset_path) AS members FROM prev_comp
        GROUP BY component HAVING NOT bool_or(contains(asset_path, '/__ExternalActors__/')
                                           OR contains(asset_path, '/__ExternalObjects__/'))""",
    # Distance from b back to a by walks that never return to a vertex: loops end by themselves.
    "layers": """
        SELECT asset_path AS root, asset_path AS vertex, 0 AS depth, [asset_path] AS been FROM layer_roots
        UNION ALL SELECT layers.root, iedges.from_path, layers.depth + 1, list_append(layers.been, iedges.from_path)
        FROM layers JOIN iedges ON layers.vertex = iedges.to_path WHERE NOT list_contains(layers.been, iedges.from_path)""",
    "back": """
        SELECT root, vertex, min(depth) AS depth FROM layers GROUP BY root, vertex HAVING root <> vertex""",
    "named": "SELECT *, split_part(asset_path, '/', -1) AS name FROM assets",
    "tex_groups": """
        SELECT name, file_size AS each_bytes, count(*) AS copies, CAST(sum(file_size) AS BIGINT) AS total_bytes,
               min(asset_path) AS first_path
        FROM named WHERE asset_type = 'Texture2D' GROUP BY name, file_size HAVING count(*) >= 2""",
    "name_groups": """
        SELECT name, count(*) AS copies, CAST(sum(file_size) AS BIGINT) AS total_bytes, min(asset_path) AS first_path,
               CASE WHEN count(DISTINCT asset_type) = 1 THEN min(asset_type) END AS shared_type,
               array_to_string(list_sort(list(DISTINCT asset_type)), ',') AS types
        FROM named GROUP BY name HAVING count(*) >= 2""",
    "dup_report": """
        SELECT 'texture-dup' AS kind, name, copies, total_bytes, first_path, 'Texture2D' AS shared_type, 'Texture2D' AS types
        FROM tex_groups
        UNION ALL SELECT 'same-name', * FROM name_groups WHERE name NOT IN (SELECT name FROM tex_groups)""",
    "prefixes": """
        SELECT * FROM (VALUES ('Texture2D', ['T_']), ('Material', ['M_']), ('StaticMesh', ['SM_']), ('Blueprint', ['BP_']),
            ('SkeletalMesh', ['SKM_', 'SK_']), ('AnimBlueprint', ['ABP_']), ('UserWidget', ['WBP_']),
            ('SoundWave', ['SW_', 'S_']), ('NiagaraSystem', ['NS_']), ('NiagaraEmitter', ['NE_', 'NS_']))
            t(asset_type, allowed)""",
    "budgets": "SELECT * FROM (VALUES ('Texture2D', 4194304), ('StaticMesh', 8388608)) t(asset_type, max_size)",
    "v_naming": """
        SELECT 'lint' AS "check", 'warn' AS severity, 'naming/prefix' AS rule, asset_path,
               'asset `' || name || '` should start with '
               || CASE WHEN len(allowed) = 1 THEN '`' || allowed[1] || '`'
                       ELSE 'one of: ' || array_to_string(['`' || p || '`' for p in allowed], ', ') END AS message
        FROM named JOIN prefixes USING (asset_type)
        WHERE NOT list_bool_or([starts_with(name, p) for p in allowed])""",
    "v_blueprint": """
        SELECT 'lint' AS "check", 'error' AS severity, rule, asset_path,
               label || ' ' || value || ' exceeds limit ' || bound AS message
        FROM (
            SELECT asset_path, 'blueprint/node-count' AS rule, 'node count' AS label, node_count AS value, 200 AS bound
            FROM blueprint_metrics
            UNION ALL SELECT asset_path, 'blueprint/event-tick', 'event tick count', event_tick_count, 1 FROM blueprint_metrics
            UNION ALL SELECT asset_path, 'blueprint/cast-count', 'cast count', cast_count, 10 FROM blueprint_metrics
            UNION ALL SELECT asset_path, 'blueprint/dependency-depth', 'dependency depth', dependency_depth, 20
            FROM blueprint_metrics)
        WHERE value > bound""",
    "prev_v_blueprint": """
        SELECT rule, asset_path
        FROM (
            SELECT asset_path, 'blueprint/node-count' AS rule, node_count AS value, 200 AS bound FROM prev_metrics
            UNION ALL SELECT asset_path, 'blueprint/event-tick', event_tick_count, 1 FROM prev_metrics
            UNION ALL SELECT asset_path, 'blueprint/cast-count', cast_count, 10 FROM prev_metrics
            UNION ALL SELECT asset_path, 'blueprint/dependency-depth', dependency_depth, 20 FROM prev_metrics)
        WHERE value > bound AND asset_path IN (SELECT asset_path FROM prev_assets)""",
    "over": """
        SELECT asset_path, name, asset_type, file_size, CAST(max_size AS BIGINT) AS max_size,
               file_size - max_size AS excess_bytes
        FROM named JOIN budgets USING (asset_type) WHERE file_size > max_size""",
    "v_lint_budget": """
        SELECT 'lint' AS "check", 'warn' AS severity, 'budget/' || lower(asset_type) AS rule, asset_path,
               asset_type || ' ' || name || ' exceeds size limit: ' || printf('%.1f', file_size / 1048576.0::DOUBLE)
               || ' MB > ' || printf('%.1f', max_size / 1048576.0::DOUBLE) || ' MB' AS message
        FROM over""",
    "v_lint_report": """
        SELECT * FROM v_naming UNION ALL SELECT * FROM v_blueprint UNION ALL SELECT * FROM v_lint_budget""",
    "v_budget": """
        SELECT 'budget' AS "check", 'error' AS severity, 'budget/' || lower(asset_type) AS rule, asset_path,
               printf('%.1f MB', file_size / 1048576.0::DOUBLE) || ' > '
               || printf('%.1f MB', max_size / 1048576.0::DOUBLE) AS message
        FROM over""",
    "v_cycles": """
        SELECT 'cycles' AS "check", 'error' AS severity, 'circular-deps' AS rule, asset_path,
               'cycle of ' || size || ' assets from ' || component AS message
        FROM comp JOIN reported USING (component)""",
    "v_dead": """
        SELECT 'dead-assets' AS "check", 'warn' AS severity, 'dead-assets' AS rule, asset_path,
               'unreferenced asset' AS message FROM dead""",
    "v_redirectors": """
        SELECT 'redirectors' AS "check", 'warn' AS severity, 'redirectors' AS rule, asset_path,
               'unresolved redirector' AS message FROM assets WHERE asset_type = 'ObjectRedirector'""",
    "v_duplicates": """
        SELECT 'duplicates' AS "check", 'warn' AS severity, 'duplicate-assets' AS rule, name AS asset_path,
               '[' || kind || '] ' || name AS message FROM dup_report""",
    "v_all": """
        SELECT * FROM v_dead UNION ALL SELECT * FROM v_cycles UNION ALL SELECT * FROM v_redirectors
        UNION ALL SELECT * FROM v_naming UNION ALL SELECT * FROM v_blueprint UNION ALL SELECT * FROM v_budget
        UNION ALL SELECT * FROM v_duplicates""",
    "check_rows": """
        SELECT c."check",
               CASE WHEN c."check" <> 'lint' THEN c.severity
                    WHEN EXISTS (SELECT 1 FROM v_all v WHERE v."check" = 'lint' AND v.severity = 'error') THEN 'error'
                    ELSE 'warn' END AS severity,
               CASE WHEN c."check" = 'cycles' THEN (SELECT count(*) FROM reported)
                    ELSE (SELECT count(*) FROM v_all v WHERE v."check" = c."check") END AS finding_count
        FROM (VALUES ('dead-assets', 'warn'), ('cycles', 'error'), ('redirectors', 'warn'), ('lint', 'error'),
                     ('budget', 'error'), ('duplicates', 'warn')) c("check", severity)""",
    "errors_now": """
        SELECT 'redirectors' AS "check", 'error' AS severity, rule, asset_path, message FROM v_redirectors
        UNION ALL SELECT * FROM v_blueprint UNION ALL SELECT * FROM v_budget""",
    "errors_before": """
        SELECT 'redirectors' AS "check", 'error' AS severity, 'redirectors' AS rule, asset_path,
               'unresolved redirector' AS message FROM prev_assets WHERE asset_type = 'ObjectRedirector'
        UNION ALL
        SELECT 'budget', 'error', 'budget/' || lower(asset_type), asset_path,
               printf('%.1f MB', file_size / 1048576.0::DOUBLE) || ' > ' || printf('%.1f MB', max_size / 1048576.0::DOUBLE)
        FROM prev_assets JOIN budgets USING (asset_type) WHERE file_size > max_size
        UNION ALL
        SELECT 'lint', 'error', rule, asset_path, NULL FROM prev_v_blueprint""",
    "regressed": """
        SELECT * FROM errors_now WHERE (rule, asset_path) NOT IN (SELECT (rule, asset_path) FROM errors_before)""",
    "scores": """
        SELECT asset_path, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings,
               CAST(greatest(100 - least(coalesce(errors, 0) * 20, 60) - least(coalesce(warnings, 0) * 5, 20)
                    - CASE WHEN file_size > 5 * max_size THEN 20 WHEN file_size > 2 * max_size THEN 10 ELSE 0 END, 0)
                    AS BIGINT) AS score
        FROM assets LEFT JOIN budgets USING (asset_type)
        LEFT JOIN (SELECT asset_path, count(*) FILTER (severity = 'error') AS errors,
                          count(*) FILTER (severity = 'warn') AS warnings
                   FROM (SELECT * FROM v_naming UNION ALL SELECT * FROM v_blueprint) GROUP BY asset_path)
        USING (asset_path)""",
    "labelled": """
        SELECT *, CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 70 THEN 'Good' WHEN score >= 50 THEN 'Fair'
                       ELSE 'Poor' END AS label FROM scores""",
    "hops": """
        SELECT i.from_path AS vertex, min(i.to_path) AS next
        FROM iedges i JOIN assets f ON f.asset_path = i.from_path AND f.asset_type = 'MaterialInstance'
        JOIN assets t ON t.asset_path = i.to_path AND t.asset_type IN ('Material', 'MaterialInstance') GROUP BY i.from_path""",
    "chain_walk": """
        SELECT vertex, next AS spot, [vertex] AS seen, 1 AS depth FROM hops
        UNION ALL
        SELECT c.vertex, h.next, list_append(c.seen, c.spot), c.depth + 1
        FROM chain_walk c JOIN hops h ON h.vertex = c.spot WHERE NOT list_contains(c.seen, c.spot)""",
    "out_deg": "SELECT from_path AS asset_path, count(*) AS n FROM iedges GROUP BY from_path",
    "in_deg": "SELECT to_path AS asset_path, count(*) AS n FROM iedges GROUP BY to_path",
    "newest30": """
        SELECT h.id, h.scanned_at, asset_count AS assets, total_size AS file_size_total,
               (SELECT b.errors FROM baseline_errors b WHERE abs(b.saved_at - h.scanned_at) <= 300
                ORDER BY abs(b.saved_at - h.scanned_at), b.saved_at, b.name LIMIT 1) AS violations
        FROM (SELECT * FROM scan_history ORDER BY scanned_at DESC, id DESC LIMIT 30) h""",
}

IS_PREFIX_OUT = "(starts_with(file_path, 'Content/Parts/Brand_1/') OR starts_with(file_path, 'Content/Maps/'))"
IS_GLOB_OUT = (
    "(regexp_full_match(file_path, 'Content/Parts/Brand_2[^/]/.*')"
    " OR regexp_full_match(file_path, '(/?|.*/)T_red_[^/]*[.]uasset'))"
)
IS_IGNORED = """
    CASE WHEN regexp_full_match(file_path, '(/?|.*/)T_blue_[^/]*') THEN false
         WHEN regexp_full_match(file_path, 'Content/Parts/[^/]*/P1[^/]*/[^/]*[.]uasset') THEN true
         WHEN starts_with(file_path, 'Content/Parts/Brand_12/') THEN false
         WHEN starts_with(file_path, 'Content/Parts/Brand_1') THEN true
         ELSE false END"""
SIZE_TEXT = """
    CASE WHEN file_size >= 1048576 THEN printf('%.1f MB', file_size / 1048576.0::DOUBLE)
         WHEN file_size >= 1024 THEN printf('%.1f KB', file_size / 1024.0::DOUBLE)
         ELSE file_size || ' B' END"""
FOLDER = """
    CASE WHEN length(asset_path) - length(replace(asset_path, '/', '')) >= 4
         THEN array_to_string(string_split(asset_path, '/')[1:4], '/') || '/'
         WHEN length(asset_path) - length(replace(asset_path, '/', '')) = 3
         THEN array_to_string(string_split(asset_path, '/')[1:3], '/') || '/'
         ELSE asset_path END"""
STAMP = "CASE WHEN length(asset_path) > 30 THEN last_modified * 1000 ELSE last_modified END"
CLAMPED = f"make_timestamp(least({STAMP}, 253402300799) * 1000000)"


def over_layers(root_types: str, query: str) -> str:
    """Query over `back`, walking from all assets of the given types."""
    roots = f"layer_roots AS (SELECT asset_path FROM assets WHERE asset_type IN ({root_types})), "
    return roots + "|" + query


FORWARD = """
    fwd AS (SELECT asset_path AS root, asset_path AS vertex, 0 AS depth, [asset_path] AS been FROM assets
            WHERE asset_type IN ('DataAsset', 'Blueprint', 'MaterialInstance')
            UNION ALL SELECT fwd.root, iedges.to_path, fwd.depth + 1, list_append(fwd.been, iedges.to_path)
            FROM fwd JOIN iedges ON fwd.vertex = iedges.from_path WHERE NOT list_contains(fwd.been, iedges.to_path)),
    first_met AS (SELECT root, vertex, min(depth) AS depth FROM fwd GROUP BY root, vertex), |"""


def tree_cte(root_types: str, at: str, to: str) -> str:
    """`tree`: every edge reached from a root, with the depth of its ends and whether it closes a cycle."""
    return f"""
    walk AS (SELECT asset_path AS root, asset_path AS vertex, 0 AS depth, [asset_path] AS been
             FROM assets WHERE asset_type IN ({root_types})
             UNION ALL
             SELECT w.root, i.{to}, w.depth + 1, list_append(w.been, i.{to})
             FROM walk w JOIN iedges i ON i.{at} = w.vertex WHERE NOT list_contains(w.been, i.{to})),
    met AS (SELECT root, vertex, min(depth) AS depth FROM walk GROUP BY root, vertex),
    tree AS (SELECT m.root, m.vertex AS parent, i.{to} AS asset_path, m.depth + 1 AS depth, c.depth AS met_at,
                    coalesce(i.from_path = i.to_path OR (c.depth <= m.depth AND p.component = k.component), false) AS is_cycle
             FROM met m JOIN iedges i ON i.{at} = m.vertex
             JOIN met c ON c.root = m.root AND c.vertex = i.{to}
             LEFT JOIN comp p ON p.asset_path = m.vertex LEFT JOIN comp k ON k.asset_path = i.{to}), |"""


TEXTURE_RULES = """
    SELECT 'lint' AS "check", severity, rule, asset_path, rule AS message FROM (
        SELECT asset_path, 'warn' AS severity, 'lint/texture/non-power-of-two' AS rule FROM texture_details
        WHERE source_x <= 0 OR bit_count(source_x) <> 1 OR source_y <= 0 OR bit_count(source_y) <> 1
        UNION ALL SELECT asset_path, 'warn', 'lint/texture/missing-mip-maps' FROM texture_details
        WHERE mip_gen = 'TMGS_NoMipmaps' AND source_x > 64 AND source_y > 64
        UNION ALL SELECT asset_path, 'error', 'lint/texture/uncompressed' FROM texture_details
        WHERE compression = 'TC_None' AND source_x > 512 AND source_y > 512
        UNION ALL SELECT asset_path, 'warn', 'lint/texture/has-alpha-but-opaque' FROM texture_details
        WHERE has_alpha AND texture_group = 'TEXTUREGROUP_World')"""

OVERRIDE_LINT = """
    SELECT 'lint' AS "check", 'error' AS severity, 'naming/prefix' AS rule, asset_path,
           'asset `' || name || '` should start with '
           || CASE asset_type WHEN 'Blueprint' THEN '`BP_`' WHEN 'Material' THEN '`M_`' WHEN 'SoundWave' THEN '`A_`'
                              ELSE '`T_`' END AS message
    FROM named
    WHERE (asset_type IN ('Texture2D', 'StaticMesh') AND NOT starts_with(name, 'T_'))
       OR (asset_type = 'SoundWave' AND NOT starts_with(name, 'A_'))
       OR (asset_type = 'Blueprint' AND NOT starts_with(name, 'BP_'))
       OR (asset_type = 'Material' AND NOT starts_with(name, 'M_'))
    UNION ALL
    SELECT 'lint', 'warn', rule, asset_path, label || ' ' || value || ' exceeds limit ' || bound
    FROM (
        SELECT asset_path, 'blueprint/node-count' AS rule, 'node count' AS label, node_count AS value, 100 AS bound
        FROM blueprint_metrics
        UNION ALL SELECT asset_path, 'blueprint/event-tick', 'event tick count', event_tick_count, 2 FROM blueprint_metrics
        UNION ALL SELECT asset_path, 'blueprint/cast-count', 'cast count', cast_count, 12 FROM blueprint_metrics
        UNION ALL SELECT asset_path, 'blueprint/dependency-depth', 'dependency depth', dependency_depth, 15
        FROM blueprint_metrics)
    WHERE value > bound"""

DIFF = """
    SELECT n.from_path AS asset_path, 'dep_added' AS change, NULL AS old, n.to_path AS new
    FROM (SELECT from_path, to_path FROM deps WHERE NOT is_soft
          EXCEPT SELECT from_path, to_path FROM prev_deps WHERE NOT is_soft) n
    WHERE n.from_path IN (SELECT asset_path FROM both_sides)
    UNION ALL
    SELECT o.from_path, 'dep_removed', o.to_path, NULL
    FROM (SELECT from_path, to_path FROM prev_deps WHERE NOT is_soft
          EXCEPT SELECT from_path, to_path FROM deps WHERE NOT is_soft) o
    WHERE o.from_path IN (SELECT asset_path FROM both_sides)
    UNION ALL
    SELECT asset_path, 'type_changed', was, now FROM both_sides WHERE was <> now
    UNION ALL
    SELECT asset_path, 'node_count_delta', NULL, CAST(m.node_count - p.node_count AS VARCHAR)
    FROM blueprint_metrics m JOIN prev_metrics p USING (asset_path) WHERE asset_path IN (SELECT asset_path FROM both_sides)
    UNION ALL
    SELECT asset_path, 'event_tick_count_delta', NULL, CAST(m.event_tick_count - p.event_tick_count AS VARCHAR)
    FROM blueprint_metrics m JOIN prev_metrics p USING (asset_path) WHERE asset_path IN (SELECT asset_path FROM both_sides)"""

CHAINS = """
    chains AS (SELECT asset_path AS source, asset_path AS target, asset_path AS chain, 0 AS hops, [asset_path] AS been
               FROM assets WHERE asset_type = 'World'
               UNION ALL
               SELECT c.source, i.from_path, c.chain || ' > ' || i.from_path, c.hops + 1, list_append(c.been, i.from_path)
               FROM chains c JOIN iedges i ON i.to_path = c.target WHERE NOT list_contains(c.been, i.from_path)), |
    SELECT c.source, c.target, CAST(best AS BIGINT) AS hops, min(c.chain) AS chain
    FROM chains c JOIN (SELECT source, target, min(hops) AS best FROM chains GROUP BY 1, 2) b
      ON b.source = c.source AND b.target = c.target AND b.best = c.hops
    WHERE c.target IN (SELECT asset_path FROM assets WHERE asset_type = 'DataAsset') GROUP BY 1, 2, best"""

QUERIES = {
    # ingest and tables
    "exclude_prefix": f"SELECT * FROM disk_files WHERE NOT {IS_PREFIX_OUT}",
    "exclude_glob": f"SELECT * FROM disk_files WHERE NOT {IS_GLOB_OUT}",
    "ignore_rules": f"SELECT file_path, {IS_IGNORED} AS ignored FROM disk_files",
    "ingest_plan": f"""
        SELECT file_path, CASE WHEN excluded_by IS NULL THEN 'scanned' ELSE 'ignored' END AS status, excluded_by
        FROM (SELECT file_path, CASE WHEN {IS_PREFIX_OUT} OR {IS_GLOB_OUT} THEN 'exclude_paths'
                                     WHEN {IS_IGNORED} THEN 'ignore_rules' END AS excluded_by FROM disk_files)""",
    "changed_files": """
        SELECT d.file_path, d.mtime FROM disk_files d LEFT JOIN index_files i USING (file_path)
        WHERE i.last_modified IS DISTINCT FROM d.mtime""",
    "stale_assets": "SELECT file_path FROM index_files WHERE file_path NOT IN (SELECT file_path FROM disk_files)",
    "ingest_delta_counts": """
        SELECT count(*) FILTER (i.file_path IS NULL) AS new_count,
               count(*) FILTER (i.file_path IS NOT NULL AND d.file_path IS NOT NULL AND d.mtime <> i.last_modified) AS updated_count,
               count(*) FILTER (d.file_path IS NULL) AS removed_count,
               count(*) FILTER (d.mtime = i.last_modified) AS unchanged_count,
               count(*) FILTER (d.file_path IS NOT NULL) AS total_after
        FROM disk_files d FULL JOIN index_files i ON d.file_path = i.file_path""",
    "path_convert": """
        SELECT file_path, '/Game/' || regexp_replace(substr(file_path, 9), '[.](uasset|umap)$', '') AS asset_path FROM disk_files
        UNION ALL SELECT 'Content/' || substr(asset_path, 7) || '.uasset', asset_path FROM assets""",
    "path_validity": """
        SELECT asset_path AS candidate, true AS valid FROM assets
        UNION ALL SELECT asset_path || '.uasset', false FROM assets
        UNION ALL SELECT substr(asset_path, 2), false FROM assets""",
    "package_name": """
        SELECT asset_path AS object_path, asset_path AS package FROM assets
        UNION ALL SELECT asset_path || '.' || split_part(asset_path, '/', -1) || '_C', asset_path FROM assets""",
    "upsert_assets": """
        WITH fresh AS (SELECT asset_path, asset_type, file_size FROM assets EXCEPT SELECT * FROM prev_assets)
        SELECT * FROM prev_assets WHERE asset_path NOT IN (SELECT asset_path FROM fresh) UNION ALL SELECT * FROM fresh""",
    "edge_dedup": "SELECT from_path, to_path, bool_and(is_soft) AS is_soft FROM raw_deps GROUP BY from_path, to_path",
    "delete_cascade": """
        WITH gone AS (SELECT asset_path FROM assets WHERE asset_type IN ('ObjectRedirector', 'DataTable'))
        SELECT 'assets' AS table_name, asset_path AS row_key FROM assets WHERE asset_path NOT IN (FROM gone)
        UNION ALL SELECT 'texture_metadata', asset_path FROM texture_metadata WHERE asset_path NOT IN (FROM gone)
        UNION ALL SELECT 'deps', from_path || ' -> ' || to_path FROM deps WHERE from_path NOT IN (FROM gone)""",
    "scan_snapshot": """
        SELECT count(*) AS asset_count, CAST(sum(file_size) AS BIGINT) AS total_size,
               count(*) FILTER (asset_type = 'Blueprint') AS blueprint_count,
               count(*) FILTER (asset_type = 'Texture2D') AS texture_count,
               CAST(sum(file_size) FILTER (asset_type = 'Texture2D') AS BIGINT) AS texture_size,
               (SELECT avg(node_count) FROM blueprint_metrics) AS avg_node_count
        FROM assets""",
    "load_baseline": "SELECT name, saved_at, h.* FROM baselines JOIN scan_history h ON snapshot_id = h.id WHERE name = 'main'",
    "recent_snapshots": "SELECT * FROM scan_history ORDER BY scanned_at DESC, id DESC LIMIT 7",
    "previous_snapshot": "SELECT * FROM scan_history ORDER BY scanned_at DESC, id DESC LIMIT 1 OFFSET 1",
    "edges": "SELECT * FROM deps",
    "asset_metrics": "SELECT asset_type, file_size, m.* FROM assets JOIN blueprint_metrics m USING (asset_path)",
    "asset_textures": "SELECT asset_type, file_size, m.* FROM assets JOIN texture_metadata m USING (asset_path)",
    "asset_lookup": "SELECT * FROM assets WHERE asset_path IN (SELECT to_path FROM deps)",
    # find
    "find_type_size": "SELECT * FROM assets WHERE asset_type = 'Texture2D' AND file_size BETWEEN 1048576 AND 8388608",
    "find_glob": "SELECT * FROM assets WHERE regexp_full_match(file_path, '.*/Brand_1.*/T_.l.*')",
    "find_unreferenced": "SELECT * FROM assets WHERE asset_path IN (SELECT asset_path FROM dead_all)",
    "find_refs": """
        SELECT * FROM assets WHERE asset_path IN (
            SELECT a FROM closure JOIN assets t ON t.asset_path = closure.b
            WHERE t.asset_type = 'World' AND closure.a <> closure.b)""",
    "find_deps": """
        SELECT * FROM assets WHERE asset_path IN (
            SELECT to_path FROM iedges WHERE from_path IN (
                SELECT asset_path FROM assets WHERE asset_type IN ('Blueprint', 'MaterialInstance')))""",
    "find_totals": """
        SELECT count(*) AS asset_count, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS total_bytes
        FROM assets WHERE asset_type = 'StaticMesh' AND file_size >= 2097152""",
    "find_sorted": "SELECT * FROM assets ORDER BY file_size DESC, asset_path",
    "find_has_violation": """
        SELECT * FROM assets WHERE asset_path IN (SELECT asset_path FROM v_blueprint WHERE starts_with(rule, 'blueprint/'))""",
    "dead_filtered": """
        SELECT * FROM dead WHERE asset_type IN ('Texture2D', 'StaticMesh', 'DataAsset') AND file_size >= 4096
        AND NOT contains(asset_path, '/Brand_2') AND NOT contains(asset_path, 'small')""",
    "internal_edges": "SELECT * FROM iedges",
    # statistics
    "stats_by_type": """
        SELECT asset_type, count(*) AS asset_count, CAST(sum(file_size) AS BIGINT) AS total_bytes FROM assets GROUP BY asset_type""",
    "stats_by_folder": f"""
        SELECT {FOLDER} AS folder, count(*) AS asset_count, CAST(sum(file_size) AS BIGINT) AS total_bytes FROM assets GROUP BY 1""",
    "stats_totals": """
        SELECT (SELECT count(*) FROM assets) AS total_assets, (SELECT CAST(sum(file_size) AS BIGINT) FROM assets) AS total_bytes,
               (SELECT count(*) FROM iedges) AS total_edges,
               (SELECT count(*) FROM verts WHERE asset_path NOT IN (SELECT to_path FROM iedges)) AS unreferenced,
               (SELECT count(*) FROM reported) AS cycles,
               (SELECT count(*) FROM iedges)::DOUBLE / (SELECT count(*) FROM assets) AS avg_out_degree""",
    "stats_type_share": """
        SELECT asset_type, CAST(sum(file_size) AS BIGINT) AS total_bytes,
               CAST(sum(file_size) AS BIGINT) * 100.0::DOUBLE / (SELECT CAST(sum(file_size) AS BIGINT) FROM assets) AS share_percent
        FROM assets GROUP BY asset_type""",
    "largest_assets": "SELECT asset_path, asset_type, file_size FROM assets ORDER BY file_size DESC, asset_path LIMIT 10",
    "dead_by_type": """
        SELECT asset_type, count(*) AS asset_count, CAST(sum(file_size) AS BIGINT) AS total_bytes FROM dead GROUP BY asset_type""",
    "dead_by_dir": f"""
        SELECT {FOLDER} AS folder, count(*) AS asset_count, CAST(sum(file_size) AS BIGINT) AS total_bytes FROM dead GROUP BY 1""",
    "dup_same_name": "SELECT name, asset_path, copies FROM named JOIN name_groups USING (name)",
    "dup_texture": """
        SELECT g.name, g.each_bytes, n.asset_path, g.copies FROM named n JOIN tex_groups g
        ON n.name = g.name AND n.file_size = g.each_bytes WHERE n.asset_type = 'Texture2D'""",
    "dup_groups": "SELECT * FROM dup_report",
    "degrees": """
        SELECT asset_path, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree
        FROM verts LEFT JOIN in_deg i USING (asset_path) LEFT JOIN out_deg o USING (asset_path)""",
    "graph_summary": """
        SELECT (SELECT count(*) FROM verts) AS vertices, (SELECT count(*) FROM verts WHERE is_placeholder) AS placeholders,
               (SELECT count(*) FROM iedges) AS edges, (SELECT count(*) FROM reported) AS cycles""",
    "blueprint_rank": """
        SELECT asset_path, asset_type, node_count, event_tick_count, cast_count, dependency_depth,
               row_number() OVER (ORDER BY node_count DESC, asset_path) AS rank
        FROM assets JOIN blueprint_metrics USING (asset_path)""",
    "export_table": """
        SELECT asset_path AS path, asset_type AS type, file_size, coalesce(o.n, 0) AS deps_count, coalesce(i.n, 0) AS in_degree
        FROM assets LEFT JOIN in_deg i USING (asset_path) LEFT JOIN out_deg o USING (asset_path)""",
    "export_filtered": """
        SELECT asset_path AS path, asset_type AS type, file_size, coalesce(o.n, 0) AS deps_count, coalesce(i.n, 0) AS in_degree
        FROM assets LEFT JOIN in_deg i USING (asset_path) LEFT JOIN out_deg o USING (asset_path)
        WHERE asset_type = 'Texture2D' AND file_size >= 4194304 AND regexp_full_match(file_path, '.*/T_.*')""",
    # scalar functions
    "leaf_name": "SELECT asset_path, name AS leaf FROM named",
    "relative_path": """
        SELECT replace('D:/proj/' || file_path, '/', '\\') AS full_path, file_path AS relative FROM assets
        UNION ALL SELECT file_path, file_path FROM assets""",
    "format_size": f"SELECT asset_path, {SIZE_TEXT} AS size, format('{{:,}}', file_size) AS bytes FROM assets",
    "folder_bucket": f"SELECT asset_path, {FOLDER} AS folder FROM assets",
    "format_timestamp": f"""
        SELECT asset_path, strftime({CLAMPED}, '%Y-%m-%d %H:%M:%S UTC') AS utc,
               strftime({CLAMPED}, '%Y-%m-%dT%H:%M:%SZ') AS rfc3339 FROM assets""",
    "days_since_scan": "SELECT id, greatest(1707000000 - scanned_at, 0) // 86400 AS days FROM scan_history",
    # graph
    "vertices": "SELECT * FROM verts",
    "dead_assets": "SELECT * FROM dead",
    "dead_hard_only": """
        WITH hard AS (SELECT * FROM iedges WHERE NOT is_soft),
        hard_verts AS (SELECT asset_path, asset_type, file_size, false AS is_placeholder FROM assets
                       UNION ALL SELECT DISTINCT to_path, '', CAST(0 AS BIGINT), true FROM hard
                       WHERE to_path NOT IN (SELECT asset_path FROM assets))
        SELECT * FROM hard_verts WHERE asset_path NOT IN (SELECT to_path FROM hard)
        AND NOT contains(asset_path, '/__ExternalActors__/') AND NOT contains(asset_path, '/__ExternalObjects__/')
        AND asset_type NOT IN ('MetaData', 'AssetImportData', 'BillboardComponent', 'ActorFolder', 'ArrowComponent',
                               'BlueprintGeneratedClass', 'AnimCurveMetaData', 'BodySetup')""",
    "direct_deps": """
        SELECT i.from_path AS asset_path, i.to_path AS dep_path, v.asset_type AS dep_type
        FROM iedges i JOIN verts v ON v.asset_path = i.to_path JOIN assets a ON a.asset_path = i.from_path
        WHERE a.asset_type IN ('Blueprint', 'MaterialInstance', 'DataAsset')""",
    "direct_refs": """
        SELECT i.to_path AS asset_path, i.from_path AS referrer FROM iedges i JOIN assets a ON a.asset_path = i.to_path
        WHERE a.asset_type IN ('DataTable', 'World', 'Texture2D')""",
    "cycles": """
        SELECT component, size, max(asset_path) AS last_member FROM reported JOIN comp USING (component) GROUP BY 1, 2""",
    "cycle_members": "SELECT asset_path, component, size FROM comp JOIN reported USING (component)",
    "cycle_key": """
        SELECT component, CAST(sum(CAST('0x' || substr(md5(asset_path), 1, 15) AS BIGINT)) AS VARCHAR) AS fingerprint
        FROM comp JOIN reported USING (component) GROUP BY component""",
    "cycle_types": """
        SELECT component, array_to_string(list_sort(list(DISTINCT asset_type)), ',') AS types
        FROM comp JOIN reported USING (component) JOIN verts USING (asset_path) GROUP BY component""",
    "soft_cycles": """
        SELECT r.component, r.size, count(*) AS soft_edges
        FROM iedges i JOIN comp f ON f.asset_path = i.from_path JOIN comp t ON t.asset_path = i.to_path
        JOIN reported r ON r.component = f.component
        WHERE f.component = t.component AND i.is_soft AND i.from_path <> i.to_path GROUP BY r.component, r.size""",
    "impact": over_layers(
        "'World'",
        """SELECT root AS target, vertex AS asset_path, depth,
                  CASE WHEN depth = 1 THEN 'direct' ELSE 'transitive' END AS kind FROM back""",
    ),
    "impact_counts": over_layers(
        "'World', 'DataTable', 'Material', 'Texture2D'",
        """SELECT asset_path, count(*) FILTER (depth = 1) AS direct_count, count(*) FILTER (depth > 1) AS transitive_count
           FROM layer_roots LEFT JOIN back ON root = asset_path GROUP BY asset_path""",
    ),
    "deps_closure": FORWARD
    + """SELECT root AS asset_path, count(*) FILTER (depth = 1) AS direct_count, count(*) FILTER (depth > 1) AS transitive_count,
                CAST(sum(coalesce(file_size, 0)) AS BIGINT) AS total_bytes
         FROM first_met LEFT JOIN assets ON assets.asset_path = vertex GROUP BY root""",
    "deps_paths": tree_cte("'DataAsset', 'MaterialInstance'", "from_path", "to_path")
    + "SELECT root, parent, asset_path, depth, is_cycle, CAST(0 AS BIGINT) AS hidden_children FROM tree",
    "deps_paths_capped": tree_cte("'DataAsset', 'MaterialInstance'", "from_path", "to_path")
    + """SELECT root, parent, t.asset_path, depth, is_cycle,
                CAST(CASE WHEN met_at = 2 THEN coalesce(n, 0) ELSE 0 END AS BIGINT) AS hidden_children
         FROM tree t LEFT JOIN out_deg USING (asset_path) WHERE depth <= 2""",
    "impact_paths": tree_cte("'World', 'Material'", "to_path", "from_path")
    + """SELECT root AS target, parent, asset_path, depth,
                CASE WHEN is_cycle THEN 'cycle' WHEN depth = 1 THEN 'direct' ELSE 'transitive' END AS kind,
                CASE WHEN NOT is_cycle AND depth > 1 THEN split_part(parent, '/', -1) END AS via FROM tree""",
    "redirectors": "SELECT asset_path, file_size FROM assets WHERE asset_type = 'ObjectRedirector'",
    "material_chain": """
        SELECT a.asset_path, CAST(coalesce(max(CASE WHEN list_contains(seen, spot) THEN 0 ELSE depth END), 0) AS BIGINT) AS chain_depth
        FROM assets a LEFT JOIN chain_walk c ON c.vertex = a.asset_path WHERE a.asset_type = 'MaterialInstance' GROUP BY 1""",
    "clean_plan": """
        SELECT asset_path, asset_type, file_size FROM dead WHERE NOT is_placeholder AND file_size >= 4096
        AND NOT contains(asset_path, 'Brand_2') AND regexp_full_match(asset_path, '/Game/.*/P.*/T_.*')""",
    "shortest_path": CHAINS,
    "rename_impact": over_layers(
        "'World', 'DataTable'",
        """SELECT a.asset_path AS source,
                  CASE WHEN asset_type = 'World' THEN asset_path || '_New' ELSE '/Game/World/L_0' END AS destination,
                  count(*) FILTER (depth = 1) AS direct_references, count(*) FILTER (depth > 1) AS transitive_impact_count,
                  asset_type = 'DataTable' AS destination_exists
           FROM assets a LEFT JOIN back ON root = a.asset_path WHERE asset_type IN ('World', 'DataTable') GROUP BY 1, 2, 5""",
    ),
    # rules and checks
    "lint_naming": "SELECT * FROM v_naming",
    "lint_blueprint": "SELECT * FROM v_blueprint",
    "lint_overrides": OVERRIDE_LINT,
    "lint_all": "SELECT * FROM v_lint_report",
    "lint_custom_rule": """
        SELECT * FROM v_naming
        UNION ALL SELECT 'lint', 'warn', 'custom/name-length', asset_path, 'name has ' || length(name) || ' characters'
        FROM named WHERE length(name) > 14""",
    "lint_texture": TEXTURE_RULES,
    "lint_metadata": """
        SELECT 'lint' AS "check", severity, rule, asset_path, rule AS message FROM (
            SELECT asset_path, 'warn' AS severity, 'lint/static-mesh/no-lod' AS rule FROM mesh_details
            WHERE lod_count = 1 AND triangle_count_lod0 > 10000
            UNION ALL SELECT asset_path, 'warn', 'lint/static-mesh/high-lightmap-res' FROM mesh_details WHERE lightmap_resolution > 512
            UNION ALL SELECT asset_path, 'warn', 'lint/static-mesh/no-collision' FROM mesh_details WHERE has_collision = false
            UNION ALL SELECT asset_path, 'info', 'lint/static-mesh/nanite-no-lod' FROM mesh_details WHERE has_nanite AND lod_count >= 2
            UNION ALL SELECT asset_path, 'warn', 'lint/sound/stereo-ambient' FROM sound_details WHERE duration > 10 AND num_channels = 2
            UNION ALL SELECT asset_path, 'error', 'lint/sound/uncompressed' FROM sound_details
            WHERE compression_quality = 100 AND file_size > 2 * 1024 * 1024
            UNION ALL SELECT asset_path, 'warn', 'lint/sound/high-sample-rate' FROM sound_details WHERE sample_rate > 48000
            UNION ALL SELECT asset_path, 'warn', 'lint/sound/non-streaming-large' FROM sound_details WHERE duration > 30 AND is_streaming = false
            UNION ALL SELECT asset_path, 'warn', 'lint/material/too-many-texture-samples' FROM material_details WHERE texture_sample_count > 12
            UNION ALL SELECT asset_path, 'warn', 'lint/material/deep-instance-chain' FROM material_details WHERE instance_chain_depth > 2
            UNION ALL SELECT asset_path, 'warn', 'lint/material/wpo-on-opaque' FROM material_details WHERE uses_wpo AND blend_mode = 'BLEND_Opaque'
            UNION ALL SELECT asset_path, 'warn', 'lint/material/translucent-two-sided' FROM material_details
            WHERE two_sided AND blend_mode = 'BLEND_Translucent'
            UNION ALL SELECT asset_path, 'error', 'lint/material/subsurface-high-sample-count' FROM material_details
            WHERE shading_model = 'MSM_Subsurface' AND texture_sample_count > 16
            UNION ALL SELECT asset_path, 'warn', 'lint/data-table/large-table' FROM table_details WHERE row_count > 10000
            UNION ALL SELECT asset_path, 'error', 'lint/data-table/missing-struct' FROM table_details WHERE row_struct IS NULL)""",
    "budget": """
        SELECT asset_path, asset_type, file_size, max_size, excess_bytes, 'budget/' || lower(asset_type) AS rule FROM over""",
    "budget_by_type": """
        SELECT asset_type, max_size, count(*) AS violation_count, max(file_size) AS largest,
               CAST(sum(excess_bytes) AS BIGINT) AS excess_bytes FROM over GROUP BY asset_type, max_size""",
    "check_violations": "SELECT * FROM v_all",
    "check_selected": """
        SELECT "check", 'error' AS severity, rule, asset_path, message FROM v_dead
        UNION ALL SELECT * FROM v_naming UNION ALL SELECT * FROM v_blueprint UNION ALL SELECT * FROM v_budget""",
    "check_results": 'SELECT "check", severity, finding_count, finding_count = 0 AS passed FROM check_rows',
    "check_sample": """
        SELECT "check", severity, rule, asset_path, message FROM (
            SELECT *, row_number() OVER (PARTITION BY "check" ORDER BY asset_path, rule, message) AS n FROM v_all) WHERE n <= 5""",
    "violation_summary": """
        SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity <> 'error') AS warnings FROM v_all""",
    "gate": """
        SELECT blocking, warning, fail_on, CASE fail_on WHEN 'error' THEN blocking = 0
                                                        WHEN 'warn' THEN blocking = 0 AND warning = 0 ELSE true END AS passed
        FROM (SELECT count(*) FILTER (severity = 'error' AND finding_count > 0) AS blocking,
                     count(*) FILTER (severity = 'warn' AND finding_count > 0) AS warning FROM check_rows),
             (VALUES ('error'), ('warn'), ('never')) f(fail_on)""",
    "sarif_results": """
        SELECT rule AS rule_id, CASE WHEN severity = 'error' THEN 'error' ELSE 'warning' END AS level, message, file_path AS uri
        FROM v_all LEFT JOIN assets USING (asset_path)""",
    "annotations": """
        SELECT '::' || CASE WHEN severity = 'error' THEN 'error' ELSE 'warning' END || ' file=' || coalesce(file_path, '')
               || ',title=' || rule || '::' || message AS line
        FROM v_lint_report LEFT JOIN assets USING (asset_path)""",
    "health_score": "SELECT asset_path, errors, warnings, score, label FROM labelled",
    "health_summary": """
        SELECT label, count(*) AS asset_count, (SELECT sum(score)::DOUBLE / count(*) FROM scores) AS project_average
        FROM labelled GROUP BY label""",
    "audit": """
        SELECT asset_path, asset_type, coalesce(o.n, 0) AS deps_count, coalesce(i.n, 0) AS referrer_count,
               coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(rules, '') AS rules,
               asset_type = 'ObjectRedirector' AS is_redirector
        FROM assets LEFT JOIN in_deg i USING (asset_path) LEFT JOIN out_deg o USING (asset_path)
        LEFT JOIN (SELECT asset_path, count(*) FILTER (severity = 'error') AS errors,
                          count(*) FILTER (severity <> 'error') AS warnings,
                          string_agg(severity || ' ' || rule, '; ' ORDER BY severity, rule) AS rules
                   FROM v_lint_report GROUP BY asset_path) USING (asset_path)""",
    # comparing states
    "size_increases": """
        SELECT asset_path, p.file_size AS old_size, a.file_size AS new_size,
               greatest(a.file_size - p.file_size, 0) * 100 // p.file_size AS pct_increase
        FROM prev_assets p JOIN assets a USING (asset_path)
        WHERE p.file_size <> 0 AND greatest(a.file_size - p.file_size, 0) * 100 // p.file_size >= 10""",
    "blueprint_regressions": """
        SELECT asset_path, p.node_count AS old_node_count, p.event_tick_count AS old_event_tick_count,
               m.node_count AS new_node_count, m.event_tick_count AS new_event_tick_count
        FROM prev_metrics p JOIN blueprint_metrics m USING (asset_path) WHERE m.node_count > p.node_count""",
    "asset_additions": "SELECT * FROM assets WHERE asset_path NOT IN (SELECT asset_path FROM prev_assets)",
    "asset_deletions": "SELECT * FROM prev_assets WHERE asset_path NOT IN (SELECT asset_path FROM assets)",
    "regressions": "SELECT * FROM regressed",
    "baseline_resolved": """
        SELECT * FROM errors_before WHERE (rule, asset_path) NOT IN (SELECT (rule, asset_path) FROM errors_now)""",
    "regression_gate": "SELECT count(*) AS regressions, count(*) = 0 AS passed FROM regressed",
    "asset_diff": """
        both_sides AS (SELECT asset_path, p.asset_type AS was, a.asset_type AS now
                       FROM prev_assets p JOIN assets a USING (asset_path)), |""" + DIFF,
    "stats_diff": """
        SELECT metric, CAST(old AS BIGINT) AS old, CAST(new AS BIGINT) AS new, CAST(new - old AS BIGINT) AS delta FROM (
            SELECT 'assets' AS metric, (SELECT count(*) FROM prev_assets) AS old, (SELECT count(*) FROM assets) AS new
            UNION ALL SELECT 'file_size_total', (SELECT sum(file_size) FROM prev_assets), (SELECT sum(file_size) FROM assets)
            UNION ALL SELECT 'violations', (SELECT count(*) FROM errors_before), (SELECT count(*) FROM errors_now)
            UNION ALL SELECT 'dead_assets', (SELECT count(*) FROM prev_dead), (SELECT count(*) FROM dead)
            UNION ALL SELECT 'cycles', (SELECT count(*) FROM prev_reported), (SELECT count(*) FROM reported))""",
    "baseline_summary": """
        SELECT (SELECT count(*) FROM errors_before) AS errors,
               (SELECT count(*) FROM prev_assets JOIN prefixes USING (asset_type)
                WHERE NOT list_bool_or([starts_with(split_part(asset_path, '/', -1), p) for p in allowed])) AS warnings,
               (SELECT count(*) FROM regressed) AS regressions, (SELECT count(*) FROM regressed) = 0 AS passed""",
    "catalogue_health": """
        SELECT 'assets' AS "check", (SELECT count(*) FROM assets) > 0 AS ok, (SELECT count(*) FROM assets) || ' assets' AS detail
        UNION ALL SELECT key, value = '1', value || ' (expected 1)' FROM properties WHERE key = 'schema_version'
        UNION ALL SELECT key, value = '0.2.0', value || ' (expected 0.2.0)' FROM properties WHERE key = 'writer_version'
        UNION ALL SELECT 'last_scan', true,
            ((1707000000 - (SELECT max(scanned_at) FROM scan_history)) // 86400) || ' days ago'""",
    "trend": """
        SELECT *, newest - oldest AS delta, CASE WHEN newest > oldest THEN 'up' WHEN newest < oldest THEN 'down'
                                                 WHEN newest = oldest THEN 'unchanged' END AS direction
        FROM (SELECT unnest(['assets', 'violations', 'file_size_total']) AS metric,
                     unnest([(SELECT assets FROM newest30 ORDER BY scanned_at, id LIMIT 1),
                             (SELECT violations FROM newest30 ORDER BY scanned_at, id LIMIT 1),
                             (SELECT file_size_total FROM newest30 ORDER BY scanned_at, id LIMIT 1)]) AS oldest,
                     unnest([(SELECT assets FROM newest30 ORDER BY scanned_at DESC, id DESC LIMIT 1),
                             (SELECT violations FROM newest30 ORDER BY scanned_at DESC, id DESC LIMIT 1),
                             (SELECT file_size_total FROM newest30 ORDER BY scanned_at DESC, id DESC LIMIT 1)]) AS newest)""",
    "trend_series": "SELECT id, scanned_at, assets, violations, file_size_total FROM newest30",
    # change stream, batch form
    "debounced_events": """
        SELECT epoch_ms(ts) // 7200000 * 7200000 AS window_start_ms, asset_path, arg_max(kind, (ts, event_id)) AS kind,
               count(*) AS merged FROM pkg_events GROUP BY 1, 2""",
    "debounced_from_first": """
        openings AS (
            SELECT asset_path, min(ts) AS opened FROM pkg_events GROUP BY asset_path
            UNION ALL
            SELECT o.asset_path, (SELECT min(e.ts) FROM pkg_events e
                                  WHERE e.asset_path = o.asset_path AND e.ts >= o.opened + INTERVAL 2 HOUR)
            FROM openings o WHERE o.opened IS NOT NULL), |
        SELECT epoch_us(o.opened) // 1000 AS window_start_ms, o.asset_path, arg_max(e.kind, (e.ts, e.event_id)) AS kind, count(*) AS merged
        FROM openings o JOIN pkg_events e
          ON e.asset_path = o.asset_path AND e.ts >= o.opened AND e.ts < o.opened + INTERVAL 2 HOUR
        GROUP BY o.asset_path, o.opened""",
    "new_dead": "SELECT asset_path FROM dead_all WHERE asset_path NOT IN (SELECT asset_path FROM prev_dead_all)",
    "new_cycles": "SELECT component, size FROM reported WHERE members NOT IN (SELECT members FROM prev_reported)",
}


def sql(name: str) -> str:
    """Complete DuckDB statement: the views it needs, then the query.

    A `|` splits off views of its own that a query puts in front.
    """
    own, _, body = QUERIES[name].rpartition(", |") if ", |" in QUERIES[name] else ("", "", QUERIES[name])
    views = {**VIEWS, **HELPERS}
    chain = needed(own + " " + body, views)
    ctes = []
    for view in chain:
        if view == "layers":
            ctes.append(own.strip())
        recursive = view in ("closure", "prev_closure", "layers", "chain_walk")
        ctes.append(f"{view} AS {'' if recursive else 'MATERIALIZED '}({views[view]})")
    if own and "layers" not in chain:
        ctes.append(own.strip())
    return f"WITH RECURSIVE {', '.join(ctes)} SELECT * FROM ({body})"


def oracle_sql() -> dict[str, str]:
    return {name: sql(name) for name in QUERIES}

"""Table schemas. Nothing is ever inferred."""

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()

ASSETS = _struct(("asset_path", S), ("file_path", S), ("asset_type", S), ("file_size", L), ("last_modified", L))
DEPS = _struct(("from_path", S), ("to_path", S), ("is_soft", B))
BLUEPRINT_METRICS = _struct(
    ("asset_path", S), ("node_count", L), ("event_tick_count", L), ("cast_count", L), ("dependency_depth", L)
)
TEXTURE_METADATA = _struct(
    ("asset_path", S),
    ("compression", S),
    ("mip_gen", S),
    ("has_alpha", B),
    ("texture_group", S),
    ("source_x", L),
    ("source_y", L),
)
MATERIAL_SAMPLES = _struct(("asset_path", S), ("texture_sample_count", L))
SCAN_HISTORY = _struct(
    ("id", L),
    ("scanned_at", L),
    ("asset_count", L),
    ("total_size", L),
    ("blueprint_count", L),
    ("avg_node_count", D),
    ("texture_count", L),
    ("texture_size", L),
)
BASELINES = _struct(("name", S), ("snapshot_id", L), ("saved_at", L))
VIOLATIONS = _struct(("check", S), ("severity", S), ("rule", S), ("asset_path", S), ("message", S))
CHANGE_EVENTS = _struct(("event_id", L), ("ts", T.TimestampType()), ("asset_path", S), ("kind", S))

PROPERTIES = _struct(("key", S), ("value", S))
SCHEMA_VERSION = "1"

# Small tables that every version holds in full: rows follow scans, not assets.
CARRIED_TABLES = {"scan_history": SCAN_HISTORY, "baselines": BASELINES, "properties": PROPERTIES}
# Tables of one catalogue snapshot, in the order they are written.
SNAPSHOT_TABLES = {
    "assets": ASSETS,
    "deps": DEPS,
    "blueprint_metrics": BLUEPRINT_METRICS,
    "texture_metadata": TEXTURE_METADATA,
    "material_samples": MATERIAL_SAMPLES,
}

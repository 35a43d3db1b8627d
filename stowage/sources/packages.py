"""Decoding content packages into catalogue tables.

Spark distributes the files; a task reads and decodes one file at a time. Everything about a
package fits one nested row, so extraction works on arrays within the row and needs no
shuffle at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions import paths
from stowage.sources.package_bytes import TEXTURE_CLASSES, Rejected, read_package

# Class of an export object to asset type.
ASSET_TYPE_OF_CLASS = {
    "Blueprint": "Blueprint",
    "BlueprintInterface": "BlueprintInterface",
    "AnimBlueprint": "AnimBlueprint",
    "WidgetBlueprint": "UserWidget",
    "Texture2D": "Texture2D",
    "StaticMesh": "StaticMesh",
    "SkeletalMesh": "SkeletalMesh",
    "Material": "Material",
    "MaterialInstanceConstant": "MaterialInstance",
    "MaterialFunction": "MaterialFunction",
    "SoundWave": "SoundWave",
    "SoundCue": "SoundCue",
    "AnimSequence": "AnimSequence",
    "AnimMontage": "AnimMontage",
    "LevelSequence": "LevelSequence",
    "DataTable": "DataTable",
    "DataAsset": "DataAsset",
    "ObjectRedirector": "ObjectRedirector",
    "NiagaraSystem": "NiagaraSystem",
    "NiagaraEmitter": "NiagaraEmitter",
    "IKRigDefinition": "IKRigDefinition",
    "IKRetargeter": "IKRetargeter",
    "DialogueWave": "DialogueWave",
}
BLUEPRINT_TYPES = ("Blueprint", "AnimBlueprint", "UserWidget")
TASK_BYTES = 128 * 1024 * 1024

DECODED = """
    file_path string, mtime bigint, file_size bigint, reason string,
    imports array<struct<outer: int, object_name: string>>,
    soft_packages array<string>,
    export_classes array<string>,
    exports_cut boolean,
    mentions_tick boolean,
    properties array<struct<section: string, name: string, type: string, value: string, depth: int>>
"""
_EMPTY = {
    "imports": None,
    "soft_packages": None,
    "export_classes": None,
    "exports_cut": None,
    "mentions_tick": None,
    "properties": None,
}


def _read_file(path: str) -> bytes:
    """Whole content of one file, local or on any store Arrow knows."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with store.open_input_stream(inner) as stream:
        return stream.read()


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, mtime in zip(batch["file_path"], batch["mtime"]):
            row = {"file_path": path, "mtime": mtime, "file_size": 0, "reason": None, **_EMPTY}
            try:
                data = _read_file(path)
                row["file_size"] = len(data)
                row.update(read_package(data, path.lower().endswith(".umap")))
            except Rejected as error:
                row["reason"] = str(error)
            except (OSError, ValueError) as error:  # a store Arrow does not know is a ValueError
                row["reason"] = f"io error: {error}"
            # One row per batch: a package's tables may be large, and only one is held at a time.
            yield pd.DataFrame([row])


def decode(files: DataFrame) -> DataFrame:
    """(file_path, mtime, length) to one decoded row per file; failures carry a reason.

    Only the given files are opened, so an incremental scan reads just what changed. The
    result feeds several tables: settle or store it before splitting.
    """
    total = files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()["bytes"]
    tasks = max(1, -(-total // TASK_BYTES), files.sparkSession.sparkContext.defaultParallelism)
    rows = files.select("file_path", "mtime").repartition(int(tasks)).mapInPandas(_decode, DECODED)
    # An export table that runs off the file is an error unless a known class came before.
    cut = F.col("exports_cut") & ~_is_map() & _first_known_type().isNull()
    return rows.withColumn("reason", F.when(cut, F.lit("unexpected end of file")).otherwise(F.col("reason")))


# ---------------------------------------------------------------- what the rows mean


def _is_map() -> Column:
    return F.lower("file_path").endswith(".umap")


def _first_known_type() -> Column:
    known = F.create_map(*[F.lit(x) for pair in ASSET_TYPE_OF_CLASS.items() for x in pair])
    types = F.transform("export_classes", lambda c: F.when(c.isNotNull(), F.try_element_at(known, c)))
    return F.get(F.array_compact(types), F.lit(0))


def _asset_type() -> Column:
    first_class = F.get(F.array_compact("export_classes"), F.lit(0))
    return F.when(_is_map(), "World").otherwise(F.coalesce(_first_known_type(), first_class, F.lit("")))


def _project_paths(candidates: Column) -> Column:
    """Those of the texts that are asset paths of the project, each once, in order."""
    return F.array_sort(
        F.array_distinct(
            F.filter(candidates, lambda p: p.startswith("/Game/") & ~F.substring_index(p, "/", -1).contains("."))
        )
    )


def _hard_names() -> Column:
    """Package-level imports, repeats included."""
    top = F.filter("imports", lambda i: (i["outer"] == 0) & i["object_name"].startswith("/Game/"))
    return F.filter(
        F.transform(top, lambda i: i["object_name"]), lambda p: ~F.substring_index(p, "/", -1).contains(".")
    )


def _property_values(section: str) -> Column:
    hits = F.filter("properties", lambda p: p["section"] == section)
    return F.transform(hits, lambda p: p["value"])


def _soft_names() -> Column:
    nothing = F.array().cast("array<string>")
    kind = F.col("asset_type")
    from_properties = (
        F.when(kind == "DataTable", _property_values("table"))
        .when(kind == "AnimMontage", _property_values("montage"))
        .when(kind == "LevelSequence", _property_values("sequence"))
        .otherwise(nothing)
    )
    return F.concat(F.col("soft_packages"), from_properties)


def _enum(name: str) -> Column:
    """Last value of a texture property; an unreadable last value is NULL too."""
    hits = F.filter("properties", lambda p: (p["section"] == "texture") & (p["name"] == name))
    return F.try_element_at(hits, F.lit(-1))["value"]


def extract(decoded: DataFrame, content_root: str) -> dict[str, DataFrame]:
    """Catalogue tables, and the quarantine, from decoded rows."""
    path = paths.asset_path_of_file(F.col("file_path"), content_root)
    outside = F.lit("invalid asset path: file path is not under the content root")
    rows = decoded.withColumn("asset_path", path).withColumn(
        "reason", F.coalesce("reason", F.when(F.col("asset_path").isNull(), outside))
    )
    good = rows.where(F.col("reason").isNull()).withColumn("asset_type", _asset_type())
    classes = F.col("export_classes")
    count_class = lambda test: F.size(F.filter(classes, test)).cast("bigint")
    events = count_class(lambda c: c == "K2Node_Event")
    edges = good.select(
        "asset_path",
        _project_paths(_hard_names()).alias("hard"),
        _project_paths(_soft_names()).alias("all_soft"),
    ).select("asset_path", "hard", F.array_except("all_soft", "hard").alias("soft"))
    tagged = F.concat(
        F.transform("hard", lambda p: F.struct(p.alias("to_path"), F.lit(False).alias("is_soft"))),
        F.transform("soft", lambda p: F.struct(p.alias("to_path"), F.lit(True).alias("is_soft"))),
    )
    is_texture = (F.col("asset_type") == "Texture2D") | F.col("asset_type").isin(*TEXTURE_CLASSES)
    return {
        "assets": good.select(
            "asset_path", "file_path", "asset_type", "file_size", F.col("mtime").alias("last_modified")
        ),
        "deps": edges.select(F.col("asset_path").alias("from_path"), F.inline(tagged)),
        "blueprint_metrics": good.where(F.col("asset_type").isin(*BLUEPRINT_TYPES)).select(
            "asset_path",
            count_class(lambda c: c.startswith("K2Node_")).alias("node_count"),
            F.when(F.col("mentions_tick") & (events > 0), 1).otherwise(0).cast("bigint").alias("event_tick_count"),
            count_class(lambda c: c == "K2Node_DynamicCast").alias("cast_count"),
            # Named a depth, but it counts import rows before repeats are removed.
            F.size(_hard_names()).cast("bigint").alias("dependency_depth"),
        ),
        "texture_metadata": good.where(is_texture).select(
            "asset_path",
            _enum("CompressionSettings").alias("compression"),
            _enum("MipGenSettings").alias("mip_gen"),
            F.lit(None).cast("boolean").alias("has_alpha"),
            _enum("LODGroup").alias("texture_group"),
            F.lit(None).cast("bigint").alias("source_x"),
            F.lit(None).cast("bigint").alias("source_y"),
        ),
        "material_samples": good.where(F.col("asset_type") == "Material").select(
            "asset_path", count_class(lambda c: c == "MaterialExpressionTextureSample").alias("texture_sample_count")
        ),
        "skipped": rows.where(F.col("reason").isNotNull()).select("file_path", "reason"),
    }

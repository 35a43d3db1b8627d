import struct

import pytest
from package_writer import Package, i32, text
from pyspark.sql import functions as F

from stowage import schema
from stowage.operators import compare, tables
from stowage.session import settle
from stowage.sources import inventory, packages
from stowage.sources.snapshots import SnapshotStore, scan


def blueprint():
    p = Package()
    p.add_import("/Game/A/M_One")
    p.add_import("/Game/A/M_One")
    p.add_import("/Game/A/T_Two")
    p.add_import("/Engine/Basic/X")
    p.add_import("/Game/A/Bad.Name")
    p.add_import("/Game/A/Inner", outer=-1)
    p.add_soft("/Game/A/T_Two")
    p.add_soft("/Game/A/S_Three")
    p.add_export("SomethingElse")
    p.add_export("Blueprint")
    for kind in ("K2Node_Event", "K2Node_DynamicCast", "K2Node_DynamicCast", "K2Node_If"):
        p.add_export(kind)
    p.name("ReceiveTick")
    return p.build()


def table():
    p = Package()
    header = p.prop("RowStruct", "ObjectProperty", i32(0)) + p.prop("H", "NameProperty", p.name("/Game/Not/Header")) + p.end()
    row1 = p.prop("Icon", "SoftObjectProperty", p.soft_path("/Game/UI/T_Icon")) + p.prop("B", "BoolProperty", b"", b"\1")
    row1 += p.prop("Str", "StrProperty", text("/Game/UI/W_Str")) + p.end()
    row2 = p.prop("N", "NameProperty", p.name("/Game/UI/W_Name"))
    row2 += p.prop("Skip", "StructProperty", p.prop("I", "NameProperty", p.name("/Game/UI/Hidden")) + p.end(), p.name("S") + bytes(16))
    row2 += p.end()
    broken = p.prop("N", "NameProperty", p.name("/Game/UI/W_Last")) + i32(9999, 0)
    body = header + i32(4) + i32(0, 0) + row1 + i32(0, 0) + row2 + i32(0, 0) + broken
    p.add_export("DataTable", body)
    return p.build()


def montage():
    p = Package()
    leaf = p.prop("AnimReference", "SoftObjectProperty", p.soft_path("/Game/Anim/A_Deep")) + p.end()
    segment = p.array_of_structs("AnimSegments", [leaf, leaf]) + p.end()
    track = p.struct_prop("AnimTrack", segment) + p.end()
    refs = i32(2) + p.soft_path("/Game/Anim/A_List1") + p.soft_path("/Game/Anim/A_List2")
    body = p.array_of_structs("SlotAnimTracks", [track])
    body += p.prop("Refs", "ArrayProperty", refs, p.name("SoftObjectProperty"))
    body += p.prop("Map", "MapProperty", bytes(12), p.name("X") + p.name("Y")) + p.end()
    p.add_export("AnimMontage", body)
    return p.build()


def sequence():
    p = Package()
    p.add_export("LevelSequence", p.end())
    p.add_export("MovieSceneAudioSection", p.prop("Sound", "SoftObjectProperty", p.soft_path("/Game/Audio/SW_A")) + p.end())
    p.add_export("Other", p.prop("Anim", "SoftObjectProperty", p.soft_path("/Game/Anim/A_B")) + i32(777, 0))
    return p.build()


def texture():
    p = Package()
    body = p.texture_enum("CompressionSettings", "TC_Old")
    body += p.name("Flag") + p.name("BoolProperty") + i32(0, 0) + b"\1" + b"\0"
    body += p.name("Guided") + p.name("IntProperty") + i32(4, 0) + b"\1" + bytes(16) + i32(5)
    body += p.texture_enum("CompressionSettings", "TC_Default") + p.texture_enum("LODGroup", "TEXTUREGROUP_World")
    body += i32(9999, 0)
    p.add_export("Texture2D", body)
    return p.build()


def material():
    p = Package(version=1000)
    p.add_export("Material")
    p.add_export("MaterialExpressionTextureSample")
    p.add_export("MaterialExpressionTextureSample")
    return p.build(wide_name=True)


def plain(kind):
    p = Package()
    p.add_export(kind)
    return p.build()


FILES = {
    "Content/A/BP_One.uasset": blueprint(),
    "Content/A/DT_One.uasset": table(),
    "Content/A/AM_One.uasset": montage(),
    "Content/A/LS_One.uasset": sequence(),
    "Content/A/T_One.UASSET": texture(),
    "Content/A/M_One.uasset": material(),
    "Content/A/Cube.uasset": plain("TextureCube"),
    "Content/A/Odd.uasset": plain("StrangeThing"),
    "Content/A/None.uasset": plain(None),
    "Content/Maps/L_One.umap": plain("StaticMesh"),
    "Content/Bad/Zero.uasset": bytes(4),
    "Content/Bad/Short.uasset": struct.pack("<I", 0x9E2A83C1),
    "Content/Bad/Legacy.uasset": Package().build(legacy=-7),
    "Content/Bad/Version.uasset": Package(version=0).build(),
    "Content/Bad/Negative.uasset": Package().build(name_count=-1),
    "Content/Bad/Huge.uasset": Package().build(name_count=2_000_000_000),
    "Content/A/readme.txt": b"no package",
    "Content/Dev/BP_Dev.uasset": blueprint(),
    "Content/Development/BP_Kept.uasset": plain("Blueprint"),
}


@pytest.fixture()
def project(tmp_path):
    for name, data in FILES.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return tmp_path


@pytest.fixture()
def extracted(spark, project):
    listed = inventory.discover(spark, str(project))
    decoded, rows = settle(packages.decode(listed))
    assert rows == len(FILES) - 1
    return packages.extract(decoded, f"{project}/Content")


def pairs(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_types_follow_the_first_known_class(extracted):
    types = dict(pairs(extracted["assets"], "asset_path", "asset_type"))
    assert types["/Game/A/BP_One"] == "Blueprint"
    assert types["/Game/A/Cube"] == "TextureCube"
    assert types["/Game/A/Odd"] == "StrangeThing"
    assert types["/Game/A/None"] == ""
    assert types["/Game/Maps/L_One"] == "World"
    assert types["/Game/A/T_One"] == "Texture2D"


def test_failures_are_quarantined_with_reasons(extracted):
    reasons = {p.rsplit("/", 1)[1]: r for p, r in pairs(extracted["skipped"], "file_path", "reason")}
    assert reasons == {
        "Zero.uasset": "invalid magic number: 0x00000000",
        "Short.uasset": "unexpected end of file",
        "Legacy.uasset": "unsupported file version: legacy=-7, ue5=0",
        "Version.uasset": "unsupported file version: legacy=-8, ue5=0",
        "Negative.uasset": "invalid data: negative name_count",
        "Huge.uasset": "unexpected end of file",
    }


def test_dependencies_are_distinct_and_hard_wins(extracted):
    deps = [r for r in pairs(extracted["deps"], "from_path", "to_path", "is_soft") if r[0] == "/Game/A/BP_One"]
    assert deps == [
        ("/Game/A/BP_One", "/Game/A/M_One", False),
        ("/Game/A/BP_One", "/Game/A/S_Three", True),
        ("/Game/A/BP_One", "/Game/A/T_Two", False),
    ]


def test_blueprint_metrics(extracted):
    rows = {r.asset_path: r for r in extracted["blueprint_metrics"].collect()}
    one = rows["/Game/A/BP_One"]
    assert (one.node_count, one.event_tick_count, one.cast_count, one.dependency_depth) == (4, 1, 2, 3)
    assert rows["/Game/Development/BP_Kept"].event_tick_count == 0


def test_soft_references_inside_properties(extracted):
    soft = {}
    for a, b, s in pairs(extracted["deps"], "from_path", "to_path", "is_soft"):
        if s:
            soft.setdefault(a, []).append(b)
    assert soft["/Game/A/DT_One"] == ["/Game/UI/T_Icon", "/Game/UI/W_Last", "/Game/UI/W_Name", "/Game/UI/W_Str"]
    assert soft["/Game/A/AM_One"] == ["/Game/Anim/A_Deep", "/Game/Anim/A_List1", "/Game/Anim/A_List2"]
    assert soft["/Game/A/LS_One"] == ["/Game/Anim/A_B", "/Game/Audio/SW_A"]


def test_texture_metadata_keeps_what_precedes_a_broken_property(extracted):
    rows = {r.asset_path: r for r in extracted["texture_metadata"].collect()}
    one = rows["/Game/A/T_One"]
    assert (one.compression, one.mip_gen, one.texture_group) == ("TC_Default", None, "TEXTUREGROUP_World")
    assert rows["/Game/A/Cube"].compression is None


def test_texture_samples(extracted):
    assert pairs(extracted["material_samples"], "asset_path", "texture_sample_count") == [("/Game/A/M_One", 2)]


def test_scan_publishes_versions_and_rescans_only_changes(spark, project, tmp_path_factory):
    store = SnapshotStore(spark, str(tmp_path_factory.mktemp("store")))
    rules = inventory.ScanRules(exclude_paths=["Content/Dev"])
    first = scan(store, str(project), f"{project}/Content", rules)
    delta = first["delta"].first()
    assert (delta.new_count, delta.updated_count, delta.removed_count) == (11, 0, 0)
    paths = {r.asset_path for r in store.read()["assets"].collect()}
    assert "/Game/Dev/BP_Dev" not in paths and "/Game/Development/BP_Kept" in paths

    import os

    # One file changes, one breaks, one goes.
    changed = project / "Content/A/M_One.uasset"
    changed.write_bytes(plain("Texture2D"))
    os.utime(changed, (1, 1))
    broken = project / "Content/A/Odd.uasset"
    broken.write_bytes(bytes(4))
    os.utime(broken, (2, 2))
    (project / "Content/A/DT_One.uasset").rename(project / "Content/A/DT_Two.uasset")
    second = scan(store, str(project), f"{project}/Content", rules)
    delta = second["delta"].first()
    assert (delta.new_count, delta.updated_count, delta.removed_count) == (1, 1, 1)
    assert store.versions() == [1, 2]
    now = store.read()
    types = dict(pairs(now["assets"], "asset_path", "asset_type"))
    assert types["/Game/A/M_One"] == "Texture2D"
    assert types["/Game/A/Odd"] == "StrangeThing"  # keeps its row
    assert "/Game/A/DT_One" not in types and "/Game/A/DT_Two" in types
    assert now["material_samples"].count() == 0
    assert now["deps"].where(F.col("from_path") == "/Game/A/DT_One").count() == 0
    # The broken file is tried again on every scan.
    third = scan(store, str(project), f"{project}/Content", rules, now=77, save_baseline="release")
    assert "Odd.uasset" in {p.rsplit("/", 1)[1] for (p,) in pairs(third["skipped"], "file_path")}
    # What the second scan changed, and the records that every version keeps.
    assert {p for (p,) in pairs(second["added"], "asset_path")} == {"/Game/A/DT_Two"}
    assert {p for (p,) in pairs(second["deleted"], "asset_path")} == {"/Game/A/DT_One"}
    history = store.small("scan_history").orderBy("id").collect()
    assert [r.id for r in history] == [1, 2, 3] and history[2].scanned_at == 77
    assert history[2].asset_count == store.read()["assets"].count()
    loaded = tables.load_baseline(store.small("baselines"), store.small("scan_history"), "release").collect()
    assert [(r.id, r.saved_at) for r in loaded] == [(3, 77)]
    expected = {"schema_version": schema.SCHEMA_VERSION, "writer_version": "older"}
    health = compare.catalogue_health(
        store.read()["assets"], store.small("scan_history"), store.small("properties"), expected, now=77 + 86400
    )
    assert {r.check: r.ok for r in health.collect()} == {
        "assets": True, "schema_version": True, "writer_version": False, "last_scan": True,
    }
    # An inventory made elsewhere does instead of a listing; unreadable places are quarantined.
    listed = spark.createDataFrame([("nostore://x/Content/A/New.uasset", 5, 9)], "file_path string, mtime bigint, length bigint")
    fourth = scan(store, "nostore://x", "nostore://x/Content", rules, files=listed)
    assert [p for (p,) in pairs(fourth["skipped"], "file_path")] == ["nostore://x/Content/A/New.uasset"]

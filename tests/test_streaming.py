import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stowage import schema
from stowage.operators import graph
from stowage.sources.snapshots import SnapshotStore
from stowage.streaming import changes
from stowage.streaming.watch import Watch, problems, rescan_from

START = datetime(2024, 1, 1)


def events(spark, *rows):
    """(id, milliseconds, path, kind)"""
    full = [(i, START + timedelta(milliseconds=ms), p, k) for i, ms, p, k in rows]
    return spark.createDataFrame(full, schema.CHANGE_EVENTS)


def test_normalise_keeps_package_changes_only(spark):
    raw = spark.createDataFrame(
        [
            (1, START, "/p/Content/A/B.uasset", "create"),
            (2, START, "/p/Content/A/B.UMAP", "Modify"),
            (3, START, "/p/Content/A/B.txt", "modify"),
            (4, START, "/p/Content/A/C.uasset", "access"),
            (5, START, "/elsewhere/C.uasset", "remove"),
            (6, START, "/p/Content/A/C.uasset", "remove"),
        ],
        "event_id bigint, ts timestamp, file_path string, action string",
    )
    rows = sorted((r.event_id, r.asset_path, r.kind) for r in changes.normalise(raw, "/p/Content").collect())
    assert rows == [(1, "/Game/A/B", "Created"), (2, "/Game/A/B", "Changed"), (6, "/Game/A/C", "Deleted")]


def test_last_kind_wins_within_a_window(spark):
    rows = changes.debounce(
        events(spark, (1, 0, "/a", "Created"), (2, 100, "/a", "Deleted"), (3, 100, "/a", "Changed"), (4, 300, "/a", "Deleted"))
    ).orderBy("window_start")
    assert [(r.kind, r.merged) for r in rows.collect()] == [("Changed", 3), ("Deleted", 1)]


def test_stream_equals_its_batch_twin_and_drops_late_rows(spark, tmp_path):
    batches = [
        [(1, 0, "/a", "Created"), (2, 100, "/a", "Changed"), (3, 200, "/b", "Created")],
        [(4, 400, "/a", "Deleted"), (5, 900_000, "/c", "Changed")],
        # Spark judges lateness by the watermark of the batch before, so let one pass.
        [(8, 1_000_000, "/mid", "Changed")],
        [(6, 50, "/late", "Changed"), (7, 1_800_000, "/end", "Changed")],
    ]
    for n, rows in enumerate(batches):
        events(spark, *rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{n}")
    stream = (
        spark.readStream.schema(schema.CHANGE_EVENTS)
        .option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true")
        .parquet(f"{tmp_path}/in")
    )
    out = changes.debounce(stream.withWatermark("ts", "1 minute"))
    query = (
        out.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", f"{tmp_path}/ck")
        .trigger(availableNow=True)
        .start(f"{tmp_path}/out")
    )
    query.awaitTermination(120)
    got = sorted((r.asset_path, r.kind, r.merged) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    on_time = [row for rows in batches for row in rows if row[2] not in ("/late", "/end")]
    twin = changes.debounce(events(spark, *on_time))
    assert got == sorted((r.asset_path, r.kind, r.merged) for r in twin.collect())


def test_a_window_opens_with_the_first_event(spark):
    rows = [(1, 100, "/a", "Created"), (2, 350, "/a", "Changed"), (3, 399, "/a", "Deleted"), (4, 400, "/a", "Changed")]
    rows += [(5, 690, "/a", "Deleted"), (6, 700, "/a", "Created"), (7, 5000, "/a", "Changed"), (8, 120, "/b", "Created")]
    got = changes.debounce_from_first(events(spark, *rows)).orderBy("asset_path", "window_start").collect()
    ms = lambda t: round((t - START).total_seconds() * 1000)
    assert [(r.asset_path, ms(r.window_start), r.kind, r.merged) for r in got] == [
        ("/a", 100, "Deleted", 3), ("/a", 400, "Deleted", 2), ("/a", 700, "Created", 1), ("/a", 5000, "Changed", 1),
        ("/b", 120, "Created", 1),
    ]


def test_stream_of_first_opened_windows_equals_its_batch_twin(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.randrange(8000), f"/{rng.choice('abc')}", rng.choice(["Created", "Changed", "Deleted"])) for i in range(120)]
    for n in range(4):  # out of order across files, within the lateness
        events(spark, *rows[n::4]).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    for n, ms in ((4, 900_000), (5, 1_800_000)):
        events(spark, (1000 + n, ms, "/end", "Changed")).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = (
        spark.readStream.schema(schema.CHANGE_EVENTS)
        .option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true")
        .parquet(f"{tmp_path}/in")
    )
    query = (
        changes.stream_debounce_from_first(stream)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", f"{tmp_path}/ck")
        .trigger(availableNow=True)
        .start(f"{tmp_path}/out")
    )
    query.awaitTermination(200)
    assert query.exception() is None
    columns = ["asset_path", "window_start", "window_end", "kind", "merged"]
    got = spark.read.parquet(f"{tmp_path}/out").where("asset_path <> '/end'").select(columns)
    twin = changes.debounce_from_first(events(spark, *rows)).select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, twin.collect()))


def catalogue(make_assets, make_edges, assets, edges):
    return {"assets": make_assets(*[(a, "World") for a in assets]), "deps": make_edges(*edges)}


def full(spark, tables):
    return {n: tables.get(n, spark.createDataFrame([], s)) for n, s in schema.SNAPSHOT_TABLES.items()}


def batch(spark, *rows):
    return changes.debounce(events(spark, *rows))


def reported(watch, version):
    return sorted((r.problem, r.asset_path) for r in watch.reports(version).collect())


def test_only_new_problems_are_reported_and_replays_change_nothing(spark, make_assets, make_edges, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    store.write(
        1,
        catalogue(
            make_assets, make_edges, ["/Game/A", "/Game/B", "/Game/Old"], [("/Game/A", "/Game/B"), ("/Game/B", "/Game/A")]
        ),
    )
    truth = full(
        spark,
        catalogue(
            make_assets,
            make_edges,
            ["/Game/A", "/Game/C", "/Game/D", "/Game/E"],
            [("/Game/A", "/Game/C"), ("/Game/C", "/Game/D"), ("/Game/D", "/Game/C")],
        ),
    )
    watch, first = Watch(store, rescan_from(truth)), "stream"

    # A loses its edge to B and gains one to the new cycle C, D.
    one = batch(spark, (1, 0, "/Game/A", "Changed"), (2, 0, "/Game/C", "Created"), (3, 0, "/Game/D", "Created"))
    watch.process(one, 0, first)
    assert store.versions() == [1, 2]
    # B still points at A, so A is alive; B itself is new, Old was known at the start.
    assert reported(watch, 2) == [("new cycle", "/Game/C"), ("new dead asset", "/Game/B")]
    before = sorted(r.asset_path for r in store.read(2)["assets"].collect())
    watch.process(batch(spark, (9, 0, "/Game/A", "Deleted")), 0, first)
    assert store.versions() == [1, 2]
    assert sorted(r.asset_path for r in store.read(2)["assets"].collect()) == before

    # Deletes: known and unknown paths; a path created again after its delete.
    two = batch(
        spark,
        (4, 0, "/Game/B", "Deleted"),
        (5, 0, "/Game/Nowhere", "Deleted"),
        (6, 0, "/Game/E", "Deleted"),
        (7, 900, "/Game/E", "Created"),
    )
    watch.process(two, 1, first)
    now = store.read()
    assert sorted(r.asset_path for r in now["assets"].collect()) == [
        "/Game/A", "/Game/C", "/Game/D", "/Game/E", "/Game/Old",
    ]
    assert now["deps"].where(F.col("from_path") == "/Game/B").count() == 0
    # A is dead now that B is gone; E arrives unreferenced; nothing old is repeated.
    assert reported(watch, 3) == [("new dead asset", "/Game/A"), ("new dead asset", "/Game/E")]


def test_replays_are_known_after_other_writers_and_no_version_is_written_twice(spark, make_assets, make_edges, tmp_path):
    root = str(tmp_path / "store")
    store, other = SnapshotStore(spark, root), SnapshotStore(spark, root)
    start = catalogue(make_assets, make_edges, ["/Game/A"], [])
    store.write(1, start)
    truth = full(spark, catalogue(make_assets, make_edges, ["/Game/A", "/Game/C"], []))
    one = batch(spark, (1, 0, "/Game/C", "Created"))
    Watch(store, rescan_from(truth)).process(one, 0, "stream")
    other.write(3, catalogue(make_assets, make_edges, ["/Game/A", "/Game/B"], []))  # a scan comes in between
    Watch(other, rescan_from(truth)).process(one, 0, "stream")
    assert store.versions() == [1, 2, 3] and store.applied("stream") == 0 and store.applied("else") is None
    with pytest.raises(FileExistsError):
        store.write(3, start)
    # Both have chosen 4 before either has published it.
    touched = spark.createDataFrame([("/Game/D",)], "asset_path string")
    store.stage_changes(4, full(spark, catalogue(make_assets, make_edges, ["/Game/D"], [])), touched)
    other.write(4, catalogue(make_assets, make_edges, ["/Game/E"], []))
    with pytest.raises(FileExistsError):
        store.publish_changes(4)
    assert [r.asset_path for r in store.read()["assets"].collect()] == ["/Game/E"]


def test_watch_survives_a_restart_and_skips_empty_batches(spark, make_assets, make_edges, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    store.write(1, catalogue(make_assets, make_edges, ["/Game/A", "/Game/B", "/Game/C"], [("/Game/A", "/Game/B"), ("/Game/B", "/Game/C")]))

    def run(*rows):
        events(spark, *rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema.CHANGE_EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        watch = Watch(store, rescan_from(full(spark, {})))
        query = watch.writer(stream, f"{tmp_path}/ck").trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None
        return watch

    run((1, 0, "/Game/A", "Deleted"), (2, 900_000, "/Game/Z", "Deleted"))
    assert [r.asset_path for r in store.read()["assets"].orderBy("asset_path").collect()] == ["/Game/B", "/Game/C"]
    # The second event only lets the watermark pass, and later deletes of nothing change nothing.
    assert store.versions() == [1, 2]
    watch = run((3, 1_000_000, "/Game/B", "Deleted"), (4, 2_000_000, "/Game/Z", "Deleted"))
    assert store.versions() == [1, 2, 3]
    assert [r.asset_path for r in store.read()["assets"].collect()] == ["/Game/C"]
    assert [reported(watch, v) for v in (2, 3)] == [[("new dead asset", "/Game/B")], [("new dead asset", "/Game/C")]]


def test_changes_find_what_a_full_comparison_finds(spark, make_assets, make_edges, tmp_path, monkeypatch):
    monkeypatch.setattr("stowage.streaming.watch.FULL_EVERY", 2)
    rng = random.Random(6)
    names = [f"/Game/N{i}" for i in range(9)] + ["/Game/__ExternalActors__/P"]
    world = lambda: catalogue(
        make_assets, make_edges, rng.sample(names, 8), list({(rng.choice(names), rng.choice(names)) for _ in range(14)})
    )
    start = world()
    start["deps"] = start["deps"].join(start["assets"].select(F.col("asset_path").alias("from_path")), "from_path", "left_semi")
    store = SnapshotStore(spark, str(tmp_path / "store"))
    store.write(1, start)
    for n in range(4):
        truth = full(spark, world())
        known = {r.asset_path for r in truth["assets"].collect()}
        picked = rng.sample(names, 4)
        rows = [(i, 0, p, "Changed" if p in known else "Deleted") for i, p in enumerate(picked)]
        before, versions = problems(store.read()), store.versions()
        watch = Watch(store, rescan_from(truth))
        watch.process(batch(spark, *rows), n, "s")
        if store.versions() == versions:
            continue
        after = problems(store.read())
        dead = after["dead"].join(before["dead"], "asset_path", "left_anti")
        want = [("new dead asset", r.asset_path) for r in dead.collect()]
        want += [("new cycle", r.component) for r in graph.new_cycles(before["cycles"], after["cycles"]).collect()]
        assert reported(watch, store.versions()[-1]) == sorted(want)
    assert len(store.chain(store.versions()[-1])) <= 2


def test_watch_runs_as_a_stream(spark, make_assets, make_edges, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    store.write(1, catalogue(make_assets, make_edges, ["/Game/A", "/Game/B"], [("/Game/A", "/Game/B")]))
    events(spark, (1, 0, "/Game/A", "Deleted"), (2, 900_000, "/Game/Z", "Deleted")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema.CHANGE_EVENTS).parquet(f"{tmp_path}/in")
    watch = Watch(store, rescan_from(full(spark, {})))
    query = watch.writer(stream, f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    assert [r.asset_path for r in store.read()["assets"].collect()] == ["/Game/B"]
    found = [row for v in store.versions()[1:] for row in reported(watch, v)]
    assert found == [("new dead asset", "/Game/B")]

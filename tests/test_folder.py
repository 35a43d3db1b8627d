import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stowage import schema
from stowage.sources import inventory
from stowage.sources.snapshots import SnapshotStore
from stowage.streaming import changes
from stowage.streaming.folder import FolderEvents
from stowage.streaming.watch import Watch, rescan_from


def put(path, text="x", mtime=1_700_000_000):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, (mtime, mtime))


def walked(root):
    out = set()
    for folder, _, names in os.walk(root):
        for name in names:
            if name.endswith((".uasset", ".umap")):
                path = os.path.join(folder, name)
                out.add((path, int(os.path.getmtime(path)), os.path.getsize(path)))
    return out


def listed(spark, root):
    rows = inventory.discover(spark, str(root)).collect()
    found = {tuple(r) for r in rows}
    assert len(found) == len(rows)
    return found


def test_tasks_list_what_a_walk_finds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inventory, "LISTING_ROWS", 7)
    for i in range(300):
        put(tmp_path / f"a{i % 13}" / f"b{i % 7}" / ("deep/" * (i % 4)) / f"F {i}.{['uasset', 'UMAP', 'txt', 'umap'][i % 4]}", "x" * i)
    put(tmp_path / "_hidden" / ".x.uasset")
    (tmp_path / "empty").mkdir()
    (tmp_path / "loop").symlink_to(tmp_path)  # not followed
    upper = {(str(p), int(p.stat().st_mtime), p.stat().st_size) for p in tmp_path.glob("a*/**/*.UMAP")}
    want = walked(tmp_path) | upper
    assert listed(spark, tmp_path) == want
    assert listed(spark, f"file://{tmp_path}") == want
    assert listed(spark, tmp_path / "empty") == set() == listed(spark, tmp_path / "missing")


def test_many_folders(spark, tmp_path):
    for i in range(1000):
        folder = tmp_path / f"{i % 40}" / f"{i}"
        folder.mkdir(parents=True)
        for k in range(10):
            (folder / f"{k}.uasset").touch()
    assert inventory.discover(spark, str(tmp_path)).count() == 10_000


def test_polls_give_the_changes_between_listings(spark, tmp_path):
    root, home = tmp_path / "p" / "Content", str(tmp_path / "home")
    put(root / "A.uasset")
    put(root / "B.uasset")
    put(root / "Sub" / "C.umap")
    events = FolderEvents(spark, str(root), home)
    assert events.poll(datetime(2024, 1, 1)) == 1
    put(root / "A.uasset", "x", 1_700_000_009)
    put(root / "B.uasset", "longer")  # same time
    put(root / "New" / "D.uasset")
    put(root / "New" / "D.txt")
    (root / "Sub" / "C.umap").unlink()
    # A poll that dies before it has published is done again.
    os.makedirs(f"{home}/staged/{2:020d}")
    put(tmp_path / "home" / "listings" / f"{2:020d}" / "part-0", "broken")
    assert FolderEvents(spark, str(root), home).poll(datetime(2024, 1, 2)) == 2
    assert events.poll(datetime(2024, 1, 3)) == 3 and events.polls() == [1, 2, 3]

    def run(out):
        query = (
            events.stream().writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck")
            .trigger(availableNow=True).start(out)
        )
        query.awaitTermination(120)
        assert query.exception() is None
        return sorted((r.file_path.rsplit("/", 1)[1], r.action, r.ts.day) for r in spark.read.parquet(out).collect())

    want = [("A.uasset", "modify", 2), ("B.uasset", "modify", 2), ("C.umap", "remove", 2), ("D.uasset", "create", 2)]
    assert run(f"{tmp_path}/out") == want
    (root / "A.uasset").unlink()
    events.poll(datetime(2024, 1, 4))
    assert run(f"{tmp_path}/out") == sorted([*want, ("A.uasset", "remove", 4)])
    os.makedirs(f"{home}/events/{5:020d}")  # by another poller, after this one has looked
    events.polls = lambda: [1, 2, 3, 4]
    with pytest.raises(FileExistsError):
        events.poll()


def test_the_watch_opens_windows_with_the_first_event(spark, make_assets, make_edges, tmp_path):
    """0.25 s and 0.45 s lie in two windows of a fixed grid, but in one that opens at 0.25 s."""
    rows = [(1, 250, "/Game/A", "Created"), (2, 450, "/Game/A", "Deleted"), (3, 600, "/Game/A", "Created")]
    rows += [(4, 900_000, "/end", "Changed")]
    full = [(i, datetime(2024, 1, 1, 0, ms // 60_000, ms % 60_000 // 1000, ms % 1000 * 1000), p, k) for i, ms, p, k in rows]
    spark.createDataFrame(full, schema.CHANGE_EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in")
    seen = []

    class Noting(Watch):
        def process(self, batch, batch_id, stream):
            seen.extend((r.asset_path, r.kind, r.merged) for r in batch.orderBy("window_start").collect())

    stream = spark.readStream.schema(schema.CHANGE_EVENTS).parquet(f"{tmp_path}/in")
    watch = Noting(SnapshotStore(spark, str(tmp_path / "store")), rescan_from({}))
    query = watch.writer(stream, f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination(200)
    assert query.exception() is None
    assert seen == [("/Game/A", "Deleted", 2), ("/Game/A", "Created", 1)]


def test_a_folder_is_watched(spark, make_assets, make_edges, tmp_path):
    root = tmp_path / "p" / "Content"
    put(root / "A.uasset")
    put(root / "B.uasset")
    store = SnapshotStore(spark, str(tmp_path / "store"))
    store.write(1, {"assets": make_assets(("/Game/A", "World"), ("/Game/B", "World")), "deps": make_edges(("/Game/A", "/Game/B"))})
    events = FolderEvents(spark, str(root), str(tmp_path / "home"))
    events.poll(datetime(2024, 1, 1))
    (root / "A.uasset").unlink()
    events.poll(datetime(2024, 1, 2))
    put(root / "Later.uasset")  # lets the watermark pass
    events.poll(datetime(2024, 1, 3))
    none = {name: spark.createDataFrame([], s) for name, s in schema.SNAPSHOT_TABLES.items()}
    watch = Watch(store, rescan_from(none))
    raw = changes.normalise(events.stream(), str(root))
    query = watch.writer(raw, f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    assert [r.asset_path for r in store.read()["assets"].collect()] == ["/Game/B"]
    assert [(r.problem, r.asset_path) for r in watch.reports(store.versions()[-1]).collect()] == [("new dead asset", "/Game/B")]

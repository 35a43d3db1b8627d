import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from stowage.llm import permutation_index
from stowage.llm.queries import op12_nearest

SCHEMA = "vec_id bigint, embedding array<float>, label int"
QUERY = "vec_id % 20 = 0"


def usable(rows):
    kept = {}
    for i, v, *_ in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            kept[i, tuple(np.float32(v).astype(float) + 0.0)] = None
    return list(kept)


def brute(rows, k=20):
    """{(query, its vector): [(score, id)]}, nearest first."""
    known = usable(rows)
    width = max((len(v) for _, v in known), default=0)
    pad = lambda v: np.array([*v, *[0.0] * (width - len(v))])
    found = {}
    for q, v in known:
        if q is not None and q % 20 == 0:
            scored = [(float(pad(v) @ pad(w)), i) for i, w in known if i != q]
            found[q, v] = sorted(scored, key=lambda x: (-round(x[0], 12), x[1] is None, x[1] or 0))[:k]
    return found


def answers(frame):
    found = {}
    for r in frame.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.score, r.vec_id, r["rank"]))
    return found


def recall(got, want):
    """Share of the wanted answers that are found; a tie in score is as good."""
    hits = sum(
        len({i for _, i, _ in got[q]} & {i for _, i in best}) for (q, _), best in want.items()
    )
    return hits / sum(len(best) for best in want.values())


def clustered(rng, n, dims, spread=1.0):
    centres = rng.normal(size=(12, dims))
    made = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dims)) * spread
    return (made / np.linalg.norm(made, axis=1, keepdims=True)).astype("f4")


def check_order(got, rows, k=20):
    vectors = {i: v for i, v in usable(rows)}
    for q, found in got.items():
        assert [r for _, _, r in found] == list(range(1, len(found) + 1))
        assert [(-s, i) for s, i, _ in found] == sorted((-s, i) for s, i, _ in found)
        for score, i, _ in found:
            width = min(len(vectors[q]), len(vectors[i]))
            assert i != q and score == pytest.approx(np.dot(vectors[q][:width], vectors[i][:width]), abs=1e-12)


@pytest.mark.parametrize("n, cells", [(1500, (65_536, 4_096)), (3000, (40, 3))])
def test_recall_against_brute_force(spark, monkeypatch, n, cells):
    monkeypatch.setattr(permutation_index, "CELL_VECTORS", cells[0])
    monkeypatch.setattr(permutation_index, "CELL_QUERIES", cells[1])
    made = clustered(np.random.default_rng(n), n, 48)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(made)]
    got = answers(permutation_index.nearest(spark.createDataFrame(rows, SCHEMA).repartition(4), QUERY))
    want = brute(rows)
    assert all(len(found) == 20 for found in got.values()) and len(got) == len(want)
    check_order(got, rows)
    assert recall(got, want) >= 0.9


def test_recall_with_norms_of_all_sizes(spark):
    rng = np.random.default_rng(4)
    made = clustered(rng, 2000, 32) * np.exp(rng.normal(size=(2000, 1)) * 0.5)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(made.astype("f4"))]
    got = answers(permutation_index.nearest(spark.createDataFrame(rows, SCHEMA), QUERY))
    assert recall(got, brute(rows)) >= 0.9


def test_one_vector_of_a_third_of_the_rows(spark):
    made = clustered(np.random.default_rng(8), 900, 24)
    made[::3] = made[0]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(made)]
    got, want = answers(permutation_index.nearest(spark.createDataFrame(rows, SCHEMA), QUERY)), brute(rows)
    assert recall(got, want) >= 0.9
    assert [i for _, i, _ in got[0]] == [i for _, i in want[0, next(v for i, v in usable(rows) if i == 0)]]


@pytest.mark.parametrize("pivots, ranked", [(256, 128), (100, 100), (13, 13), (1, 1), (256, 3)])
def test_footrules_place_by_place(pivots, ranked):
    rng = np.random.default_rng(pivots)
    orders = np.argsort(rng.random((2500, pivots)), axis=1)[:, :ranked].astype("i4")
    query = np.argsort(rng.random(pivots))[:ranked].astype("i4")
    places = lambda order: [order.tolist().index(p) if p in order else ranked for p in range(pivots)]
    for file in (-1, int(query[0])):
        cell = permutation_index.Cell(file, orders, pivots)
        mine, footrules = cell.footrules(query)
        assert footrules.dtype == np.int32 and (len(mine) == 2500 if file < 0 else len(mine) > 0)
        # What a cell holds of an entry: a byte per pivot and its files, no number per place.
        assert sum(x.nbytes for x in vars(cell).values() if isinstance(x, np.ndarray) and x.base is None) <= 2500 * (pivots + 8 + 4 * permutation_index.POSTED)
        for at in range(0, len(mine), 97):
            pair = zip(places(orders[mine[at]]), places(query))
            assert footrules[at] == sum(abs(x - y) for x, y in pair)


def test_few_pivots_leave_queries_short_and_all_entries_are_compared_then(spark, monkeypatch):
    monkeypatch.setattr(permutation_index, "POSTED", 1)
    monkeypatch.setattr(permutation_index, "READ", 1)
    made = clustered(np.random.default_rng(9), 400, 16)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(made)]
    got = answers(permutation_index.nearest(spark.createDataFrame(rows, SCHEMA), QUERY))
    assert all(len(found) == 20 for found in got.values()) and len(got) == 20


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (20, None, 1), (40, [0.0, -0.0], 1), (60, [1.0, None], 1), (80, [nan, 1.0], 1)]
    rows += [(100, [inf, 1.0], 1), (1, [1.0], None), (2, [0.5, 2.0, 3.0], 1), (None, [1.0, 0.0], 1), (120, [], 1)]
    rows += [(3, [-0.0, 1.0], 1), (3, [0.0, 1.0], 1), (5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", query string, file int")
    got = answers(permutation_index.nearest(df, QUERY))
    assert got == {0: [(1.0, 1, 1), (1.0, 5, 2), (1.0, None, 3), (0.5, 2, 4), (0.0, 3, 5)]}
    alone = permutation_index.nearest(spark.createDataFrame(rows[:1], SCHEMA), QUERY)
    assert alone.collect() == [] and alone.columns == ["query_id", "rank", "vec_id", "score"]
    assert permutation_index.nearest(spark.createDataFrame([], SCHEMA), QUERY).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_recall_on_the_table(spark):
    folder = "/root/testdata/sf0.01"
    got = answers(op12_nearest(spark, folder))
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check_order(got, rows)
    assert recall(got, brute(rows)) >= 0.95

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stowage.llm import exact_dedup, fuse
from stowage.llm.queries import exact_copies


@pytest.mark.parametrize("n", [1, 2, 3, 10, 500, 40_000])
def test_filter_knows_every_key_and_few_others(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, n).astype("u8")
    made = fuse.build(keys)
    assert fuse.contains(keys, *made).all()
    others = rng.integers(0, 2**63, 20_000).astype("u8")
    assert fuse.contains(others, *made).mean() < 0.01
    if n >= 500:
        assert len(made[3]) < 1.6 * n + 200


def brute(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(text or "", []).append(i)
    out = []
    for i, text in rows:
        ids = groups[text or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id bigint, text string, keep_id string")
    return df, sorted((tuple(r) for r in exact_copies(df).collect()), key=repr)


def test_against_brute_force(spark):
    rows = [(i, f"text {i % 700}") for i in range(1000)] + [(2000 + i, "hot") for i in range(400)]
    rows += [(5, "text 5"), (5, "text 5"), (None, "none"), (None, "none"), (None, "hot"), (7000, None), (7001, "")]
    rows += [(7002, "hot "), (7003, "Hot"), (7004, "long " * 50_000), (7005, "long " * 50_000)]
    df, got = run(spark, rows)
    assert got == brute(rows)


def test_only_one_row_of_equal_texts_is_left(spark):
    rows = [(i, f"t{i % 7}") for i in range(50)] + [(49, "t0"), (49, "t0"), (None, "q"), (None, "q"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = exact_dedup.drop_duplicates(df, F.col("doc_id") % 2 == 0)
    assert sorted(r.text or "" for r in left.collect()) == sorted({t or "" for _, t in rows})
    assert left.columns == df.columns


def test_empty_table(spark):
    assert run(spark, [])[1] == []

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from stowage.llm import mixing
from stowage.llm.queries import mixed


def brute(rows):
    """Targets by filling sources one after the other, and taken words by walking each source."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    total = {s: sum(size(t) for _, t, x in rows if x == s) for s in sources}
    goal, open_ = {}, set(sources)
    while open_:
        per = (sum(total.values()) - sum(goal.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if per * weight[s] > 3 * total[s]}
        if not full:
            goal |= {s: per * weight[s] for s in open_}
            break
        goal |= {s: 3.0 * total[s] for s in full}
        open_ -= full
    out = []
    for s in sources:
        own = [(hashlib.md5(str("" if i is None else i).encode()).hexdigest(), i, size(t)) for i, t, x in rows if x == s]
        own.sort(key=lambda r: (r[0], r[1] is None, r[1] or 0))
        taken = [0] * len(own)
        at = 0
        for _ in range(3):
            for k, (_, _, n) in enumerate(own):
                if at + n / 2 <= goal[s]:
                    taken[k] += n
                at += n
        out += [(i, n, total[s], pytest.approx(goal[s]), x) for (_, i, n), x in zip(own, taken)]
    return out


def make(seed, n, names):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = rng.choice([0, 1, 3, 20, 200])
        rows.append((i * 7, "w\t" * words, rng.choice(names)))
    return rows


@pytest.mark.parametrize("seed, names", [(1, ["a"] * 50 + ["b", "é", "Z", None]), (2, ["x", None]), (3, [None])])
def test_against_brute_force(spark, monkeypatch, seed, names):
    monkeypatch.setattr(mixing, "CUT_ROWS", 20)
    rows = make(seed, 600, names) + [(None, "a b c", "a"), (10**9, None, "void"), (10**9 + 1, " ", "void")]
    df = spark.createDataFrame([(*r, 3.0) for r in rows], "doc_id bigint, text string, source string, target double")
    got = sorted(((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in mixed(df).collect()), key=repr)
    want = sorted(brute(rows), key=lambda r: repr((r[0], r[1], r[2], r[3].expected, r[4])))
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: (r[0] is None, r[0] or 0)), sorted(want, key=lambda r: (r[0] is None, r[0] or 0))):
        assert g == w


def test_words_come_near_the_target_and_no_document_beyond_three_times(spark):
    rows = make(4, 800, ["hot"] * 9 + ["s1", "s2", "s3"])
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixed(df).join(df.select("doc_id", "source"), "doc_id")
    assert got.where("taken > 3 * size").count() == 0
    for r in got.groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n"), F.max("size").alias("m")).collect():
        assert abs(r.t - r.n) <= r.m / 2 + 1e-6


def test_mix_repeats_rows_and_follows_the_schedule(spark):
    rows = [(i, "w " * 10, s) for s in ("a", "b", "c") for i in range(ord(s) * 1000, ord(s) * 1000 + 400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = [r.source for r in mixing.mix(df).collect()]
    plan = {r.doc_id: r.copies for r in mixed(df).collect()}
    assert len(out) == sum(plan.values())
    half = len(out) // 2
    assert out[:half].count("a") > out[half:].count("a") and out[:half].count("c") < out[half:].count("c")
    even = [r.first_position for r in mixed(df).collect() if ord("b") * 1000 <= r.doc_id < ord("c") * 1000]
    assert sum(even) / len(even) == pytest.approx(0.5, abs=0.02)


@pytest.mark.parametrize("weight", [1, 2, 3])
def test_due_inverts_the_integral(spark, weight):
    got = [r[0] for r in spark.range(101).select(mixing.due(F.col("id") / 100, F.lit(weight))).collect()]
    knots = mixing.SCHEDULES[weight]

    def strength(t):
        for (a, f), (b, g) in zip(knots, knots[1:]):
            if t <= b:
                return f + (g - f) * (t - a) / (b - a)

    steps = 20_000
    grid = [strength((k + 0.5) / steps) / steps for k in range(steps)]
    for i in range(0, 101, 10):
        assert sum(grid[: round(got[i] * steps)]) == pytest.approx(i / 100 * sum(grid), abs=1e-3)


def test_reruns_agree_and_empty_tables_give_no_rows(spark):
    rows = make(5, 200, ["a", "b"])
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    again = df.repartition(7).orderBy(F.rand(3))
    assert sorted(mixed(df).collect()) == sorted(mixed(again).collect())
    assert mixed(df.limit(0)).collect() == [] and mixing.mix(df.limit(0)).collect() == []

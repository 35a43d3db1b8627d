import random

import numpy as np
import pytest

from stowage.llm import quality
from stowage.llm.queries import graded, ratings


def corpus(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        grade = rng.choice([0, 1, 2, 2, 2])
        words = ["".join(rng.choices(["ka", "lo", "mi", "tur"], k=3)) for _ in range(rng.randint(5, 200))]
        if grade == 0:
            words = [w + "%%%" if rng.random() < 0.5 else w for w in words]
        elif grade == 1:
            words = [w if rng.random() < 0.8 else "meh" + w for w in words]
        rows.append((i, " ".join(words), 1))
        labels.append((i, grade, 0))
    return rows, labels


def test_held_out_grades_and_special_rows(spark):
    rows, labels = corpus(900, 3)
    extra = [(5000, None, 1), (5001, "", 1), (5002, rows[0][1], 1), (None, "ka", 1), (5003, "ka%%% " * 60_000, 1)]
    docs = spark.createDataFrame(rows + extra, "doc_id bigint, text string, tails int")
    marks = spark.createDataFrame([*labels, (None, 1, 0), (3, None, None)], "doc_id bigint, quality int, toxic int")
    got = graded(docs, marks).collect()
    assert len(got) == len(rows) + len(extra)
    truth = {i: int(q > 0) for i, q, _ in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    for r in got:
        assert 0 <= r.top_tail <= r.score <= 1 and r.expected_grade == pytest.approx(r.score + r.top_tail)
    by_id = {r.doc_id: r.score for r in got}
    assert by_id[5000] == by_id[5001] and by_id[5002] == by_id[0] and by_id[5003] < 0.5


def test_fit_finds_the_maximum_of_the_likelihood():
    rows, labels = corpus(400, 5)
    grades = [q for _, q, _ in labels]
    shares = {g: grades.count(g) / len(grades) for g in (0, 1, 2)}
    model = quality.fit([t for _, t, _ in rows], grades, shares)
    assert model.thresholds[0] < model.thresholds[1]
    features = quality.Features()
    s = np.array([model.strength(*features.of(t)) for _, t, _ in rows])

    def likelihood(thresholds):
        tails = 1 / (1 + np.exp(-(s[:, None] - thresholds)))
        reach = np.concatenate([np.ones((len(s), 1)), tails, np.zeros((len(s), 1))], axis=1)
        row = np.arange(len(s))
        return np.log(reach[row, grades] - reach[row, np.array(grades) + 1]).mean()

    best = likelihood(model.thresholds)
    for k in range(2):
        for change in (-0.5, 0.5):
            assert likelihood(model.thresholds + change * (np.arange(2) == k)) < best + 1e-3


def test_without_ratings_or_documents(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert [r.kept for r in graded(docs, none).collect()] == [False]
    assert [r.expected_grade for r in graded(docs, one).collect()] == [1.0]
    assert graded(docs.limit(0), one).collect() == []


@pytest.mark.parametrize("grades", [2, 3, 4])
def test_scores_against_plain_python(spark, grades):
    rows, labels = corpus(300, 7)
    labels = [(i, q + (i % 2 if grades == 4 and q == 2 else 0) if grades > 2 else min(q, 1), 1) for i, q, _ in labels]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, tails int")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = quality.fit(*quality.rated_sample(docs, ratings(marks)))
    assert len(model.thresholds) == grades - 1 and list(model.thresholds) == sorted(model.thresholds)
    texts = {i: t for i, t, _ in rows}
    for r in graded(docs, marks).collect():
        words = texts[r.doc_id].encode().split()
        strength = sum(model.weights[f] for w in words for f in quality.features_of(w)) / len(words)
        strength += model.weights[quality.REPEAT] * sum(a == b for a, b in zip(words, words[1:])) / len(words)
        tails = [1 / (1 + np.exp(-(quality.SCALE * strength - t))) for t in model.thresholds]
        assert r.score == pytest.approx(tails[0], abs=1e-9) and r.top_tail == pytest.approx(tails[-1], abs=1e-9)
        assert r.expected_grade == pytest.approx(sum(tails), abs=1e-9)

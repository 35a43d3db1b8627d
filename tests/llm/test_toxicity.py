import random
import zlib

import numpy as np
import pytest

from stowage.llm import toxicity
from stowage.llm.queries import toxic


def test_windows_cover_every_word_and_overlap_by_half():
    sizes = np.array([32, 33, 48, 100, 1000])
    begins, firsts = toxicity.windows(sizes)
    ends = np.cumsum(sizes)
    for k, (first, size) in enumerate(zip(firsts, sizes)):
        own = begins[first : firsts[k + 1] if k + 1 < len(firsts) else None] - (ends[k] - size)
        assert own[0] == 0 and own[-1] == size - toxicity.WINDOW
        assert all(0 < b - a <= toxicity.STRIDE for a, b in zip(own, own[1:]))


def test_trigrams_stay_within_their_word():
    rows, starts = toxicity.gram_rows([b"ab", b"x", b"longer"])
    alone = [toxicity.gram_rows([w])[0].tolist() for w in (b"ab", b"x", b"longer")]
    assert [list(p) for p in np.split(rows, starts[1:])] == alone
    assert rows.max() < toxicity.GRAM_ROWS


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    net = toxicity.Network.start()
    net.p = {k: v.astype("f8") for k, v in net.p.items()}
    words = [b"alpha", b"beta", b"gamma", b"x"]
    at = rng.integers(0, 5, (6, 9))
    y = np.array([0, 1, 1, 0, 1, 0.0])

    def loss():
        x = np.concatenate([np.zeros((1, 2 * toxicity.WIDTH)), net.vectors(words)])
        gates = net.gates(x)
        states = np.concatenate([net.layer(side, gates[side], at) for side in "fb"], axis=2)
        logit = net.pool(states.astype("f8"))[-1]
        return float(np.mean(np.log1p(np.exp(logit)) - y * logit))

    got = net.gradients(words, at, y)
    for name, grad in got.items():
        for spot in rng.permutation(np.flatnonzero(np.abs(grad) > 1e-4))[:3]:
            where = np.unravel_index(spot, grad.shape)
            old = net.p[name][where]
            net.p[name][where] = old + 1e-2
            up = loss()
            net.p[name][where] = old - 1e-2
            down = loss()
            net.p[name][where] = old
            assert (up - down) / 2e-2 == pytest.approx(grad[where], rel=0.05, abs=2e-4), (name, where)


def corpus(n, seed):
    rng = random.Random(seed)
    syllables = ["ka", "lo", "mi", "tur", "ven", "sha", "po", "ri"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices(syllables, k=3)) for _ in range(rng.randint(1, 300))]
        bad = i % 4 == 0
        for _ in range(4 if bad else 0):
            words.insert(rng.randint(0, len(words)), "grumb" + rng.choice(["u", "aka", "osha", "en"]))
        rows.append((i, " ".join(words), "q"))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_accuracy_and_special_rows(spark, monkeypatch):
    rows, labels = corpus(700, 1)
    special = [(10_000, None, "x"), (10_001, "", "x"), (10_002, rows[4][1], "x"), (4, rows[4][1], "x"), (None, "ka lo", "x")]
    special += [(10_003, "ka lo mi " * 20_000, "x"), (10_004, "ka lo mi " * 20_000 + "grumbu grumbaka grumben", "x")]
    docs = spark.createDataFrame(rows + special, "doc_id bigint, text string, score string")
    marks = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id bigint, toxic int")
    got = toxic(docs, marks).collect()
    assert len(got) == len(rows) + len(special)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    score = {r.doc_id: r.score for r in got}
    assert score[10_000] == score[10_001] and score[10_002] == score[4]
    assert score[10_004] > 0.5 > score[10_003]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    monkeypatch.setattr(toxicity, "MEMO_WORDS", 10)
    assert {r.doc_id: r.score for r in toxic(docs, marks).collect()} == score


def test_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    one = spark.createDataFrame([(1, 1)], "doc_id bigint, toxic int")
    assert [r.score for r in toxic(docs, none).collect()] == [0.0]
    assert [r.score for r in toxic(docs, one).collect()] == [1.0]
    assert toxic(docs.limit(0), one).collect() == []


def rare_insults(n, seed):
    """Long texts of words that hardly recur; every eighth holds one or two of six insults."""
    rng = random.Random(seed)
    syllables = ["ka", "lo", "mi", "tur", "ven", "sha", "po", "ri", "dal", "es", "qui", "on"]
    texts, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices(syllables, k=rng.randint(2, 5))) for _ in range(rng.randint(30, 400))]
        for _ in range(rng.randint(1, 2) if i % 8 == 0 else 0):
            words.insert(rng.randint(0, len(words)), rng.choice(["grumb", "vileze", "hatog", "scorz", "bleck", "fuzzat"]))
        texts.append(" ".join(words))
        labels.append(int(i % 8 == 0))
    return texts, labels


def test_learns_insults_instead_of_texts_by_heart():
    net = toxicity.train(*rare_insults(480, 3), 0.125)
    texts, labels = rare_insults(400, 4)
    found = toxicity.Scorer(net).score(texts) >= 0.5
    truth = np.array(labels) == 1
    assert found[truth].mean() >= 0.9 and found[~truth].mean() <= 0.01


def test_sureness_prefers_words_of_many_texts():
    texts = ["bad own%d und" % i for i in range(6)] + ["und so%d" % i for i in range(6)]
    sample = toxicity.Sample(texts)
    sure = toxicity.sureness(sample, np.array([1] * 6 + [0] * 6, "f4"))
    by_word = dict(zip([b""] + sample.words, sure))
    assert by_word[b"bad"] > by_word[b"own1"] > 0 == by_word[b"und"] == by_word[b"so1"] == by_word[b""]


def plain_logit(net, words):
    """The network word by word, in plain Python floats."""
    x = [np.zeros(2 * toxicity.WIDTH)] * (toxicity.WINDOW - len(words))
    x = [net.vectors([w])[0].astype("f8") for w in words] + x
    sides = []
    for side, order in (("f", range(len(x))), ("b", reversed(range(len(x))))):
        h, states, size = np.zeros(toxicity.HIDDEN), {}, toxicity.HIDDEN
        for t in order:
            g = x[t] @ net.p[f"W{side}"] + net.p[f"c{side}"]
            s = h @ net.p[f"U{side}"]
            z = 1 / (1 + np.exp(-(g[:size] + s[:size])))
            r = 1 / (1 + np.exp(-(g[size : 2 * size] + s[size : 2 * size])))
            h = (1 - z) * np.tanh(g[2 * size :] + r * s[2 * size :]) + z * h
            states[t] = h
        sides.append(states)
    both = [np.concatenate([sides[0][t], sides[1][t]]) for t in range(len(x))]
    e = np.array([np.tanh(b @ net.p["A"] + net.p["a"]) @ net.p["v"] for b in both])
    weight = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
    return sum(w * (b @ net.p["w"]) for w, b in zip(weight, both)) + net.p["d"][0]


def test_scores_against_a_plain_forward_pass():
    net = toxicity.Network.start(known=[b"ka", b"lo"])
    net.slope, net.level = 1.7, -0.3
    rng = random.Random(5)
    for n in (0, 1, 31, 32, 33, 100):
        words = [rng.choice([b"ka", b"lo", b"mi", "é".encode()]) for _ in range(n)]
        begins = sorted({*range(0, max(1, n - toxicity.WINDOW + 1), toxicity.STRIDE), max(0, n - toxicity.WINDOW)})
        worst = max(plain_logit(net, words[b : b + toxicity.WINDOW]) for b in begins)
        want = 1 / (1 + np.exp(-(1.7 * worst - 0.3)))
        got = toxicity.Scorer(net).score([b" ".join(words).decode()])[0]
        assert got == pytest.approx(want, rel=1e-4), n


def test_repeated_ids_give_the_same_sample(spark):
    rows = [(i % 3, "text %d" % i) for i in range(200)]
    marks = spark.createDataFrame([(0, 1), (1, 0), (2, 0)], "doc_id bigint, toxic int")
    samples = [
        toxicity.labelled_sample(spark.createDataFrame(own, "doc_id bigint, text string").repartition(k), marks, per_class=5)
        for k, own in ((3, rows), (7, rows[::-1]))
    ]
    assert samples[0] == samples[1] and len(samples[0][0]) == 10

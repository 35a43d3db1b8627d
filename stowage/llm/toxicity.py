"""Toxicity scores by a bidirectional gated recurrent network over all windows of a text.

A word enters the network twice: by an embedding of its hash, and by the mean embedding of its
character trigrams, which also covers word forms never seen. Two recurrent layers read a window
of `WINDOW` words from both ends, attention pools their states, and a logistic unit scores the
window. Windows overlap by half and cover the whole text; a text is as toxic as its worst window.

Training is numpy on a sample of labelled rows, at most `PER_CLASS` of each label, chosen by a
hash of their id, of rows with one id those with the least texts. Equal texts count once. Labels
are known for texts, not windows: the word that speaks most surely for toxic texts (`sureness`)
picks the first window of each, then the network itself picks the worst window of every text, in
turns with training on them.

A toxic text is mostly ordinary words, and a network of this size learns them by heart. So words
of fewer than `MIN_TEXTS` texts share an embedding, weights decay, and windows exchange words: in
toxic ones ordinary words take the place of words that prove nothing, and clean ones are given
such words of toxic texts; some windows lose their end, as short and empty texts are padded. Texts without a sure word join in the second half of the turns. A part
of the sample is kept out of training; it picks the turn to keep, and a logistic step on it sets
slope and level of the worst windows' scores, with the labels weighted as they occur, so that
0.5 separates.

Scoring runs in Arrow batches with a memo of word inputs that starts anew when full. Null texts
count as empty; an empty text is one window of padding. Scores are rounded to five
digits, so that they depend on the text alone and repeated rows score alike. Empty tables give
no rows.
Without labels of both kinds every score is the share of toxic labels (0 if there are none).
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.llm.common import small_batches, whole

WINDOW, STRIDE = 32, 16
GRAM_ROWS = 8192
# Words of fewer training texts share one embedding.
MIN_TEXTS = 3
# Weight decay; every VALIDATION-th text is checked against.
DECAY, VALIDATION = 0.1, 5
# Shares of words exchanged, of clean windows that get them, and of windows cut short.
SWAP, SWAPPED_CLEAN, SHORT = 0.5, 0.7, 0.1
WIDTH, HIDDEN, ATTENTION = 8, 8, 8
PER_CLASS = 1500
ROUNDS, STEPS, BATCH, RATE = 8, 60, 128, 0.01
MEMO_WORDS = 200_000
# ASCII punctuation separates words; other bytes stay.
SPACED = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(SPACED).split()


def gram_rows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the character trigrams of all words in `<…>`, and where each word's begin."""
    raw = np.frombuffer(b"".join(b"<%s>" % w for w in words), "u1").astype(np.uint32)
    sizes = np.fromiter(map(len, words), "i8", len(words))
    starts = np.concatenate([[0], np.cumsum(sizes + 2)[:-1]])
    code = raw[:-2] * np.uint32(0x9E3779B1) + raw[1:-1] * np.uint32(0x85EBCA6B) + raw[2:] * np.uint32(0xC2B2AE35)
    code ^= code >> np.uint32(15)
    rows = (code * np.uint32(0x2C1B3C6D) >> np.uint32(32 - 13)).astype("i8")  # 13 bits: GRAM_ROWS
    keep = np.ones(len(raw) - 2, bool)
    ends = starts[1:]
    keep[ends - 1] = keep[ends - 2] = False  # trigrams that would reach into the next word
    return rows[keep], np.concatenate([[0], np.cumsum(sizes)[:-1]])


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of every window of texts that lie one after the other, and each text's first window.

    `sizes` are at least WINDOW. The last window of a text ends with the text.
    """
    counts = np.maximum(0, -(-(sizes - WINDOW) // STRIDE)) + 1
    firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    nth = np.arange(counts.sum()) - np.repeat(firsts, counts)
    last = np.repeat(begins + sizes - WINDOW, counts)
    return np.minimum(np.repeat(begins, counts) + nth * STRIDE, last), firsts


def scatter(rows: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of `values` by the row they belong to."""
    out = np.zeros((rows, values.shape[1]), values.dtype)
    if len(at):
        order = np.argsort(at, kind="stable")
        own = at[order]
        starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        out[own[starts]] = np.add.reduceat(values[order], starts)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    p: dict[str, np.ndarray]
    slope: float = 1.0
    level: float = 0.0
    constant: float | None = None
    known: dict[bytes, int] = field(default_factory=dict)

    @classmethod
    def start(cls, seed: int = 7, known: Iterable[bytes] = ()) -> "Network":
        """Row 0 of the words' embeddings stands for every word that is not in `known`."""
        known = {w: i + 1 for i, w in enumerate(known)}
        rng = np.random.default_rng(seed)
        make = lambda scale, *shape: (rng.normal(size=shape) * scale).astype("f4")
        p = {"word": make(0.1, len(known) + 1, WIDTH), "gram": make(0.3, GRAM_ROWS, WIDTH)}
        for side in "fb":
            p[f"W{side}"] = make(0.3, 2 * WIDTH, 3 * HIDDEN)
            p[f"U{side}"] = make(0.3, HIDDEN, 3 * HIDDEN)
            p[f"c{side}"] = np.zeros(3 * HIDDEN, "f4")
        p |= {"A": make(0.3, 2 * HIDDEN, ATTENTION), "a": np.zeros(ATTENTION, "f4"), "v": make(0.5, ATTENTION)}
        p |= {"w": make(0.5, 2 * HIDDEN), "d": np.zeros(1, "f4")}
        return cls(p, known=known)

    def word_rows(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter((self.known.get(w, 0) for w in words), "i8", len(words))

    def vectors(self, words: list[bytes]) -> np.ndarray:
        """Word and character inputs of distinct words; no words: no rows."""
        if not words:
            return np.zeros((0, 2 * WIDTH), "f4")
        grams, starts = gram_rows(words)
        sizes = np.diff([*starts, len(grams)])[:, None].astype("f4")
        chars = np.add.reduceat(self.p["gram"][grams], starts) / sizes
        return np.concatenate([self.p["word"][self.word_rows(words)], chars], axis=1)

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {side: x @ self.p[f"W{side}"] + self.p[f"c{side}"] for side in "fb"}

    def layer(self, side: str, gates: np.ndarray, at: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (windows, words, HIDDEN) of one direction; `at` has rows of `gates`."""
        n, size = at.shape
        u = self.p[f"U{side}"]
        h = np.zeros((n, HIDDEN), "f4")
        states = np.empty((n, size, HIDDEN), "f4")
        for t in range(size) if side == "f" else range(size - 1, -1, -1):
            g, s = gates[at[:, t]], h @ u
            zr = _sigmoid(g[:, : 2 * HIDDEN] + s[:, : 2 * HIDDEN])
            z, r, sn = zr[:, :HIDDEN], zr[:, HIDDEN:], s[:, 2 * HIDDEN :]
            new = np.tanh(g[:, 2 * HIDDEN :] + r * sn)
            if keep is not None:
                keep.append((t, h, z, r, new, sn))
            h = new + z * (h - new)
            states[:, t] = h
        return states

    def pool(self, states: np.ndarray) -> tuple[np.ndarray, ...]:
        s = np.tanh(states @ self.p["A"] + self.p["a"])
        e = s @ self.p["v"]
        weight = np.exp(e - e.max(axis=1, keepdims=True))
        weight /= weight.sum(axis=1, keepdims=True)
        pooled = np.einsum("nt,nth->nh", weight, states)
        return s, weight, pooled, pooled @ self.p["w"] + self.p["d"][0]

    def logits(self, gates: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
        out = np.empty(len(at), "f4")
        for i in range(0, len(at), 4096):  # bounds what is held at once
            part = at[i : i + 4096]
            states = np.concatenate([self.layer(side, gates[side], part) for side in "fb"], axis=2)
            out[i : i + 4096] = self.pool(states)[-1]
        return out

    def probability(self, worst: np.ndarray) -> np.ndarray:
        # Single precision sums differ in their last digits with the texts scored beside them.
        return np.round(_sigmoid(self.slope * worst.astype("f8") + self.level), 5)

    def gradients(self, words: list[bytes], at: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over windows; row 0 of `at` is padding, row i + 1 is words[i]."""
        p, n = self.p, len(at)
        x = np.concatenate([np.zeros((1, 2 * WIDTH), "f4"), self.vectors(words)])
        gates = self.gates(x)
        kept = {"f": [], "b": []}
        states = np.concatenate([self.layer(side, gates[side], at, kept[side]) for side in "fb"], axis=2)
        s, weight, pooled, logit = self.pool(states)
        g = {}
        d_logit = ((_sigmoid(logit) - y) / n).astype("f4")
        g["w"], g["d"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * p["w"]
        d_weight = np.einsum("nth,nh->nt", states, d_pooled)
        d_e = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
        g["v"] = np.einsum("nta,nt->a", s, d_e)
        d_s = d_e[:, :, None] * p["v"] * (1 - s * s)
        g["A"], g["a"] = np.einsum("nth,nta->ha", states, d_s), d_s.sum(axis=(0, 1))
        d_states = weight[:, :, None] * d_pooled[:, None, :] + d_s @ p["A"].T
        d_x = np.zeros_like(x)
        for k, side in enumerate("fb"):
            u, d_steps = p[f"U{side}"], np.zeros((n, at.shape[1], 3 * HIDDEN), x.dtype)
            d_u, d_h = np.zeros_like(u), np.zeros((n, HIDDEN), "f4")
            for t, h, z, r, new, sn in reversed(kept[side]):
                d = d_h + d_states[:, t, k * HIDDEN : (k + 1) * HIDDEN]
                d_new = d * (1 - z) * (1 - new * new)
                d_z = d * (h - new) * z * (1 - z)
                d_r = d_new * sn * r * (1 - r)
                d_s_all = np.concatenate([d_z, d_r, d_new * r], axis=1)
                d_u += h.T @ d_s_all
                d_h = d * z + d_s_all @ u.T
                d_steps[:, t] = np.concatenate([d_z, d_r, d_new], axis=1)
            d_gates = scatter(len(x), at.ravel(), d_steps.reshape(-1, 3 * HIDDEN))
            g[f"U{side}"], g[f"c{side}"] = d_u, d_gates.sum(axis=0)
            g[f"W{side}"] = x.T @ d_gates
            d_x += d_gates @ p[f"W{side}"].T
        g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        if words:
            g["word"] = scatter(len(p["word"]), self.word_rows(words), d_x[1:, :WIDTH])
            grams, starts = gram_rows(words)
            sizes = np.diff([*starts, len(grams)])
            g["gram"] = scatter(GRAM_ROWS, grams, np.repeat(d_x[1:, WIDTH:] / sizes[:, None], sizes, axis=0))
        return g


class Adam:
    def __init__(self, p: dict[str, np.ndarray]):
        self._m, self._v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
        self._t = 0

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray], rate: float) -> None:
        self._t += 1
        size = math.sqrt(sum(float((x * x).sum()) for x in g.values()))
        clip = min(1.0, 1.0 / (size + 1e-12))
        for k, x in g.items():
            x = x * clip
            self._m[k] += 0.1 * (x - self._m[k])
            self._v[k] += 0.001 * (x * x - self._v[k])
            m, v = self._m[k] / (1 - 0.9**self._t), self._v[k] / (1 - 0.999**self._t)
            p[k] -= (rate * (m / (np.sqrt(v) + 1e-8) + DECAY * p[k])).astype("f4")


class Sample:
    """Training texts as word numbers (0 is padding), one after the other."""

    def __init__(self, texts: list[str | None]):
        split = [words_of(t) for t in texts]
        self.words = sorted(set(chain.from_iterable(split)))
        number = {w: i + 1 for i, w in enumerate(self.words)}
        padded = [[number[w] for w in own] + [0] * (WINDOW - len(own)) for own in split]
        self.flat = np.array(list(chain.from_iterable(padded)), "i8")
        self.begins, self.firsts = windows(np.array([len(x) for x in padded], "i8"))
        self.ends = np.append(self.firsts[1:], len(self.begins))
        self.sets = [set(own) for own in split]
        self.sizes = np.array([len(x) for x in padded], "i8")
        self.text_begins = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])

    def at(self, chosen: np.ndarray) -> np.ndarray:
        return self.flat[self.begins[chosen][:, None] + np.arange(WINDOW)]

    def best(self, marks: np.ndarray) -> np.ndarray:
        """The highest mark among the words of every window."""
        parts = range(0, len(self.begins), 4096)
        return np.concatenate([marks[self.at(np.arange(i, min(i + 4096, len(self.begins))))].max(axis=1) for i in parts])

    def scores(self, net: Network) -> np.ndarray:
        x = np.concatenate([np.zeros((1, 2 * WIDTH), "f4"), net.vectors(self.words)])
        return net.logits(net.gates(x), self.flat[self.begins[:, None] + np.arange(WINDOW)])

    def worst(self, scores: np.ndarray) -> np.ndarray:
        """The best-scored window of every text."""
        top = np.maximum.reduceat(scores, self.firsts)
        at = np.flatnonzero(scores == np.repeat(top, self.ends - self.firsts))
        return at[np.searchsorted(at, self.firsts)]


def sureness(sample: "Sample", y: np.ndarray) -> np.ndarray:
    """How surely a word speaks for toxic texts, by its number: a one-sided log-likelihood ratio.

    It weighs in how many texts a word occurs, so a word of many toxic texts comes before one
    that a single text happens to hold.
    """
    n = [int((y == k).sum()) for k in (0, 1)]
    seen = [Counter(chain.from_iterable(s for s, own in zip(sample.sets, y) if own == k)) for k in (0, 1)]
    have = [np.array([seen[k][w] for w in sample.words], "f8") for k in (0, 1)]
    both = (have[0] + have[1]) / (n[0] + n[1])

    def gain(k: int) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            inside = np.where(have[k] > 0, have[k] * np.log(have[k] / n[k] / both), 0.0)
            outside = np.where(have[k] < n[k], (n[k] - have[k]) * np.log((1 - have[k] / n[k]) / (1 - both)), 0.0)
        return inside + outside

    return np.append(0.0, np.where(have[1] / n[1] > have[0] / n[0], gain(0) + gain(1), 0.0))


def exchange(
    numbers: np.ndarray, sure: np.ndarray, innocent: np.ndarray, ordinary: np.ndarray, rng: np.random.Generator
) -> None:
    """Make the words around sure ones and the length tell nothing; the first half of the windows is toxic.

    Toxic windows with a sure word get `ordinary` words in place of others, clean ones `innocent`
    words of toxic texts. Without sure words in the sample nobody knows which are innocent.
    """
    half, own = len(numbers) // 2, sure[numbers]
    least = np.where(own, np.arange(1, numbers.shape[1] + 1), 0).max(axis=1)
    cut = (rng.random(len(numbers)) < SHORT) & ((least > 0) | (np.arange(len(numbers)) >= half))
    length = np.where(cut, np.maximum(least, rng.integers(0, numbers.shape[1], len(numbers))), numbers.shape[1])
    numbers[np.arange(numbers.shape[1]) >= length[:, None]] = 0
    if not sure.any():
        return
    rows = np.append(own[:half].any(axis=1), rng.random(len(numbers) - half) < SWAPPED_CLEAN)
    swap = (rng.random(numbers.shape) < SWAP) & rows[:, None] & (numbers > 0)
    swap[:half] &= ~own[:half]
    for part, pool in ((slice(None, half), ordinary), (slice(half, None), innocent)):
        if len(pool):
            at = swap[part]
            numbers[part][at] = pool[rng.integers(0, len(pool), int(at.sum()))]


def train(texts: list[str | None], labels: list[int], share: float) -> Network:
    """A network from a bounded sample; `share` is how often label 1 occurs among all labels."""
    if not labels or min(labels) == max(labels):
        return Network({}, constant=float(share))
    # Copies would make a text's own words look common; equal texts count once.
    distinct = sorted({(t or "", k) for t, k in zip(texts, labels)})
    aside = [zlib.crc32(t.encode()) % VALIDATION == 0 for t, _ in distinct]
    kept = [x for x, out in zip(distinct, aside) if not out]
    checked = [x for x, out in zip(distinct, aside) if out]
    if len({k for _, k in kept}) < 2 or len({k for _, k in checked}) < 2:
        kept = checked = distinct
    y, rng = np.array([k for _, k in kept], "f4"), np.random.default_rng(7)
    sample, check = Sample([t for t, _ in kept]), Sample([t for t, _ in checked])
    truth = np.array([k for _, k in checked], "f4")
    texts_with = Counter(chain.from_iterable(sample.sets))
    sure = sureness(sample, y)
    scores = sample.best(sure)
    sure = sure > math.log(len(sample.words) + 1)
    surely = np.logical_or.reduceat(sure[sample.flat], sample.text_begins)
    of_text = np.repeat(y, sample.sizes)
    innocent = sample.flat[(of_text == 1) & ~sure[sample.flat] & (sample.flat > 0)]
    ordinary = sample.flat[(of_text == 0) & (sample.flat > 0)]
    net = Network.start(known=[w for w in sample.words if texts_with[w] >= MIN_TEXTS])
    adam, best = Adam(net.p), None
    for turn in range(ROUNDS):
        worst = sample.worst(scores)
        # Clean texts also give windows at random, so that all of ordinary prose is seen.
        clean = np.flatnonzero(y == 0)
        others = rng.integers(sample.firsts[clean], sample.ends[clean])
        chosen, target = np.concatenate([worst, others]), np.concatenate([y, np.zeros(len(others), "f4")])
        bad = np.flatnonzero(y == 1)
        if 2 * turn < ROUNDS and surely[bad].any():
            bad = bad[surely[bad]]
        weight = {1: bad, 0: np.flatnonzero(target == 0)}
        for _ in range(STEPS):
            pick = np.concatenate([rng.choice(weight[1], BATCH // 2), rng.choice(weight[0], BATCH // 2)])
            numbers = sample.at(chosen[pick])
            exchange(numbers, sure, innocent, ordinary, rng)
            used, at = np.unique(numbers, return_inverse=True)
            at = at.reshape(len(pick), WINDOW)
            if used[0] != 0:  # row 0 is padding, also where there is none
                at, used = at + 1, np.concatenate([[0], used])
            rate = RATE * (0.3 if turn >= ROUNDS - 2 else 1.0)
            adam.step(net.p, net.gradients([sample.words[i - 1] for i in used[1:]], at, target[pick]), rate)
        scores = sample.scores(net)
        top = np.maximum.reduceat(check.scores(net), check.firsts).astype("f8")
        slope, level = _fit_level(top, truth, share)
        z = slope * top + level
        each = np.logaddexp(0, np.where(truth == 1, -z, z))
        loss = float(each[truth == 1].mean() + each[truth == 0].mean())
        if best is None or loss < best[0]:
            best = loss, Network({k: x.copy() for k, x in net.p.items()}, slope, level, known=net.known)
    return best[1]


def _fit_level(top: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and level of a weighted logistic regression on one input, by damped Newton steps."""
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    middle, spread = top.mean(), top.std() + 1e-6
    x = np.stack([(top - middle) / spread, np.ones_like(top)], axis=1)
    ridge, b = np.array([1e-1, 1e-3]), np.array([0.0, math.log(share / (1 - share))])

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + (ridge * b * b).sum() / 2)

    for _ in range(50):
        q = _sigmoid(x @ b)
        curve = (x * (weight * q * (1 - q))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, x.T @ (weight * (q - y)) + ridge * b)
        while loss(b - step) > loss(b) + 1e-12:
            step = step / 2
        b = b - step
    slope = max(0.05, float(b[0])) / spread
    return slope, float(b[1]) - slope * middle


class Memo(dict):
    """Numbers of words; new words are noted down as they are looked up."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.fresh.append(word)
        self[word] = number = len(self) + 1
        return number


class Scorer:
    """Scores texts; lives in one Python worker."""

    def __init__(self, net: Network):
        self._net = net
        self._restart()

    def _restart(self) -> None:
        self._memo, self._used = Memo(), 1
        if self._net.constant is None:
            padding = self._net.gates(np.zeros((1, 2 * WIDTH), "f4"))
            self._gates = {side: np.repeat(g, 1024, axis=0) for side, g in padding.items()}

    def _learn(self) -> None:
        fresh, self._memo.fresh = self._memo.fresh, []
        if not fresh:
            return
        made, end = self._net.gates(self._net.vectors(fresh)), self._used + len(fresh)
        for side, g in made.items():
            if end > len(self._gates[side]):
                grown = np.empty((max(end, 2 * len(self._gates[side])), 3 * HIDDEN), "f4")
                grown[: self._used] = self._gates[side][: self._used]
                self._gates[side] = grown
            self._gates[side][self._used : end] = g
        self._used = end

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self._net.constant is not None:
            return np.full(len(texts), self._net.constant)
        out = np.empty(len(texts))
        begin = 0
        while begin < len(texts):  # some hundred thousand words at a time
            numbers, sizes, end = [], [], begin
            while end < len(texts) and len(numbers) < 200_000:
                own = list(map(self._memo.__getitem__, words_of(texts[end])))
                sizes.append(max(WINDOW, len(own)))
                numbers += own + [0] * (WINDOW - len(own))
                end += 1
            self._learn()
            flat = np.array(numbers, "i4")
            begins, firsts = windows(np.array(sizes, "i8"))
            logits = np.concatenate(
                [
                    self._net.logits(self._gates, flat[begins[i : i + 4096, None] + np.arange(WINDOW)])
                    for i in range(0, len(begins), 4096)
                ]
            )
            out[begin:end] = self._net.probability(np.maximum.reduceat(logits, firsts))
            begin = end
            if self._used > MEMO_WORDS:
                self._restart()
        return out


def is_held_out(doc_id: str = "doc_id") -> Column:
    """Never learned from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS):
    """(texts, labels, share of label 1): at most `per_class` rows of each label, by a hash of the id."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out())
    known = known.select("doc_id", F.col(label).alias("label"))
    share = known.agg(F.coalesce(F.avg("label"), F.lit(0.0))).first()[0]
    order = [F.xxhash64(F.col("doc_id"), F.lit(1)), F.col("doc_id")]
    ids = [known.where(F.col("label") == k).orderBy(*order).limit(per_class) for k in (0, 1)]
    # Two times per_class ids at most: a bounded broadcast.
    picked = docs.select("doc_id", whole().alias("text")).join(F.broadcast(ids[0].unionAll(ids[1])), "doc_id")
    # An id may have many rows: the order decides which of them are taken.
    rows = picked.orderBy("doc_id", "text", "label").limit(2 * per_class).collect()
    return [r["text"] for r in rows], [int(r["label"]) for r in rows], float(share)


def score(docs: DataFrame, net: Network, column: str = "text", to: str = "score") -> DataFrame:
    """Add `to`; all other columns are passed on."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a row per word of several training texts
    fields = [f for f in docs.schema.fields if f.name != to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            scores = scorer.score(batch.column(column).to_pylist())
            rest = [batch.column(batch.schema.get_field_index(f.name)) for f in fields]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(scores, pa.float64())], [*(f.name for f in fields), to])

    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(to, T.DoubleType())]))


def learn(docs: DataFrame, labels: DataFrame) -> Network:
    return train(*labelled_sample(docs, labels))

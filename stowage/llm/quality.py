"""Quality grades by ordinal regression on hashed text.

Cumulative-link model: a text's strength s is a weighted mean of its hashed features, and the
chance of a grade above k is the logistic function of s − t(k), with ordered thresholds t. All
grades share the weights. The expected grade is the sum of the chances, the tail probability of a
grade is the chance to reach it, and a text is selected where the tail reaches a level.

Features of a word are its hash, the hash of its shape (letters, digits, marks, length), and
whether it repeats the word before; they are averaged over the text, so length plays no part.
Learned in numpy from a sample of at most `PER_GRADE` rows of each grade, chosen by a hash of the
id; the classes are weighted as they occur.

Null texts count as empty; an empty text has no features, so the thresholds alone give its
grade. Without ratings of two grades at least, every text gets the grade that occurs (0 if none).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.llm.common import small_batches, whole
from stowage.llm.toxicity import is_held_out

BUCKETS = 1 << 14
PER_GRADE = 2000
PASSES, RATE, DECAY = 300, 0.05, 1e-3
SCALE = 20.0
MEMO_WORDS = 300_000
# Shape of a byte: a letter or byte of a letter, a digit, or the mark itself.
SHAPE = bytes(97 if chr(b).isalpha() or b > 127 else 57 if chr(b).isdigit() else b for b in range(256))
REPEAT = 0


def features_of(word: bytes) -> tuple[int, int]:
    shape = word.translate(SHAPE)
    shape = shape.lstrip(b"a") + b"/%d" % min(3, len(word) // 5)
    return 1 + zlib.crc32(word.lower()) % (BUCKETS - 1), 1 + zlib.crc32(b"shape" + shape) % (BUCKETS - 1)


class Features(dict):
    """Feature numbers by word, computed once."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        self[word] = found = features_of(word)
        return found

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct features of a text and their mean number per word."""
        words = (text or "").encode().split()
        if not words:
            return np.zeros(0, "i8"), np.zeros(0)
        if len(self) > MEMO_WORDS:
            self.clear()
        numbers = np.array(list(map(self.__getitem__, words)), "i8").ravel()
        repeats = sum(map(bytes.__eq__, words, words[1:]))
        at, counts = np.unique(numbers, return_counts=True)
        return np.append(at, REPEAT), np.append(counts, repeats) / len(words)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one less than grades
    constant: int | None = None

    def strength(self, at: np.ndarray, x: np.ndarray) -> float:
        return SCALE * float(self.weights[at] @ x)

    def tails(self, strength: np.ndarray) -> np.ndarray:
        """The chance to reach grade 1, 2, … for each strength."""
        return _sigmoid(np.asarray(strength)[:, None] - self.thresholds)


def fit(texts: list[str | None], grades: list[int], shares: dict[int, float]) -> Ordinal:
    """Maximum likelihood by Adam on all rows at once; `shares`: how often each grade occurs."""
    y = np.array(grades, "i8")
    present = sorted(set(grades))
    top = max(shares, default=0)
    if len(present) < 2:
        return Ordinal(np.zeros(BUCKETS), np.zeros(max(1, top)), constant=present[0] if present else 0)
    features = Features()
    rows = [features.of(t) for t in texts]
    sizes = np.array([len(at) for at, _ in rows])
    own = np.repeat(np.arange(len(rows)), sizes)
    at, x = np.concatenate([a for a, _ in rows]), SCALE * np.concatenate([v for _, v in rows])
    weight = np.array([shares[g] / (y == g).sum() for g in y])
    weight /= weight.sum()
    # Thresholds as a first one and positive gaps, so they stay in order.
    p = {"w": np.zeros(BUCKETS), "first": np.zeros(1), "gaps": np.zeros(top - 1)}
    m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    for step in range(1, PASSES + 1):
        gaps = np.exp(p["gaps"])
        t = np.concatenate([p["first"], p["first"] + np.cumsum(gaps)])
        s = np.bincount(own, p["w"][at] * x, len(rows))
        reach = np.concatenate([np.ones((len(y), 1)), _sigmoid(s[:, None] - t), np.zeros((len(y), 1))], axis=1)
        row = np.arange(len(y))
        upper, lower = reach[row, y], reach[row, y + 1]
        chance = np.maximum(upper - lower, 1e-12)
        d_upper, d_lower = upper * (1 - upper), lower * (1 - lower)
        d_s = -weight * (d_upper - d_lower) / chance
        d_t = np.zeros(top + 2)
        np.add.at(d_t, y, weight * d_upper / chance)
        np.add.at(d_t, y + 1, -weight * d_lower / chance)
        d_t = d_t[1:-1]
        after = np.cumsum(d_t[::-1])[::-1]
        g = {"w": np.bincount(at, d_s[own] * x, BUCKETS) + DECAY * p["w"], "first": after[:1], "gaps": after[1:] * gaps}
        for k, d in g.items():
            a, b = m[k]
            a += 0.1 * (d - a)
            b += 0.01 * (d * d - b)
            p[k] -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-9)
    gaps = np.exp(p["gaps"])
    return Ordinal(p["w"], np.concatenate([p["first"], p["first"] + np.cumsum(gaps)]))


def rated_sample(docs: DataFrame, ratings: DataFrame, per_grade: int = PER_GRADE):
    """(texts, grades, share of each grade) from `ratings` (doc_id, grade from 0); at most `per_grade` rows each."""
    known = ratings.where(F.col("grade").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out())
    counts = {r["grade"]: r["count"] for r in known.groupBy("grade").count().collect()}
    total = sum(counts.values())
    docs = docs.select("doc_id", whole().alias("text"))
    rows = []
    for grade in sorted(counts):
        ids = known.where(F.col("grade") == grade).orderBy(F.xxhash64(F.col("doc_id"), F.lit(2)), "doc_id")
        rows += docs.join(F.broadcast(ids.limit(per_grade)), "doc_id").limit(per_grade).collect()  # bounded on purpose
    rows.sort(key=lambda r: (r["doc_id"], r["text"], r["grade"]))
    return [r["text"] for r in rows], [r["grade"] for r in rows], {g: n / total for g, n in counts.items()}


def grade(docs: DataFrame, model: Ordinal, column: str = "text", to: str = "tails") -> DataFrame:
    """Add `to`: the chances to reach grade 1, 2, …; all other columns are passed on."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 130 KB
    fields = [f for f in docs.schema.fields if f.name != to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, features = shared.value, Features()
        for batch in batches:
            if own.constant is None:
                s = [own.strength(*features.of(t)) for t in batch.column(column).to_pylist()]
                tails = own.tails(np.array(s, "f8"))
            else:
                tails = np.tile(np.arange(len(own.thresholds)) < own.constant, (len(batch), 1)).astype("f8")
            rest = [batch.column(batch.schema.get_field_index(f.name)) for f in fields]
            made = pa.array(list(tails), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*rest, made], [*(f.name for f in fields), to])

    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(to, T.ArrayType(T.DoubleType()))]))

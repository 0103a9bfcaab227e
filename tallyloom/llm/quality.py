"""Graded quality by ordinal cumulative-link regression on hashed text.

P(grade <= k) = sigmoid(theta_k - w.x) with one weight vector for all grades and ordered thresholds. x holds
the shares of hashed words and hashed word shapes among a text's words, and hashed bins of a few whole-text
numbers. The expected grade ranks texts; the tail probability P(grade >= cut) selects them.

Fitted on at most TRAIN_ROWS labelled texts, the first by a hash of doc_id: their sparse vectors come to the driver
whole, six bytes for each bucket that a text holds. They are at most BUCKETS numbers each; the texts' words are what bounds them in practice.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .toxicity import held_out

BUCKETS = 1 << 16
TRAIN_ROWS = 16_000
STEPS = 120
PENALTY = 1e-6
#: Numbers of the training vectors that a step works on at once.
BLOCK = 1 << 20
_RUNS = re.compile(r"(.)\1+")


@dataclass
class Model:
    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def below(self, z: np.ndarray) -> np.ndarray:
        """P(grade <= k) for all but the last grade; z: w.x."""
        return 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - z[:, None], -40, 40)))


def _bucket(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % BUCKETS


def _shape(token: str) -> str:
    kinds = "".join("a" if c.islower() else "A" if c.isupper() else "9" if c.isdigit() else c for c in token)
    return _RUNS.sub(r"\1+", kinds)


def _whole(text: str, tokens: list[str]) -> list[str]:
    """Terms for the text as a whole."""
    n = max(1, len(tokens))
    lines = [x for x in text.split("\n") if x.strip()]
    numbers = {
        "distinct": len(set(tokens)) / n * 10,
        "longest_run": math.log2(1 + max((len(list(g)) for _, g in itertools.groupby(tokens)), default=0)),
        "lines": len(set(lines)) / max(1, len(lines)) * 10,
        "letters": min(sum(map(len, tokens)) / n, 20),
        "size": math.log2(1 + len(tokens)),
    }
    return [f"{k}={int(v)}" for k, v in numbers.items()]


class _Buckets(dict):
    LIMIT = 400_000

    def __missing__(self, token: str) -> tuple[int, int]:
        if len(self) >= self.LIMIT:
            self.clear()
        self[token] = got = (_bucket("w:" + token.lower().strip(".,;:!?")), _bucket("s:" + _shape(token)))
        return got


def _vector(text: str, buckets: _Buckets) -> dict[int, float]:
    tokens = text.split()
    counts: Counter[int] = Counter()
    for token, n in Counter(tokens).items():
        for b in buckets[token]:
            counts[b] += n
    x = {b: n / len(tokens) for b, n in counts.items()}
    for term in _whole(text, tokens):
        b = _bucket("t:" + term)
        x[b] = x.get(b, 0) + 0.2
    return x


def _slopes(z: np.ndarray, theta: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the sum of -log P(level) by each text's z and by each threshold."""
    cdf = 1 / (1 + np.exp(-np.clip(theta[None, :] - z[:, None], -40, 40)))
    cdf = np.column_stack([np.zeros(len(z)), cdf, np.ones(len(z))])
    slope, rows = cdf * (1 - cdf), np.arange(len(z))
    p = np.maximum(cdf[rows, level + 1] - cdf[rows, level], 1e-12)
    dtheta = np.zeros(len(theta))
    np.add.at(dtheta, level[level < len(theta)], -(slope[rows, level + 1] / p)[level < len(theta)])
    np.add.at(dtheta, level[level > 0] - 1, (slope[rows, level] / p)[level > 0])
    return (slope[rows, level + 1] - slope[rows, level]) / p, dtheta


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on labelled rows that aren't held out. Null labels and ids don't count; without labels all grades are 0."""
    bounded_batches(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)  # bounded, so it is broadcast
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(some), "doc_id").select("label", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets()
        for batch in batches:
            xs = [_vector(t, buckets) for t in batch.column(1).to_pylist()]
            cols = [pa.array([np.fromiter(x, dtype, len(x)).tobytes() for x in part], pa.binary()) for part, dtype in ((xs, "<u2"), (map(dict.values, xs), "<f4"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["label", "at", "x"])

    got = rows.mapInArrow(vectors, "label int, at binary, x binary").toArrow()
    y = got["label"].to_numpy()
    grades = sorted({int(v) for v in y})
    if len(grades) < 2:
        return Model(grades or [0], np.zeros(BUCKETS), np.zeros(0))
    level = np.searchsorted(grades, y)
    ends = np.cumsum([len(v) // 2 for c in got["at"].chunks for v in c.to_numpy(zero_copy_only=False)])
    at = np.frombuffer(b"".join(v for c in got["at"].chunks for v in c.to_numpy(zero_copy_only=False)), dtype="<u2")
    x = np.frombuffer(b"".join(v for c in got["x"].chunks for v in c.to_numpy(zero_copy_only=False)), dtype="<f4")
    del got
    starts = np.concatenate([[0], ends[:-1]])  # every text has the terms of the text as a whole, so none is empty
    cuts = np.unique([*np.searchsorted(ends, np.arange(0, ends[-1], BLOCK)), len(y)])
    blocks = [(slice(a, b), slice(starts[a], ends[b - 1]), starts[a:b] - starts[a]) for a, b in zip(cuts, cuts[1:])]
    share = np.cumsum(np.bincount(level, minlength=len(grades)))[:-1] / len(y)
    theta = np.log(share / (1 - share))
    w, m, v = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(BUCKETS)
    for t in range(1, STEPS + 1):  # full-batch Adam
        z = np.concatenate([np.add.reduceat(w[at[span]] * x[span], first) for _, span, first in blocks])
        dz, dtheta = _slopes(z, theta, level)
        g = sum(np.bincount(at[span], np.repeat(dz[texts], np.diff(first, append=span.stop - span.start)) * x[span], minlength=BUCKETS) for texts, span, first in blocks)
        g = g / len(y) + PENALTY * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        theta = np.maximum.accumulate(theta - 2.0 * dtheta / len(y))  # thresholds stay in order
    return Model(grades, w, theta)


def grade(docs: DataFrame, model: Model, cut: int | None = None) -> DataFrame:
    """doc_id, expected_grade and tail_probability (of a grade >= cut, the best one by default) of each row of docs.

    Null texts are empty and get the grade of an empty text. Rows that repeat are graded apart; other columns aren't read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    first = np.searchsorted(model.grades, model.grades[-1] if cut is None else cut)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, buckets = shared.value, _Buckets()
        weight, grades = model.weights, np.array(model.grades, dtype=float)

        class Weights(dict):
            def __missing__(self, token: str) -> float:
                if len(self) >= _Buckets.LIMIT:
                    self.clear()
                a, b = buckets[token]
                self[token] = got = float(weight[a] + weight[b])
                return got

        weights = Weights()
        for batch in batches:
            z = []
            for t in batch.column(1).to_pylist():
                tokens = (t or "").split()
                total = sum(map(weights.__getitem__, tokens)) / max(1, len(tokens))
                z.append(total + 0.2 * sum(weight[_bucket("t:" + x)] for x in _whole(t or "", tokens)))
            cdf = np.column_stack([model.below(np.array(z, dtype=float)), np.ones(len(z))])
            p = np.diff(cdf, axis=1, prepend=0)
            tail = p[:, first:].sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p @ grades), pa.array(np.clip(tail, 0, 1))], ["doc_id", "expected_grade", "tail_probability"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, expected_grade double, tail_probability double")


def select(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: float = 0.5) -> DataFrame:
    """doc_id, held_out, expected_grade, tail_probability and kept (tail_probability >= limit) of each row of docs.

    Null and empty texts are graded as texts without words; rows that repeat come out as often as they came, a null doc_id is not held out. Without
    labels every text has the same grade. An empty table gives no rows; columns other than doc_id and text aren't read.
    """
    graded = grade(docs, fit(docs, labels, label))
    return graded.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= limit).alias("kept"))

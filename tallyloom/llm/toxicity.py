"""Toxic passages by maximal scoring segments.

A word's score is the log-odds that a text with it is toxic, against any text. Shares have Dirichlet priors in a
chain: all words, then prefixes of 4 and 5 letters, then the word; each level's prior is centred on the level
before, so a rare word scores like its prefix and an unknown one like all words. Copies of a text count once. Scores are lowered by DRIFT, so that they fall on average
in other texts; then the linear scan of Ruzzo and Tompa gives all maximal scoring segments of a text, and the
best score of n words of other text follows an extreme-value law with E(S) = K n exp(-lambda S). lambda comes from the
scores' distribution, K from other texts held out of the counts. A text's statistic is -log E of its best segment
with those of its further significant ones; a logistic curve on held-out texts makes it a probability.

The classifier is fitted on at most TRAIN_ROWS labelled texts, the first by a hash of doc_id; two thirds are
counted and one third calibrates. The counts are gathered by a distributed aggregation over those texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

TRAIN_ROWS = 24_000
PREFIXES = (4, 5)
PRIOR = 30.0
MIN_TEXTS = 4
DRIFT = 0.35
SMALL = 0.7
SIGNIFICANT = 0.01
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    scores: dict[str, float]  # units: prefixes end with *
    rate: float = 1.0  # lambda
    k: float = 1.0
    curve: tuple[float, ...] = (0.0, 0.0, 0.0)


def _units(word: str) -> list[str]:
    return [f"{word[:n]}*" for n in PREFIXES if len(word) >= n] + [word]


class _WordScores(dict):
    """Score of each white-space token, remembered; a token of several words has the sum of their scores."""

    LIMIT = 500_000

    def __init__(self, scores: dict[str, float]):
        super().__init__()
        self.scores = scores

    def one(self, word: str) -> float:
        for unit in reversed(_units(word)):
            if unit in self.scores:
                return self.scores[unit]
        return 0.0

    def __missing__(self, token: str) -> float:
        if len(self) >= self.LIMIT:
            self.clear()
        odds = [self.one(w) for w in _WORD.findall(token.lower())]
        self[token] = value = sum(x - DRIFT for x in odds)
        return value


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), by Ruzzo and Tompa's linear scan.

    Runs without a positive score only move the running total, so they cost one addition a word.
    """
    total = 0.0
    open_: list[tuple[int, int, float, float]] = []  # start, end, total before, total after
    for i, x in enumerate(scores):
        if x <= 0:
            total += x
            continue
        left, right = total, total + x
        total, start = right, i
        while True:
            j = len(open_) - 1
            while j >= 0 and open_[j][2] >= left:
                j -= 1
            if j < 0 or open_[j][3] >= right:
                open_.append((start, i + 1, left, right))
                break
            start, left = open_[j][0], open_[j][2]
            del open_[j:]
    return [(a, b, after - before) for a, b, before, after in open_]


def _statistic(segs: list[tuple[int, int, float]], n: int, model: Model) -> tuple[float, float]:
    best = max((s for *_, s in segs), default=0.0)
    size = math.log(max(model.k, 1e-12) * max(n, 1))
    first = model.rate * best - size
    others = sum(sorted((model.rate * s - size for *_, s in segs if model.rate * s - size > -math.log(SIGNIFICANT)), reverse=True)[1:])
    return first, math.log1p(others)


def _probability(x: tuple[float, float], curve: tuple[float, ...]) -> float:
    z = curve[0] + curve[1] * x[0] + curve[2] * x[1]
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Newton steps for a small penalized logistic curve."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = a.T @ (a * (p * (1 - p) + 1e-9)[:, None]) + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (y - p) - 1e-2 * w)
        w += np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def _karlin_rate(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1; 1 where the scores have none."""
    if not len(scores) or scores.max(initial=0) <= 0 or scores @ weights >= 0:
        return 1.0
    low, high, f = 0.0, 1.0, lambda r: float(weights @ np.exp(r * scores)) - 1
    while f(high) < 0 and high < 64:
        high *= 2
    low = high / 2**30
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on labelled rows that aren't held out. Null labels and ids don't count; without labels every score is equal."""
    bounded_batches(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)  # bounded, so it is broadcast
    count = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)) < 2
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(some), "doc_id").select("label", count.alias("count"), "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, other = Counter(), Counter()
        for batch in batches:
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (toxic if y else other).update({"", *(u for w in set(_WORD.findall(t.lower())) for u in _units(w))})
        sums = {u: (toxic[u], other[u]) for u in {*toxic, *other}}
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *(pa.array([v[k] for v in sums.values()], pa.int64()) for k in (0, 1))], ["unit", "toxic", "other"])

    # counts are of texts; an exact copy adds nothing
    units = rows.where("count").select("label", "text").dropDuplicates(["text"]).mapInArrow(counted, "unit string, toxic long, other long")
    units = units.groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).where(F.col("toxic") + F.col("other") >= MIN_TEXTS)
    found = {r[0]: (r[1], r[2]) for r in units.collect()}  # bounded by the words of train_rows texts
    all_toxic, all_other = found.get("", (0, 0))
    if not all_toxic or not all_other:
        return Model({})
    share = {"": all_toxic / (all_toxic + all_other)}
    base, odds = math.log(share[""] / (1 - share[""])), {}
    for unit in sorted(found, key=lambda u: (not u.endswith("*"), len(u))):
        if not unit:
            continue
        word = unit.removesuffix("*")
        chain = [u for u in _units(word) if u != unit and u.endswith("*") and (not unit.endswith("*") or len(u) < len(unit))]
        parent = next((share[u] for u in reversed(chain) if u in share), share[""])
        y, n = found[unit]
        # a Dirichlet prior of PRIOR words centred on the level above
        share[unit] = (y + PRIOR * parent) / (y + n + PRIOR)
        x = math.log(share[unit] / (1 - share[unit])) - base
        odds[unit] = round(x, 4) if abs(x) >= SMALL else 0.0
    # a unit that scores like the level above needs no entry
    model = Model({})
    for unit, x in odds.items():
        chain = [u for u in _units(unit.removesuffix("*")) if u != unit and u in odds]
        if x != (odds[chain[-1]] if chain else 0.0):
            model.scores[unit] = x
    words = [(u, n) for u, n in found.items() if u and not u.endswith("*")]
    lookup = _WordScores(model.scores)
    s, w = np.array([lookup[u] for u, _ in words]), np.array([n[1] for _, n in words], dtype=float)
    rest = all_other - w.sum()  # words met too seldom score as unknown ones
    s, w = np.append(s, -DRIFT), np.append(w, max(rest, 0.0))
    model.rate = _karlin_rate(s, w / w.sum())
    shared = docs.sparkSession.sparkContext.broadcast(model.scores)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _WordScores(shared.value)
        for batch in batches:
            out = ([], [])
            for t in batch.column(1).to_pylist():
                scores = [lookup[x] for x in t.split()]
                out[0].append([v for *_, v in segments(scores)])
                out[1].append(len(scores))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.list_(pa.float64())), pa.array(out[1], pa.int64())], ["label", "segs", "n"])

    held = rows.where(~F.col("count")).select("label", "text").mapInArrow(measured, "label int, segs array<double>, n long").collect()  # at most train_rows
    clean = [(r["n"], max(r["segs"], default=0.0)) for r in held if not r["label"] and r["n"]]
    # K by maximum likelihood, lambda given; the median member keeps mislabelled texts from mattering
    each = np.array([n * math.exp(-min(model.rate * best, 700.0)) for n, best in clean])
    model.k = math.log(2) / max(float(np.median(each)), 1e-9) if len(each) else 1.0
    x = np.array([_statistic([(0, 0, v) for v in r["segs"]], r["n"], model) for r in held]).reshape(-1, 2)
    y = np.array([float(r["label"]) for r in held])
    if len(held):
        model.curve = _logistic(x, y)
    return model


def score(docs: DataFrame, model: Model, passages: bool = False) -> DataFrame:
    """doc_id and score (0 to 1) of each row of docs (doc_id, text); with passages: start, end (words) and E of each
    significant segment.

    Null texts are empty and get the score of a text without any toxic word. Rows that repeat are scored apart, other columns aren't read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = "doc_id long, score double" + ", passages array<struct<start:int,end:int,e:double>>" * passages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        lookup = _WordScores(model.scores).__getitem__
        for batch in batches:
            out, spans = [], []
            for t in batch.column(1).to_pylist():
                scores = list(map(lookup, (t or "").split()))
                segs = segments(scores)
                out.append(_probability(_statistic(segs, len(scores), model), model.curve))
                if passages:
                    e = [(a, b, model.k * len(scores) * math.exp(-min(model.rate * s, 700.0))) for a, b, s in segs]
                    spans.append([{"start": a, "end": b, "e": x} for a, b, x in e if x < SIGNIFICANT])
            cols = [batch.column(0), pa.array(out, pa.float64())]
            if passages:
                cols.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("e", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "score", "passages"][: len(cols)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, kind)


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs.

    Null and empty texts have the score of a text without any toxic word; rows that repeat come out as often as they came, a null doc_id is not held
    out. Without labels of both kinds all scores are equal. An empty table gives no rows; columns other than doc_id and text aren't read.
    """
    scored = score(docs, fit(docs, labels, label))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: float = 0.5) -> DataFrame:
    """The rows of docs that score under limit, with all their columns.

    Null and empty texts have the score of a text without any toxic word; rows that repeat stay or go together, an empty
    table gives no rows. Without labels of both kinds nothing is known and all rows stay.
    """
    spark = docs.sparkSession
    model = fit(docs, labels, label)
    if not model.scores:
        return docs
    shared = spark.sparkContext.broadcast(model)
    bounded_batches(spark)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        lookup = _WordScores(model.scores).__getitem__
        for batch in batches:
            keep = []
            for t in batch.column(at).to_pylist():
                scores = list(map(lookup, (t or "").split()))
                keep.append(_probability(_statistic(segments(scores), len(scores), model), model.curve) < limit)
            yield batch.filter(pa.array(keep, pa.bool_()))

    numbered = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # mapInArrow looks columns up by name, which may hold dots
    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)

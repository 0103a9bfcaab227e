"""Periodic runs of words by a harmonic grid and vectorised prefix hashes.

A run of period p has at least R(p) = max(24, 3p) words, so its words that have an equal word p further on are R(p) - p or more in a row: one of them
lies on the grid of every max(24 - p, 2p)-th word. All pairs (period, grid word) of a batch of documents, some n log n for n words, are
looked at at once: where the two words are equal, the longest common extensions to both sides are found by binary search over prefix
hashes. Equal stretches never have different hashes, so no extension is too short; each is then verified word by word, and
one that a collision made too long is cut to the runs inside. Of the periods found for one stretch, the others are multiples of
the smallest, which stays.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

LEAST_WORDS = 24
LEAST_PERIODS = 3
#: Pairs of a period and a grid word that are looked at at once, and words of documents that are taken together.
PAIRS = 1 << 20
WORDS = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def planted(doc_id: int | None, words: list) -> list:
    """The words with their periodic tail: for documents with crc32(doc_id) % 10 = 0."""
    n = len(words)
    if doc_id is None or n == 0:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


class _Hashes:
    """Prefix sums of word numbers times powers of an odd base, modulo 2**64."""

    def __init__(self, ids: np.ndarray):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xA0761D6478BD642F)
        mixed ^= mixed >> np.uint64(32)
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(ids), _BASE)]), dtype=np.uint64)
        self.prefix = np.concatenate([[np.uint64(0)], np.cumsum(mixed * self.power[: len(ids)], dtype=np.uint64)])

    def equal(self, at: np.ndarray, size: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """Whether size words from at and from at + shift have equal hashes."""
        here, there = self.prefix[at + size] - self.prefix[at], self.prefix[at + shift + size] - self.prefix[at + shift]
        return here * self.power[shift] == there


def _extensions(hashes: _Hashes, at: np.ndarray, shift: np.ndarray, room: np.ndarray, back: bool) -> np.ndarray:
    """How many words from at on (or before at) equal those shift further on, up to room."""
    size = np.zeros(len(at), dtype=np.int64)
    if not len(at):
        return size
    for bit in reversed(range(int(room.max()).bit_length())):
        more = size + (1 << bit)
        k = np.flatnonzero(more <= room)
        good = hashes.equal(at[k] - more[k] if back else at[k], more[k], shift[k])
        size[k[good]] = more[k[good]]
    return size


def _grid(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, period, word) of all grid words that have a word a period further on, some PAIRS at a time."""
    periods = sizes // LEAST_PERIODS
    docs = np.flatnonzero(sizes >= LEAST_WORDS)
    for d in np.array_split(docs, max(1, int(periods[docs].sum()) // PAIRS)):
        doc = np.repeat(d, periods[d])
        period = np.arange(len(doc)) - np.repeat(np.cumsum(periods[d]) - periods[d], periods[d]) + 1
        step = np.maximum(LEAST_WORDS - period, (LEAST_PERIODS - 1) * period)
        ends = np.cumsum(-(-(sizes[doc] - period) // step))
        cuts = np.searchsorted(ends, np.arange(PAIRS, ends[-1] if len(ends) else 0, PAIRS), side="right")
        for a, b in zip([0, *cuts], [*cuts, len(doc)], strict=True):
            if a == b:
                continue
            n = np.diff(ends[a:b], prepend=ends[a - 1] if a else 0)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(doc[a:b], n), np.repeat(period[a:b], n), np.repeat(starts[doc[a:b]], n) + place * np.repeat(step[a:b], n)


def find_runs(texts: list[list]) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each list of words, by start and period."""
    numbers: dict = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for words in texts for w in words], dtype=np.int64)
    sizes = np.array([len(words) for words in texts], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    hashes = _Hashes(ids)
    found = []
    for doc, period, at in _grid(starts, sizes):
        same = ids[at] == ids[at + period]
        doc, period, at = doc[same], period[same], at[same]
        fore = _extensions(hashes, at, period, starts[doc] + sizes[doc] - at - period, False)
        back = _extensions(hashes, at, period, at - starts[doc], True)
        long = back + fore + period >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
        first, end = (at - back)[long], (at + fore + period)[long]
        found.append(np.unique(np.column_stack([doc[long], first, end, period[long]]), axis=0))
    if not found:
        return out
    rows = np.concatenate(found)
    least: dict[tuple[int, int, int], int] = {}
    for d, a, z, p in rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))].tolist():
        known = least.get((d, a, z))
        if known is None or p % known:
            for a, z in _verified(ids, a, z, p, int(starts[d]), int(starts[d] + sizes[d])):
                least[d, a, z] = min(p, least.get((d, a, z), p))
    for (d, a, z), p in least.items():
        out[d].append((a - int(starts[d]), z - a, p))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def _verified(ids: np.ndarray, a: int, z: int, period: int, first: int, end: int) -> list[tuple[int, int]]:
    """[a, z) if its words have the period; else two different stretches had one hash: the runs inside, none of which goes on beyond it."""
    other = np.flatnonzero(ids[a : z - period] != ids[a + period : z])
    if not len(other):
        return [(a, z)]
    edges = np.concatenate([[a - 1], other + a, [z - period]]).tolist()
    runs = [(x + 1, y + period) for x, y in zip(edges, edges[1:], strict=False) if y - x - 1 + period >= max(LEAST_WORDS, LEAST_PERIODS * period)]
    goes_on = lambda x, y: (x > first and ids[x - 1] == ids[x - 1 + period]) or (y < end and ids[y] == ids[y - period])
    return [r for r in runs if not goes_on(*r)]


def _row(doc_id: int | None, words: list, runs: list[tuple[int, int, int]]) -> tuple:
    best = None
    for run in runs:  # in order of start and period: the first of equals stays
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    listed = hashlib.sha256("".join(f"{a},{n},{p}\n" for a, n, p in runs).encode())
    kept = words
    if runs:
        edges = np.zeros(len(words) + 1, dtype=np.int64)
        for a, n, p in runs:
            edges[a + p] += 1
            edges[a + n] -= 1
        kept = [words[k] for k in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]
    first = (None,) * 4 if best is None else (best[0], best[1], best[2], 1000 * best[1] // best[2])
    return doc_id, len(runs), *first, listed.hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


_COLUMNS = [("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]


def periodic_runs(docs: DataFrame, plant: bool = True) -> DataFrame:
    """The runs of each row of docs (doc_id, text), after its periodic tail is planted (plant).

    doc_id, n_runs, and of the run with the greatest length/period (ties: the smallest start, then period) start,
    length, period and exponent_milli (null without runs), runs_sha256 (of "start,length,period" lines) and collapsed_sha256 (of the words
    that are in no run after its first period, joined by a space). Words are split at ASCII white space. Null and empty texts
    have no words, hence no runs and the digests of empty strings; rows with a null doc_id get no planted tail. Rows that repeat come
    out as often as they came, an empty table gives no rows; other columns aren't read. A task holds one batch of texts; a text of n
    words takes some n log n steps, PAIRS pairs at a time.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(ids: list, texts: list) -> pa.RecordBatch:
            rows = [_row(*x) for x in zip(ids, texts, find_runs(texts), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(_COLUMNS)], schema=pa.schema(_COLUMNS))

        for batch in batches:
            ids, texts, n = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []  # bytes are split at ASCII white space only
                ids.append(doc_id)
                texts.append(planted(doc_id, words) if plant else words)
                n += len(words)
                if n >= WORDS:
                    yield made(ids, texts)
                    ids, texts, n = [], [], 0
            if ids:
                yield made(ids, texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")

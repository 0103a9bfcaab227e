"""What changed between two texts of one client.

changed() finds the stretches of the new text: tokens that are the same at both ends go first; tokens that occur once on both sides, in
the longest run of rising places, are anchors; the texts between anchors are treated alike, and what has no anchor is compared by the
shortest edit script while that has at most EDITS steps. Beyond that a stretch is changed as a whole, so work is bounded. It is an
Arrow function, as no built-in form finds spans; context, merging, budget and pieces are expressions.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scope import let, windows

# Characters kept around a change, characters in a piece, pieces at most, characters up to which texts are compared.
CONTEXT, PIECE, PIECES, COMPARED = 100, 1200, 4, 300_000
#: Steps of an edit script, and how often anchors are sought within each other.
EDITS, LEVELS = 120, 6
#: Pairs of letters up to which an edit script is sought by rows of bits.
CELLS = 1 << 22
_TOKEN = re.compile(r"[A-Za-z0-9_]+|\s+|.", re.S)


def _common(a: str, i: int, b: str, j: int, most: int) -> int:
    """How many letters from a[i] and b[j] on are equal, up to most: by doubling, then halving."""
    low, step = 0, 1
    while low < most:
        step = min(step, most - low)
        if a[i + low : i + low + step] == b[j + low : j + low + step]:
            low += step
            step *= 2
        elif step == 1:
            break
        else:
            step = max(1, step // 2)
            while step > 1 and a[i + low : i + low + step] != b[j + low : j + low + step]:
                step //= 2
    return low


def _anchors(a: str, b: str) -> list[tuple[int, int]]:
    """Places in a and b of letters that both have once, in the longest run that rises in both."""
    once_a, once_b = ({c for c, n in Counter(x).items() if n == 1} for x in (a, b))
    both = once_a & once_b
    if not both:
        return []
    place = {c: j for j, c in enumerate(b) if c in both}
    pairs = [(i, place[c]) for i, c in enumerate(a) if c in both]
    ends: list[int] = []  # the least last place of a run of each length
    tops: list[int] = []  # and which pair that is
    before = []
    for k, (_, j) in enumerate(pairs):
        n = bisect_left(ends, j)
        before.append(tops[n - 1] if n else -1)
        ends[n:n + 1] = [j]
        tops[n:n + 1] = [k]
    run, k = [], tops[-1]
    while k >= 0:
        run.append(pairs[k])
        k = before[k]
    return run[::-1]


def _script(a: str, b: str) -> list[tuple[int, int]] | None:
    """Stretches of b that the shortest edit script inserts or, where empty, deletes at; None if it has over EDITS steps."""
    n, m = len(a), len(b)
    if abs(n - m) > EDITS:
        return None
    return _by_rows(a, b) if n * m <= CELLS else _by_reach(a, b)


def _by_rows(a: str, b: str) -> list[tuple[int, int]] | None:
    """The script from the longest common subsequence: for each letter of a a row of bits, one for each letter of b. A bit is 0 where
    that letter makes the subsequence longer, so a row takes four operations on whole numbers. Of equal scripts the one of _by_reach."""
    n, m = len(a), len(b)
    full, bit, places = (1 << m) - 1, 1, {}
    for c in b:
        places[c] = places.get(c, 0) | bit
        bit <<= 1
    row, rows = full, [full]
    for c in a:
        if met := row & places.get(c, 0):
            row = (row + met | row - met) & full
        rows.append(row)
    if n - m + 2 * row.bit_count() > EDITS:
        return None
    edits, x, y = [], n, m
    while x and y:
        if rows[x] >> y - 1 & 1:  # this letter adds nothing: put in
            y -= 1
            edits.append((y, y + 1))
        else:
            x -= 1
            if rows[x] >> y - 1 & 1:
                y -= 1  # it adds only with this letter of a: kept
            else:
                edits.append((y, y))
    edits.extend([(0, 0)] * x)
    edits.extend((k, k + 1) for k in range(y - 1, -1, -1))
    return edits[::-1]


def _by_reach(a: str, b: str) -> list[tuple[int, int]] | None:
    """The script from the places that each number of steps reaches, which needs no room for long texts."""
    n, m = len(a), len(b)
    reach, trace = {1: 0}, []
    for d in range(EDITS + 1):
        trace.append(dict(reach))
        for k in range(-d, d + 1, 2):
            down = k == -d or (k != d and reach.get(k - 1, -1) < reach.get(k + 1, -1))
            x = reach[k + 1] if down else reach[k - 1] + 1
            y = x - k
            if x > n or y > m:
                reach[k] = -n - m  # outside
                continue
            x += _common(a, x, b, y, min(n - x, m - y)) if y >= 0 and x >= 0 else 0
            reach[k] = x
            if x >= n and x - k >= m:
                edits, k_, x_ = [], k, x
                for e in range(d, 0, -1):
                    held = trace[e]
                    went_down = k_ == -e or (k_ != e and held.get(k_ - 1, -1) < held.get(k_ + 1, -1))
                    k_ = k_ + 1 if went_down else k_ - 1
                    x_ = held[k_]
                    edits.append((x_ - k_, x_ - k_ + (1 if went_down else 0)))
                return edits[::-1]
    return None


def changed(old: str, new: str) -> list[tuple[int, int]]:
    """Changed stretches [from, to) of new in order; empty ones where something was only taken out."""
    if old == new:
        return []
    tokens = (_TOKEN.findall(old), _TOKEN.findall(new))
    letters = {t: chr(k + 32 if k < 0xD000 else k + 0x2000) for k, t in enumerate(dict.fromkeys(tokens[0] + tokens[1]))}
    a, b = ("".join(map(letters.__getitem__, x)) for x in tokens)
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b), 0)]
    while work:  # from left to right
        i, i_end, j, j_end, level = work.pop()
        head = _common(a, i, b, j, min(i_end - i, j_end - j))
        i, j = i + head, j + head
        left, right = a[i:i_end][::-1], b[j:j_end][::-1]
        tail = _common(left, 0, right, 0, min(len(left), len(right)))
        i_end, j_end = i_end - tail, j_end - tail
        if i == i_end or j == j_end:
            if i < i_end or j < j_end:
                out.append((j, j_end))
            continue
        anchors = _anchors(a[i:i_end], b[j:j_end]) if level < LEVELS else []
        if anchors:
            parts, at = [], (i, j)
            for x, y in anchors:
                parts.append((at[0], i + x, at[1], j + y, level + 1))
                at = (i + x + 1, j + y + 1)
            parts.append((at[0], i_end, at[1], j_end, level + 1))
            work.extend(p for p in reversed(parts) if p[0] < p[1] or p[2] < p[3])
            continue
        script = _script(a[i:i_end], b[j:j_end])
        out.extend([(j, j_end)] if script is None else [(j + x, j + y) for x, y in script])
    ends = list(accumulate(map(len, tokens[1]), initial=0))
    joined: list[tuple[int, int]] = []
    for x, y in out:
        if joined and joined[-1][1] == ends[x]:
            joined[-1] = (joined[-1][0], ends[y])
        else:
            joined.append((ends[x], ends[y]))
    return joined


_SPANS = T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())]))


@F.pandas_udf(_SPANS)
def _changed(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([[] if x is None else [{"a": a, "b": b} for a, b in changed(x, y)] for x, y in zip(old, new, strict=True)])


def changed_pieces(old: Column, new: Column, piece: int = PIECE, most: int = PIECES) -> Column:
    """Pieces of new that are judged again: the changed stretches with their context if they fit into most pieces, else pieces spread evenly.

    None for equal texts, which stay in the JVM. Null is an empty text; without an old one, or where both together are too long, nothing is compared.
    """
    old, new = F.coalesce(old, F.lit("")), F.coalesce(new, F.lit(""))
    span = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    none = F.array().cast("array<struct<a:int,b:int>>")

    def merged(parts: Column) -> Column:
        wide = F.transform(parts, lambda x: span(F.greatest(F.lit(0), x["a"] - CONTEXT), F.least(F.length(new), x["b"] + CONTEXT)))

        def add(acc: Column, x: Column) -> Column:
            last = F.element_at(acc, -1)
            meets = (F.size(acc) > 0) & F.when(F.size(acc) > 0, x["a"] <= last["b"])
            return F.when(meets, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(span(last["a"], F.greatest(last["b"], x["b"]))))).otherwise(F.concat(acc, F.array(x)))

        return F.aggregate(wide, none, add)

    def cut(spans: Column) -> Column:
        texts = lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil((x["b"] - x["a"]) / piece).cast("int"), F.lit(1)) - 1), lambda k: F.substring(new, x["a"] + k * piece + 1, F.least(F.lit(piece), x["b"] - x["a"] - k * piece)))
        return F.slice(F.filter(F.flatten(F.transform(spans, texts)), lambda x: x != ""), 1, most)

    spread = windows(new, piece, F.lit(most))
    size = lambda spans: F.aggregate(spans, F.lit(0), lambda acc, x: acc + x["b"] - x["a"])
    comparable = (old != "") & (F.length(old) + F.length(new) <= COMPARED)
    sent = lambda text: F.when(comparable & (old != new), text)  # a function in a CASE runs for all rows: those that don't need it send null
    by_spans = let(_changed(sent(old), sent(new)), lambda parts: let(merged(parts), lambda spans: F.when(size(spans) <= piece * most, cut(spans)).otherwise(spread)))
    return F.when(old == new, F.array().cast("array<string>")).when(comparable, by_spans).otherwise(spread)

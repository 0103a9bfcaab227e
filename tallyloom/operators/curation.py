"""Curation of labelled text: conflicts, splits, weights, balance, leakage, regressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scope

#: Characters in a gram of the substring join, and grams in its windows.
GRAM, SPREAD = 8, 33


def hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("sha", scope.text_hash(F.col("text")))


def resolve_conflicts(rows: DataFrame) -> DataFrame:
    """One row for each text: the largest label, and the first row that has it. rows: sha, label, id."""
    return rows.groupBy("sha").agg(F.max("label").alias("label"), F.min_by("id", F.struct(-F.col("label"), F.col("id"))).alias("id"))


def ranked(rows: DataFrame, order: str) -> DataFrame:
    """Adds rank (from 1) by a hexadecimal column over all rows, without sorting them in one task.

    Rows are ranked within their first three digits; counts of the 4096 prefixes before are added.
    """
    rows = rows.withColumn("_p", F.substring(order, 1, 3))
    counts = rows.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = rows.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(order)))
    return placed.join(F.broadcast(before), "_p").withColumn("rank", F.col("_k") + F.col("_before")).drop("_p", "_k", "_before")


def split(rows: DataFrame, share: float = 0.32) -> DataFrame:
    """part: the first max(1, int(n * share)) rows by sha are eval, the others train."""
    n = max(1, int(rows.count() * share))
    return ranked(rows, "sha").withColumn("part", F.when(F.col("rank") <= n, "eval").otherwise("train")).drop("rank")


def override_labels(rows: DataFrame, human: DataFrame) -> DataFrame:
    """Human labels (sha, human) win; unseen human texts join train; whatever a person labelled leaves eval."""
    joined = rows.join(human, "sha", "full")
    part = F.when(F.col("human").isNotNull(), "train").otherwise(F.col("part"))
    return joined.select("sha", F.coalesce("human", "label").alias("label"), part.alias("part"))


def weight_hard(rows: DataFrame, hard: DataFrame, times: int = 4) -> DataFrame:
    """Hard rows come so many times into train and leave eval."""
    flagged = rows.join(hard.select("sha", F.lit(True).alias("hard")).distinct(), "sha", "left")
    kept = flagged.where(F.col("hard").isNull() | (F.col("part") == "train"))
    n = F.when(F.col("hard"), times).otherwise(1)
    return kept.select("sha", "label", "part", F.explode(F.sequence(F.lit(1), n)).alias("copy"))


def balance(rows: DataFrame, ratio: float = 1.0) -> DataFrame:
    """The rarest label whole, of each other one at most ratio times as many: real rows first, then by hash (which stands for a random choice).

    rows: sha, label, synthetic. Labels are few; rows without one are left out. Ranks come from ranked(), so a large class is not one task.
    """
    counts = {r["label"]: r["n"] for r in rows.where("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("n")).collect()}
    most = int(ratio * min(counts.values(), default=0))
    parts = []
    for label, n in sorted(counts.items()):
        part = rows.where(F.col("label") == label)
        if n > max(most, min(counts.values())):
            # the hash's digits lead, so that ranks are dealt by them: real and synthetic rows are ranked apart
            real, made = (ranked(part.where(F.col("synthetic") == s), "sha") for s in (False, True))
            n_real = part.where(~F.col("synthetic")).count()
            part = real.where(F.col("rank") <= most).unionByName(made.where(F.col("rank") <= most - n_real)).drop("rank")
        parts.append(part)
    return reduce(DataFrame.unionByName, parts, rows.limit(0))


def _least_grams(spread: int) -> Callable[[Column], Column]:
    """Array of the different least gram hashes over all windows of so many grams of a text; none where it has no window."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(text: pd.Series) -> pd.Series:
        def one(t: str | None) -> np.ndarray:
            code = np.frombuffer((t or "").encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
            n = len(code) - GRAM + 1
            if n < spread:
                return np.zeros(0, np.int64)
            h = np.zeros(n, np.uint64)
            for k in range(GRAM):
                h = (h ^ code[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            return np.unique(np.lib.stride_tricks.sliding_window_view(h, spread).min(axis=1)).view(np.int64)

        return text.map(one)

    return run


def _held_in(whole: DataFrame, part: DataFrame) -> DataFrame:
    """Pairs (whole, part) of ids where the whole's text holds the part's."""
    keyed = lambda rows: rows.withColumn("key", F.md5("text"))
    whole, part, found = keyed(whole), keyed(part), []
    for spread, low, high in ((SPREAD, GRAM + SPREAD - 1, None), (1, GRAM, GRAM + SPREAD - 2)):
        sought = part.where(F.length("text") >= low) if high is None else part.where(F.length("text").between(low, high))
        if sought.isEmpty():
            continue
        grams = _least_grams(spread)
        theirs = whole.where(F.length("text") >= low).select("key", "text").dropDuplicates(["key"]).select(F.col("key").alias("whole_key"), F.explode(grams("text")).alias("gram"))
        mine = sought.select("key", "text").dropDuplicates(["key"]).select(F.col("key").alias("part_key"), F.explode(grams("text")).alias("gram"))
        often = theirs.join(mine.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
        rarest = mine.join(often, "gram", "left").groupBy("part_key").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
        pairs = theirs.join(rarest, "gram").select("whole_key", "part_key")
        pairs = pairs.join(whole.select(F.col("key").alias("whole_key"), F.col("id").alias("whole"), F.col("text").alias("a")), "whole_key")
        pairs = pairs.join(sought.select(F.col("key").alias("part_key"), F.col("id").alias("part"), F.col("text").alias("b")), "part_key")
        found.append(pairs.where(F.col("a").contains(F.col("b"))).select("whole", "part", "whole_key", "part_key"))
    if not found:
        return whole.select(F.col("id").alias("whole"), "key").limit(0).join(part.select(F.col("id").alias("part"), "key").limit(0), "key").select("whole", "part", F.col("key").alias("whole_key"), F.col("key").alias("part_key"))
    return reduce(DataFrame.unionByName, found)


def overlaps(train: DataFrame, held: DataFrame, shortest: int = GRAM) -> DataFrame:
    """Pairs (id, held_id) where one text holds the other; shorter texts and nulls have none.

    What a text holds has no window of grams that the text lacks, so the least gram of each of its windows is one of the text's least
    grams too (winnowing). Each text looks for its rarest one among those of the other side, and contains() decides. Texts of fewer than
    GRAM + SPREAD - 1 characters have no such window: they look for a gram among all, which costs a row for each character of the other side.
    """
    if shortest < GRAM:
        raise ValueError(f"texts are compared from {GRAM} characters on")
    a, b = (rows.select("id", "text").where(F.length("text") >= shortest) for rows in (train, held))
    down = _held_in(a, b).select(F.col("whole").alias("id"), F.col("part").alias("held_id"))
    up = _held_in(b, a).where("whole_key <> part_key").select(F.col("part").alias("id"), F.col("whole").alias("held_id"))  # equal texts are in down
    return down.unionByName(up)


def by_prefix(previews: DataFrame, candidates: DataFrame, size: int = 16) -> DataFrame:
    """Each preview with the first candidate (by id) that starts alike."""
    first = candidates.where(F.length("text") >= size).groupBy(F.left("text", F.lit(size)).alias("head")).agg(F.min("id").alias("candidate"))
    return previews.join(first, F.left("text", F.lit(size)) == F.col("head"), "left").select("id", "candidate")


def auto_label(findings: Column, risk: Column, p: Column) -> Column:
    return F.when(findings > 0, "1").when((risk < 20) & (p <= 0.3), "0").otherwise("queue")


def regressions(labels: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each labelled text: how often, its label and the newest prediction. Both have req_id."""
    joined = labels.where("label IS NOT NULL").join(rows, "req_id")
    newest = F.struct("ts", "id")
    return joined.groupBy("sha").agg(F.count("*").alias("dup"), F.max("label").alias("want"), F.max_by("predicted", newest).alias("got"))


_NOISE = r"<system-reminder|data:image/|base64,"


def divergences(rows: DataFrame, candidates: DataFrame, size: int = 16) -> DataFrame:
    """Texts on which two classifiers differ: sha, want and dup of each that a candidate's first characters match; the others as one row without them.

    rows: text, label, other. candidates: id, text, want; the first by id with a head counts. Injected context, images and very
    short texts are no real conversation and left out.
    """
    norm = scope.one_space(F.col("text"))
    real = rows.where(F.col("label").isNotNull() & F.col("other").isNotNull() & (F.col("label") != F.col("other")))
    real = real.where(~F.col("text").rlike(_NOISE) & (F.length(norm) >= 10)).select(norm.alias("text"))
    heads = candidates.where(F.length("text") >= size).groupBy(F.left("text", F.lit(size)).alias("head")).agg(F.min_by("want", "id").alias("want"))
    found = real.join(heads, F.left("text", F.lit(size)) == F.col("head"), "left")
    return found.groupBy(F.when(F.col("want").isNotNull(), F.sha1("text")).alias("sha"), "want").agg(F.count("*").alias("dup"))

"""Measures of classifiers over scored rows. want and got are 1 for positive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import placed_values


def counts(want: Column, got: Column) -> list[Column]:
    return [F.count_if(want & got).alias("tp"), F.count_if(want & ~got).alias("fn"), F.count_if(~want & got).alias("fp"), F.count_if(~want & ~got).alias("tn")]


def confusion(rows: DataFrame, *by: str, want: Column | None = None, got: Column | None = None) -> DataFrame:
    """tp, fn, fp, tn with recall, fpr, precision (null where empty) and accuracy."""
    want, got = F.col("want") == 1 if want is None else want, F.col("got") == 1 if got is None else got
    out = rows.groupBy(*by).agg(*counts(want, got))
    tp, fn, fp, tn = map(F.col, ("tp", "fn", "fp", "tn"))
    return out.select("*", F.try_divide(tp, tp + fn).alias("recall"), F.try_divide(fp, fp + tn).alias("fpr"), F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp + tn, tp + fn + fp + tn).alias("accuracy"))


def group_score(rows: DataFrame, by: str) -> DataFrame:
    want, got = F.col("want") == 1, F.col("got") == 1
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(want == got).alias("ok"), F.count_if(want & ~got).alias("miss"), F.count_if(~want & got).alias("false_alarm"))


def matrix(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Caught and clean by each of two columns, in one pass."""
    out = rows.groupingSets([[a], [b]], a, b).agg(F.grouping_id(a, b).alias("gid"), F.count_if((F.col("want") == 1) & (F.col("got") == 1)).alias("caught"), F.count_if((F.col("want") == 0) & (F.col("got") == 0)).alias("clean"))
    return out.select(F.when(F.col("gid") == 1, a).otherwise(b).alias("by"), F.coalesce(F.col(a).cast("string"), F.col(b).cast("string")).alias("item"), "caught", "clean")


def sweep(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """Confusion at each threshold; each row is repeated for the few thresholds, partial counts do the rest."""
    each = rows.select("want", "p", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    return confusion(each, "threshold", got=F.col("p") >= F.col("threshold"))


def calibration(rows: DataFrame) -> DataFrame:
    """Per class: n, mean squared distance of p to the class, median and 10 % and 90 % points by place."""
    placed = placed_values(rows, "p", ["want"]).withColumnsRenamed({"_c": "c", "_end": "end"})

    def pick(q: float, name: str) -> Column:
        at = F.least(F.floor(F.col("n") * q), F.col("n") - 1)
        return F.max(F.when((F.col("end") > at) & (F.col("end") - F.col("c") <= at), F.col("p"))).alias(name)

    square = F.sum(F.col("c") * F.pow(F.col("p") - F.col("want"), 2)) / F.sum("c")
    return placed.groupBy("want").agg(F.sum("c").alias("n"), F.round(square, 9).alias("brier"), pick(0.1, "p10"), pick(0.5, "p50"), pick(0.9, "p90"))


def deltas(rows: DataFrame, full: str = "full") -> DataFrame:
    """Differences of recall and false positive rate to the full configuration, in points."""
    base = rows.where(F.col("variant") == full).select(F.col("recall").alias("r0"), F.col("fpr").alias("f0"), F.lit(1).alias("one"))
    # the base is one row
    return rows.withColumn("one", F.lit(1)).join(F.broadcast(base), "one").select("variant", "recall", "fpr", ((F.col("recall") - F.col("r0")) * 100).alias("d_recall"), ((F.col("fpr") - F.col("f0")) * 100).alias("d_fpr"))


def sticky_cascade(rows: DataFrame, threshold: float) -> DataFrame:
    """Adds hit: flagged itself, or any earlier row of its session was."""
    own = (F.col("flag") == 1) | ((F.col("risk") >= 20) & (F.col("p") >= threshold))
    w = Window.partitionBy("session").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("own", own).withColumn("hit", F.col("own") | F.coalesce(F.max("own").over(w), F.lit(False)))

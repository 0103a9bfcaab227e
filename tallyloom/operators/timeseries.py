"""Series over time: equal buckets, chart buckets, counter snapshots, gaps, trailing windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scope


def _seconds(ts: str) -> Column:
    return F.unix_timestamp(F.lit(ts).cast("timestamp"))


def _calendar(rows: DataFrame, n: int) -> DataFrame:
    return rows.sparkSession.range(n).select(F.col("id").alias("idx"))


def _bucketed(log: DataFrame, since: str, until: str, width: Column) -> DataFrame:
    inside = log.where((F.col("ts") >= F.lit(since).cast("timestamp")) & (F.col("ts") < F.lit(until).cast("timestamp")))
    return inside.withColumn("idx", F.floor((F.unix_timestamp("ts") - _seconds(since)) / width).cast("long"))


def series(log: DataFrame, since: str, until: str, n: int) -> DataFrame:
    """Calls, local routes and blocks in n equal buckets of [since, until); empty buckets are 0, labels in display time."""
    span = F.greatest(_seconds(until) - _seconds(since), F.lit(n))
    width = span / n
    rows = _bucketed(log, since, until, width).groupBy("idx").agg(
        F.count("*").alias("calls"),
        F.count_if(scope.is_local_route(F.col("action"))).alias("routed"),
        F.count_if(scope.is_blocked(F.col("action"), F.col("status_code"))).alias("blocked"),
    )
    start = F.timestamp_seconds(_seconds(since) + F.floor(F.col("idx") * width))
    label = F.when(span <= 26 * 3600, F.date_format(scope.local_time(start), "HH:mm")).otherwise(F.date_format(scope.local_time(start), "MM-dd HH:mm"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return _calendar(log, n).join(F.broadcast(rows), "idx", "left").select("idx", label.alias("label"), zero("calls"), zero("routed"), zero("blocked"))


def chart(log: DataFrame, since: str, until: str, n: int) -> DataFrame:
    """Per bucket: calls, mean and peak rate (in slots of 10 s), shares of errors and latency figures; empty: 0 and null."""
    width = (_seconds(until) - _seconds(since)) / n
    rows = _bucketed(log, since, until, width)
    slots = rows.groupBy("idx", F.floor((F.unix_timestamp("ts") - _seconds(since)) / 10).alias("slot")).agg(F.count("*").alias("c"))
    peak = slots.groupBy("idx").agg(F.max("c").alias("peak"))
    ms = F.when(F.col("gateway_internal_ms") > 0, F.col("gateway_internal_ms"))
    share = lambda test: (F.count_if(test) / F.count("*"))
    s = F.col("status_code")
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY CASE WHEN gateway_internal_ms > 0 THEN gateway_internal_ms END)").cast("double")
    found = rows.groupBy("idx").agg(
        F.count("*").alias("calls"), share(s >= 500).alias("share_5xx"), share(s == 403).alias("share_403"), share(s == 429).alias("share_429"),
        p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"),
    )
    calls = F.coalesce("calls", F.lit(0))
    return _calendar(log, n).join(F.broadcast(found), "idx", "left").join(F.broadcast(peak), "idx", "left").select(
        "idx", calls.alias("calls"), (calls / width).alias("qps"), (F.coalesce("peak", F.lit(0)) / F.least(width, F.lit(10.0))).alias("qps_max"),
        "share_5xx", "share_403", "share_429", "p50", "p95", "p99", "min_ms", "max_ms",
    )


def _by_day(ticks: DataFrame, seconds: int) -> DataFrame:
    """Ticks with their day, so that windows over time run within days; days are joined by a window over one row a day."""
    return ticks.withColumn("_day", F.floor(F.col("t") * seconds / 86400).cast("long"))


def _neighbour(ticks: DataFrame, columns: list[str], seconds: int, ahead: bool = False) -> DataFrame:
    """Adds _near: the columns of the tick before (or ahead), across days."""
    rows, row = _by_day(ticks, seconds), F.struct(*columns)
    edge = (F.min_by if ahead else F.max_by)(row, "t").alias("_edge")
    over = Window.orderBy("_day")
    days = rows.groupBy("_day").agg(edge).select("_day", (F.lead if ahead else F.lag)("_edge").over(over).alias("_far"))
    inner = (F.lead if ahead else F.lag)(row).over(Window.partitionBy("_day").orderBy("t"))
    return rows.withColumn("_inner", inner).join(days, "_day").withColumn("_near", F.coalesce("_inner", "_far")).drop("_day", "_inner", "_far")


def snapshots(log: DataFrame, tick: int, wrap: int) -> DataFrame:
    """Running counters at each tick with calls; calls starts again at 0 after wrap, as a restarted process would."""
    ticks = log.groupBy(F.floor(F.unix_timestamp("ts") / tick).cast("long").alias("t")).agg(F.count("*").alias("n"), F.sum("duration_ms").alias("d"))
    rows = _by_day(ticks, tick)
    before = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    base = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}")
    days = rows.groupBy("_day").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).select("_day", base("n"), base("d"))
    w = Window.partitionBy("_day").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c: F.sum(c).over(w) + F.col(f"_{c}")
    return rows.join(days, "_day").select("t", (total("n") % wrap).alias("calls"), total("d").alias("total"))


def derived(snaps: DataFrame, tick: int) -> DataFrame:
    """Differences of counters; a counter that fell counts 0."""
    rows = _neighbour(snaps, ["t", "calls", "total"], tick).where("_near IS NOT NULL")
    step = lambda c: F.greatest(F.lit(0).cast("long"), F.col(c) - F.col(f"_near.{c}"))
    rows = rows.select("t", step("calls").alias("calls"), step("total").alias("total_ms"), (F.col("t") - F.col("_near.t")).alias("ticks"))
    return rows.select("t", "calls", "total_ms", (F.col("calls") / (F.col("ticks") * float(tick))).alias("rate"))


def derived_by_key(log: DataFrame, key: str, tick: int, wrap: int) -> DataFrame:
    """key, t and calls of the ticks at which a key's running counter (which starts again at 0 after wrap) has grown.

    A key has one row for each tick with calls, however many calls there are.
    """
    ticks = log.groupBy(key, F.floor(F.unix_timestamp("ts") / tick).cast("long").alias("t")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy("t")
    counted = ticks.withColumn("_count", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) % wrap)
    grown = counted.withColumn("calls", F.col("_count") - F.coalesce(F.lag("_count").over(w), F.lit(0)))
    return grown.where("calls > 0").select(key, "t", "calls")


def with_gaps(ticks: DataFrame, tick: int) -> DataFrame:
    """Ticks (seconds) and, in the middle of each hole of over 2.5 ticks, a marker."""
    rows = _neighbour(ticks.select("t"), ["t"], 1, ahead=True).select("t", F.col("_near.t").alias("next"))
    hole = F.col("next") - F.col("t") > int(2.5 * tick)
    both = F.when(hole, F.array(F.struct(F.col("t"), F.lit(False).alias("gap")), F.struct((F.col("t") + F.floor((F.col("next") - F.col("t")) / 2)).alias("t"), F.lit(True).alias("gap"))))
    return rows.select(F.explode(F.coalesce(both, F.array(F.struct(F.col("t"), F.lit(False).alias("gap"))))).alias("x")).select("x.t", "x.gap")


#: Ticks that one task walks; the windows that reach into it come with it.
CHUNK_TICKS = 360
PERCENTS = (50, 95, 99)


def trailing_percentiles(log: DataFrame, size: int = 300, step: int = 10) -> DataFrame:
    """At every step (t, seconds): n and the nearest-rank p50, p95 and p99 of the latencies of the last size seconds, both ends included; ticks without any are left out.

    Equal values that enter and leave the windows at the same ticks are counted first. Such a count goes to the chunk of ticks where it
    enters, and to the next one if it leaves there; a task walks its chunk with the counts by value, adding each once and taking it away once.
    """
    s = F.unix_timestamp("ts")
    rows = log.where("gateway_internal_ms > 0").select(F.ceil(s / step).cast("long").alias("first"), F.floor((s + size) / step).cast("long").alias("last"), F.col("gateway_internal_ms").cast("long").alias("v"))
    per = max(CHUNK_TICKS, size // step + 1)
    counts = rows.groupBy("first", "last", "v").agg(F.count("*").alias("n"))
    chunk = lambda c: F.floor(F.col(c) / per)
    dealt = counts.withColumn("chunk", F.explode(F.array_distinct(F.array(chunk("first"), chunk("last")))))

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        start = int(part["chunk"].iloc[0]) * per
        values, place = np.unique(part["v"].to_numpy(), return_inverse=True)
        n = part["n"].to_numpy()
        enter, leave = np.maximum(part["first"].to_numpy() - start, 0), np.minimum(part["last"].to_numpy() + 1 - start, per)
        held, out = np.zeros(len(values), dtype=np.int64), []
        by_enter, by_leave = np.argsort(enter, kind="stable"), np.argsort(leave, kind="stable")
        ins, outs = (np.searchsorted(x[order], np.arange(per + 2)) for x, order in ((enter, by_enter), (leave, by_leave)))
        for t in range(per):
            new, old = by_enter[ins[t] : ins[t + 1]], by_leave[outs[t] : outs[t + 1]]
            np.add.at(held, place[new], n[new])
            np.subtract.at(held, place[old], n[old])
            upto = np.cumsum(held)
            if upto[-1]:
                at = np.searchsorted(upto, [-(-upto[-1] * q // 100) for q in PERCENTS])
                out.append(((start + t) * step, upto[-1], *values[at]))
        return pd.DataFrame(out, columns=["t", "n", *(f"p{q}" for q in PERCENTS)])

    return dealt.groupBy("chunk").applyInPandas(walk, "t long, n long, " + ", ".join(f"p{q} long" for q in PERCENTS))


def token_growth(log: DataFrame, start: str, middle: str, end: str) -> DataFrame:
    """Tokens of two neighbouring windows that both include their ends."""
    at = lambda s: F.lit(s).cast("timestamp")
    rows = log.where((F.col("ts") >= at(start)) & (F.col("ts") <= at(end)))
    tokens = F.col("prompt_tokens") + F.col("completion_tokens")
    return rows.agg(
        F.sum(F.when(F.col("ts") >= at(middle), tokens).otherwise(0)).alias("now_tokens"), F.sum(F.when(F.col("ts") <= at(middle), tokens).otherwise(0)).alias("before_tokens")
    )

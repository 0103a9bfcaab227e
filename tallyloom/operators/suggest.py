"""Threshold rules over statistics. Each returns id, type, severity, subject and a number that explains it.

Count thresholds grow with the window: base * max(24, hours) / 24, rounded half to even, 1 at least. Shares don't.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scope
from . import stats

SEVERITIES = ("high", "warn", "info")


@dataclass(frozen=True)
class Thresholds:
    violations: int = 20
    volume: int = 1000
    error_rate: float = 0.10
    error_calls: int = 30
    black_calls: int = 20
    black_violations: int = 5
    black_rate: float = 0.30
    white_calls: int = 100
    revoke: int = 2
    reorder_hits: int = 10
    limit_calls: int = 1000
    limit_peak: int = 20
    per_rule: int = 3
    total: int = 20
    latency_p95_ms: float = 0.0
    local_share: float = 0.0
    token_growth: float = 0.0


def thresholds(settings: Mapping[str, str]) -> Thresholds:
    """Thresholds from text settings; "24:20,168:100" means its 24 h value, unreadable ones the default."""
    found = {}
    for field in fields(Thresholds):
        text = str(settings.get(field.name, "")).strip()
        if ":" in text:
            text = dict(p.split(":", 1) for p in text.replace(" ", "").split(",") if ":" in p).get("24", "")
        try:
            found[field.name] = type(field.default)(float(text))
        except ValueError:
            continue
    return Thresholds(**found)


def scaled(base: float, hours: float) -> int:
    return max(1, round(base * max(24.0, hours) / 24.0))


def _rows(df: DataFrame, kind: str, severity: str | Column, subject: str, number: str) -> DataFrame:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(F.concat(F.lit(f"{kind}:"), F.col(subject)).alias("id"), F.lit(kind).alias("type"), sev.alias("severity"), F.col(subject).alias("subject"), F.col(number).cast("double").alias("number"))


def key_tiers(log: DataFrame, rules: DataFrame, known: DataFrame, th: Thresholds, hours: float) -> DataFrame:
    """Rule 0: black by rate, revoke of white keys with violations, white for long clean ones; unknown and black keys are skipped."""
    tiers = stats.key_tier(log).join(known, "key_name", "left_semi").join(rules.where("kind = 'black'"), "key_name", "left_anti")
    white = rules.where("kind = 'white'").select("key_name", F.lit(True).alias("white")).distinct()
    rows = tiers.join(white, "key_name", "left")
    calls, viol = F.col("calls"), F.col("violations")
    black = (calls >= scaled(th.black_calls, hours)) & (viol >= scaled(th.black_violations, hours)) & (viol / calls >= th.black_rate)
    kind = (
        F.when(black, "key_rate_black")
        .when(F.col("white"), F.when(viol >= scaled(th.revoke, hours), "key_white_revoke"))
        .when((calls >= scaled(th.white_calls, hours)) & (viol == 0), "key_whitelist")
    )
    severity = F.when(F.col("type") == "key_rate_black", "high").when(F.col("type") == "key_white_revoke", "warn").otherwise("info")
    found = rows.withColumn("type", kind).where("type IS NOT NULL")
    return found.select(F.concat_ws(":", "type", "key_name").alias("id"), "type", severity.alias("severity"), F.col("key_name").alias("subject"), viol.cast("double").alias("number"))


def key_blacklist(log: DataFrame, rules: DataFrame, known: DataFrame, already: DataFrame, th: Thresholds, hours: float) -> DataFrame:
    """Rule 1: keys with many abnormal requests, unless rule 0 has them already."""
    counted = stats.key_tier(log).where(F.col("violations") >= scaled(th.violations, hours))
    rest = counted.join(known, "key_name", "left_semi").join(rules.where("kind = 'black'"), "key_name", "left_anti")
    rest = rest.join(already.where("type = 'key_rate_black'").select(F.col("subject").alias("key_name")), "key_name", "left_anti")
    return _rows(rest, "key_blacklist", "high", "key_name", "violations")


def volume_watch(log: DataFrame, th: Thresholds, hours: float) -> DataFrame:
    return _rows(stats.group(log, "client_ip").where(F.col("calls") >= scaled(th.volume, hours)), "volume_watch", "info", "label", "calls")


def model_errors(log: DataFrame, th: Thresholds, hours: float) -> DataFrame:
    g = stats.group(log, "model").where((F.col("calls") >= scaled(th.error_calls, hours)) & (F.col("errors") / F.col("calls") >= th.error_rate))
    return _rows(g, "model_error_rate", "warn", "label", "errors")


def reorder(rules: DataFrame, least: int) -> DataFrame:
    """Rule 4: inside each action's unlocked runs the rules with enough hits exchange their own priorities by hits.

    rules: name, priority, action, locked, hits. A policy is a document of tens of rules.
    """
    by_action = Window.partitionBy("action").orderBy("priority", "name")
    rows = rules.withColumn("segment", F.sum(F.col("locked").cast("int")).over(by_action)).where(~F.col("locked") & (F.col("hits") >= least))
    seg = Window.partitionBy("action", "segment")
    slots = rows.select("action", "segment", F.col("priority").alias("new_priority"), F.row_number().over(seg.orderBy("priority", "name")).alias("k"))
    wanted = rows.withColumn("k", F.row_number().over(seg.orderBy(F.desc("hits"), "priority", "name")))
    return wanted.join(slots, ["action", "segment", "k"]).select("name", "priority", "new_priority").where("priority <> new_priority")


def silent_rules(rules: DataFrame, hits: DataFrame, ever: DataFrame, now: str, grace_days: int = 14) -> DataFrame:
    """Rule 5: rules without a hit in the window; rules that never fired only after their grace. Default rules never."""
    quiet = rules.where(~F.col("name").isin(*scope.DEFAULT_RULES)).join(hits, "name", "left_anti").join(ever.select("name", F.lit(True).alias("ever")), "name", "left")
    young = F.col("ever").isNull() & (F.col("created") > F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {grace_days} DAYS"))
    return quiet.where(~young).select("name", F.coalesce("ever", F.lit(False)).alias("fired_before"))


def idle_whitelist(rules: DataFrame, log: DataFrame) -> DataFrame:
    """Rule 6: white keys without a call."""
    return rules.where("kind = 'white'").join(log.select("key_name").distinct(), "key_name", "left_anti").select("key_name")


def add_limits(log: DataFrame, limited: DataFrame, th: Thresholds, hours: float) -> DataFrame:
    """Rule 7: busy models without a limit; rpm = max(10, 2 * peak)."""
    busy = stats.peak_per_minute(log.where("provider <> '' AND model <> ''"), "provider", "model").where((F.col("calls") >= scaled(th.limit_calls, hours)) & (F.col("peak") >= th.limit_peak))
    free = busy.join(limited, ["provider", "model"], "left_anti")
    return free.orderBy(F.desc("calls"), "provider", "model").limit(th.per_rule).select("provider", "model", "calls", "peak", F.greatest(F.lit(10), F.col("peak") * 2).alias("rpm"))


def local_share(log: DataFrame) -> DataFrame:
    """Rule 9: routed / (allowed + routed)."""
    a = F.lower(scope.norm("action"))
    out = log.agg(F.count_if(a == "allow").alias("allowed"), F.count_if(a == "route_local").alias("routed"))
    return out.withColumn("share", F.try_divide(F.col("routed"), F.col("allowed") + F.col("routed")))


def capped(rows: DataFrame, th: Thresholds) -> DataFrame:
    """At most per_rule suggestions of a type and total in all, worst severity first. rows: type, severity, seq (emission order)."""
    first = rows.withColumn("_k", F.row_number().over(Window.partitionBy("type").orderBy("seq"))).where(F.col("_k") <= th.per_rule)
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return first.orderBy(rank, "seq").limit(th.total).drop("_k")


def broken_providers(states: DataFrame) -> DataFrame:
    """A suggestion for each provider whose breaker is open or half open. states: provider, state, failures."""
    some = states.where(F.col("state").isin("open", "half_open"))
    metric = F.concat_ws(" ", "provider", "state", F.col("failures").cast("string"))
    return some.select(F.concat(F.lit("breaker:"), F.col("provider")).alias("id"), F.lit("provider_breaker").alias("type"), F.lit("high").alias("severity"), metric.alias("metric"))

"""Statistics, billing, percentiles, series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scope
from ..operators import stats, timeseries
from .registry import query

SINCE, UNTIL = "2024-01-05 00:00:00", "2024-01-25 12:00:00"
RL, LAB = ("request_log",), ("request_log", "aliases")

_IN = f"ts >= TIMESTAMP '{SINCE}' AND ts <= TIMESTAMP '{UNTIL}'"
_BLOCKED = "(starts_with(lower(trim(action)), 'block') OR coalesce(status_code, 0) = 403)"
_LOCAL = "(lower(trim(action)) = 'route_local')"
_CLIP = "least(greatest({0}, 0), prompt_tokens)"
_HEAD = "h AS (SELECT lower(alias) AS a, arg_min(concat(head_provider, '/', head_model), priority) AS head FROM aliases WHERE enabled GROUP BY 1)"
_LABEL = """coalesce(head, CASE WHEN provider <> '' AND m <> '' THEN concat(provider, '/', m) WHEN m <> '' THEN m WHEN provider <> '' THEN provider ELSE '(unknown)' END)"""
_LABELLED = f"""{_HEAD}, s AS (SELECT *, CASE WHEN provider <> '' AND starts_with(model, concat(provider, '/')) THEN substr(model, length(provider) + 2) ELSE model END AS m
  FROM request_log WHERE {_IN}), lab AS (SELECT s.*, {_LABEL} AS label FROM s LEFT JOIN h ON lower(model) = a)"""
_MEASURES = f"""count(*) AS calls, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens, count(*) FILTER ({_BLOCKED}) AS blocked, count(*) FILTER ({_LOCAL}) AS local_routed, count(*) FILTER (status_code >= 500) AS errors"""


def _log(t):
    return stats.window(t("request_log"), SINCE, UNTIL)


def _labelled(t):
    return stats.with_label(_log(t), t("aliases"))


@query("scan_request_log_window", f"SELECT req_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, action, status_code FROM request_log WHERE {_IN}", RL)
def _(t):
    return _log(t).select("req_id", scope.stamp(F.col("ts")).alias("ts"), "action", "status_code")


@query("scan_request_log_resolved", f"SELECT req_id, coalesce(nullif(trim(k.name), ''), trim(key_name)) AS key_name FROM request_log LEFT JOIN keys k USING (key_id) WHERE {_IN}", ("request_log", "keys"))
def _(t):
    return stats.with_key_name(_log(t), t("keys")).select("req_id", "key_name")


@query("join_key_name", "SELECT coalesce(nullif(trim(k.name), ''), trim(key_name)) AS key_name, count(*) AS calls FROM request_log LEFT JOIN keys k USING (key_id) GROUP BY 1", ("request_log", "keys"))
def _(t):
    return stats.with_key_name(t("request_log"), t("keys")).groupBy("key_name").agg(F.count("*").alias("calls"))


# Aliases made from parts: a brand in any case stands for its enabled parts, the smallest first.
_PART_ALIASES = "SELECT CASE WHEN p_partkey % 2 = 0 THEN lower(p_brand) ELSE p_brand END AS alias, p_type AS head_provider, concat('part', CAST(p_partkey AS varchar(20))) AS head_model, CAST(p_size AS BIGINT) * 1000000000 + p_partkey AS priority, p_partkey % 3 <> 0 AS enabled"


@query("join_alias_head", f"SELECT lower(alias) AS alias, arg_min(concat(head_provider, '/', head_model), priority) AS head, count(*) AS members FROM ({_PART_ALIASES} FROM part) WHERE enabled GROUP BY 1")
def _(t):
    aliases = t("part").select(F.when(F.col("p_partkey") % 2 == 0, F.lower("p_brand")).otherwise(F.col("p_brand")).alias("alias"), F.col("p_type").alias("head_provider"), F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("head_model"), (F.col("p_size").cast("long") * 1000000000 + F.col("p_partkey")).alias("priority"), (F.col("p_partkey") % 3 != 0).alias("enabled"))
    return aliases.where("enabled").groupBy(F.lower("alias").alias("alias")).agg(F.min_by(F.concat_ws("/", "head_provider", "head_model"), "priority").alias("head"), F.count("*").alias("members"))


@query("real_model_label", f"WITH {_LABELLED} SELECT label, count(*) AS calls FROM lab GROUP BY 1", LAB)
def _(t):
    return _labelled(t).groupBy("label").agg(F.count("*").alias("calls"))


@query(
    "stats_overview",
    f"""SELECT count(*) AS total, count(*) FILTER ({_BLOCKED}) AS blocked, count(*) FILTER ({_LOCAL}) AS local_routed, count(DISTINCT nullif(client_ip, '')) AS active_ips,
    CAST(coalesce(floor(sum(duration_ms) FILTER (duration_ms > 0) / count(*) FILTER (duration_ms > 0)), 0) AS BIGINT) AS avg_duration_ms, CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS prompt_tokens,
    CAST(coalesce(sum(completion_tokens), 0) AS BIGINT) AS completion_tokens, CAST(coalesce(sum({_CLIP.format("cached_tokens")}), 0) AS BIGINT) AS cached_tokens FROM request_log WHERE {_IN}""",
    RL,
)
def _(t):
    return stats.overview(_log(t))


def _group_query(dim: str) -> None:
    where = f"WHERE {_IN}" + (" AND provider <> ''" if dim == "provider" else "")

    @query(f"stats_group_{dim}", f"SELECT CASE WHEN trim({dim}) = '' THEN '(unknown)' ELSE trim({dim}) END AS label, {_MEASURES} FROM request_log {where} GROUP BY 1", RL)
    def _(t):
        return stats.group(_log(t), dim)


for _dim in ("provider", "key_name", "client_ip", "model", "action", "blocked_reason"):
    _group_query(_dim)


@query("stats_key_tier", f"SELECT key_name, count(*) AS calls, count(*) FILTER ({_BLOCKED}) AS blocks, count(*) FILTER ({_LOCAL}) AS locals, count(*) FILTER ({_BLOCKED} OR {_LOCAL}) AS violations FROM request_log WHERE key_name <> '' AND {_IN} GROUP BY 1", RL)
def _(t):
    return stats.key_tier(_log(t))


@query(
    "stats_key_model",
    f"""WITH {_LABELLED}, p AS (SELECT key_name, label, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens, count(*) AS calls FROM lab WHERE key_name <> '' GROUP BY 1, 2 HAVING sum(prompt_tokens + completion_tokens) > 0),
    k AS (SELECT key_name, CAST(sum(tokens) AS BIGINT) AS key_tokens FROM p GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5) SELECT p.*, key_tokens FROM p JOIN k USING (key_name)""",
    LAB,
)
def _(t):
    return stats.key_model(_labelled(t), 5)


_SUMS = f"""CAST(sum(prompt_tokens) AS BIGINT) AS prompt, CAST(sum(completion_tokens) AS BIGINT) AS completion, CAST(sum({_CLIP.format("cached_tokens")}) AS BIGINT) AS cached,
  CAST(sum({_CLIP.format("cache_creation_tokens")}) AS BIGINT) AS creation, count(*) AS calls"""
_DAY = "strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d')"


@query("stats_billing", f"WITH {_LABELLED} SELECT CASE WHEN key_name = '' THEN '(unregistered)' ELSE key_name END AS key_name, label, {_SUMS} FROM lab GROUP BY 1, 2", LAB)
def _(t):
    return stats.billing(stats.with_billing_key(_labelled(t)), "key_name", "label")


@query("stats_billing_by_key", f"WITH {_LABELLED} SELECT label, {_SUMS} FROM lab WHERE key_id = 7 GROUP BY 1", LAB)
def _(t):
    return stats.billing(_labelled(t).where("key_id = 7"), "label")


@query("stats_billing_daily", f"WITH {_LABELLED} SELECT {_DAY} AS day, label, {_SUMS} FROM lab GROUP BY 1, 2", LAB)
def _(t):
    return stats.billing(stats.with_day(_labelled(t)), "day", "label")


_PRICED = f"""b AS (SELECT label, {_SUMS} FROM lab GROUP BY 1), pr AS (SELECT b.*,
  coalesce((prompt - cached) / 1e6 * price_in + cached / 1e6 * (CASE WHEN coalesce(price_cached, 0) > 0 THEN price_cached ELSE price_in END) + creation / 1e6 * price_in + completion / 1e6 * price_out, 0) AS cost,
  price_in IS NOT NULL OR split_part(label, '/', 1) = 'local' AS priced, price_in IS NOT NULL AND cached > 0 AND coalesce(price_cached, 0) <= 0 AS cached_at_full FROM b LEFT JOIN prices USING (label))"""
BILL = ("request_log", "aliases", "prices")


@query("price_billing", f"WITH {_LABELLED}, {_PRICED} SELECT label, prompt, completion, cached, creation, calls, CAST(cost AS DOUBLE) AS cost, priced, cached_at_full FROM pr", BILL)
def _(t):
    return stats.priced(stats.billing(_labelled(t), "label"), t("prices"))


@query("join_price", f"WITH {_LABELLED}, {_PRICED} SELECT priced, count(*) AS labels, CAST(sum(calls) AS BIGINT) AS calls FROM pr GROUP BY 1", BILL)
def _(t):
    return stats.priced(stats.billing(_labelled(t), "label"), t("prices")).groupBy("priced").agg(F.count("*").alias("labels"), F.sum("calls").alias("calls"))


@query("model_spend", f"WITH {_LABELLED}, {_PRICED} SELECT label, CAST(cost AS DOUBLE) AS cost, prompt + completion AS tokens, CAST(CASE WHEN prompt + completion = 0 THEN 0 ELSE cost / (prompt + completion) * 1e6 END AS DOUBLE) AS rate_per_1m FROM pr WHERE priced", BILL)
def _(t):
    return stats.model_spend(stats.priced(stats.billing(_labelled(t), "label"), t("prices")))


@query("key_weekly_cost", f"WITH {_LABELLED.replace(_IN, _IN + ' AND key_id = 7')}, {_PRICED} SELECT round(CAST(sum(cost) AS DOUBLE), 6) AS cost FROM pr WHERE priced", BILL)
def _(t):
    rows = stats.priced(stats.billing(_labelled(t).where("key_id = 7"), "label"), t("prices"))
    return rows.where("priced").agg(F.round(F.sum("cost"), 6).alias("cost"))


@query(
    "cost_by_key",
    f"WITH {_LABELLED}, {_PRICED.replace('SELECT label, ', 'SELECT key_name, label, ').replace('GROUP BY 1)', 'GROUP BY 1, 2)')} SELECT key_name, round(CAST(sum(cost) AS DOUBLE), 6) AS cost FROM pr WHERE key_name <> '' GROUP BY 1 HAVING sum(cost) > 0",
    BILL,
)
def _(t):
    rows = stats.priced(stats.billing(_labelled(t).where("key_name <> ''"), "key_name", "label"), t("prices"))
    return rows.groupBy("key_name").agg(F.round(F.sum("cost"), 6).alias("cost")).where("cost > 0")


@query("latency_percentiles", f"SELECT count(*) AS n, " + ", ".join(f"CAST(quantile_disc(gateway_internal_ms, {p / 100}) AS DOUBLE) AS p{p}" for p in (50, 95, 99)) + f" FROM request_log WHERE gateway_internal_ms > 0 AND {_IN}", RL)
def _(t):
    return stats.percentiles(_log(t))


_RANKED = "r AS (SELECT provider, duration_ms, count(*) OVER (PARTITION BY provider) AS n, row_number() OVER (PARTITION BY provider ORDER BY duration_ms) - 1 AS place FROM request_log WHERE duration_ms > 0 AND " + _IN + ")"


def _percentile_query(name: str, rank_sql: str, rank) -> None:
    @query(name, f"WITH {_RANKED} SELECT provider, n, duration_ms FROM r WHERE place = greatest(least({rank_sql}, n - 1), 0)", RL)
    def _(t):
        return stats.ranked_percentile(_log(t).where("duration_ms > 0"), "duration_ms", ["provider"], rank()).select("provider", "n", "duration_ms")


_percentile_query("suggestion_p95", "CAST(round_even(0.95 * (n - 1), 0) AS BIGINT)", lambda: F.bround(F.lit(0.95) * (F.col("n") - 1), 0).cast("long"))
_percentile_query("eval_p95", "CAST(floor(n * 0.95) AS BIGINT)", lambda: F.floor(F.col("n") * F.lit(0.95)).cast("long"))
_percentile_query("replay_pct", "n * 90 // 100", lambda: F.floor(F.col("n") * 90 / 100).cast("long"))


@query("median_eval", f"SELECT provider, CAST(median(duration_ms) AS DOUBLE) AS median_ms FROM request_log WHERE duration_ms > 0 AND {_IN} GROUP BY 1", RL)
def _(t):
    return _log(t).where("duration_ms > 0").groupBy("provider").agg(F.median("duration_ms").alias("median_ms"))


@query("peak_per_minute", f"SELECT provider, model, max(c) AS peak, CAST(sum(c) AS BIGINT) AS calls FROM (SELECT provider, model, date_trunc('minute', ts) AS m, count(*) AS c FROM request_log WHERE {_IN} GROUP BY ALL) GROUP BY 1, 2", RL)
def _(t):
    return stats.peak_per_minute(_log(t), "provider", "model")


@query(
    "stats_summary_groups",
    f"""WITH {_LABELLED} SELECT * FROM (SELECT 'key' AS kind, key_name AS label, {_MEASURES} FROM lab GROUP BY 2 UNION ALL SELECT 'provider', provider, {_MEASURES} FROM lab GROUP BY 2
    UNION ALL SELECT 'model', label, {_MEASURES} FROM lab GROUP BY 2 UNION ALL SELECT 'rule', blocked_reason, {_MEASURES} FROM lab GROUP BY 2) WHERE label NOT IN ('', '(unknown)')""",
    LAB,
)
def _(t):
    return stats.summary_groups(_labelled(t))


_ALL = f"""count(*) AS calls, CAST(coalesce(sum(prompt_tokens + completion_tokens), 0) AS BIGINT) AS tokens, CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS prompt, CAST(coalesce(sum(completion_tokens), 0) AS BIGINT) AS completion,
    CAST(coalesce(sum({_CLIP.format("cached_tokens")}), 0) AS BIGINT) AS cached, CAST(coalesce(sum({_CLIP.format("cache_creation_tokens")}), 0) AS BIGINT) AS creation, count(*) FILTER ({_BLOCKED}) AS blocked, count(*) FILTER ({_LOCAL}) AS local_routed,
    count(*) FILTER (status_code >= 500) AS errors, CAST(coalesce(floor(sum(duration_ms) FILTER (duration_ms > 0) / count(*) FILTER (duration_ms > 0)), 0) AS BIGINT) AS avg_ms"""
_BUCKET = f"CAST(floor(epoch(ts - TIMESTAMP '{SINCE}') / (epoch(TIMESTAMP '{UNTIL}' - TIMESTAMP '{SINCE}') / 60)) AS BIGINT)"


@query(
    "stats_summary",
    f"""WITH {_LABELLED}, v AS MATERIALIZED (SELECT l.* REPLACE (coalesce(nullif(trim(k.name), ''), trim(key_name)) AS key_name) FROM lab l LEFT JOIN keys k USING (key_id)),
    r AS MATERIALIZED (SELECT * FROM v WHERE key_name IN (SELECT name FROM keys WHERE name <> '')), o AS (SELECT * FROM v WHERE provider IN ('external', 'other')),
    km AS (SELECT key_name, label, {_ALL} FROM r GROUP BY 1, 2), kt AS (SELECT key_name FROM km WHERE tokens > 0 GROUP BY 1 ORDER BY sum(tokens) DESC, 1 LIMIT 5),
    p AS (SELECT 'overview' AS part, CAST(NULL AS VARCHAR) AS k1, CAST(NULL AS VARCHAR) AS k2, {_ALL} FROM v
    UNION ALL SELECT 'key', key_name, NULL, {_ALL} FROM r GROUP BY key_name UNION ALL SELECT 'provider', provider, NULL, {_ALL} FROM o GROUP BY provider UNION ALL SELECT 'model', label, NULL, {_ALL} FROM o GROUP BY label
    UNION ALL SELECT 'rule', CASE WHEN trim(blocked_reason) = '' THEN '(unknown)' ELSE trim(blocked_reason) END AS rule, NULL, {_ALL} FROM v GROUP BY rule
    UNION ALL SELECT 'billing', * FROM km UNION ALL SELECT 'key_model', * FROM km WHERE tokens > 0 AND key_name IN (SELECT key_name FROM kt) UNION ALL SELECT 'daily', {_DAY} AS day, label, {_ALL} FROM r GROUP BY day, label
    UNION ALL SELECT 'series', CAST({_BUCKET} AS VARCHAR) AS k1, NULL, {_ALL} FROM v WHERE {_BUCKET} < 60 GROUP BY {_BUCKET}
    UNION ALL SELECT 'series', CAST(i AS VARCHAR), NULL, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0 FROM range(60) AS t(i) WHERE i NOT IN (SELECT {_BUCKET} FROM v))
    SELECT part, k1, CASE WHEN part = 'series' THEN strftime(TIMESTAMP '{SINCE}' + INTERVAL 8 HOUR + CAST(k1 AS BIGINT) * INTERVAL '29520 seconds', '%m-%d %H:%M') ELSE k2 END AS k2, calls, tokens, prompt, completion, cached, creation, blocked, local_routed, errors,
    CASE WHEN part = 'overview' THEN (SELECT count(DISTINCT nullif(trim(client_ip), '')) FROM v) ELSE 0 END AS active_ips, avg_ms FROM p""",
    ("request_log", "aliases", "keys"),
)
def _(t):
    """The whole page; keys by their present names, one of two providers registered."""
    log = stats.with_key_name(stats.with_label(_log(t), t("aliases")), t("keys"))
    providers = t("keys").sparkSession.createDataFrame([("external",), ("other",)], "provider string")
    return stats.summary(log, SINCE, UNTIL, 60, 5, t("keys"), providers)


_BOUNDS = [50, 100, 200, 500, 1000, 2000]


@query("histogram_fixed", "SELECT le, CAST(sum(n) AS BIGINT) AS cumulative FROM (" + " UNION ALL ".join(f"SELECT '{b}' AS le, CAST(duration_ms <= {b} AS BIGINT) AS n FROM request_log WHERE duration_ms > 0 AND {_IN}" for b in _BOUNDS) + f" UNION ALL SELECT '+Inf', 1 FROM request_log WHERE duration_ms > 0 AND {_IN}) GROUP BY 1", RL)
def _(t):
    return stats.histogram(_log(t), "duration_ms", _BOUNDS)


@query("top_n_keys", f"SELECT key_name, count(*) AS calls FROM request_log WHERE key_name <> '' AND {_IN} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", RL)
def _(t):
    return stats.top_k(_log(t).where("key_name <> ''").groupBy("key_name").agg(F.count("*").alias("calls")), "calls", "key_name", 10)


@query("key_allow_residual", f"SELECT key_name, greatest(0, count(*) - count(*) FILTER ({_BLOCKED}) - count(*) FILTER ({_LOCAL})) AS allowed FROM request_log WHERE key_name <> '' AND {_IN} GROUP BY 1", RL)
def _(t):
    return stats.key_tier(_log(t)).select("key_name", F.greatest(F.lit(0).cast("long"), F.col("calls") - F.col("blocks") - F.col("locals")).alias("allowed"))


@query("semi_registered", f"SELECT key_name, count(*) AS calls FROM request_log WHERE key_id IN (SELECT key_id FROM keys) AND {_IN} GROUP BY 1", ("request_log", "keys"))
def _(t):
    return _log(t).join(t("keys"), "key_id", "left_semi").groupBy("key_name").agg(F.count("*").alias("calls"))


_LISTED = "SELECT concat('key', CAST(user_id AS VARCHAR)) AS key_name, CASE WHEN event_type = 'error' AND event_id % 7 = 0 THEN 'black' WHEN event_type = 'signup' THEN 'middle' ELSE 'white' END AS kind FROM events WHERE event_id % 3 = 0"


@query("key_verdict", f"SELECT key_name, CASE min(CASE kind WHEN 'black' THEN 0 WHEN 'middle' THEN 1 ELSE 2 END) WHEN 0 THEN 'black' WHEN 1 THEN 'middle' ELSE 'white' END AS verdict FROM ({_LISTED}) GROUP BY 1")
def _(t):
    """Lists made from events: the strictest that a key is on counts."""
    kind = F.when((F.col("event_type") == "error") & (F.col("event_id") % 7 == 0), "black").when(F.col("event_type") == "signup", "middle").otherwise("white")
    rules = t("events").where("event_id % 3 = 0").select(F.concat(F.lit("key"), F.col("user_id").cast("string")).alias("key_name"), kind.alias("kind"))
    rank = F.when(F.col("kind") == "black", 0).when(F.col("kind") == "middle", 1).otherwise(2)
    return rules.groupBy("key_name").agg(F.min_by("kind", rank).alias("verdict"))


# Keys made from users: some masked already, names that share a mask.
_USER_KEYS = "SELECT DISTINCT user_id AS key_id, CASE WHEN user_id % 9 = 0 THEN concat('tk-***', CAST(user_id AS VARCHAR)) ELSE concat(CASE WHEN user_id % 2 = 0 THEN 'tk-' ELSE 'pk-' END, lpad(CAST(user_id * 7919 AS VARCHAR), 12, '0'), '-', lpad(CAST(user_id % 40 AS VARCHAR), 3, '0')) END AS key_value, concat('name', CAST(user_id AS VARCHAR)) AS name FROM events"


def _user_keys(t):
    u = F.col("user_id")
    text = lambda c, n: F.lpad(c.cast("string"), n, "0")
    plain = F.concat(F.when(u % 2 == 0, "tk-").otherwise("pk-"), text(u * 7919, 12), F.lit("-"), text(u % 40, 3))
    return t("events").select(u.alias("key_id"), F.when(u % 9 == 0, F.concat(F.lit("tk-***"), u.cast("string"))).otherwise(plain).alias("key_value"), F.concat(F.lit("name"), u.cast("string")).alias("name")).distinct()


@query("join_masked_token_name", f"WITH k AS (SELECT concat(left(key_value, 3), '***', right(key_value, 4)) AS mask, min(name) AS name FROM ({_USER_KEYS}) WHERE strpos(key_value, '*') = 0 GROUP BY 1), a AS (SELECT concat(CASE WHEN user_id % 2 = 0 THEN 'tk-***' ELSE 'pk-***' END, '-', lpad(CAST(user_id % 40 AS VARCHAR), 3, '0')) AS mask FROM events) SELECT mask, name, count(*) AS rows_named FROM a JOIN k USING (mask) GROUP BY 1, 2")
def _(t):
    """Rows that only know a masked key get its name; of keys with one mask the first name."""
    named = _user_keys(t).where(~F.col("key_value").contains("*")).groupBy(scope.mask_key(F.col("key_value")).alias("mask")).agg(F.min("name").alias("name"))
    u = F.col("user_id")
    rows = t("events").select(F.concat(F.when(u % 2 == 0, "tk-***").otherwise("pk-***"), F.lit("-"), F.lpad((u % 40).cast("string"), 3, "0")).alias("mask"))
    return rows.join(named, "mask").groupBy("mask", "name").agg(F.count("*").alias("rows_named"))


_PATTERNS = "SELECT DISTINCT concat(left(key_value, CAST(1 + key_id % 6 AS INT)), '***', right(key_value, CAST(key_id % 5 AS INT))) AS pattern FROM k WHERE key_id % 11 = 1"


@query("theta_fuzzy_key", f"WITH k AS ({_USER_KEYS}), m AS ({_PATTERNS}) SELECT k.key_id, m.pattern FROM k JOIN m ON length(key_value) >= 14 AND starts_with(key_value, split_part(pattern, '***', 1)) AND ends_with(key_value, split_part(pattern, '***', 2))")
def _(t):
    """Keys by patterns of different lengths, cut from some of them."""
    keys = _user_keys(t)
    ends = F.concat(F.left("key_value", (1 + F.col("key_id") % 6).cast("int")), F.lit("***"), F.right("key_value", (F.col("key_id") % 5).cast("int")))
    return stats.fuzzy_keys(keys, keys.where("key_id % 11 = 1").select(ends.alias("pattern")).distinct())


@query("retention_purge", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS rows_kept FROM request_log WHERE NOT (ts < TIMESTAMP '2024-01-15 00:00:00') GROUP BY 1", RL)
def _(t):
    kept = t("request_log").where(F.col("ts") >= F.lit("2024-01-15 00:00:00").cast("timestamp"))
    return kept.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("rows_kept"))


@query("backfill_missing", "SELECT count(*) AS added, min(CAST(req_id AS BIGINT)) AS first_id FROM (SELECT DISTINCT req_id FROM audit WHERE req_id NOT IN (SELECT req_id FROM request_log WHERE id % 3 = 0))", ("request_log", "audit"))
def _(t):
    stored = t("request_log").where("id % 3 = 0").select("req_id")
    return t("audit").select("req_id").distinct().join(stored, "req_id", "left_anti").agg(F.count("*").alias("added"), F.min(F.col("req_id").cast("long")).alias("first_id"))


@query("insert_normalize", "SELECT substr(concat(req_id, 'x'), 1, 3) AS req_id, coalesce(nullif(provider, ''), '-') AS provider, coalesce(status_code, 0) AS status_code FROM audit", ("audit",))
def _(t):
    return t("audit").select(F.substring(F.concat("req_id", F.lit("x")), 1, 3).alias("req_id"), F.coalesce(F.nullif("provider", F.lit("")), F.lit("-")).alias("provider"), F.coalesce("status_code", F.lit(0)).alias("status_code"))


@query(
    "timeseries_n",
    f"""WITH p AS (SELECT epoch(TIMESTAMP '{UNTIL}' - TIMESTAMP '{SINCE}') / 24 AS width), b AS (SELECT CAST(floor(epoch(ts - TIMESTAMP '{SINCE}') / width) AS BIGINT) AS idx, count(*) AS calls, count(*) FILTER ({_LOCAL}) AS routed, count(*) FILTER ({_BLOCKED}) AS blocked
    FROM request_log, p WHERE ts >= TIMESTAMP '{SINCE}' AND ts < TIMESTAMP '{UNTIL}' GROUP BY 1), c AS (SELECT unnest(range(24)) AS idx)
    SELECT idx, strftime(TIMESTAMP '{SINCE}' + INTERVAL 8 HOUR + idx * INTERVAL '73800 seconds', '%m-%d %H:%M') AS label, coalesce(calls, 0) AS calls, coalesce(routed, 0) AS routed, coalesce(blocked, 0) AS blocked FROM c LEFT JOIN b USING (idx)""",
    RL,
)
def _(t):
    return timeseries.series(t("request_log"), SINCE, UNTIL, 24)


@query(
    "chart_series",
    f"""WITH e AS (SELECT *, CAST(floor(epoch(ts - TIMESTAMP '2024-01-10 00:00:00') / 600) AS BIGINT) AS idx, CAST(floor(epoch(ts - TIMESTAMP '2024-01-10 00:00:00') / 10) AS BIGINT) AS slot FROM request_log WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-11 00:00:00'),
    m AS (SELECT idx, max(c) AS peak FROM (SELECT idx, slot, count(*) AS c FROM e GROUP BY 1, 2) GROUP BY 1),
    b AS (SELECT idx, count(*) AS calls, count(*) FILTER (status_code >= 500) AS e5, count(*) FILTER (status_code = 403) AS e403, count(*) FILTER (status_code = 429) AS e429, CAST(quantile_disc(gateway_internal_ms, 0.5) FILTER (gateway_internal_ms > 0) AS DOUBLE) AS p50,
      CAST(quantile_disc(gateway_internal_ms, 0.95) FILTER (gateway_internal_ms > 0) AS DOUBLE) AS p95, CAST(quantile_disc(gateway_internal_ms, 0.99) FILTER (gateway_internal_ms > 0) AS DOUBLE) AS p99, min(gateway_internal_ms) FILTER (gateway_internal_ms > 0) AS min_ms, max(gateway_internal_ms) FILTER (gateway_internal_ms > 0) AS max_ms FROM e GROUP BY 1),
    c AS (SELECT unnest(range(144)) AS idx) SELECT idx, coalesce(calls, 0) AS calls, coalesce(calls, 0) / 600.0 AS qps, coalesce(peak, 0) / 10.0 AS qps_max, e5 / calls AS share_5xx, e403 / calls AS share_403, e429 / calls AS share_429, p50, p95, p99, min_ms, max_ms FROM c LEFT JOIN b USING (idx) LEFT JOIN m USING (idx)""",
    RL,
)
def _(t):
    return timeseries.chart(t("request_log"), "2024-01-10 00:00:00", "2024-01-11 00:00:00", 144)


@query("daily_heatmap", f"SELECT {_DAY} AS day, count(*) AS calls, sqrt(count(*)) AS shade FROM request_log GROUP BY 1", RL)
def _(t):
    return stats.with_day(t("request_log")).groupBy("day").agg(F.count("*").alias("calls")).withColumn("shade", F.sqrt("calls"))


@query(
    "ring_derive",
    """WITH tick AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS t, count(*) AS n, CAST(sum(duration_ms) AS BIGINT) AS d FROM request_log GROUP BY 1),
    snap AS (SELECT t, CAST(sum(n) OVER w % 500 AS BIGINT) AS calls, CAST(sum(d) OVER w AS BIGINT) AS total FROM tick WINDOW w AS (ORDER BY t)),
    g AS (SELECT t, greatest(0, calls - lag(calls) OVER o) AS calls, greatest(0, total - lag(total) OVER o) AS total_ms, t - lag(t) OVER o AS ticks FROM snap WINDOW o AS (ORDER BY t))
    SELECT t, calls, total_ms, CAST(calls / (ticks * 3600.0) AS DOUBLE) AS rate FROM g WHERE ticks IS NOT NULL""",
    RL,
)
def _(t):
    return timeseries.derived(timeseries.snapshots(t("request_log"), 3600, 500), 3600)


@query(
    "ring_derive_keys",
    """WITH tick AS (SELECT key_name, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS t, count(*) AS n FROM request_log WHERE key_name <> '' GROUP BY 1, 2), c AS (SELECT key_name, t, CAST(sum(n) OVER (PARTITION BY key_name ORDER BY t) % 50 AS BIGINT) AS c FROM tick)
    SELECT key_name, t, calls FROM (SELECT key_name, t, c - coalesce(lag(c) OVER (PARTITION BY key_name ORDER BY t), 0) AS calls FROM c) WHERE calls > 0""",
    RL,
)
def _(t):
    return timeseries.derived_by_key(t("request_log").where("key_name <> ''"), "key_name", 3600, 50)


@query(
    "ring_gap",
    """WITH tick AS (SELECT DISTINCT CAST(floor(epoch(ts) / 600) AS BIGINT) * 600 AS t FROM request_log), g AS (SELECT t, lead(t) OVER (ORDER BY t) AS n FROM tick)
    SELECT t, false AS gap FROM g UNION ALL SELECT t + (n - t) // 2, true FROM g WHERE n - t > 1500""",
    RL,
)
def _(t):
    ticks = t("request_log").select((F.floor(F.unix_timestamp("ts") / 600) * 600).cast("long").alias("t")).distinct()
    return timeseries.with_gaps(ticks, 600)


@query("ring_retention", "SELECT t FROM (SELECT DISTINCT CAST(floor(epoch(ts) / 600) AS BIGINT) * 600 AS t FROM request_log) WHERE t >= 1706313600 - 500 * 600 ORDER BY t DESC LIMIT 300", RL)
def _(t):
    ticks = t("request_log").select((F.floor(F.unix_timestamp("ts") / 600) * 600).cast("long").alias("t")).distinct()
    return ticks.where(F.col("t") >= 1706313600 - 500 * 600).orderBy(F.desc("t")).limit(300)


@query(
    "trailing_percentile",
    """WITH x AS (SELECT gateway_internal_ms AS v, unnest(range(CAST(ceil(epoch(ts) / 10) AS BIGINT), CAST(floor((epoch(ts) + 300) / 10) AS BIGINT) + 1)) * 10 AS t FROM request_log WHERE gateway_internal_ms > 0)
    SELECT t, count(*) AS n, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.95) AS p95, quantile_disc(v, 0.99) AS p99 FROM x GROUP BY t""",
    RL,
)
def _(t):
    """Every ten seconds over the last five minutes."""
    return timeseries.trailing_percentiles(t("request_log"), 300, 10)


@query(
    "token_growth",
    f"""SELECT CAST(sum(CASE WHEN ts >= TIMESTAMP '2024-01-15 00:00:00' THEN prompt_tokens + completion_tokens ELSE 0 END) AS BIGINT) AS now_tokens, CAST(sum(CASE WHEN ts <= TIMESTAMP '2024-01-15 00:00:00' THEN prompt_tokens + completion_tokens ELSE 0 END) AS BIGINT) AS before_tokens
    FROM request_log WHERE ts >= TIMESTAMP '2024-01-08 00:00:00' AND ts <= TIMESTAMP '2024-01-22 00:00:00'""",
    RL,
)
def _(t):
    return timeseries.token_growth(t("request_log"), "2024-01-08 00:00:00", "2024-01-15 00:00:00", "2024-01-22 00:00:00")

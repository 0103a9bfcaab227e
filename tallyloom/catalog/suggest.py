"""Suggestion rules, rankings of candidates and tiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats, suggest
from ..sources.adapters import REQUEST_LOG
from ..streaming import state
from .registry import SQL, query
from .stats import LAB, RL, SINCE, UNTIL, _BLOCKED, _IN, _LOCAL

TH = suggest.Thresholds(volume=1, limit_calls=1, limit_peak=1, white_calls=1, error_rate=0.01)
HOURS = 24.0
KR = ("request_log", "key_rules")
_KNOWN = "known AS (SELECT DISTINCT key_name FROM request_log WHERE key_name <> '' AND key_name <> 'key9')"
_TIER = f"t AS (SELECT key_name, count(*) AS calls, count(*) FILTER ({_BLOCKED} OR {_LOCAL}) AS violations FROM request_log WHERE key_name <> '' AND {_IN} GROUP BY 1)"
_OPEN = "key_name IN (SELECT key_name FROM known) AND key_name NOT IN (SELECT key_name FROM key_rules WHERE kind = 'black')"
_ZERO = f"""{_KNOWN}, {_TIER}, z AS (SELECT *, CASE WHEN calls >= 20 AND violations >= 5 AND violations / calls >= 0.45 THEN 'key_rate_black'
  WHEN key_name IN (SELECT key_name FROM key_rules WHERE kind = 'white') THEN CASE WHEN violations >= 2 THEN 'key_white_revoke' END WHEN calls >= 1 AND violations = 0 THEN 'key_whitelist' END AS type FROM t WHERE {_OPEN})"""
ZERO = suggest.Thresholds(black_rate=0.45, white_calls=1)


def _log(t):
    return stats.window(t("request_log"), SINCE, UNTIL)


def _known(t):
    return t("request_log").where("key_name <> '' AND key_name <> 'key9'").select("key_name").distinct()


def _zero(t):
    return suggest.key_tiers(_log(t), t("key_rules"), _known(t), ZERO, HOURS)


@query("suggest_key_tier", f"WITH {_ZERO} SELECT concat(type, ':', key_name) AS id, type, CASE type WHEN 'key_rate_black' THEN 'high' WHEN 'key_white_revoke' THEN 'warn' ELSE 'info' END AS severity, key_name AS subject, CAST(violations AS DOUBLE) AS number FROM z WHERE type IS NOT NULL", KR)
def _(t):
    return _zero(t)


@query("suggest_key_blacklist", f"WITH {_ZERO} SELECT concat('key_blacklist:', key_name) AS id, 'key_blacklist' AS type, 'high' AS severity, key_name AS subject, CAST(violations AS DOUBLE) AS number FROM z WHERE violations >= 20 AND coalesce(type, '') <> 'key_rate_black'", KR)
def _(t):
    return suggest.key_blacklist(_log(t), t("key_rules"), _known(t), _zero(t), ZERO, HOURS)


def _found(kind: str, severity: str, dim: str, number: str, having: str) -> str:
    return f"SELECT concat('{kind}:', label) AS id, '{kind}' AS type, '{severity}' AS severity, label AS subject, CAST({number} AS DOUBLE) AS number FROM (SELECT CASE WHEN {dim} = '' THEN '(unknown)' ELSE {dim} END AS label, count(*) AS calls, count(*) FILTER (status_code >= 500) AS errors FROM request_log WHERE {_IN} GROUP BY 1) WHERE {having}"


@query("suggest_volume_watch", _found("volume_watch", "info", "client_ip", "calls", "calls >= 40"), RL)
def _(t):
    return suggest.volume_watch(_log(t), suggest.Thresholds(volume=40), HOURS)


@query("suggest_model_errors", _found("model_error_rate", "warn", "model", "errors", "calls >= 30 AND errors / calls >= 0.01"), RL)
def _(t):
    return suggest.model_errors(_log(t), TH, HOURS)


# The rules that decided something, with their hits: by risk, some of them locked.
_RULES = "SELECT concat(rule, ' ', provider, ' ', CAST(id % 4 AS VARCHAR)) AS name, CAST(max(risk_score) * 10 + min(id) AS BIGINT) AS priority, max(action) AS action, count(*) % 5 = 1 AS locked, count(*) AS hits FROM audit WHERE rule <> '' GROUP BY 1"


def _rules(t):
    rows = t("audit").where("rule <> ''").groupBy(F.concat_ws(" ", "rule", "provider", (F.col("id") % 4).cast("string")).alias("name"))
    return rows.agg((F.max("risk_score") * 10 + F.min("id")).cast("long").alias("priority"), F.max("action").alias("action"), (F.count("*") % 5 == 1).alias("locked"), F.count("*").alias("hits"))


@query("rule_reorder", f"""WITH r AS ({_RULES}), s AS (SELECT *, sum(CAST(locked AS INT)) OVER (PARTITION BY action ORDER BY priority, name) AS seg FROM r), u AS (SELECT * FROM s WHERE NOT locked AND hits >= 10),
  k AS (SELECT *, row_number() OVER (PARTITION BY action, seg ORDER BY priority, name) AS slot, row_number() OVER (PARTITION BY action, seg ORDER BY hits DESC, priority, name) AS want FROM u)
  SELECT a.name, a.priority, b.priority AS new_priority FROM k a JOIN k b ON a.action = b.action AND a.seg = b.seg AND a.want = b.slot WHERE a.priority <> b.priority""", ("audit",))
def _(t):
    return suggest.reorder(_rules(t), 10)


@query("reorder_apply", f"""WITH r AS ({_RULES}), s AS (SELECT *, sum(CAST(locked AS INT)) OVER (PARTITION BY action ORDER BY priority, name) AS seg FROM r), u AS (SELECT * FROM s WHERE NOT locked AND hits >= 10),
  k AS (SELECT *, row_number() OVER (PARTITION BY action, seg ORDER BY priority, name) AS slot, row_number() OVER (PARTITION BY action, seg ORDER BY hits DESC, priority, name) AS want FROM u),
  n AS (SELECT a.name, b.priority AS p FROM k a JOIN k b ON a.action = b.action AND a.seg = b.seg AND a.want = b.slot) SELECT r.name, coalesce(p, priority) AS priority FROM r LEFT JOIN n USING (name)""", ("audit",))
def _(t):
    rules = _rules(t)
    moved = suggest.reorder(rules, 10).select("name", "new_priority")
    return rules.join(moved, "name", "left").select("name", F.coalesce("new_priority", "priority").alias("priority"))


_NAMES = "SELECT name, created FROM (VALUES ('rule0', TIMESTAMP '2023-01-01 00:00:00'), ('rule1', TIMESTAMP '2023-01-01 00:00:00'), ('old', TIMESTAMP '2023-01-01 00:00:00'), ('young', TIMESTAMP '2024-01-24 00:00:00'), ('default_allow', TIMESTAMP '2023-01-01 00:00:00')) AS t(name, created)"


@query("anti_silent_rules", f"WITH n AS ({_NAMES}), e AS (SELECT DISTINCT rule AS name FROM audit), h AS (SELECT DISTINCT rule AS name FROM audit WHERE rule <> 'rule1') SELECT name, name IN (SELECT name FROM e) AS fired_before FROM n WHERE name <> 'default_allow' AND name NOT IN (SELECT name FROM h) AND (name IN (SELECT name FROM e) OR created <= TIMESTAMP '2024-01-11 12:00:00')", ("audit",))
def _(t):
    rows = t("audit").select(F.col("rule").alias("name")).distinct()
    return suggest.silent_rules(rows.sparkSession.sql(_NAMES), rows.where("name <> 'rule1'"), rows, UNTIL)


@query("anti_idle_whitelist", "SELECT key_name FROM key_rules WHERE kind = 'white' AND key_name NOT IN (SELECT key_name FROM request_log)", KR)
def _(t):
    return suggest.idle_whitelist(t("key_rules"), t("request_log"))


@query("suggest_add_limit", f"WITH m AS (SELECT provider, model, max(c) AS peak, CAST(sum(c) AS BIGINT) AS calls FROM (SELECT provider, model, date_trunc('minute', ts) AS m, count(*) AS c FROM request_log WHERE provider <> '' AND model <> '' AND {_IN} GROUP BY ALL) GROUP BY 1, 2) SELECT provider, model, calls, peak, greatest(10, peak * 2) AS rpm FROM m WHERE model <> 'base' ORDER BY calls DESC, provider, model LIMIT 3", RL)
def _(t):
    log = _log(t)
    limited = log.sparkSession.createDataFrame([("local", "base")], "provider string, model string")
    return suggest.add_limits(log, limited, TH, HOURS)


@query("suggest_local_share", f"SELECT allowed, routed, CAST(routed / (allowed + routed) AS DOUBLE) AS share FROM (SELECT count(*) FILTER (action = 'allow') AS allowed, count(*) FILTER (action = 'route_local') AS routed FROM request_log WHERE {_IN})", RL)
def _(t):
    return suggest.local_share(_log(t))


@query("suggestion_cap", "SELECT type, severity, seq FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY seq) AS k FROM (SELECT event_type AS type, CASE event_type WHEN 'error' THEN 'high' WHEN 'signup' THEN 'warn' ELSE 'info' END AS severity, event_id AS seq FROM events WHERE value > 50)) WHERE k <= 3 ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END, seq LIMIT 5")
def _(t):
    """Suggestions made from large events, three of a type and five in all."""
    severity = F.when(F.col("event_type") == "error", "high").when(F.col("event_type") == "signup", "warn").otherwise("info")
    rows = t("events").where("value > 50").select(F.col("event_type").alias("type"), severity.alias("severity"), F.col("event_id").alias("seq"))
    return suggest.capped(rows, suggest.Thresholds(total=5))


# Candidates made from parts: for each brand an alias with its members.
_CANDIDATES = "SELECT p_brand AS alias, concat('part', CAST(p_partkey AS VARCHAR)) AS model, p_size % 4 AS rank, CAST(p_retailprice AS DOUBLE) AS price_in, CAST(p_size AS BIGINT) * 4000 AS context_length, p_partkey % 3 + 1 AS tier, p_partkey AS pos FROM part"


def _candidates(t):
    size, key = F.col("p_size"), F.col("p_partkey")
    model = F.concat(F.lit("part"), key.cast("string"))
    return t("part").select(F.col("p_brand").alias("alias"), model.alias("model"), (size % 4).alias("rank"), F.col("p_retailprice").cast("double").alias("price_in"), (size.cast("long") * 4000).alias("context_length"), (key % 3 + 1).alias("tier"), key.alias("pos"))


@query("candidate_rank", f"SELECT alias, model, row_number() OVER (PARTITION BY alias ORDER BY rank, price_in, pos) AS place FROM ({_CANDIDATES}) c")
def _(t):
    """The order in which an alias tries its members."""
    from pyspark.sql import Window

    return _candidates(t).select("alias", "model", F.row_number().over(Window.partitionBy("alias").orderBy("rank", "price_in", "pos")).cast("long").alias("place"))


@query("pick_fallback", f"SELECT alias, arg_min(model, {{'c': context_length, 'r': rank, 'p': price_in, 'k': pos}}) AS model FROM ({_CANDIDATES}) c WHERE model NOT IN (SELECT arg_min(model, {{'r': rank, 'p': price_in, 'k': pos}}) FROM ({_CANDIDATES}) d GROUP BY alias) AND context_length > 32000 GROUP BY alias")
def _(t):
    """After an alias's first member failed for its length: of the untried ones with more context the smallest."""
    rows = _candidates(t)
    tried = rows.groupBy("alias").agg(F.min_by("model", F.struct("rank", "price_in", "pos")).alias("model"))
    return rows.join(tried, ["alias", "model"], "left_anti").where("context_length > 32000").groupBy("alias").agg(F.min_by("model", F.struct("context_length", "rank", "price_in", "pos")).alias("model"))


@query("tier_select", f"SELECT alias, level, model FROM (SELECT c.alias, l.level, c.model, row_number() OVER (PARTITION BY c.alias, l.level ORDER BY CASE WHEN tier >= level THEN 0 ELSE 1 END, CASE WHEN tier >= level THEN tier ELSE -tier END, pos) AS k FROM ({_CANDIDATES}) c, (VALUES (1), (2), (3), (4)) AS l(level)) WHERE k = 1")
def _(t):
    """For each level of difficulty the member of the lowest tier that reaches it, else of the highest."""
    fits = F.col("tier") >= F.col("level")
    leveled = _candidates(t).select("*", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("level"))
    order = F.struct(F.when(fits, 0).otherwise(1), F.when(fits, F.col("tier")).otherwise(-F.col("tier")), "pos")
    return leveled.groupBy("alias", "level").agg(F.min_by("model", order).alias("model"))


@query("breaker_report", "SELECT provider, model, coalesce(state, 'closed') AS state, CASE WHEN state = 'open' THEN greatest(0, 30 - 12) ELSE 0 END AS cooldown FROM (SELECT DISTINCT provider, model FROM request_log WHERE provider <> '' UNION SELECT 'external', 'extra') LEFT JOIN (SELECT 'external' AS provider, 'fast' AS model, 'open' AS state) USING (provider, model)", RL)
def _(t):
    log = t("request_log")
    known = log.where("provider <> ''").select("provider", "model").union(log.sparkSession.createDataFrame([("external", "extra")], "provider string, model string")).distinct()
    state = log.sparkSession.createDataFrame([("external", "fast", "open", 12)], "provider string, model string, state string, elapsed int")
    joined = known.join(F.broadcast(state), ["provider", "model"], "left")
    return joined.select("provider", "model", F.coalesce("state", F.lit("closed")).alias("state"), F.when(F.col("state") == "open", F.greatest(F.lit(0), 30 - F.col("elapsed"))).otherwise(0).alias("cooldown"))


@query(
    "suggest_breaker",
    f"WITH b AS ({SQL['breaker_fsm'].replace('WITH RECURSIVE', 'WITH RECURSIVE', 1)}) SELECT concat('breaker:', provider) AS id, 'provider_breaker' AS type, 'high' AS severity, concat(provider, ' ', state, ' ', CAST(failures AS VARCHAR)) AS metric FROM (SELECT concat(provider, ' ', strftime(ts, '%Y-%m-%d')) AS provider, arg_max(out, {{'t': ts, 'id': id}}) AS state, count(*) FILTER (status_code >= 500) AS failures FROM b JOIN (SELECT event_id AS id, {REQUEST_LOG['ts']} AS ts, {REQUEST_LOG['provider']} AS provider, {REQUEST_LOG['status_code']} AS status_code FROM events) USING (id) GROUP BY 1) WHERE state IN ('open', 'half_open')",
)
def _(t):
    """What each provider's breaker ends each day with."""
    rows = t("request_log").select("provider", F.unix_timestamp("ts").alias("t"), "id", (F.col("status_code") >= 500).alias("failed"))
    ends = state.fold(rows, "provider", ["failed"], state.breaker(window=86400, recovery=3600), "string")
    day = F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd")
    last = rows.join(ends, "id").groupBy(F.concat_ws(" ", "provider", day).alias("provider")).agg(F.max_by("out", F.struct("t", "id")).alias("state"), F.count_if("failed").alias("failures"))
    return suggest.broken_providers(last)

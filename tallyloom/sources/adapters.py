"""Request log, audit rows and sessions as views over the event, document and conversation tables.

Each view is a list of SQL expressions that Spark and other SQL engines read alike, so one definition feeds the
operators and the SQL that checks them. ``now`` never enters: every window is a parameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_K = "CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT)"

#: One row for each request, seconds precision, with local routes that are also 403, empty keys and clipped caches.
REQUEST_LOG: dict[str, str] = {
    "id": "event_id",
    "ts": "date_trunc('second', ts)",
    "req_id": "CAST(event_id AS varchar(32))",
    "client_ip": "CASE WHEN event_id % 97 = 0 THEN '' ELSE concat('10.0.', CAST(user_id % 4 AS varchar(10)), '.', CAST(user_id % 50 AS varchar(10))) END",
    "key_id": "user_id % 20 + 1",
    "key_name": "CASE WHEN user_id % 7 = 0 THEN '' ELSE concat('key', CAST(user_id % 20 AS varchar(10))) END",
    "provider": "CASE event_id % 5 WHEN 0 THEN 'external' WHEN 1 THEN 'external' WHEN 2 THEN 'local' WHEN 3 THEN 'external' ELSE '' END",
    "model": "CASE event_id % 5 WHEN 0 THEN 'fast' WHEN 1 THEN 'external/pro' WHEN 2 THEN 'base' WHEN 3 THEN 'Auto-AB' ELSE '' END",
    "action": "CASE event_type WHEN 'error' THEN 'block' WHEN 'signup' THEN 'route_local' ELSE 'allow' END",
    "status_code": "CASE WHEN event_id % 41 = 0 THEN 403 WHEN event_id % 23 = 0 THEN 500 WHEN event_id % 31 = 0 THEN 429 ELSE 200 END",
    "blocked_reason": "CASE event_type WHEN 'error' THEN concat('l1:rule', CAST(event_id % 6 AS varchar(10))) WHEN 'signup' THEN 'l2:last_user' ELSE '' END",
    "duration_ms": "CASE WHEN event_id % 9 <> 0 THEN CAST(floor(value * 10) AS BIGINT) ELSE 0 END",
    "gateway_internal_ms": "CASE WHEN event_id % 9 <> 0 THEN CAST(floor(value) AS BIGINT) ELSE 0 END",
    "prompt_tokens": "CAST(floor(value) AS BIGINT)",
    "completion_tokens": _K,
    "cached_tokens": f"{_K} * 3",
    "cache_creation_tokens": "event_id % 11",
}

#: One row for each decision; half of them carry the judgement of a second classifier and its shadow.
AUDIT: dict[str, str] = {
    "id": "event_id",
    "ts": "date_trunc('second', ts)",
    "req_id": "CAST(event_id AS varchar(32))",
    "type": "CASE WHEN event_id % 10 = 0 THEN 'file' ELSE 'prompt' END",
    "action": REQUEST_LOG["action"],
    "rule": "CASE WHEN event_id % 53 = 0 THEN 'egress_denied' WHEN event_type = 'error' THEN concat('rule', CAST(event_id % 6 AS varchar(10))) WHEN event_type = 'signup' THEN 'l2_confidential' WHEN event_id % 29 = 0 THEN '' ELSE 'default_allow' END",
    "provider": REQUEST_LOG["provider"],
    "model": REQUEST_LOG["model"],
    "local_flag": "event_type = 'signup'",
    "client_ip": REQUEST_LOG["client_ip"],
    "token_masked": "concat('key***', CAST(user_id % 20 AS varchar(10)))",
    "filename": "CASE WHEN event_id % 10 = 0 THEN concat('file', CAST(event_id % 7 AS varchar(10)), '.csv') ELSE '' END",
    "status_code": "CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 41 = 0 THEN 403 WHEN event_id % 23 = 0 THEN 500 ELSE 200 END",
    "risk_score": "event_id % 100",
    "doc_id": "event_id % 150",
    "l2_label": "CASE WHEN event_id % 2 <> 0 THEN NULL WHEN event_id % 6 = 0 THEN 'CONFIDENTIAL' ELSE 'NORMAL' END",
    "l2_confidence": "CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 100 AS DOUBLE) / 100 END",
    "l2_degraded": "event_id % 26 = 0",
    "l2_latency_ms": "CASE WHEN event_id % 2 = 0 THEN 100 + event_id % 300 END",
    "shadow_label": "CASE WHEN event_id % 2 <> 0 OR event_id % 14 = 0 THEN NULL WHEN event_id % 10 = 0 THEN 'CONFIDENTIAL' ELSE 'NORMAL' END",
    "shadow_degraded": "event_id % 28 = 0",
    "text_preview": "concat('asked ', props)",
    "requested_model": "CASE WHEN event_id % 8 = 0 THEN 'Auto-AB' ELSE '' END",
    "key_name": REQUEST_LOG["key_name"],
    "session_id": "concat('s-', CAST(user_id AS varchar(20)))",
}

#: Small dimensions, written as rows of SQL literals.
KEYS = "SELECT CAST(id AS BIGINT) AS key_id, CASE WHEN id % 6 = 0 THEN '' ELSE concat('name', CAST(id AS varchar(10))) END AS name, concat('tk-0000-', CAST(id AS varchar(10)), '-abcd') AS key_value FROM (VALUES (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12), (13), (14), (15)) AS t(id)"
KEY_RULES = "SELECT kind, key_name FROM (VALUES ('black', 'key3'), ('white', 'key4'), ('white', 'key5'), ('white', 'key99'), ('middle', 'key3'), ('middle', 'key6')) AS t(kind, key_name)"
ALIASES = "SELECT alias, provider AS head_provider, model AS head_model, CAST(priority AS BIGINT) AS priority, enabled FROM (VALUES ('auto-ab', 'external', 'pro', 2, true), ('auto-ab', 'external', 'old', 1, false), ('auto-ab', 'local', 'base', 3, true), ('off', 'local', 'base', 1, false)) AS t(alias, provider, model, priority, enabled)"
PRICES = "SELECT label, price_in, price_out, price_cached FROM (VALUES ('external/fast', 1e0, 2e0, 0e0), ('external/pro', 4e0, 8e0, 5e-1)) AS t(label, price_in, price_out, price_cached)"

DIMENSIONS = {"keys": KEYS, "key_rules": KEY_RULES, "aliases": ALIASES, "prices": PRICES}
_EVENTS = {"request_log": REQUEST_LOG, "audit": AUDIT}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture table, an adapter view or a dimension by name."""
    if name in DIMENSIONS:
        return spark.sql(DIMENSIONS[name])
    if name in _EVENTS:
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        return events.selectExpr(*(f"{sql} AS {column}" for column, sql in _EVENTS[name].items()))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_views(*names: str) -> str:
    """The same views as the head of a SQL query: WITH a AS (...), b AS (...)."""
    parts = []
    for name in names:
        if name in DIMENSIONS:
            parts.append(f"{name} AS ({DIMENSIONS[name]})")
        else:
            columns = ", ".join(f"{sql} AS {column}" for column, sql in _EVENTS[name].items())
            parts.append(f"{name} AS (SELECT {columns} FROM events)")
    return "WITH " + ", ".join(parts)

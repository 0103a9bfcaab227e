"""Decision rows: search, pages, indicators, agreement, rule hits, as-of joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scope
from ..operators import audit
from .registry import query

AU = ("audit",)
_INFER = "CASE WHEN starts_with(lower(action), 'block') OR rule = 'egress_denied' THEN 403 WHEN lower(action) = 'route_local' AND strpos(rule, 'fallback') > 0 THEN 502 WHEN lower(action) IN ('allow', 'route_local') THEN 200 ELSE 0 END"
_STATUS = f"CASE WHEN status_code > 0 THEN status_code ELSE {_INFER} END"
_CLASS = "CASE WHEN {0} IS NULL OR {0} = 0 THEN 'unknown' WHEN {0} // 100 BETWEEN 1 AND 5 THEN concat(CAST({0} // 100 AS VARCHAR), 'xx') ELSE 'other' END"
_BLOCK = f"(starts_with(lower(action), 'block') OR ({_INFER}) = 403)"
_MISMATCH = "(coalesce(shadow_label IN ('CONFIDENTIAL', 'NORMAL'), false) AND NOT l2_degraded AND l2_label IS DISTINCT FROM shadow_label)"
_N = "count(*) FILTER ({0})".format


@query("scan_audit_window", "SELECT id FROM audit WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00' AND action = 'block' ORDER BY ts DESC, id DESC LIMIT 500", AU)
def _(t):
    return audit.scan(t("audit"), "2024-01-05 00:00:00", "2024-01-20 00:00:00", 500, action="block").select("id")


@query("scan_audit_hot_tail", "SELECT id, action FROM audit ORDER BY ts DESC, id DESC LIMIT 1000", AU)
def _(t):
    return audit.scan(t("audit"), limit=1000).select("id", "action")


@query("infer_status", f"SELECT {_INFER} AS status, count(*) AS n FROM audit GROUP BY 1", AU)
def _(t):
    return t("audit").groupBy(scope.infer_status(F.col("action"), F.col("rule")).alias("status")).agg(F.count("*").alias("n"))


@query("entry_status", f"SELECT {_STATUS} AS status, count(*) AS n FROM audit GROUP BY 1", AU)
def _(t):
    return t("audit").groupBy(audit.status().alias("status")).agg(F.count("*").alias("n"))


@query("entry_blocked", f"SELECT rule, {_BLOCK} AS blocked, count(*) AS n FROM audit GROUP BY 1, 2", AU)
def _(t):
    return t("audit").groupBy("rule", scope.entry_blocked(F.col("action"), F.col("rule")).alias("blocked")).agg(F.count("*").alias("n"))


@query("status_class", f"SELECT {_CLASS.format('status_code')} AS class, count(*) AS n FROM audit GROUP BY 1", AU)
def _(t):
    return t("audit").groupBy(scope.status_class(F.col("status_code")).alias("class")).agg(F.count("*").alias("n"))


@query("resolve_action", "SELECT CASE WHEN coalesce(status_code, 0) = 403 THEN 'block' WHEN trim(blocked_reason) <> '' THEN 'route_local' ELSE 'allow' END AS resolved, count(*) AS n FROM request_log GROUP BY 1", ("request_log",))
def _(t):
    return t("request_log").groupBy(scope.resolve_action(F.col("status_code"), F.col("blocked_reason")).alias("resolved")).agg(F.count("*").alias("n"))


@query("predicates", "SELECT starts_with(action, 'block') OR status_code = 403 AS blocked, action = 'route_local' AS local, starts_with(action, 'block') OR status_code = 403 OR action = 'route_local' AS abnormal, count(*) AS n FROM request_log GROUP BY ALL", ("request_log",))
def _(t):
    a, s = F.col("action"), F.col("status_code")
    return t("request_log").groupBy(scope.is_blocked(a, s).alias("blocked"), scope.is_local_route(a).alias("local"), scope.is_abnormal(a, s).alias("abnormal")).agg(F.count("*").alias("n"))


@query("to_beijing", "SELECT id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS shown FROM audit WHERE id % 5 <> 0 UNION ALL SELECT id, 'soon' FROM audit WHERE id % 5 = 0", AU)
def _(t):
    raw = F.when(F.col("id") % 5 == 0, "soon").otherwise(scope.stamp(F.col("ts")))
    return t("audit").select("id", scope.display_time(raw).alias("shown"))


@query("mask_key", "SELECT key_value, CASE WHEN length(key_value) <= 8 THEN '***' ELSE concat(left(key_value, 3), '***', right(key_value, 4)) END AS masked, users FROM (SELECT concat('k-', CAST(user_id * 7919 AS VARCHAR)) AS key_value, count(*) AS users FROM events GROUP BY 1)")
def _(t):
    """Keys made from the users of events, short and long ones."""
    keys = t("events").groupBy(F.concat(F.lit("k-"), (F.col("user_id") * 7919).cast("string")).alias("key_value")).agg(F.count("*").alias("users"))
    return keys.select("key_value", scope.mask_key(F.col("key_value")).alias("masked"), "users")


@query("logs_filter_page", "SELECT id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS shown FROM request_log WHERE action = 'block' AND provider = 'external' ORDER BY ts DESC, id DESC LIMIT 100 OFFSET 50", ("request_log",))
def _(t):
    rows = t("request_log").where("action = 'block' AND provider = 'external'")
    return rows.orderBy(F.desc("ts"), F.desc("id")).offset(50).limit(100).select("id", scope.stamp(scope.local_time(F.col("ts"))).alias("shown"))


_FACETS = ("client_ip", "key_name", "model", "action", "provider")


@query("logs_facets", " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS facet, {c} AS value FROM request_log WHERE {c} <> ''" for c in _FACETS), ("request_log",))
def _(t):
    log = t("request_log")
    pairs = F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in _FACETS))
    return log.select(F.explode(pairs).alias("x")).select("x.facet", "x.value").where("value <> ''").distinct()


@query("audit_filter", f"SELECT id FROM audit WHERE strpos(client_ip, '10.0.1') > 0 AND strpos(lower(token_masked), 'key') > 0 AND provider = 'external' AND {_CLASS.format('s')} = '4xx'".replace("FROM audit", f"FROM (SELECT *, {_STATUS} AS s FROM audit)"), AU)
def _(t):
    return audit.search(t("audit"), ip="10.0.1", token="KEY", provider="external", status_text="4xx").select("id")


# JSON of the judgement as Spark writes it: fields that are null are left out.
_JUDGED = "concat('{', array_to_string(list_filter([CASE WHEN l2_label IS NOT NULL THEN concat('\"l2_label\":\"', l2_label, '\"') END, CASE WHEN l2_confidence IS NOT NULL THEN concat('\"l2_confidence\":', CAST(l2_confidence AS VARCHAR)) END, concat('\"l2_degraded\":', CAST(l2_degraded AS VARCHAR)), CASE WHEN shadow_label IS NOT NULL THEN concat('\"shadow_label\":\"', shadow_label, '\"') END, concat('\"shadow_degraded\":', CAST(shadow_degraded AS VARCHAR))], lambda x: x IS NOT NULL), ','), '}')"
_ANY = lambda word: " OR ".join(f"coalesce(strpos(lower({c}), '{word}') > 0, false)" for c in (*audit.SEARCHED, _JUDGED))


@query(
    "audit_fulltext_q",
    f"SELECT 'local' AS q, id FROM audit WHERE {_ANY('local')} OR local_flag UNION ALL SELECT '外发', id FROM audit WHERE {_ANY('外发')} OR NOT local_flag UNION ALL SELECT '判密', id FROM audit WHERE {_ANY('判密')} OR rule = 'l2_confidential' "
    f"UNION ALL SELECT 'Degraded\":True', id FROM audit WHERE {_ANY('degraded\":true')} UNION ALL SELECT 's-7', id FROM audit WHERE {_ANY('s-7')}",
    AU,
)
def _(t):
    """By columns, by the route, by a rule's display name, and by the judgement's JSON."""
    found = None
    for q in ("local", "外发", "判密", 'Degraded":True', "s-7"):
        rows = audit.search(t("audit"), q=q).select(F.lit(q).alias("q"), "id")
        found = rows if found is None else found.unionByName(rows)
    return found


@query("pred_shadow_mismatch", f"SELECT id FROM audit WHERE {_MISMATCH}", AU)
def _(t):
    return audit.search(t("audit"), mismatch=True).select("id")


@query("audit_sort_page", "SELECT id, rule FROM audit ORDER BY rule DESC, ts DESC, id DESC LIMIT 50 OFFSET 100", AU)
def _(t):
    return audit.page(t("audit"), "rule", 2).select("id", "rule")


@query("audit_probe_class", "SELECT CASE WHEN l2_label IS NULL THEN 'none' WHEN l2_degraded THEN 'degraded' WHEN l2_label = shadow_label THEN 'agree' ELSE 'disagree' END AS class, count(*) AS n FROM audit GROUP BY 1", AU)
def _(t):
    c = F.when(F.col("l2_label").isNull(), "none").when(F.col("l2_degraded"), "degraded").when(F.col("l2_label") == F.col("shadow_label"), "agree").otherwise("disagree")
    return t("audit").groupBy(c.alias("class")).agg(F.count("*").alias("n"))


@query("audit_count_kpi", f"SELECT count(*) AS total, {_N("action = 'allow'")} AS allow, {_N("action = 'route_local'")} AS route_local, {_N("starts_with(action, 'block') OR rule = 'egress_denied'")} AS block FROM audit", AU)
def _(t):
    return audit.count_kpi(t("audit"))


@query("audit_window_kpi", f"SELECT *, total - allow - route_local - block AS other FROM (SELECT count(*) AS total, {_N("action = 'allow'")} AS allow, {_N("action = 'route_local'")} AS route_local, {_N(_BLOCK)} AS block FROM audit)", AU)
def _(t):
    return audit.window_kpi(t("audit"))


@query("join_usage_by_req", "SELECT id, prompt_tokens, completion_tokens, duration_ms FROM (SELECT id, req_id FROM audit ORDER BY ts DESC, id DESC LIMIT 50) LEFT JOIN (SELECT req_id, prompt_tokens, completion_tokens, duration_ms FROM request_log WHERE id % 3 <> 0) USING (req_id)", ("audit", "request_log"))
def _(t):
    return audit.with_usage(audit.page(t("audit"), "time", 0), t("request_log").where("id % 3 <> 0")).select("id", "prompt_tokens", "completion_tokens", "duration_ms")


@query(
    "sink_csv_export",
    "SELECT strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS time, "
    + ", ".join(f"CASE WHEN regexp_matches({c}, '^[=+\\-@]') THEN concat('''', {c}) ELSE {c} END AS {c}" for c in ("req_id", "type", "action", "rule", "provider", "model", "client_ip", "token_masked", "filename"))
    + f", {_STATUS} AS status FROM (SELECT * REPLACE (CASE WHEN id % 7 = 0 THEN concat('=', rule) ELSE rule END AS rule) FROM audit)",
    AU,
)
def _(t):
    rows = t("audit").withColumn("rule", F.when(F.col("id") % 7 == 0, F.concat(F.lit("="), F.col("rule"))).otherwise(F.col("rule")))
    return audit.csv_export(rows)


@query("sink_prometheus", "SELECT concat('requests_total{provider=\"', provider, '\",action=\"', action, '\",status=\"', status, '\"} ', CAST(n AS VARCHAR)) AS line FROM (SELECT provider, action, " + _CLASS.format("status_code") + " AS status, count(*) AS n FROM request_log GROUP BY ALL)", ("request_log",))
def _(t):
    counts = t("request_log").groupBy("provider", "action", scope.status_class(F.col("status_code")).alias("status")).agg(F.count("*").alias("n"))
    return audit.prometheus_lines(counts)


_TOP = lambda c: f"(SELECT '{c}', {c}, count(*) FROM audit WHERE {c} <> '' GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)"


@query("export_panel", f"SELECT 'action' AS panel, action AS item, count(*) AS n FROM audit GROUP BY 2 UNION ALL SELECT 'type', type, count(*) FROM audit GROUP BY 2 UNION ALL SELECT 'class', {_CLASS.format('status_code')}, count(*) FROM audit GROUP BY 2 UNION ALL {_TOP('rule')} UNION ALL {_TOP('provider')} UNION ALL {_TOP('model')}", AU)
def _(t):
    return audit.panel(t("audit"))


@query(
    "prometheus_summary",
    """WITH x AS (SELECT l2_label AS l, quantile_disc(l2_latency_ms, [0.5, 0.95, 0.99]) AS q, sum(l2_latency_ms) AS s, count(*) AS n FROM audit WHERE l2_label IS NOT NULL AND l2_latency_ms IS NOT NULL GROUP BY 1)
    SELECT concat('l2_ms{l2_label="', l, '",quantile="', ['0.5', '0.95', '0.99'][i], '"} ', CAST(q[i] AS VARCHAR)) AS line FROM x, range(1, 4) AS t(i) UNION ALL SELECT concat('l2_ms_sum{l2_label="', l, '"} ', CAST(s AS VARCHAR)) FROM x UNION ALL SELECT concat('l2_ms_count{l2_label="', l, '"} ', CAST(n AS VARCHAR)) FROM x""",
    AU,
)
def _(t):
    return audit.prometheus_summary(t("audit").where("l2_label IS NOT NULL"), "l2_ms", "l2_latency_ms", "l2_label")


@query("rule_hits", "SELECT rule, CAST(sum(n) AS BIGINT) AS count, string_agg(concat(action, '=', CAST(n AS VARCHAR)), ',' ORDER BY action, n) AS actions, strftime(max(last), '%Y-%m-%d %H:%M:%S') AS last_seen FROM (SELECT rule, action, count(*) AS n, max(ts) AS last FROM audit WHERE rule NOT IN ('', 'bypass', 'default_allow') GROUP BY 1, 2) GROUP BY 1", AU)
def _(t):
    return audit.rule_hits(t("audit"))


_SH = "(l2_label IS NOT NULL AND coalesce(shadow_label IN ('CONFIDENTIAL', 'NORMAL'), false))"


@query(
    "shadow_stats",
    f"""SELECT *, CAST(agree / compared AS DOUBLE) AS agree_rate FROM (SELECT {_N('l2_label IS NOT NULL')} AS l2_total, {_N(_SH)} AS shadowed, {_N(f'l2_label IS NOT NULL AND NOT {_SH} AND shadow_degraded')} AS shadow_degraded,
    {_N(f"{_SH} AND l2_label = 'CONFIDENTIAL' AND shadow_label = 'CONFIDENTIAL'")} AS cc, {_N(f"{_SH} AND l2_label = 'CONFIDENTIAL' AND shadow_label <> 'CONFIDENTIAL'")} AS cn,
    {_N(f"{_SH} AND l2_label <> 'CONFIDENTIAL' AND shadow_label = 'CONFIDENTIAL'")} AS nc, {_N(f"{_SH} AND l2_label <> 'CONFIDENTIAL' AND shadow_label <> 'CONFIDENTIAL'")} AS nn,
    {_N(f'{_SH} AND l2_degraded')} AS main_degraded, {_N(f'{_SH} AND NOT l2_degraded')} AS compared, {_N(f'{_SH} AND NOT l2_degraded AND l2_label = shadow_label')} AS agree,
    CAST(sum(l2_latency_ms) FILTER ({_SH}) AS BIGINT) AS latency_sum FROM audit)""",
    AU,
)
def _(t):
    return audit.shadow_stats(t("audit"))


_DIV = f"d AS (SELECT *, CASE WHEN l2_label = 'NORMAL' THEN 'nc' ELSE 'cn' END AS cell FROM audit WHERE l2_label IN ('CONFIDENTIAL', 'NORMAL') AND {_MISMATCH})"


@query("divergence_rows", f"WITH {_DIV} SELECT id, cell FROM d", AU)
def _(t):
    return audit.divergences(t("audit")).select("id", "cell")


_COLLAPSED = f"""{_DIV}, x AS (SELECT d.id, d.ts, cell, filename, text, CASE WHEN d.id % 4 = 0 THEN NULL ELSE toxic END AS label FROM d LEFT JOIN documents USING (doc_id) LEFT JOIN labels USING (doc_id)),
g AS (SELECT sha1(concat_ws('|', trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), filename)) AS "group", * FROM x)
SELECT "group", arg_max(id, struct_pack(t := ts, i := id)) AS id, arg_max(cell, struct_pack(t := ts, i := id)) AS cell, count(*) AS dup, arg_max(label, struct_pack(t := ts, i := id)) FILTER (label IS NOT NULL) AS label FROM g GROUP BY 1"""


def _labelled(t):
    rows = audit.divergences(t("audit")).join(t("documents").select("doc_id", "text"), "doc_id", "left").join(t("labels").select("doc_id", "toxic"), "doc_id", "left")
    return rows.withColumn("label", F.when(F.col("id") % 4 == 0, F.lit(None)).otherwise(F.col("toxic")))


@query("dedup_collapse_latest", f"WITH {_COLLAPSED}", AU)
def _(t):
    return audit.collapsed(_labelled(t))


@query("join_label", f"WITH {_COLLAPSED.replace('SELECT \"group\", arg_max(id', 'SELECT label, count(*) AS texts FROM (SELECT \"group\", arg_max(id')}) GROUP BY 1", AU)
def _(t):
    return audit.collapsed(_labelled(t)).groupBy("label").agg(F.count("*").alias("texts"))


_KEPT = "TIMESTAMP '2024-01-10 12:00:00'"


@query(
    "stored_labels",
    f"""WITH {_DIV}, x AS (SELECT d.id, d.ts, concat_ws('|', trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), filename) AS k FROM d LEFT JOIN documents USING (doc_id)),
    p AS (SELECT arg_min(k, id) AS one, arg_max(k, id) AS two FROM x)
    SELECT strftime(ts, '%Y-%m-%d') AS day, CASE WHEN k = two THEN 'normal' WHEN k = one THEN 'secret' END AS label, count(*) AS n FROM x, p WHERE ts >= {_KEPT} GROUP BY 1, 2""",
    AU,
)
def _(t):
    """Rows are stored, two texts are labelled with all rows that share them, old rows are purged; what the table then holds."""
    from ..sources import sinks
    from ..streaming.metrics import scratch

    rows = audit.divergences(t("audit")).join(t("documents").select("doc_id", "text"), "doc_id", "left").select("id", "ts", "req_id", audit.group_key().alias("group"), F.lit(None).cast("string").alias("label"))
    spark = rows.sparkSession
    path = scratch(spark, "labels")
    sinks.append(rows, path)
    ends = spark.read.parquet(path).agg(F.min_by("req_id", "id").alias("one"), F.max_by("req_id", "id").alias("two")).first()
    sinks.label_group(spark, path, "req_id", ends["one"], "group", "secret")
    sinks.label_group(spark, path, "req_id", ends["two"], "group", "normal")
    sinks.purge_stored(spark, path, "2024-01-10 12:00:00")
    return spark.read.parquet(path).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "label").agg(F.count("*").alias("n"))


@query("sink_jsonl_export", f"WITH {_DIV} SELECT concat('{{\"id\":', CAST(id AS VARCHAR), ',\"cell\":\"', cell, '\",\"rule\":\"', rule, '\"}}') AS line FROM d", AU)
def _(t):
    return audit.divergences(t("audit")).select(F.to_json(F.struct("id", "cell", "rule")).alias("line"))


@query(
    "events_hourly",
    f"""WITH b AS (SELECT date_trunc('hour', ts) AS hour, {_N(_BLOCK)} AS blocked, {_N('l2_degraded')} AS degraded, {_N("action = 'route_local'")} AS local FROM audit GROUP BY 1),
    c AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-08 12:00:00', TIMESTAMP '2024-01-10 12:00:00', INTERVAL 1 HOUR)) AS hour)
    SELECT strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, coalesce(blocked, 0) AS blocked, coalesce(degraded, 0) AS degraded, coalesce(local, 0) AS local FROM c LEFT JOIN b USING (hour)""",
    AU,
)
def _(t):
    return audit.hourly_events(t("audit"), "2024-01-10 12:34:56", 48)


_ROUNDS = "(VALUES (1, TIMESTAMP '2024-01-02 00:00:00', TIMESTAMP '2024-01-09 00:00:00'), (2, TIMESTAMP '2024-01-08 00:00:00', TIMESTAMP '2024-01-20 00:00:00'), (3, TIMESTAMP '2023-01-08 00:00:00', TIMESTAMP '2023-01-20 00:00:00')) AS r(round, started, finished)"


@query("interval_round", f"SELECT round, count(*) AS compared, {_N('l2_label = shadow_label')} AS agree FROM audit JOIN {_ROUNDS} ON ts BETWEEN started AND finished WHERE l2_label IS NOT NULL AND shadow_label IS NOT NULL AND NOT l2_degraded GROUP BY 1", AU)
def _(t):
    rows = t("audit")
    return audit.rounds(rows, rows.sparkSession.sql(f"SELECT * FROM {_ROUNDS}"))


@query(
    "asof_sticky_session",
    """WITH m AS (SELECT client_ip, id, ts, last_value(CASE WHEN action = 'route_local' THEN epoch(ts) END IGNORE NULLS) OVER (PARTITION BY client_ip ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m_at FROM audit WHERE client_ip <> '')
    SELECT id, coalesce(epoch(ts) - m_at <= 86400, false) AS sticky FROM m""",
    AU,
)
def _(t):
    return audit.asof_sticky(t("audit").where("client_ip <> ''"), F.col("action") == "route_local", 86400, "client_ip").select("id", "sticky")


# A version of the policy for each day: the rules that decided that day, with what they did.
_SNAPSHOTS = "SELECT strftime(ts, '%Y-%m-%d') AS version, rule AS name, CAST(count(*) % 3 AS BIGINT) AS priority, max(action) AS action, min(provider) AS body FROM audit WHERE rule <> '' AND id % 4 = 0 GROUP BY 1, 2"
_LIVE = "SELECT rule AS name, CAST(count(*) % 3 AS BIGINT) AS priority, max(action) AS action, min(provider) AS body FROM audit WHERE rule <> '' AND id % 4 = 1 GROUP BY 1"


def _versions(t):
    rows = t("audit").where("rule <> ''").withColumn("version", F.date_format("ts", "yyyy-MM-dd")).withColumnRenamed("rule", "name")
    made = ((F.count("*") % 3).alias("priority"), F.max("action").alias("action"), F.min("provider").alias("body"))
    return rows.where("id % 4 = 0").groupBy("version", "name").agg(*made), rows.where("id % 4 = 1").groupBy("name").agg(*made)


_KINDS = """SELECT name, unnest(CASE WHEN a IS NULL THEN ['added'] WHEN b IS NULL THEN ['removed'] ELSE list_filter([CASE WHEN a.priority <> b.priority THEN 'priority' END, CASE WHEN a.action <> b.action OR a.body <> b.body THEN 'changed' END], lambda x: x IS NOT NULL) END) AS change"""


@query("outer_policy_diff", f"WITH s AS ({_SNAPSHOTS}), a AS (SELECT name, struct_pack(priority, action, body) AS a FROM s WHERE version = '2024-01-03'), b AS (SELECT name, struct_pack(priority, action, body) AS b FROM s WHERE version = '2024-01-20') {_KINDS} FROM a FULL JOIN b USING (name)", AU)
def _(t):
    """The policies of two days."""
    snapshots, _live = _versions(t)
    return audit.policy_diff(snapshots.where("version = '2024-01-03'"), snapshots.where("version = '2024-01-20'"))


_STEPS = f"s AS MATERIALIZED ({_SNAPSHOTS}), v AS (SELECT version, row_number() OVER (ORDER BY version) AS step FROM (SELECT DISTINCT version FROM s)), r AS MATERIALIZED (SELECT step, name, struct_pack(priority, action, body) AS rule FROM s JOIN v USING (version) UNION ALL SELECT (SELECT count(*) FROM v) + 1, name, struct_pack(priority, action, body) FROM ({_LIVE}))"


@query("policy_version_changes", f"WITH {_STEPS}, p AS (SELECT v.version, coalesce(x.name, y.name) AS name, x.rule AS a, y.rule AS b FROM v JOIN (SELECT DISTINCT name FROM r) n ON true LEFT JOIN r x ON x.step = v.step AND x.name = n.name LEFT JOIN r y ON y.step = v.step + 1 AND y.name = n.name WHERE x.name IS NOT NULL OR y.name IS NOT NULL) {_KINDS.replace('SELECT name', 'SELECT version, name')} FROM p", AU)
def _(t):
    """Every version with the next newer one, the newest with the live rules."""
    return audit.policy_changes(*_versions(t))


@query(
    "policy_intervals",
    f"""WITH {_STEPS}, g AS (SELECT *, sum(CASE WHEN b.rule IS NULL OR b.rule <> a.rule THEN 1 ELSE 0 END) OVER (PARTITION BY a.name ORDER BY a.step) AS run FROM (SELECT a.step, a.name, a.rule FROM r a) a LEFT JOIN (SELECT step + 1 AS step, name, rule FROM r) b USING (step, name))
    SELECT name, any_value(rule.priority) AS priority, any_value(rule.action) AS action, any_value(rule.body) AS body, min(version) AS first, CASE WHEN max(step) <= (SELECT count(*) FROM v) THEN max(version) END AS last
    FROM (SELECT g.step, g.name, g.run, r.rule, v.version FROM g JOIN r USING (step, name) LEFT JOIN v USING (step)) GROUP BY name, run""",
    AU,
)
def _(t):
    """From when to when each rule was in force as it was."""
    return audit.policy_intervals(*_versions(t))


_EDGES = "[" + ", ".join(map(str, audit.LATENCY_EDGES)) + "]"


@query(
    "prometheus_histogram",
    f"""WITH x AS (SELECT l2_label AS l, l2_latency_ms AS v FROM audit WHERE l2_label IS NOT NULL AND l2_latency_ms IS NOT NULL)
    SELECT concat('l2_latency_ms_bucket{{label="', l, '",le="', CAST(e AS VARCHAR), '"}} ', CAST(count(*) FILTER (v <= e) AS VARCHAR)) AS line FROM x, (SELECT unnest({_EDGES}) AS e) GROUP BY l, e
    UNION ALL SELECT concat('l2_latency_ms_bucket{{label="', l, '",le="+Inf"}} ', CAST(count(*) AS VARCHAR)) FROM x GROUP BY l
    UNION ALL SELECT concat('l2_latency_ms_sum{{label="', l, '"}} ', CAST(sum(v) AS VARCHAR)) FROM x GROUP BY l
    UNION ALL SELECT concat('l2_latency_ms_count{{label="', l, '"}} ', CAST(count(*) AS VARCHAR)) FROM x GROUP BY l""",
    AU,
)
def _(t):
    return audit.prometheus_histogram(t("audit"))

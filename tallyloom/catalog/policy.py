"""Decisions by compiled rules, second-classifier overrides, routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scope
from ..plans import policy
from .registry import query

RULES = [
    policy.Rule("deny_egress", "block", {"egress.allowed == false": False}, 1),
    policy.Rule("night", "route_local", {"any": [{"hour >=": 22}, {"hour <": 6}]}, 30),
    policy.Rule("cad", "route_local", {"file.ext in": ["dwg", "csv"]}, 20),
    policy.Rule("risky", "route_local", {"all": [{"risk >=": 60}, {"provider not_in": "local"}]}, 10),
    policy.Rule("secret_name", "block", {"file.filename contains_any": ["file3", "secret"]}, 15),
    policy.Rule("pattern", "block", {"rule matches_regex": "^rule[01]$"}, 12),
    policy.Rule("none_needle", "block", {"absent contains_any": ["none"]}, 90),
    policy.Rule("default_allow", "allow", "always", 100),
]


def _field(name: str):
    return {
        "egress.allowed": F.col("rule") != "egress_denied", "hour": F.hour("ts"), "file.ext": F.when(F.col("filename") != "", F.substring_index("filename", ".", -1)),
        "file.filename": F.col("filename"), "risk": F.col("risk_score"), "provider": F.col("provider"), "rule": F.col("rule"),
    }.get(name)


_WHEN = {
    "deny_egress": "rule = 'egress_denied'", "risky": "risk_score >= 60 AND provider <> 'local'", "pattern": "rule IN ('rule0', 'rule1')", "secret_name": "strpos(filename, 'file3') > 0",
    "cad": "filename <> ''", "night": "hour(ts) >= 22 OR hour(ts) < 6", "none_needle": "true",
}
_ACTION = {r.name: r.action for r in RULES}
_RULE = "CASE " + " ".join(f"WHEN {w} THEN '{n}'" for n, w in _WHEN.items()) + " END"
_ACT = "CASE " + " ".join(f"WHEN {w} THEN '{_ACTION[n]}'" for n, w in _WHEN.items()) + " END"


def _decided(t):
    return t("audit").withColumn("d", policy.decide(RULES, _field))


@query("decide_first_match", f"SELECT id, {_RULE} AS rule, {_ACT} AS action FROM audit", ("audit",))
def _(t):
    return _decided(t).select("id", "d.rule", "d.action")


def _op_query(name: str, cond: dict, sql: str) -> None:
    @query(f"policy_op_{name}", f"SELECT id FROM audit WHERE {sql}", ("audit",))
    def _(t):
        return t("audit").where(policy.matches(cond, _field)).select("id")


for _name, _cond, _sql in (
    ("ne", {"provider != local": "local"}, "provider IS DISTINCT FROM 'local'"),
    ("not_in", {"provider not_in": " Local , external"}, "provider NOT IN ('local', 'external')"),
    ("eq", {"provider == anything": "external"}, "provider = 'external'"),
    ("in", {"rule in": ["rule1", "l2_"]}, "strpos(rule, 'rule1') > 0 OR strpos(rule, 'l2_') > 0"),
    ("contains_any", {"rule contains_any": ["RULE", "egress"]}, "strpos(rule, 'rule') > 0 OR strpos(rule, 'egress') > 0"),
    ("matches_regex", {"rule matches_regex": "rule[24]"}, "regexp_matches(rule, 'rule[24]')"),
    ("ge", {"risk >=": "60"}, "risk_score >= 60"),
    ("le", {"risk <=": 10}, "risk_score <= 10"),
    ("gt", {"risk >": 60}, "risk_score > 60"),
    ("lt", {"risk <": "10"}, "risk_score < 10"),
):
    _op_query(_name, _cond, _sql)


@query("dry_run", f"SELECT a.action AS was, {_ACT} AS action, {_RULE} AS rule, count(*) AS n FROM (SELECT action, id, TIMESTAMP '2024-01-01 12:00:00' AS ts, rule, filename, risk_score, 'local' AS provider FROM audit) a GROUP BY ALL", ("audit",))
def _(t):
    """What the rules would do with the recorded requests at noon on the local provider, beside what was done."""
    rows = t("audit").withColumn("ts", F.lit("2024-01-01 12:00:00").cast("timestamp")).withColumn("provider", F.lit("local"))
    tried = rows.select(F.col("action").alias("was"), policy.decide(RULES, _field).alias("d"))
    return tried.groupBy("was", "d.action", "d.rule").agg(F.count("*").alias("n"))


@query("block_to_fallback", f"SELECT action, count(*) AS n FROM (SELECT CASE WHEN a = 'block' AND id % 2 = 0 THEN 'route_local' ELSE a END AS action FROM (SELECT id, {_ACT} AS a FROM audit)) GROUP BY 1", ("audit",))
def _(t):
    reject = F.col("id") % 2 != 0
    action = F.when((F.col("d.action") == "block") & ~reject, "route_local").otherwise(F.col("d.action"))
    return _decided(t).groupBy(action.alias("action")).agg(F.count("*").alias("n"))


@query("l2_decision", "SELECT CASE WHEN l2_label = 'CONFIDENTIAL' AND l2_confidence >= 0.7 THEN 'l2_confidential' WHEN id % 97 = 0 THEN 'l2_injection' WHEN l2_degraded THEN 'l2_unavailable' ELSE rule END AS decided, count(*) AS n FROM audit GROUP BY 1", ("audit",))
def _(t):
    c = policy.l2_decision(F.col("rule"), F.col("l2_label"), F.col("l2_confidence"), F.col("id") % 97 == 0, F.col("l2_degraded"))
    return t("audit").groupBy(c.alias("decided")).agg(F.count("*").alias("n"))


@query(
    "review_pipeline",
    f"""WITH s AS (SELECT *, {_RULE} AS r, {_ACT} AS a FROM audit), g AS (SELECT *, a = 'allow' OR (risk_score >= 20 AND a <> 'block') AS gray FROM s)
    SELECT CASE WHEN gray AND l2_label = 'CONFIDENTIAL' AND l2_confidence >= 0.7 THEN 'route_local' WHEN gray AND l2_degraded THEN 'route_local' ELSE a END AS action, count(*) AS n FROM g GROUP BY 1""",
    ("audit",),
)
def _(t):
    rows = _decided(t)
    gray = (F.col("d.action") == "allow") | ((F.col("risk_score") >= 20) & (F.col("d.action") != "block"))
    second = policy.l2_decision(F.lit("keep"), F.col("l2_label"), F.col("l2_confidence"), F.lit(False), F.col("l2_degraded"))
    action = F.when(gray & (second != "keep"), "route_local").otherwise(F.col("d.action"))
    return rows.groupBy(action.alias("action")).agg(F.count("*").alias("n"))


@query("l2_chunk_merge", "SELECT id % 4 AS k, CASE id % 4 WHEN 0 THEN 'CONFIDENTIAL' WHEN 1 THEN 'NORMAL' WHEN 2 THEN 'NORMAL' ELSE 'NORMAL' END AS label, id % 4 = 1 AS degraded, id % 4 = 3 AS cached, CAST(30 AS INT) AS latency, count(*) AS n FROM audit GROUP BY ALL", ("audit",))
def _(t):
    k = F.col("id") % 4
    chunk = lambda label, conf, bad, ms: F.struct(label.alias("label"), F.lit(conf).alias("confidence"), bad.alias("degraded"), (k == 3).alias("cached"), F.lit(ms).alias("latency"))
    chunks = F.array(chunk(F.lit("NORMAL"), 0.6, F.lit(False), 10), chunk(F.when(k == 0, "CONFIDENTIAL").otherwise("NORMAL"), 0.8, k == 1, 30), chunk(F.lit("NORMAL"), 0.9, F.lit(False), 20))
    rows = t("audit").select(k.alias("k"), policy.merge_chunks(chunks).alias("m"))
    return rows.groupBy("k", "m.label", "m.degraded", "m.cached", "m.latency").agg(F.count("*").alias("n"))


@query("resolve_route", "SELECT CASE WHEN action <> 'allow' THEN 'local' WHEN strpos(model, '/') > 0 THEN split_part(model, '/', 1) WHEN provider <> '' THEN provider ELSE 'external' END AS route, action <> 'allow' AND provider NOT IN ('', 'local') AS override_denied, count(*) AS n FROM audit GROUP BY ALL", ("audit",))
def _(t):
    pinned = F.col("action") != "allow"
    route = F.when(pinned, "local").when(F.col("model").contains("/"), F.substring_index("model", "/", 1)).when(F.col("provider") != "", F.col("provider")).otherwise("external")
    return t("audit").groupBy(route.alias("route"), (pinned & ~F.col("provider").isin("", "local")).alias("override_denied")).agg(F.count("*").alias("n"))


# The n-th string is begun only while fewer than 20,000 characters stand before it.
_BODY = "[CAST(e.event_type AS VARCHAR), e.props, '', d.text, d.text, d.lang, left(d.text, 50), d.text, d.text, d.text, d.source]"


@query(
    "body_text_flatten",
    f"""WITH b AS (SELECT d.doc_id, [left(x, 4000) for x in {_BODY}] AS parts FROM documents d JOIN events e ON e.event_id = d.doc_id),
    k AS (SELECT doc_id, parts[i] AS x, i FROM b, range(1, 12) AS t(i) WHERE coalesce(list_sum([length(y) for y in parts[1 : i - 1]]), 0) < 20000 AND parts[i] <> '')
    SELECT doc_id, CAST(sum(length(x)) + count(*) - 1 AS BIGINT) AS n, sha256(string_agg(x, ' ' ORDER BY i)) AS digest FROM k GROUP BY doc_id""",
)
def _(t):
    """Bodies of documents with the events of their numbers: strings in lists and maps down to the fourth level."""
    from ..functions.flatten import body_text

    both = t("documents").join(t("events").select(F.col("event_id").alias("doc_id"), "event_type", "props"), "doc_id")
    inner = F.struct(F.array("text", "text").alias("messages"), F.struct("lang", F.array(F.left("text", F.lit(50))).alias("head")).alias("meta"))
    body = F.to_json(F.struct("event_type", F.array(F.col("props"), F.lit("")).alias("list"), inner.alias("inner"), F.array("text", "text", "text").alias("rest"), "source"))
    rows = both.select("doc_id", body_text(body).alias("text"))
    return rows.select("doc_id", F.length("text").cast("long").alias("n"), F.sha2("text", 256).alias("digest"))

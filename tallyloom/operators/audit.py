"""Search, indicators and agreement analysis over decision rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scope

SEARCHED = ("text_preview", "filename", "requested_model", "model", "provider", "rule", "client_ip", "type", "token_masked", "key_name", "session_id")
JUDGED = ("l2_label", "l2_confidence", "l2_degraded", "shadow_label", "shadow_degraded")
EXTERNAL = ("external", "外部", "外发")
LOCAL = ("local", "本地")
# The names under which rules are displayed and searched, and the rules that no policy holds.
RULE_NAMES = {
    "default_allow": "默认放行",
    "allow": "放行",
    "route_local": "本地路由",
    "block": "阻断",
    "l2_confidential": "L2 判密",
    "l2_unavailable": "L2 不可用",
    "l2_injection": "L2 提示注入",
    "first_chunk_fallback": "首块转内网",
    "prompt_too_long_fallback": "长提示转内网",
    "key_blacklist": "密钥黑名单",
    "key_middle_local": "密钥中间档转内网",
    "encoded_keyword": "编码关键词转内网",
    "review_text_overflow": "超审查预算转内网",
    "local_alias_bypass": "全内网别名放行",
    "financial_local_only": "财务表转内网",
    "drawing_local_only": "图纸转内网",
    "pii_weighted_route_local": "隐私加权转内网",
    "pii_critical_block": "高危隐私拦截",
    "block_secrets": "拦截密钥",
    "session_route_local": "会话机密转内网",
    "tainted_file_ref": "文件名转内网",
    "unparsed_binary_route_local": "未解析二进制转内网",
    "ocr_empty_image_route_local": "空图转内网",
    "未解析二进制转内网": "二进制转内网",
    "文件名污染转内网": "文件名转内网",
    "empty_image": "空图转内网",
}
SYSTEM_RULES = ("l2_confidential", "l2_unavailable", "l2_injection", "encoded_keyword", "review_text_overflow", "first_chunk_fallback", "prompt_too_long_fallback", "local_alias_bypass", "key_middle_local")
SYSTEM_MARK = "（系统内置）"


def scan(rows: DataFrame, since: str | None = None, until: str | None = None, limit: int | None = None, **equal: str) -> DataFrame:
    """Newest limit rows with since <= ts < until and equal columns."""
    if since:
        rows = rows.where(F.col("ts") >= F.lit(since).cast("timestamp"))
    if until:
        rows = rows.where(F.col("ts") < F.lit(until).cast("timestamp"))
    for column, value in equal.items():
        rows = rows.where(F.col(column) == value)
    return rows.orderBy(F.desc("ts"), F.desc("id")).limit(limit) if limit else rows


def status() -> Column:
    return scope.entry_status(F.col("status_code"), F.col("action"), F.col("rule"))


def search(rows: DataFrame, ip: str = "", token: str = "", status_text: str = "", q: str = "", mismatch: bool = False, **equal: str) -> DataFrame:
    """All given conditions at once. An unknown status text is no condition."""
    if ip:
        rows = rows.where(F.col("client_ip").contains(ip))
    if token:
        rows = rows.where(F.lower("token_masked").contains(token.lower()))
    for column, value in equal.items():
        rows = rows.where(F.col(column) == value)
    if len(status_text) == 3 and status_text[0].isdigit():
        rows = rows.where(scope.status_class(status()) == status_text.lower() if status_text[1:].lower() == "xx" else status() == int(status_text))
    if mismatch:
        rows = rows.where(scope.shadow_mismatch(F.col("l2_label"), F.col("shadow_label"), F.col("l2_degraded")))
    return rows.where(fulltext(q)) if q else rows


def fulltext(q: str) -> Column:
    """Substring, whatever its case, of any searched column, of the name a rule is displayed under, or of the second classifier's judgement as
    JSON; the words for the two routes also match by the route flag, a missing flag being external."""
    word = q.lower()
    found = F.lit(False)
    for column in SEARCHED:
        found = found | F.coalesce(F.lower(column).contains(word), F.lit(False))
    # which rules' display names hold the word is known beforehand
    named = [r for r in (*RULE_NAMES, *SYSTEM_RULES) if word in f"{RULE_NAMES.get(r, '')}{SYSTEM_MARK if r in SYSTEM_RULES else ''}".lower()]
    if named:
        found = found | F.coalesce(scope.norm("rule").isin(named), F.lit(False))
    found = found | F.lower(F.to_json(F.struct(*JUDGED))).contains(word)
    local = F.coalesce("local_flag", F.lit(False))
    return found | ~local if word in EXTERNAL else found | local if word in LOCAL else found


def page(rows: DataFrame, sort: str, number: int, size: int = 50) -> DataFrame:
    """One page by provider, rule or type (then time), or by time; a page past the end is the last one."""
    order = [F.desc(sort)] if sort in ("provider", "rule", "type") else []
    order += [F.asc("ts"), F.asc("id")] if sort == "time_asc" else [F.desc("ts"), F.desc("id")]
    last = max(0, (rows.count() - 1) // size)
    return rows.orderBy(*order).offset(min(max(number, 0), last) * size).limit(size)


def count_kpi(rows: DataFrame) -> DataFrame:
    a = F.col("action")
    return rows.agg(
        F.count("*").alias("total"), F.count_if(a == "allow").alias("allow"), F.count_if(a == "route_local").alias("route_local"), F.count_if(a.startswith("block") | (F.col("rule") == "egress_denied")).alias("block")
    )


def window_kpi(rows: DataFrame) -> DataFrame:
    """As count_kpi, with other = total - the rest; a denied egress is both blocked and its action."""
    out = rows.agg(
        F.count("*").alias("total"), F.count_if(F.col("action") == "allow").alias("allow"), F.count_if(F.col("action") == "route_local").alias("route_local"),
        F.count_if(scope.entry_blocked(F.col("action"), F.col("rule"))).alias("block"),
    )
    return out.withColumn("other", F.col("total") - F.col("allow") - F.col("route_local") - F.col("block"))


def with_usage(paged: DataFrame, log: DataFrame) -> DataFrame:
    """The page's rows with their tokens and latency; the join only sees the page."""
    usage = log.select("req_id", "prompt_tokens", "completion_tokens", "duration_ms")
    return paged.join(usage, "req_id", "left")


def csv_export(rows: DataFrame) -> DataFrame:
    """Columns as strings, guarded against formulas, times as displayed."""
    text = [scope.csv_guard(F.substring(F.coalesce(F.col(c).cast("string"), F.lit("")), 1, 200)).alias(c) for c in ("req_id", "type", "action", "rule", "provider", "model", "client_ip", "token_masked", "filename")]
    return rows.select(scope.stamp(scope.local_time(F.col("ts"))).alias("time"), *text, status().alias("status"))


def rule_hits(rows: DataFrame) -> DataFrame:
    """Per rule, without default and bypass ones: count, counts by action (sorted, as text) and the last time."""
    named = rows.where(~scope.norm("rule").isin("", "bypass", *scope.DEFAULT_RULES))
    pairs = named.groupBy("rule", "action").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    entry = F.struct("action", "n")
    out = pairs.groupBy("rule").agg(F.sum("n").alias("count"), F.array_sort(F.collect_list(entry)).alias("by"), F.max("last").alias("last"))
    return out.select("rule", "count", F.array_join(F.transform("by", lambda x: F.concat_ws("=", x["action"], x["n"].cast("string"))), ",").alias("actions"), scope.stamp(F.col("last")).alias("last_seen"))


def shadow_stats(rows: DataFrame) -> DataFrame:
    """Agreement of the two classifiers: cells over all shadowed rows, the rate only over rows that aren't degraded."""
    has = F.col("l2_label").isNotNull()
    shadowed = has & F.coalesce(F.col("shadow_label").isin("CONFIDENTIAL", "NORMAL"), F.lit(False))
    main, shadow = F.col("l2_label") == "CONFIDENTIAL", F.col("shadow_label") == "CONFIDENTIAL"
    compared = shadowed & ~F.col("l2_degraded")
    out = rows.agg(
        F.count_if(has).alias("l2_total"), F.count_if(shadowed).alias("shadowed"), F.count_if(has & ~shadowed & F.col("shadow_degraded")).alias("shadow_degraded"),
        F.count_if(shadowed & main & shadow).alias("cc"), F.count_if(shadowed & main & ~shadow).alias("cn"), F.count_if(shadowed & ~main & shadow).alias("nc"), F.count_if(shadowed & ~main & ~shadow).alias("nn"),
        F.count_if(shadowed & F.col("l2_degraded")).alias("main_degraded"), F.count_if(compared).alias("compared"), F.count_if(compared & (F.col("l2_label") == F.col("shadow_label"))).alias("agree"),
        F.sum(F.when(shadowed, F.col("l2_latency_ms"))).alias("latency_sum"),
    )
    return out.withColumn("agree_rate", F.try_divide(F.col("agree"), F.col("compared")))


def divergences(rows: DataFrame) -> DataFrame:
    """Rows whose two labels are valid and differ, main not degraded; cell nc or cn."""
    both = F.col("l2_label").isin("CONFIDENTIAL", "NORMAL") & scope.shadow_mismatch(F.col("l2_label"), F.col("shadow_label"), F.col("l2_degraded"))
    return rows.where(both).withColumn("cell", F.when(F.col("l2_label") == "NORMAL", "nc").otherwise("cn"))


def group_key() -> Column:
    """Key of a text group: white space collapsed, with the file name; the direction of the difference is no part."""
    return F.sha1(F.concat_ws("|", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")), F.coalesce("filename", F.lit(""))))


def collapsed(rows: DataFrame) -> DataFrame:
    """One row for each text group: the newest, with the group's size and its newest label that isn't null.

    Reduced before the shuffle, so a text that repeats without end costs one row for each task.
    """
    newest = F.struct("ts", "id")
    return rows.groupBy(group_key().alias("group")).agg(
        F.max_by("id", newest).alias("id"), F.max_by("cell", newest).alias("cell"), F.count("*").alias("dup"),
        F.max_by("label", F.when(F.col("label").isNotNull(), newest)).alias("label"),
    )


def hourly_events(rows: DataFrame, until: str, hours: int) -> DataFrame:
    """Three kinds that may overlap, by hour, with empty hours."""
    end = F.date_trunc("hour", F.lit(until).cast("timestamp"))
    start = end - F.expr(f"INTERVAL {hours} HOURS")
    kinds = F.array_compact(F.array(
        F.when(scope.entry_blocked(F.col("action"), F.col("rule")), "blocked"), F.when(F.coalesce("l2_degraded", F.lit(False)), "degraded"), F.when(scope.is_local_route(F.col("action")), "local")
    ))
    inside = rows.where((F.col("ts") >= start) & (F.col("ts") < end + F.expr("INTERVAL 1 HOUR")))
    counts = inside.select(F.date_trunc("hour", "ts").alias("hour"), F.explode(kinds).alias("kind")).groupBy("hour").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("blocked", "degraded", "local")))
    calendar = rows.sparkSession.range(1).select(F.explode(F.sequence(start, end, F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    return calendar.join(F.broadcast(counts), "hour", "left").select(scope.stamp(F.col("hour")).alias("hour"), *(F.coalesce(k, F.lit(0)).alias(k) for k in ("blocked", "degraded", "local")))


def rounds(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Agreement in each round [started, finished]: rows meet the rounds of their day, then the exact times are compared."""
    days = spans.withColumn("_day", F.explode(F.sequence(F.to_date("started"), F.to_date("finished"))))
    joined = rows.withColumn("_day", F.to_date("ts")).join(days, "_day").where(F.col("ts").between(F.col("started"), F.col("finished")))
    valid = joined.where(F.col("l2_label").isNotNull() & F.col("shadow_label").isNotNull() & ~F.col("l2_degraded"))
    return valid.groupBy("round").agg(F.count("*").alias("compared"), F.count_if(F.col("l2_label") == F.col("shadow_label")).alias("agree"))


def asof_sticky(rows: DataFrame, mark: Column, ttl_seconds: int, session: str = "session", chunk: int = 86400) -> DataFrame:
    """Adds sticky: was the session marked within the ttl before this row?

    Windows run within chunks of time, so that one session's rows are spread; what a chunk hands on is the time of its last mark.
    """
    at = F.unix_timestamp("ts")
    rows = rows.withColumn("_chunk", F.floor(at / chunk)).withColumn("_mark", F.when(mark, at))
    within = Window.partitionBy(session, "_chunk").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(session).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    edges = rows.groupBy(session, "_chunk").agg(F.max("_mark").alias("_last"))
    edges = edges.select(F.col(session).alias("_session"), F.col("_chunk").alias("_of"), F.max("_last").over(before).alias("_carry"))
    both = rows.withColumn("_near", F.last("_mark", ignorenulls=True).over(within)).join(edges, F.col(session).eqNullSafe(F.col("_session")) & F.col("_chunk").eqNullSafe(F.col("_of")))
    marked = F.coalesce("_near", "_carry")
    return both.withColumn("sticky", F.coalesce(at - marked <= ttl_seconds, F.lit(False))).drop("_chunk", "_mark", "_session", "_of", "_carry", "_near")


def _changes(old: Column, new: Column) -> Column:
    """What differs between two states (priority, action, body) of one rule; null: no such rule. A rule may have changed in two ways."""
    both = old.isNotNull() & new.isNotNull()
    differs = lambda *names: both & ~F.struct(*(old[n] for n in names)).eqNullSafe(F.struct(*(new[n] for n in names)))
    tests = {"added": old.isNull(), "removed": new.isNull(), "priority": differs("priority"), "changed": differs("action", "body")}
    return F.array_compact(F.array(*(F.when(test, F.lit(k)) for k, test in tests.items())))


def policy_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """name and change (added, removed, priority, changed) for each rule that differs between two versions."""
    a, b = (df.select("name", F.struct("priority", "action", "body").alias(k)) for df, k in ((old, "a"), (new, "b")))
    return a.join(b, "name", "full").select("name", F.explode(_changes(F.col("a"), F.col("b"))).alias("change"))


def _stepped(snapshots: DataFrame, live: DataFrame) -> DataFrame:
    """name, rule, step (places of versions in order from 0, the live rules last) and last (the live rules' place)."""
    versions = snapshots.select("version").distinct().withColumn("step", F.row_number().over(Window.orderBy("version")) - 1)  # one row for each saved version
    last = F.lit(versions.count())
    rule = F.struct("priority", "action", "body").alias("rule")
    saved = snapshots.join(versions, "version").select("name", rule, "step", "version")
    rows = saved.unionByName(live.select("name", rule, F.lit(None).cast("int").alias("step"), F.lit(None).cast(dict(snapshots.dtypes)["version"]).alias("version")))
    return rows.withColumn("last", last).withColumn("step", F.coalesce("step", "last"))


def policy_changes(snapshots: DataFrame, live: DataFrame) -> DataFrame:
    """version, name, change: what each saved version lacks of the next newer one, the newest of the live rules.

    snapshots: version, name, priority, action, body, one row for each rule of each version; live the same without version. A version is compared
    with its neighbour by one window over each rule's rows, so the work is that of the rows, not of pairs of versions.
    """
    rows, w = _stepped(snapshots, live), Window.partitionBy("name").orderBy("step")
    near = rows.withColumn("_before", F.lag(F.struct("step", "rule")).over(w)).withColumn("_after", F.lead("step").over(w))
    none = F.lit(None).cast(rows.schema["rule"].dataType)
    joined = F.col("_before.step") == F.col("step") - 1
    arrived = F.when(F.col("step") > 0, _changes(F.when(joined, F.col("_before.rule")), F.col("rule")))
    left = F.when((F.col("step") < F.col("last")) & ~F.coalesce(F.col("_after") == F.col("step") + 1, F.lit(False)), _changes(F.col("rule"), none))
    each = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: x)
    found = near.select("name", F.explode(F.concat(F.transform(each(arrived), lambda x: F.struct((F.col("step") - 1).alias("step"), x.alias("change"))), F.transform(each(left), lambda x: F.struct(F.col("step").alias("step"), x.alias("change"))))).alias("c"))
    versions = rows.where("version IS NOT NULL").select("step", "version").distinct()
    return found.select("name", "c.step", "c.change").join(versions, "step").select("version", "name", "change")


def policy_intervals(snapshots: DataFrame, live: DataFrame) -> DataFrame:
    """name, priority, action, body, first and last version of each unbroken stretch of versions in which a rule was the same; last is null where it still is."""
    rows, w = _stepped(snapshots, live), Window.partitionBy("name").orderBy("step")
    before = F.lag(F.struct("step", "rule")).over(w)
    starts = ~F.coalesce((before["step"] == F.col("step") - 1) & before["rule"].eqNullSafe(F.col("rule")), F.lit(False))
    runs = rows.withColumn("_new", starts).withColumn("_run", F.count_if("_new").over(w))
    found = runs.groupBy("name", "_run").agg(F.first("rule").alias("rule"), F.min_by("version", "step").alias("first"), F.max_by("version", "step").alias("last"), F.max(F.col("version").isNull()).alias("_live"))
    return found.select("name", "rule.*", "first", F.when(~F.col("_live"), F.col("last")).alias("last"))


def panel(rows: DataFrame, top: int = 10) -> DataFrame:
    """The live panel from one scan: panel, item and n. action, type and class (of the status) in full, of rule, provider and model the top ones."""
    filled = lambda c: F.when(scope.norm(c) == "", "unknown").otherwise(scope.norm(c)).alias(c)
    some = lambda c: F.nullif(scope.norm(c), F.lit("")).alias(c)
    dims = ["action", "type", "class", "rule", "provider", "model"]
    flat = rows.select(filled("action"), filled("type"), scope.status_class(F.col("status_code")).alias("class"), *map(some, dims[3:]))
    sets = flat.groupingSets([[d] for d in dims], *dims).agg(F.grouping_id(*dims).alias("gid"), F.count("*").alias("n"))
    gid = {d: (1 << len(dims)) - 1 - (1 << (len(dims) - 1 - k)) for k, d in enumerate(dims)}
    name = F.coalesce(*(F.when(F.col("gid") == g, F.lit(d)) for d, g in gid.items()))
    found = sets.select(name.alias("panel"), F.coalesce(*dims).alias("item"), "n").where("item IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("panel").orderBy(F.desc("n"), "item"))  # over different items
    return found.withColumn("_place", place).where(F.col("panel").isin(*dims[:3]) | (F.col("_place") <= top)).drop("_place")


def prometheus_summary(rows: DataFrame, metric: str, column: str, by: str, quantiles: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Text exposition of a column's quantiles (nearest rank), sum and count by a label."""
    label = lambda extra="": F.concat(F.lit(f'{{{by}="'), F.col(by), F.lit(f'"{extra}}} '))
    at = [F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {column})").cast("long").alias(f"q{k}") for k, q in enumerate(quantiles)]
    found = rows.where(F.col(column).isNotNull()).groupBy(by).agg(*at, F.sum(column).cast("long").alias("total"), F.count("*").alias("n"))
    value = lambda c: F.col(c).cast("string")
    lines = [F.concat(F.lit(metric), label(f',quantile="{q}"'), value(f"q{k}")) for k, q in enumerate(quantiles)]
    lines += [F.concat(F.lit(f"{metric}_sum"), label(), value("total")), F.concat(F.lit(f"{metric}_count"), label(), value("n"))]
    return found.select(F.explode(F.array(*lines)).alias("line"))


def prometheus_lines(counts: DataFrame) -> DataFrame:
    """Text exposition of calls by provider, action and status class, a line for each series."""
    cells = ("provider", "action", "status")
    labels = F.array_join(F.array(*(F.concat(F.lit(f'{c}="'), F.col(c), F.lit('"')) for c in cells)), ",")
    return counts.select(F.concat(F.lit("requests_total{"), labels, F.lit("} "), F.col("n").cast("string")).alias("line"))


# Upper edges of the second classifier's latency histogram, in milliseconds.
LATENCY_EDGES = (50, 100, 200, 300, 500, 1000, 2000)


def prometheus_histogram(rows: DataFrame) -> DataFrame:
    """Text exposition of the second classifier's latency by label: cumulative buckets, then sum and count."""
    ms = F.col("l2_latency_ms")
    sums = {f'_bucket{{{{label="%s",le="{e}"}}}}': F.count_if(ms <= e) for e in LATENCY_EDGES}
    sums |= {'_bucket{{label="%s",le="+Inf"}}': F.count("*"), '_sum{{label="%s"}}': F.sum(ms), '_count{{label="%s"}}': F.count("*")}
    found = rows.where("l2_label IS NOT NULL AND l2_latency_ms IS NOT NULL").groupBy("l2_label").agg(F.array(*(v.cast("long") for v in sums.values())).alias("n"))
    names = F.array(*(F.lit("l2_latency_ms" + k.replace("{{", "{").replace("}}", "}")) for k in sums))
    lines = F.transform(names, lambda x, i: F.concat(F.replace(x, F.lit("%s"), F.col("l2_label")), F.lit(" "), F.get("n", i).cast("string")))
    return found.select(F.explode(lines).alias("line"))

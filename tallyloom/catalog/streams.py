"""State machines, streams and line sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import changes, scope
from ..sources import jsonl, sinks
from ..sources.adapters import REQUEST_LOG
from ..streaming import metrics, state
from .registry import QUERIES, SQL, query

RL = ("request_log",)


def _timed(t):
    return t("request_log").select("key_name", "provider", F.unix_timestamp("ts").alias("t"), "id", (F.col("status_code") >= 500).alias("failed"), F.when(F.col("id") % 5 != 0, F.col("id") % 4).alias("level"))


def _walk(key: str, start: str, step: str) -> str:
    """SQL that walks each key's events e in time order from the state r: start gives the first state's columns, step the next one's, out last."""
    events = f"SELECT {key} AS k, CAST(epoch(ts) AS DOUBLE) AS t, id, status_code >= 500 AS failed, CASE WHEN id % 5 <> 0 THEN id % 4 END AS level, CASE WHEN provider = 'local' AND model = 'base' THEN CAST(1 AS DOUBLE) WHEN model = 'fast' THEN 2 ELSE 0 END AS rpm, row_number() OVER (PARTITION BY {key} ORDER BY ts, id) AS n FROM request_log"
    return f"WITH RECURSIVE e AS MATERIALIZED ({events}), r AS (SELECT DISTINCT k, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, {start} FROM e UNION ALL {step}) SELECT id, out FROM r WHERE n > 0"


_NEXT = "FROM r JOIN e ON e.k = r.k AND e.n = r.n + 1"
_RATE = f"CAST({0.05 / 60!r} AS DOUBLE)"
_ONE = "CAST(1 AS DOUBLE)"
_BUCKETS = f"""SELECT k, n, id, CASE WHEN a >= 1 THEN a - 1 ELSE a END, t, CASE WHEN a < 1 THEN old_b WHEN b >= 1 THEN b - 1 ELSE b END,
    CASE WHEN a < 1 THEN old_at ELSE t END, CASE WHEN a < 1 THEN 'rps' WHEN b >= 1 THEN 'ok' ELSE 'rpm' END
    FROM (SELECT e.k, e.n, e.id, e.t, least({_ONE}, r.a + greatest(0, e.t - r.a_at)) AS a, least({_ONE}, r.b + greatest(0, e.t - r.b_at) * {_RATE}) AS b, r.b AS old_b, r.b_at AS old_at {_NEXT})"""
# A request first asks whether it may go: an open breaker whose time is over is half open then. q: the times of failures, all that lie in the window.
_BREAKER = f"""SELECT k, n, id,
    CASE WHEN was = 'half_open' AND failed OR was <> 'half_open' AND failed AND len(kept) >= 5 THEN 'open' WHEN was = 'half_open' AND good >= 1 THEN 'closed' ELSE was END AS name,
    CASE WHEN was = 'half_open' AND failed OR was <> 'half_open' AND failed AND len(kept) >= 5 THEN t ELSE opened END,
    CASE WHEN was = 'half_open' AND NOT failed AND good = 0 THEN 1 ELSE 0 END,
    CASE WHEN was = 'half_open' THEN CASE WHEN NOT failed AND good >= 1 THEN [] ELSE q END WHEN failed THEN kept WHEN was = 'closed' AND len(q) > 0 AND t - q[1] > 86400 THEN [] ELSE q END,
    CASE WHEN was = 'half_open' AND failed OR was <> 'half_open' AND failed AND len(kept) >= 5 THEN 'open' WHEN was = 'half_open' AND good >= 1 THEN 'closed' ELSE was END
    FROM (SELECT e.k, e.n, e.id, e.t, e.failed, r.opened, r.q, list_filter(list_append(r.q, e.t), lambda x: e.t - x <= 86400) AS kept,
    CASE WHEN r.name = 'open' AND e.t - r.opened >= 3600 THEN 'half_open' ELSE r.name END AS was, CASE WHEN r.name = 'open' THEN 0 ELSE r.good END AS good {_NEXT})"""
_LIMITED = f"""SELECT k, n, id, CASE WHEN rpm > 0 AND a >= 1 THEN a - 1 ELSE a END, t, CASE WHEN rpm = 0 OR a >= 1 THEN CAST(1 AS BIGINT) ELSE 0 END
    FROM (SELECT e.k, e.n, e.id, e.t, e.rpm, least(e.rpm, r.a + greatest(0, e.t - r.used) * (e.rpm / 60)) AS a {_NEXT})"""
_STICKY = f"""SELECT k, n, id, CASE WHEN now >= 2 THEN now WHEN held > 0 THEN tier ELSE 0 END, CASE WHEN now >= 2 THEN t ELSE used END, now
    FROM (SELECT *, greatest(coalesce(level, held), held) AS now
    FROM (SELECT e.k, e.n, e.id, e.t, e.level, r.tier, r.used, CASE WHEN r.tier >= 2 AND e.t - r.used <= 3600 THEN r.tier ELSE 0 END AS held {_NEXT}))"""


@query("token_bucket", _walk("key_name", f"{_ONE} AS a, CAST(0 AS DOUBLE) AS a_at, {_ONE} AS b, CAST(0 AS DOUBLE) AS b_at, '' AS out", _BUCKETS), RL)
def _(t):
    return state.fold(_timed(t), "key_name", [], state.two_buckets(1, 0.05), "string")


@query("breaker_fsm", _walk("provider", "'closed' AS name, CAST(0 AS DOUBLE) AS opened, 0 AS good, CAST([] AS DOUBLE[]) AS q, '' AS out", _BREAKER), RL)
def _(t):
    return state.fold(_timed(t), "provider", ["failed"], state.breaker(window=86400, recovery=3600), "string")


@query("sticky_tier", _walk("key_name", "CAST(0 AS BIGINT) AS tier, CAST(0 AS DOUBLE) AS used, CAST(0 AS BIGINT) AS out", _STICKY), RL)
def _(t):
    return state.sticky_tiers(_timed(t), "key_name", 3600)


# An hour of the log is a second of the limiter, so that its sparse requests meet the limits.
_SCOPED = "SELECT concat(CASE WHEN type = 'file' THEN 'files' ELSE 'default' END, '|', token_masked) AS k, CAST(epoch(ts) AS DOUBLE) / 3600 AS t, id, type = 'file' AS files, row_number() OVER (PARTITION BY type, token_masked ORDER BY ts, id) AS n FROM audit"
_WAIT = lambda have, rate: f"greatest(1, CAST(floor((1 - {have}) / {rate}) AS BIGINT))"
_MINUTE, _FILES = (f"({n} / CAST(60 AS DOUBLE))" for n in (20, 3))
_LIMITER = f"""WITH RECURSIVE e AS MATERIALIZED ({_SCOPED}), r AS (SELECT DISTINCT k, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, CAST(NULL AS DOUBLE) AS a, CAST(NULL AS DOUBLE) AS a_at, CAST(NULL AS DOUBLE) AS b, CAST(NULL AS DOUBLE) AS b_at, '' AS out FROM e
    UNION ALL SELECT k, n, id, CASE WHEN files THEN 0 WHEN a >= 1 THEN a - 1 ELSE a END, t,
    CASE WHEN files THEN CASE WHEN c >= 1 THEN c - 1 ELSE c END WHEN a < 1 THEN old_b WHEN b >= 1 THEN b - 1 ELSE b END, CASE WHEN files OR a >= 1 THEN t ELSE old_at END,
    CASE WHEN files AND c >= 1 THEN 'ok 0' WHEN files THEN concat('files_rpm ', {_WAIT("c", _FILES)}) WHEN a < 1 THEN concat('rps ', {_WAIT("a", "1")}) WHEN b < 1 THEN concat('rpm ', {_WAIT("b", _MINUTE)}) ELSE 'ok 0' END
    FROM (SELECT e.k, e.n, e.id, e.t, e.files, r.b AS old_b, r.b_at AS old_at, least({_ONE}, coalesce(r.a + greatest(0, e.t - r.a_at) * {_ONE}, 1)) AS a,
    least(CAST(20 AS DOUBLE), coalesce(r.b + greatest(0, e.t - r.b_at) * {_MINUTE}, 20)) AS b, least(CAST(3 AS DOUBLE), coalesce(r.b + greatest(0, e.t - r.b_at) * {_FILES}, 3)) AS c {_NEXT}))
    SELECT id, out FROM r WHERE n > 0"""


@query("rate_limiter", _LIMITER, ("audit",))
def _(t):
    """What each request gets from the buckets of its key: uploads have their own, other requests must pass two."""
    scope_ = F.when(F.col("type") == "file", "files").otherwise("default")
    rows = t("audit").select(F.concat_ws("|", scope_, "token_masked").alias("k"), (F.unix_timestamp("ts") / F.lit(3600.0)).alias("t"), "id", scope_.alias("scope"))
    return state.fold(rows, "k", ["scope"], state.limiter(1, 20, 3), "string").select("id", "out")


_MENTION = "CASE WHEN filename <> '' THEN filename WHEN id % 10 = 3 THEN concat('帮我看看File', CAST(id % 7 AS varchar(5)), '.CSV ') WHEN id % 10 = 5 THEN concat(CAST(id % 7 AS varchar(5)), '.csv') WHEN id % 10 = 7 THEN ' ' END"
_TTL = 3 * 86400
_TAINTED = f"""WITH f AS MATERIALIZED (SELECT id, CAST(epoch(ts) AS BIGINT) AS t, token_masked AS k, lower(trim({_MENTION})) AS m, local_flag AND filename <> '' AS mark FROM audit WHERE ({_MENTION}) IS NOT NULL),
    x AS (SELECT a.id, a.m, b.m AS name, max({{'t': b.t, 'id': b.id}}) AS last FROM f a JOIN f b ON a.k = b.k AND b.mark AND (b.t < a.t OR b.t = a.t AND b.id < a.id) AND a.t - b.t <= {_TTL} WHERE a.m <> '' GROUP BY ALL),
    y AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY last DESC) AS place FROM x)
    SELECT id, arg_max(name, last) AS name, strftime(make_timestamp(max(last).t * 1000000), '%Y-%m-%d %H:%M:%S') AS tainted_at FROM y WHERE place <= 200 AND (ends_with(m, name) OR ends_with(name, m)) GROUP BY id"""


@query("asof_tainted_file", _TAINTED, ("audit",))
def _(t):
    """Rows that mention a file which the same key tainted within three days, by either name's end: the one tainted last."""
    rows = t("audit").select("token_masked", F.unix_timestamp("ts").alias("t"), "id", F.expr(_MENTION).alias("mention"), (F.col("local_flag") & (F.col("filename") != "")).alias("tainted"))
    step, combine = state.tainted_files(_TTL)
    found = state.fold(rows.where("mention IS NOT NULL AND token_masked <> ''"), "token_masked", ["mention", "tainted"], step, "string", combine).where("out IS NOT NULL")
    return found.select("id", F.regexp_extract("out", "^[0-9]+ (.*)$", 1).alias("name"), scope.stamp(F.timestamp_seconds(F.split("out", " ")[0].cast("long"))).alias("tainted_at"))


def _live(spark, sf_dir):
    """The request log as a stream."""
    rows = metrics.read_events(spark, sf_dir).selectExpr(*(f"{sql} AS {column}" for column, sql in REQUEST_LOG.items() if column in ("id", "ts", "key_name")))
    return rows.select("key_name", F.unix_timestamp("ts").alias("t"), "id", F.when(F.col("id") % 5 != 0, F.col("id") % 4).alias("level"))


def _streamed(columns: list[str], step, out: str, ttl: float):
    def run(spark, sf_dir):
        with metrics.stateful(spark):
            return metrics.drained(state.stream(_live(spark, sf_dir), "key_name", columns, step, out, ttl), "append")

    return run


# The same rows as the tables give; a bucket is full after its ttl, a tier is held no longer.
QUERIES["stream_token_bucket"] = _streamed([], state.two_buckets(1, 0.05), "string", 1200)
SQL["stream_token_bucket"] = SQL["token_bucket"]
QUERIES["stream_sticky_tier"] = _streamed(["level"], state.sticky_tier(3600), "long", 3600)
SQL["stream_sticky_tier"] = SQL["sticky_tier"]

_ARRIVES = "ts + CASE WHEN event_id % 13 = 0 THEN INTERVAL 8 DAY WHEN event_id % 5 = 0 THEN INTERVAL 6 HOUR ELSE INTERVAL 0 HOUR END"
_ARRIVALS = ("2024-01-06", "2024-01-11", "2024-01-16", "2024-01-21", "2024-01-26")
_LATE = 86400


def _late_rows(spark, sf_dir):
    """Rows that come late or are no good, counted by cause: they arrive in six portions, and the stream starts again for each from its checkpoint."""
    base = metrics.scratch(spark, "late")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    portion = sum((F.when(F.expr(_ARRIVES) >= F.lit(day).cast("timestamp"), 1).otherwise(0) for day in _ARRIVALS), F.lit(0))
    for k in range(len(_ARRIVALS) + 1):
        rows.where(portion == k).write.mode("append").parquet(f"{base}/in")
        live = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        sinks.checked_stream(live, f"{base}/out", lambda: (F.col("value") >= 1) & (F.col("event_type") != ""), _LATE, f"{base}/checkpoint").awaitTermination()
    return sinks.counts(spark, f"{base}/out").select("batch", "n", "accepted", "late", "invalid", F.floor("latest").alias("latest"))


QUERIES["stream_late_rows"] = _late_rows
SQL["stream_late_rows"] = f"""WITH p AS (SELECT *, coalesce(value >= 1 AND event_type <> '', false) AS ok, CAST({' + '.join(f"CASE WHEN {_ARRIVES} >= TIMESTAMP '{day}' THEN 1 ELSE 0 END" for day in _ARRIVALS)} AS BIGINT) AS batch FROM events),
    w AS (SELECT batch, max(epoch(ts)) FILTER (ok) AS latest FROM p GROUP BY 1),
    b AS (SELECT batch, latest, max(latest) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w)
    SELECT batch, count(*) AS n, count(*) FILTER (ok AND NOT coalesce(before - {_LATE} > epoch(ts), false)) AS accepted, count(*) FILTER (ok AND coalesce(before - {_LATE} > epoch(ts), false)) AS late,
    count(*) FILTER (NOT ok) AS invalid, CAST(floor(any_value(latest)) AS BIGINT) AS latest FROM p JOIN b USING (batch) GROUP BY batch"""


def _windowed(spark, sf_dir):
    rows = metrics.drained(metrics.windowed(metrics.read_events(spark, sf_dir)), "complete")
    return rows.select(scope.stamp(F.col("w.start")).alias("day"), "event_type", "n", "total")


QUERIES["stream_windowed_metrics"] = _windowed
SQL["stream_windowed_metrics"] = "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS day, event_type, count(*) AS n, CAST(sum(floor(value)) AS BIGINT) AS total FROM events GROUP BY 1, 2"


@query("source_jsonl", "SELECT event_id AS id, CAST(floor(value) AS BIGINT) AS v FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0")
def _(t):
    whole = F.to_json(F.struct(F.col("event_id").alias("id"), F.floor("value").alias("v")))
    line = F.when(F.col("event_id") % 11 == 0, F.lit(" ")).when(F.col("event_id") % 13 == 0, F.substring(whole, 1, 9)).otherwise(whole)
    return jsonl.parse(t("events").select(line.alias("value")), "id long, v long")


@query(
    "sink_request_log",
    "SELECT strftime(ts, '%Y-%m-%d') AS day, coalesce(nullif(provider, ''), '-') AS provider, count(*) AS n, count(DISTINCT req_id) AS requests, max(length(m)) AS longest FROM (SELECT *, left(concat(model, ' ', req_id), 9) AS m FROM request_log) GROUP BY 1, 2",
    RL,
)
def _(t):
    """The log is normalized, appended by day and read again."""
    log = t("request_log")
    path = metrics.scratch(log.sparkSession, "log")
    rows = log.select("ts", "req_id", F.nullif("provider", F.lit("")).alias("provider"), F.concat_ws(" ", "model", "req_id").alias("model"))
    sinks.append(sinks.normalized(rows, {"provider": "-"}, {"model": 9}), path)
    stored = log.sparkSession.read.parquet(path)
    return stored.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"), "provider").agg(F.count("*").alias("n"), F.count_distinct("req_id").alias("requests"), F.max(F.length("model")).cast("long").alias("longest"))


@query("ring_persist_compact", "SELECT CAST(floor(epoch(ts) / 600) AS BIGINT) * 600 AS t, count(*) AS calls FROM request_log GROUP BY 1 ORDER BY 1 DESC LIMIT 2160", RL)
def _(t):
    """Ticks are written as lines, some of them torn, the newest 2,160 whole ones are kept and read again."""
    log = t("request_log")
    spark, base = log.sparkSession, metrics.scratch(log.sparkSession, "ring")
    ticks = log.groupBy((F.floor(F.unix_timestamp("ts") / 600) * 600).cast("long").alias("t")).agg(F.count("*").alias("calls"))
    lines = ticks.select(F.to_json(F.struct("t", "calls")).alias("value"))
    torn = lines.where(F.pmod(F.xxhash64("value"), F.lit(10)) == 0).select(F.left("value", F.length("value") - 3).alias("value"))
    lines.unionByName(torn).write.text(f"{base}/lines")
    jsonl.compact(spark, f"{base}/lines", f"{base}/short", "t", 2160)
    return jsonl.read(spark, f"{base}/short", "t long, calls long")


@query("diff_trigger", "SELECT conv_id, turn, text IS DISTINCT FROM lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS changed FROM conversations")
def _(t):
    from pyspark.sql import Window

    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t("conversations").select("conv_id", "turn", (~F.col("text").eqNullSafe(before)).alias("changed"))


@query("diff_spans")
def _(t):
    from pyspark.sql import Window

    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = t("conversations").select("conv_id", "turn", "text", before.alias("before"))
    pieces = rows.select("conv_id", "turn", changes.changed_pieces(F.col("before"), F.col("text")).alias("pieces"))
    return pieces.select("conv_id", "turn", F.size("pieces").alias("n"), F.sha2(F.array_join("pieces", "\n"), 256).alias("digest"))


@query("model_rpm_bucket", _walk("concat_ws('/', provider, model)", "CAST(2 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS used, CAST(0 AS BIGINT) AS out", _LIMITED), RL)
def _(t):
    """Requests under the limit of their provider and model, a bucket for each pair; the first enabled limit that names it counts."""
    limits = t("keys").sparkSession.sql("SELECT * FROM (VALUES (1, 'external/fast', 0, true), (2, 'local/base', 1, true), (3, 'fast', 2, true), (4, 'external/pro', 1, false)) AS t(position, name, rpm, enabled)")
    rows = t("request_log").select("provider", "model", F.concat_ws("/", "provider", "model").alias("pair"), F.unix_timestamp("ts").alias("t"), "id")
    return state.fold(state.with_limits(rows, limits), "pair", ["rpm"], state.limited(), "long")


@query(
    "long_windows",
    """WITH n AS (SELECT doc_id, text, CAST(ceil(length(text) / 500) AS BIGINT) AS n FROM documents), p AS (SELECT doc_id, text, CASE WHEN n <= 4 THEN range(n) ELSE list_sort(list_distinct([CAST(round_even(i * (n - 1) / 3.0, 0) AS BIGINT) for i in range(4)])) END AS places FROM n)
    SELECT doc_id, CAST(len(places) AS INT) AS windows, sha256(array_to_string([substr(text, k * 500 + 1, 500) for k in places], '|')) AS digest, sha256(right(text, CAST((length(text) - 1) % 500 + 1 AS BIGINT))) AS last FROM p""",
)
def _(t):
    """Four windows spread over each text; of one window, the last."""
    rows = t("documents").select("doc_id", scope.windows(F.col("text"), 500, F.lit(4)).alias("w"), scope.windows(F.col("text"), 500, F.lit(1)).alias("one"))
    return rows.select("doc_id", F.size("w").alias("windows"), F.sha2(F.array_join("w", "|"), 256).alias("digest"), F.sha2(F.array_join("one", "|"), 256).alias("last"))


@query("slim_envelope", "SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN text ELSE concat(text, CASE WHEN turn % 3 = 1 THEN chr(10) || '</query> more' ELSE '' END) END AS query FROM conversations")
def _(t):
    """What stands between a client's tags, to the last closing one; texts without tags stay as they are."""
    wrapped = F.when(F.col("turn") % 3 == 2, F.col("text")).otherwise(F.concat(F.lit("<client>meta</client>\n<query>"), F.col("text"), F.when(F.col("turn") % 3 == 1, "\n</query> more").otherwise(""), F.lit("</query>")))
    return t("conversations").select("conv_id", "turn", F.when(wrapped.contains("<query>"), F.regexp_extract(wrapped, r"(?s)<query>(.*)</query>", 1)).otherwise(wrapped).alias("query"))

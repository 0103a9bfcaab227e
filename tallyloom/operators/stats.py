"""Usage, latency and cost statistics over a request log. Windows include both ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scope
from ..streaming.metrics import materialized

UNREGISTERED = "(unregistered)"


def window(log: DataFrame, since: str | None, until: str | None) -> DataFrame:
    """Rows with since <= ts <= until; an empty bound is open. The bounds reach the scan."""
    if since:
        log = log.where(F.col("ts") >= F.lit(since).cast("timestamp"))
    if until:
        log = log.where(F.col("ts") <= F.lit(until).cast("timestamp"))
    return log


def _blocked() -> Column:
    return scope.is_blocked(F.col("action"), F.col("status_code"))


def _local() -> Column:
    return scope.is_local_route(F.col("action"))


def _tokens() -> Column:
    return F.col("prompt_tokens") + F.col("completion_tokens")


def with_label(log: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds label: an alias stands for its first enabled member, other rows for provider/model."""
    head = aliases.where("enabled").groupBy(F.lower("alias").alias("_alias")).agg(F.min_by(F.concat_ws("/", "head_provider", "head_model"), "priority").alias("_head"))
    joined = log.join(head, F.lower(scope.norm("model")) == F.col("_alias"), "left")
    return joined.withColumn("label", F.coalesce("_head", scope.label(F.col("provider"), F.col("model")))).drop("_alias", "_head")


def with_key_name(log: DataFrame, keys: DataFrame) -> DataFrame:
    """key_name becomes the key's present name where it has one, else the trimmed one of the row."""
    names = keys.select("key_id", F.col("name").alias("_name"))
    return log.join(names, "key_id", "left").withColumn("key_name", F.coalesce(F.nullif(scope.norm("_name"), F.lit("")), scope.norm("key_name"))).drop("_name")


def overview(log: DataFrame) -> DataFrame:
    """One row of totals; the mean duration is of rows with one, cut to an integer, 0 without any."""
    some = F.col("duration_ms") > 0
    mean = F.sum(F.when(some, F.col("duration_ms"))) / F.count_if(some)
    return log.agg(
        F.count("*").alias("total"),
        F.count_if(_blocked()).alias("blocked"),
        F.count_if(_local()).alias("local_routed"),
        F.count_distinct(F.nullif(scope.norm("client_ip"), F.lit(""))).alias("active_ips"),
        F.coalesce(F.floor(mean), F.lit(0)).cast("long").alias("avg_duration_ms"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"),
        F.coalesce(F.sum(scope.clipped("cached_tokens")), F.lit(0)).alias("cached_tokens"),
    )


def _group_measures() -> list[Column]:
    return [
        F.count("*").alias("calls"),
        F.sum(_tokens()).alias("tokens"),
        F.count_if(_blocked()).alias("blocked"),
        F.count_if(_local()).alias("local_routed"),
        F.count_if(F.col("status_code") >= 500).alias("errors"),
    ]


def group(log: DataFrame, dim: str) -> DataFrame:
    """Calls, tokens, blocked, local and server errors by one column; an empty provider is left out, others are (unknown)."""
    rows = log.where(scope.norm("provider") != "") if dim == "provider" else log
    return rows.groupBy(scope.or_unknown(dim).alias("label")).agg(*_group_measures())


def key_tier(log: DataFrame) -> DataFrame:
    """Per named key: calls, blocks, local routes and violations (either, once)."""
    return log.where(scope.norm("key_name") != "").groupBy("key_name").agg(
        F.count("*").alias("calls"),
        F.count_if(_blocked()).alias("blocks"),
        F.count_if(_local()).alias("locals"),
        F.count_if(_blocked() | _local()).alias("violations"),
    )


def key_model(labelled: DataFrame, top: int) -> DataFrame:
    """Tokens and calls by key and label of the top keys by tokens; pairs without tokens are left out."""
    pairs = labelled.where(scope.norm("key_name") != "").groupBy("key_name", "label").agg(F.sum(_tokens()).alias("tokens"), F.count("*").alias("calls")).where("tokens > 0")
    totals = pairs.groupBy("key_name").agg(F.sum("tokens").alias("key_tokens")).orderBy(F.desc("key_tokens"), "key_name").limit(top)
    return pairs.join(totals, "key_name")


def billing(labelled: DataFrame, *by: str) -> DataFrame:
    """Token sums by the given columns; caches are clipped row by row."""
    return labelled.groupBy(*by).agg(
        F.sum("prompt_tokens").alias("prompt"),
        F.sum("completion_tokens").alias("completion"),
        F.sum(scope.clipped("cached_tokens")).alias("cached"),
        F.sum(scope.clipped("cache_creation_tokens")).alias("creation"),
        F.count("*").alias("calls"),
    )


def with_billing_key(labelled: DataFrame) -> DataFrame:
    return labelled.withColumn("key_name", F.when(scope.norm("key_name") == "", UNREGISTERED).otherwise(scope.norm("key_name")))


def with_day(labelled: DataFrame) -> DataFrame:
    return labelled.withColumn("day", F.date_format(scope.local_time(F.col("ts")), "yyyy-MM-dd"))


def priced(billed: DataFrame, prices: DataFrame, local_provider: str = "local") -> DataFrame:
    """Adds cost, priced and cached_at_full. Prices are per million tokens; creation comes on top of the prompt.

    A label without a price costs nothing: it is priced where its provider is the local one, else unpriced.
    """
    rows = billed.join(prices, "label", "left")
    cached_price = F.when(F.coalesce("price_cached", F.lit(0.0)) > 0, F.col("price_cached")).otherwise(F.col("price_in"))
    cost = (
        (F.col("prompt") - F.col("cached")) / F.lit(1e6) * F.col("price_in")
        + F.col("cached") / F.lit(1e6) * cached_price
        + F.col("creation") / F.lit(1e6) * F.col("price_in")
        + F.col("completion") / F.lit(1e6) * F.col("price_out")
    )
    local = F.substring_index("label", "/", 1) == local_provider
    return rows.select(
        *billed.columns,
        F.coalesce(cost, F.lit(0.0)).alias("cost"),
        (F.col("price_in").isNotNull() | local).alias("priced"),
        (F.col("price_in").isNotNull() & (F.col("cached") > 0) & (F.coalesce("price_cached", F.lit(0.0)) <= 0)).alias("cached_at_full"),
    )


def model_spend(priced_rows: DataFrame) -> DataFrame:
    """Cost, tokens and cost per million tokens of priced labels."""
    rows = priced_rows.where("priced").groupBy("label").agg(F.sum("cost").alias("cost"), F.sum(F.col("prompt") + F.col("completion")).alias("tokens"))
    return rows.withColumn("rate_per_1m", F.coalesce(F.try_divide(F.col("cost"), F.col("tokens")) * 1e6, F.lit(0.0)))


def percentiles(log: DataFrame, column: str = "gateway_internal_ms") -> DataFrame:
    """Nearest-rank p50, p95 and p99 over values above 0; null without any."""
    rows = log.where(F.col(column) > 0)
    return rows.agg(F.count("*").alias("n"), *(F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {column})").cast("double").alias(f"p{p}") for p in (50, 95, 99)))


def placed_values(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, value, _c (rows with it), n (rows of the group) and _end (rows up to it in ascending order).

    Different values are dealt by ranges, so that a group of any size is placed by many tasks: within a range by a window, with the counts of the ranges before added.
    """
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("_c"))
    dealt = materialized(counts.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()))
    w = Window.partitionBy(*by)
    ranges = dealt.groupBy(*by, "_part").agg(F.sum("_c").alias("_sum"))  # a row for each range and group
    ranges = ranges.withColumn("n", F.sum("_sum").over(w)).withColumn("_before", F.sum("_sum").over(w.orderBy("_part")) - F.col("_sum")).drop("_sum")
    ranges = ranges.select(*(F.col(c).alias(f"_of_{k}") for k, c in enumerate([*by, "_part"])), "n", "_before")
    same = [F.col(c).eqNullSafe(F.col(f"_of_{k}")) for k, c in enumerate([*by, "_part"])]
    placed = dealt.withColumn("_at", F.sum("_c").over(Window.partitionBy(*by, "_part").orderBy(value))).join(ranges, same)
    return placed.select(*by, value, "_c", "n", (F.col("_at") + F.col("_before")).alias("_end"))


def ranked_percentile(rows: DataFrame, value: str, by: list[str], rank: Column) -> DataFrame:
    """by, n and the value whose place in ascending order within by (from 0) is rank, an expression over n."""
    at = F.greatest(F.least(rank, F.col("n") - 1), F.lit(0))
    return placed_values(rows, value, by).where((F.col("_end") > at) & (F.col("_end") - F.col("_c") <= at)).drop("_c", "_end")


def peak_per_minute(log: DataFrame, *by: str) -> DataFrame:
    minutes = log.groupBy(*by, F.date_trunc("minute", "ts").alias("minute")).agg(F.count("*").alias("calls"))
    return minutes.groupBy(*by).agg(F.max("calls").alias("peak"), F.sum("calls").alias("calls"))


def summary_groups(labelled: DataFrame) -> DataFrame:
    """The groupings of the summary page in one pass: kind is key, provider, label or rule."""
    rows = labelled.select(scope.norm("key_name").alias("key"), scope.norm("provider").alias("provider"), F.col("label").alias("model"), scope.norm("blocked_reason").alias("rule"), "action", "status_code", "prompt_tokens", "completion_tokens")
    sets = rows.groupingSets([["key"], ["provider"], ["model"], ["rule"]], "key", "provider", "model", "rule").agg(
        F.grouping_id("key", "provider", "model", "rule").alias("gid"), *_group_measures()
    )
    kinds = {7: "key", 11: "provider", 13: "model", 14: "rule"}
    kind = F.coalesce(*(F.when(F.col("gid") == g, F.lit(k)) for g, k in kinds.items()))
    out = sets.select(kind.alias("kind"), F.coalesce("key", "provider", "model", "rule").alias("label"), "calls", "tokens", "blocked", "local_routed", "errors")
    return out.where((F.col("label") != "") & (F.col("label") != scope.UNKNOWN))


_SUMS = ("calls", "tokens", "prompt", "completion", "cached", "creation", "blocked", "local_routed", "errors")


def summary(labelled: DataFrame, since: str, until: str, n: int, top: int, keys: DataFrame, providers: DataFrame) -> DataFrame:
    """The whole statistics page from one scan of the window: part, k1, k2 and the same measures in every part.

    part: overview (also active_ips and avg_ms), key, provider, model, rule (k1: the label), series (k1: bucket of n, k2: its label; empty ones
    too), key_model (the top keys by tokens, pairs with tokens), billing (key, label) and daily (display day, label). keys (name) and
    providers (provider) are the registered ones: rows of others count in neither key, provider, model nor bill; an empty list registers all.
    """
    spark = labelled.sparkSession
    some = lambda c: scope.norm(c)
    listed = lambda df, c, name: F.broadcast(df.select(some(c).alias(f"_{name}")).where(F.col(f"_{name}") != "").distinct().withColumn(f"_is_{name}", F.lit(True)))  # settings, a few rows
    known_keys, known_providers = listed(keys, "name", "key"), listed(providers, "provider", "provider")
    all_keys, all_providers = known_keys.isEmpty(), known_providers.isEmpty()
    rows = window(labelled, since, until)
    rows = rows.join(known_keys, some("key_name") == F.col("_key"), "left").join(known_providers, some("provider") == F.col("_provider"), "left")
    key_ok = F.lit(all_keys) | F.coalesce("_is_key", F.lit(False))
    provider_ok = (some("provider") != "") & (F.lit(all_providers) | F.coalesce("_is_provider", F.lit(False)))
    begin, end = (F.unix_timestamp(F.lit(x).cast("timestamp")) for x in (since, until))
    span = F.greatest(end - begin, F.lit(n))
    idx = F.floor((F.unix_timestamp("ts") - begin) / (span / n)).cast("long")
    flat = rows.select(
        F.nullif(some("client_ip"), F.lit("")).alias("ip"),
        F.when(key_ok, scope.or_unknown("key_name")).alias("key"),
        F.when(provider_ok, some("provider")).alias("provider"),
        F.when(provider_ok, F.col("label")).alias("model"),
        scope.or_unknown("blocked_reason").alias("rule"),
        F.when(idx < n, idx).alias("idx"),
        F.when(key_ok, F.when(some("key_name") == "", UNREGISTERED).otherwise(some("key_name"))).alias("bill_key"),
        F.when(key_ok, F.date_format(scope.local_time(F.col("ts")), "yyyy-MM-dd")).alias("day"),
        F.col("label").alias("bill_label"),
        F.lit(1).cast("long").alias("calls"), _tokens().alias("tokens"), F.col("prompt_tokens").alias("prompt"), F.col("completion_tokens").alias("completion"),
        scope.clipped("cached_tokens").alias("cached"), scope.clipped("cache_creation_tokens").alias("creation"),
        _blocked().cast("long").alias("blocked"), _local().cast("long").alias("local_routed"), (F.col("status_code") >= 500).cast("long").alias("errors"),
        F.when(F.col("duration_ms") > 0, F.col("duration_ms")).alias("ms"),
    )
    columns = ["ip", "key", "provider", "model", "rule", "idx", "bill_key", "day", "bill_label"]
    grains = {"overview": [], "ips": ["ip"], "key": ["key"], "provider": ["provider"], "model": ["model"], "rule": ["rule"], "series": ["idx"], "billing": ["bill_key", "bill_label"], "daily": ["day", "bill_label"]}
    measures = [*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _SUMS), F.coalesce(F.sum("ms"), F.lit(0)).alias("ms"), F.count("ms").alias("with_ms")]
    sets = flat.groupingSets(list(grains.values()), *columns).agg(F.grouping_id(*columns).alias("gid"), *measures)
    number = {name: sum(1 << (len(columns) - 1 - k) for k, c in enumerate(columns) if c not in of) for name, of in grains.items()}
    part = F.coalesce(*(F.when(F.col("gid") == g, F.lit(name)) for name, g in number.items()))
    first = F.coalesce(*(F.when(F.col("gid") == number[name], F.col(of[0]).cast("string")) for name, of in grains.items() if of))
    found = sets.select(part.alias("part"), first.alias("k1"), "bill_label", *_SUMS, "ms", "with_ms").where((F.col("part") == "overview") | F.col("k1").isNotNull())
    # addresses are counted by their rows; the other parts stay as they are
    zero = [F.lit(0).cast("long").alias(c) for c in (*_SUMS, "ms", "with_ms", "active_ips")]
    at_ip = F.col("part") == "ips"
    kept = found.select(
        F.when(at_ip, "overview").otherwise(F.col("part")).alias("part"), F.when(~at_ip, F.col("k1")).alias("k1"), F.col("bill_label").alias("k2"),
        *(F.when(at_ip, 0).otherwise(F.col(c)).alias(c) for c in (*_SUMS, "ms", "with_ms")), at_ip.cast("long").alias("active_ips"),
    )
    ticks = spark.range(n).select(F.lit("series").alias("part"), F.col("id").cast("string").alias("k1"), F.lit(None).cast("string").alias("k2"), *zero)
    nothing = spark.range(1).select(F.lit("overview").alias("part"), F.lit(None).cast("string").alias("k1"), F.lit(None).cast("string").alias("k2"), *zero)
    parts = kept.unionByName(ticks).unionByName(nothing).groupBy("part", "k1", "k2").agg(*(F.sum(c).alias(c) for c in (*_SUMS, "ms", "with_ms", "active_ips")))
    # billing rows are pairs of registered keys and labels; of the top keys those with tokens come once more as key_model
    pair = (F.col("part") == "billing") & (F.col("tokens") > 0)
    parts = parts.withColumn("_of_key", F.sum(F.when(pair, F.col("tokens"))).over(Window.partitionBy("part", "k1")))
    parts = parts.withColumn("_place", F.when(pair, F.dense_rank().over(Window.partitionBy("part", pair).orderBy(F.desc("_of_key"), "k1"))))
    both = F.when(F.col("_place") <= top, F.array(F.lit("billing"), F.lit("key_model"))).otherwise(F.array("part"))
    start = F.timestamp_seconds(begin + F.floor(F.col("k1").try_cast("long") * (span / n)))
    label = F.when(span <= 26 * 3600, F.date_format(scope.local_time(start), "HH:mm")).otherwise(F.date_format(scope.local_time(start), "MM-dd HH:mm"))
    return parts.select(
        F.explode(both).alias("part"), "k1", F.when(F.col("part") == "series", label).otherwise(F.col("k2")).alias("k2"), *_SUMS, "active_ips",
        F.coalesce(F.floor(F.try_divide("ms", "with_ms")), F.lit(0)).cast("long").alias("avg_ms"),
    )


def fuzzy_keys(keys: DataFrame, patterns: DataFrame, least: int = 14) -> DataFrame:
    """key_id and pattern of all keys (key_id, key_value, of at least so many characters) that begin and end as a pattern "head***tail" does.

    The patterns' (head, tail) lengths are few, as both are shorter than a key; a key is joined by equality once for each of them.
    """
    head, tail = F.split_part("pattern", F.lit("***"), F.lit(1)), F.split_part("pattern", F.lit("***"), F.lit(2))
    cut = patterns.where(F.col("pattern").contains("***")).select("pattern", head.alias("_head"), tail.alias("_tail")).distinct()
    shapes = cut.select(F.length("_head").alias("a"), F.length("_tail").alias("b")).distinct().collect()  # pairs of lengths
    if not shapes:
        return keys.select("key_id", F.lit("").alias("pattern")).limit(0)
    ends = F.explode(F.array(*(F.struct(F.left("key_value", F.lit(s["a"])).alias("_head"), F.right("key_value", F.lit(s["b"])).alias("_tail")) for s in shapes)))
    each = keys.where(F.length("key_value") >= least).select("key_id", ends.alias("_e")).select("key_id", "_e.*").distinct()
    return each.join(cut, ["_head", "_tail"]).select("key_id", "pattern")


def histogram(log: DataFrame, column: str, bounds: list[int]) -> DataFrame:
    """Cumulative counts by upper bound, +Inf last; every bound has a row."""
    values = log.where(F.col(column) > 0)
    each = values.select(F.explode(F.array(*(F.struct(F.lit(str(b)).alias("le"), (F.col(column) <= b).cast("long").alias("n")) for b in bounds), F.struct(F.lit("+Inf").alias("le"), F.lit(1).cast("long").alias("n")))).alias("x"))
    return each.groupBy("x.le").agg(F.sum("x.n").alias("cumulative"))


def top_k(rows: DataFrame, by: str, tie: str, k: int) -> DataFrame:
    return rows.orderBy(F.desc(by), tie).limit(k)

"""Predicates and derived columns of requests and decisions. All are Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "(unknown)"
DEFAULT_RULES = ("default_allow", "默认放行")
DISPLAY_HOURS = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once and bind it in body; the optimizer would put it into every lambda call of body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def norm(c: Column | str) -> Column:
    """Null becomes empty; white space of any kind goes from both ends."""
    return F.regexp_replace(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), r"^\s+|\s+$", "")


def is_blocked(action: Column, status: Column) -> Column:
    return F.lower(norm(action)).startswith("block") | (F.coalesce(status, F.lit(0)) == 403)


def is_local_route(action: Column) -> Column:
    return F.lower(norm(action)) == "route_local"


def is_abnormal(action: Column, status: Column) -> Column:
    """Blocked or routed to local; for suggestions, never for display."""
    return is_blocked(action, status) | is_local_route(action)


def resolve_action(status: Column, reason: Column) -> Column:
    return F.when(F.coalesce(status, F.lit(0)) == 403, "block").when(norm(reason) != "", "route_local").otherwise("allow")


def infer_status(action: Column, rule: Column) -> Column:
    a = F.lower(norm(action))
    local = a == "route_local"
    return (
        F.when(a.startswith("block") | (rule == "egress_denied"), 403)
        .when(local & F.coalesce(rule.contains("fallback"), F.lit(False)), 502)
        .when(a.isin("allow", "route_local"), 200)
        .otherwise(0)
    )


def entry_status(status: Column, action: Column, rule: Column) -> Column:
    """The recorded status where there is a positive one, else what action and rule imply."""
    return F.when(status > 0, status).otherwise(infer_status(action, rule))


def entry_blocked(action: Column, rule: Column) -> Column:
    return is_blocked(action, infer_status(action, rule))


def label(provider: Column, model: Column) -> Column:
    """provider/model, without a provider prefix that the model repeats; (unknown) where both are empty."""
    p, m = norm(provider), norm(model)
    bare = F.when((p != "") & m.startswith(F.concat(p, F.lit("/"))), F.substring(m, F.length(p) + 2, F.length(m))).otherwise(m)
    return F.when((p != "") & (bare != ""), F.concat_ws("/", p, bare)).when(bare != "", bare).when(p != "", p).otherwise(UNKNOWN)


def or_unknown(c: str) -> Column:
    return F.when(norm(c) == "", UNKNOWN).otherwise(norm(c))


def clipped(tokens: str, prompt: str = "prompt_tokens") -> Column:
    """Cached tokens never count beyond the prompt or below zero."""
    return F.least(F.greatest(F.coalesce(tokens, F.lit(0)), F.lit(0)), F.greatest(F.coalesce(prompt, F.lit(0)), F.lit(0)))


def local_time(ts: Column) -> Column:
    """UTC as displayed: eight hours later."""
    return ts + F.expr(f"INTERVAL {DISPLAY_HOURS} HOURS")


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def display_time(raw: Column) -> Column:
    """A time string in display time; a string that is no time stays as it is."""
    return F.coalesce(stamp(local_time(F.try_to_timestamp(raw))), raw)


def mask_key(key: Column) -> Column:
    return F.when(F.length(key) <= 8, "***").otherwise(F.concat(F.left(key, F.lit(3)), F.lit("***"), F.right(key, F.lit(4))))


def status_class(status: Column) -> Column:
    c = F.floor(status / 100)
    return F.when(status.isNull() | (status == 0), "unknown").when(c.between(1, 5), F.concat(c.cast("string"), F.lit("xx"))).otherwise("other")


def classify_failure(status: Column, message: Column) -> Column:
    return F.when((status == 400) & F.lower(message).rlike("context length|maximum context|too many tokens|context window"), "overflow").otherwise("error")


def shadow_mismatch(label_: Column, shadow: Column, degraded: Column) -> Column:
    known = shadow.isin("CONFIDENTIAL", "NORMAL")
    return F.coalesce(known, F.lit(False)) & ~F.coalesce(degraded, F.lit(False)) & ~label_.eqNullSafe(shadow)


def source_trim(text: Column) -> Column:
    t = norm(text)
    return F.when(F.length(t) > 2500, F.concat(F.left(t, F.lit(1500)), F.lit("\n…\n"), F.right(t, F.lit(1000)))).otherwise(t)


def chunks(text: Column, size: int, most: int) -> Column:
    """Fixed windows of a text, at most so many; none for an empty text."""
    n = F.least(F.ceil(F.length(text) / size), F.lit(most)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def token_cap(asked: Column, default: int, cap: int) -> Column:
    value = F.when(F.coalesce(asked, F.lit(0)) <= 0, default).otherwise(asked)
    return F.least(value, F.lit(cap)) if cap else value


def one_space(text: Column) -> Column:
    """The text with its white space collapsed; null: empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def text_hash(text: Column) -> Column:
    """sha1 of the text with its white space collapsed."""
    return F.sha1(one_space(text))


def csv_guard(c: Column) -> Column:
    """A leading formula sign gets a quote before it."""
    return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def windows(text: Column, size: int, most: Column, start: int = 0) -> Column:
    """Pieces of size characters from start on: all of them, or most of them spread evenly with the first and the last; of one, the last."""
    n = F.greatest(F.ceil((F.length(text) - start) / size), F.lit(0)).cast("int")
    spread = F.when(most < 2, F.array(n - 1)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(most - 1, F.lit(1))), lambda i: F.bround(i * (n - 1) / (most - 1), 0).cast("int"))))
    every = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    places = F.when(most < 1, F.array().cast("array<int>")).when(n <= most, every).otherwise(spread)
    return F.transform(places, lambda i: F.substring(text, i * size + start + 1, F.lit(size)))


def blocks(last: Column, tool: Column, before: Column, size: int, budget: int, most: int = 5) -> Column:
    """What a second classifier sees of a conversation (name, text): the last user text, never cut by the budget; the tool result's
    head and the tail of the user text before while the budget lasts (0: no limit); then windows of the last user text beyond its first piece."""
    part = lambda name, text: F.struct(F.lit(name).alias("name"), F.trim(text).alias("text"))

    def add(acc: Column, x: Column) -> Column:
        n = F.length(x["text"])
        fits = (n > 0) & (F.size(acc["out"]) < most) & (F.lit(budget <= 0) | (x["name"] == "last_user") | (acc["used"] + n <= budget))
        used = acc["used"] + F.when(x["name"] == "last_user", 0).otherwise(n)
        return F.when(fits, F.struct(used.alias("used"), F.concat(acc["out"], F.array(x)).alias("out"))).otherwise(acc)

    zero = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<name:string,text:string>>").alias("out"))
    single = F.array(part("last_user", F.left(last, F.lit(size))), part("tool", F.left(tool, F.lit(size))), part("history", F.right(before, F.lit(size))))
    first = F.aggregate(single, zero, add)
    rest = lambda now: F.transform(windows(last, size, most - F.size(now["out"]), size), lambda x: part("long_text", x))
    return F.element_at(F.transform(F.array(first), lambda now: F.aggregate(rest(now), now, add)["out"]), 1)

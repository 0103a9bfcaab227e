"""What JSON bodies and stream events of model providers say: usage, model, provider, tools. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters of a body that is looked into at most, characters of a tool.
BODY_CHARS, TOOL_CHARS = 1_000_000, 4000


def _number(usage: Column, *names: str) -> Column:
    """The first of some fields that is a whole number above 0; 0 without any."""
    found = (F.get_json_object(usage, f"$.{n}").try_cast("bigint") for n in names)
    return F.coalesce(*(F.when(x > 0, x) for x in found), F.lit(0).cast("long"))


def _clipped(tokens: Column, prompt: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(F.coalesce(tokens, F.lit(0).cast("long")), prompt))


def usage(text: Column) -> Column:
    """prompt, completion, cached and creation of a usage object in JSON, by the names of either family; caches never count beyond the prompt.

    Missing, negative and malformed numbers are 0; a text that is no object has four zeros.
    """
    whole = lambda path: F.get_json_object(text, f"$.{path}").try_cast("bigint")
    prompt = _number(text, "prompt_tokens", "input_tokens")
    cached = F.coalesce(F.nullif(whole("prompt_tokens_details.cached_tokens"), F.lit(0).cast("long")), whole("cache_read_input_tokens"))
    return F.struct(
        prompt.alias("prompt"),
        _number(text, "completion_tokens", "output_tokens").alias("completion"),
        _clipped(cached, prompt).alias("cached"),
        _clipped(whole("cache_creation_input_tokens"), prompt).alias("creation"),
    )


def event_usage(event: Column) -> Column:
    """usage and only_usage (no choices in it) of a stream's event; null unless the JSON of its first data line has usage with both sides."""
    line = F.trim(F.regexp_extract(event, r"(?m)^data:(.*)$", 1))
    of = F.get_json_object(line, "$.usage")
    keys = F.coalesce(F.json_object_keys(of), F.array().cast("array<string>"))
    both = F.arrays_overlap(keys, F.array(F.lit("prompt_tokens"), F.lit("input_tokens"))) & F.arrays_overlap(keys, F.array(F.lit("completion_tokens"), F.lit("output_tokens")))
    found = usage(of)
    only = F.coalesce(F.get_json_object(line, "$.choices") == "[]", F.lit(False))
    return F.when(both, F.struct(*(found[n].alias(n) for n in ("prompt", "completion", "cached", "creation")), only.alias("only_usage")))


def _peeked(body: Column, *paths: str) -> Column:
    """The first of some fields that isn't empty, of a JSON object of at most BODY_CHARS characters; empty without any."""
    whole = F.when((F.length(body) <= BODY_CHARS) & F.json_object_keys(body).isNotNull(), body)
    return F.coalesce(*(F.nullif(F.get_json_object(whole, f"$.{p}"), F.lit("")) for p in paths), F.lit(""))


def model(body: Column) -> Column:
    return _peeked(body, "model")


def provider(body: Column) -> Column:
    """Where an answer came from: as the gateway notes it, or as an error reports it."""
    return _peeked(body, "gateway.provider", "detail.provider", "error.provider")


def capped(values: Column, most: int) -> Column:
    """A list's first values and, if it is longer, how many more there are."""
    more = F.array(F.concat(F.lit("+"), (F.size(values) - most).cast("string")))
    return F.when(F.size(values) > most, F.concat(F.slice(values, 1, most), more)).otherwise(values)


def tools_text(tools: Column) -> Column:
    """Each tool as JSON, cut, one in a line."""
    return F.array_join(F.transform(tools, lambda x: F.substring(F.to_json(x), 1, TOOL_CHARS)), "\n")

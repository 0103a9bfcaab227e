"""The rule language compiled to one Column.

A rule has a name, a priority, an action and a ``when``: "always", one condition, or {"any": [...]} or {"all": [...]} of
conditions. A condition is {"<field> <operator>": value}; only its first entry counts. Rules are tried by priority
(ties in the order given); the first that is true decides, else default_allow does. CASE WHEN is exactly that.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

ACTIONS = ("allow", "route_local", "block")
DEFAULT = "default_allow"


@dataclass(frozen=True)
class Rule:
    name: str
    action: str
    when: Any
    priority: int = 100

    def __post_init__(self) -> None:
        if self.action not in ACTIONS:
            raise ValueError(f"{self.name}: unknown action {self.action}")
        if not 0 <= self.priority <= 1000:
            raise ValueError(f"{self.name}: priority {self.priority} is not in 0..1000")
        for c in conditions(self.when):
            if not isinstance(c, Mapping) or {"any", "all"} & set(c):
                raise ValueError(f"{self.name}: groups can't be nested")


def conditions(when: Any) -> list[Any]:
    if when == "always":
        return []
    if isinstance(when, Mapping) and ("any" in when or "all" in when):
        return list(when["any"] if "any" in when else when["all"])
    return [when]


Field = Callable[[str], Column | None]


def _text(c: Column | None) -> Column:
    """As text; a missing field reads "None", as it does in the language."""
    return F.lit("None") if c is None else F.coalesce(c.cast("string"), F.lit("None"))


def _listed(value: Any) -> list[str]:
    return [str(v) for v in value] if isinstance(value, list) else [v.strip() for v in str(value).split(",") if v.strip()]


def _contains_any(hay: Column, needles: list[str]) -> Column:
    low = F.lower(hay)
    return reduce(lambda a, b: a | b, (low.contains(n.lower()) for n in needles), F.lit(False))


def condition(cond: Mapping[str, Any], field: Field, copies: Mapping[str, Column]) -> Column:
    """One condition; copies gives, for a field, a second normalized column that text operators also try."""
    key, value = next(iter(cond.items()))
    for op in ("!=", " not_in", "==", " in", "contains_any", "matches_regex", ">=", "<=", ">", "<"):
        if op in key and not (op == " in" and not re.search(r" in\s*$", key)):
            break
    else:
        return F.lit(False)
    name = key.split(op)[0].strip()
    c = field(name)
    also = copies.get(name)
    if op in ("==", "!="):
        same = (F.lit(value is None) if c is None else c.eqNullSafe(F.lit(value)))
        return ~same if op == "!=" else same
    if op == " not_in":
        return ~F.trim(F.lower(_text(c))).isin([v.strip().lower() for v in _listed(value)])
    if op == " in":
        if not isinstance(value, list):
            return F.lit(str(value)).contains(_text(c))
        exact = F.lower(_text(c)).isin([str(v).lower() for v in value])
        return exact if name == "file.ext" else exact | _contains_any(_text(c), [str(v) for v in value])
    if op == "contains_any":
        hit = _contains_any(_text(c), _listed(value))
        return hit | _contains_any(_text(also), _listed(value)) if also is not None else hit
    if op == "matches_regex":
        find = lambda x: F.coalesce(x.cast("string"), F.lit("")).rlike(value)
        hit = F.lit(False) if c is None else find(c)
        return hit | find(also) if also is not None else hit
    number = F.lit(None).cast("double") if c is None else c.try_cast("double")
    test = {">=": number >= float(value), "<=": number <= float(value), ">": number > float(value), "<": number < float(value)}[op]
    return F.coalesce(test, F.lit(False))


def matches(when: Any, field: Field, copies: Mapping[str, Column] | None = None) -> Column:
    if when == "always":
        return F.lit(True)
    parts = [condition(c, field, copies or {}) for c in conditions(when)]
    if isinstance(when, Mapping) and "any" not in when and "all" in when:
        return reduce(lambda a, b: a & b, parts, F.lit(True))
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def decide(rules: list[Rule], field: Field, copies: Mapping[str, Column] | None = None) -> Column:
    """Struct of rule, action and priority of the first rule that is true."""
    verdict = lambda n, a, p: F.struct(F.lit(n).alias("rule"), F.lit(a).alias("action"), F.lit(p).alias("priority"))
    out: Column | None = None
    for r in sorted(rules, key=lambda r: r.priority):
        test, then = matches(r.when, field, copies), verdict(r.name, r.action, r.priority)
        out = F.when(test, then) if out is None else out.when(test, then)
    last = verdict(DEFAULT, "allow", 100)
    return last if out is None else out.otherwise(last)


def rules_of(document: Any) -> list[Rule]:
    """Rules of a parsed document, {"policies": [...]} or the list alone, by priority. A rule without name, action or when, or one that Rule refuses, is an error."""
    listed = document.get("policies") if isinstance(document, Mapping) else document
    if not isinstance(listed, list):
        raise ValueError("no list of policies")
    made = []
    for n, entry in enumerate(listed):
        if not isinstance(entry, Mapping) or not entry.get("name") or "when" not in entry or "action" not in entry:
            raise ValueError(f"policy {n}: name, action and when are needed")
        made.append(Rule(str(entry["name"]), entry["action"], entry["when"], entry.get("priority", 100)))
    return sorted(made, key=lambda r: r.priority)


def load(path: str, last: list[Rule] | None = None) -> list[Rule]:
    """Rules of a YAML (or JSON, which is YAML) file. No file: all is allowed. A broken file: last, the rules in force, or the error where there are none."""
    import yaml  # only this reader needs it

    try:
        with open(path, encoding="utf-8") as f:
            return rules_of(yaml.safe_load(f) or {})
    except FileNotFoundError:
        return [Rule(DEFAULT, "allow", "always", 100)]
    except (ValueError, TypeError, yaml.YAMLError):
        if last is None:
            raise
        return last


def l2_decision(rule: Column, label: Column, confidence: Column, injection: Column, degraded: Column, least: float = 0.7) -> Column:
    """What a second classifier changes; the order counts."""
    return F.when((label == "CONFIDENTIAL") & (confidence >= least), "l2_confidential").when(injection, "l2_injection").when(degraded, "l2_unavailable").otherwise(rule)


def merge_chunks(chunks: Column) -> Column:
    """One judgement from the first five chunks (label, confidence, degraded, cached, latency)."""
    first = F.slice(chunks, 1, 5)
    secret, bad = F.filter(first, lambda x: x["label"] == "CONFIDENTIAL"), F.filter(first, lambda x: x["degraded"])
    best = F.array_max(F.transform(first, lambda x: F.struct(x["confidence"].alias("confidence"), x["label"].alias("label"), x["degraded"].alias("degraded"))))
    pick = F.when(F.size(secret) > 0, F.struct(secret[0]["confidence"].alias("confidence"), secret[0]["label"].alias("label"), secret[0]["degraded"].alias("degraded"))).when(
        F.size(bad) > 0, F.struct(bad[0]["confidence"].alias("confidence"), bad[0]["label"].alias("label"), F.lit(True).alias("degraded"))
    ).otherwise(best)
    return F.struct(pick["label"].alias("label"), pick["confidence"].alias("confidence"), pick["degraded"].alias("degraded"), F.forall(first, lambda x: x["cached"]).alias("cached"), F.array_max(F.transform(first, lambda x: x["latency"])).alias("latency"))


_FORM = {"equals": "==", "differs": "!=", "in": "in", "not_in": "not_in", "contains": "contains_any", "regex": "matches_regex", "at_least": ">=", "at_most": "<=", "over": ">", "under": "<"}


def build_when(rows: list[Mapping[str, Any]], combiner: str = "any") -> Any:
    """A form's rows (field, test, value) as a ``when``. An hour span over midnight becomes two conditions of an any."""
    if not rows:
        return "always"
    made: list[dict[str, Any]] = []
    for r in rows:
        if r["test"] == "hours":
            start, end = r["value"]
            if start > end and combiner == "all" and len(rows) > 1:
                raise ValueError("a span over midnight can't be part of an all")
            combiner = "any" if start > end else "all" if len(rows) == 1 else combiner
            made += [{f"{r['field']} >=": start}, {f"{r['field']} <": end}]
        else:
            op, value = _FORM[r["test"]], r["value"]
            made.append({f"{r['field']} {op}" + (f" {value}" if op in ("==", "!=") else ""): value})
    return made[0] if len(made) == 1 else {combiner: made}


def parse_when(when: Any) -> tuple[str, list[dict[str, Any]]]:
    """The form's combiner and rows of a ``when``; the inverse of build_when, with spans as their two bounds."""
    names = {v: k for k, v in _FORM.items()}
    rows = []
    for c in conditions(when):
        key, value = next(iter(c.items()))
        field, op = key.split()[:2]
        rows.append({"field": field, "test": names[op], "value": value})
    return ("all" if isinstance(when, Mapping) and "all" in when else "any"), rows

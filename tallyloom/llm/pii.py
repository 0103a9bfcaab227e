"""Personal data by gradient-boosted candidates, in built-in expressions only.

Four strict patterns give the base spans. Looser generators propose further, overlapping candidates: matches that
fail a strict check, digit runs with any separators, national phone numbers, spelled-out mail addresses,
spaced addresses of machines, and opaque strings that may be secrets (a kind of its own, without base spans). Boosted trees over format and context features rank them. What makes a base span one
is masked there: a candidate inside a base span has the context of that span, so no "+" is seen; mail addresses show no sign
for "at"; Luhn and octets are never features. All features are small integers, so the corpus is counted by
feature pattern (at most PATTERNS of them) in one aggregation and the trees are fitted to those counts on the
driver; they come back as CASE expressions.

A threshold per kind is calibrated on scores of trees that were fitted without the candidate's fifth of the documents, over the candidates that
touch no base span, as only those can be added. Whether they are base spans says nothing about them; a witness does that the trees don't see, with a rate among
real ones and a rate by chance: Luhn (1 and a tenth) for cards, octets (1 and 156 of 900 for each group of three digits)
for machines, a private cue word before it (its rate among base spans and among other digit runs) for phones and mail, a secret's name before it or an issuer's
mark at its head (1 and the rate among the candidates below the threshold) for secrets. The
share of real ones follows from the three rates; the lowest score where it is at least PRECISION by Wilson bounds is taken.

Patterns are written with possessive repeats and \\G so that very long runs neither backtrack nor recurse. Work grows little
faster than a text: places are running sums, kept in blocks; base spans are searched by halving; context comes from chunks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialized, quoted

KINDS = ("email", "ip", "card", "phone", "secret")
EMAIL, IP, CARD, PHONE, SECRET = range(5)
BASE_KINDS = KINDS[:SECRET]
FOLDS = 5
PRECISION = 0.97
TREES, RATE, PENALTY = 40, 0.3, 1.0
FEATURES = {"kind": 5, "digits": 8, "groups": 5, "separator": 5, "before": 5, "after": 5, "cue": 3}
PATTERNS = math.prod(FEATURES.values())

_LOCAL = "[A-Za-z0-9._%+-]"
_BASE = {
    EMAIL: rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    IP: r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    CARD: r"[0-9](?:[\x20-]?[0-9])++",
    PHONE: r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Letters, digits and a few signs without a break; a letter and a digit among them.
_OPAQUE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}+"
#: Loose generators: kind (None: by the number of digits) and pattern.
_LOOSE: tuple[tuple[int | None, str], ...] = (
    (None, r"[0-9](?:[\x20().\-/]{0,3}+[0-9])++"),
    (PHONE, r"(?<![0-9])\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    (IP, r"(?<![0-9.])[0-9]{1,3}\x20?\.\x20?[0-9]{1,3}\x20?\.\x20?[0-9]{1,3}\x20?\.\x20?[0-9]{1,3}(?![0-9])"),
    (EMAIL, rf"(?<!{_LOCAL}){_LOCAL}++\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:(?:\x20?(?:\(dot\)|\[dot\])\x20?|\.)[A-Za-z0-9-]++)++"),
    (SECRET, _OPAQUE),
)
# What stands before a secret, and marks that issuers put at its head.
_NAMED = r"(?i)(?:token|secret|passwd|password|pwd|api[_-]?key|access[_-]?key|auth|bearer|credential)s?[\"']?\s{0,2}[:=]?>?\s{0,2}[\"']?$"
_MARKED = r"^(?:AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|sk-|sk_live_|xox[abprs]-|AIza|eyJ)"
_PRIVATE = r"(?i)(?:tel|phone|call|fax|mobile|mail|contact|card|visa|address|server|host|ip)\b[^0-9@]{0,12}$"
_PUBLIC = r"(?i)(?:version|licen[sc]e|v\.?|isbn|no\.?|release|password|token|key|id)\b[^0-9@]{0,12}$"
#: Chance that a random group of three digits (100 to 999) is at most 255, and that random digits pass the Luhn check.
_OCTET, _LUHN_CHANCE = 156 / 900, 0.1
_CANDIDATE = "array<struct<start:int,end:int,f:array<int>,hit:boolean,apart:boolean,label:boolean,valid:boolean,cue:boolean,trial:boolean,chance:double>>"
_SPAN = "array<struct<start:int,end:int,s:string>>"
_SIZED = "array<struct<start:int,kind:int,end:int>>"
_RAW = "array<struct<start:int,end:int,kind:int,s:string>>"
#: Results that are appended one by one before they are joined to those before.
BLOCK = 256


def _scan(items: Column, first: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """emit(state, item) for each item in turn, step(state, item) being the next state; kind: the type of the array.

    Results are appended within blocks, so that appending does not copy all results before.
    """

    def block(state: Column, part: Column) -> Column:
        zero = F.struct(state.alias("state"), F.array().cast(kind).alias("out"))
        return F.aggregate(part, zero, lambda acc, x: F.struct(step(acc["state"], x).alias("state"), F.concat(acc["out"], F.array(emit(acc["state"], x))).cast(kind).alias("out")))

    def one(acc: Column, i: Column) -> Column:
        return let(block(acc["state"], F.slice(items, i + 1, BLOCK)), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    zero = F.struct(first.alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
    return F.when(F.size(items) == 0, F.array().cast(kind)).otherwise(F.flatten(F.aggregate(F.sequence(F.lit(0), F.size(items) - 1, F.lit(BLOCK)), zero, one)["out"]))


def _found(text: Column, pattern: str) -> Column:
    """start, end (code points, end exclusive) and text of all matches, from the texts between them."""

    def place(m: Column) -> Column:
        pairs = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(m)), m, lambda g, s: F.struct(F.length(g).alias("gap"), s.alias("s")))
        start = lambda at, x: at + x["gap"]
        end = lambda at, x: at + x["gap"] + F.length(x["s"])
        found = lambda p: _scan(p, F.lit(0), end, lambda at, x: F.struct(start(at, x).alias("start"), end(at, x).alias("end"), x["s"].alias("s")), _SPAN)
        return F.when(F.size(m) == 0, F.array().cast(_SPAN)).otherwise(let(pairs, found))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def _chunks(text: Column) -> Column:
    """width and parts of a text: each part has twice the width, so that a short piece lies in one of them whole."""
    width = F.greatest(F.lit(2048), F.ceil(F.length(text) / 512).cast("int"))
    part = lambda w: F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / w).cast("int")), lambda i: F.substring(text, i * w + 1, 2 * w))
    return let(width, lambda w: F.struct(w.alias("width"), part(w).alias("parts")))


def _piece(text: Column, chunks: Column, start: Column, length: Column) -> Column:
    """length code points from start on (from 0), without walking there from the text's start."""
    width = chunks["width"]
    near = F.substring(F.get(chunks["parts"], F.floor(start / width).cast("int")), (start % width).cast("int") + 1, length)
    return F.when(length <= width, near).otherwise(F.substring(text, start + 1, length))


def _ending_after(spans: Column, at: Column) -> Column:
    """The place of the first of the ordered spans that ends after at, by halving; their number if none does."""

    def halve(acc: Column, _: Column) -> Column:
        mid = F.shiftright(acc["lo"] + acc["hi"], 1)
        left = F.get(spans, mid)["end"] > at
        lo, hi = F.when(left, acc["lo"]).otherwise(mid + 1), F.when(left, mid).otherwise(acc["hi"])
        return F.when(acc["lo"] < acc["hi"], F.struct(lo.alias("lo"), hi.alias("hi"))).otherwise(acc)

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi")), halve)["lo"]


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def _valid(kind: int, s: Column) -> Column:
    if kind == IP:
        return F.forall(F.split(s, r"\."), lambda x: F.coalesce(x.try_cast("int") <= 255, F.lit(False)))
    if kind == CARD:
        return let(_digits(s), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False))
    if kind == PHONE:
        return F.length(_digits(s)).between(9, 15)
    return F.lit(True)


def _guard(kind: int | None, text: Column) -> Column:
    """A cheap test that most texts fail, so that the patterns only run over the others."""
    if kind == EMAIL:
        return text.contains("@")
    return text.contains("+") if kind == PHONE else F.col("_digits")


def base_matches(text: Column) -> Column:
    """For each kind the matches of its base pattern (start, end, s), valid or not."""
    return F.array(*(F.when(_guard(k, text), _found(text, _BASE[k])).otherwise(F.array().cast(_SPAN)) for k in range(SECRET)))


def base_spans(matches: Column) -> Column:
    """For each kind its base spans (start, kind, end), ordered and apart from each other; secrets have none."""

    def of(k: int) -> Column:
        valid = F.filter(F.get(matches, F.lit(k)), lambda x: _valid(k, x["s"]))
        return F.transform(valid, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end")))

    return F.array(*map(of, range(SECRET)), F.array().cast("array<struct<start:int,kind:int,end:int>>"))


def _near(char: Column) -> Column:
    return (
        F.when((char == "") | char.rlike(r"^\s$"), 0).when(char.rlike(r"^\p{L}$"), 1).when(char.rlike("^[0-9]$"), 2).when(char == "+", 3).otherwise(4)
    )


def _features(kind: Column, s: Column, before: Column, after: Column, cue: Column) -> list[Column]:
    n = F.length(_digits(s))
    digits = F.when(n < 7, 0).when(n < 9, 1).when(n < 11, 2).when(n < 12, 3).when(n < 15, 4).when(n < 17, 5).when(n < 20, 6).otherwise(7)
    groups = F.least(F.regexp_count(s, F.lit("[0-9]+")), F.lit(4))
    letters = F.when(s.rlike("^[0-9a-f]+$|^[0-9A-F]+$"), 0).when(s.rlike("^[0-9A-Z]+$"), 1).when(s.rlike("^[0-9a-z]+$"), 2).when(s.rlike("^[0-9A-Za-z]+$"), 3).otherwise(4)
    size = F.when(F.length(s) < 20, 0).when(F.length(s) < 32, 1).when(F.length(s) < 41, 2).when(F.length(s) < 65, 3).otherwise(4)
    groups = F.when(kind == SECRET, size).otherwise(groups)
    separator = F.when(kind == SECRET, letters).when(kind == EMAIL, 0).when(s.contains("("), 3).when(s.contains("."), 2).when(s.rlike("[ -]"), 1).when(s.contains("/"), 4).otherwise(0)
    seen = F.when(kind.isin(EMAIL, PHONE, SECRET), 0).otherwise(cue)  # their witness
    return [kind, digits, groups, separator, _near(before), _near(after), seen]


def candidates(text: Column, matches: Column, base: Column) -> Column:
    """Loose candidates: start, end, f (array of features), hit (over a base span of the same kind), apart (touches no base span; a secret: no mail address or machine),
    label (what the trees learn), valid (may be added), cue (a private one before it), trial (the witness can tell) and
    chance (that the witness speaks for a candidate that isn't real; 0 where that is measured).
    """

    def as_raw(found: Column, kind: int | None) -> Column:
        which = F.lit(kind) if kind is not None else None
        by_digits = lambda x: F.when(F.length(_digits(x["s"])) < 12, PHONE).otherwise(CARD)
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), (by_digits(x) if which is None else which).alias("kind"), x["s"].alias("s")))

    def loose(kind: int | None, pattern: str) -> Column:
        guard = (text.contains("(at)") | text.contains("[at]")) if kind == EMAIL else F.col("_digits")
        return F.when(guard, as_raw(_found(text, pattern), kind)).otherwise(F.array().cast(_RAW))

    def described(x: Column, chunks: Column) -> Column:
        k, s, end = x["kind"], x["s"], x["end"]
        over = lambda spans: let(F.get(spans, _ending_after(spans, x["start"]))["start"], lambda a: F.when(a < end, a))
        same = over(F.get(base, k))

        def of(first: Column) -> Column:
            anchor = F.least(x["start"], F.coalesce(first, x["start"]))
            context = _piece(text, chunks, F.greatest(anchor - 24, F.lit(0)), F.least(anchor, F.lit(24)))
            last = F.when(anchor == 0, "").otherwise(_piece(text, chunks, anchor - 1, F.lit(1)))

            def at(c: Column) -> Column:
                cue = F.when(c["context"].rlike(_PRIVATE), 2).when(c["context"].rlike(_PUBLIC), 1).otherwise(0)
                f = F.array(*(v.cast("int") for v in _features(k, s, c["before"], _piece(text, chunks, end, F.lit(1)), cue)))
                secret = c["context"].rlike(_NAMED) | s.rlike(_MARKED)
                threes = F.regexp_count(s, F.lit("(?<![0-9])[1-9][0-9]{2}(?![0-9])"))
                valid = F.when(k == CARD, _valid(CARD, s)).when(k == IP, _valid(IP, F.replace(s, F.lit(" "), F.lit("")))).when(k == SECRET, True).otherwise(cue != 1)
                label = F.when(k.isin(CARD, IP), valid).when(k == SECRET, secret).otherwise(first.isNotNull())
                trial = F.when(k == IP, threes > 0).when(k == CARD, F.length(_digits(s)).between(12, 19)).otherwise(True)
                chance = F.when(k == CARD, _LUHN_CHANCE).when(k == IP, F.pow(F.lit(_OCTET), threes)).otherwise(0.0)
                others = F.when(k == SECRET, F.slice(base, 1, 2)).otherwise(base)  # numbers inside a secret are part of it
                apart = ~F.exists(others, lambda spans: over(spans).isNotNull())
                named = {"start": x["start"], "end": end, "f": f, "hit": first.isNotNull(), "apart": apart, "label": label, "valid": valid, "cue": F.lit(None), "trial": trial, "chance": chance}
                named["cue"] = F.when(k == SECRET, secret).otherwise(cue == 2)
                return F.struct(*(c.alias(n) for n, c in named.items()))

            return let(F.struct(context.alias("context"), last.alias("before")), at)

        return let(same, of)

    enough = lambda x: x["kind"].isin(EMAIL, IP, SECRET) | (F.length(_digits(x["s"])) >= 7)
    again = lambda raw: F.filter(raw, lambda x, i: (i == 0) | ~F.get(raw, i - 1).eqNullSafe(x))
    mails = F.filter(F.get(matches, F.lit(EMAIL)), lambda x: _valid(EMAIL, x["s"]))
    raw = F.concat(as_raw(mails, EMAIL), *(loose(*x) for x in _LOOSE), *(as_raw(F.get(matches, F.lit(k)), k) for k in (IP, CARD, PHONE)))
    raw = let(F.array_sort(F.filter(raw, enough)), again)  # each once
    return let(raw, lambda r: F.when(F.size(r) == 0, F.array().cast(_CANDIDATE)).otherwise(let(_chunks(text), lambda c: F.transform(r, lambda x: described(x, c)))))


class Boosted:
    """Depth-two regression trees for the logistic loss, fitted to counts of feature patterns."""

    def __init__(self, x: np.ndarray, pos: np.ndarray, neg: np.ndarray):
        tests = [(j, v) for j, size in enumerate(FEATURES.values()) for v in range(size - 1)]
        below = np.array([x[:, j] <= v for j, v in tests]) if len(x) else np.zeros((len(tests), 0), dtype=bool)
        n, total = pos + neg, max(1, (pos + neg).sum())
        rate = (pos.sum() + 1) / (total + 2)
        self.bias, self.trees = math.log(rate / (1 - rate)), []
        score = np.full(len(x), self.bias)

        def split(rows: np.ndarray) -> tuple[tuple[int, int], np.ndarray]:
            left = below & rows
            gl, hl = left @ g, left @ h
            gr, hr = (rows @ g) - gl, (rows @ h) - hl
            gain = gl**2 / (hl + PENALTY) + gr**2 / (hr + PENALTY)
            k = int(gain.argmax())
            return tests[k], below[k]

        for _ in range(TREES if len(x) else 0):
            p = 1 / (1 + np.exp(-score))
            g, h = pos - n * p, n * p * (1 - p)
            root, cut = split(np.ones(len(x), dtype=bool))
            tree = [root]
            for side in (cut, ~cut):
                test, inner = split(side)
                leaves = []
                for rows in (side & inner, side & ~inner):
                    value = RATE * float((rows @ g) / ((rows @ h) + PENALTY))
                    score[rows] += value
                    leaves.append(value)
                tree.append((test, leaves))
            self.trees.append(tree)
        self.fitted = score

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for root, left, right in self.trees:
            at_left = x[:, root[0]] <= root[1]
            for side, (test, leaves) in ((at_left, left), (~at_left, right)):
                out += side * np.where(x[:, test[0]] <= test[1], *leaves)
        return out

    def column(self, f: Column) -> Column:
        out = F.lit(self.bias)
        for root, left, right in self.trees:
            leaf = lambda t, v: F.when(F.get(f, F.lit(t[0])) <= t[1], v[0]).otherwise(v[1])
            out = out + F.when(F.get(f, F.lit(root[0])) <= root[1], leaf(*left)).otherwise(leaf(*right))
        return out


def _wilson(k: float, n: float, z: float = 1.96) -> float:
    """Lower bound of a share (upper with negative z)."""
    p = k / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _proven(kind: int, of: dict[str, float], rest: dict[str, float], junk: dict[str, float]) -> float:
    """A lower bound of the share of real ones among the valid candidates that touch no base span.

    of: counts of the candidates of the kind over a cut, rest: of those below it, junk: of cards and machines that fail their check.
    """
    if not of["n"]:
        return 0.0
    low = _wilson(of["k"], of["n"])
    if kind in (CARD, IP):
        high, chance = 1.0, of["chance"] / of["n"]
    elif kind == SECRET:
        high, chance = 1.0, rest["k"] / max(1.0, rest["n"])
    else:
        high = _wilson(of["base_k"], of["base_n"], -1.96) if of["base_n"] else 1.0
        chance = (rest["k"] + junk["bad_k"]) / max(1.0, rest["n"] + junk["bad_n"])
    share = min(1.0, (low - chance) / (high - chance)) if high > chance else 0.0
    if kind == CARD and share > 0:  # only those that pass are added
        share /= share + chance * (1 - share)
    return share


def _prepared(docs: DataFrame) -> DataFrame:
    """_row of docs with _text, _bases (spans by kind), _base (all of them, ordered) and _cand."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("_row")  # so that no column of docs clashes with those added here
    rows = docs.select(row, text.alias("_text"), text.rlike("[0-9]").alias("_digits"))
    rows = rows.withColumn("_matches", base_matches(F.col("_text")))
    rows = rows.withColumn("_bases", base_spans(F.col("_matches")))
    rows = rows.withColumn("_cand", candidates(F.col("_text"), F.col("_matches"), F.col("_bases")))
    return rows.withColumn("_base", F.array_sort(F.flatten("_bases"))).drop("_matches", "_digits")


def _fit(rows: DataFrame) -> tuple[Boosted, dict[int, float]]:
    """Trees and the score each kind needs, from counts over all rows (_doc, _cand); math.inf where nothing is proven."""
    fold = F.pmod(F.xxhash64("_doc", F.lit("calibration")), F.lit(FOLDS)).cast("int")
    each = rows.select(fold.alias("fold"), F.explode_outer("_cand").alias("c")).where("c IS NOT NULL")  # explode() would make the array a second time, to test its size
    c, kind = F.col("c"), F.get(F.col("c.f"), F.lit(0))
    witness = F.when(kind.isin(CARD, IP), c["valid"]).otherwise(c["cue"])
    usable, bad = c["apart"] & c["trial"], c["apart"] & kind.isin(CARD, IP) & ~c["valid"]
    sums = {"pos": c["label"], "neg": ~c["label"], "k": usable & witness, "n": usable, "base_k": c["hit"] & c["cue"], "base_n": c["hit"], "bad_k": bad & c["cue"], "bad_n": bad}
    counts = each.groupBy("fold", c["f"].alias("f")).agg(*(F.count_if(v).alias(n) for n, v in sums.items()), F.sum(F.when(usable, F.round(c["chance"] * 1e6).cast("long")).otherwise(0)).alias("chance"))
    got = counts.orderBy("fold", "f").collect()  # at most FOLDS * PATTERNS rows
    x, folds = np.array([r["f"] for r in got]).reshape(-1, len(FEATURES)), np.array([r["fold"] for r in got], dtype=int)
    count = {n: np.array([r[n] for r in got], dtype=float) for n in (*sums, "chance")}
    count["chance"] /= 1e6
    trained = lambda rows: Boosted(x[rows], count["pos"][rows], count["neg"][rows])
    score = np.zeros(len(x))
    for k in range(FOLDS):  # each pattern is scored by trees that have not seen its documents
        score[folds == k] = np.round(trained(folds != k).score(x[folds == k]), 9)
    total = lambda rows: {n: float(v[rows].sum()) for n, v in count.items()}
    model, needed = trained(np.ones(len(x), dtype=bool)), dict.fromkeys(range(len(KINDS)), math.inf)
    for kind in range(len(KINDS)):
        of = np.flatnonzero(x[:, 0] == kind) if len(x) else np.array([], dtype=int)
        for cut in sorted(set(score[of])):
            over = of[score[of] >= cut]
            if _proven(kind, total(over), total(of[score[of] < cut]), total(slice(None))) >= PRECISION:
                needed[kind] = cut - 1e-6
                break
    return model, needed


def fit(docs: DataFrame) -> tuple[Boosted, dict[int, float]]:
    """The trees and thresholds that a table's own candidates prove."""
    rows = _prepared(docs.select("doc_id", "text"))
    return _fit(rows.select(F.col("_row.doc_id").alias("_doc"), "_cand"))


def _all_spans(model: Boosted, needed: dict[int, float]) -> Column:
    """_base with the candidates of _cand that reach their kind's score, ordered; of those that touch, the first and then the best."""
    passing = {k: v for k, v in needed.items() if v < math.inf}
    if not passing:
        return F.col("_base")
    cut = lambda c: F.coalesce(*(F.when(F.get(c["f"], F.lit(0)) == k, F.lit(v)) for k, v in passing.items()), F.lit(math.inf))
    scored = F.transform(
        F.filter("_cand", lambda c: c["apart"] & c["valid"]),
        lambda c: F.struct(c["start"].alias("start"), (-model.column(c["f"])).alias("rank"), (c["start"] - c["end"]).alias("length"), F.get(c["f"], F.lit(0)).alias("kind"), c["end"].alias("end"), cut(c).alias("cut")),
    )
    ranked = F.array_sort(F.filter(scored, lambda c: -c["rank"] >= c["cut"]))
    free = lambda at, c: c["start"] >= at
    span = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))
    taken = lambda r: _scan(r, F.lit(0), lambda at, c: F.when(free(at, c), c["end"]).otherwise(at), lambda at, c: F.when(free(at, c), span(c)), _SIZED)
    return F.array_sort(F.concat("_base", F.filter(let(ranked, taken), lambda x: x.isNotNull())))


def _joined(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base counts by kind, base_sha256 and spans (kind:start:end, comma-joined) of each row of docs.

    Null and empty texts have no spans. Rows that repeat are found apart. Columns other than doc_id and
    text aren't read. An empty table gives no rows.
    """
    rows = _prepared(docs.select("doc_id", "text"))
    rows = materialized(rows.select(F.col("_row.doc_id").alias("_doc"), "_base", "_cand"))  # texts are read once
    rows = rows.withColumn("_all", _all_spans(*_fit(rows)))
    number = lambda k: F.size(F.filter("_base", lambda x: x["kind"] == k)).cast("long")
    counts = [number(k).alias(f"n_{name}") for k, name in enumerate(BASE_KINDS)]
    return rows.select(F.col("_doc").alias("doc_id"), *counts, F.sha2(_joined("_base"), 256).alias("base_sha256"), _joined("_all").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span (or run of overlapping spans) in text replaced by <kind>, and n_chars to match.

    Rows without spans, null and empty texts and all other columns stay as they are, whatever their names. Rows that repeat
    are redacted apart, an empty table gives no rows.
    """
    names = F.array(*map(F.lit, KINDS))
    text = F.col("_text")
    model, needed = fit(docs)
    rows = _prepared(docs).withColumn("_all", _all_spans(model, needed)).select("_row", "_text", "_all")
    found = F.size("_all") > 0

    def pieces(chunks: Column) -> Column:
        """What replaces the text up to each span's end."""
        piece = lambda at, x: F.when(x["start"] < at, "").otherwise(F.concat(_piece(text, chunks, at, x["start"] - at), F.lit("<"), F.get(names, x["kind"]), F.lit(">")))
        return _scan(F.col("_all"), F.lit(0), lambda at, x: F.greatest(at, x["end"]), piece, "array<string>")

    rest = F.substring(text, F.array_max(F.transform("_all", lambda x: x["end"])) + 1, F.length(text))
    rows = rows.withColumn("_whole", F.when(found, F.concat(F.array_join(let(_chunks(text), pieces), ""), rest)))
    out = {"text": F.when(found, F.col("_whole")).otherwise(F.col("_row.text"))}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(found, F.length("_whole").cast("long")).otherwise(F.col("_row.n_chars"))
    return rows.select(*(out[c].alias(c) if c in out else F.col("_row")[c].alias(c) for c in docs.columns))

"""Quality rules whose cutoffs carry a guarantee, in built-in expressions only.

Each rule is a number for each text, the worse the larger. For every stratum (language) and rule, cutoffs on
a fixed grid are tried on labelled rows of good quality: a cutoff is safe if, were its true share of falsely
rejected good texts over the rule's part of ALPHA, so few rejections as were counted would come about with a probability of at most
DELTA / (number of tests in all), an exact binomial tail. With that (Bonferroni) correction all safe cutoffs of all
strata are valid at once with probability 1 - DELTA, so the strictest safe one is taken. A stratum whose labels
prove no cutoff gets none and rejects by no rule. ALPHA is shared out evenly among the rules, so all of them together falsely reject
at most that share of a stratum's good texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialized

#: Highest accepted share of good texts that all rules together reject in one stratum, and the risk that any cutoff breaks it.
ALPHA = 0.1
DELTA = 0.05
MIN_WORDS = 50
REPEATED = 50
#: Rule: (name, cutoffs from strict to lax). A text is rejected when the rule's number is over the cutoff.
RULES: dict[str, tuple[float, ...]] = {
    "symbols_per_word": (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 1.0),
    "dup_lines_per_line": (0.05, 0.1, 0.2, 0.3, 0.5, 0.7),
    "repeated_words": (0.02, 0.05, 0.1, 0.2, 0.3, 0.4),
    "shouted": (0.05, 0.1, 0.2, 0.3, 0.5, 0.8),
    "word_chars_far_from_5": (1.0, 2.0, 3.0, 4.0, 6.0, 10.0),
}
_SPACE = r"[\x20\x09-\x0D]+"


def _windows_repeated(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more.

    Windows are compared by a 64-bit hash of their words. Only where a text has equal ones are (hash, place) pairs sorted; neighbours with one hash
    are repeated, and their places in order count three words each or, where they overlap, the step to the next.
    """

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

        def counted(h: Column) -> Column:
            pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
            same = lambda p, k, x: F.coalesce(F.get(p, k)["h"] == x["h"], F.lit(False))
            places = let(pairs, lambda p: F.array_sort(F.transform(F.filter(p, lambda x, k: ((k > 0) & same(p, k - 1, x)) | same(p, k + 1, x)), lambda x: x["i"])))
            zero = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
            step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last"))
            return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(F.aggregate(places, zero, step)["n"])

        return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(hashes, counted))

    return let(words, of)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the rules' numbers of each row.

    Words are [^\\x20\\x09-\\x0D]+ of the whole text; a null text has none, and its numbers are 0.
    A table without lang is one stratum.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    bare = F.regexp_replace("text", f"^{_SPACE}|{_SPACE}$", "")
    words = let(bare, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, _SPACE)))
    chars = F.translate("text", " \t\n\x0b\f\r", "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, " \t\x0b\f\r", "")) > 0)
    rows = docs.select("doc_id", lang.alias("lang"), text.alias("text")).select(
        "doc_id",
        "lang",
        F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words"),
        F.length(chars).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
        _windows_repeated(words).cast("long").alias("n_repeat_words"),
        F.regexp_count("text", F.lit(r"[\p{Lu}!]{2,}")).cast("long").alias("n_shouted"),
    )
    some = F.greatest("n_words", F.lit(1))
    return rows.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", F.col("lines.dup").alias("n_dup_lines"), "n_repeat_words",
        (F.col("n_symbols") / some).alias("symbols_per_word"),
        (F.col("lines.dup") / F.greatest("lines.n", F.lit(1))).alias("dup_lines_per_line"),
        (F.col("n_repeat_words") / some).alias("repeated_words"),
        (F.col("n_shouted") / some).alias("shouted"),
        F.abs(F.col("word_chars") / some - 5).alias("word_chars_far_from_5"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))


def _binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p): terms summed from their logarithms, each from the one before."""
    odds = math.log(p) - math.log1p(-p)
    start = F.struct((n * math.log1p(-p)).alias("log"), F.exp(n * math.log1p(-p)).alias("sum"))

    def step(acc: Column, j: Column) -> Column:
        log = acc["log"] + F.log((n - j + 1) / j) + odds
        return F.struct(log.alias("log"), (acc["sum"] + F.exp(log)).alias("sum"))

    return F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), start, step)["sum"]


def thresholds(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """lang, rule, cutoff: the strictest safe cutoff of each stratum and rule; without one there is no row.

    labels: doc_id, quality (1: good). Rows with other or null labels and texts that fail the base rules don't count.
    """
    alpha = alpha / len(RULES)
    good = labels.where("quality = 1").select("doc_id").distinct()
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("x"), F.array(*map(F.lit, cuts)).alias("cuts")) for r, cuts in RULES.items()))
    long = measured.where(~base_failed()).join(good, "doc_id", "left_semi").select("lang", F.explode(rules).alias("r"))
    each = long.select("lang", "r.rule", "r.x", F.explode("r.cuts").alias("cutoff"))
    counts = each.groupBy("lang", "rule", "cutoff").agg(F.count("*").alias("n"), F.count_if(F.col("x") > F.col("cutoff")).alias("k"))
    counts = materialized(counts)  # one row for each stratum, rule and cutoff
    tests = max(1, counts.select("lang").distinct().count()) * sum(map(len, RULES.values()))
    likely = F.col("k") < alpha * F.col("n")  # beyond that the tail is far over any delta
    tail = F.when(likely, _binomial_tail(F.col("k"), F.col("n"), alpha)).otherwise(1.0)
    return counts.where(tail <= delta / tests).groupBy("lang", "rule").agg(F.min("cutoff").alias("cutoff"))


def verdicts(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The measures of each row of docs, base_failed and kept.

    kept is false for texts that fail the base rules, else it says that no rule's number is over its stratum's
    cutoff. Rows with equal doc_ids are measured apart; a labelled doc_id labels all of them. Empty labels: no
    cutoffs. The table of cutoffs has a row for each stratum, so it is joined, not broadcast by force.
    """
    measured = materialized(measures(docs))
    found = thresholds(measured, labels, alpha, delta)
    cuts = found.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts"))
    cuts = F.broadcast(cuts) if cuts.count() <= 10_000 else cuts
    over = [F.coalesce(F.col(r) > F.try_element_at("cuts", F.lit(r)), F.lit(False)) for r in RULES]
    rejected = over[0]
    for x in over[1:]:
        rejected = rejected | x
    return measured.join(cuts, "lang", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & ~rejected).alias("kept")
    )


def _sql() -> str:
    cuts = " UNION ALL ".join(f"SELECT '{r}' AS rule, unnest({list(c)}) AS cutoff" for r, c in RULES.items())
    long = " UNION ALL ".join(f"SELECT doc_id, lang, '{r}' AS rule, CAST({r} AS DOUBLE) AS x, bad FROM m" for r in RULES)
    tail = f"list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({ALPHA / len(RULES)}) + (n - j) * ln(1 - {ALPHA / len(RULES)}))))"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, k, concat_ws(' ', w[k], w[k + 1], w[k + 2]) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM d WHERE len(w) >= 3)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([k, k + 1, k + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY 1),
b AS (SELECT doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines, len(regexp_extract_all(t, '[\p{{Lu}}!]{{2,}}')) AS n_shouted
  FROM d LEFT JOIN r USING (doc_id)),
m AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEATED} * n_words AS bad, n_symbols / greatest(n_words, 1) AS symbols_per_word, n_dup_lines / greatest(n_lines, 1) AS dup_lines_per_line,
  n_repeat_words / greatest(n_words, 1) AS repeated_words, n_shouted / greatest(n_words, 1) AS shouted, abs(word_chars / greatest(n_words, 1) - 5) AS word_chars_far_from_5 FROM b),
l AS ({long}),
c AS (SELECT lang, rule, CAST(cutoff AS DOUBLE) AS cutoff, count(*) AS n, count(*) FILTER (x > cutoff) AS k FROM l JOIN ({cuts}) USING (rule) WHERE NOT bad AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY 1, 2, 3),
s AS (SELECT lang, rule, min(cutoff) AS cutoff FROM c WHERE k < {ALPHA / len(RULES)} * n AND {tail} <= {DELTA} / ((SELECT count(DISTINCT lang) FROM c) * {sum(map(len, RULES.values()))}) GROUP BY 1, 2),
o AS (SELECT DISTINCT doc_id FROM l JOIN s USING (lang, rule) WHERE x > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bad AS base_failed, NOT bad AND doc_id NOT IN (SELECT doc_id FROM o) AS kept FROM m
"""


SQL = _sql()

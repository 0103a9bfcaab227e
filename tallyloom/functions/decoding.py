"""Texts hidden in base64 or hex, in built-in expressions; and Unicode normalization, which has no built-in form.

What could be coded is cut out by two patterns, and all attempts of a text are one array: white space is taken out of a base64 run, as
it may be broken over lines, and each of its words is an attempt too, as words may stand around it. An attempt counts if its
length and letters are right and its bytes are UTF-8.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Layers of a text at most, attempts at most, shortest base64, what runs look like.
LAYERS, ATTEMPTS, SHORTEST = 8, 256, 16
SPACE = r"[ \t\n\x0b\f\r]+"
BASE64_RUN, HEX_RUN = r"[A-Za-z0-9+/= \t\n\x0b\f\r]{24,}", r"[0-9a-fA-F]{32,}"
BASE64_WHOLE = r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{4}|[A-Za-z0-9+/]{3}=|[A-Za-z0-9+/]{2}==)$"


#: Characters that NFKC leaves as they are, whatever stands beside them: ASCII, letters of Latin-1 and Extended-A, ideographs, common Chinese marks.
STABLE = "\x00-\x7f¡-§©«-®°±¶·»¿-ıĴ-ľŁ-ňŊ-ž\u3001-\u301b\u4e00-\u9fff“”‘’–—€"


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column) -> Column:
    """NFKC; texts of STABLE characters only are their own form and stay in the JVM."""
    # a function in a CASE runs for all rows: those that don't need it send null
    return F.coalesce(_nfkc(F.when(~text.rlike(rf"^[{STABLE}]*+\z"), text)), text)


def _attempts(text: Column) -> Column:
    """(run, via) in the order in which they are tried."""
    runs = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tagged = lambda values, via: F.transform(values, lambda x: F.struct(x.alias("run"), F.lit(via).alias("via")))
    words = lambda run: F.transform(F.split(run, SPACE), lambda w: F.regexp_replace(w, "^=+", ""))

    def of_run(run: Column) -> Column:
        whole = F.regexp_replace(run, SPACE, "")
        return F.concat(F.array(whole), F.filter(words(run), lambda w: w != whole))

    base64 = F.filter(F.flatten(F.transform(runs(BASE64_RUN), of_run)), lambda x: x != "")
    return F.slice(F.concat(tagged(base64, "base64"), tagged(runs(HEX_RUN), "hex")), 1, ATTEMPTS)


def _plain(attempt: Column) -> Column:
    """The decoded text of an attempt; null if it is none."""
    run, is_base64 = attempt["run"], attempt["via"] == "base64"
    right = (F.length(run) >= SHORTEST) & run.rlike(BASE64_WHOLE)
    raw = F.when(is_base64, F.when(right, F.try_to_binary(run, F.lit("base64")))).when(F.length(run) % 2 == 0, F.unhex(run))
    return F.try_validate_utf8(raw.cast("string"))


def decoded(text: Column) -> Column:
    """Array of the decoded layers (text, via) of a text, each text once, LAYERS at most of the first ATTEMPTS attempts; a guard against hostile texts."""
    made = F.transform(_attempts(text), lambda x: F.struct(_plain(x).alias("text"), x["via"].alias("via")))
    good = F.filter(made, lambda x: x["text"].isNotNull())

    def once(found: Column) -> Column:
        plain = F.transform(found, lambda x: x["text"])
        first = lambda x, i: (F.array_position(plain, x["text"]) == i + 1) & (F.size(F.slice(found, 1, i + 1)) > 0)
        return F.slice(F.filter(found, first), 1, LAYERS)

    some = F.element_at(F.transform(F.array(good), once), 1)
    return F.when(text.rlike(f"{BASE64_RUN}|{HEX_RUN}"), some).otherwise(F.array().cast("array<struct<text:string,via:string>>"))


def decoded_sql(text: str) -> str:
    """The same layers of a SQL expression, as a list of (text, via)."""
    runs = lambda pattern: f"regexp_extract_all({text}, '{pattern}')"
    whole = f"regexp_replace(r, '{SPACE}', '', 'g')"
    words = f"list_transform(string_split_regex(r, '{SPACE}'), lambda w: regexp_replace(w, '^=+', ''))"
    base64 = f"list_filter(flatten(list_transform({runs(BASE64_RUN)}, lambda r: list_concat([{whole}], list_filter({words}, lambda w: w <> {whole})))), lambda x: x <> '')"
    tried = f"list_concat(list_transform({base64}, lambda x: {{'run': x, 'via': 'base64'}}), list_transform({runs(HEX_RUN)}, lambda x: {{'run': x, 'via': 'hex'}}))[1:{ATTEMPTS}]"
    plain = f"CASE WHEN a.via = 'hex' THEN CASE WHEN length(a.run) % 2 = 0 THEN TRY(decode(unhex(a.run))) END WHEN length(a.run) >= {SHORTEST} AND regexp_matches(a.run, '{BASE64_WHOLE}') THEN TRY(decode(from_base64(a.run))) END"
    good = f"list_filter(list_transform({tried}, lambda a: {{'text': {plain}, 'via': a.via}}), lambda x: x.text IS NOT NULL)"
    return f"list_transform([{good}], lambda g: list_filter(g, lambda x, i: list_position(list_transform(g, lambda y: y.text), x.text) = i)[1:{LAYERS}])[1]"

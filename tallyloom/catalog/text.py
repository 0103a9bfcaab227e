"""Inspection and redaction of texts with planted findings, and scalar text functions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import bodies, decoding, inspection, scope
from ..sources import files
from .registry import query

# Planted strings are put together from parts, so that no secret-shaped literal stands here.
_PLANTS = {
    0: ("AKIA", "ABCDEFGHIJKLMNOP"),
    1: ("ghp_", "a" * 36),
    2: ("sk-", "0123456789abcdef" * 2),
    3: ("1380", "0138000"),
    4: ("4111 1111 ", "1111 1111"),
    5: ("11010119900307", "8515"),
    6: ("-----BEGIN RSA ", "PRIVATE KEY-----"),
    7: ("工 资", " 密码"),
}
_PLANT_SQL = "concat(text, CASE doc_id % 13 " + " ".join(f"WHEN {k} THEN concat(' ', '{a}', '{b}', ' ')" for k, (a, b) in _PLANTS.items()) + " ELSE '' END)"
_P = f"p AS (SELECT doc_id, {_PLANT_SQL} AS text FROM documents)"


def _planted(t):
    return t("documents").select("doc_id", F.expr(_PLANT_SQL).alias("text"))


@query("strip_separators", f"WITH {_P} SELECT doc_id, sha256(regexp_replace(text, '[\\s\\-_.,/|]+', '', 'g')) AS stripped FROM p")
def _(t):
    return _planted(t).select("doc_id", F.sha2(inspection.strip_separators(F.col("text")), 256).alias("stripped"))


_LUHN = "list_sum(list_transform(range(1, length(v) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(v, length(v) - i + 1, 1) AS INT) ELSE CAST(substr(v, length(v) - i + 1, 1) AS INT) * 2 - CASE WHEN CAST(substr(v, length(v) - i + 1, 1) AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
_RUNS = f"{_P}, runs AS (SELECT DISTINCT doc_id, v FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS v FROM p UNION ALL SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '[\\s\\-_.,/|]+', '', 'g'), '[0-9]+')) FROM p))"


def _kind(t, kind: str):
    return _planted(t).select("doc_id", F.explode(F.filter(inspection.findings(F.col("text")), lambda x: x["kind"] == kind)).alias("f")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("pattern_scan_bankcard", f"WITH {_RUNS} SELECT doc_id, count(*) AS n FROM runs WHERE length(v) BETWEEN 16 AND 19 AND {_LUHN} GROUP BY 1")
def _(t):
    return _kind(t, "bankcard")


@query("pattern_scan_phone", f"WITH {_RUNS} SELECT doc_id, count(*) AS n FROM runs WHERE length(v) = 11 AND regexp_matches(v, '^1[3-9]') GROUP BY 1")
def _(t):
    return _kind(t, "phone")


@query("luhn", f"WITH {_RUNS} SELECT v, {_LUHN} AS valid FROM (SELECT DISTINCT v FROM runs WHERE length(v) BETWEEN 12 AND 19)")
def _(t):
    text = F.col("text")
    runs = F.concat(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)), F.regexp_extract_all(inspection.strip_separators(text), F.lit("[0-9]+"), F.lit(0)))
    values = _planted(t).select(F.explode(runs).alias("v")).where(F.length("v").between(12, 19)).distinct()
    return values.select("v", inspection.luhn(F.col("v")).alias("valid"))


_SIMPLE = {k: p for k, (p, _) in inspection.PATTERNS.items() if k not in inspection.DIGIT_KINDS}


@query("pattern_scan_keys", f"WITH {_P}, f AS (" + " UNION ALL ".join(f"SELECT DISTINCT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS v FROM p" for k, p in _SIMPLE.items()) + ") SELECT kind, count(*) AS n, count(DISTINCT doc_id) AS docs FROM f GROUP BY 1")
def _(t):
    found = _planted(t).select("doc_id", F.explode(F.filter(inspection.findings(F.col("text")), lambda x: ~x["kind"].isin(*inspection.DIGIT_KINDS))).alias("f"))
    return found.groupBy(F.col("f.kind").alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


_WORDS = ", ".join(f"('{w}', {n})" for n, ws in inspection.KEYWORDS.items() for w in ws)
_SCORE = f"k AS (SELECT doc_id, CAST(sum(n) AS INT) AS score FROM p, (VALUES {_WORDS}) AS w(word, n) WHERE strpos(text, word) > 0 OR strpos(regexp_replace(text, '\\s+', '', 'g'), word) > 0 GROUP BY 1)"


@query("keyword_score", f"WITH {_P}, {_SCORE} SELECT doc_id, score FROM k")
def _(t):
    hits = F.filter(inspection.keyword_hits(F.col("text")), lambda x: ~x["name"].isin(*inspection.RISK_RULES))
    return _planted(t).select("doc_id", inspection.total(hits).alias("score")).where("score > 0")


_RULE_TEXT = "CASE doc_id % 4 WHEN 0 THEN '那个数你懂的' WHEN 1 THEN '涨到38000了' WHEN 2 THEN 'daoshou 12k' ELSE '老板周三行程没变' END"


@query("risk_rules", f"SELECT doc_id, doc_id % 4 AS rule_no, 20 AS score FROM documents")
def _(t):
    rows = t("documents").select("doc_id", F.expr(_RULE_TEXT).alias("text"))
    hits = F.filter(inspection.keyword_hits(F.col("text")), lambda x: x["name"].isin(*inspection.RISK_RULES))
    number = F.array_position(F.array(*map(F.lit, inspection.RISK_RULES)), F.element_at(hits, 1)["name"]) - 1
    return rows.select("doc_id", number.alias("rule_no"), inspection.total(hits).alias("score"))


_ID_SUM = f"list_sum(list_transform(range(1, 18), lambda i: CAST(substr(v, i, 1) AS INT) * list_extract({list(inspection.ID_WEIGHTS)}, i)))"
_ID_OK = f"try_strptime(substr(v, 7, 8), '%Y%m%d') IS NOT NULL AND substr(v, 7, 4) BETWEEN '1900' AND '2100' AND substr('{inspection.ID_CHECKS}', CAST({_ID_SUM} % 11 + 1 AS INT), 1) = upper(substr(v, 18, 1))"
# A number for each event: region, a date that may not exist, a running number, and a last character that is right for some.
_CARDS = "SELECT event_id, concat('1101', lpad(CAST(event_id % 90 AS VARCHAR), 2, '0'), CAST(1880 + event_id % 240 AS VARCHAR), lpad(CAST(1 + event_id % 12 AS VARCHAR), 2, '0'), lpad(CAST(1 + event_id % 31 AS VARCHAR), 2, '0'), lpad(CAST(user_id % 1000 AS VARCHAR), 3, '0'), CASE WHEN event_id % 11 = 10 THEN 'x' ELSE CAST(event_id % 11 AS VARCHAR) END) AS v FROM events"


@query("idcard_checksum", f"SELECT event_id, v AS card, coalesce({_ID_OK}, false) AS valid FROM ({_CARDS})")
def _(t):
    e, two = F.col("event_id"), lambda c, n=2: F.lpad(c.cast("string"), n, "0")
    card = F.concat(F.lit("1101"), two(e % 90), (1880 + e % 240).cast("string"), two(1 + e % 12), two(1 + e % 31), two(F.col("user_id") % 1000, 3), F.when(e % 11 == 10, "x").otherwise((e % 11).cast("string")))
    return t("events").select("event_id", card.alias("card"), inspection.id_valid(card).alias("valid"))


# Width forms (U+3000, U+FF01 to U+FF5E) are the only characters of the tables that NFKC changes where it matters here; SQL has no NFKC.
_WIDE = "\u3000" + "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = unicodedata.normalize("NFKC", _WIDE)
_ALL_WEIGHTS = ", ".join(f"('{k}', {w})" for k, (_, w) in inspection.PATTERNS.items())


def _inspect_sql() -> str:
    each = lambda kind, pattern: f"SELECT DISTINCT doc_id, '{kind}' AS kind, unnest(regexp_extract_all(x, '{pattern}')) AS v FROM"
    both = "(SELECT doc_id, text AS x FROM v UNION ALL SELECT doc_id, digits FROM v)"
    found = [f"{each(k, p)} (SELECT doc_id, text AS x FROM v)" for k, p in _SIMPLE.items()]
    found.append(f"SELECT * FROM ({each('idcard', inspection.PATTERNS['idcard'][0])} {both}) WHERE {_ID_OK}")
    found.append(f"SELECT * FROM ({each('phone', '[0-9]+')} {both}) WHERE length(v) = 11 AND regexp_matches(v, '^1[3-9]')")
    found.append(f"SELECT * FROM ({each('bankcard', '[0-9]+')} {both}) WHERE length(v) BETWEEN 16 AND 19 AND {_LUHN}")
    rules = " + ".join(f"CASE WHEN regexp_matches(text, '{p}') OR regexp_matches(compact, '{p}') THEN {inspection.RISK_WEIGHT} ELSE 0 END" for p in inspection.RISK_RULES.values())
    return f"""WITH {_P}, s AS (SELECT doc_id, translate(regexp_replace(coalesce(text, ''), '{inspection.INVISIBLE}', '', 'g'), '{_WIDE}', '{_NARROW.replace("'", "''")}') AS text FROM p),
    v AS (SELECT doc_id, text, regexp_replace(text, '[\\s\\-_.,/|]+', '', 'g') AS digits, regexp_replace(text, '\\s+', '', 'g') AS compact FROM s),
    f AS ({' UNION ALL '.join(found)}),
    n AS (SELECT doc_id, kind, least({inspection.MATCH_CAP}, count(*)) AS n FROM f GROUP BY 1, 2),
    w AS (SELECT doc_id, sum(n) AS n, sum(n * weight) AS weighted FROM n JOIN (VALUES {_ALL_WEIGHTS}) AS t(kind, weight) USING (kind) GROUP BY 1),
    k AS (SELECT doc_id, sum(n) AS score FROM v, (VALUES {_WORDS}) AS t(word, n) WHERE strpos(text, word) > 0 OR strpos(compact, word) > 0 GROUP BY 1),
    r AS (SELECT doc_id, {rules} AS score FROM v),
    o AS (SELECT doc_id, CAST(coalesce(w.n, 0) AS INT) AS n_findings, CAST(coalesce(weighted, 0) AS INT) AS weighted, CAST(coalesce(k.score, 0) + r.score AS INT) AS keyword_score FROM r LEFT JOIN w USING (doc_id) LEFT JOIN k USING (doc_id))
    SELECT *, CAST(least({inspection.RISK_CAP}, weighted + keyword_score) AS INT) AS risk FROM o"""


@query("inspect_text", _inspect_sql())
def _(t):
    text = decoding.nfkc(inspection.visible(F.col("text")))
    rows = _planted(t).select("doc_id", text.alias("text"))
    rows = rows.select("doc_id", inspection.findings(F.col("text")).alias("found"), inspection.keyword_hits(F.col("text")).alias("hits"))
    return rows.select("doc_id", F.size("found").alias("n_findings"), inspection.total(F.col("found")).alias("weighted"), inspection.total(F.col("hits")).alias("keyword_score"), inspection.risk(F.col("found"), F.col("hits")).alias("risk"))


def _base64(text):
    return F.regexp_replace(F.base64(F.encode(text, "UTF-8")), "\r\n", "")  # in one line


_CODED = "CASE doc_id % 4 WHEN 0 THEN to_base64(encode(text)) WHEN 1 THEN lower(hex(encode(text))) WHEN 2 THEN concat(left(text, 200), ' ', to_base64(encode(left(text, 90))), chr(10), hex(encode(right(text, 40))), ' ', to_base64(encode(left(text, 90)))) ELSE text END"


@query(
    "decode_layers",
    f"""WITH c AS (SELECT doc_id, {_CODED} AS coded FROM documents), l AS MATERIALIZED (SELECT doc_id, {decoding.decoded_sql("coded")} AS layers FROM c)
    SELECT doc_id, CAST(len(layers) AS INT) AS n, array_to_string(list_transform(layers, lambda x: x.via), ',') AS via, sha256(array_to_string(list_transform(layers, lambda x: x.text), chr(10))) AS decoded FROM l""",
)
def _(t):
    """Whole texts in base64, in hex, coded pieces among words, and plain texts."""
    some = F.concat(F.left("text", F.lit(200)), F.lit(" "), _base64(F.left("text", F.lit(90))), F.lit("\n"), F.hex(F.encode(F.right("text", F.lit(40)), "UTF-8")), F.lit(" "), _base64(F.left("text", F.lit(90))))
    kind = F.col("doc_id") % 4
    coded = F.when(kind == 0, _base64(F.col("text"))).when(kind == 1, F.lower(F.hex(F.encode("text", "UTF-8")))).when(kind == 2, some).otherwise(F.col("text"))
    rows = t("documents").select("doc_id", decoding.decoded(coded).alias("layers"))
    return rows.select("doc_id", F.size("layers").alias("n"), F.array_join("layers.via", ",").alias("via"), F.sha2(F.array_join("layers.text", "\n"), 256).alias("decoded"))


_HIDDEN = "concat(to_base64(encode(concat(left(text, 60), CASE doc_id % 3 WHEN 0 THEN ' the salary 工资' WHEN 1 THEN ' bonus and salary' ELSE '' END))), '. ', right(text, 300), CASE WHEN doc_id % 2 = 0 THEN ' salary' ELSE '' END)"
_HITS = lambda x: f"list_filter(words, lambda w: strpos({x}, w) > 0 OR strpos(regexp_replace({x}, '\\s+', '', 'g'), w) > 0)"


@query(
    "encoded_only_keywords",
    f"""WITH c AS (SELECT doc_id, {_HIDDEN} AS coded, [{", ".join(f"'{w}'" for ws in inspection.KEYWORDS.values() for w in ws)}] AS words FROM documents),
    l AS MATERIALIZED (SELECT doc_id, coded, words, array_to_string(list_transform({decoding.decoded_sql("coded")}, lambda y: y.text), chr(10)) AS inside FROM c)
    SELECT doc_id, array_to_string(list_filter({_HITS("inside")}, lambda w: NOT list_contains({_HITS("coded")}, w)), ',') AS only_encoded FROM l""",
)
def _(t):
    """Keywords that only the coded part of a text has."""
    word = F.when(F.col("doc_id") % 3 == 0, " the salary 工资").when(F.col("doc_id") % 3 == 1, " bonus and salary").otherwise("")
    coded = _base64(F.concat(F.left("text", F.lit(60)), word))
    text = F.concat(coded, F.lit(". "), F.right("text", F.lit(300)), F.when(F.col("doc_id") % 2 == 0, " salary").otherwise(""))
    names = lambda c: F.transform(F.filter(inspection.keyword_hits(c), lambda x: ~x["name"].isin(*inspection.RISK_RULES)), lambda x: x["name"])
    rows = t("documents").select("doc_id", text.alias("text"))
    rows = rows.select("doc_id", "text", F.array_join(F.transform(decoding.decoded(F.col("text")), lambda x: x["text"]), "\n").alias("inside"))
    return rows.select("doc_id", F.array_join(F.array_except(names(F.col("inside")), names(F.col("text"))), ",").alias("only_encoded"))


def _re2(pattern: str) -> str:
    return pattern.replace("'", "''")


def _redacted_sql() -> str:
    out = "text"
    for pattern, put in inspection.SECRETS:
        out = f"regexp_replace({out}, '{_re2(pattern)}', '{put.replace('$1', chr(92) + '1')}', 'g')"
    return out


@query("redact_secrets", f"WITH {_P} SELECT doc_id, sha256({_redacted_sql()}) AS redacted, strpos({_redacted_sql()}, 'REDACTED') > 0 AS changed FROM p")
def _(t):
    text = inspection.redact_secrets(F.col("text"))
    return _planted(t).select("doc_id", F.sha2(text, 256).alias("redacted"), text.contains("REDACTED").alias("changed"))


@query("merge_findings", f"WITH {_P}, f AS (SELECT DISTINCT doc_id % 10 AS g, 'aws_key' AS kind FROM p WHERE regexp_matches(text, '{_SIMPLE['aws_key']}') UNION SELECT DISTINCT doc_id % 10, 'gh_token' FROM p WHERE regexp_matches(text, '{_SIMPLE['gh_token']}')) SELECT g, string_agg(kind, ',' ORDER BY kind) AS kinds FROM f GROUP BY 1")
def _(t):
    rows = _planted(t).select((F.col("doc_id") % 10).alias("g"), F.transform(inspection.findings(F.col("text")), lambda x: x["kind"]).alias("kinds"))
    kept = F.filter(F.array_distinct(F.flatten(F.collect_set("kinds"))), lambda k: k.isin("aws_key", "gh_token"))
    return rows.groupBy("g").agg(F.array_join(F.array_sort(kept), ",").alias("kinds")).where("kinds <> ''")


@query("pii_summary", f"WITH {_RUNS} SELECT 'bankcard' AS kind, count(*) AS n FROM runs WHERE length(v) BETWEEN 16 AND 19 AND {_LUHN} UNION ALL SELECT 'phone', count(*) FROM runs WHERE length(v) = 11 AND regexp_matches(v, '^1[3-9]')")
def _(t):
    found = _planted(t).select(F.explode(inspection.findings(F.col("text"))).alias("f")).groupBy(F.col("f.kind").alias("kind")).agg(F.count("*").alias("n"))
    return found.where(F.col("kind").isin("bankcard", "phone"))


@query("chunk_text", "SELECT doc_id, CAST(least(10, ceil(length(text) / 1800)) AS BIGINT) AS n, substr(text, 1, 20) AS head, CAST(least(length(text), 18000) AS BIGINT) AS covered FROM documents WHERE length(text) > 0")
def _(t):
    rows = t("documents").select("doc_id", "text", scope.chunks(F.col("text"), 1800, 10).alias("c")).where(F.size("c") > 0)
    covered = F.aggregate("c", F.lit(0), lambda a, x: a + F.length(x))
    return rows.select("doc_id", F.size("c").cast("long").alias("n"), F.substring(F.element_at("c", 1), 1, 20).alias("head"), covered.cast("long").alias("covered"))


@query("intent_source_trim", "SELECT doc_id, sha256(CASE WHEN length(x) > 2500 THEN concat(left(x, 1500), chr(10), '…', chr(10), right(x, 1000)) ELSE x END) AS trimmed FROM (SELECT doc_id, trim(text, E' \\t\\n\\r') AS x FROM documents)")
def _(t):
    return t("documents").select("doc_id", F.sha2(scope.source_trim(F.col("text")), 256).alias("trimmed"))


@query("review_cap", "SELECT doc_id, right(text, 500) AS kept, length(text) > 500 AS overflow FROM documents")
def _(t):
    return t("documents").select("doc_id", F.right("text", F.lit(500)).alias("kept"), (F.length("text") > 500).alias("overflow"))


@query("clip_preview", "SELECT doc_id, left(text, 80) AS clip80, left(text, 200) AS clip200 FROM documents")
def _(t):
    return t("documents").select("doc_id", F.substring("text", 1, 80).alias("clip80"), F.substring("text", 1, 200).alias("clip200"))


_SAYS = "concat(left(text, 40), CASE conv_id % 4 WHEN 0 THEN concat(' see report_', CAST(conv_id AS VARCHAR), '.xlsx and b.csv') WHEN 1 THEN concat('x', CAST(turn AS VARCHAR), '.PDF') WHEN 2 THEN ' a/b.csv.zip' ELSE '' END, right(text, 60))"


@query("mentioned_filename", f"SELECT conv_id, turn, regexp_extract({_SAYS}, '(?:^|[^A-Za-z0-9_])([A-Za-z0-9_]{{1,100}}\\.(?:xlsx|csv|pdf))', 1) AS name FROM conversations")
def _(t):
    """The first data file that a turn names."""
    kind = F.col("conv_id") % 4
    said = F.when(kind == 0, F.concat(F.lit(" see report_"), F.col("conv_id").cast("string"), F.lit(".xlsx and b.csv"))).when(kind == 1, F.concat(F.lit("x"), F.col("turn").cast("string"), F.lit(".PDF"))).when(kind == 2, " a/b.csv.zip").otherwise("")
    text = F.concat(F.left("text", F.lit(40)), said, F.right("text", F.lit(60)))
    return t("conversations").select("conv_id", "turn", F.regexp_extract(text, r"(?<![A-Za-z0-9_])([A-Za-z0-9_]{1,100}\.(?:xlsx|csv|pdf))", 1).alias("name"))


# Usage as different providers report it: both sides by either name, one side only, with details, or without.
_K = "CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT)"
_USAGE = f"""CASE event_id % 6 WHEN 0 THEN concat('{{"prompt_tokens":', {_K}, ',"completion_tokens":', event_id % 50, ',"prompt_tokens_details":{{"cached_tokens":', event_id % 120, '}}}}') WHEN 1 THEN concat('{{"input_tokens":', {_K}, ',"output_tokens":', event_id % 50, ',"cache_read_input_tokens":', event_id % 120, ',"cache_creation_input_tokens":', event_id % 7, '}}')
    WHEN 2 THEN concat('{{"prompt_tokens":0,"input_tokens":', {_K}, ',"completion_tokens":"', event_id % 9, '"}}') WHEN 3 THEN concat('{{"input_tokens":', {_K}, '}}') WHEN 4 THEN concat('{{"prompt_tokens":-5,"completion_tokens":-1,"cache_read_input_tokens":', {_K}, '}}') ELSE 'null' END"""


def _usage() -> Column:
    e, k = F.col("event_id"), F.get_json_object("props", "$.k")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return (
        F.when(e % 6 == 0, text('{"prompt_tokens":', k, ',"completion_tokens":', e % 50, ',"prompt_tokens_details":{"cached_tokens":', e % 120, "}}"))
        .when(e % 6 == 1, text('{"input_tokens":', k, ',"output_tokens":', e % 50, ',"cache_read_input_tokens":', e % 120, ',"cache_creation_input_tokens":', e % 7, "}"))
        .when(e % 6 == 2, text('{"prompt_tokens":0,"input_tokens":', k, ',"completion_tokens":"', e % 9, '"}'))
        .when(e % 6 == 3, text('{"input_tokens":', k, "}"))
        .when(e % 6 == 4, text('{"prompt_tokens":-5,"completion_tokens":-1,"cache_read_input_tokens":', k, "}"))
        .otherwise("null")
    )


_FIRST = lambda a, b: f"CASE WHEN coalesce(TRY_CAST(u ->> '{a}' AS BIGINT), 0) > 0 THEN CAST(u ->> '{a}' AS BIGINT) ELSE greatest(0, coalesce(TRY_CAST(u ->> '{b}' AS BIGINT), 0)) END"
_NORMAL = f"""n AS (SELECT *, {_FIRST('prompt_tokens', 'input_tokens')} AS prompt, {_FIRST('completion_tokens', 'output_tokens')} AS completion FROM u),
    f AS (SELECT *, greatest(0, least(coalesce(nullif(TRY_CAST(u -> 'prompt_tokens_details' ->> 'cached_tokens' AS BIGINT), 0), TRY_CAST(u ->> 'cache_read_input_tokens' AS BIGINT), 0), prompt)) AS cached, greatest(0, least(coalesce(TRY_CAST(u ->> 'cache_creation_input_tokens' AS BIGINT), 0), prompt)) AS creation FROM n)"""


@query("normalize_usage", f"WITH u AS (SELECT event_id, CAST({_USAGE} AS JSON) AS u FROM events), {_NORMAL} SELECT event_id, prompt, completion, cached, creation FROM f")
def _(t):
    return t("events").select("event_id", bodies.usage(_usage()).alias("u")).select("event_id", "u.*")


_EVENT = f"concat('event: message', chr(10), CASE WHEN event_id % 7 = 0 THEN 'data: [DONE]' WHEN event_id % 7 = 1 THEN ': comment' ELSE concat('data: ', '{{\"choices\":', CASE WHEN event_id % 2 = 0 THEN '[]' ELSE '[1]' END, ',\"usage\":', {_USAGE}, '}}') END, chr(10), 'data: {{}}')"


@query(
    "sse_usage_extract",
    f"""WITH e AS (SELECT event_id, {_EVENT} AS x FROM events), d AS (SELECT event_id, trim(regexp_extract(x, '(?:^|\n)data:([^\n]*)', 1)) AS line FROM e), j AS (SELECT event_id, CASE WHEN line NOT IN ('', '[DONE]') THEN TRY_CAST(line AS JSON) END AS j FROM d),
    u AS (SELECT event_id, j, j -> 'usage' AS u FROM j WHERE json_type(j -> 'usage') = 'OBJECT'), {_NORMAL}
    SELECT event_id, prompt, completion, cached, creation, coalesce(CAST(j -> 'choices' AS VARCHAR) = '[]', false) AS only_usage FROM f
    WHERE (json_exists(u, '$.prompt_tokens') OR json_exists(u, '$.input_tokens')) AND (json_exists(u, '$.completion_tokens') OR json_exists(u, '$.output_tokens'))""",
)
def _(t):
    """Usage of the events of a stream that report both sides of it; only_usage: nothing else is in the event."""
    body = F.when(F.col("event_id") % 7 == 0, "data: [DONE]").when(F.col("event_id") % 7 == 1, ": comment").otherwise(F.concat(F.lit('data: {"choices":'), F.when(F.col("event_id") % 2 == 0, "[]").otherwise("[1]"), F.lit(',"usage":'), _usage(), F.lit("}")))
    event = F.concat(F.lit("event: message\n"), body, F.lit("\ndata: {}"))
    found = t("events").select("event_id", bodies.event_usage(event).alias("u")).where("u IS NOT NULL")
    return found.select("event_id", "u.*")


@query("sse_stream", "WITH b AS (SELECT conv_id, string_agg(concat('data: ', turn, ' ', replace(text, chr(10), ' ')), chr(10) || chr(10) ORDER BY turn, text) AS body FROM conversations GROUP BY 1), p AS (SELECT conv_id, string_split(body, chr(10) || chr(10)) AS parts FROM b) SELECT conv_id, CAST(i - 1 AS INT) AS part, sha256(parts[i]) AS event FROM p, range(1, 1000000) AS t(i) WHERE i <= len(parts)")
def _(t):
    """A stream's body is the turns of a conversation; its events are split at blank lines."""
    line = F.concat(F.lit("data: "), F.col("turn").cast("string"), F.lit(" "), F.replace("text", F.lit("\n"), F.lit(" ")))
    lines = F.array_sort(F.collect_list(F.struct("turn", "text", line.alias("line"))))
    bodies_ = t("conversations").groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n\n").alias("body"))
    return bodies_.select("conv_id", F.posexplode(F.split("body", "\n\n")).alias("part", "event")).select("conv_id", "part", F.sha2("event", 256).alias("event"))


_ANSWER = """CASE event_id % 6 WHEN 0 THEN concat('{"model":"m', event_id % 9, '","gateway":{"provider":"', event_type, '"},"error":{"provider":"no"}}') WHEN 1 THEN concat('{"detail":{"type":"routing_error","provider":"', event_type, '"}}') WHEN 2 THEN concat('{"model":"", "error":{"provider":"', event_type, '"}}')
    WHEN 3 THEN '{"gateway":"x","detail":["provider"]}' WHEN 4 THEN concat('{"model":"', repeat('m', CAST(event_id % 5 AS INT)), '"') ELSE concat('{"pad":"', repeat('x', 1000000), '","gateway":{"provider":"y"}}') END"""


@query("peek_model", f"WITH b AS (SELECT event_id, {_ANSWER} AS body FROM events WHERE event_id % 6 < 5 OR event_id % 3000 = 5), j AS (SELECT event_id, CASE WHEN length(body) <= 1000000 THEN TRY_CAST(body AS JSON) END AS j FROM b) SELECT event_id, coalesce(j ->> 'model', '') AS model, coalesce(nullif(j -> 'gateway' ->> 'provider', ''), nullif(j -> 'detail' ->> 'provider', ''), nullif(j -> 'error' ->> 'provider', ''), '') AS provider FROM j")
def _(t):
    """Model and provider that an answer's body names; bodies that are no JSON or over a million characters name none."""
    e, kind = F.col("event_id"), F.col("event_type")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    body = (
        F.when(e % 6 == 0, text('{"model":"m', e % 9, '","gateway":{"provider":"', kind, '"},"error":{"provider":"no"}}')).when(e % 6 == 1, text('{"detail":{"type":"routing_error","provider":"', kind, '"}}'))
        .when(e % 6 == 2, text('{"model":"", "error":{"provider":"', kind, '"}}')).when(e % 6 == 3, '{"gateway":"x","detail":["provider"]}').when(e % 6 == 4, text('{"model":"', F.repeat(F.lit("m"), (e % 5).cast("int")), '"'))
        .otherwise(text('{"pad":"', F.repeat(F.lit("x"), 1_000_000), '","gateway":{"provider":"y"}}'))
    )
    return t("events").where("event_id % 6 < 5 OR event_id % 3000 = 5").select("event_id", body.alias("body")).select("event_id", bodies.model(F.col("body")).alias("model"), bodies.provider(F.col("body")).alias("provider"))


_FAILED = "concat(left(text, 30), CASE doc_id % 5 WHEN 0 THEN ' Maximum Context length is ' WHEN 1 THEN ' too many tokens ' WHEN 2 THEN ' context windows' ELSE '' END, right(text, 30))"


@query("classify_failure", f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND regexp_matches(lower({_FAILED}), 'context length|maximum context|too many tokens|context window') THEN 'overflow' ELSE 'error' END AS failure FROM documents")
def _(t):
    kind = F.col("doc_id") % 5
    message = F.concat(F.left("text", F.lit(30)), F.when(kind == 0, " Maximum Context length is ").when(kind == 1, " too many tokens ").when(kind == 2, " context windows").otherwise(""), F.right("text", F.lit(30)))
    return t("documents").select("doc_id", scope.classify_failure(F.when(F.col("doc_id") % 3 == 0, 400).otherwise(500), message).alias("failure"))


@query("cap_list_with_marker", "WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents) SELECT doc_id, sha256(array_to_string(CASE WHEN len(w) > 100 THEN list_append(w[1:100], concat('+', len(w) - 100)) ELSE w END, '|')) AS capped FROM w")
def _(t):
    """The words of a text as a list that is cut after a hundred."""
    rows = t("documents").select("doc_id", F.split("text", " ").alias("w"))
    return rows.select("doc_id", F.sha2(F.array_join(bodies.capped(F.col("w"), 100), "|"), 256).alias("capped"))


@query("host_allowed", "SELECT page_id, regexp_matches(host, '(^|\\.)example\\.(com|org)$') AS allowed FROM (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages)")
def _(t):
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    domains = F.array(F.lit("example.com"), F.lit("example.org"))
    return t("pages").select("page_id", F.exists(domains, lambda d: (host == d) | host.endswith(F.concat(F.lit("."), d))).alias("allowed"))


@query("token_cap", "SELECT event_id, CASE WHEN asked <= 0 THEN 1024 ELSE least(asked, 4096) END AS tokens, CASE WHEN asked <= 0 THEN 1024 ELSE asked END AS free FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0 ELSE CAST(floor(value * 40) AS BIGINT) - 100 END AS asked FROM events)")
def _(t):
    asked = F.when(F.col("event_id") % 7 == 0, F.lit(0)).otherwise(F.floor(F.col("value") * 40) - 100)
    return t("events").select("event_id", scope.token_cap(asked, 1024, 4096).cast("long").alias("tokens"), scope.token_cap(asked, 1024, 0).cast("long").alias("free"))


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_FORMS = {"plain": "x", "upper": f"translate(x, '{_LETTERS}', '{_LETTERS.upper()}')", "spaced": "regexp_replace(x, '(.)', '\\1 ', 'g')", "quoted": "concat('\"', x, '\"')", "cut": "left(x, 100)", "twice": "concat(x, chr(10), x)"}


@query("ood_perturb", "WITH f AS (SELECT lang, arg_min(text, doc_id) AS x FROM documents GROUP BY 1) " + " UNION ALL ".join(f"SELECT lang, '{k}' AS variant, sha256({v}) AS digest FROM f" for k, v in _FORMS.items()))
def _(t):
    first = t("documents").groupBy("lang").agg(F.min_by("text", "doc_id").alias("text"))
    x = F.col("text")
    forms = {"plain": x, "upper": F.translate(x, _LETTERS, _LETTERS.upper()), "spaced": F.regexp_replace(x, "(.)", "$1 "), "quoted": F.concat(F.lit('"'), x, F.lit('"')), "cut": F.left(x, F.lit(100)), "twice": F.concat(x, F.lit("\n"), x)}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("variant"), F.sha2(v, 256).alias("digest")) for k, v in forms.items())))
    return first.select("lang", each.alias("p")).select("lang", "p.variant", "p.digest")


@query("sampling_skip", "SELECT r.id, w.key_name IS NOT NULL AS white, w.key_name IS NULL OR r.id % 20 = 0 AS judged FROM request_log r LEFT JOIN (SELECT DISTINCT key_name FROM key_rules WHERE kind = 'white') w ON r.key_name = w.key_name", ("request_log", "key_rules"))
def _(t):
    white = t("key_rules").where("kind = 'white'").select("key_name", F.lit(True).alias("_white")).distinct()
    rows = t("request_log").join(white, "key_name", "left")
    known = F.coalesce("_white", F.lit(False))
    return rows.select("id", known.alias("white"), (~known | (F.col("id") % 20 == 0)).alias("judged"))


@query("file_keyword_flags", f"WITH {_P} SELECT doc_id, regexp_matches(text, '工资|财务|预算') AS financial, regexp_matches(text, '图纸|施工图') AS drawing FROM p")
def _(t):
    flag = lambda words: F.col("text").rlike(words)
    return _planted(t).select("doc_id", flag("工资|财务|预算").alias("financial"), flag("图纸|施工图").alias("drawing"))


@query("redact_entry", f"WITH {_P} SELECT doc_id, strpos({_redacted_sql()}, 'REDACTED') > 0 AS text_changed, concat('[REDACTED:aws-access-key] ', doc_id % 3) AS reason FROM p")
def _(t):
    rows = _planted(t).select("doc_id", F.struct("text", F.array(F.concat(F.lit("AKIA"), F.lit("ABCDEFGHIJKLMNOP "), (F.col("doc_id") % 3).cast("string"))).alias("reasons")).alias("e"))
    clean = rows.select("doc_id", inspection.redact_secrets(F.col("e.text")).alias("text"), F.transform("e.reasons", inspection.redact_secrets).alias("reasons"))
    return clean.select("doc_id", F.col("text").contains("REDACTED").alias("text_changed"), F.element_at("reasons", 1).alias("reason"))


@query(
    "scope_blocks",
    """WITH r AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC, text DESC) AS k FROM conversations),
    c AS (SELECT conv_id, coalesce(max(text) FILTER (role = 'user' AND k = 1), '') AS last, coalesce(max(text) FILTER (role = 'system' AND k = 1), '') AS tool, coalesce(max(text) FILTER (role = 'user' AND k = 2), '') AS before FROM r GROUP BY 1),
    s AS (SELECT conv_id, list_filter([{'n': 'last_user', 't': trim(left(last, 300))}, {'n': 'tool', 't': trim(left(tool, 300))}, {'n': 'history', 't': trim(right(before, 300))}], lambda x: x.t <> '') AS first, substr(last, 301) AS rest FROM c),
    w AS (SELECT *, CAST(ceil(length(rest) / 300) AS BIGINT) AS m, 5 - len(first) AS slots FROM s),
    i AS (SELECT *, CASE WHEN slots < 1 OR m = 0 THEN [] WHEN m <= slots THEN range(m) WHEN slots = 1 THEN [m - 1] ELSE list_sort(list_distinct([CAST(round_even(j * (m - 1) / CAST(slots - 1 AS DOUBLE), 0) AS BIGINT) for j in range(slots)])) END AS at_ FROM w),
    f AS (SELECT *, list_reduce(list_prepend({'used': coalesce(CAST(list_sum([length(x.t) for x in first if x.n <> 'last_user']) AS BIGINT), 0), 'out': CAST([] AS VARCHAR[])}, [{'used': length(trim(substr(rest, j * 300 + 1, 300))), 'out': [trim(substr(rest, j * 300 + 1, 300))]} for j in at_]),
      lambda acc, x: CASE WHEN x.used > 0 AND acc.used + x.used <= 900 THEN {'used': acc.used + x.used, 'out': list_concat(acc.out, x.out)} ELSE acc END).out AS long FROM i)
    SELECT conv_id, CAST(len(first) + len(long) AS INT) AS n, array_to_string(list_concat([x.n for x in first], ['long_text' for x in long]), ',') AS names, sha256(array_to_string(list_concat([x.t for x in first], long), chr(10))) AS texts FROM f""",
)
def _(t):
    """Blocks of each conversation: the last user text, the last system text as its tool result, the user text before, windows of the rest."""
    size, budget = 300, 900
    from pyspark.sql import Window

    latest = Window.partitionBy("conv_id", "role").orderBy(F.desc("turn"), F.desc("text"))
    # two turns of a role at most leave each task, however long the conversation
    turns = t("conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("k", F.row_number().over(latest)).where("k <= 2")
    back = lambda role, k: F.coalesce(F.max(F.when((F.col("role") == role) & (F.col("k") == k), F.col("text"))), F.lit(""))
    rows = turns.groupBy("conv_id").agg(back("user", 1).alias("last"), back("system", 1).alias("tool"), back("user", 2).alias("before"))
    rows = rows.select("conv_id", scope.blocks(F.col("last"), F.col("tool"), F.col("before"), size, budget).alias("blocks"))
    return rows.select("conv_id", F.size("blocks").alias("n"), F.array_join("blocks.name", ",").alias("names"), F.sha2(F.array_join("blocks.text", "\n"), 256).alias("texts"))


@query("tools_text", "SELECT doc_id, sha256(concat(left(concat('{\"name\":\"', lang, '\",\"about\":\"', x, '\"}'), 4000), chr(10), left(concat('{\"name\":\"', source, '\"}'), 4000))) AS tools FROM (SELECT *, regexp_replace(text, '[^A-Za-z0-9 .,]', '', 'g') AS x FROM documents)")
def _(t):
    """Two tools for each text, one described by it."""
    plain = F.regexp_replace("text", "[^A-Za-z0-9 .,]", "")
    tools = F.array(F.struct(F.col("lang").alias("name"), plain.alias("about")), F.struct(F.col("source").alias("name"), F.lit(None).cast("string").alias("about")))
    return t("documents").select("doc_id", F.sha2(bodies.tools_text(tools), 256).alias("tools"))


_FIN = "|".join(files.FINANCIAL)
_CELLS = f"list_filter(list_transform(string_split(text, chr(10)), lambda l: list_filter(list_transform(string_split(l, ','), lambda c: trim(c)), lambda c: c <> '')), lambda r: len(r) > 0)[1:5]"


@query(
    "source_files",
    f"""WITH f AS (SELECT doc_id % 3 AS kind, concat(doc_id, CASE doc_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.txt' ELSE '.csv' END) AS name, CASE doc_id % 3 WHEN 0 THEN concat('name,工资,date', chr(10), replace(text, '"', '')) WHEN 1 THEN '' ELSE replace(text, '"', '') END AS text FROM documents),
    h AS (SELECT *, list_filter({_CELLS}, lambda r, i: len(r) >= 3 OR i = 1 AND len(r) >= 2 OR len(r) > 1 AND regexp_matches(array_to_string(r, ' '), '{_FIN}'))[1] AS found FROM f)
    SELECT name, CASE kind WHEN 1 THEN 'pdf' ELSE 'text' END AS kind, kind = 1 AND name NOT LIKE '%.pdf' AS mismatch, CASE WHEN name LIKE '%.csv' THEN coalesce(array_to_string(list_transform(found[1:{files.HEADERS}], lambda c: left(c, {files.HEADER_CHARS})), '|'), '') ELSE '' END AS headers,
    CAST(least({files.CHUNKS}, ceil(length(text) / {files.CHUNK})) AS INT) AS chunks, regexp_matches(text, '{_FIN}') AS financial FROM h""",
)
def _(t):
    """Files by their bytes, with endings that fit and don't: tables, texts and a document format that isn't read."""
    plain, k = F.replace("text", F.lit('"'), F.lit("")), F.col("doc_id") % 3
    content = F.when(k == 0, F.encode(F.concat(F.lit("name,工资,date\n"), plain), "UTF-8")).when(k == 1, F.concat(F.lit(b"%PDF-1.4\x00"), F.encode("text", "UTF-8"))).otherwise(F.encode(plain, "UTF-8"))
    ending = F.when(F.col("doc_id") % 5 == 0, ".pdf").when(F.col("doc_id") % 5 == 1, ".txt").otherwise(".csv")
    rows = t("documents").select(F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), ending).alias("path"), content.alias("content"))
    return files.inspected(rows).select("name", "kind", "mismatch", F.array_join("headers", "|").alias("headers"), F.size("chunks").alias("chunks"), "financial")

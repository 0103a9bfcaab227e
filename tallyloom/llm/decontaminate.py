"""Benchmark decontamination by winnowing, in built-in expressions only.

A window is WINDOW = 13 words; it holds nine runs of GRAM = 5 words, and the least of their hashes is the window's
fingerprint. Equal windows have equal fingerprints, so joining fingerprints misses no shared window. Neighbouring
windows mostly share their fingerprint: each stretch of equal fingerprints is one row, about a fifth of the
words. Rows whose fingerprint the benchmark has are then extended: each of their windows is held against the
benchmark's by a hash of all its words. Both hashes must agree, which takes well over 64 bits.

All lengths are found in one pass over the documents. While the benchmark has at most LISTED fingerprints, rows without any
of them end inside that pass. Its tables are broadcast only while they take at most BROADCAST_BYTES; beyond that the joins shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialized, quoted

WINDOW = 13
GRAM = 5
#: Contaminated: SHARE * words hit >= words.
SHARE = 20
BROADCAST_BYTES = 48 << 20
LISTED = 10_000
# Words are lower-cased after they are split, so A-Z count as letters here.
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RUNS = "array<struct<n:int,fp:bigint,at:int,windows:array<bigint>>>"


def _lower(word: Column) -> Column:
    """A-Z only: lower() would change other letters too, so it only gets ASCII words."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def word_hashes(text: Column) -> Column:
    """One hash for each lower-cased word; null: none."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{_SEPARATORS}|{_SEPARATORS}$", "")
    return let(bare, lambda t: F.when(t == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(t, _SEPARATORS), lambda w: F.xxhash64(_lower(w)))))


def _over(first: int, last: Column, f) -> Column:
    return F.transform(F.sequence(F.lit(first), last), f)


def winnowed(hashes: Column, known: set[int] | None = None) -> Column:
    """Stretches of windows with one fingerprint: n (WINDOW), fp, at (the first window's place) and the windows' hashes.

    With known, only the stretches with these fingerprints; the hashes of other windows aren't made then.
    """

    def runs(h: Column) -> Column:
        last = F.size(h) - WINDOW  # the last window's place
        grams = _over(0, F.size(h) - GRAM, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(GRAM))))

        def of_grams(g: Column) -> Column:
            threes = _over(0, F.size(g) - 3, lambda i: F.least(F.get(g, i), F.get(g, i + 1), F.get(g, i + 2)))
            whole = lambda first, to: F.transform(F.sequence(first, to), lambda i: F.xxhash64(F.get(g, i), F.get(g, i + 4), F.get(g, i + 8)))

            def of_least(m: Column) -> Column:
                starts = F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | (F.get(m, i) != F.get(m, i - 1)))
                ends = lambda s: F.transform(s, lambda a, j: F.struct(F.get(m, a).alias("fp"), a.alias("at"), (F.coalesce(F.get(s, j + 1), last + 1) - 1).alias("to")))
                some = let(starts, ends)
                some = some if known is None else F.filter(some, lambda x: x["fp"].isin(known))
                return F.transform(some, lambda x: F.struct(F.lit(WINDOW).alias("n"), x["fp"].alias("fp"), x["at"].alias("at"), whole(x["at"], x["to"]).alias("windows")))

            return let(let(threes, lambda t: _over(0, last, lambda i: F.least(F.get(t, i), F.get(t, i + 3), F.get(t, i + 6)))), of_least)

        return F.when(F.size(h) >= WINDOW, let(grams, of_grams)).otherwise(F.array().cast(_RUNS))

    return let(hashes, runs)


def _short(hash_of_words: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), hash_of_words)


def short_windows(hashes: Column, n: int, known: set[int] | None = None) -> Column:
    """Every run of n words, in the form of winnowed: its hash is its fingerprint and its only window."""

    def of(h: Column) -> Column:
        each = _over(0, F.size(h) - n, lambda i: F.struct(_short(F.slice(h, i + 1, n), n).alias("fp"), i.alias("at")))
        some = each if known is None else F.filter(each, lambda x: x["fp"].isin(known))
        return F.when(F.size(h) >= n, F.transform(some, lambda x: F.struct(F.lit(n).alias("n"), x["fp"].alias("fp"), x["at"].alias("at"), F.array(x["fp"]).alias("windows")))).otherwise(F.array().cast(_RUNS))

    return let(hashes, of)


def _sized(table: DataFrame, row_bytes: Column) -> DataFrame:
    """table, a materialized one, broadcast only if its rows take at most BROADCAST_BYTES."""
    size = table.agg(F.sum(row_bytes)).first()[0] or 0
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def identity(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Two numbers that tell rows with different ids or texts apart: the doc_id (or a hash of the text) and a hash of both."""
    return F.coalesce(doc_id.cast("long"), F.xxhash64(F.lit("id"), text)).alias("_id"), F.xxhash64(text, doc_id, F.lit("key")).alias("_key")


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """What of each row of docs (doc_id, text) occurs in benchmark (item_id, text).

    doc_id, n_words, n_hit (words inside an occurrence of a window), n_items and items_sha256 (of the items with
    occurring windows, sorted as strings and comma-joined), contaminated, and _id and _key, which tell rows with one doc_id
    and different texts apart. An item with fewer than WINDOW words is one window. Null and empty texts have
    no words; items without words have no window; null item_ids are left out of the items. Rows that repeat
    come out as often as they came; empty tables give no rows or no hits; other columns aren't read.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), word_hashes(F.col("text").cast("string")).alias("h")).where(F.size("h") > 0)
    whole = F.struct(F.size("h").alias("n"), _short(F.col("h"), F.size("h")).alias("fp"), F.lit(0).alias("at"), F.array(_short(F.col("h"), F.size("h"))).alias("windows"))
    runs = F.when(F.size("h") >= WINDOW, winnowed(F.col("h"))).otherwise(F.array(whole))
    members = items.select("item_id", F.explode(runs).alias("r")).select("item_id", "r.n", "r.fp", F.explode("r.windows").alias("win"))
    members = materialized(members.distinct())
    windows = materialized(members.select("n", "fp", "win").distinct())
    prints = materialized(windows.select("n", "fp").distinct())
    lengths = sorted(r["n"] for r in prints.select("n").distinct().collect())  # at most WINDOW
    few = {n: set() for n in lengths} if prints.count() <= LISTED else None
    if few is not None:
        for r in prints.collect():
            few[r["n"]].add(r["fp"])
    listed = lambda n: None if few is None else few[n]

    def found(h: Column) -> Column:
        """The row itself (its n: the words), then the stretches that the benchmark may have."""
        row = F.array(F.struct(F.size(h).alias("n"), F.lit(None).cast("long").alias("fp"), F.lit(-1).alias("at"), F.array().cast("array<bigint>").alias("windows")))
        return F.concat(row, *(winnowed(h, listed(n)) if n == WINDOW else short_windows(h, n, listed(n)) for n in lengths))

    rows = docs.select("doc_id", *identity(F.col("doc_id"), _text()), F.explode_outer(let(word_hashes(_text()), found)).alias("c"))  # never empty; explode() would make it twice, to test that
    rows = rows.select("doc_id", "_id", "_key", "c.*")
    known = _sized(prints.select(F.col("n").alias("_n"), F.col("fp").alias("_fp")), F.lit(24))
    # rows have no fingerprint: they take part in the join by their key, so that they don't meet in one task
    rows = rows.join(known, (F.col("n") == F.col("_n")) & (F.coalesce("fp", "_key") == F.col("_fp")), "left").where("fp IS NULL OR _fp IS NOT NULL")
    rows = materialized(rows.drop("_n", "_fp"))
    each = rows.where("fp IS NOT NULL").select("_id", "_key", "n", "fp", "at", F.posexplode("windows").alias("pos", "win"))
    hits = each.join(_sized(windows, F.lit(32)), ["n", "fp", "win"])
    spans = F.collect_set(F.struct((F.col("at") + F.col("pos")).alias("a"), (F.col("at") + F.col("pos") + F.col("n")).alias("b")))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(acc["to"], x["a"]))).alias("n"), F.greatest(acc["to"], x["b"]).alias("to"))
    covered = hits.groupBy("_id", "_key").agg(spans.alias("spans")).select("_id", "_key", F.aggregate(F.array_sort("spans"), zero, step)["n"].cast("long").alias("n_hit"))
    # items are joined to different windows and collected after that, so a window that all items share is one row until then
    names = hits.select("_id", "_key", "n", "fp", "win").distinct().join(_sized(members, F.coalesce(F.octet_length("item_id"), F.lit(0)) + 48), ["n", "fp", "win"])
    names = names.select("_id", "_key", "item_id").distinct().groupBy("_id", "_key").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    of_rows = rows.where("fp IS NULL").select("doc_id", "_id", "_key", F.col("n").cast("long").alias("n_words"))
    return of_rows.join(covered.join(names, ["_id", "_key"]), ["_id", "_key"], "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated"),
        "_id",
        "_key",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns, whatever their names.

    Null and empty texts stay, rows that repeat stay or go together, an empty table gives no rows and an empty benchmark drops none.
    """
    bad = decontaminate(docs, benchmark).where("contaminated").select(F.col("_id").alias("_bad_id"), F.col("_key").alias("_bad_key")).distinct()
    row = F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("_row")  # so that no column of docs clashes with those of bad
    rows = docs.select(row, *identity(F.col("doc_id"), _text()))
    kept = rows.join(bad, (F.col("_id") == F.col("_bad_id")) & (F.col("_key") == F.col("_bad_key")), "left_anti")
    return kept.select(*(F.col("_row")[c].alias(c) for c in docs.columns))


SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[k : k + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM w, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT doc_id, dw.n, k, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS items_sha256
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY 1)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

"""SimHash near-duplicates through a grid of segment bit counts.

A fingerprint's 32 segments of two bits each have 0, 1 or 2 bits set; those counts are its point in a grid.
One differing bit moves the point by one, so the Manhattan distance of two points never exceeds the Hamming
distance of the fingerprints. In thermometer code (00, 01, 11 for 0, 1, 2) that distance is the bit count of
an exclusive or. Points within MAX_BITS = 3 of each other differ on at most three of six groups of axes (more of
them for more fingerprints), so they meet in the projection on some three of the groups: fingerprints are joined on the 20 projections,
then held against the Manhattan bound and then compared exactly. Only distinct fingerprints are joined, so a
group of copies counts once, however large; a set of fingerprints that are all within three bits of each other has at most
128 members, so links stay few beside the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialized, quoted, spread_join
from .components import connected_components

SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: Members of a cell beyond which it is split.
HOT_CELL = 5_000
#: How often a cell is split further at most, and how many times more members it must have for each further split, which makes over a hundred rows of one.
LEVELS = 2
HOTTER = 10
#: Shingle hashes whose bits are counted at once.
CHUNK = 1 << 16
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_LOW_BITS = 0x5555555555555555


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None) -> int:
    """64-bit fingerprint, signed: a bit is set where over half the shingles' XXH64 have it; no words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return _signed(xxhash.xxh64_intdigest(b" ".join(words), SEED))
    n = len(words) - SHINGLE + 1
    digest, bits = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, n, CHUNK):
        part = words[at : at + CHUNK + SHINGLE - 1]
        h = np.array([digest(s, SEED) for s in map(b" ".join, zip(part, part[1:], part[2:]))], dtype=">u8")
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > n).view(">i8")[0])


def text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("key"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the text) and fp (long) of docs (doc_id, text); other columns are not read. Null text: no words."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["doc_id", "key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, key long, fp long")


def _thermometer(fp: Column) -> Column:
    next_bit, low = F.shiftrightunsigned(fp, 1), F.lit(_LOW_BITS)
    return fp.bitwiseOR(next_bit).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(next_bit).bitwiseAND(low), 1))


def _projections(groups: int) -> list[int]:
    """Bit masks of all choices of groups - MAX_BITS groups of axes."""
    cuts = [round(i * 32 / groups) for i in range(groups + 1)]
    masks = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(cuts, cuts[1:])]
    return [_signed(sum(c)) for c in combinations(masks, groups - MAX_BITS)]


def _groups_for(n: int) -> int:
    """More groups give more rows to join but fewer candidates in each cell."""
    return 6 if n <= 20_000_000 else 8 if n <= 2_000_000_000 else 10


def _cells(rows: DataFrame, groups: int, p: str, cell: str) -> DataFrame:
    """Each of rows (fp, point, ...) once for every projection p of its point, with the cell that it falls into."""
    cells = F.array(*(F.struct(F.lit(i).alias("p"), F.col("point").bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(_projections(groups))))
    return rows.withColumn("_c", F.explode(cells)).withColumn(p, F.col("_c.p")).withColumn(cell, F.col("_c.cell")).drop("_c")


def _hot_cells(rows: DataFrame, keys: list[str], hot_cell: int) -> DataFrame:
    """The cells with some hot_cell members or more, counted on the share of fingerprints that shows them by 256 members."""
    every = max(1, hot_cell // 256)
    some = rows.where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0) if every > 1 else rows
    return materialized(some.groupBy(*keys).count().where(F.col("count") * every > hot_cell).select(*keys))


def links(reps: DataFrame, groups: int | None = None, hot_cell: int = HOT_CELL) -> DataFrame:
    """u < v: all pairs of the distinct fingerprints reps.fp (a stable table) that differ in 1 to MAX_BITS bits.

    Points of a cell with more than some hot_cell members are projected again, with two groups more, and where HOTTER times as many stay together once more: two points within the
    bound share one of those cells as well, so such a cell splits and no link is lost. Which cells are split decides how long it takes, never what is found.
    """
    n = reps.count()
    groups = groups or _groups_for(n)
    rows, keys, found = _cells(reps.select("fp", _thermometer(F.col("fp")).alias("point")), groups, "p0", "cell0"), ["p0", "cell0"], []
    u, v = F.col("u"), F.col("v")

    def pairs(rows: DataFrame) -> DataFrame:
        a, b = rows.select(*keys, F.col("fp").alias("u")), rows.select(*keys, F.col("fp").alias("v"))
        manhattan = F.bit_count(_thermometer(u).bitwiseXOR(_thermometer(v)))
        return a.join(b, keys).where((u < v) & (manhattan <= MAX_BITS) & (F.bit_count(u.bitwiseXOR(v)) <= MAX_BITS)).select("u", "v")

    for level in range(1, LEVELS + 1):
        if n <= hot_cell:
            break
        hot = _hot_cells(rows, keys, hot_cell * HOTTER ** (level - 1))
        many = hot.count()
        if not many:
            break
        hot = F.broadcast(hot) if many <= 100_000 else hot
        found.append(pairs(rows.join(hot, keys, "left_anti")))
        rows = _cells(rows.join(hot, keys, "left_semi"), groups + 2 * level, f"p{level}", f"cell{level}")
        keys = [*keys, f"p{level}", f"cell{level}"]
    out = pairs(rows)
    for x in found:
        out = out.union(x)
    return out.distinct()


def _members(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the text), fp, root (the least fingerprint reachable over links) and component_id of each row of docs."""
    fps = materialized(fingerprints(docs))
    reps = materialized(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(reps))
    linked = reps.join(roots.withColumnRenamed("node", "fp"), "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = linked.join(least, "root").select("fp", "root", "component_id")
    known = reps.join(moved, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    return spread_join(fps, known, "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable over links) of each row.

    Rows with equal fingerprints are linked. Null doc_ids don't count as smallest; a component of null doc_ids
    only has a null component_id. An empty table gives no rows.
    """
    return _members(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that stand for their component: one row for each, among those with its smallest doc_id.

    Of several such rows the first by text and then by all its columns as JSON stays; a doc_id whose rows belong to several components
    keeps one row for each. Rows without a doc_id can't be told apart by it and all stay. All columns
    of docs are kept, whatever their names; an empty table gives no rows.
    """
    least = materialized(_members(docs).where("doc_id = component_id").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("root").alias("_root")))
    roots = least.groupBy("_root").agg(F.count("*").alias("_n"), F.min("_id").alias("_id"), F.min("_key").alias("_key"))
    row = F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("_row")  # so that no column of docs clashes with those joined here
    rows = docs.select(row, F.col("doc_id").cast("long").alias("_id"), text_key().alias("_key"))
    kept = rows.join(roots.where("_n = 1").select("_id", "_key"), ["_id", "_key"], "left_semi").select("_row").union(rows.where("_id IS NULL").select("_row"))
    repeated = least.join(roots.where("_n > 1").select("_root"), "_root").distinct()
    if not repeated.isEmpty():
        first = F.min_by("_row", F.struct(F.coalesce(F.col("_row")["text"].cast("string"), F.lit("")), F.to_json("_row")))
        kept = kept.union(rows.where("_id IS NOT NULL").join(repeated, ["_id", "_key"]).groupBy("_root").agg(first.alias("_row")).select("_row"))
    return kept.select(*(F.col("_row")[c].alias(c) for c in docs.columns))

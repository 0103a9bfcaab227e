"""Best-two-fit packing of token pieces into sequences of a fixed length.

The plan only needs how many pieces there are of each length, which is at most one number for each length up
to the sequence length, whatever the size of the corpus. Pieces then get their place from their length and
their rank among the pieces of that length, so no task and no driver ever holds the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialized, shuffle_partitions
from .tokens import encoder

SEQUENCE = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, vocabulary: str, size: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """Pieces of docs (doc_id, text): the ids of the whole text and id 0, cut only where longer than size.

    All pieces but the first have size tokens. A null or empty text is one piece with id 0. Every row counts,
    rows with equal doc_id too; other columns are not read. with_ids adds the ids as little-endian bytes.
    """
    bounded_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ended
        for batch in batches:
            ids, ends = encode(batch.column(1))
            data = memoryview(ids.astype("<u4", copy=False).tobytes())
            n = np.diff(ends, prepend=0)
            pieces = -(-n // size)  # of each document
            doc = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = n - (pieces - 1) * size
            start = np.where(piece > 0, first[doc] + (piece - 1) * size, 0)
            length = np.where(piece > 0, size, first[doc])
            at = 4 * (ends - n)[doc] + 4 * start
            parts = [data[a:b] for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
            cols = [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(map(zlib.crc32, parts), pa.int64())]
            cols += [pa.array(parts, pa.binary())] if with_ids else []
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECES + ", ids binary" * with_ids)


def best_two_fit(counts: np.ndarray) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns [(length, times in a bin)...] and how many bins get each; counts[n]: pieces of length n.

    A bin is filled greedily with the longest piece that fits. Then its smallest piece s gives way to the two
    unpacked pieces that fill the gap, grown by s, best, if they fill it better than s does. The same pattern is
    used for as many bins as the counts allow, so the work depends on the number of lengths, not of pieces.
    """
    size, left, plan = len(counts) - 1, counts.astype(np.int64).copy(), []
    left[0] = 0
    while left.any():
        used, gap = np.zeros_like(left), size
        while gap and len(fits := np.flatnonzero(left[: gap + 1] > used[: gap + 1])):
            used[fits[-1]] += 1
            gap -= int(fits[-1])
        if gap and used.sum() > 1:
            s = int(np.flatnonzero(used)[0])
            room, free = gap + s, left - used
            lengths = np.flatnonzero(free[: room + 1] > 0)
            best, pair = s, None
            if len(lengths):
                # for each a the longest b <= room - a; a pair of equal lengths needs two of them
                at = np.searchsorted(lengths, room - lengths, side="right") - 1
                ok = at >= 0
                b = np.where(ok, lengths[at], 0)
                same = ok & (b == lengths) & (free[lengths] < 2)
                b = np.where(same, np.where(at > 0, lengths[np.maximum(at - 1, 0)], 0), b)
                total = np.where((b > 0), lengths + b, 0)
                k = int(total.argmax())
                if total[k] > best:
                    pair = (int(lengths[k]), int(b[k]))
            if pair:
                used[s] -= 1
                used[pair[0]] += 1
                used[pair[1]] += 1
        some = np.flatnonzero(used)
        bins = int((left[some] // used[some]).min())
        left[some] -= used[some] * bins
        plan.append(([(int(n), int(used[n])) for n in some[::-1]], bins))
    return plan


def plan_table(plan: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """The plan by length and rank: ranks from lo on of a length go to bins from seq on, times each, from offset on."""
    rows, seq, ranks = [], 0, {}
    for pattern, bins in plan:
        offset = 0
        for length, times in pattern:
            lo = ranks.get(length, 0)
            rows.append((length, lo, seq, times, offset))
            ranks[length] = lo + times * bins
            offset += length * times
        seq += bins
    rows.sort()
    names = ("length", "lo", "seq", "times", "offset")
    return {n: np.array([r[i] for r in rows], dtype=np.int64) for i, n in enumerate(names)}


def place(pieces: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """Adds sequence_id and offset to pieces.

    Ranks are counted within (length, salt) and shifted by the counts of the salts before, so that a length which
    many pieces share is spread over many tasks. Salts go by a running number, so equal rows are spread too.
    """
    spark = pieces.sparkSession
    salts = max(64, 4 * shuffle_partitions(spark))
    salted = materialized(pieces.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")))
    counts = materialized(salted.groupBy("length", "salt").agg(F.count("*").alias("n")))
    histogram = np.zeros(size + 1, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most one row for each length
        histogram[r["length"]] = r["n"]
    table = plan_table(best_two_fit(histogram))
    keys = table["length"] << 48 | table["lo"]
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(bases, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("base")).drop("salt", "base")
    names = [c for c in pieces.columns]
    shared = spark.sparkContext.broadcast((keys, table))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, table = shared.value
        for batch in batches:
            cols = dict(zip(batch.schema.names, batch.columns, strict=True))
            length, rank = (cols[c].to_numpy().astype(np.int64) for c in ("length", "rank"))
            k = np.searchsorted(keys, length << 48 | rank, side="right") - 1
            j, times = rank - table["lo"][k], table["times"][k]
            seq = table["seq"][k] + j // times
            offset = table["offset"][k] + j % times * length
            yield pa.RecordBatch.from_arrays([*(cols[c] for c in names), pa.array(seq), pa.array(offset)], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.select(*names, "rank").mapInArrow(assign, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, size: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """Pack docs (doc_id, text) into sequences of at most size tokens: one row for each piece with its place.

    An empty table gives no rows. With with_ids, ordering a sequence's rows by offset and joining their ids gives
    the training sequence.
    """
    return place(token_pieces(docs, vocabulary, size, with_ids), size)

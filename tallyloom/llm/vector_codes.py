"""Product codes for vectors by integer Lloyd rounds with Hamerly's bounds.

A vector's components become integers and its PARTS equal parts are coded apart. Every pass over the rows keeps, for each part,
its entry, an upper bound of the distance to it and a lower bound of the distance to the second nearest entry. When entries
have moved, the bounds are loosened by how far; only where they don't prove strictly that the entry is the nearest are
all entries compared, in whole numbers, so that ties go to the lower index as in a plain scan. Bounds are rounded outwards.

A pass reads the last pass's rows and writes its own, with one more row for each task: the sums and counts that its parts
took to another entry. Those are added up by Spark, and the driver only holds the codebooks. Rows of the pass before are removed
once the next one is written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, remove_path, spread_join

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Rows that a task codes at once.
BLOCK_ROWS = 8192
#: Labels up to which the sums by label are broadcast; with more the join shuffles.
BROADCAST_LABELS = 100_000
_STATE = "vec_id long, label string, v binary, a binary, u binary, l binary, moved array<bigint>"
_SCHEMA = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("v", pa.binary()), ("a", pa.binary()), ("u", pa.binary()), ("l", pa.binary()), ("moved", pa.list_(pa.int64()))])


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 + 1e-12)).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 - 1e-12)).astype(np.float32), np.float32(-np.inf))


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of each part to each entry, in whole numbers."""
    return (x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)[None]


class Codebooks:
    """Entries (parts, entries, width), how far each has moved at most since the last pass, and half the way to its nearest other entry at least."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries
        parts, k, _ = entries.shape
        apart = ((entries[:, :, None] - entries[:, None]) ** 2).sum(-1).astype(np.float64)
        apart[:, range(k), range(k)] = np.inf
        self.half = _down(np.sqrt(apart.min(2)) / 2) if k > 1 else np.full((parts, k), np.inf, np.float32)
        far = np.zeros((parts, k)) if before is None else np.sqrt(((entries - before) ** 2).sum(-1).astype(np.float64))
        self.moved = np.where(far > 0, _up(far), 0).astype(np.float64)
        others = np.repeat(self.moved[:, None], k, 1)
        others[:, range(k), range(k)] = 0
        self.others_moved = others.max(2)

    def scan(self, part: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest entry of each part (the lower index among equals), an upper and a second-nearest lower bound."""
        d = _squares(x, self.entries[part])
        rows = np.arange(len(x))
        a = d.argmin(1)
        near = d[rows, a].astype(np.float64)
        d[rows, a] = np.iinfo(np.int64).max
        second = np.sqrt(d.min(1).astype(np.float64)) if d.shape[1] > 1 else np.full(len(x), np.inf)
        return a.astype(np.uint8), _up(np.sqrt(near)), _down(second)

    def own(self, part: int, x: np.ndarray, a: np.ndarray) -> np.ndarray:
        """Squared distance of each part to its entry."""
        return ((x - self.entries[part][a]) ** 2).sum(1)

    def update(self, part: int, x: np.ndarray, a: np.ndarray, u: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries and bounds after the entries have moved; a full scan only where no bound is strict."""
        a, u, low = a.copy(), _up(u + self.moved[part][a]), _down(low - self.others_moved[part][a])
        open_ = np.flatnonzero(u >= np.maximum(low, self.half[part][a]))
        if len(open_):
            u[open_] = _up(np.sqrt(self.own(part, x[open_], a[open_]).astype(np.float64)))
            open_ = open_[u[open_] >= np.maximum(low[open_], self.half[part][a[open_]])]
        if len(open_):
            a[open_], u[open_], low[open_] = self.scan(part, x[open_])
        return a, u, low


def _rows(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    """A binary column of equally long values as a matrix."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.frombuffer(values.buffers()[1], dtype=np.int32)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]].view(dtype).reshape(len(values), width)


def _binary(matrix: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(matrix)
    size = flat.shape[1] * flat.itemsize
    return pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(np.arange(len(flat) + 1, dtype=np.int32) * size), pa.py_buffer(flat.tobytes())])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BLOCK_ROWS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def integers(values: np.ndarray, dimension: int) -> np.ndarray:
    """floor(SCALE * x). An error where eight parts' squared distances could leave 63 bits."""
    made = np.floor(SCALE * values.astype(np.float64))
    if len(made) and np.abs(made).max() >= (2.0**61 / max(1, dimension)) ** 0.5:
        raise ValueError("a component is too large for an error of 63 bits")
    return made.astype(np.int32).reshape(-1, dimension)


def _pass(books: Codebooks, first: bool, last: bool):
    parts, k, width = books.entries.shape
    dimension = parts * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moved = np.zeros((parts, k, width + 1), dtype=np.int64)
        for block in _blocks(batches):
            n = block.num_rows
            if first:
                lists = block.column("x").combine_chunks()
                if len(lists.flatten()) != n * dimension or (n and (np.diff(lists.offsets.to_numpy()) != dimension).any()):
                    raise ValueError("vectors differ in length")
                v = integers(lists.flatten().to_numpy(zero_copy_only=False), dimension)
                a, u, low = np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.float32), np.zeros((n, parts), np.float32)
            else:
                v, a = _rows(block.column("v"), "<i4", dimension), _rows(block.column("a"), "u1", parts).copy()
                u, low = _rows(block.column("u"), "<f4", parts).copy(), _rows(block.column("l"), "<f4", parts).copy()
            error = np.zeros(n, dtype=np.int64)
            for p in range(parts):
                x = v[:, p * width : (p + 1) * width].astype(np.int64)
                old = a[:, p].copy()
                a[:, p], u[:, p], low[:, p] = books.scan(p, x) if first else books.update(p, x, old, u[:, p], low[:, p])
                if last:
                    error += books.own(p, x, a[:, p])
                    continue
                new = np.arange(n) if first else np.flatnonzero(a[:, p] != old)
                one = np.column_stack([x[new], np.ones(len(new), np.int64)])
                np.add.at(moved[p], a[new, p], one)
                if not first:
                    np.subtract.at(moved[p], old[new], one)
            ids, labels = block.column("vec_id").combine_chunks(), block.column("label").combine_chunks()
            if last:
                codes = [row.tobytes().hex() for row in a]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(codes, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])
            else:
                yield pa.RecordBatch.from_arrays([ids, labels, _binary(v), _binary(a), _binary(u), _binary(low), pa.nulls(n, pa.list_(pa.int64()))], schema=_SCHEMA)
        if not last:
            empty = [pa.nulls(1, f.type) for f in _SCHEMA][:-1]
            yield pa.RecordBatch.from_arrays([*empty, pa.array([moved.ravel().tolist()], pa.list_(pa.int64()))], schema=_SCHEMA)

    return run


def _first_entries(kept: DataFrame) -> list[list[int]]:
    """The whole vectors of the ENTRIES smallest vec_ids, as integers; of rows that share an id the least vector."""
    found: dict[int, list[int]] = {}
    ints = F.transform("x", lambda x: F.floor(SCALE * x.cast("double")))
    rows = kept.where("vec_id IS NOT NULL").select("vec_id", ints.alias("x"))
    while len(found) < ENTRIES:  # one turn, unless ids repeat
        more = rows.where(F.col("vec_id") > max(found)) if found else rows
        top = more.orderBy("vec_id", "x").limit(ENTRIES).collect()
        for row in top:
            if len(found) < ENTRIES:
                found.setdefault(row["vec_id"], list(row["x"]))
        if len(top) < ENTRIES:
            break
    return [found[k] for k in sorted(found)]


def code_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each row of vectors (vec_id, column, label) that is kept.

    Rows whose vector is null or holds null or non-finite components are left out. code has two hex digits for each part,
    error is the squared distance to the coded vector, label_error the sum of error over equal labels (nulls together),
    codebooks_sha256 the digest of all entries' components. Fewer than ENTRIES different vec_ids give as many entries; rows with
    a null vec_id are coded, but begin no entry; if there is no other id, nothing is coded: no rows. Rows that repeat count and come out
    as often as they came. An empty table gives no rows; other columns aren't read. Vectors that differ in length, that can't be cut into
    PARTS equal parts, or whose error can't be held in 63 bits (components of some 46,000 at 64 dimensions) are errors.
    """
    spark = vectors.sparkSession
    vector = F.col(column)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    label = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    kept = vectors.where(vector.isNotNull() & F.forall(vector, finite)).select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), vector.alias("x"))
    whole = _first_entries(kept)
    if not whole:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    if len({len(x) for x in whole}) > 1 or len(whole[0]) % PARTS:
        raise ValueError(f"vectors of lengths {sorted({len(x) for x in whole})} can't be cut into {PARTS} equal parts")
    width = len(whole[0]) // PARTS
    entries = np.array(whole, dtype=np.int64).reshape(len(whole), PARTS, width).transpose(1, 0, 2)
    books, sums = Codebooks(entries), np.zeros((PARTS, len(whole), width + 1), dtype=object)
    rows, at = kept, None
    for round_ in range(ROUNDS):
        to = new_path(spark, f"codes-{round_}")
        rows.mapInArrow(_pass(books, round_ == 0, False), _STATE).write.option("compression", "zstd").parquet(to)
        if at:
            remove_path(spark, at)
        at, written = to, spark.read.schema(_STATE).parquet(to)
        changes = written.where("moved IS NOT NULL").select(F.posexplode("moved").alias("at", "n")).where("n <> 0")
        flat = sums.reshape(-1)
        for row in changes.groupBy("at").agg(F.sum(F.col("n").cast("decimal(20,0)")).alias("n")).collect():  # one row for each component of an entry
            flat[row["at"]] += int(row["n"])
        new = entries.copy()
        for p, j in zip(*np.nonzero(sums[:, :, width]), strict=True):
            new[p, j] = [int(s) // int(sums[p, j, width]) for s in sums[p, j, :width]]
        books, entries = Codebooks(new, entries), new
        rows = written.where("moved IS NULL").drop("moved")
    coded = new_path(spark, "codes")
    rows.mapInArrow(_pass(books, False, True), "vec_id long, label string, code string, error long").write.option("compression", "zstd").parquet(coded)
    remove_path(spark, at)
    rows = spark.read.parquet(coded)
    by_label = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    few = by_label.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    both = rows.join(F.broadcast(by_label), "label") if few else spread_join(rows, by_label, "label")
    digest = hashlib.sha256(",".join(map(str, entries.ravel().tolist())).encode()).hexdigest()
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """The same rounds as plain scans in SQL."""
    square = "list_sum([(a.x[i] - c.x[i]) * (a.x[i] - c.x[i]) for i in range(1, len(a.x) + 1)])"
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT r, p, min({{'d': {square}, 'j': c.j}}) AS m FROM parts a JOIN c{k} c USING (p) GROUP BY r, p)")
        if k < ROUNDS:
            steps.append(
                f"s{k} AS (SELECT p, j, i, CAST(sum(y) AS HUGEINT) AS s, count(*) AS n FROM (SELECT p, a{k}.m.j AS j, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS y FROM a{k} JOIN parts USING (r, p)) GROUP BY p, j, i), "
                f"c{k + 1} AS MATERIALIZED (SELECT p, j, coalesce(y, x) AS x FROM c{k} LEFT JOIN (SELECT p, j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS y FROM s{k} GROUP BY p, j) USING (p, j))"
            )
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
parts AS MATERIALIZED (SELECT r, vec_id, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x FROM kept, range({PARTS}) AS t(p)),
c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS j, x FROM (SELECT p, vec_id, min(x) AS x FROM parts WHERE vec_id IS NOT NULL GROUP BY p, vec_id) QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= {ENTRIES}),
{", ".join(steps)},
coded AS (SELECT r, string_agg(lower(printf('%02x', m.j)), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r),
digest AS (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, j, i)) AS h FROM (SELECT p, j, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS y FROM c{ROUNDS}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM kept JOIN coded USING (r), digest
"""


SQL = _sql()

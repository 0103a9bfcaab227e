"""Token-id files: independent zstandard frames, a trailing seek table and a checksum for each frame.

A shard file holds, in this order,
  * data frames: each one zstandard frame (with zstandard's own content checksum) over at most FRAME_IDS ids,
    little-endian unsigned 32-bit; a document may run over several frames;
  * one skippable frame with the document index: an Arrow stream of (doc_id, start, n_tokens), zstandard-compressed;
  * the seek table of the zstandard seekable format: compressed size, plain size and the low 32 bits of the
    XXH64 of the plain bytes of every frame, then the frame count, the flag byte 0x80 and the magic number.
Any zstandard tool decompresses a shard to its ids; a reader of a few documents only decompresses their frames.

Documents are range-partitioned by doc_id, so shards follow each other in the order of their part (the task) and
number in it: a task begins a new shard after shard_ids ids or shard_docs documents, so neither a shard nor its index grows with the
corpus. A task writes to a name of its own and renames the file when it is whole; the manifest only names the files of
tasks that ended well. A failed task removes its unfinished file; one whose executor is lost leaves it (.part), and nothing reads it.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.ipc as ipc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, shuffle_partitions
from .tokens import encoder

FRAME_IDS = 1 << 16
SHARD_IDS = 1 << 27
SHARD_DOCS = 1 << 20
#: Shards whose ranges every task gets when documents are asked for.
LISTED_SHARDS = 1_000_000
# Fixed values of the zstandard formats.
MAGIC_INDEX = 0x184D2A51
MAGIC_SEEK = 0x184D2A5E
MAGIC_FOOTER = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "path string, part int, number int, first_doc_id long, last_doc_id long, n_docs long, n_tokens long"
_MANIFEST = pa.schema([("path", pa.string()), ("part", pa.int32()), ("number", pa.int32()), *((c, pa.int64()) for c in ("first_doc_id", "last_doc_id", "n_docs", "n_tokens"))])


class ShardWriter:
    """Writes one shard; holds one frame and the index of its documents."""

    def __init__(self, stream: pa.NativeFile, level: int = 3):
        self.stream, self.entries, self.buffer = stream, [], bytearray()
        self.docs: tuple[list, list, list] = ([], [], [])
        self.ids = 0
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)

    def add(self, doc_id: int | None, ids: bytes | memoryview) -> None:
        for column, value in zip(self.docs, (doc_id, self.ids, len(ids) // 4), strict=True):
            column.append(value)
        self.ids += len(ids) // 4
        self.buffer += ids
        while len(self.buffer) >= 4 * FRAME_IDS:
            self._frame(4 * FRAME_IDS)

    def _frame(self, size: int) -> None:
        plain = bytes(self.buffer[:size])
        del self.buffer[:size]
        data = self.zstd.compress(plain)
        self.stream.write(data)
        self.entries.append((len(data), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.buffer:
            self._frame(len(self.buffer))
        sink = pa.BufferOutputStream()
        with ipc.new_stream(sink, INDEX) as out:
            out.write_batch(pa.record_batch([pa.array(c, pa.int64()) for c in self.docs], schema=INDEX))
        index = zstandard.ZstdCompressor().compress(sink.getvalue().to_pybytes())
        self.stream.write(struct.pack("<II", MAGIC_INDEX, len(index)) + index)
        self.entries.append((len(index) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        table = b"".join(struct.pack("<III", *e) for e in self.entries)
        table += struct.pack("<IBI", len(self.entries), CHECKSUM_FLAG, MAGIC_FOOTER)
        self.stream.write(struct.pack("<II", MAGIC_SEEK, len(table)) + table)
        self.stream.close()


class ShardReader:
    """Reads the seek table and the index of a shard, then only the frames that are asked for."""

    def __init__(self, path: str):
        fs, at = pafs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        self.file.seek(size - 9)
        n, flag, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != MAGIC_FOOTER or flag != CHECKSUM_FLAG:
            raise ValueError(f"{path}: no seek table with checksums")
        self.file.seek(size - 9 - 12 * n)
        self.entries = np.frombuffer(self.file.read(12 * n), dtype="<u4").reshape(n, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.entries[:, 0])])
        self.plain_at = np.concatenate([[0], np.cumsum(self.entries[:, 1])])
        self.file.seek(int(self.at[n - 1]))
        packed = self.file.read(int(self.entries[n - 1, 0]))
        if struct.unpack("<I", packed[:4])[0] != MAGIC_INDEX:
            raise ValueError(f"{path}: no document index")
        plain = zstandard.ZstdDecompressor().decompress(packed[8:])
        self.index = ipc.open_stream(plain).read_all()
        self.zstd = zstandard.ZstdDecompressor()
        self.kept: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.kept[0] != k:
            self.file.seek(int(self.at[k]))
            plain = self.zstd.decompress(self.file.read(int(self.entries[k, 0])), max_output_size=int(self.entries[k, 1]))
            if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.entries[k, 2]:
                raise ValueError(f"frame {k} has a wrong checksum")
            self.kept = (k, plain)
        return self.kept[1]

    def parts(self, start: int, n_tokens: int) -> Iterator[bytes]:
        """The id bytes of a document, frame by frame."""
        a, end = 4 * start, 4 * (start + n_tokens)
        k = int(np.searchsorted(self.plain_at, a, side="right")) - 1
        while a < end:
            base = int(self.plain_at[k])
            part = self.frame(k)[a - base : end - base]
            yield part
            a, k = a + len(part), k + 1


def write_token_files(docs: DataFrame, out: str, vocabulary: str, shard_ids: int = SHARD_IDS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Encode docs (doc_id long, text string) into shards under the URI out; returns their manifest.

    Ids are those of the whole text, then id 0. Null and empty texts: only id 0. Null doc_ids come first;
    rows with the same doc_id are all kept, ordered by text. Other columns are not read. An empty table gives
    an empty manifest. out must be a folder that every executor reaches.
    """
    bounded_batches(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, number, part = encoder(vocabulary).encode_ended, None, 0, TaskContext.get().partitionId()
        fs, at = pafs.FileSystem.from_uri(out)

        def closed() -> pa.RecordBatch:
            shard.close()
            fs.move(f"{at}/.{name}.part", f"{at}/{name}.zst")
            row = {"path": f"{out}/{name}.zst", "part": part, "number": number, "first_doc_id": shard.docs[0][0], "last_doc_id": shard.docs[0][-1], "n_docs": len(shard.docs[0]), "n_tokens": shard.ids}
            return pa.RecordBatch.from_pylist([row], _MANIFEST)

        try:
            for batch in batches:
                ids, ends = encode(batch.column(1))
                data, begin = memoryview(ids.astype("<u4", copy=False).tobytes()), 0
                for doc_id, end in zip(batch.column(0).to_pylist(), ends.tolist(), strict=True):
                    if shard is None:
                        fs.create_dir(at, recursive=True)
                        name = uuid.uuid4().hex
                        shard = ShardWriter(fs.open_output_stream(f"{at}/.{name}.part"))
                    shard.add(doc_id, data[4 * begin : 4 * end])
                    begin = end
                    if shard.ids >= shard_ids or len(shard.docs[0]) >= shard_docs:
                        yield closed()
                        shard, number = None, number + 1
            if shard is not None:
                yield closed()
                shard = None
        finally:
            if shard is not None:
                shard.stream.close()
                fs.delete_file(f"{at}/.{name}.part")

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    # The written manifest names the files of the tasks that ended well; files of other attempts are never read.
    ordered.mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(f"{out}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{out}/manifest")


def shard_starts(manifest: DataFrame) -> DataFrame:
    """Adds base: the ids of all shards before, from running sums within the parts and over the parts' totals."""
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))  # one row for each task of the writing stage
    parts = parts.select("part", before(Window.orderBy("part")).alias("_base"))
    inner = manifest.withColumn("_within", before(Window.partitionBy("part").orderBy("number")))
    return inner.join(parts, "part").withColumn("base", F.col("_base") + F.col("_within")).drop("_base", "_within")


DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def digest_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Read every shard back; per document: start among all ids, n_tokens and the crc32 of its ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = ShardReader(path)
                for part in shard.index.to_batches(max_chunksize=10_000):
                    doc_id, start, n = part.columns
                    sums = []
                    for s, k in zip(start.to_pylist(), n.to_pylist(), strict=True):
                        crc = 0
                        for piece in shard.parts(s, k):
                            crc = zlib.crc32(piece, crc)
                        sums.append(crc)
                    yield pa.RecordBatch.from_arrays([doc_id, pa.array(start.to_numpy() + base, pa.int64()), n, pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = shard_starts(manifest).select("path", "base")
    return files.repartition(shuffle_partitions(spark), "path").mapInArrow(read, DIGEST)


def _located(spans: list) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(path, doc_id) for each shard whose range holds an asked doc_id. Ranges are in order and share at most their ends."""
    paths = [r["path"] for r in spans]
    low, high = (np.array([r[c] for r in spans], dtype=np.int64) for c in ("lo", "hi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
            first, end = np.searchsorted(high, ids), np.searchsorted(low, ids, side="right")
            n = np.maximum(end - first, 0)
            at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array([paths[k] for k in at], pa.string()), pa.array(np.repeat(ids, n), pa.int64())], ["path", "doc_id"])

    return run


def read_documents(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id and ids (array of int) of the wanted doc_ids: each shard's reader decompresses their frames only.

    A doc_id that several rows had comes out once for each. Null doc_ids can't be asked for, ids that aren't there give no rows. A doc_id's shards
    are found by halving the ordered list of all shards' ranges, which every task gets while it has at most LISTED_SHARDS entries (some
    16 MB, for half a petabyte of ids); beyond that ids and ranges are joined.
    """
    spark = manifest.sparkSession
    spans = manifest.where("last_doc_id IS NOT NULL").select("path", F.coalesce("first_doc_id", F.lit(-(2**63))).alias("lo"), F.col("last_doc_id").alias("hi"))
    asked = wanted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    if spans.limit(LISTED_SHARDS + 1).count() <= LISTED_SHARDS:
        hits = asked.mapInArrow(_located(spans.orderBy("lo", "hi", "path").collect()), "path string, doc_id long")
    else:
        hits = asked.join(spans, F.col("doc_id").between(F.col("lo"), F.col("hi"))).select("path", "doc_id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, shard = None, None
        for batch in batches:
            for one in batch.column(0).dictionary_encode().dictionary.to_pylist():
                asked = batch.filter(pc.equal(batch.column(0), one)).column(1)
                if path != one:
                    path, shard = one, ShardReader(one)
                rows = shard.index.filter(pc.is_in(shard.index["doc_id"], asked))
                for row in rows.to_pylist():
                    data = b"".join(shard.parts(row["start"], row["n_tokens"]))
                    yield pa.RecordBatch.from_arrays([pa.array([row["doc_id"]], pa.int64()), pa.array([np.frombuffer(data, dtype="<u4").astype(np.int32)], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return hits.repartition(shuffle_partitions(spark), "path").sortWithinPartitions("path").mapInArrow(read, "doc_id long, ids array<int>")

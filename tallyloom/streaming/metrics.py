"""Windowed metrics of an event stream."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATENESS = "10 minutes"


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh folder below the shared one of the cluster; a temporary one only where none is set and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tallyloom-")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def materialized(rows: DataFrame) -> DataFrame:
    """rows from a reliable checkpoint in the shared folder: partitions and their order stay as they are when read again."""
    spark = rows.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(scratch(spark, "state"))
    return rows.checkpoint(eager=True)


@contextlib.contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """The RocksDB state store, which machines with timers need, for the streams that are started inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, with an event time that a watermark accepts."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str = "1 day") -> DataFrame:
    """Counts and sums by window and type; late events beyond the watermark are dropped."""
    rows = events.withWatermark("ts", LATENESS)
    return rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.floor("value")).alias("total"))


def drained(result: DataFrame, mode: str) -> DataFrame:
    """Run a streaming result over what is there and return its last output as a table; a batch that is repeated replaces itself."""
    spark = result.sparkSession
    out = scratch(spark, "stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/{'all' if mode == 'complete' else number}")

    running = result.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").foreachBatch(put).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(result.schema).option("recursiveFileLookup", "true").parquet(f"{out}/rows")

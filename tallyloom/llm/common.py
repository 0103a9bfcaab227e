"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch handed to Python; long texts make a batch of the default 10,000 rows too large.
BATCH_ROWS = 500
BATCH_BYTES = 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers hold at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only where none is set and all runs on one machine."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tallyloom-"))
    return sc.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh URI in the shared folder."""
    base = shared_dir(spark)
    return f"{base if '://' in base or base.startswith('file:') else 'file://' + base}/{what}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder made with new_path that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialized(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder: later reads survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def quoted(name: str) -> str:
    """A column's name for F.col, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once and bind it inside body, so that the optimizer can't inline it into each lambda call."""
    return F.element_at(F.transform(F.array(value), body), 1)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salted_rows(rows: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """rows with _salt: 0, or for keys in hot (key, _spread; few rows) one of _spread numbers in turn, for equal rows too.

    The running number is taken straight from rows, which must be stable when read again (see materialized).
    """
    numbered = rows.withColumn("_row", F.monotonically_increasing_id()).join(F.broadcast(hot), key, "left")
    return numbered.withColumn("_salt", F.coalesce(F.pmod("_row", "_spread"), F.lit(0)).cast("int")).drop("_row", "_spread")


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join many rows of left for each key to one row of right, with hot keys dealt over several tasks.

    A key with more than 1 / (4 x partitions) of left's rows is hot; there can be at most 4 x partitions of those, so
    they are broadcast. A hot key's rows get one of ceil(rows / limit) salts, and right's row is repeated for
    each; all repeats together are at most 8 x partitions rows. left must be stable when read again.
    """
    parts = 4 * shuffle_partitions(left.sparkSession)
    limit = max(1, left.count() // parts)
    counts = left.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > limit)
    hot = counts.select(key, F.ceil(F.col("_n") / limit).cast("int").alias("_spread"))
    one = right.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_spread", F.lit(1)) - 1))).drop("_spread")
    return salted_rows(left, hot, key).join(one, [key, "_salt"], how).drop("_salt")

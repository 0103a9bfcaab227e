"""Appending request and decision rows, dead letters, retention."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KINDS = ("accepted", "late", "invalid")
_COUNTS = "n long, accepted long, late long, invalid long, latest double"


def normalized(rows: DataFrame, defaults: dict[str, object], cuts: dict[str, int]) -> DataFrame:
    """Nulls become defaults, long strings are cut."""
    for c, value in defaults.items():
        rows = rows.withColumn(c, F.coalesce(F.col(c), F.lit(value)))
    for c, size in cuts.items():
        rows = rows.withColumn(c, F.substring(c, 1, size))
    return rows


def append(rows: DataFrame, path: str) -> None:
    """Append, one folder for each UTC day, so that time windows prune."""
    rows.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def append_stream(rows: DataFrame, path: str, dead: str, valid: Callable[[], Column], checkpoint: str) -> StreamingQuery:
    """Append valid rows; the others go to a dead-letter table. Each batch has a folder of its own (the column batch) and replaces it when repeated."""

    def put(batch: DataFrame, number: int) -> None:
        ok = F.coalesce(valid(), F.lit(False))
        batch.where(ok).withColumn("day", F.to_date("ts")).write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={number}")
        batch.where(~ok).write.mode("overwrite").parquet(f"{dead}/batch={number}")

    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()


def _replace_days(rows: DataFrame, path: str) -> None:
    """Overwrite the days that rows have, and only those; rows are written aside first, as they come from the files that go."""
    from ..streaming.metrics import materialized

    materialized(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def _days(rows: DataFrame) -> list:
    return [r["day"] for r in rows.select("day").distinct().collect()]  # folder names


def label_group(spark: SparkSession, path: str, id_column: str, row_id: object, group: str, label: str | None) -> int:
    """Label (null: clear) a row of a stored table and all rows that share its group; the number of rows that changed.

    Only the days with rows whose label changes are rewritten; other days keep their files, and a repeated call changes none. An id that
    isn't there changes nothing; a null group is no group, only the row itself is labelled.
    """
    table = spark.read.parquet(path)
    one = table.where(F.col(id_column) == row_id).select(group).first()
    if one is None:
        return 0
    mine = F.col(group) == one[0] if one[0] is not None else F.col(id_column) == row_id
    stale = table.where(mine & ~F.col("label").eqNullSafe(F.lit(label).cast("string")))
    found = stale.groupBy("day").count().collect()  # a row for each day
    if found:
        touched = table.where(F.col("day").isin([r["day"] for r in found]))
        _replace_days(touched.withColumn("label", F.when(mine, F.lit(label).cast("string")).otherwise(F.col("label"))), path)
    return sum(r["count"] for r in found)


def purge_stored(spark: SparkSession, path: str, before: str) -> int:
    """Take rows older than before out of a stored table; their number. Whole days go as folders, only the day at the border is rewritten."""
    table, cut = spark.read.parquet(path), F.lit(before).cast("timestamp")
    old = table.where((F.col("ts") < cut) & (F.col("day") <= F.to_date(cut)))
    found = {r["day"]: r["count"] for r in old.groupBy("day").count().collect()}  # a row for each day
    border = [d for d in _days(table.where((F.col("day") == F.to_date(cut)) & (F.col("ts") >= cut))) if d in found]
    if border:
        _replace_days(table.where((F.col("day") == border[0]) & (F.col("ts") >= cut)), path)
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for day in found:
        if day not in border:
            files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, f"day={day}"), True)
    spark.catalog.refreshByPath(path)
    return sum(found.values())


def checked_stream(rows: DataFrame, path: str, valid: Callable[[], Column], lateness: float, checkpoint: str) -> StreamingQuery:
    """Append a stream's rows (ts and others) with what is wrong with them counted by cause; every row is kept somewhere.

    path/rows/batch=N/kind=accepted, late (its time lies over lateness seconds before the latest of the batches before; the column
    behind has the seconds) or invalid; path/counts/batch=N has n, accepted, late, invalid and the latest time of valid rows.
    The counts come from the one pass that writes. The watermark is read from the batches before N, so a repeated batch decides and writes the same again.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = latest_before(spark, path, number)
        seconds = F.col("ts").cast("double")
        behind = F.lit(before).cast("double") - lateness - seconds
        ok = F.coalesce(valid() & F.col("ts").isNotNull(), F.lit(False))
        kind = F.when(~ok, "invalid").when(F.coalesce(behind > 0, F.lit(False)), "late").otherwise("accepted")
        seen = Observation()
        count = lambda k: F.count_if(F.col("kind") == k).alias(k)
        tagged = batch.withColumn("kind", kind).withColumn("behind", F.when(F.col("kind") == "late", behind))
        tagged = tagged.observe(seen, F.count(F.lit(1)).alias("n"), *map(count, KINDS), F.max(F.when(F.col("kind") != "invalid", seconds)).alias("latest"))
        tagged.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/rows/batch={number}")
        got = seen.get
        spark.createDataFrame([tuple(got[c] for c in ("n", *KINDS, "latest"))], _COUNTS).write.mode("overwrite").parquet(f"{path}/counts/batch={number}")

    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()


def counts(spark: SparkSession, path: str) -> DataFrame:
    """batch, n, accepted, late, invalid, latest of a checked stream."""
    return spark.read.schema(f"{_COUNTS}, batch long").option("basePath", f"{path}/counts").parquet(f"{path}/counts")


def latest_before(spark: SparkSession, path: str, number: int) -> float | None:
    """The latest time of the batches before one; none for the first."""
    return counts(spark, path).where(F.col("batch") < number).agg(F.max("latest")).first()[0] if number else None


def purge(rows: DataFrame, before: str, out: str) -> int:
    """Write what isn't older than before to another folder; the number of rows left out."""
    cut = F.lit(before).cast("timestamp")
    append(rows.where(F.col("ts") >= cut), out)
    return rows.where(F.col("ts") < cut).count()

"""Line JSON, with half-written lines left out, and its compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse(lines: DataFrame, schema: str) -> DataFrame:
    """Rows of lines.value that are whole JSON objects; blank and broken lines are dropped."""
    parsed = lines.where(F.length(F.trim("value")) > 0).select(F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("x"))
    return parsed.where("x IS NOT NULL AND x._bad IS NULL").select("x.*").drop("_bad")


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return parse(spark.read.text(path), schema)


def compact(spark: SparkSession, path: str, out: str, time: str, keep: int) -> None:
    """Write the newest keep lines by their time field to another folder."""
    rows = spark.read.text(path).withColumn("t", F.get_json_object("value", f"$.{time}").cast("double")).where("t IS NOT NULL")
    rows.orderBy(F.desc("t"), "value").limit(keep).select("value").write.mode("overwrite").text(out)

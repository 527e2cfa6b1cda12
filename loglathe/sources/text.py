"""Scans: lines of text files with their places, and tables of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of text files; lines are numbered from 0 over all files in order of their paths.

    A first pass counts the lines of every split, one narrow row each; the numbers follow without a sort of the lines.
    """
    rows = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    splits = rows.groupBy("file", "start").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "start", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("shift"))
    return rows.join(F.broadcast(splits), ["file", "start"]).select((F.col("id") + F.col("shift")).alias("line_no"), F.col("value").alias("line"))


def stream_lines(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """(line) of the text files that arrive in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path).select(F.col("value").alias("line"))


def has_avro(spark: SparkSession) -> bool:
    """Whether the external Avro source is on the class path."""
    try:
        spark._jvm.org.apache.spark.sql.execution.datasources.DataSource.lookupDataSource("avro", spark._jsparkSession.sessionState().conf())
        return True
    except Exception:  # noqa: BLE001  the bridge has one error for all causes
        return False


def read_records(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Records from Parquet, JSON, ORC or (where the source exists) Avro, by the path's ending or `kind`."""
    kind = kind or next((k for k in ("parquet", "json", "orc", "avro") if path.rstrip("/").endswith(k)), "parquet")
    if kind == "avro" and not has_avro(spark):
        raise ValueError("the Avro source is not on the class path; read Parquet or JSON instead")
    return spark.read.format(kind).load(path)

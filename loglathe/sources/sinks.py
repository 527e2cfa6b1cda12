"""Sinks of a learned structure: schema, parser, records and rejected lines, under one folder."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..plans import types
from .text import has_avro

SCHEMA, PARSER, DATA_JSON, DATA, REJECTS = "schema.json", "parser.json", "data.json", "data", "rejects"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, by the file system of the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())  # one small file


def write_schema(spark: SparkSession, folder: str, root: types.Node) -> None:
    """schema.json: the Avro-style schema, and Spark's; parser.json: the type tree."""
    both = {"avro": types.avro_schema(root) if root.has_data else None, "spark": json.loads(types.spark_schema(root).json())}
    write_text(spark, f"{folder}/{SCHEMA}", json.dumps(both, indent=2, ensure_ascii=False))
    write_text(spark, f"{folder}/{PARSER}", types.to_json(root))


def read_parser(spark: SparkSession, folder: str) -> types.Node:
    return types.from_json(read_text(spark, f"{folder}/{PARSER}"))


def write_records(records: DataFrame, folder: str, emit: bool = True) -> None:
    """JSON always; with `emit` a columnar copy as well, as Avro where that source exists, else Parquet."""
    records.write.mode("errorifexists").json(f"{folder}/{DATA_JSON}")
    if emit:
        kind = "avro" if has_avro(records.sparkSession) else "parquet"
        records.write.mode("errorifexists").format(kind).save(f"{folder}/{DATA}.{kind}")

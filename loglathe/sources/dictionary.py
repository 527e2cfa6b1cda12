"""The schema dictionary: a folder of JSON rows, one an entry, with a schema, a summary and a comment."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import summary
from ..plans.treedist import best_mapping

ENTRY = "entry_id string, info string, schema string, summary string"
OPS = "array<struct<op:string,source:string,target:string>>"
RESULT = f"entry_id string, info string, schema string, distance double, ops {OPS}"


def entry(df: DataFrame, info: str) -> tuple[str, str, str, str]:
    """An entry's row for a table of records; its id follows from its content."""
    if not df.schema.fields:
        raise ValueError("records need a schema with fields")
    tree = summary.summarize(df)
    if not tree.num_data:
        raise ValueError("records need at least one row")
    schema = json.dumps(json.loads(df.schema.json()), sort_keys=True)
    text = summary.to_json(tree)
    return hashlib.sha256("\0".join((info, schema, text)).encode()).hexdigest(), info, schema, text


def add(spark: SparkSession, folder: str, df: DataFrame, info: str) -> str:
    """Appends a table's entry to the dictionary and returns its id."""
    row = entry(df, info)
    spark.createDataFrame([row], ENTRY).coalesce(1).write.mode("append").json(folder)
    return row[0]


def contents(spark: SparkSession, folder: str) -> DataFrame:
    """All entries, once each."""
    return spark.read.schema(ENTRY).json(folder).dropDuplicates(["entry_id"])


def distances(entries: DataFrame, df: DataFrame) -> DataFrame:
    """The distance of a table's schema to every entry, and the edits; entries are dealt over the executors."""
    source = summary.to_json(summary.summarize(df))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = summary.from_json(source)
        for x in batches:
            found = [best_mapping(mine, summary.from_json(s)) for s in x["summary"]]
            ops = [[{"op": o.op, "source": o.source, "target": o.target} for o in m.ops] for m in found]
            yield pd.DataFrame({"entry_id": x["entry_id"], "info": x["info"], "schema": x["schema"], "distance": [m.distance for m in found], "ops": ops})

    return entries.select("entry_id", "info", "schema", "summary").mapInPandas(run, RESULT)


def suggest(entries: DataFrame, df: DataFrame, k: int = 1) -> DataFrame:
    """The k nearest entries, at least one, by distance and then schema; of exact ties one stays."""
    found = distances(entries, df)
    return found.dropDuplicates(["distance", "schema"]).orderBy("distance", "schema").limit(max(1, k))


def report(suggestions: DataFrame) -> DataFrame:
    """(info, distance, section, source, target): renames, fields only in the source, only in the target."""
    rows = suggestions.select("info", "distance", F.explode("ops").alias("o"))
    section = F.when(F.col("o.op") == "TRANSFORM", "rename").when(F.col("o.op") == "DELETE", "source only").otherwise("target only")
    return rows.select("info", "distance", section.alias("section"), F.col("o.source").alias("source"), F.col("o.target").alias("target"))


def renamed(df: DataFrame, ops: list) -> DataFrame:
    """df with its top-level fields named as the edits suggest; names that would clash stay."""
    names: dict[str, str] = {}
    for o in ops:
        s, t = o["source"].split("."), o["target"].split(".")
        if o["op"] == "TRANSFORM" and len(s) == 2 and len(t) == 2:
            names[s[1]] = t[1]
    taken = {c for c in df.columns if c not in names}
    out = {}
    for c in df.columns:
        new = names.get(c, c)
        out[c] = new if new == c or new not in taken else c
        taken.add(out[c])
    return df.withColumnsRenamed(out)

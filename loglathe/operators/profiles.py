"""Profiles: the token id sequences of lines, their counts and their first lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexer

#: Depth of delimited groups whose inner profiles are part of a line's profile.
DEPTH = 3
SAMPLES = 3


def profile(line: Column, meta_by_delimiter: bool = False) -> Column:
    """The ids of a line's tokens, joined by single spaces (ids hold no white space)."""
    return F.concat_ws(" ", lexer.token_ids(line, meta_by_delimiter))


def nested_profile(line: Column, depth: int = DEPTH) -> Column:
    """A profile in which each group has its delimiter and its inner profile, to the given depth."""

    def one(t: Column) -> Column:
        if depth <= 0:
            return lexer.token_id(t)
        inner = F.concat(F.lit("meta"), F.substring(t["text"], 1, 1), F.lit("\n"), nested_profile(lexer.inner_text(t["text"]), depth - 1), F.lit("\t"))
        return F.when(t["cls"] == "meta", inner).otherwise(lexer.token_id(t))

    return F.concat_ws(" ", F.transform(lexer.tokenize(line), one))


@dataclass(frozen=True)
class LineProfile:
    """A profile's number of lines and its first lines, each with its place in the input."""

    count: int
    first: tuple[tuple[int, str], ...]


def collect_profiles(df: DataFrame, line: str, order: str, depth: int = DEPTH, most: int | None = None) -> tuple[list[LineProfile], bool]:
    """The distinct profiles of a table's lines, and whether they are a sample.

    Lines are lexed once; profiles travel as 128-bit hashes, counted with partial aggregation, and of each
    at most `SAMPLES` first lines leave a task. All profiles are taken; with `most`, the most frequent ones.
    """
    p = nested_profile(F.col(line), depth)
    rows = df.where(F.col(line).isNotNull()).select(F.struct(F.xxhash64(p).alias("a"), F.xxhash64(p, F.lit(1)).alias("b")).alias("p"), F.col(order).alias("o"), F.col(line).alias("t"))
    rows = rows.select("p.*", "o", "t").persist(StorageLevel.DISK_ONLY)
    try:
        counts = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
        kept = counts if most is None else counts.orderBy(F.desc("n"), "a", "b").limit(most + 1)
        found = [((r["a"], r["b"]), r["n"]) for r in kept.collect()]  # 24 bytes a profile
        sampled = most is not None and len(found) > most
        number = dict(found[:most])
        some = rows.join(F.broadcast(kept.limit(most).select("a", "b")), ["a", "b"], "left_semi") if sampled else rows
        w = Window.partitionBy("a", "b").orderBy("o", "t")
        first = some.withColumn("r", F.row_number().over(w)).where(F.col("r") <= SAMPLES).select("a", "b", "o", "t")
        lines: dict[tuple[int, int], list[tuple[int, str]]] = {p: [] for p in number}
        for r in first.toLocalIterator():
            if (r["a"], r["b"]) in lines:
                lines[r["a"], r["b"]].append((r["o"], r["t"]))
    finally:
        rows.unpersist()
    out = [LineProfile(n, tuple(sorted(lines[p]))) for p, n in number.items() if lines[p]]
    return sorted(out, key=lambda x: x.first[0]), sampled

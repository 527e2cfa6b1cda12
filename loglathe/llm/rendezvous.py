"""Sharding by weighted rendezvous hashing of a stable record key (native expressions only).

Each (key, shard) pair has a hash value u in (0, 1); a record goes to the shard with the least
-ln(u) / weight. A shard's values never depend on the other shards, so adding shard n moves records
only into n, and each shard gets a share of the keys in proportion to its weight.

Defined cases: a null key counts as the empty string; a null text has 0 bytes; shards of weight 0 get
nothing; rows with the same key always share a shard, and get slots of their own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, unit_hash

#: Buckets of the hash order in which slots are numbered; windows sort one (shard, bucket) at a time.
SLOT_BUCKETS = 1024


def _cost(key: Column, shard: int, weight: float, seed: str) -> Column:
    u = (unit_hash(F.lit(seed), key, F.lit(str(shard))) + F.lit(0.5)) / F.lit(float(2**52))
    return -F.log(u) / F.lit(float(weight))


def shard_of(key: Column, weights: Sequence[float], seed: str = "shard") -> Column:
    """The shard (int) of a key, which is a string column, among len(weights) weighted shards."""
    if not weights or any(w < 0 or not math.isfinite(w) for w in weights) or not any(weights):
        raise ValueError("weights must be finite, none below 0 and one above 0")
    key = F.coalesce(key.cast("string"), F.lit(""))
    bids = [F.struct(_cost(key, s, w, seed).alias("cost"), F.lit(s).alias("shard")) for s, w in enumerate(weights) if w > 0]
    return F.array_min(F.array(*bids))["shard"]


def assign(df: DataFrame, key: str, weights: Sequence[float], seed: str = "shard", out: str = "shard", grown: str | None = None, next_weight: float = 1.0) -> DataFrame:
    """Adds the shard of each row, and under `grown` the shard that it would have with one more."""
    cols = {out: shard_of(F.col(f"`{key}`"), weights, seed)}
    if grown:
        cols[grown] = shard_of(F.col(f"`{key}`"), [*weights, next_weight], seed)
    return df.withColumns(cols)


def with_slots(df: DataFrame, key: str, shard: str = "shard", out: str = "slot", tie: Sequence[str] = (), buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Numbers the rows of each shard from 0 without gaps, in the order of the key's hash.

    No window spans a shard: rows are ranked inside (shard, bucket of the hash), and the counts of the
    earlier buckets, at most shards * buckets numbers, are added. Rows that agree in the key and in
    the columns of `tie` are interchangeable.
    """
    h, b, n, off = (free_name(df, x) for x in ("hash", "bucket", "count", "offset"))
    key_s = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    width = 2**52 // buckets
    placed = df.withColumn(h, unit_hash(F.lit("slot"), key_s)).withColumn(b, F.floor(F.col(h) / F.lit(width)).cast("int"))
    before = Window.partitionBy(shard).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(shard, b).agg(F.count(F.lit(1)).alias(n)).select(shard, b, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(off))
    inside = Window.partitionBy(shard, b).orderBy(h, F.col(f"`{key}`"), *(F.col(f"`{c}`") for c in tie))
    ranked = placed.withColumn(n, F.row_number().over(inside) - 1)
    # at most shards * buckets rows, whatever the input
    return ranked.join(F.broadcast(offsets), [shard, b]).withColumn(out, (F.col(off) + F.col(n)).cast("long")).drop(h, b, n, off)

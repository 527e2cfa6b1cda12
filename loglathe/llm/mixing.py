"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (native only).

Sources in code point order, null last, weigh 1, 2, 3, 1, ... and share the total size; a target stops
at `MAX_EPOCHS` times the source's size and its excess is shared again by weight. Each source's rows
fall into blocks by a hash of their key. A target of e + f source sizes takes every block in e whole
epochs; the epoch after them takes the part f of the blocks.

Which blocks those are, and to which output shard each block of each epoch goes, follows from the tree:
its root has every source's exact block quotas, those that the last epoch takes and those that it
leaves. Every node gives half of its quotas of each kind, drawn without replacement, to the left and the
others to the right, so the left half's counts by source follow the multivariate hypergeometric law and
sums stay exact; the leaves are the shards. The blocks of an epoch, permuted, are then dealt to the
shards in disjoint runs as long as their quotas, and of its run in the last epoch a shard takes as many
blocks as its quota says. As blocks differ in size, the last of the blocks so drawn is cut, or one more
begun, at the row where the source's words come nearest to its target.

Work per node is a rank among its quotas, dealt over tasks by the drawn keys; only narrow rows, a block
or a quota each, come together. `mixture` sends rows to their shards and shuffles them there.

Defined cases: null texts have size 0; sources of size 0 have the target 0; rows with equal keys are
taken together; an empty table gives an empty result; texts of any length count whole. Columns that
clash with those added, `size` too, are replaced. Weights, blocks and order depend on nothing but the
rows, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, free_name, set_aside, small_or_shuffled, unit_hash

#: Columns that `mix` adds.
ADDED = ("size", "source_size", "target", "copies", "taken", "shards")
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
#: Rows that a block holds on average, and the most blocks that a source is cut into.
BLOCK_ROWS, MAX_BLOCKS = 256, 4096
LEVELS = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, n_rows, rank, weight, target) of (source, size) rows.

    Sources sorted by cap / weight fill up in that order; the first one whose share of what is left
    stays under its cap fixes the common share of a unit of weight.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    everything = Window.partitionBy(F.lit(0))
    s = s.withColumn("rank", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod("rank", F.lit(len(weights))) + 1).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * max_epochs)
    order = everything.orderBy(F.col("cap").cast("double") / F.col("weight").cast("double"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total, heavy = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0))
    share = left.cast("double") / (heavy - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("double")
    s = s.withColumn("share", share).withColumn("free", F.col("share") * F.col("weight") <= F.col("cap"))
    s = s.withColumn("lam", F.min(F.when(F.col("free"), F.struct((F.col("cap").cast("double") / F.col("weight").cast("double")).alias("at"), "rank", "share"))).over(everything)["share"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("lam") * F.col("weight"), F.col("cap").cast("double")))
    return s.select("source", "source_size", "n_rows", "rank", "weight", target.alias("target"))


def row_hash(key: Column, seed: str) -> Column:
    return unit_hash(F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))


def _block(h: Column, n_rows: Column) -> Column:
    n = F.least(F.lit(MAX_BLOCKS), F.ceil(n_rows / BLOCK_ROWS)).cast("int")
    return F.pmod(h, n).cast("int")


#: Ranges of the drawn keys, in each of which ranks are counted by a task of its own.
BINS = 256


def _ranked(df: DataFrame, by: list[str], key: str, ties: list[str]) -> DataFrame:
    """df with r, the rank from 0 by key inside the groups, and n, the group's size; no group is sorted in one task."""
    df = df.withColumn("bin", F.floor(F.col(key) / (2**52 / BINS)).cast("int"))
    bins = df.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("in_bin"))
    up_to = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(*by, "bin", F.coalesce(F.sum("in_bin").over(up_to), F.lit(0)).alias("before"), F.sum("in_bin").over(Window.partitionBy(*by)).alias("n"))
    df = df.join(F.broadcast(bins), [*by, "bin"])  # groups x BINS narrow rows at most
    r = F.row_number().over(Window.partitionBy(*by, "bin").orderBy(key, *ties)) - 1
    return df.withColumn("r", F.col("before") + r).drop("bin", "before")


def split_quotas(units: DataFrame, levels: int = LEVELS, seed: str = "mix") -> DataFrame:
    """(rank, epoch, unit, drawn, shard): the leaf of the splitting tree that each block quota goes down to.

    units: (rank, epoch, unit, drawn), one row for each quota; drawn: whether its block is taken.
    """
    tree = units.withColumn("node", F.lit(0))
    for level in range(levels):
        key = unit_hash(*(F.lit(x) for x in (seed, "split", str(level))), *(F.col(c).cast("string") for c in ("rank", "epoch", "unit")))
        tree = _ranked(tree.withColumn("u", key), ["node", "drawn"], "u", ["rank", "epoch", "unit"])
        tree = tree.withColumn("node", F.col("node") * 2 + (F.col("r") >= F.floor(F.col("n") / 2)).cast("int")).drop("u", "r", "n")
    return tree.withColumnRenamed("node", "shard")


def plan(rows: DataFrame, seed: str = "mix", levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """(targets by source; decisions by source and block) of rows (key, source, size).

    A decision has the full copies, `cut` (of the rows of one more copy the largest hash taken; null
    for none) and the output shards of all these copies, the one more last.
    """
    sources = small_or_shuffled(source_targets(rows.select("source", "size")))
    placed = rows.select("source", "size", row_hash(F.col("key"), seed).alias("h"))
    placed = placed.join(sources.select(F.col("source").alias("s"), "rank", "n_rows", "source_size", "target"), F.col("source").eqNullSafe(F.col("s")))
    placed = placed.withColumn("block", _block(F.col("h"), F.col("n_rows"))).drop("s", "source", "n_rows")
    blocks = placed.groupBy("rank", "block").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    blocks = blocks.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    blocks = blocks.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).checkpoint()
    # the root's quotas: all blocks of each epoch; of the last one the part that is taken
    quotas = blocks.groupBy("rank").agg(F.count(F.lit(1)).alias("b"), F.first("epochs").alias("epochs"), F.first("rest").alias("rest"), F.first("source_size").alias("source_size"))
    part = F.when(F.col("source_size") > 0, F.floor(F.col("b").cast("double") * F.col("rest") / F.col("source_size"))).otherwise(0)
    units = quotas.withColumn("part", part).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs"))))
    units = units.withColumn("unit", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b") - 1)))
    units = units.select("rank", "epoch", "unit", ((F.col("epoch") < F.col("epochs")) | (F.col("unit") < F.col("part"))).alias("drawn"))
    # runs of permuted blocks for the leaves: block and quota meet at the same place of their epoch
    place = Window.partitionBy("rank", "epoch")
    leaves = split_quotas(units, levels, seed).withColumn("place", F.row_number().over(place.orderBy("shard", F.desc("drawn"), "unit")))
    perm = unit_hash(F.lit(seed), F.lit("perm"), *(F.col(c).cast("string") for c in ("rank", "epoch", "block")))
    dealt = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs")))).withColumn("perm", perm)
    dealt = dealt.withColumn("place", F.row_number().over(place.orderBy("perm", "block"))).join(leaves.select("rank", "epoch", "place", "shard", "drawn"), ["rank", "epoch", "place"]).checkpoint()
    before = Window.partitionBy("rank").orderBy(F.desc("drawn"), "perm", "block").rowsBetween(Window.unboundedPreceding, -1)
    last = dealt.where("epoch = epochs").withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    state = F.when(F.col("before") + F.col("words") <= F.col("rest"), "whole").when(F.col("before") < F.col("rest"), "part").otherwise("none")
    last = small_or_shuffled(last.select("rank", "block", "epochs", state.alias("state"), (F.col("rest") - F.col("before")).alias("room")))
    # the rows of the one block of a source that is taken in part
    inside = Window.partitionBy("rank", "block").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    part = placed.join(last.where("state = 'part'"), ["rank", "block"]).withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    past = F.col("before") + F.col("size") - F.col("room")
    part = part.where((past <= 0) | ((F.col("before") < F.col("room")) & (past <= F.col("room") - F.col("before"))))
    cuts = part.groupBy("rank", "block").agg(F.max("h").alias("cut"))
    decided = last.join(cuts, ["rank", "block"], "left").withColumn("cut", F.when(F.col("state") == "whole", F.lit(2**52)).when(F.col("state") == "part", F.col("cut")))
    shards = dealt.groupBy("rank", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("epoch", "shard"))), lambda x: x["shard"]).alias("shards"))
    return sources, small_or_shuffled(decided.join(shards, ["rank", "block"]).select("rank", "block", "epochs", "cut", "shards"))


def mix(df: DataFrame, key: str, source: str, size: Column, seed: str = "mix", levels: int = LEVELS) -> DataFrame:
    """df with size, source_size, target, copies, taken and shards (one of 2^levels for each copy, in epoch order).

    Only (key, source, size) is written down once, 24 bytes a row; wide rows never shuffle unless the
    sources or blocks are too many to broadcast.
    """
    df = df.withColumn("size", size)
    df = df.drop(*(c for c in ADDED[1:] if c not in (key, source)))
    ensure_checkpoint_dir(df.sparkSession)
    narrow = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), "size").checkpoint()
    sources, decided = plan(narrow, seed, levels)
    whole = set(df.columns) == {key, source, "size"}
    if whole:
        df = narrow.withColumnsRenamed({"key": key, "source": source})
    h, s, b, r, n = (free_name(df, x) for x in ("hash", "source", "block", "rank", "rows"))
    out = df.join(sources.select(F.col("source").alias(s), F.col("rank").alias(r), F.col("n_rows").alias(n), "source_size", "target"), F.col(f"`{source}`").eqNullSafe(F.col(s)))
    out = out.withColumn(h, row_hash(F.col(f"`{key}`"), seed)).withColumn(b, _block(F.col(h), F.col(n)))
    d = decided.select(F.col("rank").alias(r), F.col("block").alias(b), F.col("epochs").alias("copies"), F.col("cut").alias(n + "c"), "shards")
    out = out.drop(n).join(d, [r, b])
    more = F.coalesce(F.col(h) <= F.col(n + "c"), F.lit(False)).cast("int")
    out = out.withColumn("copies", F.col("copies") + more).withColumn("taken", F.col("size") * F.col("copies"))
    return out.withColumn("shards", F.slice("shards", F.lit(1), F.col("copies"))).drop(h, s, b, r, n + "c")


def in_shards(mixed: DataFrame, key: str, seed: str = "mix", shards: int = 2**LEVELS) -> DataFrame:
    """The rows of `mix`, one for each copy, dealt to partitions by shard and shuffled inside them; its added columns
    go. A shard lies in several partitions, as many as make up the session's shuffle partitions."""
    copy, part = free_name(mixed, "copy"), free_name(mixed, "part")
    rows = mixed.select("*", F.posexplode(F.slice("shards", F.lit(1), F.col("copies"))).alias(copy, part))
    order = unit_hash(F.lit(seed), F.lit("order"), F.col(f"`{key}`").cast("string"), F.col(copy).cast("string"))
    n = max(shards, int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn(copy, order)
    rows = rows.repartition(n, F.col(part), F.pmod(F.col(copy), F.lit(-(-n // shards)))).sortWithinPartitions(part, copy)
    return rows.drop(copy, part, *ADDED)


def mixture(df: DataFrame, key: str, source: str, size: Column, seed: str = "mix", levels: int = LEVELS) -> DataFrame:
    """df's rows as often as the mixture takes them, in their shards; columns of any names pass unchanged."""
    k, s, n = free_name(df, "key"), free_name(df, "from"), free_name(df, "words")
    df = df.withColumns({k: F.col(f"`{key}`"), s: F.col(f"`{source}`"), n: size})
    df, back = set_aside(df, ADDED)
    return in_shards(mix(df, k, s, F.col(n), seed, levels), k, seed, 2**levels).drop(k, s, n).withColumnsRenamed(back)

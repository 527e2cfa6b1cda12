"""Exact dedup by two Bloom passes (native expressions only).

Pass 1 builds a counting Bloom filter of the keys' hashes, cut by hash range: every task counts the cells
of the ranges that its rows touch, and only these partial filters are shuffled and added up, not the
rows. A range holds `RANGE_ROWS` rows in `PROBES` tables of `CELLS` cells, so the filter grows with the
rows. What matters of it, one bit a cell (counted twice or more, or not), is `BYTES_A_ROW` bytes a row.
Pass 2 probes it with every row: rows with a cell that nothing else hit can't have a twin and pass
straight through; only the others shuffle, on their SHA-256, to find the row that stays.

The bits are broadcast, so they are made of the rows up to `MAX_ROWS` only (32 MB). With more rows the
64-bit hashes are counted instead, 8 bytes a row after partial aggregation, and those that occur twice
fill the filter, of at most `MAX_BITS`: it lets through more rows when many are repeated, with the same
result. Either way texts are read twice and move only if they may be repeated.

Defined cases: a null key counts as empty text; of rows that agree in key and order column all are
marked kept, as nothing tells them apart; null ids stay behind any other; an empty table gives an empty
result; very long texts are hashed whole; columns that clash with those added are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, free_name, join_groups

#: Bits of one bitmap of Spark's bitmap functions.
BITMAP_BITS = 32768
#: Upper bound of the filter of repeated hashes: 2^27 bits are 16 MB; its bits for each of them.
MAX_BITS, BITS_PER_KEY = 2**27, 16
PROBES = 2
#: Rows of a range, cells of each of its tables, and rows at most of a table whose filter is made of all rows.
RANGE_ROWS, CELLS, MAX_ROWS = 256, 1024, 2**25
BYTES_A_ROW = PROBES * CELLS / 8 / RANGE_ROWS
#: Tasks that count the narrow hashes of up to MAX_ROWS rows: each gives one partial filter a range.
COUNTERS = 16
SEED = 11
#: Bytes before the tables in a serialised count-min sketch but for its factors, and the modulus.
HEAD, MODULUS = 20, 2**31 - 1


def _positions(h: Column, bits: int) -> list[Column]:
    """PROBES bit positions from one 64-bit hash."""
    return [F.pmod(F.xxhash64(h, F.lit(i)), F.lit(bits)) for i in range(PROBES)]


def _bit(bitmap: Column, pos: Column) -> Column:
    """Whether the bit is set in the bitmap (null: no such bitmap, no bit)."""
    at = F.pmod(pos, F.lit(BITMAP_BITS))
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1, F.lit(False))


def _item(h: Column) -> Column:
    """What a sketch counts for a hash: 31 bits, so that no product overflows."""
    return F.pmod(F.xxhash64(h, F.lit(SEED)), F.lit(2**31))


def _long(x: Column) -> Column:
    return F.conv(F.hex(x), 16, 10).cast("long")


def _cell(item: Column, factor: int) -> Column:
    """The cell of an item in a table of a count-min sketch."""
    x = item * F.lit(factor)
    return F.pmod((x + F.shiftright(x, 32)).bitwiseAND(F.lit(MODULUS)), F.lit(CELLS))


def counting_filter(hashes: DataFrame, col: str, ranges: int) -> DataFrame:
    """(range, sketch): the counting filter of each hash range, added up from those of the tasks."""
    # of this relative error and confidence a sketch has PROBES tables of CELLS cells
    sketch = F.count_min_sketch(_item(F.col(col)), F.lit(2 / CELLS), F.lit(1 - 0.5**PROBES - 1e-6), F.lit(SEED))
    return hashes.coalesce(COUNTERS).groupBy(F.pmod(F.col(col), F.lit(ranges)).alias("range")).agg(sketch.alias("sketch"))


def counted_twice(sketches: DataFrame) -> tuple[DataFrame, list[int]]:
    """(bucket, bitmap) rows of the cells with a count of 2 or more, and the factors of the tables' hash functions."""
    ensure_checkpoint_dir(sketches.sparkSession)
    sketches = sketches.checkpoint()
    head = sketches.select(*(_long(F.substring("sketch", HEAD + 8 * i + 1, 8)) for i in range(PROBES))).first()
    cells = F.filter(F.sequence(F.lit(0), F.lit(PROBES * CELLS - 1)), lambda i: F.substring("sketch", i * 8 + HEAD + 8 * PROBES + 1, F.lit(8)) > F.unhex(F.lit(f"{1:016x}")))
    spots = sketches.select((F.col("range") * (PROBES * CELLS)).alias("at"), F.explode(cells).alias("cell")).select((F.col("at") + F.col("cell")).alias("pos"))
    return _bitmaps(spots), list(head) if head else [1] * PROBES


def _bitmaps(spots: DataFrame) -> DataFrame:
    """(bucket, bitmap) rows, 4 kB each, of the positions pos."""
    return spots.groupBy(F.floor(F.col("pos") / BITMAP_BITS).alias("bucket")).agg(F.bitmap_construct_agg(F.pmod(F.col("pos"), F.lit(BITMAP_BITS))).alias("bitmap"))


def bloom_of_repeats(hashes: DataFrame, col: str, max_bits: int = MAX_BITS) -> tuple[DataFrame, int]:
    """(bucket, bitmap) rows of a filter of the hashes that occur twice or more, and its bits.

    At most max_bits / 32768 rows of 4 kB each.
    """
    repeated = hashes.groupBy(col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(col).alias("h"))
    ensure_checkpoint_dir(hashes.sparkSession)
    repeated = repeated.checkpoint()  # 8 bytes for each repeated hash; the texts are not read again
    n = repeated.count()
    bits = BITMAP_BITS
    while bits < min(max_bits, n * BITS_PER_KEY):
        bits *= 2
    return _bitmaps(repeated.select(F.explode(F.array(*_positions(F.col("h"), bits))).alias("pos"))), bits


def maybe_repeated(df: DataFrame, h: str, out: str, max_rows: int = MAX_ROWS, max_bits: int = MAX_BITS) -> DataFrame:
    """Adds the boolean `out`: false only where no other row has the same hash `h`."""
    ensure_checkpoint_dir(df.sparkSession)
    hashes = df.select(F.col(h).alias("h")).checkpoint()  # 8 bytes a row
    n = hashes.count()
    if n <= max_rows:
        ranges = max(1, -(-n // RANGE_ROWS))
        bitmaps, factors = counted_twice(counting_filter(hashes, "h", ranges))
        at = F.pmod(F.col(h), F.lit(ranges)) * (PROBES * CELLS)
        spots = [at + i * CELLS + _cell(_item(F.col(h)), f) for i, f in enumerate(factors)]
    else:
        bitmaps, bits = bloom_of_repeats(hashes, "h", max_bits)
        spots = _positions(F.col(h), bits)
    hit = None
    names = []
    for i, pos in enumerate(spots):
        bucket, bitmap = free_name(df, f"bucket{i}"), free_name(df, f"bitmap{i}")
        names += [bucket, bitmap]
        df = df.withColumn(bucket, F.floor(pos / BITMAP_BITS)).join(F.broadcast(bitmaps.select(F.col("bucket").alias(bucket), F.col("bitmap").alias(bitmap))), bucket, "left")
        b = _bit(F.col(bitmap), pos)
        hit = b if hit is None else hit & b
    return df.withColumn(out, hit).drop(*names)


def mark_duplicates(df: DataFrame, key: Column, order: str, max_rows: int = MAX_ROWS, max_bits: int = MAX_BITS) -> DataFrame:
    """All rows with keep_id, group_size, kept and the key's sha256.

    key: a string column expression; order: the column whose largest value stays. Rows may carry any
    other columns; names that clash with those added are replaced.
    """
    df = df.drop("keep_id", "group_size", "kept", "text_sha256")
    h, maybe = free_name(df, "hash"), free_name(df, "maybe")
    text = F.coalesce(key, F.lit(""))
    df = df.withColumn("text_sha256", F.sha2(text, 256))
    df = maybe_repeated(df.withColumn(h, F.xxhash64(text)), h, maybe, max_rows, max_bits)
    alone = df.where(~F.col(maybe)).withColumns({"keep_id": F.col(order), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})
    again = df.where(F.col(maybe))
    groups = again.groupBy("text_sha256").agg(F.max(order).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    joined = join_groups(again, groups, ["text_sha256"], "group_size", [order]).withColumn("kept", F.col(order).eqNullSafe(F.col("keep_id")))
    return alone.unionByName(joined).drop(h, maybe)

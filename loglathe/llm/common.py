"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the operators' word rule, `[^\x20\x09-\x0D]+` being a word.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by Spark's own reader, so any store will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that `df` doesn't hold, in any letter case."""
    taken = {c.lower() for c in df.columns}
    name, n = f"__{stem}", 0
    while name.lower() in taken:
        name, n = f"__{stem}{n}", n + 1
    return name


def set_aside(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """df with other names for its columns that clash with the names, and the way back."""
    taken, back = {n.lower() for n in names}, {}
    for i, c in enumerate([c for c in df.columns if c.lower() in taken]):
        new = free_name(df, f"aside{i}")
        df, back[new] = df.withColumnRenamed(c, new), c
    return df, back


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the shared folder that the session names. Without one there is none but on a single machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loglathe-checkpoint-"))


@contextmanager
def arrow_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """While jobs run inside it, batches for Python hold at most n rows: for tables with wide rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(n, int(before)) if int(before) > 0 else n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: What Python workers keep between tasks, by operator: how to drop it.
_kept: dict[str, Callable[[], object]] = {}


def claim(owner: str, drop: Callable[[], object] | None = None) -> None:
    """Called where a task of an operator starts in a Python worker: what other operators keep there goes,
    and free memory returns to the system. `drop` says how to drop what this one will keep."""
    for other in [k for k in _kept if k != owner]:
        _kept.pop(other)()
    if drop:
        _kept[owner] = drop
    try:
        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another system's C library
        pass


#: Rows of whole texts that a Python worker gets at once.
TEXT_ROWS = 2000


def bound_batches(spark: SparkSession, n: int = TEXT_ROWS) -> None:
    """Lets the session's batches for Python hold at most n rows, as rows with whole texts are wide."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(key))
    spark.conf.set(key, str(min(n, before) if before > 0 else n))


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null. Linear, without materialising the words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def unit_hash(*parts: Column) -> Column:
    """A 52-bit integer from md5, so that any SQL engine can draw the same numbers."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long")


#: What a table that is broadcast may hold, by the estimate of `estimated_bytes`.
BROADCAST_BYTES = 16 * 2**20


def estimated_bytes(df: DataFrame) -> int:
    """Bytes of a table's values: 8 for each number and row, arrays by their elements, strings by their length."""

    def width(c: str, kind: T.DataType) -> Column:
        at = F.col(f"`{c}`")
        if isinstance(kind, T.ArrayType):
            return F.coalesce(F.size(at), F.lit(0)) * 8
        return F.coalesce(F.octet_length(at), F.lit(0)) if isinstance(kind, (T.StringType, T.BinaryType)) else F.lit(8)

    each = sum((width(f.name, f.dataType) for f in df.schema.fields), F.lit(8))
    return df.agg(F.sum(each)).first()[0] or 0


def small_or_shuffled(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A checkpointed table; hinted for broadcast only if its bytes are few. With more, joins with it shuffle."""
    ensure_checkpoint_dir(df.sparkSession)
    df = df.checkpoint()
    return F.broadcast(df) if estimated_bytes(df) <= max_bytes else df


#: Groups that `join_groups` broadcasts at most, the largest of those with enough rows.
HOT_GROUPS = 100_000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, spread: list[str], hot: int = 1000, how: str = "inner") -> DataFrame:
    """rows joined with one row a group, where a few groups may hold most of the rows.

    Groups of `hot` rows or more are joined by broadcast, of more than `HOT_GROUPS` the largest, so what is
    left of them has hardly more than an even share of the rows; in the shuffle for the others their rows are
    spread by a hash of the columns `spread`. groups have narrow columns. `how`: inner or left.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    groups = groups.checkpoint()
    big = groups.where(F.col(size) >= hot)
    n = big.count()
    if not n:
        return rows.join(groups, keys, how)
    if n > HOT_GROUPS:
        hot = max(hot, int(big.select(F.percentile_approx(size, 1 - HOT_GROUPS / n)).first()[0]) + 1)
    return join_few_hot(rows, groups, keys, size, spread, hot, how)


def join_few_hot(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, spread: list[str], hot: int, how: str = "inner") -> DataFrame:
    """What `join_groups` gives, where no more than `HOT_GROUPS` groups have `hot` rows for sure."""
    big = groups.where(F.col(size) >= hot)
    added = [c for c in groups.columns if c not in keys]
    names = {c: f"__group_{i}" for i, c in enumerate([*keys, *added])}
    early = {c: f"__hot_{i}" for i, c in enumerate(added)}
    seen = F.col("__hot").isNotNull()
    found = rows.join(F.broadcast(big.select(*keys, *(F.col(c).alias(early[c]) for c in added), F.lit(True).alias("__hot"))), keys, "left")
    kind = dict(rows.dtypes)[keys[0]]
    other = F.xxhash64(*spread)
    other = F.unhex(F.hex(other)) if kind == "binary" else other.cast(kind)
    found = found.withColumn("__key", F.when(seen, other).otherwise(F.col(keys[0])))
    rest = groups.where(F.col(size) < hot).select(*(F.col(c).alias(x) for c, x in names.items()), F.lit(True).alias("__rest"))
    on = F.col("__key") == F.col(names[keys[0]])
    for k in keys[1:]:
        on &= F.col(k) == F.col(names[k])
    found = found.join(rest, on, "left")
    if how == "inner":
        found = found.where(seen | F.col("__rest"))
    return found.select(*rows.columns, *(F.when(seen, F.col(early[c])).otherwise(F.col(names[c])).alias(c) for c in added))

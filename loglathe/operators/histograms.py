"""Token histograms: how many lines hold a token id how often, and what follows from that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexer

# The thresholds of the statistical tests and of clustering.
CLUSTER_TOLERANCE, MAX_RESIDUAL, MIN_COVERAGE, ARRAY_WIDTH = 0.01, 0.1, 0.2, 3


def frequency_counts(df: DataFrame, line: str) -> DataFrame:
    """(id, freq, n): the number of lines that hold id freq times.

    Counted inside each line by built-in functions, so that only (id, freq) pairs shuffle.
    """
    ids = df.select(lexer.token_ids(F.col(line)).alias("ids"))
    pairs = ids.select(F.explode(F.transform(F.array_distinct("ids"), lambda x: F.struct(x.alias("id"), (F.size("ids") - F.size(F.array_remove("ids", x))).cast("long").alias("freq")))).alias("x"))
    return pairs.groupBy("x.id", "x.freq").agg(F.count(F.lit(1)).alias("n"))


def statistics(counts: DataFrame, total: Column) -> DataFrame:
    """(id, coverage, width, residual, zero, is_struct, is_array) from frequency counts and the number of lines."""
    total = total.cast("long")
    out = counts.groupBy("id").agg(F.sum("n").alias("coverage"), F.count(F.lit(1)).alias("width"), F.max("n").alias("top"))
    out = out.withColumn("residual", (total - F.col("top")) / total).withColumn("zero", total - F.col("coverage"))
    wide = F.col("coverage") > MIN_COVERAGE * total
    return out.select("id", "coverage", "width", "residual", "zero", ((F.col("residual") < MAX_RESIDUAL) & wide).alias("is_struct"), ((F.col("width") > ARRAY_WIDTH) & wide).alias("is_array"))


def normal_forms(counts: DataFrame, total: Column) -> DataFrame:
    """(id, form): the zero bucket, then the buckets by number of lines downwards and frequency upwards."""
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "freq", "n")))
    out = counts.groupBy("id").agg(pairs.alias("pairs"), F.sum("n").alias("coverage"))
    return out.select("id", F.concat(F.array(total.cast("long") - F.col("coverage")), F.transform("pairs", lambda p: p["n"])).alias("form"))


def symmetric_entropy(a: Column, b: Column) -> Column:
    """Half the sum of both relative entropies to the mean of two normal forms, on raw counts."""

    def part(x: Column, y: Column) -> Column:
        return F.when(F.coalesce(x, F.lit(0)) > 0, x * F.log(x / ((F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))) / F.lit(2.0)))).otherwise(0.0)

    return F.aggregate(F.zip_with(a, b, lambda x, y: part(x, y) + part(y, x)), F.lit(0.0), lambda s, x: s + x) / 2


def close_pairs(forms: DataFrame, tolerance: float = CLUSTER_TOLERANCE) -> DataFrame:
    """(a, b, score) of the pairs of ids, a before b, whose forms are within the tolerance.

    A table of ids is small: classes and single characters.
    """
    a, b = forms.select(F.col("id").alias("a"), F.col("form").alias("fa")), forms.select(F.col("id").alias("b"), F.col("form").alias("fb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", symmetric_entropy(F.col("fa"), F.col("fb")).alias("score")).where(F.col("score") < tolerance)

"""Seeded random records of five genres and of any schema, made by built-in functions on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The genres' schemas, and the shares of the result codes.
GENRES = {
    "webcrawl": "url string, dateCrawled bigint, rank double, lastResultCode int, failedAttempts int, nextCrawl bigint, content string",
    "accesslog": "srcIP string, destURL string, visitDate bigint, adRevenue float, userAgent string, countryCode string, languageCode string, searchWord string, duration int",
    "filelisting": "permissions string, user string, `group` string, size int, month string, day int, time string, filename string",
    "sensordata": "temp double, lumens double, pressure double, timestamp bigint, xpos int, ypos int, zpos int",
    "purchase": "productCode bigint, productDesc string, price double, timestamp bigint, quantity int",
}
RESULT_CODES = ((200, 0.8), (401, 0.1), (501, 0.02), (301, 0.02), (403, 0.06))


class _Random:
    """Columns from a row's id and a running number, so that reruns and retries agree."""

    def __init__(self, row: Column, seed: int):
        self.row, self.seed, self.n = row, seed, 0

    def bits(self, *more: Column) -> Column:
        self.n += 1
        return F.pmod(F.xxhash64(self.row, F.lit(self.seed), F.lit(self.n), *more), F.lit(2**31))

    def value(self, t: T.DataType) -> Column:
        if isinstance(t, T.StructType):
            return F.struct(*(self.value(f.dataType).alias(f.name) for f in t.fields))
        if isinstance(t, T.ArrayType):
            return F.array(*(self.value(t.elementType) for _ in range(3)))
        if isinstance(t, T.MapType):
            return F.map_from_arrays(F.array(*(F.lit(f"k{i}").cast(t.keyType) for i in range(3))), F.array(*(self.value(t.valueType) for _ in range(3))))
        if isinstance(t, T.StringType):
            return F.concat_ws("", *(F.char(F.lit(97) + F.pmod(self.bits(), F.lit(26))) for _ in range(8)))
        if isinstance(t, T.BinaryType):
            return F.unhex(F.hex(self.bits()))
        if isinstance(t, T.BooleanType):
            return self.bits() % 2 == 0
        if isinstance(t, T.NullType):
            return F.lit(None)
        if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            return (self.bits() / 2**31 * 1000).cast(t)
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return F.pmod(self.bits(), F.lit(127)).cast(t)
        if isinstance(t, (T.DateType, T.TimestampType)):
            return F.timestamp_seconds(self.bits()).cast(t)
        raise TypeError(t.simpleString())


def random_records(spark: SparkSession, schema: T.StructType | str, n: int, seed: int = 3333) -> DataFrame:
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    r = _Random(F.col("id"), seed)
    return spark.range(n).select(*(r.value(f.dataType).cast(f.dataType).alias(f.name) for f in schema.fields))


def genre(spark: SparkSession, name: str, n: int, seed: int = 3333) -> DataFrame:
    """Records of a genre; result codes come with their shares."""
    df = random_records(spark, GENRES[name], n, seed)
    if name == "webcrawl":
        u, at, out = F.pmod(F.xxhash64("url", "dateCrawled"), F.lit(10_000)) / 10_000, 0.0, None
        for code, share in RESULT_CODES:
            at += share
            out = F.when(u < at, code) if out is None else out.when(u < at, code)
        df = df.withColumn("lastResultCode", out.otherwise(200))
    return df

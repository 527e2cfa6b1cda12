"""A learned parser on a stream: it keeps no state, so it is the batch projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans import parser
from ..plans.types import Node


def parse_stream(lines: DataFrame, root: Node, line: str = "line") -> DataFrame:
    """A stream of lines with the parsed struct, null for rejected lines."""
    return parser.with_parsed(lines, root, line)


def write_stream(parsed: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Parquet files of accepted lines under <out>/data and of rejected ones under <out>/rejects, exactly once."""

    def batch(df: DataFrame, n: int) -> None:
        df = df.persist()  # parsed once for both
        df.where("parsed is not null").write.mode("overwrite").parquet(f"{out}/data/batch={n}")
        df.where("parsed is null").drop("parsed", "parsed_branch").write.mode("overwrite").parquet(f"{out}/rejects/batch={n}")
        df.unpersist()

    writer = parsed.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()

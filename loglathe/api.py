"""The public surface: learn a structure, parse with it, summarise tables and suggest names."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.lexer import token_id, token_ids, tokenize
from .operators import profiles as _profiles
from .operators.histograms import frequency_counts, statistics
from .operators.summary import SummaryNode, dump, summarize
from .plans import discover, parser, types
from .plans.treedist import best_mapping
from .sources import dictionary, sinks, text

__all__ = ["Learned", "dictionary", "dump", "infer", "infer_report", "learn", "map_schemas", "profiles", "suggest", "summarize", "token_histograms", "token_id", "token_ids", "tokenize", "tokenize_report"]


@dataclass(frozen=True)
class Learned:
    """A learned structure; sampled says that there were more profiles than were asked for."""

    root: types.Node
    sampled: bool
    profiles: int

    @property
    def schema(self) -> T.StructType:
        return types.spark_schema(self.root)

    def avro(self):
        return types.avro_schema(self.root)

    def to_json(self) -> str:
        return types.to_json(self.root)

    def cost(self) -> float:
        return self.root.cost()

    def parse(self, df: DataFrame, line: str = "line") -> tuple[DataFrame, DataFrame]:
        """(accepted rows with the struct `parsed`, rejected rows)."""
        return parser.parse(df, self.root, line)

    def records(self, df: DataFrame, line: str = "line") -> DataFrame:
        return self.parse(df, line)[0].select("parsed.*")


def infer(df: DataFrame, line: str = "line", order: str | None = None, meta_by_delimiter: bool = False, nullable_groups: bool = False, depth: int = _profiles.DEPTH, most: int | None = None) -> Learned:
    """The structure of a table's lines; `order` says which lines come first (else their text)."""
    found, sampled = _profiles.collect_profiles(df, line, order or line, depth, most)
    return Learned(discover.infer(found, discover.Options(meta_by_delimiter, nullable_groups)), sampled, len(found))


def learn(spark: SparkSession, path: str, out: str, emit: bool = True) -> dict[str, float]:
    """Learns from text files and writes schema, parser, records and rejects to a new folder.

    Returns the numbers of lines and seconds.
    """
    if sinks.exists(spark, out):
        raise FileExistsError(out)
    began = time.time()
    lines = text.read_lines(spark, path)
    learned = infer(lines, order="line_no")
    inferred = time.time()
    sinks.write_schema(spark, out, learned.root)
    good, bad = learned.parse(lines)
    if learned.root.has_data:
        sinks.write_records(good.select("parsed.*"), out, emit)
    bad.select("line_no", "line").write.mode("errorifexists").json(f"{out}/{sinks.REJECTS}")
    total, rejected = lines.count(), spark.read.schema("line_no long, line string").json(f"{out}/{sinks.REJECTS}").count()
    return {"lines": total, "parsed": total - rejected, "profiles": learned.profiles, "infer_s": inferred - began, "total_s": time.time() - began}


def profiles(df: DataFrame, line: str = "line") -> DataFrame:
    """(profile, n): the id sequences of a table's lines and their numbers."""
    return df.where(F.col(line).isNotNull()).groupBy(_profiles.profile(F.col(line)).alias("profile")).agg(F.count(F.lit(1)).alias("n"))


def token_histograms(df: DataFrame, line: str = "line") -> DataFrame:
    """Coverage, width, residual mass and both tests of every token id."""
    return statistics(frequency_counts(df, line), F.lit(df.count()))


def tokenize_report(df: DataFrame, line: str = "line") -> dict[str, int]:
    """Lines in all, lexed and not (null lines only), and tokens."""
    r = df.agg(F.count(F.lit(1)).alias("lines"), F.count(line).alias("lexed"), F.sum(F.size(tokenize(F.col(line)))).alias("tokens")).first()
    return {"lines": r["lines"], "lexed": r["lexed"], "failed": r["lines"] - r["lexed"], "tokens": r["tokens"] or 0}


def infer_report(df: DataFrame, line: str = "line", order: str | None = None) -> dict[str, object]:
    began = time.time()
    learned = infer(df, line, order)
    return {"lines": df.count(), "profiles": learned.profiles, "sampled": learned.sampled, "seconds": time.time() - began, "cost": learned.cost(), "tree": types.render(learned.root)}


def map_schemas(a: DataFrame | SummaryNode, b: DataFrame | SummaryNode):
    """The edit distance of two tables' schemas and the edits."""
    x, y = (t if isinstance(t, SummaryNode) else summarize(t) for t in (a, b))
    return best_mapping(x, y)


def suggest(spark: SparkSession, folder: str, df: DataFrame, k: int = 1) -> DataFrame:
    """The k nearest dictionary entries of a table's schema."""
    return dictionary.suggest(dictionary.contents(spark, folder), df, k)

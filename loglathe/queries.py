"""The engine's queries over the given tables and their SQL: `QUERIES` and `SQL`, by name."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import api
from .functions import lexer
from .operators import histograms, profiles, summary
from .plans import treedist, types
from .sources import dictionary, generators, sinks, text
from .streaming import parse as streaming

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- events as log lines: most in one shape, errors without a user part, and some lines of literals only

EVERY_BAD = 97


def event_line() -> Column:
    head = F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string"))
    tail = F.concat_ws(" ", F.col("event_type"), F.date_format("ts", "'['dd/MMM/yyyy']' HH:mm:ss"), F.format_string("%.2f", F.col("value")), F.col("props"))
    good = F.when(F.col("event_type") == "error", F.concat_ws(" ", head, tail)).otherwise(F.concat_ws(" ", head, F.lit("-"), tail))
    return F.when(F.col("event_id") % EVERY_BAD == 0, F.lit(";;; |")).otherwise(good)


EVENT_LINE_SQL = f"""CASE WHEN event_id % {EVERY_BAD} = 0 THEN ';;; |' ELSE '10.0.0.' || (user_id % 250)::VARCHAR || CASE WHEN event_type = 'error' THEN ' ' ELSE ' - ' END ||
    concat_ws(' ', event_type, strftime(ts, '[%d/%b/%Y] %H:%M:%S'), printf('%.2f', value), props) END"""


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select(F.col("event_id").alias("k"), event_line().alias("line"))


def _lines(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """(k, line) of a source by its name."""
    if source == "events":
        return event_lines(spark, sf_dir)
    table, key, col = {"props": ("events", "event_id", "props"), "part": ("part", "p_partkey", "p_name"), "documents": ("documents", "doc_id", "text"), "pages": ("pages", "page_id", "html"), "conversations": ("conversations", "conv_id", "text"), "benchmark": ("benchmark", "item_id", "text")}[source]
    return _read(spark, sf_dir, table).select(F.col(key).alias("k"), F.col(col).alias("line"))


LINES_SQL = {
    "events": f"SELECT event_id AS k, {EVENT_LINE_SQL} AS line FROM events",
    "props": "SELECT event_id AS k, props AS line FROM events",
    "part": "SELECT p_partkey AS k, p_name AS line FROM part",
    "documents": "SELECT doc_id AS k, text AS line FROM documents",
    "pages": "SELECT page_id AS k, html AS line FROM pages",
    "conversations": "SELECT conv_id AS k, text AS line FROM conversations",
    "benchmark": "SELECT item_id AS k, text AS line FROM benchmark",
}


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def tokens_sql(lines: str) -> str:
    """CTEs up to `t` (k, n, pos, cls, param, txt, id), the tokens of (k, line); n numbers the lines."""
    pattern = _quoted(lexer.alternation(lexer.DAY_PLAIN))
    rules = {n: _quoted(p) for n, p in lexer.rules(lexer.DAY_PLAIN)}
    order = ("ipaddr", "permissionbits", "date", "time", "floatrange", "intrange", "float", "int", "string", "char", "eol")
    openers = ", ".join(_quoted(c) for c in lexer.CLOSERS)
    cases = " ".join(f"WHEN regexp_full_match(x, {rules[n]}) THEN '{n}'" for n in order)
    return f"""
l AS ({lines}),
r AS (SELECT k, row_number() OVER () AS n, regexp_extract_all(line, {pattern}) AS a FROM l WHERE line IS NOT NULL),
x AS (SELECT k, n, unnest(a) AS x, unnest(range(len(a))) AS slot FROM r),
c AS (SELECT *, CASE WHEN length(x) > 1 AND x[1] IN ({openers}) THEN 'meta' {cases} ELSE 'ws' END AS cls FROM x),
s AS (SELECT *, regexp_extract(x, '^([0-9.]+)-', 1) AS low FROM c),
t0 AS (
    SELECT k, n, slot * 3 AS pos, cls, CASE WHEN cls = 'char' THEN x END AS param, x AS txt FROM s WHERE cls NOT IN ('floatrange', 'intrange')
    UNION ALL SELECT k, n, slot * 3, replace(cls, 'range', ''), NULL, low FROM s WHERE cls IN ('floatrange', 'intrange')
    UNION ALL SELECT k, n, slot * 3 + 1, 'char', '-', '-' FROM s WHERE cls IN ('floatrange', 'intrange')
    UNION ALL SELECT k, n, slot * 3 + 2, replace(cls, 'range', ''), NULL, x[length(low) + 2:] FROM s WHERE cls IN ('floatrange', 'intrange')
),
t AS (SELECT *, cls || coalesce(param, '') AS id FROM t0)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def _tokens(df: DataFrame) -> DataFrame:
    return df.select("k", F.posexplode(lexer.tokenize(F.col("line"))).alias("pos", "t")).select("k", "pos", "t.*", lexer.token_id(F.col("t")).alias("id"))


# ---- tokens

for _source in ("documents", "pages", "conversations", "events", "props", "part"):

    def _count_by_class(spark: SparkSession, sf_dir: str, source: str = _source) -> DataFrame:
        # counted in the tasks, so that a class and a number shuffle, not a row a token
        classes = _lines(spark, sf_dir, source).select(F.explode(lexer.classes(F.col("line"))).alias("cls"))
        return classes.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))

    _query(f"tok_count_by_class_{_source}", f"WITH {tokens_sql(LINES_SQL[_source])} SELECT cls, count(*) AS n FROM t GROUP BY cls")(_count_by_class)

for _source in ("events", "part", "documents"):

    def _first_class(spark: SparkSession, sf_dir: str, source: str = _source) -> DataFrame:
        first = F.get(lexer.tokenize(F.col("line")), F.lit(0))
        return _lines(spark, sf_dir, source).select(first["cls"].alias("cls")).where("cls is not null").groupBy("cls").agg(F.count(F.lit(1)).alias("n"))

    _query(f"tok_first_class_{_source}", f"WITH {tokens_sql(LINES_SQL[_source])} SELECT cls, count(*) AS n FROM t WHERE pos = 0 GROUP BY cls")(_first_class)


@_query("tok_ipaddr", f"WITH {tokens_sql(LINES_SQL['events'])} SELECT txt AS ip, count(*) AS n FROM t WHERE cls = 'ipaddr' GROUP BY txt")
def tok_ipaddr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(event_lines(spark, sf_dir)).where("cls = 'ipaddr'").groupBy(F.col("text").alias("ip")).agg(F.count(F.lit(1)).alias("n"))


@_query(
    "tok_date",
    f"""WITH l AS ({LINES_SQL["events"]}) SELECT extract(month FROM ts)::INTEGER AS month, extract(day FROM ts)::INTEGER AS day, extract(year FROM ts)::INTEGER AS year, count(*) AS n
    FROM events WHERE event_id % {EVERY_BAD} <> 0 GROUP BY ALL""",
)
def tok_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates inside the bracketed groups, decoded."""
    inner = _tokens(event_lines(spark, sf_dir)).where("cls = 'meta' and startswith(text, '[')").select("k", lexer.inner_text(F.col("text")).alias("line"))
    return _tokens(inner).where("cls = 'date'").select(lexer.date_value(F.col("text")).alias("d")).groupBy("d.month", "d.day", "d.year").agg(F.count(F.lit(1)).alias("n"))


@_query(
    "tok_time",
    f"SELECT extract(hour FROM ts)::INTEGER AS hrs, extract(minute FROM ts)::INTEGER AS mins, extract(second FROM ts)::INTEGER AS secs, count(*) AS n FROM events WHERE event_id % {EVERY_BAD} <> 0 GROUP BY ALL",
)
def tok_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(event_lines(spark, sf_dir)).where("cls = 'time'").select(lexer.time_value(F.col("text")).alias("t")).groupBy("t.hrs", "t.mins", "t.secs").agg(F.count(F.lit(1)).alias("n"))


@_query("tok_range", f"WITH {tokens_sql('SELECT p_partkey AS k, p_size::VARCHAR || chr(45) || p_partkey::VARCHAR AS line FROM part')} SELECT k, pos, cls, txt FROM t")
def tok_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of numbers give three tokens."""
    parts = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat_ws("-", "p_size", "p_partkey").alias("line"))
    return _tokens(parts).select("k", F.col("pos").cast("long").alias("pos"), "cls", F.col("text").alias("txt"))


@_query("tok_meta", f"WITH {tokens_sql(LINES_SQL['events'])} SELECT txt[2:-2] AS inner_text, count(*) AS n FROM t WHERE cls = 'meta' GROUP BY 1")
def tok_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(event_lines(spark, sf_dir)).where("cls = 'meta'").groupBy(lexer.inner_text(F.col("text")).alias("inner_text")).agg(F.count(F.lit(1)).alias("n"))


@_query("tok_number", f"WITH {tokens_sql(LINES_SQL['documents'])} SELECT cls, count(*) AS n, count(try_cast(txt AS INTEGER)) FILTER (cls = 'int') AS ints, min(txt) AS low, max(txt) AS high FROM t WHERE cls IN ('int', 'float') GROUP BY cls")
def tok_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in the documents; ints beyond 32 bits have no value."""
    t = _tokens(_lines(spark, sf_dir, "documents")).where("cls in ('int', 'float')")
    return t.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("cls") == "int", F.col("text").try_cast("int"))).alias("ints"), F.min("text").alias("low"), F.max("text").alias("high"))


@_query("tok_has_data", f"WITH {tokens_sql(LINES_SQL['conversations'])} SELECT cls IN ('ipaddr', 'permissionbits', 'date', 'time', 'int', 'float', 'string') AS has_data, count(*) AS n FROM t GROUP BY 1")
def tok_has_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(_lines(spark, sf_dir, "conversations")).groupBy(lexer.has_data(F.col("cls")).alias("has_data")).agg(F.count(F.lit(1)).alias("n"))


# ---- profiles and histograms

for _source in ("events", "part", "props"):

    def _profile_counts(spark: SparkSession, sf_dir: str, source: str = _source) -> DataFrame:
        return _lines(spark, sf_dir, source).where("line is not null").groupBy(profiles.profile(F.col("line")).alias("profile")).agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first_k"))

    _query(f"profile_counts_{_source}", f"WITH {tokens_sql(LINES_SQL[_source])}, p AS (SELECT k, n, string_agg(id, ' ' ORDER BY pos) AS profile FROM t GROUP BY k, n) SELECT profile, count(*) AS n, min(k) AS first_k FROM p GROUP BY profile")(_profile_counts)

_FREQ_SQL = "f AS (SELECT id, freq, count(*) AS n FROM (SELECT n, id, count(*) AS freq FROM t GROUP BY n, id) GROUP BY id, freq)"

for _source in ("events", "documents", "part"):

    def _freq_histogram(spark: SparkSession, sf_dir: str, source: str = _source) -> DataFrame:
        return histograms.frequency_counts(_lines(spark, sf_dir, source).where("line is not null"), "line")

    _query(f"freq_histogram_{_source}", f"WITH {tokens_sql(LINES_SQL[_source])}, {_FREQ_SQL} SELECT id, freq, n FROM f")(_freq_histogram)

    def _hist_stats(spark: SparkSession, sf_dir: str, source: str = _source) -> DataFrame:
        lines = _lines(spark, sf_dir, source).where("line is not null")
        stats = histograms.statistics(histograms.frequency_counts(lines, "line"), F.lit(lines.count()))
        return stats.withColumn("residual", F.round("residual", 6))

    _query(
        f"hist_stats_{_source}",
        f"""WITH {tokens_sql(LINES_SQL[_source])}, {_FREQ_SQL}, m AS (SELECT count(*) AS total FROM r), g AS (
        SELECT id, sum(n)::BIGINT AS coverage, count(*) AS width, max(n) AS top, any_value(total) AS total FROM f, m GROUP BY id)
        SELECT id, coverage, width, round((total - top) / total::DOUBLE, 6) AS residual, total - coverage AS zero,
            (total - top) / total::DOUBLE < {histograms.MAX_RESIDUAL} AND coverage > {histograms.MIN_COVERAGE}::DOUBLE * total AS is_struct,
            width > {histograms.ARRAY_WIDTH} AND coverage > {histograms.MIN_COVERAGE}::DOUBLE * total AS is_array FROM g""",
    )(_hist_stats)

_FORM_SQL = "w AS (SELECT id, list_prepend((SELECT count(*) FROM r) - sum(n), list(n ORDER BY n DESC, freq)) AS form FROM f GROUP BY id)"


@_query("normal_forms", f"WITH {tokens_sql(LINES_SQL['events'])}, {_FREQ_SQL}, {_FORM_SQL} SELECT id, array_to_string(form, ' ') AS form FROM w")
def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = event_lines(spark, sf_dir)
    forms = histograms.normal_forms(histograms.frequency_counts(lines, "line"), F.lit(lines.count()))
    return forms.select("id", F.concat_ws(" ", F.col("form").cast("array<string>")).alias("form"))


@_query(
    "hist_pairs",
    f"""WITH {tokens_sql(LINES_SQL["events"])}, {_FREQ_SQL}, {_FORM_SQL}, p AS (
        SELECT a.id AS a, b.id AS b, a.form AS fa, b.form AS fb, unnest(range(1, greatest(len(a.form), len(b.form)) + 1)) AS i FROM w a JOIN w b ON a.id < b.id
    ), q AS (SELECT a, b, coalesce(fa[i], 0)::DOUBLE AS x, coalesce(fb[i], 0)::DOUBLE AS y FROM p)
    SELECT a, b, round(sum(CASE WHEN x > 0 THEN x * ln(2 * x / (x + y)) ELSE 0 END + CASE WHEN y > 0 THEN y * ln(2 * y / (x + y)) ELSE 0 END) / 2, 6) AS score
    FROM q GROUP BY a, b HAVING sum(CASE WHEN x > 0 THEN x * ln(2 * x / (x + y)) ELSE 0 END + CASE WHEN y > 0 THEN y * ln(2 * y / (x + y)) ELSE 0 END) / 2 < {histograms.CLUSTER_TOLERANCE}""",
)
def hist_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = event_lines(spark, sf_dir)
    forms = histograms.normal_forms(histograms.frequency_counts(lines, "line"), F.lit(lines.count()))
    return histograms.close_pairs(forms).withColumn("score", F.round("score", 6))


@_query(
    "first_samples",
    f"WITH {tokens_sql(LINES_SQL['events'])}, q AS (SELECT k, id, txt, row_number() OVER (PARTITION BY id ORDER BY k, pos) AS place FROM t) SELECT id, place, k, txt FROM q WHERE place <= 3",
)
def first_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three tokens of each id, by line and place: of each task three an id leave it."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("id").orderBy("k", "pos"))
    return _tokens(event_lines(spark, sf_dir)).withColumn("place", place).where(F.col("place") <= profiles.SAMPLES).select("id", F.col("place").cast("long").alias("place"), "k", F.col("text").alias("txt"))


for _source in ("events", "part"):

    def _union_partition(spark: SparkSession, sf_dir: str, source: str = _source) -> DataFrame:
        ids = lexer.token_ids(F.col("line"))
        return _lines(spark, sf_dir, source).where("line is not null").groupBy(F.concat_ws(" ", F.slice(ids, 1, 3)).alias("head")).agg(F.count(F.lit(1)).alias("n"))

    _query(
        f"union_partition_{_source}",
        f"WITH {tokens_sql(LINES_SQL[_source])}, p AS (SELECT n, array_to_string(list(id ORDER BY pos)[1:3], ' ') AS head FROM t GROUP BY n) SELECT head, count(*) AS n FROM p GROUP BY head",
    )(_union_partition)


# ---- learning and parsing


def learned_events(spark: SparkSession, sf_dir: str) -> api.Learned:
    return api.infer(event_lines(spark, sf_dir), order="k")


def _flat_events(parsed: DataFrame, root: types.Node) -> DataFrame:
    """The parsed fields of log lines in one shape: ip, event_type, date, time, value and the number of props."""
    union = F.col(f"parsed.{root.name}") if isinstance(root, types.Union) else F.col("parsed")
    branches = [b for b in (root.branches if isinstance(root, types.Union) else [root]) if b.has_data]

    def first(find) -> Column:
        found = []
        for b in branches:
            at = union[b.name] if isinstance(root, types.Union) else union
            found += find(b, at)
        return F.coalesce(*found)

    def leaves(node: types.Node, at: Column):
        for m in node.children:
            if m.has_data:
                here = at[m.name]
                if isinstance(m, types.Base):
                    yield m, here
                else:
                    yield from leaves(m, here)

    def of(cls: str, nth: int = 0):
        return lambda b, at: [c for m, c in leaves(b, at) if m.cls == cls][nth : nth + 1]

    return parsed.select(
        *(c for c in ("k",) if c in parsed.columns),
        first(of("ipaddr")).alias("ip"),
        first(of("string")).alias("event_type"),
        first(of("date")).alias("date"),
        first(of("time")).alias("time"),
        first(of("float")).alias("value"),
        first(of("int")).alias("number"),
    )


@_query(
    "parse_events",
    f"""SELECT event_id AS k, '10.0.0.' || (user_id % 250)::VARCHAR AS ip, event_type, extract(day FROM ts)::INTEGER AS day, extract(hour FROM ts)::INTEGER AS hrs,
        round(printf('%.2f', value)::DOUBLE * 100)::BIGINT AS cents, regexp_extract(props, '([0-9]+)', 1)::INTEGER AS number FROM events WHERE event_id % {EVERY_BAD} <> 0""",
)
def parse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns the structure of the log lines and reads their fields back with it."""
    learned = learned_events(spark, sf_dir)
    good, _ = learned.parse(event_lines(spark, sf_dir))
    flat = _flat_events(good, learned.root)
    return flat.select("k", "ip", "event_type", F.col("date.day").alias("day"), F.col("time.hrs").alias("hrs"), F.round(F.col("value") * 100).cast("long").alias("cents"), "number")


@_query("parse_rejects", f"SELECT event_id AS k, {EVENT_LINE_SQL} AS line FROM events WHERE event_id % {EVERY_BAD} = 0")
def parse_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = learned_events(spark, sf_dir).parse(event_lines(spark, sf_dir))
    return bad.select("k", "line")


@_query(
    "parse_agg",
    f"""SELECT event_type, count(*) AS n, sum(round(printf('%.2f', value)::DOUBLE * 100)::BIGINT)::BIGINT AS cents, count(DISTINCT user_id % 250) AS ips, min(extract(day FROM ts))::INTEGER AS first_day
    FROM events WHERE event_id % {EVERY_BAD} <> 0 GROUP BY event_type""",
)
def parse_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: learn, parse, aggregate what was parsed."""
    learned = learned_events(spark, sf_dir)
    good, _ = learned.parse(event_lines(spark, sf_dir))
    flat = _flat_events(good, learned.root)
    return flat.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"), F.count_distinct("ip").alias("ips"), F.min("date.day").alias("first_day"))


@_query("parse_props", "SELECT event_id AS k, regexp_extract(props, '([0-9]+)', 1)::INTEGER AS number FROM events")
def parse_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir, "props")
    learned = api.infer(lines, order="k")
    number = [c for c in _columns(learned.schema) if c[1] == T.IntegerType()]
    return learned.parse(lines)[0].select("k", F.coalesce(*(F.col("parsed." + p) for p, _ in number)).alias("number"))


def _columns(schema: T.StructType, path: str = ""):
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            yield from _columns(f.dataType, f"{path}{f.name}.")
        else:
            yield f"{path}{f.name}", f.dataType


#: What the trees of the three sources must be: three shapes of log lines, one of props, one of names.
_PROPS = '{char({) {{char(") char(k) char(")} char(:) ws int} char(})}'
_SHAPE = "{{ipaddr {}string ws {{char([) date char(])}} ws time ws float ws {}}}"
_EVENT_TREE = f"<{{char(;) char(;) char(;) ws char(|)}} | {_SHAPE.format('ws char(-) ws ', _PROPS)} | {_SHAPE.format('ws ', _PROPS)}>"
#: Their numbers of nodes: 1 + 6 + 27 + 25, 11 and 4. Every node costs ln 24.
_NODES = {"events": (_EVENT_TREE, 59, 3), "props": (_PROPS, 11, 1), "part": ("{string ws string}", 4, 1)}


@_query("infer_tree", "SELECT * FROM (VALUES " + ", ".join(f"({_quoted(k)}, {_quoted(t)}, round({n} * ln(24), 6)::DOUBLE, {p}::BIGINT, false)" for k, (t, n, p) in _NODES.items()) + ") v(source, tree, cost, profiles, sampled)")
def infer_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The learned trees of three sources with their costs."""
    rows = []
    for source in _NODES:
        x = api.infer(_lines(spark, sf_dir, source), order="k")
        rows.append((source, types.render(x.root), round(x.cost(), 6), x.profiles, x.sampled))
    return spark.createDataFrame(rows, "source string, tree string, cost double, profiles long, sampled boolean")


_DATE_TYPE, _TIME_TYPE = "struct<month:int,day:int,year:int>", "struct<hrs:int,mins:int,secs:int>"


def _avro_record(name: str, *fields: tuple[str, object]) -> dict[str, object]:
    return {"type": "record", "name": name, "fields": [{"name": n, "type": t} for n, t in fields]}


#: Nodes are numbered by kind in preorder; those without data are left out.
_SCHEMAS = {
    "props": ("struct<record_2:struct<base_7:int>>", _avro_record("record_1", ("record_2", _avro_record("record_2", ("base_7", "int"))))),
    "part": ("struct<base_1:string,base_3:string>", _avro_record("record_1", ("base_1", "string"), ("base_3", "string"))),
}


@_query("learned_schemas", "SELECT * FROM (VALUES " + ", ".join(f"({_quoted(k)}, {_quoted(s)}, {_quoted(json.dumps(a))})" for k, (s, a) in _SCHEMAS.items()) + ") v(source, spark, avro)")
def learned_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark and Avro schemas of what was learned."""
    rows = []
    for source in _SCHEMAS:
        x = api.infer(_lines(spark, sf_dir, source), order="k")
        rows.append((source, x.schema.simpleString(), json.dumps(types.without_docs(x.avro()))))
    return spark.createDataFrame(rows, "source string, spark string, avro string")


@_query(
    "parse_arrays",
    "SELECT l_orderkey AS k, count(*) AS n, sum(l_partkey)::BIGINT AS total, min(l_partkey)::BIGINT AS first FROM lineitem GROUP BY l_orderkey",
)
def parse_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of numbers of any length are learned as an array, and read back as one."""
    items = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_list("l_partkey")).alias("x"))
    lines = items.select("k", F.array_join(F.transform("x", lambda v: F.concat(v.cast("string"), F.lit(","))), "").alias("line"))
    learned = api.infer(lines, order="k")
    array = next(n for n in learned.root.walk() if isinstance(n, types.Array))
    head = next(c for c, t in _columns(learned.schema) if t == T.IntegerType())
    rest = F.transform(F.col(f"parsed.{array.name}"), lambda x: F.coalesce(*(x[m.name] for m in array.body.children if m.has_data)))
    good = learned.parse(lines)[0].select("k", F.concat(F.array(F.col(f"parsed.{head}")), F.coalesce(rest, F.array().cast("array<int>"))).alias("x"))
    total = F.aggregate("x", F.lit(0).cast("long"), lambda a, v: a + v)
    return good.select("k", F.size("x").cast("long").alias("n"), total.alias("total"), F.array_min("x").cast("long").alias("first"))


@_query(
    "parse_heads",
    """SELECT p_partkey AS k, CASE WHEN p_partkey % 3 <> 1 THEN p_size END::INTEGER AS number, CASE WHEN p_partkey % 3 <> 2 THEN split_part(p_name, ' ', 1) END AS word,
    (SELECT count(*) FROM (VALUES (0), (1), (2)))::INTEGER AS branches FROM part""",
)
def parse_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in which no token is in nearly all and none makes an array: branches by their first tokens."""
    third = F.col("p_partkey") % 3
    line = F.when(third == 0, F.concat_ws(" ", "p_size", "p_name")).when(third == 1, F.col("p_name")).otherwise(F.col("p_size").cast("string"))
    lines = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), line.alias("line"))
    learned = api.infer(lines, order="k")
    cols = _columns(learned.schema)
    ints, words = ([c for c, t in cols if t == kind] for cols, kind in ((list(cols), T.IntegerType()), (list(_columns(learned.schema)), T.StringType())))
    parsed = learned.parse(lines)[0]
    return parsed.select("k", F.coalesce(*(F.col(f"parsed.{c}") for c in ints)).alias("number"), F.coalesce(*(F.col(f"parsed.{c}") for c in words)).alias("word"), F.lit(len(learned.root.children)).alias("branches"))


@_query("line_numbers", "SELECT event_id AS line_no, event_id::VARCHAR || ' ' || event_type AS line FROM events")
def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of several files are numbered from 0 in the order of the files."""
    folder = _folder(spark)
    rows = _read(spark, sf_dir, "events").select("event_id", F.concat_ws(" ", "event_id", "event_type").alias("line"))
    first = rows.agg(F.min("event_id")).first()[0]
    rows.repartitionByRange(5, "event_id").sortWithinPartitions("event_id").select("line").write.text(f"{folder}/in")
    return text.read_lines(spark, f"{folder}/in").select((F.col("line_no") + first).alias("line_no"), "line")


def _folder(spark: SparkSession) -> str:
    """A new folder in the place that the cluster shares; on a single machine its own."""
    import tempfile

    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not (sc.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="loglathe-checkpoint-"))
    return f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"


@_query("learn_files", f"SELECT count(*) AS lines, count(*) FILTER (event_id % {EVERY_BAD} <> 0) AS parsed, count(*) FILTER (event_id % {EVERY_BAD} = 0) AS rejected, true AS same_parser FROM events")
def learn_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text scan, learning and all sinks: writes log lines as files, learns from them, reads the results."""
    folder = _folder(spark)
    event_lines(spark, sf_dir).select("line").write.text(f"{folder}/in")
    counts = api.learn(spark, f"{folder}/in", f"{folder}/out")
    root = sinks.read_parser(spark, f"{folder}/out")
    records = spark.read.parquet(f"{folder}/out/{sinks.DATA}.parquet").count()
    same = root == learned_events(spark, sf_dir).root and records == counts["parsed"]
    return spark.createDataFrame([(counts["lines"], counts["parsed"], counts["lines"] - counts["parsed"], same)], "lines long, parsed long, rejected long, same_parser boolean")


@_query("stream_parse", SQL["parse_agg"])
def stream_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The learned parser on a stream of files, all that are there, into Parquet."""
    folder = _folder(spark)
    event_lines(spark, sf_dir).select("line").write.text(f"{folder}/in")
    root = learned_events(spark, sf_dir).root
    q = streaming.write_stream(streaming.parse_stream(text.stream_lines(spark, f"{folder}/in"), root), f"{folder}/out", f"{folder}/state")
    q.awaitTermination()
    flat = _flat_events(spark.read.parquet(f"{folder}/out/data"), root)
    return flat.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"), F.count_distinct("ip").alias("ips"), F.min("date.day").alias("first_day"))


# ---- summaries

COLUMNS = {
    "lineitem": "l_orderkey:long l_partkey:long l_suppkey:long l_linenumber:int l_quantity:double l_extendedprice:double l_discount:double l_tax:double l_returnflag:string l_linestatus:string l_shipdate:timestamp",
    "orders": "o_orderkey:long o_custkey:long o_orderstatus:string o_totalprice:double o_orderdate:timestamp o_orderpriority:string",
    "customer": "c_custkey:long c_name:string c_nationkey:int c_acctbal:double c_mktsegment:string",
    "part": "p_partkey:long p_name:string p_brand:string p_type:string p_size:int p_retailprice:double",
    "documents": "doc_id:long text:string lang:string source:string n_chars:long",
}


def _summary_sql(table: str) -> str:
    out = [f"SELECT '{table}' AS path, 'record' AS kind, count(*) AS num_data, '' AS stat, NULL::DOUBLE AS value FROM {table}"]
    for c in COLUMNS[table].split():
        name, kind = c.split(":")
        stat, value = {"string": ("total_length", f"sum(strlen({name}))"), "timestamp": ("", "NULL")}.get(kind, ("total", f"sum({name})"))
        out.append(f"SELECT '{table}.{name}', '{kind}', count({name}), '{stat}', round(({value})::DOUBLE, 2) FROM {table}")
    return "\nUNION ALL ".join(out)


for _table in COLUMNS:

    def _summary(spark: SparkSession, sf_dir: str, table: str = _table) -> DataFrame:
        return summary.dump_frame(spark, summary.summarize(_read(spark, sf_dir, table), table)).withColumn("value", F.round("value", 2))

    _query(f"summary_{_table}", _summary_sql(_table))(_summary)


@_query(
    "summary_nested",
    """WITH e AS (SELECT *, o_totalprice > 100000 AS big FROM orders), i AS (SELECT l_orderkey AS k, count(*) AS n, sum(l_linenumber) AS s FROM lineitem GROUP BY 1)
SELECT 'x' AS path, 'record' AS kind, (SELECT count(*) FROM e) AS num_data, '' AS stat, NULL::DOUBLE AS value
UNION ALL SELECT 'x.o', 'record', (SELECT count(*) FROM e), '', NULL
UNION ALL SELECT 'x.o.key', 'long', count(o_orderkey), 'total', sum(o_orderkey)::DOUBLE FROM e
UNION ALL SELECT 'x.o.big', 'boolean', count(big), 'num_true', count(*) FILTER (big) FROM e
UNION ALL SELECT 'x.o.big', 'boolean', count(big), 'num_false', count(*) FILTER (NOT big) FROM e
UNION ALL SELECT 'x.o.bytes', 'bytes', count(*), 'total_length', sum(strlen(o_orderpriority)) FROM e
UNION ALL SELECT 'x.items', 'array', count(n), 'total_size', sum(n)::DOUBLE FROM e LEFT JOIN i ON o_orderkey = k
UNION ALL SELECT 'x.items.element', 'record', sum(n)::BIGINT, '', NULL FROM e JOIN i ON o_orderkey = k
UNION ALL SELECT 'x.items.element.line', 'int', sum(n)::BIGINT, 'total', sum(s)::DOUBLE FROM e JOIN i ON o_orderkey = k
UNION ALL SELECT 'x.nothing', 'null', count(*), '', NULL FROM e""",
)
def summary_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, arrays of records, booleans, bytes and nulls."""
    items = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("line"))).alias("items"))
    orders = _read(spark, sf_dir, "orders").join(items, "o_orderkey", "left")
    o = F.struct(F.col("o_orderkey").alias("key"), (F.col("o_totalprice") > 100000).alias("big"), F.encode("o_orderpriority", "UTF-8").alias("bytes"))
    return summary.dump_frame(spark, summary.summarize(orders.select(o.alias("o"), "items", F.lit(None).alias("nothing")), "x"))


@_query(
    "summary_array",
    """SELECT 'embeddings' AS path, 'record' AS kind, count(*) AS num_data, '' AS stat, NULL::DOUBLE AS value FROM embeddings
UNION ALL SELECT 'embeddings.vec_id', 'long', count(vec_id), 'total', sum(vec_id)::DOUBLE FROM embeddings
UNION ALL SELECT 'embeddings.embedding', 'array', count(embedding), 'total_size', sum(len(embedding))::DOUBLE FROM embeddings
UNION ALL SELECT 'embeddings.embedding.element', 'float', sum(len(embedding))::BIGINT, 'total', round((SELECT sum(x::DOUBLE) FROM (SELECT unnest(embedding) AS x FROM embeddings)), 4) FROM embeddings
UNION ALL SELECT 'embeddings.label', 'int', count(label), 'total', sum(label)::DOUBLE FROM embeddings""",
)
def summary_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.dump_frame(spark, summary.summarize(_read(spark, sf_dir, "embeddings"), "embeddings")).withColumn("value", F.round("value", 4))


@_query(
    "summary_map",
    """WITH p AS (SELECT regexp_extract(props, '"([a-z]+)"', 1) AS key, regexp_extract(props, '([0-9]+)', 1)::BIGINT AS v FROM events)
SELECT 'props' AS path, 'record' AS kind, count(*) AS num_data, '' AS stat, NULL::DOUBLE AS value FROM p
UNION ALL SELECT 'props.m', 'map', count(*), '', NULL FROM p
UNION ALL SELECT 'props.m.' || key, 'long', count(v), 'total', sum(v)::DOUBLE FROM p GROUP BY key""",
)
def summary_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").select(F.from_json("props", "map<string,bigint>").alias("m"))
    return summary.dump_frame(spark, summary.summarize(rows, "props"))


@_query(
    "summary_enum_fixed_union",
    """SELECT 'x' AS path, 'record' AS kind, count(*) AS num_data, '' AS stat, NULL::DOUBLE AS value FROM orders
UNION ALL SELECT 'x.status', 'enum', count(o_orderstatus), 'symbols.' || s, n FROM orders, (SELECT o_orderstatus AS s, count(*) + 1 AS n FROM orders GROUP BY 1) GROUP BY s, n
UNION ALL SELECT 'x.four', 'fixed', count(*), 'total_length', count(*) * 4 FROM orders
UNION ALL SELECT 'x.four', 'fixed', count(*), 'size', 4 FROM orders
UNION ALL SELECT 'x.u', 'union', count(*), 'branches.a', count(*) FILTER (o_orderkey % 2 = 0) FROM orders
UNION ALL SELECT 'x.u', 'union', count(*), 'branches.b', count(*) FILTER (o_orderkey % 2 <> 0) FROM orders
UNION ALL SELECT 'x.u.a', 'long', count(*), 'total', sum(o_orderkey)::DOUBLE FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT 'x.u.b', 'string', count(*), 'total_length', sum(strlen(o_orderpriority))::DOUBLE FROM orders WHERE o_orderkey % 2 <> 0""",
)
def summary_enum_fixed_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enums count from 1; a union is a struct of branches."""
    even = F.col("o_orderkey") % 2 == 0
    rows = _read(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("status", metadata={"enum": True}),
        F.encode(F.lpad((F.col("o_orderkey") % 1000).cast("string"), 4, "0"), "UTF-8").alias("four", metadata={"fixed": 4}),
        F.struct(F.when(even, F.col("o_orderkey")).alias("a"), F.when(~even, F.col("o_orderpriority")).alias("b")).alias("u", metadata={"union": True}),
    )
    return summary.dump_frame(spark, summary.summarize(rows, "x"))


# ---- the dictionary


@_query("dictionary_contents", "SELECT * FROM (VALUES " + ", ".join(f"('{t}')" for t in TABLES) + ") v(info)")
def dictionary_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dictionary(spark, sf_dir).select("info")


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{_folder(spark)}/dictionary"
    for t in TABLES:
        dictionary.add(spark, folder, _read(spark, sf_dir, t), t)
    return dictionary.contents(spark, folder)


@_query(
    "suggest_topk",
    """WITH m AS (SELECT abs((SELECT avg(s_nationkey) FROM supplier) - (SELECT avg(c_nationkey) FROM customer)) AS d)
SELECT 'customer' AS info, 4 * 0.5::DOUBLE AS distance, 6 AS n_ops
UNION ALL SELECT 'supplier', round(3 * 0.5 + d + 1000, 4), 6 FROM m
UNION ALL SELECT 'events', 4 * 0.5 + 3 * 1000, 8""",
)
def suggest_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest of all tables' schemas to customers with fields of no name.

    A field that matches costs 0.5, or for ints the distance of the means; one too many or too few costs 1000.
    """
    anonymous = _read(spark, sf_dir, "customer").toDF("a", "b", "c", "d", "e")
    return dictionary.suggest(_dictionary(spark, sf_dir), anonymous, 3).select("info", F.round("distance", 4).alias("distance"), F.size("ops").alias("n_ops"))


@_query(
    "suggest_report",
    """SELECT 'customer' AS info, 2.0::DOUBLE AS distance, 'rename' AS section, 'root' || s AS source, 'root' || t AS target
FROM (VALUES ('', ''), ('.a', '.c_custkey'), ('.b', '.c_name'), ('.c', '.c_nationkey'), ('.d', '.c_acctbal'), ('.e', '.c_mktsegment')) v(s, t)""",
)
def suggest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    anonymous = _read(spark, sf_dir, "customer").toDF("a", "b", "c", "d", "e")
    return dictionary.report(dictionary.suggest(_dictionary(spark, sf_dir), anonymous, 1))


@_query("suggest_renamed", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def suggest_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with fields of no name, renamed by the nearest schema."""
    anonymous = _read(spark, sf_dir, "customer").toDF("a", "b", "c", "d", "e")
    best = dictionary.suggest(_dictionary(spark, sf_dir), anonymous, 1).first()
    return dictionary.renamed(anonymous, best["ops"])


@_query(
    "schema_distance_int",
    "SELECT abs(avg(p_size) - (SELECT avg(c_nationkey) FROM customer)) < 9000 AS near, round(abs(avg(p_size) - (SELECT avg(c_nationkey) FROM customer)), 6) AS distance FROM part",
)
def schema_distance_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between two records of one int each: the distance of the means."""
    a, b = _read(spark, sf_dir, "part").select("p_size"), _read(spark, sf_dir, "customer").select("c_nationkey")
    m = treedist.best_mapping(summary.summarize(a), summary.summarize(b))
    return spark.createDataFrame([(m.distance < 9000, round(m.distance, 6))], "near boolean, distance double")


@_query("generated_genres", "SELECT * FROM (VALUES " + ", ".join(f"('{g}', 1000::BIGINT, {s.count(',') + 1}::BIGINT)" for g, s in generators.GENRES.items()) + ") v(genre, n, fields)")
def generated_genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousand seeded records of each genre."""
    out = None
    for g in generators.GENRES:
        df = generators.genre(spark, g, 1000)
        one = df.agg(F.lit(g).alias("genre"), F.count(F.lit(1)).alias("n"), F.lit(len(df.columns)).cast("long").alias("fields"))
        out = one if out is None else out.unionByName(one)
    return out


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_agg(spark, sf_dir)


__all__ = ["QUERIES", "SQL", "entry"]

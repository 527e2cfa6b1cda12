"""Statistical summaries: one tree of numbers for a table with any nested schema, in one aggregation.

Values below arrays are summed inside their arrays by higher-order functions, so nothing is exploded;
only maps, whose keys are data, and enums, whose symbols are, take a grouping each.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = 1
#: The kinds of nodes; the last three are for types that the fourteen do not cover.
KINDS = ("array", "boolean", "bytes", "double", "enum", "fixed", "float", "int", "long", "map", "null", "record", "string", "union", "decimal", "date", "timestamp")


@dataclass(frozen=True)
class SummaryNode:
    kind: str
    name: str
    num_data: int = 0
    stats: dict[str, Any] = field(default_factory=dict)
    children: tuple[SummaryNode, ...] = ()
    doc: str = ""

    def matched(self) -> tuple[SummaryNode, ...]:
        """Children as matching sees them: records only have some; arrays, maps and unions are leaves."""
        return self.children if self.kind == "record" else ()

    def walk(self, path: str = "") -> Iterator[tuple[str, SummaryNode]]:
        here = f"{path}.{self.name}" if path else self.name
        yield here, self
        for c in self.children:
            yield from c.walk(here)

    @property
    def mean(self) -> float | None:
        return self.stats["total"] / self.num_data if self.num_data and self.stats.get("total") is not None else None

    def to_dict(self) -> dict[str, Any]:
        return {"kind": self.kind, "name": self.name, "num_data": self.num_data, "stats": self.stats, "doc": self.doc, "children": [c.to_dict() for c in self.children]}

    @staticmethod
    def from_dict(d: dict[str, Any]) -> SummaryNode:
        return SummaryNode(d["kind"], d["name"], d["num_data"], d["stats"], tuple(map(SummaryNode.from_dict, d["children"])), d["doc"])


def to_json(node: SummaryNode) -> str:
    return json.dumps({"version": VERSION, "root": node.to_dict()}, sort_keys=True)


def from_json(text: str) -> SummaryNode:
    d = json.loads(text)
    if d.get("version") != VERSION:
        raise ValueError(f"a summary of version {d.get('version')}; {VERSION} is read here")
    return SummaryNode.from_dict(d["root"])


def kind_of(f: T.StructField) -> str:
    t, meta = f.dataType, f.metadata or {}
    if isinstance(t, T.StructType):
        return "union" if meta.get("union") else "record"
    if isinstance(t, T.StringType):
        return "enum" if meta.get("enum") else "string"
    if isinstance(t, T.BinaryType):
        return "fixed" if meta.get("fixed") else "bytes"
    for kinds, name in (
        ((T.ArrayType,), "array"),
        ((T.BooleanType,), "boolean"),
        ((T.DoubleType,), "double"),
        ((T.FloatType,), "float"),
        ((T.ByteType, T.ShortType, T.IntegerType), "int"),
        ((T.LongType,), "long"),
        ((T.MapType,), "map"),
        ((T.NullType,), "null"),
        ((T.DecimalType,), "decimal"),
        ((T.DateType,), "date"),
        ((T.TimestampType, T.TimestampNTZType), "timestamp"),
    ):
        if isinstance(t, kinds):
            return name
    raise TypeError(f"no node for {t.simpleString()}")


class _Values:
    """The values of a field in one row: the column itself, or below arrays all values in one array."""

    def __init__(self, col: Column, many: bool = False):
        self.col, self.many = col, many

    def field(self, name: str) -> _Values:
        return _Values(F.transform(F.filter(self.col, lambda x: x.isNotNull()), lambda x: x[name]), True) if self.many else _Values(self.col[name])

    def elements(self) -> _Values:
        return _Values(F.flatten(F.filter(self.col, lambda x: x.isNotNull())) if self.many else self.col, True)

    def sum(self, of, kind: str) -> Column:
        """The sum over all rows of of(value), null values aside."""
        if not self.many:
            return F.sum(of(self.col).cast(kind))
        each = F.aggregate(F.filter(self.col, lambda x: x.isNotNull()), F.lit(0).cast(kind), lambda a, x: a + F.coalesce(of(x).cast(kind), F.lit(0).cast(kind)))
        return F.sum(each)

    def count(self) -> Column:
        return F.sum(F.coalesce(F.size(F.filter(self.col, lambda x: x.isNotNull())), F.lit(0)).cast("bigint")) if self.many else F.count(self.col)

    def count_null(self) -> Column:
        return F.sum(F.coalesce(F.size(F.filter(self.col, lambda x: x.isNull())), F.lit(0)).cast("bigint")) if self.many else F.count_if(self.col.isNull())


class _Plan:
    def __init__(self) -> None:
        self.exprs: list[Column] = []

    def add(self, c: Column) -> int:
        self.exprs.append(c.alias(f"a{len(self.exprs)}"))
        return len(self.exprs) - 1


def _node(f: T.StructField, v: _Values, plan: _Plan, groupings: list[tuple[T.StructField, _Values]]):
    """A function from the aggregation's row (and the groupings' results) to the node of a field."""
    kind, t, doc = kind_of(f), f.dataType, (f.metadata or {}).get("comment", "")
    n = plan.add(v.count())
    parts: dict[str, int] = {}
    children = []
    if kind in ("int", "long"):
        parts["total"] = plan.add(v.sum(lambda x: x, "bigint" if kind == "int" else "decimal(38,0)"))
    elif kind in ("double", "float"):
        parts["total"] = plan.add(v.sum(lambda x: x, "double"))
    elif kind == "decimal":
        parts["total"] = plan.add(v.sum(lambda x: x, "decimal(38,6)"))
    elif kind in ("string", "bytes", "fixed"):
        parts["total_length"] = plan.add(v.sum(lambda x: F.octet_length(x), "bigint"))
    elif kind == "boolean":
        parts["num_true"] = plan.add(v.sum(lambda x: x.cast("int"), "bigint"))
    elif kind == "null":
        parts["num_null"] = plan.add(v.count_null())
    elif kind == "array":
        parts["total_size"] = plan.add(v.sum(lambda x: F.size(x), "bigint"))
        children.append(_node(T.StructField("element", t.elementType, True, (f.metadata or {}).get("element") or {}), v.elements(), plan, groupings))
    elif kind in ("record", "union"):
        children = [_node(c, v.field(c.name), plan, groupings) for c in t.fields]
    group = None
    if kind in ("map", "enum"):
        group = len(groupings)
        groupings.append((f, v))

    def build(row, grouped) -> SummaryNode:
        num = row[n] or 0
        stats = {k: (float(x) if hasattr(x := row[i], "as_tuple") and kind == "decimal" else int(x) if hasattr(x, "as_tuple") else x) for k, i in parts.items()}
        stats = {k: 0 if x is None else x for k, x in stats.items()}
        if kind == "boolean":
            stats["num_false"] = num - stats["num_true"]
        if kind == "fixed":
            stats["size"] = (f.metadata or {})["fixed"]
        if kind == "null":
            num = stats.pop("num_null")
        kids = tuple(c(row, grouped) for c in children)
        if kind == "map":
            kids = grouped[group]
        if kind == "enum":
            stats["symbols"] = grouped[group]
        if kind == "union":
            stats["branches"] = {k.name: k.num_data for k in kids}
        return SummaryNode(kind, f.name, num, stats, kids, doc)

    return build


def _grouped(df: DataFrame, f: T.StructField, v: _Values):
    if kind_of(f) == "enum":
        one = df.select((F.explode(v.col) if v.many else v.col).alias("x")).where("x is not null")
        return {r["x"]: r["n"] + 1 for r in one.groupBy("x").agg(F.count(F.lit(1)).alias("n")).orderBy("x").collect()}  # counts start at 1
    t: T.MapType = f.dataType
    maps = df.select((F.explode(v.col) if v.many else v.col).alias("m"))
    rows = maps.select(F.explode("m").alias("key", "value"))
    plan, deeper = _Plan(), []
    build = _node(T.StructField("value", t.valueType), _Values(F.col("value")), plan, deeper)
    if deeper:
        raise TypeError("maps and enums inside maps have no summary")
    out = []
    for r in rows.groupBy("key").agg(*plan.exprs).orderBy("key").collect():
        node = build(r[1:], [])
        out.append(SummaryNode(node.kind, str(r["key"]), node.num_data, node.stats, node.children, node.doc))
    return tuple(out)


def summarize(df: DataFrame, name: str = "root", doc: str = "") -> SummaryNode:
    """The summary tree of a table's rows; fields in schema order."""
    plan, groupings = _Plan(), []
    total = plan.add(F.count(F.lit(1)))
    builders = [_node(f, _Values(F.col(f"`{f.name}`")), plan, groupings) for f in df.schema.fields]
    row = df.agg(*plan.exprs).first()
    grouped = [_grouped(df, f, v) for f, v in groupings]
    return SummaryNode("record", name, row[total], {}, tuple(b(row, grouped) for b in builders), doc)


def dump(node: SummaryNode) -> list[tuple[str, str, int, str, float | None]]:
    """(path, kind, num_data, stat, value) rows of a report."""
    out: list[tuple[str, str, int, str, float | None]] = []
    for path, n in node.walk():
        flat = {k: v for k, v in n.stats.items() if not isinstance(v, dict)} | {f"{k}.{s}": c for k, v in n.stats.items() if isinstance(v, dict) for s, c in v.items()}
        for stat, value in flat.items() or [("", None)]:
            out.append((path, n.kind, n.num_data, stat, None if value is None else float(value)))
    return out


def dump_frame(spark, node: SummaryNode) -> DataFrame:
    return spark.createDataFrame(dump(node), "path string, kind string, num_data long, stat string, value double")

"""Type trees: what structure learning finds, as Spark schemas, Avro schemas and JSON."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

from ..functions.lexer import DATA_CLASSES

VERSION = 1
#: The cost of a node's kind; Spark and Avro types of the token classes.
KIND_COST = math.log(24)
DATE = T.StructType([T.StructField(n, T.IntegerType()) for n in ("month", "day", "year")])
TIME = T.StructType([T.StructField(n, T.IntegerType()) for n in ("hrs", "mins", "secs")])
SPARK_TYPES: dict[str, T.DataType] = {"ipaddr": T.StringType(), "permissionbits": T.StringType(), "date": DATE, "time": TIME, "int": T.IntegerType(), "float": T.DoubleType(), "string": T.StringType()}
AVRO_TYPES = {"ipaddr": "string", "permissionbits": "string", "int": "int", "float": "double", "string": "string"}


@dataclass(frozen=True)
class Node:
    name: str = ""

    kind = ""

    @property
    def children(self) -> tuple[Node, ...]:
        return ()

    @property
    def has_data(self) -> bool:
        return any(c.has_data for c in self.children)

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children:
            yield from c.walk()

    def cost(self) -> float:
        """A description cost: the same for every node."""
        return sum(KIND_COST for _ in self.walk())


@dataclass(frozen=True)
class Base(Node):
    cls: str = "noop"
    param: str | None = None
    samples: tuple[str, ...] = ()

    kind = "base"

    @property
    def has_data(self) -> bool:
        return self.cls in DATA_CLASSES

    def doc(self) -> str:
        return "Example data: " + ", ".join(f"'{s}'" for s in self.samples) if self.samples else ""


@dataclass(frozen=True)
class Struct(Node):
    members: tuple[Node, ...] = ()

    kind = "record"

    @property
    def children(self) -> tuple[Node, ...]:
        return self.members


@dataclass(frozen=True)
class Array(Node):
    body: Node = field(default_factory=Base)

    kind = "array"

    @property
    def children(self) -> tuple[Node, ...]:
        return (self.body,)


@dataclass(frozen=True)
class Union(Node):
    branches: tuple[Node, ...] = ()

    kind = "union"

    @property
    def children(self) -> tuple[Node, ...]:
        return self.branches


def rebuilt(node: Node, children: tuple[Node, ...]) -> Node:
    if isinstance(node, Struct):
        return replace(node, members=children)
    if isinstance(node, Array):
        return replace(node, body=children[0])
    return replace(node, branches=children) if isinstance(node, Union) else node


def hoisted(node: Node) -> Node:
    """Unions right under unions become one, all the way down."""
    node = rebuilt(node, tuple(map(hoisted, node.children)))
    if isinstance(node, Union):
        flat: list[Node] = []
        for b in node.branches:
            flat += b.branches if isinstance(b, Union) else [b]
        return flat[0] if len(flat) == 1 else replace(node, branches=tuple(flat))
    return node


def named(node: Node) -> Node:
    """Names by kind and number in preorder, so that equal trees have equal names."""
    numbers: dict[str, int] = {}

    def visit(n: Node) -> Node:
        numbers[n.kind] = numbers.get(n.kind, 0) + 1
        n = replace(n, name=f"{n.kind}_{numbers[n.kind]}")
        return rebuilt(n, tuple(map(visit, n.children)))

    return visit(node)


def data_type(node: Node) -> T.DataType:
    """The Spark type of a node with data. A union is a struct with one field a branch, one of them not null."""
    if isinstance(node, Base):
        return SPARK_TYPES[node.cls]
    if isinstance(node, Array):
        return T.ArrayType(data_type(node.body))
    return T.StructType([spark_field(c) for c in node.children if c.has_data])


def spark_field(node: Node) -> T.StructField:
    doc = node.doc() if isinstance(node, Base) else ""
    return T.StructField(node.name, data_type(node), True, {"comment": doc} if doc else {})


def spark_schema(root: Node) -> T.StructType:
    """The schema of parsed lines; a root that isn't a record is its only field."""
    if not root.has_data:
        return T.StructType([])
    kind = data_type(root)
    return kind if isinstance(root, Struct) else T.StructType([spark_field(root)])


def avro_schema(node: Node) -> Any:
    if isinstance(node, Base):
        if node.cls in ("date", "time"):
            return {"type": "record", "name": node.name, "doc": node.doc(), "fields": [{"name": f.name, "type": "int"} for f in SPARK_TYPES[node.cls].fields]}
        return AVRO_TYPES[node.cls]
    if isinstance(node, Array):
        return {"type": "array", "items": avro_schema(node.body)}
    if isinstance(node, Union):
        out: list[Any] = []
        for s in (avro_schema(b) for b in node.branches if b.has_data):
            if s not in out:
                out.append(s)
        return out
    return {"type": "record", "name": node.name, "doc": "RECORD", "fields": [{"name": m.name, "type": avro_schema(m), **({"doc": m.doc()} if isinstance(m, Base) and m.doc() else {})} for m in node.children if m.has_data]}


def without_docs(schema: Any) -> Any:
    """An Avro schema without its docs, which hold examples."""
    if isinstance(schema, dict):
        return {k: without_docs(v) for k, v in schema.items() if k != "doc"}
    return [without_docs(x) for x in schema] if isinstance(schema, list) else schema


def to_dict(node: Node) -> dict[str, Any]:
    out: dict[str, Any] = {"kind": node.kind, "name": node.name}
    if isinstance(node, Base):
        return out | {"class": node.cls, "param": node.param, "samples": list(node.samples)}
    return out | {"children": [to_dict(c) for c in node.children]}


def to_json(root: Node) -> str:
    return json.dumps({"version": VERSION, "root": to_dict(root)}, ensure_ascii=False)


def from_dict(d: dict[str, Any]) -> Node:
    if d["kind"] == "base":
        return Base(d["name"], d["class"], d["param"], tuple(d["samples"]))
    children = tuple(map(from_dict, d["children"]))
    if d["kind"] == "array":
        return Array(d["name"], children[0])
    return {"record": Struct, "union": Union}[d["kind"]](d["name"], children)


def from_json(text: str) -> Node:
    d = json.loads(text)
    if d.get("version") != VERSION:
        raise ValueError(f"a type tree of version {d.get('version')}; {VERSION} is read here")
    return from_dict(d["root"])


def render(node: Node) -> str:
    """One line for a tree, for reports."""
    if isinstance(node, Base):
        return node.cls + (f"({node.param})" if node.param else "")
    left, right = {"record": "{}", "array": "[]", "union": "<>"}[node.kind]
    sep = " | " if isinstance(node, Union) else " "
    return left + sep.join(map(render, node.children)) + right

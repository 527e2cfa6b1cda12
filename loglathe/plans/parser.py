"""Guided parsing: a type tree compiled to regular expressions and built-in functions.

Every token is an atomic group, as a guided parse never takes a token back; unions are ordered
alternatives that backtrack, which tries the branches of all unions in the order of the tree. One
expression per root branch gives all its values in one match. The result is a projection without
state, so it runs on streams as well.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexer
from .types import Array, Base, Node, Struct, Union, data_type, spark_schema

#: Between the values of one match; lines that hold it take a slower way.
SEPARATOR = "\x01"

#: What a token class reads in a guided parse: no ranges and no groups.
PATTERNS = {
    "ipaddr": lexer.IPADDR,
    "permissionbits": lexer.PERMISSIONS,
    "date": lexer.date_pattern(),
    "time": f"{lexer.TIME_SECONDS}|{lexer.TIME_MINUTES}",
    "int": lexer.INT,
    "float": lexer.FLOAT,
    "string": lexer.STRING,
    "eol": r"\n",
    "ws": f"{lexer.SPACE}+",
    "noop": "",
}


def _literal(c: str) -> str:
    return re.sub(r"([^0-9A-Za-z_\s])", r"\\\1", c)


@dataclass
class _Pattern:
    """Text of an expression under construction; each data token, union branch and array gets a group."""

    groups: int = 0

    def group(self) -> int:
        self.groups += 1
        return self.groups


@dataclass(frozen=True)
class _Slot:
    """Where a node's value stands: group numbers of a base or array, or those of the parts."""

    node: Node
    group: int
    parts: tuple[_Slot, ...] = ()
    element: tuple[str, tuple[_Slot, ...], int] | None = None


def _compile(node: Node, p: _Pattern) -> tuple[str, _Slot]:
    if isinstance(node, Base):
        body = _literal(node.param) if node.cls == "char" and node.param else lexer.NOT_SPACE if node.cls == "char" else PATTERNS[node.cls]
        if node.has_data:
            g = p.group()
            return f"((?>{body}))", _Slot(node, g)
        return (f"(?>{body})" if body else ""), _Slot(node, 0)
    if isinstance(node, Struct):
        done = [_compile(m, p) for m in node.members]
        return "".join(x for x, _ in done), _Slot(node, 0, tuple(s for _, s in done))
    if isinstance(node, Union):
        done = []
        for b in node.branches:
            g = p.group()
            text, slot = _compile(b, p)
            done.append((f"({text})", _Slot(b, g, (slot,))))
        return "(?:" + "|".join(x for x, _ in done) + ")", _Slot(node, 0, tuple(s for _, s in done))
    # an array: one group for all its text, in which elements are found again; the last may be cut short
    g = p.group()
    inner = _Pattern()
    body, slot = _compile(node.body, inner)
    flat = re.sub(r"(?<!\\)\((?!\?)", "(?:", body)
    short = _partial(node.body)
    text = f"((?:{flat})*+{f'(?:{short})?' if short else ''})"
    return text, _Slot(node, g, (), (body, (slot,), inner.groups))


def _partial(body: Node) -> str:
    """What a group cut short at the end of the array reads: a beginning of its members."""
    if not isinstance(body, Struct) or len(body.members) < 2:
        return ""
    text = ""
    for m in reversed(body.members[:-1]):
        one = re.sub(r"(?<!\\)\((?!\?)", "(?:", _compile(m, _Pattern())[0])
        text = f"{one}(?:{text})?" if text else one
    return text


def _value(cls: str, text: Column) -> Column:
    if cls == "int":
        return text.try_cast("int")
    if cls == "float":
        return text.try_cast("double")
    if cls == "date":
        return lexer.date_value(text)
    if cls == "time":
        return lexer.time_value(text)
    return text


def _read(slot: _Slot, at) -> Column:
    """The value of a slot; at(group) is the text of a group."""
    node = slot.node
    kind = data_type(node)
    if isinstance(node, Base):
        text = at(slot.group)
        return F.when(text != "", _value(node.cls, text)).cast(kind)
    if isinstance(node, Struct):
        return F.struct(*(_read(s, at).alias(s.node.name) for s in slot.parts if s.node.has_data)).cast(kind)
    if isinstance(node, Union):
        fields, before = [], F.lit(False)
        for s in slot.parts:
            taken = at(s.group) != ""
            if s.node.has_data:
                fields.append(F.when(taken & ~before, _read(s.parts[0], at)).cast(data_type(s.node)).alias(s.node.name))
            before = before | taken
        return F.struct(*fields).cast(kind)
    body, (inner,), groups = slot.element
    short = _partial(node.body)
    found = F.regexp_extract_all(at(slot.group), F.lit(f"{re.sub(r'(?<!\\)\((?!\?)', '(?:', body)}{f'|{short}' if short else ''}"), F.lit(0))
    elements = F.filter(found, lambda x: x != "")

    def element(x: Column) -> Column:
        whole = x.rlike(rf"\A(?:{body})\z")
        value = _read(inner, lambda g: F.when(whole, F.regexp_extract(x, rf"\A(?:{body})\z", g)).otherwise(F.lit("")))
        if not short:
            return value
        return F.when(whole, value).otherwise(_short(node.body, x)).cast(kind.elementType)

    return F.transform(elements, element).cast(kind)


def _short(body: Struct, x: Column) -> Column:
    """An element cut short: its first members, the others null."""
    fields, text, p = [], "", _Pattern()
    for m in body.members:
        one, slot = _compile(m, p)
        text += one
        if m.has_data:
            ahead, groups = text, p.groups
            if m is body.members[-1]:
                fields.append(F.lit(None).cast(data_type(m)).alias(m.name))
            else:
                fields.append(_read(slot, lambda g, ahead=ahead: F.regexp_extract(x, rf"\A(?:{ahead})", g)).alias(m.name))
    return F.struct(*fields)


def _branches(root: Node) -> list[Node]:
    return list(root.branches) if isinstance(root, Union) else [root]


def line_pattern(node: Node) -> str:
    """The expression that a whole line of a node matches; only white space may follow."""
    return rf"\A{_compile(node, _Pattern())[0]}{lexer.SPACE}*\z"


def _parsed_by(node: Node, line: Column, parts: Column) -> Column:
    p = _Pattern()
    text, slot = _compile(node, p)
    pattern = rf"\A{text}{lexer.SPACE}*\z"

    def at(g: int) -> Column:
        return F.get(parts, F.lit(g))

    return _read(slot, at) if pattern else line


def parse_column(root: Node, line: Column) -> Column:
    """The parsed value of a line as a struct, null if the line isn't accepted."""
    return _project(root, _parts(root, line))


def _parts(root: Node, line: Column) -> Column:
    """array<string>: the number of the branch that matched, and the texts of its groups."""
    out = None
    for i, b in enumerate(_branches(root)):
        if not b.has_data:
            continue  # lines of literals only are not accepted
        p = _Pattern()
        text, _ = _compile(b, p)
        pattern = rf"\A{text}{lexer.SPACE}*\z"
        joined = SEPARATOR.join([str(i), *(f"${g}" for g in range(1, p.groups + 1))])
        fast = F.split(F.regexp_replace(line, F.lit(pattern), F.lit(joined)), SEPARATOR, -1)
        slow = F.array(F.lit(str(i)), *(F.regexp_extract(line, pattern, g) for g in range(1, p.groups + 1)))
        got = F.when(line.contains(SEPARATOR), slow).otherwise(fast)
        out = F.when(line.rlike(pattern), got) if out is None else out.when(line.rlike(pattern), got)
    return F.lit(None).cast("array<string>") if out is None else out


def _project(root: Node, parts: Column) -> Column:
    schema = spark_schema(root)
    if isinstance(root, Union):
        fields = [F.when(F.get(parts, F.lit(0)) == str(i), _parsed_by(b, parts, parts)).cast(data_type(b)).alias(b.name) for i, b in enumerate(root.branches) if b.has_data]
        value = F.struct(F.struct(*fields).alias(root.name)) if fields else F.struct(F.lit(0))
    else:
        value = _parsed_by(root, parts, parts)
        if not isinstance(root, Struct):
            value = F.struct(value.alias(root.name))
    return F.when(parts.isNotNull(), value.cast(schema) if len(schema) else value)


def with_parsed(df: DataFrame, root: Node, line: str, out: str = "parsed") -> DataFrame:
    """df with the parsed struct, null for rejected lines, and `<out>_branch`, the root branch (int)."""
    if not root.has_data:
        return df.withColumn(out, F.lit(None).cast(T.StructType([]))).withColumn(f"{out}_branch", F.lit(None).cast("int"))
    parts = f"__{out}_parts"
    df = df.withColumn(parts, _parts(root, F.col(line)))
    return df.withColumn(out, _project(root, F.col(parts))).withColumn(f"{out}_branch", F.get(F.col(parts), F.lit(0)).cast("int")).drop(parts)


def parse(df: DataFrame, root: Node, line: str, out: str = "parsed") -> tuple[DataFrame, DataFrame]:
    """(accepted rows with the parsed struct, rejected rows)."""
    all_rows = with_parsed(df, root, line, out)
    return all_rows.where(F.col(out).isNotNull()), all_rows.where(F.col(out).isNull()).drop(out, f"{out}_branch")

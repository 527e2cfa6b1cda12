r"""Chat formatting by schema fingerprints (native expressions only).

`fingerprint` turns a JSON record into the set of its nested field paths and hashes it; paths that no
mapping names, such as metadata, are left out, so they change no fingerprint. `MAPPINGS` maps
fingerprints to declarative mappings, each a way to cut canonical turns (role, text) from one layout.
`format_chat` renders turns in one template,

    <|im_start|>ROLE newline TEXT <|im_end|> newline

with the role percent-encoded, and the control strings inside texts escaped: each backslash is doubled
and a backslash follows the first character of every control string, so no text can end a turn or
start another, and `unescape` gives the text back. The loss mask is a list of (start, length) spans in
code points over the formatted string, one for each assistant text.

`struct_fingerprint` and `struct_turns` do the same for records in columns, each record by the fields that it
has, so one column holds records of many layouts; texts come from the columns and never pass a JSON parser.
A null there is a field that the record lacks; a record whose own fields are no layout has that of its schema.

Defined cases: null texts are empty, null roles are `user`, also where no turn has a role; turns of a layout
with an order go by it, those without a number last, ties by role and text; null records and those of an
unknown layout give null turns, the latter keep their fingerprint, by which they can be counted; empty lists of
turns give no turns, and no turns an empty string; equal rows are formatted each by itself; other columns
pass, those named as an added one are replaced; empty tables give empty results. JSON strings that Spark's parser
refuses (a text of over 20 million characters, a variant over its size limit) count as unknown.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name

#: Control strings of common chat templates, and this template's own.
CONTROL = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>")
START, END = "<|im_start|>", "<|im_end|>\n"
TURNS = "array<struct<role:string,text:string>>"

#: First character, rest; no control string starts inside the rest of another.
ESCAPE_PATTERN = "([<\\[])(\\|im_start\\|>|\\|im_end\\|>|s>|/s>|INST\\]|/INST\\]|<SYS>>|</SYS>>|\\|endoftext\\|>|\\|system\\|>|\\|user\\|>|\\|assistant\\|>)"


@dataclass(frozen=True)
class Mapping:
    """messages: path of an array of turns, with its role and text fields; or steps: (role, path) in order.

    order: field of a turn by which an array is sorted; renamed: whether `ROLES` holds.
    """

    name: str
    messages: str = ""
    role: str = "role"
    text: str = "content"
    steps: tuple[tuple[str, str], ...] = ()
    order: str = ""
    renamed: bool = True

    @property
    def layouts(self) -> tuple[tuple[str, ...], ...]:
        """The sets of field paths, sorted, that records of this layout have."""
        if self.messages:
            at = f"{self.messages}[]."
            return tuple(sorted({self.messages, at + self.role, at + self.text})), (self.messages, at + self.text), (self.messages, at + self.role), (self.messages,)
        return (tuple(sorted(path for _, path in self.steps)),)


#: Declarative mappings, the first that has a record's field paths counts.
MAPPINGS = (
    Mapping("messages", "messages"),
    Mapping("messages_text", "messages", text="text"),
    Mapping("conversations", "conversations", "from", "value"),
    Mapping("prompt_completion", steps=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt_response", steps=(("user", "prompt"), ("assistant", "response"))),
    Mapping("question_answer", steps=(("user", "question"), ("assistant", "answer"))),
    Mapping("instruction_output", steps=(("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction_input", steps=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("system_instruction", steps=(("system", "system"), ("user", "instruction"), ("assistant", "output"))),
    # the gathered rows of a table with a turn a row
    Mapping("table_rows", "table_rows", text="text", order="turn", renamed=False),
)
#: Role names of other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


def known_paths(mappings: tuple[Mapping, ...] = MAPPINGS) -> tuple[frozenset[str], dict[str, frozenset[str]]]:
    """The fields that any mapping names: of records, and of the elements of their arrays of turns."""
    top = {p for m in mappings for p in ([m.messages] if m.messages else [path for _, path in m.steps])}
    inner: dict[str, set[str]] = {}
    for m in mappings:
        if m.messages:
            inner.setdefault(m.messages, set()).update((m.role, m.text))
    return frozenset(top), {k: frozenset(v) for k, v in inner.items()}


def field_paths(json: Column, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """The sorted nested field paths of a JSON record that mappings name (array<string>); null for what is no record."""
    top, inner = known_paths(mappings)
    v = F.try_parse_json(json)
    keys = F.json_object_keys(json)
    paths = F.filter(keys, lambda k: k.isin(*sorted(top)))

    def of_turns(name: str) -> Column:
        shape = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
        found = F.regexp_extract_all(shape, F.lit("[<,] ?`?([A-Za-z_]+)`?: "), F.lit(1))
        known = F.transform(F.filter(found, lambda k: k.isin(*sorted(inner[name]))), lambda k: F.concat(F.lit(f"{name}[]."), k))
        return F.coalesce(known, F.array().cast("array<string>"))

    paths = F.concat(paths, *map(of_turns, sorted(inner)))
    return F.when(v.isNotNull(), F.array_sort(F.array_distinct(paths)))


def _hash(paths: Column) -> Column:
    return F.sha2(F.concat_ws(",", paths), 256)


def _digest(paths: Iterable[str]) -> str:
    """What `_hash` gives, of paths that are known before."""
    return hashlib.sha256(",".join(paths).encode()).hexdigest()


def mapping_of(mappings: tuple[Mapping, ...] = MAPPINGS) -> dict[str, Mapping]:
    """The mappings by the fingerprints of their layouts."""
    out: dict[str, Mapping] = {}
    for m in mappings:
        for paths in m.layouts:
            out.setdefault(_digest(paths), m)
    return out


def fingerprint(json: Column, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    return _hash(field_paths(json, mappings))


def _turn(role: Column, text: Column, renamed: bool = True) -> Column:
    known = [F.element_at(F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv)), role)] if renamed else []
    return F.struct(F.coalesce(*known, role, F.lit("user")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _apply(m: Mapping, get: Callable[[str, str], Column]) -> Column:
    """The turns by a mapping; get gives a field of the record by name and type."""
    if m.messages:
        found = get(m.messages, "array<struct<" + ",".join(f"`{n}`:string" for n in (m.role, m.text, m.order) if n) + ">>")
        if m.order:
            keyed = F.transform(found, lambda x: F.struct(x[m.order].try_cast("decimal(38,9)").alias("at"), _turn(x[m.role], x[m.text], m.renamed).alias("turn")))
            keyed = F.array_sort(F.transform(keyed, lambda x: F.struct(x["at"].isNull().alias("last"), x["at"].alias("at"), x["turn"].alias("turn"))))
            return F.transform(keyed, lambda x: x["turn"]).cast(TURNS)
        return F.transform(found, lambda x: _turn(x[m.role], x[m.text], m.renamed)).cast(TURNS)
    parts = F.array(*(_turn(F.lit(role), get(path, "string")) for role, path in m.steps))
    kept = F.filter(parts, lambda x: (x["role"] == "assistant") | (x["text"] != ""))
    # parts with one role in a row are one turn
    merged = F.aggregate(
        kept,
        F.array().cast(TURNS),
        lambda a, x: F.when(
            (F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["role"] == x["role"]),
            F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(x["role"].alias("role"), F.concat(F.try_element_at(a, F.lit(-1))["text"], F.lit("\n\n"), x["text"]).alias("text")).cast("struct<role:string,text:string>"))),
        ).otherwise(F.concat(a, F.array(x.cast("struct<role:string,text:string>")))),
    )
    return merged.cast(TURNS)


def _mapped(mark: Column, mappings: tuple[Mapping, ...], get: Callable[[str, str], Column], fields: frozenset[str] | None = None) -> Column:
    """The turns by the mapping that a fingerprint has, or null; fields: those that records can have at all."""
    out = F.lit(None).cast(TURNS)
    known = mapping_of(mappings)
    for m in mappings:
        marks = [k for k, v in known.items() if v is m]
        if marks and (fields is None or fields >= ({m.messages} if m.messages else {path for _, path in m.steps})):
            out = F.when(mark.isin(*marks), _apply(m, get)).otherwise(out)
    return out


def canonical_turns(json: Column, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """Canonical turns of a JSON record, or null for a layout that no mapping has."""
    v = F.try_parse_json(json)
    return _mapped(fingerprint(json, mappings), mappings, lambda name, kind: F.try_variant_get(v, f"$.{name}", kind))


def _fields(kind: T.DataType) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in kind.fields} if isinstance(kind, T.StructType) else {}


def _inner_fields(kind: T.DataType) -> tuple[str, ...]:
    return tuple(_fields(kind.elementType)) if isinstance(kind, T.ArrayType) else ()


def _type_paths(kind: T.DataType, mappings: tuple[Mapping, ...]) -> tuple[tuple[str, str], ...]:
    """The fields of a type that mappings name, each with that of its elements or an empty name, sorted as paths."""
    top, inner = known_paths(mappings)
    fields = {k: v for k, v in _fields(kind).items() if k in top}
    return tuple(sorted(((k, n) for k, v in fields.items() for n in ("", *(inner.get(k, frozenset()) & set(_inner_fields(v))))), key=_path))


def _path(field: tuple[str, str]) -> str:
    return f"{field[0]}[].{field[1]}" if field[1] else field[0]


def struct_paths(df: DataFrame, record: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """What `field_paths` gives, of each record in a column of structs by its values that aren't null."""
    at = F.col(f"`{record}`")

    def has(name: str, inside: str) -> Column:
        return F.exists(at[name], lambda x: x[inside].isNotNull()) if inside else at[name].isNotNull()

    paths = F.array(*(F.when(has(*p), F.lit(_path(p))) for p in _type_paths(df.schema[record].dataType, mappings)))
    return F.when(at.isNotNull(), F.array_compact(paths.cast("array<string>")))


def struct_fingerprint(df: DataFrame, record: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """The fingerprint of each record in a column of structs; null for null records."""
    own, known = _hash(struct_paths(df, record, mappings)), mapping_of(mappings)
    of_schema = _digest(map(_path, _type_paths(df.schema[record].dataType, mappings)))
    mark = F.when(own.isin(*known), own).otherwise(F.lit(of_schema)) if of_schema in known else own
    return F.when(F.col(f"`{record}`").isNotNull(), mark)


def struct_turns(df: DataFrame, record: str, mappings: tuple[Mapping, ...] = MAPPINGS, mark: Column | None = None) -> Column:
    """Canonical turns of a column of structs, each by its fingerprint, or null for a layout that no mapping has.

    mark: a column with what `struct_fingerprint` gave, so that it isn't computed again for each mapping.
    """
    at, kinds = F.col(f"`{record}`"), _fields(df.schema[record].dataType)

    def get(name: str, kind: str) -> Column:
        if not kind.startswith("array"):
            return at[name].cast(kind)
        has = _inner_fields(kinds[name])
        wanted = T.DataType.fromDDL(kind).elementType.names
        return F.transform(at[name], lambda x: F.struct(*((x[n].cast("string") if n in has else F.lit(None).cast("string")).alias(n) for n in wanted)))

    # lists of anything but structs hold no turns
    fields = frozenset(n for n in kinds if n not in known_paths(mappings)[1] or _inner_fields(kinds[n]))
    return _mapped(struct_fingerprint(df, record, mappings) if mark is None else mark, mappings, get, fields)


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), ESCAPE_PATTERN, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chat(df: DataFrame, turns: str = "turns", trained: str = "assistant") -> DataFrame:
    """Adds `formatted` and `loss_spans` to rows with canonical turns."""
    heads = F.transform(turns, lambda t: F.struct(F.concat(F.lit(START), F.url_encode(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == trained).alias("train")))
    parts = free_name(df, "parts")
    df = df.withColumn(parts, heads)
    df = df.withColumn("formatted", F.concat_ws("", F.transform(parts, lambda p: F.concat(p["head"], p["body"], F.lit(END)))))
    spans = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["head"]) + F.length(p["body"]) + len(END)).alias("at"),
            F.when(p["train"], F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length"))))).otherwise(a["spans"]).alias("spans"),
        ),
    )["spans"]
    return df.withColumn("loss_spans", spans).drop(parts)


def read_back(formatted: Column) -> Column:
    """The turns of a formatted string: the reverse of `format_chat`, in linear time."""
    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    return F.transform(
        pieces,
        lambda p: F.struct(
            F.url_decode(F.substring_index(F.substr(p, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
            unescape(F.substr(p, F.locate("\n", p) + 1)).alias("text"),
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.concat_ws("", F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))))

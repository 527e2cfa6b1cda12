"""The lexer: lines of text to arrays of tokens, as one regular expression over built-in functions.

The rules are tried in order at the current position and every position matches some rule, so the
lexemes of a line are the matches of the ordered alternation of the rules' patterns. One replacement of
all matches writes a mark before each lexeme and, as every class that its first character doesn't tell
has a group of its own, marks beside it that say which group matched; split at the first mark, that is
all tokens with their classes. A range of numbers gives three tokens. No Python runs on the executors;
`lex` is the same lexer for single lines on the driver.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token classes, their patterns and the order in which they are tried.
CLASSES = ("meta", "char", "ipaddr", "permissionbits", "date", "time", "int", "float", "string", "eol", "ws", "noop")
DATA_CLASSES = frozenset(("ipaddr", "permissionbits", "date", "time", "int", "float", "string"))
CLOSERS = {"[": "]", "{": "}", '"': '"', "'": "'", "<": ">", "(": ")"}
SPACE = r"[ \t\n\x0B\f\r]"
NOT_SPACE = r"[^ \t\n\x0B\f\r]"
IPADDR = r"(?:[0-9]+\.){3,}[0-9]+|\*\.(?:(?:[0-9]+|\*)\.)*(?:[0-9]+|\*)"
PERMISSIONS = r"[drwx-]{9,}"
MONTH_NAME = "January|Jan|jan|February|Feb|feb|March|Mar|mar|April|Apr|apr|May|may|June|Jun|jun|July|Jul|jul|August|Aug|aug|September|Sep|sep|October|Oct|oct|November|Nov|nov|December|Dec|dec"
MONTH_NUMBER = "[01]*[0-9]"
SEPARATORS = (SPACE + "+", r"\.", "/")
TIME_SECONDS, TIME_MINUTES = "[0-9][0-9]:[0-9][0-9]:[0-9][0-9]", "[0-9][0-9]:[0-9][0-9]"
INT, UNSIGNED = "[-+]?[0-9]+", "[0-9]+"
FLOAT, UNSIGNED_FLOAT = r"[+-]?[0-9]*\.[0-9]+", r"[0-9]*\.[0-9]+"
STRING = r"""[^ \t\n\x0B\f\r",;|\[\]{}<>()']{2,}"""
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
FIRST_YEAR = 1970

#: Days 1 to 31 as the day pattern reads them; a day that it would read beyond 31 fails. And years from 1970.
DAY = "(?:0[1-9]|[12][0-9]|3[01]|[4-9]|[1-3](?![0-9]))"
#: The same for engines without lookahead; it differs on a name of a month before 32 to 39 only.
DAY_PLAIN = "(?:0[1-9]|[12][0-9]|3[01]|[1-9])"
YEAR = "(?:19[7-9][0-9]|2[0-9]{3})"


def date_forms() -> list[tuple[str, ...]]:
    """All date forms in the order in which they are tried, as parts: month (M or m), day, year, separators."""
    month_first, year_first, day_first = [], [], []
    for s in SEPARATORS:
        for m in ("M", "m"):
            month_first.append((m, s, "D", s, "Y"))
            year_first.append(("Y", s, m, s, "D"))
            day_first.append(("D", s, m, s, "Y"))
    for s in SEPARATORS:
        month_first.append(("M", s, "D"))
        day_first.append(("D", s, "M"))
    return month_first + year_first + day_first


def date_pattern(day: str = DAY) -> str:
    parts = {"M": f"(?:{MONTH_NAME})", "m": MONTH_NUMBER, "D": day, "Y": YEAR}
    return "|".join("".join(parts.get(p, p) for p in form) for form in date_forms())


def meta_pattern() -> str:
    return "|".join(rf"\{a}[^\{b}]*\{b}" if a not in "\"'<" else f"{a}[^{b}]*{b}" for a, b in CLOSERS.items())


def rules(day: str = DAY) -> list[tuple[str, str]]:
    """(class, pattern) in order of priority; ranges are classes of their own until they are split."""
    return [
        ("meta", meta_pattern()),
        ("ipaddr", IPADDR),
        ("permissionbits", PERMISSIONS),
        ("date", date_pattern(day)),
        ("time", f"{TIME_SECONDS}|{TIME_MINUTES}"),
        ("floatrange", f"{UNSIGNED_FLOAT}-{UNSIGNED_FLOAT}"),
        ("intrange", f"{UNSIGNED}-{UNSIGNED}"),
        ("float", FLOAT),
        ("int", INT),
        ("string", STRING),
        ("char", NOT_SPACE),
        ("eol", r"\n"),
        ("ws", f"{SPACE}+"),
    ]


#: What the first form of a date or any other can start with; elsewhere none of them is tried.
DATE_START = "(?=[0-9JFMASONDjfmasond])(?=[0-9]|(?:[Jj]an|[Ff]eb|[Mm]a[ry]|[Aa]pr|[Jj]u[nl]|[Aa]ug|[Ss]ep|[Oo]ct|[Nn]ov|[Dd]ec))"


def alternation(day: str = DAY, group: Callable[[str], str] = lambda name: "(?:") -> str:
    """The rules in order; group says how a rule's group opens."""
    return "|".join(f"{DATE_START if name == 'date' and day == DAY else ''}{group(name)}{p})" for name, p in rules(day))


LEXEME = alternation()
#: Classes with a group of their own; of the others the first character and the length tell the class.
MARKED = ("ipaddr", "permissionbits", "date", "time", "floatrange", "intrange", "float", "int")
#: A mark before each lexeme, and one before each group but that of the other classes.
START_MARK, GROUP_MARK = "\x01", "\x02"
#: Characters that a class can start with, so that most lexemes pass its rules at one glance.
STARTS = {"ipaddr": "(?=[0-9*])", "date": DATE_START} | {x: "(?=[0-9.+-])" for x in ("time", "floatrange", "intrange", "float", "int")}
OTHERS = "|".join(f"(?:{p})" for _, p in rules()[9:])
MARKING = "|".join([f"({meta_pattern()})", *(f"{STARTS.get(name, '')}({p})" for name, p in rules()[1:9]), f"({OTHERS})"])
#: A lexeme with a group of its own stands among marks, one at its end at least; the others come after all of them.
REPLACEMENT = START_MARK + "".join(f"${i + 2}{GROUP_MARK}" for i in range(len(MARKED))) + "$1$10"
#: Lines with a range of numbers have this somewhere.
RANGE_HINT = r"[0-9]-[.0-9]"


def lexemes(line: Column) -> Column:
    """The lexemes of a line (array<string>), ranges in one piece; null for null."""
    return F.regexp_extract_all(line, F.lit(LEXEME), F.lit(0))


def _pieces(line: Column) -> Column:
    """The lexemes of a line that isn't empty and has no marks of its own, marked if they have a group."""
    marked = F.regexp_replace(line, F.lit(MARKING), F.lit(REPLACEMENT))
    marked = F.replace(marked, F.lit(START_MARK + GROUP_MARK * len(MARKED)), F.lit(START_MARK))
    return F.split(F.substr(marked, F.lit(2)), START_MARK, -1)


_LINE_ENDS = [ord(c) for c in "\t\x0b\f\r"]


def _by_start(x: Column) -> Column:
    """The class of a lexeme that has no group of its own."""
    first, one = F.ascii(x), F.octet_length(x) == 1
    out = F.when(first == ord(" "), "ws").when(one, F.when(first == ord("\n"), "eol").when(first.isin(_LINE_ENDS), "ws").otherwise("char"))
    return out.when(first.isin([ord(c) for c in CLOSERS]), "meta").when(first.isin(_LINE_ENDS), "ws").when((first > 127) & (F.length(x) == 1), "char").otherwise("string")


def _by_marks(piece: Column) -> Column:
    """The class of a lexeme among marks: how many are before it."""
    return F.element_at(F.array(*map(F.lit, MARKED)), F.length(piece) - F.length(F.ltrim(piece, F.lit(GROUP_MARK))) + 1)


def _among_marks(piece: Column) -> Column:
    return piece.endswith(GROUP_MARK)


def _piece_class(piece: Column) -> Column:
    return F.when(_among_marks(piece), _by_marks(piece)).otherwise(_by_start(piece))


def _piece_text(piece: Column) -> Column:
    return F.when(_among_marks(piece), F.replace(piece, F.lit(GROUP_MARK), F.lit(""))).otherwise(piece)


def _class(x: Column) -> Column:
    """The class of one lexeme, ranges as such."""
    first, size = F.substring(x, 1, 1), F.length(x)
    out = F.when((size > 1) & first.isin(*CLOSERS), "meta")
    out = out.when((size == 1) & first.rlike(f"{NOT_SPACE}") & ~first.rlike("[0-9]"), "char")
    # words are most lexemes: what starts with none of these is a string, or else white space
    out = out.when(~first.rlike(r"[0-9*.+\-drwxJFMASONDjfmasond \t\n\x0B\f\r]"), "string")
    out = out.when(x == "\n", "eol").when(first.rlike(SPACE), "ws")
    for name, p in rules():
        if name in ("ipaddr", "permissionbits", "date", "time", "floatrange", "intrange", "float", "int"):
            out = out.when(x.rlike(rf"\A(?:{p})\z"), name)
    return out.otherwise("string")


def _token(cls: Column, param: Column, text: Column) -> Column:
    return F.struct(cls.cast("string").alias("cls"), param.cast("string").alias("param"), text.cast("string").alias("text"))


def _expand(t: Column) -> Column:
    """The tokens of one lexeme with its class."""
    cls, x = t["cls"], t["text"]
    at = F.regexp_replace(x, "(?<=[0-9])-.*", "")
    kind = F.when(cls == "floatrange", "float").otherwise("int")
    parts = F.array(_token(kind, F.lit(None), at), _token(F.lit("char"), F.lit("-"), F.lit("-")), _token(kind, F.lit(None), F.substr(x, F.length(at) + 2)))
    return F.when(cls.isin("floatrange", "intrange"), parts).otherwise(F.array(_token(cls, F.when(cls == "char", x), x)))


def _plain(piece: Column) -> Column:
    """The token of a piece that is no range."""
    cls = _piece_class(piece)
    return _token(cls, F.when(cls == "char", piece), _piece_text(piece))


def _ways(line: Column, slow: Callable[[Column], Column], ranges: Callable[[Column], Column], plain: Callable[[Column], Column]) -> Column:
    """What one of three makes of a line: slow of lines that hold a mark, where the class of each lexeme is found from
    the lexeme, ranges of those that may hold a range, plain of the others."""
    own_marks = line.contains(START_MARK) | line.contains(GROUP_MARK)
    return F.when(own_marks | (line == ""), slow(lexemes(line))).when(line.rlike(RANGE_HINT), ranges(_pieces(line))).otherwise(plain(_pieces(line)))


def _expanded(lexemes: Column, cls: Callable[[Column], Column], text: Callable[[Column], Column]) -> Column:
    return F.flatten(F.transform(F.transform(lexemes, lambda x: F.struct(cls(x).alias("cls"), text(x).alias("text"))), _expand))


def tokenize(line: Column) -> Column:
    """array<struct<cls,param,text>> of a line. param is the character of a char token, else null."""
    return _ways(line, lambda x: _expanded(x, _class, lambda y: y), lambda x: _expanded(x, _piece_class, _piece_text), lambda x: F.transform(x, _plain))


def classes(line: Column) -> Column:
    """The classes of a line's tokens (array<string>)."""

    def of(tokens: Column) -> Column:
        return F.transform(tokens, lambda t: t["cls"])

    return _ways(line, lambda x: of(_expanded(x, _class, lambda y: y)), lambda x: of(_expanded(x, _piece_class, _piece_text)), lambda x: F.transform(x, _piece_class))


def token_id(token: Column, meta_by_delimiter: bool = False) -> Column:
    """The id that tokens are grouped by: class name and parameter."""
    param = F.coalesce(token["param"], F.lit(""))
    if meta_by_delimiter:
        param = F.when(token["cls"] == "meta", F.substring(token["text"], 1, 1)).otherwise(param)
    return F.concat(token["cls"], param)


def token_ids(line: Column, meta_by_delimiter: bool = False) -> Column:
    def of(tokens: Column) -> Column:
        return F.transform(tokens, lambda t: token_id(t, meta_by_delimiter))

    def plain(piece: Column) -> Column:
        cls = _piece_class(piece)
        param = F.when(cls == "char", piece)
        if meta_by_delimiter:
            param = param.when(cls == "meta", F.substring(piece, 1, 1))
        return F.concat(cls, F.coalesce(param, F.lit("")))

    return _ways(line, lambda x: of(_expanded(x, _class, lambda y: y)), lambda x: of(_expanded(x, _piece_class, _piece_text)), lambda x: F.transform(x, plain))


def has_data(cls: Column) -> Column:
    return cls.isin(*sorted(DATA_CLASSES))


def inner_text(meta: Column) -> Column:
    """The text between the delimiters of a meta token's text."""
    return F.substr(meta, F.lit(2), F.greatest(F.length(meta) - 2, F.lit(0)))


def month_number(month: Column) -> Column:
    """1 to 12 for names and numbers as written; -1 for what is neither. Numbers aren't range-checked."""
    names = F.create_map(*(F.lit(x) for i, m in enumerate(MONTHS) for x in (m, i + 1)))
    return F.coalesce(month.try_cast("int"), F.try_element_at(names, F.lower(F.substring(month, 1, 3))), F.lit(-1))


def date_value(text: Column) -> Column:
    """struct<month,day,year> of a date token's text; year -1 if there is none."""
    parts = F.split(text, rf"{SPACE}+|\.|/")
    p = [F.try_element_at(parts, F.lit(i)) for i in (1, 2, 3)]
    named = [x.rlike("[A-Za-z]") for x in p]
    year_first = p[0].rlike(r"\A[0-9]{4}\z") & p[2].isNotNull() & ~p[2].rlike(r"\A[0-9]{4}\z")
    month_first = named[0] | (~named[1] & p[2].isNotNull() & _valid_day(p[1]) & _is_month(p[0]))
    month = F.when(year_first, p[1]).when(month_first, p[0]).otherwise(p[1])
    day = F.when(year_first, p[2]).when(month_first, p[1]).otherwise(p[0])
    year = F.when(year_first, p[0]).otherwise(F.coalesce(p[2], F.lit("-1")))
    return F.struct(month_number(month).alias("month"), day.try_cast("int").alias("day"), year.try_cast("int").alias("year"))


def _valid_day(x: Column) -> Column:
    return x.rlike(rf"\A(?:{DAY_PLAIN})\z")


def _is_month(x: Column) -> Column:
    return x.rlike(rf"\A{MONTH_NUMBER}\z")


def time_value(text: Column) -> Column:
    """struct<hrs,mins,secs>; secs 0 if there are none."""
    parts = F.split(text, ":")
    return F.struct(F.try_element_at(parts, F.lit(1)).try_cast("int").alias("hrs"), F.try_element_at(parts, F.lit(2)).try_cast("int").alias("mins"), F.coalesce(F.try_element_at(parts, F.lit(3)).try_cast("int"), F.lit(0)).alias("secs"))


# ---- the same lexer on the driver, for single lines


@dataclass(frozen=True)
class Token:
    cls: str
    param: str | None
    text: str

    @property
    def id(self) -> str:
        return self.cls + (self.param or "")

    @property
    def inner(self) -> str:
        return self.text[1:-1]


_LEXEME = re.compile(alternation(group=lambda name: f"(?P<{name}>"))
_RANGE = re.compile("(?<=[0-9])-")


def lex(line: str) -> list[Token]:
    out: list[Token] = []
    for m in _LEXEME.finditer(line):
        x, cls = m.group(), m.lastgroup
        if cls in ("floatrange", "intrange"):
            a, b = _RANGE.split(x, maxsplit=1)
            kind = cls.removesuffix("range")
            out += [Token(kind, None, a), Token("char", "-", "-"), Token(kind, None, b)]
        else:
            out.append(Token(cls, x if cls == "char" else None, x))
    return out


def decode_date(text: str) -> tuple[int, int, int]:
    """(month, day, year) of a date token's text on the driver."""
    for form in date_forms():
        p = {"M": f"({MONTH_NAME})", "m": f"({MONTH_NUMBER})", "D": f"({DAY})", "Y": f"({YEAR})"}
        m = re.fullmatch("".join(p.get(x, x) for x in form), text)
        if m:
            got = dict(zip([x.lower() for x in form if x in p], m.groups(), strict=True))
            month = got["m"]
            number = int(month) if month.isdigit() else MONTHS.index(month[:3].lower()) + 1
            return number, int(got["d"]), int(got.get("y", -1))
    raise ValueError(text)


def decode_time(text: str) -> tuple[int, int, int]:
    h, m, *s = text.split(":")
    return int(h), int(m), int(s[0]) if s else 0


def sample(token: Token) -> str:
    """How a token shows in a field's examples."""
    if token.cls == "date":
        m, d, y = decode_date(token.text)
        return f"{m}/{d}/{y}"
    if token.cls == "time":
        return "{}:{}:{}".format(*decode_time(token.text))
    return token.text

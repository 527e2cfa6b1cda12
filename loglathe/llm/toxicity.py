"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding lower-cases, maps homoglyphs of other scripts and digit or symbol substitutions to letters
(1, l, | and i are one letter) and everything else to spaces; texts with diacritics are matched with
them and, once more, without. Entries are whole words or beginnings of words. `learn` takes them from labelled rows: log odds of the folded
words and word beginnings in toxic and other rows, near copies of one text counted once; fixed common
insults join them. A hit inside an exception phrase doesn't count. The score is a logistic function of
the weighted hits, normalised by the square root of the text's length.

Defined cases: null and empty texts score as texts without hits; without labels only the fixed entries
hold, with fixed coefficients; texts are scored whole at any length. A document that is labelled more
than once is toxic if any label says so; rows that share an id are rows of their own with its label.
Empty tables give empty results; columns named as an added one are replaced, others pass.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, claim, ensure_checkpoint_dir

#: Labelled rows that the lexicon and the two coefficients are fitted on, at most; chosen by a hash.
MAX_TRAIN = 12_000
#: Beginnings of words, in letters.
PREFIXES = (3, 4, 5, 6, 7, 8, 9)
#: An entry needs so many toxic families of rows, such a share of all toxic ones, and so high a z-score
#: of its log odds.
MIN_SUPPORT, SUPPORT_SHARE, MIN_Z = 5, 0.01, 3.5
#: And so high a share of toxic families among all that have it.
MIN_SHARE = 0.5

#: Common insults (folded when used) and phrases in which such words are harmless.
INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "imbecile", "dumbass", "asshole", "bastard", "bitch", "scumbag", "retard", "degenerate", "vermin", "filthy")
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash bag", "trash bags", "trash collection", "class clown", "clown fish", "clown car", "pond scum", "soap scum", "stupid mistake", "filthy rich", "vermin control")
#: Letters of other scripts that look like Latin ones, and substitutions.
HOMOGLYPHS = dict(
    zip(
        "абвгдеёзикмнорстухіїјѕԁһӏӀ" + "αβγεηικνορτυχω" + "ıłøđħŧƒ" + "0134578@$€|l",
        "abbrdeezukmhopctyxiijsdhii" + "abyenikvoptuxw" + "iiodhtf" + "oieastbasei" + "i",
        strict=True,
    )
)


def _letters(c: str) -> str:
    """The folded letters of a character, diacritics kept, or a space."""
    x = unicodedata.normalize("NFKC", c).lower()
    for _ in range(2):  # what a homoglyph gives may be an l
        x = "".join(HOMOGLYPHS.get(y, y) for y in x)
    return x if x and all(y.isalpha() or unicodedata.combining(y) for y in x) else " "


def _bare(c: str) -> str:
    """One letter without its diacritics."""
    base = unicodedata.normalize("NFKD", c)[0]
    return HOMOGLYPHS.get(base, base)


class _Table(dict):
    """A translation table that fills itself."""

    def __init__(self, make, **fixed: str):
        self.make = make

    def __missing__(self, c: int) -> str:
        self[c] = v = self.make(chr(c))
        return v


@lru_cache(maxsize=1)
def _tables() -> tuple[_Table, _Table]:
    fold, bare = _Table(_letters), _Table(_bare)
    for c in (0xAD, 0x200B, 0x200C, 0x200D, 0xFEFF):
        fold[c] = ""  # invisible
    return fold, bare


def fold(text: str) -> str:
    """The folded text, each word with one space at least on both sides; diacritics kept."""
    return f" {text.translate(_tables()[0])} "


def without_diacritics(folded: str) -> str:
    """Letter for letter, so that places stay the same."""
    return folded if folded.isascii() else folded.translate(_tables()[1])


@dataclass(frozen=True)
class Lexicon:
    """entries: folded patterns, ' word ' or ' beginning', with weights; a score is a + b * x."""

    entries: dict[str, float]
    exceptions: tuple[str, ...] = ()
    a: float = -3.0
    b: float = 6.0
    report: dict[str, float] = field(default_factory=dict)


def default_entries(weight: float = 3.0) -> dict[str, float]:
    return {f" {fold(w).strip()} ": weight for w in INSULTS}


class Matcher:
    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        for p, w in lexicon.entries.items():
            self.automaton.add_word(p, (len(p), w))
        for p in lexicon.exceptions:
            p = f" {' '.join(fold(p).split())} "
            self.automaton.add_word(p, (len(p), None))
        if len(self.automaton):
            self.automaton.make_automaton()

    def x(self, text: str) -> float:
        """Weighted hits by the root of the length in hundreds of words; each word counts once, by its best entry."""
        t = fold(text)
        if not len(self.automaton):
            return 0.0
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for u in (t,) if t.isascii() else (t, without_diacritics(t)):
            for end, (n, w) in self.automaton.iter(u):
                start = end + 1 - n
                if w is None:
                    spared.append((start, end))
                elif w > best.get(start, 0.0):
                    best[start] = w
        if spared:
            best = {s: w for s, w in best.items() if not any(a <= s < b for a, b in spared)}
        return sum(best.values()) / math.sqrt(1 + len(t) / 600) if best else 0.0

    def score(self, text: str) -> float:
        z = self.lexicon.a + self.lexicon.b * math.log1p(self.x(text))
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def _features(text: str) -> tuple[set[str], int]:
    """Patterns that a text holds, and a hash that near copies of it mostly share."""
    words = fold(text).split()
    out: set[str] = set()
    distinct = set(words)
    for w in distinct | {without_diacritics(w) for w in distinct}:
        out.add(f" {w} ")
        out.update([f" {w[:n]}" for n in PREFIXES if len(w) >= n])
    import xxhash

    family = min((xxhash.xxh3_64_intdigest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))), default=0)
    return out, family & (2**62 - 1)


def _fit(xs: Sequence[float], ys: Sequence[int], ridge: float = 1.0) -> tuple[float, float]:
    """Ridge logistic regression of y on log1p(x) by Newton steps."""
    a, b = -2.0, 1.0
    pts = [(math.log1p(x), y) for x, y in zip(xs, ys, strict=True)]
    for _ in range(50):
        ga = gb = haa = hab = hbb = 0.0
        for x, y in pts:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x))))
            r, v = y - p, p * (1 - p)
            ga, gb, haa, hab, hbb = ga + r, gb + r * x, haa + v, hab + v * x, hbb + v * x * x
        ga, gb, haa, hbb = ga - 1e-3 * a, gb - ridge * 1e-2 * b, haa + 1e-3, hbb + ridge * 1e-2
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 5 / max(abs(da), abs(db), 1e-9))
        a, b = a + step * da, b + step * db
        if abs(da) + abs(db) < 1e-6:
            break
    return a, b


def closed(found: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Entries with their weights, of (weight, toxic rows): of a beginning that nearly always goes on in
    one way only the longest form stays, so that ' tra' isn't one for ' trash '; then longer entries that
    say no more than a shorter one go."""
    wider = dict(found)
    for f in found:
        for n in range(2, len(f)):
            if f[:n] in wider and found[f][1] >= 0.9 * found[f[:n]][1]:
                del wider[f[:n]]
    return {f: w for f, (w, _) in wider.items() if not any(f[:n] in wider and wider[f[:n]][0] >= w - 0.7 for n in range(2, len(f)))}


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_train: int = MAX_TRAIN) -> Lexicon:
    """The lexicon of at most max_train labelled rows, those with the least hashes of the key.

    labels: (key, label) with label 0 or 1; null labels take no part, and of several of one key the largest counts.
    """
    picked = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null").groupBy("k").agg(F.max("y").alias("y"))
    picked = picked.orderBy(F.xxhash64("k"), "k", "y").limit(max_train)
    train = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(picked), "k").select("t", "y")  # at most max_train rows

    def families(rows: DataFrame, only: frozenset[str] | None) -> DataFrame:
        """(f, n): families of rows that hold a pattern, of those in `only`; '' stands for all rows."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            claim("toxicity")
            for batch in batches:
                out: list[tuple[str, int]] = []
                for t in batch["t"]:
                    found, family = _features(t or "")
                    out += [(f, family) for f in (found if only is None else found & only)]
                    out.append(("", family))  # the row itself
                    if len(out) > 200_000:
                        yield pd.DataFrame(out, columns=["f", "family"])
                        out = []
                yield pd.DataFrame(out, columns=["f", "family"])

        return rows.mapInPandas(run, "f string, family long").distinct().groupBy("f").agg(F.count(F.lit(1)).alias("n"))

    ensure_checkpoint_dir(docs.sparkSession)
    bad = families(train.where("y = 1").select("t"), None).where((F.col("n") >= MIN_SUPPORT) | (F.col("f") == "")).checkpoint()
    n_bad = next((r["n"] for r in bad.where("f = ''").collect()), 0)
    # what so many of at most max_train rows hold is bounded by what one of them holds, some hundreds of times
    candidates = {r["f"]: r["n"] for r in bad.where((F.col("f") != "") & (F.col("n") >= max(MIN_SUPPORT, SUPPORT_SHARE * n_bad))).collect()}
    good = {r["f"]: r["n"] for r in families(train.where("y = 0").select("t"), frozenset(candidates)).collect()}  # no more than the candidates
    n_good = good.get("", 0)
    if not n_bad or not n_good:
        return Lexicon(default_entries(), EXCEPTIONS)
    found: list[tuple[float, str, float, int]] = []
    for f, x in candidates.items():
        y = good.get(f, 0)
        w = math.log((x + 0.5) / (n_bad + 1)) - math.log((y + 0.5) / (n_good + 1))
        z = w / math.sqrt(1 / (x + 0.5) + 1 / (y + 0.5))
        if z >= MIN_Z and x >= MIN_SHARE * (x + y):
            found.append((-z, f, w, x))
    entries = closed({f: (w, x) for _, f, w, x in sorted(found)})
    entries = default_entries(max(entries.values(), default=3.0)) | entries
    fixed = Lexicon(entries, EXCEPTIONS)

    def xs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Matcher(fixed)
        for batch in batches:
            yield pd.DataFrame({"x": [m.x(t or "") for t in batch["t"]], "y": batch["y"]})

    points = train.mapInPandas(xs, "x double, y int").collect()
    a, b = _fit([p["x"] for p in points], [p["y"] for p in points])
    return Lexicon(entries, EXCEPTIONS, a, b, {"bad": n_bad, "good": n_good, "entries": len(entries)})


def score(text: Column, lexicon: Lexicon) -> Column:
    """The score (double) of each whole text."""

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        claim("toxicity")
        m = Matcher(lexicon)
        for texts in batches:
            yield pd.Series([m.score(t or "") for t in texts], dtype="float64")

    return run(text)


def held_out(key: Column, folds: int = 5) -> Column:
    """Whether a row is kept from learning: crc32 of the key's text modulo `folds` is 0."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(folds)) == 0, F.lit(False))


#: Columns that `scored` adds.
ADDED = ("held_out", "score", "predicted")


def scored(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """docs with held_out, score and predicted, learned from the labelled rows that aren't held out."""
    bound_batches(docs.sparkSession)
    lexicon = learn(docs, labels.where(~held_out(F.col(key))), key, text, label)
    out = docs.withColumn("held_out", held_out(F.col(key))).withColumn("score", score(F.col(text), lexicon))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def entries_of(lexicon: Lexicon) -> Iterable[tuple[str, float]]:
    return sorted(lexicon.entries.items(), key=lambda kv: -kv[1])

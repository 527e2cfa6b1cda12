"""Line dedup over a whole corpus by a deletion-neighbourhood join; of close lines the earliest stays.

Lines are sequences of words between ASCII white space. Two lines are close if they are equal or, with
`EDIT_WORDS` words or more each, one word apart: one inserted, deleted or replaced. A line goes if any
line before it is close to it; blank lines stay. Lines are ordered by their row's id, rows that share an
id by a hash of their texts, and by line number. The line that is named as kept is the earliest close
one; it may go itself for one that is close to it only, so a chain of close lines leaves its first.

Equal lines meet by 128-bit hashes. For the others every line has its variants, the line without each
one of its words, as hashed keys: lines one replacement apart share a variant at the same place, and a
line with one word more has the other line as a variant. Only lines that can have a close one send
variants: of two close lines of `FILTER_WORDS` words or more, the first six or the last six words
agree, so other lines without such a partner are spared. Where variants meet, each line is held
against the earliest of its group only, so no group's pairs are listed, and the edit distance of every
link is verified on the words before the earliest is taken.

A row is its id and the hash of its text (`x` below). Keys have 95 bits and lines are told apart by 64
more, so no collision hides a link.

Defined cases: rows with a null id or text pass unchanged; rows that agree in id and text are one row
and share its fate, rows that share an id only are told apart; texts are read whole at any length;
empty tables give empty results; columns of other names pass unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_ROWS, arrow_rows, claim, ensure_checkpoint_dir, free_name, join_groups, small_or_shuffled

#: Lines of so many words may differ by one; so many may be filtered by their ends; words of an end.
EDIT_WORDS, FILTER_WORDS, END = 8, 13, 6
#: Lines that a task remembers to have sent variants of.
REMEMBERED = 200_000


def within_one(a: list[bytes], b: list[bytes]) -> bool:
    """Whether one edit of words at most makes b of a."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def variants(words: list[bytes], seed: int = 0) -> list[int]:
    """128-bit hashes of the line without its word i, for each i."""
    import xxhash

    line = b" ".join(words)
    out, at, view = [], 0, memoryview(line)
    for i, w in enumerate(words):
        x = xxhash.xxh3_128(view[:at] if i < len(words) - 1 else view[: max(0, at - 1)], seed=seed)
        x.update(view[at + len(w) + 1 :])
        out.append(x.intdigest())
        at += len(w) + 1
    return out


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc, x, line, h, g, pre, suf) of every line with words of (doc, x, t) rows; pre and suf are hashes of
    the ends of longer lines, else null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        claim("line_dedup")
        for batch in batches:
            doc, x_, line, full, ends = [], [], [], [], []
            for d, row, t in zip(batch["doc"], batch["x"], batch["t"], strict=True):
                for i, x in enumerate(t.encode().split(b"\n")):
                    words = x.split()
                    if words:
                        doc.append(d)
                        x_.append(row)
                        line.append(i)
                        full.append(xxhash.xxh3_128_digest(b" ".join(words)))
                        if len(words) >= FILTER_WORDS:
                            ends.append(xxhash.xxh3_64_digest(b" ".join(words[:END]), seed=1) + xxhash.xxh3_64_digest(b" ".join(words[-END:]), seed=2))
                        else:
                            ends.append(bytes(16))
            h = np.frombuffer(b"".join(full), np.int64).reshape(-1, 2)
            e = np.frombuffer(b"".join(ends), np.int64).reshape(-1, 2)
            yield pd.DataFrame({"doc": np.array(doc, np.int64), "x": np.array(x_, np.int64), "line": np.array(line, np.int32), "h": h[:, 0], "g": h[:, 1], "pre": e[:, 0], "suf": e[:, 1]})

    return docs.mapInPandas(run, "doc long, x long, line int, h long, g long, pre long, suf long")


def _with_lines(docs: DataFrame, wanted: DataFrame, how: str) -> DataFrame:
    """docs (doc, x, t) with the array `lines` of the wanted (doc, x, line)."""
    lists = wanted.groupBy("doc", "x").agg(F.sort_array(F.collect_set("line")).alias("lines"))
    return docs.join(small_or_shuffled(lists), ["doc", "x"], how)


def _variant_rows(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(k, i, h, doc, x, line): keys of the variants and of the lines; i has more bits of the key above 32 bits
    for the place of the word that is left out, from 1, or 0 for the line itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        claim("line_dedup")
        # by id within a batch, so that of equal lines hardly any but the earliest, which links need, is sent
        seen: dict[bytes, tuple[int, int, int]] = {}
        for batch in batches:
            k, i_, h, counts, doc, x_, line = [], [], [], [], [], [], []
            for d, row, t, wanted in sorted(zip(batch["doc"], batch["x"], batch["t"], batch["lines"], strict=True), key=lambda r: r[:2]):
                wanted = set() if wanted is None else set(wanted)
                for i, text in enumerate(t.encode().split(b"\n")):
                    words = text.split()
                    if len(words) < EDIT_WORDS or (i not in wanted and len(words) > FILTER_WORDS + 1):
                        continue
                    whole = b" ".join(words)
                    digest = xxhash.xxh3_128(whole)
                    me = digest.digest()
                    if i not in wanted:
                        if me in seen and seen[me] <= (d, row, i):
                            continue
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen[me] = d, row, i
                    keys = [digest.intdigest(), *variants(words)]
                    k += [y & _LOW for y in keys]
                    i_ += [y >> 97 << 32 | n for n, y in enumerate(keys)]
                    h.append(xxhash.xxh3_64_intdigest(whole, seed=1))
                    counts.append(len(keys))
                    doc.append(d)
                    x_.append(row)
                    line.append(i)
                if len(k) > 300_000:
                    yield _frame(k, i_, h, counts, doc, x_, line)
                    k, i_, h, counts, doc, x_, line = [], [], [], [], [], [], []
            yield _frame(k, i_, h, counts, doc, x_, line)

    return _with_lines(docs, candidates, "left").select("doc", "x", "t", "lines").mapInPandas(run, "k long, i long, h long, doc long, x long, line int")


_LOW = 2**64 - 1


def _frame(k: list[int], i: list[int], h: list[int], counts: list[int], doc: list[int], x: list[int], line: list[int]) -> pd.DataFrame:
    """h, doc, x and line are of a line, for so many keys as counts says."""
    n = np.array(counts, np.int64)
    return pd.DataFrame(
        {
            "k": np.array(k, np.uint64).view(np.int64),
            "i": np.array(i, np.int64),
            "h": np.repeat(np.array(h, np.uint64).view(np.int64), n),
            "doc": np.repeat(np.array(doc, np.int64), n),
            "x": np.repeat(np.array(x, np.int64), n),
            "line": np.repeat(np.array(line, np.int32), n),
        }
    )


Place = tuple[int, int, int]


class _Links:
    """The links of one key, from its rows in order of (place of the word, line's place), whole lines first.

    Holds one line for each place of a word and each whole line, whatever the number of rows.
    """

    def __init__(self) -> None:
        self.first: dict[int, tuple[Place, int]] = {}
        self.parts: dict[int, list[tuple[Place, int]]] = {}

    def row(self, p: Place, i: int, h: int) -> Iterator[tuple[Place, Place]]:
        """(p, the earlier close line) pairs that the row adds."""
        if i in self.first:
            q, g = self.first[i]
            if g != h:
                yield p, q
            return
        self.first[i] = p, h
        if i & 0xFFFFFFFF:
            self.parts.setdefault(i >> 32, []).append((p, h))

    def whole(self, p: Place, i: int, h: int) -> Iterator[tuple[Place, Place]]:
        """Links of a row to the whole line of its key, where that comes first."""
        found = self.first.get(i >> 32 << 32)
        if found and i & 0xFFFFFFFF and found[1] != h and found[0] < p:
            yield p, found[0]

    def done(self) -> Iterator[tuple[Place, Place]]:
        """Links of whole lines to the earliest of the lines that have them as a variant."""
        for e, parts in self.parts.items():
            found = self.first.get(e << 32)
            if found:
                early = min((p for p, h in parts if h != found[1]), default=None)
                if early and early < found[0]:
                    yield found[0], early


def _meet(rows: DataFrame) -> DataFrame:
    """(doc, x, line, q_doc, q_x, q_line): the links of all keys, with one pass over each sorted partition."""
    names = ["k", "i", "h", "doc", "x", "line"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("line_dedup")
        key, links = None, None

        def frame(out: list[tuple[Place, Place]]) -> pd.DataFrame:
            return pd.DataFrame([(*p, *q) for p, q in out], columns=["doc", "x", "line", "q_doc", "q_x", "q_line"])

        for batch in batches:
            if not len(batch):
                continue
            k, i, h, doc, x, line = (batch[c].to_numpy() for c in names)
            out: list[tuple[Place, Place]] = []
            starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            ends = np.r_[starts[1:], len(k)]
            # a key with one line in it links nothing; the first and last may go on in other batches
            mixed = np.minimum.reduceat(h, starts) != np.maximum.reduceat(h, starts)
            mixed[0] = mixed[-1] = True
            for s, e in zip(starts[mixed].tolist(), ends[mixed].tolist(), strict=True):
                if links is None or k[s] != key:
                    if links is not None:
                        out += links.done()
                    key, links = k[s], _Links()
                for p, j, g in zip(zip(doc[s:e].tolist(), x[s:e].tolist(), line[s:e].tolist(), strict=True), i[s:e].tolist(), h[s:e].tolist(), strict=True):
                    out += links.row(p, j, g)
                    out += links.whole(p, j, g)
            yield frame(out)
        if links is not None:
            yield frame(list(links.done()))

    return rows.repartition("k").sortWithinPartitions(*names[:2], "doc", "x", "line").mapInPandas(run, "doc long, x long, line int, q_doc long, q_x long, q_line int")


def _verified(docs: DataFrame, links: DataFrame) -> DataFrame:
    """The links whose lines are within one edit of each other."""

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for d, x, t, wanted in zip(batch["doc"], batch["x"], batch["t"], batch["lines"], strict=True):
                lines = t.encode().split(b"\n")
                out += [(d, x, i, lines[i]) for i in wanted if i < len(lines)]
            yield pd.DataFrame(out, columns=["doc", "x", "line", "words"])

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            ok = [within_one(a.split(), b.split()) for a, b in zip(x["words"], x["q_words"], strict=True)]
            yield x.loc[ok, ["doc", "x", "line", "q_doc", "q_x", "q_line"]]

    at, q_at = ["doc", "x", "line"], ["q_doc", "q_x", "q_line"]
    wanted = links.select(*at).union(links.select(*q_at))
    texts = _with_lines(docs, wanted, "inner").select("doc", "x", "t", "lines").mapInPandas(fetch, "doc long, x long, line int, words binary").dropDuplicates(at).checkpoint()
    # an early line may be that of many links: adaptive execution splits its partition, as both sides are joined by sorting
    both = links.join(texts, at).join(texts.toDF(*q_at, "q_words"), q_at)
    return both.select(*at, "words", *q_at, "q_words").mapInPandas(check, "doc long, x long, line int, q_doc long, q_x long, q_line int")


def duplicate_lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, x, line, keep_doc, keep_line): every line that goes, with the earliest line close to it."""
    ensure_checkpoint_dir(df.sparkSession)
    docs = df.select(F.col(f"`{key}`").cast("long").alias("doc"), F.xxhash64(F.col(f"`{text}`")).alias("x"), F.col(f"`{text}`").alias("t")).where("doc is not null and t is not null")
    with arrow_rows(df.sparkSession, TEXT_ROWS):
        lines = lines_of(docs).checkpoint()  # 56 bytes a line
        spot = F.struct("doc", "x", "line")
        first = lines.groupBy("h", "g").agg(F.min(spot).alias("p"), F.count(F.lit(1)).alias("n"), F.first("pre").alias("pre"), F.first("suf").alias("suf")).checkpoint()
        # lines whose first or last words another line shares
        ends = first.where("pre <> 0 or suf <> 0").select("p.*", F.explode(F.array("pre", "suf")).alias("e"))
        shared = ends.groupBy("e").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        candidates = join_groups(ends, shared, ["e"], "m", ["doc", "x", "line"]).select("doc", "x", "line").distinct()
        sent = _variant_rows(docs, candidates)
    links = _meet(sent).distinct().checkpoint()
    near = _verified(docs, links).groupBy("doc", "x", "line").agg(F.min(F.struct(F.col("q_doc").alias("doc"), F.col("q_x").alias("x"), F.col("q_line").alias("line"))).alias("q"))
    kept = first.select("h", "g", "p", "n").join(near.select(spot.alias("p"), "q"), "p", "left")
    kept = kept.withColumn("keep", F.least("p", F.coalesce("q", "p"))).where((F.col("n") > 1) | (F.col("keep") < F.col("p"))).select("h", "g", "n", "keep")
    found = join_groups(lines.select("doc", "x", "line", "h", "g"), kept, ["h", "g"], "n", ["doc", "x", "line"])
    return found.where(F.col("keep") < spot).select("doc", "x", "line", F.col("keep.doc").alias("keep_doc"), F.col("keep.line").alias("keep_line"))


def drop_lines(df: DataFrame, key: str = "doc_id", text: str = "text", chars: str | None = "n_chars") -> DataFrame:
    """df without its duplicate lines; rows of which no word is left go. `chars`, if df has it, is set anew."""
    d, x, gone = (free_name(df, n) for n in ("doc", "x", "gone"))
    lists = duplicate_lines(df, key, text).groupBy(F.col("doc").alias(d), F.col("x").alias(x)).agg(F.sort_array(F.collect_set("line")).alias(gone))
    out = df.join(small_or_shuffled(lists), (F.col(f"`{key}`").cast("long") == F.col(d)) & (F.xxhash64(F.col(f"`{text}`")) == F.col(x)), "left").drop(d, x)
    lines = F.split(F.col(f"`{text}`"), "\n", -1)
    left = F.array_join(F.filter(lines, lambda y, i: ~F.array_contains(F.col(gone), i)), "\n")
    out = out.withColumn(text, F.when(F.col(gone).isNull(), F.col(f"`{text}`")).otherwise(left))
    out = out.where(F.col(gone).isNull() | F.col(f"`{text}`").rlike(r"[^\x20\x09-\x0D]"))
    if chars and chars in df.columns:
        out = out.withColumn(chars, F.when(F.col(gone).isNull(), F.col(f"`{chars}`")).otherwise(F.length(f"`{text}`").cast(df.schema[chars].dataType)))
    return out.select(*(f"`{c}`" for c in df.columns))

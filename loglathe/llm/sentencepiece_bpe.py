"""SentencePiece encoding and decoding, exact for models of the BPE type with identity normalisation.

An encoding is the one sequence of pieces in which every adjacent pair is what merging its own text
would give. Longest matches of an Aho-Corasick automaton propose pieces; a proposal stands if
re-merging it with its left neighbour gives the two again; else shorter ones follow, and when none is
left the position's bit is set in a field of failed positions, the last piece goes, and the search
goes on from there. Characters without a piece become byte pieces.

Where no piece of the model goes over the start of a space run or over a character without a piece,
these cut the text into units that encode independently; a bounded memo of units spares repeats.

Defined cases: null texts count as empty; empty texts have no ids and decode to the empty text. Every
worker holds one model and at most twice `MEMO` units of up to 64 characters and twice `PAIRS` pairs; no
text is cut.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bound_batches, claim, free_name

SPACE = "▁"
#: Entries of each of the two generations of the memo of units, and of that of pairs.
MEMO, PAIRS = 400_000, 150_000
#: Characters of text that one Arrow batch of results comes from, at least one row.
BATCH_CHARS = 4_000_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class _Memo(dict):
    """A dict that fills itself by `make`; when full, only what is asked for again lives on."""

    def __init__(self, make, bound: int):
        self.make, self.bound, self.old = make, bound, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.bound:
            self.old = self.copy()
            self.clear()
        self[key] = value
        return value


class PieceModel:
    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or model.trainer_spec.model_type != 2 or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with identity normalisation are supported")
        self.dummy = spec.add_dummy_prefix
        kinds = type(model.pieces[0])
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.ids = normal
        # merging goes by score, the leftmost of equal ones first
        self.rank = {piece: -model.pieces[i].score for piece, i in normal.items()}
        self.bytes_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.unk = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        self.raw = [b"" if p.type == kinds.CONTROL else " ⁇ ".encode() if p.type == kinds.UNKNOWN else bytes([int(p.piece[1:-1], 16)]) if p.type == kinds.BYTE else p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        self.is_byte = [p.type == kinds.BYTE for p in model.pieces]
        self.pairs = _Memo(self._pair, PAIRS)
        self.units = _Memo(self.encode_unit, MEMO)
        self.automaton = ahocorasick.Automaton()
        for piece in normal:
            if len(piece) == 1 or self.merge(piece) == [piece]:
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        known = {c for piece in normal for c in piece}
        if not known <= normal.keys():
            raise ValueError("a character of some piece is no piece")
        self.known = known
        if any(SPACE in piece.lstrip(SPACE) for piece in normal):
            cut = ""  # spaces inside pieces: the whole text is one unit
        else:
            cut = SPACE
        apart = "" if "\n" in known else "\n"
        self.unit = re.compile(f"{cut}+[^{cut}{apart}]*|[^{cut}{apart}]+|\n" if cut else f"[^{apart}]+|\n" if apart else "(?s:.+)")

    def merge(self, text: str) -> list[str]:
        """Merges characters by the rule of the model: best score first, leftmost of equals."""
        parts, rank = list(text), self.rank.get
        inf = float("inf")
        scores = [rank(parts[i] + parts[i + 1], inf) for i in range(len(parts) - 1)]
        while scores:
            best = min(scores)
            if best == inf:
                break
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i < len(scores):
                scores[i] = rank(parts[i] + parts[i + 1], inf)
            if i:
                scores[i - 1] = rank(parts[i - 1] + parts[i], inf)
        return parts

    def _pair(self, pair: tuple[str, str]) -> bool:
        """Whether two adjacent pieces survive when their text is merged anew."""
        return self.merge(pair[0] + pair[1]) == [*pair]

    def pieces(self, text: str) -> list[str]:
        """Pieces of a text whose characters all have one, by backtracking."""
        n, pairs = len(text), self.pairs
        at: list[list[str]] = [[] for _ in range(n)]  # matches from each position, the longest last
        for end, piece in self.automaton.iter(text):
            at[end + 1 - len(piece)].append(piece)
        failed = bytearray((n >> 3) + 1)
        out: list[str] = []
        tried: list[int] = []
        pos, k = 0, len(at[0]) - 1
        while pos < n:
            options = at[pos]
            while k >= 0:
                piece = options[k]
                end = pos + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1 and (not out or pairs[out[-1], piece]):
                    break
                k -= 1
            if k >= 0:
                out.append(piece)
                tried.append(k)
                pos = end
                k = len(at[pos]) - 1 if pos < n else 0
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                pos -= len(out.pop())
                k = tried.pop() - 1
        return out

    def encode_unit(self, unit: str) -> bytes:
        """int32 ids of one unit."""
        known, ids = self.known, self.ids
        out = array("i")
        if all(map(known.__contains__, unit)):
            out.extend(map(ids.__getitem__, self.pieces(unit)))
            return out.tobytes()
        start = 0
        for i in range(len(unit) + 1):
            if i == len(unit) or unit[i] not in known:
                if i > start:
                    out.extend(map(ids.__getitem__, self.pieces(unit[start:i])))
                if i < len(unit):
                    out.extend(self.bytes_ids.get(b, self.unk) for b in unit[i].encode("utf-8", "surrogatepass")) if self.bytes_ids else out.append(self.unk)
                start = i + 1
        return out.tobytes()

    def encode(self, text: str) -> bytes:
        """int32 ids of a whole text, without begin and end ids."""
        if not text:
            return b""
        text = text.replace(" ", SPACE)
        units = self.unit.findall(SPACE + text if self.dummy else text)
        memo = self.units
        return b"".join([memo[u] if len(u) <= 64 else self.encode_unit(u) for u in units])

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; a byte that is no part of a character becomes U+FFFD."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = self._decode_bytes(ids)
        first = next((i for i in ids if self.raw[i]), None)
        return text[1:] if self.dummy and text.startswith(" ") and not self.is_byte[first] and first != self.unk else text

    def _decode_bytes(self, ids: Iterable[int]) -> str:
        out, run = [], b""
        for i in [*ids, None]:
            if i is not None and self.is_byte[i]:
                run += self.raw[i]
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[:n].decode())
                        run = run[n:]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    run = run[1:]
            if i is not None:
                out.append(self.raw[i].decode())
        return "".join(out)


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    """One model for each Python worker."""
    return PieceModel(path)


def encode(df: DataFrame, text: str, model_path: str | None = None, ids: str = "token_ids", decoded: str | None = "decoded") -> DataFrame:
    """df with the ids (array<int>) of each whole text, and under `decoded` the text decoded from them.

    A narrow pass over the rows, with no shuffle; columns named like those added are replaced.
    """
    path = model_path or default_model()
    out = [c for c in (ids, decoded) if c]
    df = df.drop(*(c for c in out if c != text))
    source = text
    if text in out:
        source = free_name(df, "text")
        df = df.withColumnRenamed(text, source)
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), *([T.StructField(decoded, T.StringType(), False)] if decoded else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("sentencepiece", load.cache_clear)
        model = load(path)
        for whole in batches:
            start = 0
            texts = whole.column(whole.schema.get_field_index(source)).to_pylist()
            while start < len(texts):
                end, chars = start, 0
                while end < len(texts) and chars < BATCH_CHARS:
                    chars += len(texts[end] or "")
                    end += 1
                rows = [model.encode(t or "") for t in texts[start:end]]
                offsets = array("i", [0])
                n = 0
                for r in rows:
                    n += len(r) >> 2
                    offsets.append(n)
                values = pa.Array.from_buffers(pa.int32(), n, [None, pa.py_buffer(b"".join(rows))])
                cols = [*whole.slice(start, end - start).columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)]
                if decoded:
                    cols.append(pa.array([model.decode(array("i", r)) for r in rows], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, [*whole.schema.names, *out])
                start = end

    bound_batches(df.sparkSession)
    result = df.mapInArrow(run, schema)
    return result.withColumnRenamed(source, text) if source != text and text not in out else result.drop(source) if source != text else result

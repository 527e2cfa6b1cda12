"""Structure discovery on weighted profiles: a recursion over distinct token sequences and their counts.

Every decision depends on token ids, their order and numbers of lines only, so it is taken here on the
distinct profiles with their numbers of lines; the lines themselves stay on the executors.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from ..functions.lexer import CLOSERS, Token, lex, sample
from ..operators.histograms import ARRAY_WIDTH, CLUSTER_TOLERANCE, MAX_RESIDUAL, MIN_COVERAGE
from ..operators.profiles import SAMPLES, LineProfile
from .types import Array, Base, Node, Struct, Union, hoisted, named

Place = tuple[int, ...]
Example = tuple[Place, tuple[Token, ...]]


@dataclass(frozen=True)
class Chunk:
    """Token sequences with one id sequence: how many, and the first of them with their places."""

    weight: int
    examples: tuple[Example, ...]

    @property
    def ids(self) -> tuple[str, ...]:
        return tuple(t.id for t in self.examples[0][1])

    @property
    def first(self) -> Place:
        return self.examples[0][0]

    def cut(self, start: int, end: int, sub: int = 0) -> Chunk:
        return Chunk(self.weight, tuple(((*p, sub), t[start:end]) for p, t in self.examples))


def chunks_of(profiles: Iterable[LineProfile]) -> list[Chunk]:
    return [Chunk(p.count, tuple(((o,), tuple(lex(line))) for o, line in p.first)) for p in profiles]


@dataclass(frozen=True)
class Histogram:
    """Of one id: lines by frequency above 0, and all lines."""

    id: str
    counts: dict[int, int]
    total: int

    @property
    def coverage(self) -> int:
        return sum(self.counts.values())

    @property
    def width(self) -> int:
        return len(self.counts)

    @property
    def residual(self) -> float:
        return (self.total - max(self.counts.values())) / self.total

    @property
    def form(self) -> list[int]:
        return [self.total - self.coverage, *(n for _, n in sorted(self.counts.items(), key=lambda x: (-x[1], x[0])))]

    @property
    def is_struct(self) -> bool:
        return self.residual < MAX_RESIDUAL and self.coverage > MIN_COVERAGE * self.total

    @property
    def is_array(self) -> bool:
        return self.width > ARRAY_WIDTH and self.coverage > MIN_COVERAGE * self.total


def histograms(chunks: Sequence[Chunk]) -> list[Histogram]:
    total = sum(c.weight for c in chunks)
    counts: dict[str, dict[int, int]] = defaultdict(lambda: defaultdict(int))
    for c in chunks:
        ids = c.ids
        for i in set(ids):
            counts[i][ids.count(i)] += c.weight
    return [Histogram(i, dict(f), total) for i, f in sorted(counts.items())]


def entropy(a: Sequence[int], b: Sequence[int]) -> float:
    out = 0.0
    for i in range(max(len(a), len(b))):
        x, y = a[i] if i < len(a) else 0, b[i] if i < len(b) else 0
        mean = (x + y) / 2
        out += sum(v * math.log(v / mean) for v in (x, y) if v)
    return out / 2


def clusters(found: Sequence[Histogram], tolerance: float = CLUSTER_TOLERANCE) -> list[list[Histogram]]:
    """Single-link clusters: what pairs within the tolerance connect."""
    root = list(range(len(found)))

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    forms = [h.form for h in found]
    for i in range(len(found)):
        for j in range(i):
            if entropy(forms[i], forms[j]) < tolerance:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    out: dict[int, list[Histogram]] = defaultdict(list)
    for i, h in enumerate(found):
        out[top(i)].append(h)
    return list(out.values())


def _ordered(groups: dict[tuple, list[Chunk]]) -> list[list[Chunk]]:
    """Branches in the order in which they first appear."""
    return sorted(groups.values(), key=lambda g: min(c.first for c in g))


def _array_parts(chunk: Chunk, wanted: frozenset[str]) -> tuple[Chunk, list[Chunk], Chunk]:
    """Preamble, whole groups and postamble of one chunk.

    The preamble ends once all ids of the cluster were seen; groups have as many tokens as the cluster
    has ids and end at the first other token, with which the postamble starts, after what was left of
    a group; a group left open at the end of the chunk is dropped.
    """
    ids, n = chunk.ids, len(wanted)
    seen: set[str] = set()
    start = 0
    while start < len(ids) and len(seen) < n:
        if ids[start] in wanted:
            seen.add(ids[start])
        start += 1
    stop = start
    while stop < len(ids) and ids[stop] in wanted:
        stop += 1
    whole = start + (stop - start) // n * n
    groups = [chunk.cut(i, i + n, i) for i in range(start, whole, n)]
    return chunk.cut(0, start), groups, chunk.cut(whole, len(ids)) if stop < len(ids) else chunk.cut(len(ids), len(ids))


def _samples(chunks: Sequence[Chunk]) -> tuple[str, ...]:
    every = sorted((e for c in chunks for e in c.examples), key=lambda e: e[0])
    return tuple(sample(t[0]) for _, t in every[:SAMPLES])


def _inner(chunks: Sequence[Chunk]) -> list[Chunk]:
    """The insides of chunks that are one group each; what one profile holds may differ deeper than it sees."""
    out: list[Chunk] = []
    for c in chunks:
        by_ids: dict[tuple[str, ...], list[Example]] = defaultdict(list)
        for p, t in c.examples:
            inner = tuple(lex(t[0].inner))
            by_ids[tuple(x.id for x in inner)].append((p, inner))
        share = max(1, c.weight // len(by_ids))
        out += [Chunk(share if k else c.weight - share * (len(by_ids) - 1), tuple(e)) for k, e in enumerate(by_ids.values())]
    return out


@dataclass(frozen=True)
class Options:
    """meta_by_delimiter: groups with different delimiters are different; nullable_groups: a group that was
    seen empty may be empty."""

    meta_by_delimiter: bool = False
    nullable_groups: bool = False


def discover(chunks: Sequence[Chunk], options: Options = Options()) -> Node:
    chunks = [c for c in chunks if c.examples[0][1]]
    if not chunks:
        return Base(cls="noop")
    sequences: dict[tuple[str, ...], list[Chunk]] = defaultdict(list)
    for c in chunks:
        sequences[c.ids].append(c)
    if len(sequences) == 1 and len(chunks[0].ids) == 1:
        token = min(chunks, key=lambda c: c.first).examples[0][1][0]
        if token.cls != "meta":
            return Base(cls=token.cls, param=token.param, samples=_samples(chunks))
        opener = token.text[0]
        if options.meta_by_delimiter:
            kinds: dict[tuple, list[Chunk]] = defaultdict(list)
            for c in chunks:
                kinds[(c.examples[0][1][0].text[0],)].append(c)
            if len(kinds) > 1:
                return Union(branches=tuple(discover(g, options) for g in _ordered(kinds)))
        inside = _inner(chunks)
        inner = discover(inside, options)
        if options.nullable_groups and inner.has_data and not all(c.examples[0][1] for c in inside):
            inner = Union(branches=(inner, Base(cls="noop")))
        return Struct(members=(Base(cls="char", param=opener), inner, Base(cls="char", param=CLOSERS[opener])))
    groups = clusters(histograms(chunks))
    if any(all(h.is_struct for h in g) for g in groups):
        # the profile of a struct holds every id, so each distinct sequence is a record or a branch
        if len(sequences) == 1:
            width = len(chunks[0].ids)
            return Struct(members=tuple(discover([c.cut(i, i + 1) for c in chunks], options) for i in range(width)))
        return Union(branches=tuple(discover(g, options) for g in _ordered(dict(sequences))))
    arrays = [g for g in groups if all(h.is_array for h in g)]
    if arrays:
        best = min(arrays, key=lambda g: (-max(h.coverage for h in g), min(h.id for h in g)))
        parts = [_array_parts(c, frozenset(h.id for h in best)) for c in chunks]
        bodies = [b for _, body, _ in parts for b in body]
        if bodies:
            members: list[Node] = []
            if any(p.examples[0][1] for p, _, _ in parts):
                members.append(discover([p for p, _, _ in parts], options))
            members.append(Array(body=discover(bodies, options)))
            if any(q.examples[0][1] for _, _, q in parts):
                members.append(discover([q for _, _, q in parts], options))
            return Struct(members=tuple(members))
    # neither: branches by the first ids, one more than are needed to tell some apart
    k = 1
    while len({c.ids[:k] for c in chunks}) == 1 and k < max(len(c.ids) for c in chunks):
        k += 1
    heads: dict[tuple, list[Chunk]] = defaultdict(list)
    for c in chunks:
        heads[c.ids[: k + 1]].append(c)
    if len(heads) == 1:  # no progress is possible by heads: by whole sequences then
        heads = dict(sequences)
    return Union(branches=tuple(discover(g, options) for g in _ordered(heads)))


def infer(profiles: Iterable[LineProfile], options: Options = Options()) -> Node:
    """The named type tree of lines with the given profiles."""
    return named(hoisted(discover(chunks_of(profiles), options)))

"""MinHash near-dedup with sequential Bayesian verification; links are exact.

Texts become sets of five-word shingles; equal sets fall into one class at once. Signatures of 128
values are banded 32 x 4, so that a pair at the threshold shares a band but for 5 in a million.
Candidates' signatures are compared in batches of 16: after each, the pair goes if the posterior
probability (uniform prior) that its similarity reaches the threshold is under `MISS`. Survivors are
verified on their full sets. No bucket's pairs are all listed:

1. each class is tested with one pivot of its buckets, the one that shares most bands with others;
2. where a bucket still holds several components, the classes outside its largest one are compared in
   blocks with all of it; a forest of the surviving pairs connects families of classes;
3. in each family the classes outside its largest component meet all others, in blocks that carry the
   full sets. Whatever pair of two components passes the signatures is verified there unless the two
   have been joined already, so no link between components is missed.

Components are found by distributed stars over the classes, which have numbers of their own, so rows
that share an id and differ in text are told apart; a component is named by the least id of its rows.

Defined cases: null texts and texts without words have empty sets, are linked with nothing and stay;
rows with a null id stay and link nothing; of rows that share an id each has its own set's component,
and all that have the component's id are kept; texts are read whole at any length; an empty table gives
an empty result; other columns are not read, whatever their names, and `keep_one` passes them on.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_ROWS, arrow_rows, claim, ensure_checkpoint_dir, free_name, join_groups, small_or_shuffled
from .components import components

WORDS, PERCENT = 5, 75
BANDS, ROWS = 32, 4
BATCH, MISS = 16, 1e-5
#: Classes of one block of a bucket, and of a family, whose blocks carry full sets: smaller ones copy them more often.
BLOCK, FAMILY_BLOCK = 512, 512
#: Rows with full sets that a Python worker gets at once.
WIDE_ROWS = 1000
#: Shingles that are permuted at once.
_CHUNK = 4096
_P = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, w: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(w)
        if len(self) > 200_000:
            self.clear()
        self[w] = h
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Whole texts to sorted distinct 64-bit shingle hashes."""

    def __init__(self, words: int = WORDS):
        self.words, self.hashes = words, _WordHashes()

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, only ASCII space splits
        if not words:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        n = min(self.words, len(words))
        x = np.full(len(words) - n + 1, n, np.uint64)
        for i in range(n):
            x = x * _P + h[i : i + len(x)]
        return np.unique(_mix(x))


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """128 minima (uint32) of a set that isn't empty."""
    a, b = _permutations() if not hasattr(signature, "ab") else signature.ab
    signature.ab = (a, b)
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    out = np.full(len(a), 2**32 - 1, np.uint32)
    for i in range(0, len(x), _CHUNK):
        m = a[:, None] * x[None, i : i + _CHUNK]
        m += b[:, None]
        m ^= m >> np.uint32(15)
        np.minimum(out, m.min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(BANDS, ROWS).astype(np.uint64)
    x = np.arange(BANDS, dtype=np.uint64) * np.uint64(77)
    for i in range(ROWS):
        x = _mix(x * _P + parts[:, i])
    return x.view(np.int64)


def least_matches(threshold: float = PERCENT / 100, miss: float = MISS) -> dict[int, int]:
    """For n compared values the least matches at which the posterior of reaching the threshold is `miss`.

    With a uniform prior that posterior is the chance of at most m successes in n + 1 trials.
    """
    out = {}
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        total, m = 0.0, 0
        while (total := total + comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)) < miss:
            m += 1
        out[n] = m
    return out


def survivors(a: np.ndarray, b: np.ndarray, need: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the pairs of signature rows that pass every batch, and their matches."""
    left = np.arange(len(a))
    got = np.zeros(len(a), np.int32)
    for n, least in need.items():
        got = got + (a[left, n - BATCH : n] == b[left, n - BATCH : n]).sum(axis=1, dtype=np.int32)
        ok = got >= least
        left, got = left[ok], got[ok]
    return left, got


def features(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, mark, n_shingles, set_key, sig, bands) of every row; mark: a hash of the text; the last three null for empty sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        claim("minhash")
        shingle = Shingler()
        for batch in batches:
            out = []
            for i, m, t in zip(batch["id"], batch["mark"], batch["t"], strict=True):
                s = shingle(t)
                if len(s):
                    sig = signature(s)
                    out.append((i, m, len(s), xxhash.xxh3_128_digest(s.tobytes()), (sig & 0xFFFF).astype(np.uint16).tobytes(), band_keys(sig)))
                else:
                    out.append((i, m, 0, None, None, None))
            df = pd.DataFrame(out, columns=["id", "mark", "n_shingles", "set_key", "sig", "bands"])
            yield df.astype({"id": "Int64"})

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("mark"), F.col(f"`{text}`").alias("t"))
    return rows.mapInPandas(run, "id long, mark long, n_shingles long, set_key binary, sig binary, bands array<long>")


def _matrix(sigs) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint16).reshape(-1, BANDS * ROWS)


def _prune_pairs(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """(a, b, matches) of the pairs (a, b) that survive their signatures' comparison."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        need = least_matches()
        for x in batches:
            if len(x):
                at, got = survivors(_matrix(x["sa"]), _matrix(x["sb"]), need)
                yield pd.DataFrame({"a": x["a"].to_numpy()[at], "b": x["b"].to_numpy()[at], "matches": got})

    joined = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    return joined.mapInPandas(run, "a long, b long, matches int")


def _linked(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether two sets reach the threshold exactly."""
    if 100 * min(len(p), len(q)) < PERCENT * max(len(p), len(q)):
        return False
    both = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * both >= PERCENT * (len(p) + len(q) - both)


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that reach the threshold on their full sets, as edges (u, v)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            ok = np.zeros(len(x), bool)
            for i, (p, q) in enumerate(zip(x["sa"], x["sb"], strict=True)):
                ok[i] = _linked(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64))
            yield pd.DataFrame({"u": x["a"].to_numpy()[ok], "v": x["b"].to_numpy()[ok]})

    joined = pairs.select("a", "b").distinct().join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    joined = joined.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    return joined.mapInPandas(run, "u long, v long")


def _sets(docs: DataFrame, key: str, text: str, classes: DataFrame) -> DataFrame:
    """(id, shingles as sorted 64-bit hashes) of the classes (id, rep, set_key); rep: the id of one of its rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        shingle = Shingler()
        for x in batches:
            found = [shingle(t).tobytes() for t in x["t"]]
            yield pd.DataFrame({"set_key": [xxhash.xxh3_128_digest(b) for b in found], "rep": x["rep"], "shingles": found})

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("rep"), F.col(f"`{text}`").alias("t"))
    found = rows.join(small_or_shuffled(classes.select("rep").distinct()), "rep", "left_semi").mapInPandas(run, "set_key binary, rep long, shingles binary")
    return found.join(classes, ["set_key", "rep"]).select("id", "shingles").dropDuplicates(["id"])


class _Forest(dict):
    """Union-find over hashable nodes."""

    def top(self, x):
        while (y := self.get(x, x)) != x:
            z = self.get(y, y)
            self[x] = z
            x = z
        return x

    def join(self, x, y) -> bool:
        x, y = self.top(x), self.top(y)
        if x != y:
            self[max(x, y)] = min(x, y)
        return x != y


def _dealt(rows: DataFrame, group: str, size: int) -> DataFrame:
    """rows (group, id, comp, ...) of groups that hold several components, dealt into blocks (group, t, q).

    Every row is a target in one block of targets, and those outside the group's largest component are
    queries in one block of queries; all blocks of the two kinds meet. A block has about `size` of each.
    """
    by_comp = rows.groupBy(group, "comp").agg(F.count(F.lit(1)).alias("n"))
    main = by_comp.groupBy(group).agg(F.max(F.struct("n", "comp")).alias("x"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("c")).where("c > 1")
    main = main.select(group, F.col("x.comp").alias("main"), F.ceil(F.col("all") / size).cast("int").alias("nt"), F.ceil((F.col("all") - F.col("x.n")) / size).cast("int").alias("nq"))
    own = rows.columns
    rows = rows.join(main, group)
    spot = F.xxhash64("id")
    as_t = rows.select(*own, F.lit(False).alias("query"), F.pmod(spot, "nt").cast("int").alias("t"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("q"))
    as_q = rows.where("comp <> main").select(*own, F.lit(True).alias("query"), F.explode(F.sequence(F.lit(0), F.col("nt") - 1)).alias("t"), F.pmod(spot, "nq").cast("int").alias("q"))
    return as_t.unionByName(as_q).repartition(group, "t", "q").sortWithinPartitions(group, "t", "q")


def _by_block(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of whole blocks from a partition that is sorted by the keys."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        k = batch[keys].to_numpy()
        same = (k == k[-1]).all(axis=1)
        start = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if start or (held and (held[-1][keys].iloc[-1].to_numpy() != k[-1]).any()):
            yield pd.concat([*held, batch.iloc[:start]])
            held = []
        held.append(batch.iloc[start:])
    if held:
        yield pd.concat(held)


def _families(buckets: DataFrame, comps: DataFrame, sigs: DataFrame) -> DataFrame:
    """Edges (u, v) that connect all ids with a surviving pair between components in some bucket.

    A block gives a forest of its surviving pairs, so no more edges than it has rows.
    """
    rows = buckets.join(comps, F.col("id") == F.col("node"), "left").select("bucket", "id", F.coalesce("component", "id").alias("comp"))
    blocks = _dealt(rows.join(sigs.select("id", "sig"), "id"), "bucket", BLOCK)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        need = least_matches()
        claim("minhash")
        keys = ["bucket", "t", "q"]
        for x in _by_block(batches, keys):
            k = x[keys].to_numpy()
            starts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(axis=1)])
            ends = np.r_[starts[1:], len(x)]
            ids, comp, query, sig = x["id"].to_numpy(), x["comp"].to_numpy(), x["query"].to_numpy(bool), _matrix(x["sig"])
            out: list[tuple[int, int]] = []
            left: list[tuple[int, int, int]] = []

            def settle() -> None:
                """The small blocks' pairs, all at once."""
                if left:
                    z = np.array(left)
                    at, _ = survivors(sig[z[:, 1]], sig[z[:, 2]], need)
                    tree = _Forest()
                    out.extend((int(ids[i]), int(ids[j])) for n, i, j in z[at].tolist() if tree.join((n, int(ids[i])), (n, int(ids[j]))))
                    left.clear()

            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                if e - s <= 16:
                    left += [(s, i, j) for i in range(s, e) if query[i] for j in range(s, e) if not query[j] and comp[i] != comp[j]]
                    if len(left) > 100_000:
                        settle()
                    continue
                qs, ts = np.flatnonzero(query[s:e]) + s, np.flatnonzero(~query[s:e]) + s
                root = ids.copy()  # of each id the tree that it is in so far
                for i in qs.tolist():
                    js = ts[(comp[ts] != comp[i]) & (root[ts] != root[i])]
                    at, _ = survivors(np.broadcast_to(sig[i], (len(js), sig.shape[1])), sig[js], need)
                    for j in js[at].tolist():
                        if root[i] != root[j]:
                            here = root[s:e]
                            here[here == root[j]] = root[i]
                            out.append((int(ids[i]), int(ids[j])))
            settle()
            yield pd.DataFrame(out, columns=["u", "v"])

    return blocks.mapInPandas(run, "u long, v long")


def _links_across(families: DataFrame, comps: DataFrame, sigs: DataFrame, sets: DataFrame) -> DataFrame:
    """Verified links (u, v) between components of one family, at most one for each two that they join.

    Each class outside the family's largest component meets all of the family, in blocks that carry the
    full sets; pairs pass the signatures first and are verified where they meet.
    """
    rows = families.join(comps.withColumnRenamed("component", "comp"), "node", "left").select("family", F.col("node").alias("id"), F.coalesce("comp", "node").alias("comp"))
    blocks = _dealt(rows.join(sigs.select("id", "sig"), "id").join(sets, "id"), "family", FAMILY_BLOCK)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        need = least_matches()
        claim("minhash")
        keys = ["family", "t", "q"]
        for x in _by_block(batches, keys):
            k = x[keys].to_numpy()
            starts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(axis=1)])
            ends = np.r_[starts[1:], len(x)]
            ids, comp, query, sig = x["id"].to_numpy(), x["comp"].to_numpy(), x["query"].to_numpy(bool), _matrix(x["sig"])
            sets_ = [np.frombuffer(b, np.uint64) for b in x["shingles"]]
            out: list[tuple[int, int]] = []
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                qs, ts = np.flatnonzero(query[s:e]) + s, np.flatnonzero(~query[s:e]) + s
                root = comp.copy()  # of each component the one that it is joined with so far
                for i in qs.tolist():
                    js = ts[root[ts] != root[i]]
                    at, got = survivors(np.broadcast_to(sig[i], (len(js), sig.shape[1])), sig[js], need)
                    for j in js[at[np.argsort(-got, kind="stable")]].tolist():
                        if root[i] != root[j] and _linked(sets_[i], sets_[j]):
                            here = root[s:e]
                            here[here == root[j]] = root[i]
                            out.append((int(ids[i]), int(ids[j])))
            yield pd.DataFrame(out, columns=["u", "v"])

    return blocks.mapInPandas(run, "u long, v long")


def cluster(docs: DataFrame, key: str = "doc_id", text: str = "text", marked: bool = False) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of docs; if marked, with mark, the xxhash64 of the text."""
    ensure_checkpoint_dir(docs.sparkSession)
    with arrow_rows(docs.sparkSession, TEXT_ROWS):
        feats = features(docs, key, text).checkpoint()
    real = feats.where(F.col("set_key").isNotNull() & F.col("id").isNotNull())
    every = real.groupBy("set_key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n_rows"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    # classes have numbers of their own, as two of them may share an id; written, so that they stay
    own = every.withColumn("id", F.monotonically_increasing_id()).checkpoint()
    classes = own.select("set_key", "rep", "n_rows", "id")
    bands = own.select("id", F.explode("bands").alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = bands.join(shared, "bucket").checkpoint()
    ids = buckets.groupBy("id").agg(F.sum("n").alias("degree")).checkpoint()
    sigs = own.join(ids, "id", "left_semi").select("id", "sig").checkpoint()
    with arrow_rows(docs.sparkSession, WIDE_ROWS):
        sets = _sets(docs, key, text, classes.join(ids, "id", "left_semi").select("id", "rep", "set_key")).checkpoint()
    # 1: one pivot for each class
    ranked = buckets.join(ids, "id")
    pivots = ranked.groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("id")).alias("o"))).alias("p")).select("bucket", (-F.col("p.o")).alias("b"))
    pairs = ranked.join(pivots, "bucket").where("id <> b").select(F.col("id").alias("a"), "b").distinct()
    close = _prune_pairs(pairs, sigs)
    best = close.groupBy("a").agg(F.max(F.struct("matches", "b")).alias("p")).select("a", F.col("p.b").alias("b"))
    with arrow_rows(docs.sparkSession, WIDE_ROWS):
        edges = _verify(best, sets).checkpoint()
    comps = components(edges, rounds=1)  # what is connected already need not be compared
    # 2: ids that have a surviving partner in another component, and what they connect to
    bonds = _families(buckets.select("bucket", "id"), comps, sigs).checkpoint()
    families = components(bonds).withColumnRenamed("component", "family")
    # 3: all of a family's components against each other
    with arrow_rows(docs.sparkSession, WIDE_ROWS):
        edges = edges.union(_links_across(families, comps, sigs, sets).checkpoint())
    comps = components(edges)
    held = classes.join(comps, F.col("id") == F.col("node"), "left").select("set_key", "rep", "n_rows", F.coalesce("component", "id").alias("component"))
    least = held.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = held.join(least, "component").select("set_key", "n_rows", "component_id")
    out = join_groups(feats.select("id", "mark", "n_shingles", "set_key"), named, ["set_key"], "n_rows", ["id"], how="left")
    out = out.withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")))
    return out.select("id", *(["mark"] if marked else []), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those whose component has a smaller id."""
    i, t = (free_name(docs, x) for x in ("id", "text_hash"))
    found = cluster(docs, key, text, marked=True)
    gone = small_or_shuffled(found.where("not kept").select(F.col("id").alias(i), F.col("mark").alias(t)).distinct())
    return docs.join(gone, (F.col(f"`{key}`").cast("long") == F.col(i)) & (F.xxhash64(F.col(f"`{text}`")) == F.col(t)), "left_anti")

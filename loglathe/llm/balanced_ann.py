"""Approximate nearest neighbours with balanced posting lists.

`fit_centroids` clusters a sample into lists of about equal size: every cluster above the list size is
split by 2-means at the median, so dense regions get more centroids. The number of lists grows with the
rows, one to `LIST` of them, up to `MAX_CENTROIDS`, so that the share of the vectors that a query reads
falls with the size. Each vector goes to its nearest centroid and, if it lies near a boundary, to
another one that is nearly as near and in another direction. Centroids are found by a best-first walk
over an in-memory graph of their nearest neighbours. A query scans all lists whose distance is within a
ratio of that of a near list, so easy queries read few lists; there is no bound on their number.

Lists are dealt to groups of neighbouring lists, a task's unit, and a query goes once to each group that
has lists of it, with their numbers. Groups that got more than `BLOCK` vectors are cut into blocks by a
hash, all of which a query of the group reads; each block gives its nearest few, and scores are exact.
Only the centroids travel to the workers, at most `MAX_CENTROIDS` * dimensions floats and their graph.

Vectors of another length than most can be near each other only; they form a list for each length, read
whole by the queries of that length, so their neighbours are exact.

Defined cases: vectors that are null or zero or hold null or non-finite components take no part, nor do
rows with a null id; ties go to the smaller id; with fewer candidates than k all are returned; copies of
a vector are neighbours like any others. Rows that agree in id and vector are one row; rows that share
an id only are told apart, each is a query by itself and a candidate of the other. Columns other than
the two named are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir

#: Rows of a list, centroids and vectors of the sample that they are fitted on at most, those with the least
#: hashes of the id; vectors of the sample to a list; lists of a group; vectors of a block.
LIST, MAX_CENTROIDS, MAX_SAMPLE, SAMPLED, GROUP, BLOCK = 25, 32_768, 262_144, 25, 128, 8192
#: A vector is in at most so many lists, with distances within (1 + EPSILON) of the nearest.
REPLICAS, EPSILON = 2, 0.2
#: A query reads lists with distances up to (1 + RATIO) of that of its ANCHOR-th nearest list: the nearest's own
#: distance varies more, as a query that is in the table drew a centroid to itself.
RATIO, ANCHOR = 0.15, 9
DEGREE = 24
#: Rounds that refine the centroids, and what a mean length of a list costs in cosine.
ROUNDS, PENALTY = 3, 0.01
#: Query rows that are held against one list at once.
QUERIES = 1024


@dataclass
class Centroids:
    points: np.ndarray  # unit vectors
    graph: np.ndarray  # (n, degree) neighbours
    entries: np.ndarray  # where walks start


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _split(v: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Two halves by balanced 2-means: the assignment is cut at the median of the difference."""
    a, b = v[rng.integers(len(v))], v[rng.integers(len(v))]
    side = np.zeros(len(v), bool)
    for _ in range(8):
        d = v @ (a - b)
        side = d > np.median(d)
        if side.all() or not side.any():  # copies of one vector
            side = np.arange(len(v)) % 2 == 0
        a, b = v[side].mean(0), v[~side].mean(0)
    return side


def _refined(points: np.ndarray, v: np.ndarray) -> np.ndarray:
    """One round of spherical k-means, with a penalty for lists that are longer than the mean."""
    n = len(points)
    at, size, step = np.empty(len(v), np.int64), np.zeros(n, np.float32), max(1, 64_000_000 // n)
    for i in range(0, len(v), step):
        at[i : i + step] = np.argmax(v[i : i + step] @ points.T - PENALTY * size, axis=1)
        size = (np.bincount(at[: i + step], minlength=n) * (n / min(len(v), i + step))).astype(np.float32)
    order = np.argsort(at, kind="stable")
    found, start = np.unique(at[order], return_index=True)
    sums = np.add.reduceat(v[order].astype(np.float64), start, axis=0)
    norms = np.linalg.norm(sums, axis=1, keepdims=True)
    points = points.copy()
    points[found] = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), points[found])
    return points


def fit_centroids(sample: np.ndarray, lists: int, seed: int = 7) -> Centroids:
    """About `lists` centroids of the sample, neighbouring ones with near numbers, and their graph."""
    rng = np.random.default_rng(seed)
    v = _unit(np.unique(sample.astype(np.float64), axis=0))
    size = max(1, -(-len(v) // lists))
    todo, done = [np.arange(len(v))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            done.append(rows)
            continue
        side = _split(v[rows], rng)
        todo += [rows[side], rows[~side]]
    points = np.stack([v[r].mean(0) for r in done])
    norms = np.linalg.norm(points, axis=1, keepdims=True)
    points = np.where(norms > 1e-9, points / np.maximum(norms, 1e-9), v[[r[0] for r in done]]).astype(np.float32)
    for _ in range(ROUNDS if len(points) > 1 else 0):
        points = _refined(points, v.astype(np.float32))
    n = len(points)
    near = min(DEGREE, n)
    graph = np.empty((n, near), np.int32)
    for i in range(0, n, 1024):
        d = points[i : i + 1024] @ points.T
        graph[i : i + 1024] = np.argpartition(-d, near - 1, axis=1)[:, :near]
    if n > near:  # a few far links keep the graph in one piece
        graph[:, -4:] = rng.integers(0, n, (n, 4))
    entries = rng.permutation(n)[: min(n, 16)]
    return Centroids(points, graph, entries)


def walk(c: Centroids, q: np.ndarray, width: int, ratio: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(ids, cosines) of about the `width` nearest centroids of each unit vector, nearest first, and of all that
    `_reach` covers with the ratio.

    Best-first search, in lockstep for a block of vectors.
    """
    n, b = len(c.points), len(q)
    q = q.astype(np.float32)
    width = min(width, n)
    keep = max(width, DEGREE)
    rows = np.arange(b)[:, None]
    ids = np.broadcast_to(c.entries, (b, len(c.entries))).copy()
    cos = q @ c.points[c.entries].T
    seen = np.zeros((b, n), bool)
    seen[rows, ids] = True
    open_ = np.ones(ids.shape, bool)
    while True:
        best = np.where(open_, cos, -np.inf)
        ahead = min(best.shape[1], 4 if ratio == 0 else max(4, ids.shape[1] // 8))
        at = np.argpartition(-best, ahead - 1, axis=1)[:, :ahead]
        live = np.isfinite(best[rows, at])
        if not live.any():
            break
        open_[rows, at] = False
        new = c.graph[ids[rows, at]]
        fresh = ~seen[rows[:, :, None], new] & live[:, :, None]
        new, fresh = new.reshape(b, -1), fresh.reshape(b, -1)
        order = np.argsort(np.where(fresh, new, n), axis=1, kind="stable")
        new, fresh = np.take_along_axis(new, order, 1), np.take_along_axis(fresh, order, 1)
        fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
        most = int(fresh.sum(1).max(initial=0))
        if most:
            order = np.argsort(~fresh, axis=1, kind="stable")[:, :most]
            new, fresh = np.take_along_axis(new, order, 1), np.take_along_axis(fresh, order, 1)
            seen[np.broadcast_to(rows, new.shape)[fresh], new[fresh]] = True
            d = np.where(fresh, np.matmul(c.points[new], q[:, :, None])[:, :, 0], -np.inf)
            ids, cos, open_ = np.concatenate([ids, new], 1), np.concatenate([cos, d], 1), np.concatenate([open_, fresh], 1)
        wanted = keep
        if ratio:
            dist = _distance(cos)
            wanted = max(keep, int((dist <= _reach(dist, ratio)).sum(1).max()))
        if ids.shape[1] > wanted:
            top = np.argpartition(-cos, wanted - 1, axis=1)[:, :wanted]
            ids, cos, open_ = (np.take_along_axis(x, top, 1) for x in (ids, cos, open_))
    top = np.argsort(-cos, axis=1, kind="stable")
    if not ratio:
        top = top[:, :width]
    return np.take_along_axis(ids, top, 1), np.take_along_axis(cos, top, 1)


def _distance(cos: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * cos))


def _reach(d: np.ndarray, ratio: float) -> np.ndarray:
    """How far the lists may be that a query reads, of distances to lists in any order."""
    n = min(ANCHOR, d.shape[1]) - 1
    return (1 + ratio) * np.partition(d, n, axis=1)[:, n : n + 1]


def _lists_of(c: Centroids, v: np.ndarray) -> list[list[int]]:
    """The lists that hold each vector: the nearest, and others nearly as near in other directions."""
    ids, cos = walk(c, v, 2 * REPLICAS)
    d = _distance(cos)
    near = (d <= (1 + EPSILON) * d[:, :1]) & np.isfinite(cos)
    # how far the candidates are from the nearest list: further than from the vector means another direction
    apart = _distance(np.matmul(c.points[ids], c.points[ids[:, 0]][:, :, None])[:, :, 0]) > 0.9 * d
    out = []
    for i in range(len(v)):
        taken = [int(ids[i, 0])]
        for j in np.flatnonzero(near[i] & apart[i]):
            if len(taken) < REPLICAS and j and (len(taken) == 1 or (_distance(c.points[taken[1:]] @ c.points[ids[i, j]]) > d[i, j] * 0.9).all()):
                taken.append(int(ids[i, j]))
        out.append(taken)
    return out


def _lists_for(c: Centroids, q: np.ndarray, ratio: float) -> list[np.ndarray]:
    ids, cos = walk(c, q, 1, ratio)
    d = _distance(cos)
    near = (d <= _reach(d, ratio)) & np.isfinite(cos)
    return [ids[i][near[i]] for i in range(len(q))]


def valid(vector: Column) -> Column:
    """Vectors that take part: not null, with finite components and not zero."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(ok & F.exists(vector, lambda x: x != 0), F.lit(False))


class _Block:
    """The vectors of one block, by list, and the nearest of queries among them."""

    def __init__(self, lists: np.ndarray, ids: np.ndarray, marks: np.ndarray, v: np.ndarray, k: int):
        # rows that agree in list, id and vector once; and of copies of a vector in a list no more than can count
        _, copy = np.unique(v, axis=0, return_inverse=True)
        order = np.lexsort((marks, ids, copy.ravel(), lists))
        keys = np.stack([lists[order], copy.ravel()[order]])
        again = np.r_[False, (keys[:, 1:] == keys[:, :-1]).all(0)]
        same = again & np.r_[False, (ids[order][1:] == ids[order][:-1]) & (marks[order][1:] == marks[order][:-1])]
        order, again = order[~same], again[~same]
        start = np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))
        order = order[np.arange(len(order)) - start <= k]
        self.lists, self.ids, self.marks, self.v, self.k = lists[order], ids[order], marks[order], v[order], k
        self.norms = np.sqrt((self.v * self.v).sum(1))
        found, at = np.unique(self.lists, return_index=True)
        self.runs = {int(x): (int(s), int(e)) for x, s, e in zip(found, at, [*at[1:], len(order)], strict=True)}

    def nearest(self, q_ids: np.ndarray, q_marks: np.ndarray, q: np.ndarray, asked: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, float]]:
        """(query, its mark, id, mark, score) of the k nearest of each query in the lists that it asks for."""
        most = 2 * self.k + 2  # by scores that may be off by rounding: fewer than k better ones, and all copies at the end
        score = np.full((len(q), most), -np.inf)
        at = np.full((len(q), most), -1)
        who: dict[int, list[int]] = {}
        for i, lists in enumerate(asked):
            for x in lists:
                who.setdefault(int(x), []).append(i)
        norms = np.sqrt((q * q).sum(1))
        for x, rows in who.items():
            s, e = self.runs.get(x, (0, 0))
            if s == e:
                continue
            rows_ = np.array(rows)
            fast = (q[rows_] @ self.v[s:e].T) / (self.norms[s:e] * norms[rows_, None])
            fast[(q_ids[rows_, None] == self.ids[s:e]) & (q_marks[rows_, None] == self.marks[s:e])] = -np.inf
            both = np.concatenate([score[rows_], fast], 1)
            top = np.argpartition(-both, most - 1, axis=1)[:, :most]
            score[rows_] = np.take_along_axis(both, top, 1)
            at[rows_] = np.where(top < most, np.take_along_axis(at[rows_], np.minimum(top, most - 1), 1), top - most + s)
        for i in range(len(q)):
            some = np.unique(at[i][np.isfinite(score[i])])
            # the same operations in the same order for every pair, so that ties are ties
            exact = (self.v[some] * q[i]).sum(1) / (self.norms[some] * norms[i])
            taken: set[tuple[int, int]] = set()
            for j in np.lexsort((self.marks[some], self.ids[some], -exact)):
                row = int(self.ids[some[j]]), int(self.marks[some[j]])
                if row not in taken and len(taken) < self.k:  # a vector in two lists
                    taken.add(row)
                    yield int(q_ids[i]), int(q_marks[i]), *row, float(exact[j])


def search(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5, ratio: float = RATIO) -> DataFrame:
    """(query_id, rank, <key>, score): the k nearest found of each query row among all other rows."""
    spark, k_ = df.sparkSession, k
    ensure_checkpoint_dir(spark)
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where(F.col("id").isNotNull() & valid(F.col("v"))).withColumn("mark", F.xxhash64("v"))
    schema = f"query_id long, rank int, `{key}` long, score double"
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return spark.createDataFrame([], schema)
    dim, lists = size["d"], max(1, min(MAX_CENTROIDS, size["count"] // LIST))
    sample = rows.where(F.size("v") == dim).select("id", "v").orderBy(F.xxhash64("id"), "id").limit(min(MAX_SAMPLE, SAMPLED * lists)).select("v").toArrow()
    points = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in sample["v"].chunks]).reshape(-1, dim)
    shared = spark.sparkContext.broadcast(fit_centroids(points, lists))
    kind = rows.schema["v"].dataType.simpleString()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each vector once for each of its lists, each query once for each group of its lists."""
        c = shared.value
        step = max(1, min(1024, 40_000_000 // max(1, len(c.points))))
        for batch in batches:
            for start in range(0, len(batch), step):
                part = batch.iloc[start : start + step]
                ids, marks, vs, asked = part["id"].to_numpy(), part["mark"].to_numpy(), part["v"].to_numpy(), part["q"].to_numpy(bool)
                sizes = np.array([len(v) for v in vs])
                out: list[tuple] = []

                def ask(i: int, lists: np.ndarray, ids=ids, marks=marks, vs=vs, out=out) -> None:
                    for g in np.unique(lists // GROUP):
                        out.append((int(g), int(ids[i]), int(marks[i]), vs[i], lists[lists // GROUP == g].tolist(), True))

                usual = np.flatnonzero(sizes == dim)
                if len(usual):
                    u = _unit(np.stack(vs[usual]).astype(np.float64))
                    for i, found in zip(usual.tolist(), _lists_of(c, u), strict=True):
                        out += [(x // GROUP, int(ids[i]), int(marks[i]), vs[i], [x], False) for x in found]
                    mine = asked[usual]
                    if mine.any():
                        for i, found in zip(usual[mine].tolist(), _lists_for(c, u[mine], ratio), strict=True):
                            ask(i, found)
                for i in np.flatnonzero(sizes != dim).tolist():  # a list, and group, for each other length
                    own = -1 - int(sizes[i])
                    out.append((own, int(ids[i]), int(marks[i]), vs[i], [own], False))
                    if asked[i]:
                        out.append((own, int(ids[i]), int(marks[i]), vs[i], [own], True))
                yield pd.DataFrame(out, columns=["grp", "id", "mark", "v", "lists", "q"])

    placed = rows.select("id", "mark", "v", "q").mapInPandas(place, f"grp int, id long, mark long, v {kind}, lists array<int>, q boolean").checkpoint()  # posting lists and their queries, written once
    sizes = placed.where(~F.col("q")).groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = placed.join(F.broadcast(sizes), "grp")  # at most MAX_CENTROIDS / GROUP rows, and the other lengths
    postings = placed.where(~F.col("q")).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    queries = placed.where("q").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = postings.unionByName(queries).select("grp", "block", "q", "id", "mark", "v", "lists").repartition("grp", "block").sortWithinPartitions("grp", "block", "q")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Block by block, its vectors before its queries."""
        key, held, block = None, [], None
        for batch in batches:
            if not len(batch):
                continue
            g = batch[["grp", "block", "q"]].to_numpy(np.int64)
            starts = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]).any(axis=1)])
            for s, e in zip(starts, [*starts[1:], len(batch)], strict=True):
                part = batch.iloc[s:e]
                if key is None or (g[s, :2] != key).any():
                    key, held, block = g[s, :2], [], None
                if not g[s, 2]:
                    held.append(part)
                    continue
                if not held:
                    continue
                if block is None:
                    every = pd.concat(held)
                    block = _Block(np.array([x[0] for x in every["lists"]]), every["id"].to_numpy(), every["mark"].to_numpy(), np.stack(every["v"].to_numpy()).astype(np.float64), k_)
                for start in range(0, len(part), QUERIES):
                    some = part.iloc[start : start + QUERIES]
                    found = block.nearest(some["id"].to_numpy(), some["mark"].to_numpy(), np.stack(some["v"].to_numpy()).astype(np.float64), list(some["lists"]))
                    yield pd.DataFrame(list(found), columns=["query_id", "query_mark", "id", "mark", "score"])

    found = dealt.mapInPandas(scan, "query_id long, query_mark long, id long, mark long, score double")
    best = found.groupBy("query_id", "query_mark").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("s"), "id", "mark"))), 1, k).alias("x"))
    return best.select("query_id", F.posexplode("x").alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.id").alias(key), (-F.col("x.s")).alias("score"))

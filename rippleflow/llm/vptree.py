"""Nearest neighbours by vantage-point trees, one per shard.

Vectors are scaled to length one, where the largest cosine is the least Euclidean distance, and
dealt into shards by a hash, as many as keep a shard within ``SHARD_ROWS`` vectors. Each shard
builds a tree of spheres: a vantage point, and the median distance to it that halves the rest. Every
query goes to every shard. A branch is left out if the triangle inequality says that the sphere is
farther than the k-th best so far, with that distance divided by a factor: factor one keeps the
search exact, a larger one prunes more. Queries go down a tree together, in blocks.

Equal vectors are one point of the tree with a list of ids, so copies cost no depth, and all ids
that can be among the best are kept. Found vectors are scored again by the cosine of the original
vectors, in double precision and in a fixed order of additions.

Memory is bounded by a shard and a block of queries. Queries are moved to shards as rows, once per
shard, which is the size of the result before the best are chosen.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no
part, as query or candidate; a query is only compared with vectors of its length; rows that share
an id are each a candidate for the others' queries but not for their own id; fewer candidates than
k give fewer rows; ties go to the smaller id; rows without id take no part; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rippleflow.llm.common import arrow_schema

SHARD_ROWS = 20_000
LEAF = 256
QUERY_BLOCK = 512
#: Distances this close are taken as equal while searching; exact scores decide later. The root of
#: ``2 - 2 ab`` is off by some 3e-8 for nearly parallel vectors.
CLOSE = 2e-7


@dataclass
class Node:
    """A leaf holds points; a branch holds a vantage point and what lies in and out of its sphere."""

    points: np.ndarray
    radius: float = 0.0
    inside: Node | None = None
    outside: Node | None = None


def build(vectors: np.ndarray, points: np.ndarray, rng: np.random.Generator,
          leaf: int = LEAF) -> Node:
    if len(points) <= leaf:
        return Node(points)
    # of a few candidates, the point from which distances spread most
    picks = rng.choice(len(points), min(8, len(points)), replace=False)
    trial = points[rng.choice(len(points), min(256, len(points)), replace=False)]
    spread = distances(vectors[points[picks]], vectors[trial]).var(axis=1)
    best = picks[int(np.argmax(spread))]
    vantage, rest = points[best:best + 1], np.delete(points, best)
    far = distances(vectors[vantage], vectors[rest])[0]
    radius = float(np.median(far))
    near = far <= radius
    if near.all():  # many points at one distance
        near[len(near) // 2:] = False
        radius = float(far.max())
    return Node(vantage, radius, build(vectors, rest[near], rng, leaf),
                build(vectors, rest[~near], rng, leaf))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


class Search:
    """The nearest ``k`` points of a block of queries, with all that tie."""

    def __init__(self, vectors: np.ndarray, queries: np.ndarray, k: int, factor: float):
        self.vectors, self.queries, self.factor = vectors, queries, factor
        self.best = np.full((len(queries), k), np.inf)
        self.seen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def offer(self, who: np.ndarray, points: np.ndarray) -> np.ndarray:
        d = distances(self.queries[who], self.vectors[points])
        k = self.best.shape[1]
        both = np.concatenate([self.best[who], d], axis=1)
        self.best[who] = np.partition(both, k - 1, axis=1)[:, :k] if both.shape[1] > k else both
        row, column = np.nonzero(d <= self.reach(who)[:, None] + CLOSE)
        self.seen.append((who[row], points[column], d[row, column]))
        return d

    def reach(self, who: np.ndarray) -> np.ndarray:
        return self.best[who].max(axis=1)

    def visit(self, node: Node, who: np.ndarray) -> None:
        if not len(who) or not len(node.points):
            return
        d = self.offer(who, node.points)
        if node.inside is None:
            return
        gap = d[:, 0] - node.radius
        for near in (True, False):  # queries inside the sphere look inside first
            side = gap <= 0 if near else gap > 0
            some, own = who[side], np.abs(gap[side])
            first, second = (node.inside, node.outside) if near else (node.outside, node.inside)
            self.visit(first, some)
            self.visit(second, some[own <= self.reach(some) / self.factor + CLOSE])

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.seen:
            return np.array([], int), np.array([], int)
        who, point, d = (np.concatenate(x) for x in zip(*self.seen))
        keep = d <= self.reach(who) + CLOSE
        return who[keep], point[keep]


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products added up component by component, the same in any engine."""
    return np.cumsum(a * b, axis=1)[:, -1]


class Shard:
    """The tree over one shard's vectors."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, k: int, factor: float, seed: int):
        unit = raw / np.sqrt((raw * raw).sum(axis=1))[:, None]
        order = np.lexsort((ids, *raw.T[::-1]))
        raw, ids = raw[order], ids[order]
        new = np.ones(len(ids), bool)
        new[1:] = (raw[1:] != raw[:-1]).any(axis=1)
        self.start = np.flatnonzero(new)
        self.end = np.append(self.start[1:], len(ids))
        self.ids, self.raw, self.unit = ids, raw[self.start], unit[order][self.start]
        self.k, self.factor = k, factor
        self.tree = build(self.unit, np.arange(len(self.start)), np.random.default_rng(seed))

    def search(self, names: np.ndarray, raw: np.ndarray):
        """(query id, vector id, score) of the best ``k`` per query, itself not counted."""
        unit = raw / np.sqrt((raw * raw).sum(axis=1))[:, None]
        # one more than k, as the query itself may be a point
        run = Search(self.unit, unit, self.k + 1, self.factor)
        run.visit(self.tree, np.arange(len(names)))
        who, point = run.found()
        q, v = raw[who], self.raw[point]
        score = dot(q, v) / (np.sqrt(dot(q, q)) * np.sqrt(dot(v, v)))
        out = []
        order = np.lexsort((-score, who))
        who, point, score = who[order], point[order], score[order]
        for a, b in zip(*(lambda e: (e[:-1], e[1:]))(np.searchsorted(who, np.arange(len(names) + 1)))):
            best = []
            for p, s in zip(point[a:b].tolist(), score[a:b].tolist()):
                if len(best) >= self.k and s < best[-1][0]:
                    break
                ids = self.ids[self.start[p]:self.end[p]]
                ids = ids[ids != names[who[a]]][:self.k]  # ids of a point are in order
                best += [(s, i) for i in ids.tolist()]
                best.sort(key=lambda x: (-x[0], x[1]))
                best = best[:self.k]
            out += [(int(names[who[a]]), i, s) for s, i in best]
        return out


def valid_vectors(table: DataFrame) -> DataFrame:
    """(id, vector) in double precision of the rows that take part."""
    vector = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x)
                      & (F.abs(x) < F.lit(float("inf"))))
    return (table.select(F.col("vec_id").cast("long").alias("id"), vector.alias("vector"))
            .where("id IS NOT NULL AND vector IS NOT NULL").where(finite)
            .where(F.exists("vector", lambda x: x != 0)))


def nearest(table: DataFrame, every: int = 50, k: int = 5, factor: float = 1.0,
            shard_rows: int = SHARD_ROWS, seed: int = 3) -> DataFrame:
    """The ``k`` nearest vectors of each query (ids divisible by ``every``): query_id, rank, vec_id,
    score (cosine)."""
    rows = valid_vectors(table)
    shards = max(1, math.ceil(rows.count() / shard_rows))
    size = F.size("vector").alias("size")
    shard = F.pmod(F.xxhash64(F.lit(seed), "id", "vector"), F.lit(shards)).cast("int")
    candidates = rows.select(shard.alias("shard"), size, F.lit(0).alias("role"), "id", "vector")
    queries = rows.where(F.col("id") % every == 0).select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), size,
        F.lit(1).alias("role"), "id", "vector")
    dealt = candidates.union(queries).repartition(shards, "shard", "size").sortWithinPartitions(
        "shard", "size", "role", "id", "vector")
    layout = arrow_schema("query_id long, vec_id long, score double")

    def run(batches):
        key, held, tree, ask = None, [], None, []

        def answers():
            nonlocal tree, held
            if tree is None:
                parts = [h for h in held]
                tree = Shard(np.concatenate([i for i, _ in parts]),
                             np.concatenate([v for _, v in parts]), k, factor, seed)
                held = []
            ids, vectors = (np.concatenate(x) for x in zip(*ask))
            ask.clear()
            for at in range(0, len(ids), QUERY_BLOCK):
                found = tree.search(ids[at:at + QUERY_BLOCK], vectors[at:at + QUERY_BLOCK])
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*found), layout)], schema=layout)

        for batch in batches:
            marks = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
            edges = np.flatnonzero((np.diff(marks, axis=0) != 0).any(axis=1)) + 1
            edges = [0, *edges.tolist(), len(marks)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if tuple(marks[a, :2]) != key:
                    if ask:
                        yield from answers()
                    key, held, tree = tuple(marks[a, :2]), [], None
                part = batch.slice(a, b - a)
                ids = part.column(3).to_numpy()
                vectors = part.column(4).flatten().to_numpy().reshape(len(ids), marks[a, 1])
                if marks[a, 2] == 0:
                    held.append((ids, vectors))
                elif held or tree is not None:
                    ask.append((ids, vectors))
                    if sum(len(i) for i, _ in ask) >= 8 * QUERY_BLOCK:
                        yield from answers()
        if ask:
            yield from answers()

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")

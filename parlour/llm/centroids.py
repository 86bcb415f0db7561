"""Operator 11: centroid clustering by a vantage-point tree over the centroids.

Each round a vantage-point tree is built over the centroids and broadcast; every vector searches it best first,
branch by branch, and passes over a branch only if even its nearest point must lie beyond the best distance found
(a branch at exactly that distance is searched, so that ties come out). Distances are exact integers, ties go to the
smaller number. Each task sums its vectors by cluster; Spark adds up these sums, and the new centroids are exact floors.

Scale: the quantised vectors are written once and read once a round; what is shuffled is k rows of sums a task, what is
collected k * width sums, what is broadcast the tree of k centroids. No vector leaves its task but with its result.
"""

from __future__ import annotations

import hashlib
import math
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlour.llm.common import written

WIDTH, SCALE, K, ROUNDS, SEED = 64, 256, 40, 5, 2
LEAF = 4  # centroids of a leaf, at most
EXACT_FLOAT = 1 << 53  # integers below it are exact in floating point


class VantageTree:
    """``nodes``: ("leaf", numbers) or ("split", number, [(child, nearest, farthest), ...]), the root being node 0;
    nearest and farthest bound the distances from the vantage centroid to the centroids below the child."""

    def __init__(self, centroids: list[list[int]]):
        self.points = centroids
        self.nodes: list[tuple] = []
        if centroids:
            self._build(list(range(len(centroids))))
        self.most = max((abs(x) for c in centroids for x in c), default=0)

    def _distance(self, i: int, j: int) -> int:
        return sum((a - b) ** 2 for a, b in zip(self.points[i], self.points[j]))

    def _build(self, members: list[int]) -> int:
        at = len(self.nodes)
        self.nodes.append(("leaf", members))
        if len(members) > LEAF:
            vantage, rest = members[0], members[1:]
            far = sorted((self._distance(vantage, i), i) for i in rest)
            half = len(far) // 2
            children = []
            for part in (far[:half], far[half:]):
                child = self._build([i for _, i in part])
                children.append((child, _root_below(part[0][0]), _root_above(part[-1][0])))
            self.nodes[at] = ("split", vantage, children)
        return at


def _root_below(x: int) -> float:
    return math.sqrt(x) * (1 - 1e-14)


def _root_above(x: int) -> float:
    return math.sqrt(x) * (1 + 1e-14)


def _distances(q: np.ndarray, norms: np.ndarray, points: np.ndarray, exact: bool) -> np.ndarray:
    """Squared distances of the rows of ``q`` to ``points``: whole numbers below 2**53 if ``exact``, else Python's integers."""
    if exact:
        return norms[:, None] - 2 * (q @ points.T) + (points * points).sum(1)[None, :]
    return np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(r, p)) for p in points] for r in q], object).reshape(len(q), len(points))


def nearest(q: np.ndarray, tree: VantageTree) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the centroid nearest to each row of integers ``q``: every row follows its own
    best-first order through the tree, all rows of one node being worked on together."""
    n, width = q.shape
    most = max(int(np.abs(q).max(initial=0)), tree.most)
    exact = 4 * width * most * most < EXACT_FLOAT
    kind = np.float64 if exact else object
    rows, points = q.astype(kind), np.array(tree.points, kind).reshape(-1, width)
    norms = (rows * rows).sum(1) if exact else np.zeros(n)
    best, number = np.full(n, np.inf, kind), np.full(n, len(points))
    bound = np.full((n, len(tree.nodes)), np.inf)  # lower bounds of the branches that wait; infinite: not waiting
    bound[:, 0] = 0
    live = np.arange(n)
    while len(live):
        node = bound[live].argmin(1)
        least = bound[live, node]
        radius = np.sqrt(best[live].astype(np.float64)) * (1 + 1e-12)
        go = (least <= radius) & np.isfinite(least)  # inclusive: a tie on the edge is searched
        live, node = live[go], node[go]
        bound[live, node] = np.inf
        for k in np.unique(node):
            at, (what, own, *children) = live[node == k], tree.nodes[k]
            numbers = np.array([own] if what == "split" else own)
            d = _distances(rows[at], norms[at], points[numbers], exact)
            first = d.argmin(1)  # numbers of a leaf need not ascend: the smallest of equal ones is taken below
            found = d[np.arange(len(at)), first]
            which = np.where(d == found[:, None], numbers[None, :], len(points)).min(1)
            better = (found < best[at]) | ((found == best[at]) & (which < number[at]))
            best[at[better]], number[at[better]] = found[better], which[better]
            if what == "split":
                away = np.sqrt(d[:, 0].astype(np.float64))
                for child, low, high in children[0]:
                    gap = np.maximum(low - away * (1 + 1e-14), away * (1 - 1e-14) - high)
                    bound[at, child] = np.maximum(gap, 0)
    if len(best) and int(best.max()) >= 1 << 63:
        raise OverflowError("a squared distance does not fit a long")
    return number, best.astype(np.int64)


def _batches(stream: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for b in stream:
        if b.num_rows:
            yield b.column(0), b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(id, q): the vectors of exactly ``width`` components, none null or not finite, as integers floor(scale * x)."""
    v = F.col("v")
    whole = (F.size("v") == width) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    number = lambda x: F.when(F.abs(x) < 2.0**50, F.floor(x.cast("double") * scale)).otherwise(F.raise_error(F.lit("a component is too large for whole numbers")).cast("long"))
    return (embeddings.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter(v.isNotNull()).filter(whole)
            .select("id", F.transform("v", number).alias("q")))


def first_centroids(kept: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors of least hash of "seed:id"; of equal identifiers the lesser vector comes first."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return [list(r["q"]) for r in kept.orderBy(name, "q").limit(k).collect()]


def next_centroids(kept: DataFrame, centroids: list[list[int]], width: int) -> list[list[int]]:
    """One round: componentwise floor(sum / count) of each centroid's vectors; those without any stay."""
    tree = kept.sparkSession.sparkContext.broadcast(VantageTree(centroids))

    def sums(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), width), object)
        count = np.zeros(len(centroids), np.int64)
        for _, q in _batches(stream, width):
            number, _ = nearest(q, tree.value)
            order = np.argsort(number, kind="stable")
            starts = np.flatnonzero(np.diff(number[order], prepend=-1))
            total[number[order][starts]] += np.add.reduceat(q[order], starts).astype(object)
            count += np.bincount(number, minlength=len(centroids))
        hit = np.flatnonzero(count)
        if len(hit):
            yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(count[hit]), pa.array(total[hit].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "s"])

    parts = kept.mapInArrow(sums, "cluster int, n long, s array<bigint>")
    got = (parts.select("cluster", "n", F.posexplode("s").alias("at", "s")).groupBy("cluster", "at")
           .agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())
    tree.unpersist()
    out = [list(c) for c in centroids]
    for r in got:
        out[r["cluster"]][r["at"]] = int(r["s"]) // r["n"]
    return out


def cluster(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int = WIDTH, scale: int = SCALE,
            k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance) of every kept vector, written to the shared folder, and the final centroids.

    Vectors that are null, of another width, or hold a null, NaN or infinity are left out. A null identifier hashes as the
    empty text and is carried along; repeated rows count as often as they occur, also among the first centroids (of which
    there are fewer than ``k`` if fewer vectors are kept). An empty table gives no rows and no centroids. Other columns
    play no part, whatever their names. Components of 2**50 and beyond, or a squared distance beyond a long, are an error."""
    kept = written(vectors(embeddings, id_col, vector_col, width, scale), "op11-vectors")
    centroids = first_centroids(kept, k, seed)
    if centroids:
        for _ in range(rounds):
            centroids = next_centroids(kept, centroids, width)
    tree = kept.sparkSession.sparkContext.broadcast(VantageTree(centroids))
    kind = dict(kept.dtypes)["id"]

    def assign(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, q in _batches(stream, width):
            number, distance = nearest(q, tree.value)
            yield pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    return written(kept.mapInArrow(assign, f"id {kind}, cluster int, distance long"), "op11-assigned"), centroids


def cluster_report(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """One row per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256. The k rows of facts about
    the clusters go by way of the driver."""
    spark = assigned.sparkSession
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    facts = pd.DataFrame([(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in sums.items()],
                         columns=["cluster", "cluster_inertia", "inertia", "centroid_sha256"])
    table = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

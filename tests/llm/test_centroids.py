"""Operator 11 against a plain search over all centroids."""

import hashlib
import random

import numpy as np
import pytest

from parlour.llm.centroids import VantageTree, cluster, cluster_report, nearest


def brute(rows, width, scale, k, rounds):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centroids = [q for _, q in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    nearest_of = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        at = [nearest_of(q)[1] for _, q in kept]
        for j in range(len(centroids)):
            own = [q for (_, q), a in zip(kept, at) if a == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    out = [(i, *nearest_of(q)) for i, q in kept]
    total = sum(d for _, d, _ in out)
    return sorted([(i, j, d, sum(e for _, e, h in out if h == j), total, hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest())
                   for i, d, j in out], key=repr)


def run(spark, rows, width, scale, k, rounds):
    df = spark.createDataFrame([(i, v, "a", 7) for i, v in rows], "vec_id long, embedding array<float>, id string, cluster int")
    assigned, centroids = cluster(df, width=width, scale=scale, k=k, rounds=rounds)
    return sorted([tuple(r) for r in cluster_report(assigned, centroids).collect()], key=repr)


def test_equals_plain_search(spark):
    rng = random.Random(5)
    rows = [(i, [float(np.float32(rng.gauss(0, 0.2))) for _ in range(8)]) for i in range(300)]
    assert run(spark, rows, 8, 256, 12, 5) == brute(rows, 8, 256, 12, 5)


def test_ties_copies_and_unusable_vectors(spark):
    rng = random.Random(6)
    rows = [(i, [float(rng.randrange(-2, 3)) for _ in range(2)]) for i in range(120)]  # very many ties
    rows += [(1000 + i, [1.0, 1.0]) for i in range(80)] + [rows[3], rows[3], (None, [2.0, -2.0])]
    rows += [(2000, None), (2001, []), (2002, [1.0]), (2003, [1.0, None]), (2004, [float("nan"), 1.0]), (2005, [float("inf"), 1.0]), (2006, [1.0, 2.0, 3.0])]
    assert run(spark, rows, 2, 1, 20, 5) == brute(rows, 2, 1, 20, 5)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, [-1.0, 3.0])]
    assert run(spark, rows, 2, 256, 40, 5) == brute(rows, 2, 256, 40, 5)
    assert run(spark, [], 2, 256, 40, 5) == []


@pytest.mark.parametrize("most", [3, 1000, 1 << 28])
def test_tree_search_is_exact(most):
    rng = np.random.default_rng(most)
    points = rng.integers(-most, most + 1, (50, 3)).tolist()
    q = rng.integers(-most, most + 1, (400, 3))
    number, distance = nearest(q, VantageTree(points))
    for r, j, d in zip(q.tolist(), number, distance):
        assert min((sum((a - b) ** 2 for a, b in zip(r, p)), i) for i, p in enumerate(points)) == (d, j)


def test_distance_beyond_a_long_is_an_error():
    with pytest.raises(OverflowError):
        nearest(np.array([[1 << 40, 0]]), VantageTree([[-(1 << 40), 0]]))

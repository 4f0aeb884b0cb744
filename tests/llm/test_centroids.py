"""Clusters against a plain loop over whole numbers, and the query against its SQL."""

import hashlib
import math

import numpy as np
import pytest

from siteloom.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster string, v string"
LONG = 2**63 - 1


def plain(rows, width, k, rounds, seed=2):
    own = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v])
        for i, v in rows
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)
    ]

    def order(row):
        none = row[0] is None
        return none, "" if none else hashlib.sha256(f"{seed}:{row[0]}".encode()).hexdigest(), row[1]

    middle = [v for _, v in sorted(own, key=order)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(middle)) for _, v in own]

    for _ in range(rounds):
        found = assign()
        for j in range(len(middle)):
            mine = [v for (_, v), (_, at) in zip(own, found, strict=True) if at == j]
            if mine:
                middle[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = assign()
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    cut = [min(d, LONG) for d, _ in found]
    inertia = [min(sum(d for d, (_, at) in zip(cut, found, strict=True) if at == j), LONG) for j in range(len(middle))]
    total = min(sum(cut), LONG)
    return sorted(
        ((i, j, d, inertia[j], total, names[j]) for (i, _), (_, j), d in zip(own, found, cut, strict=True)), key=repr
    )


def run(spark, rows, width, k=5, rounds=3, parts=3):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA).repartition(parts)
    got = centroids.cluster(df, width, k, rounds).collect()
    return sorted((tuple(r) for r in got), key=repr)


def vectors(seed, n, width=6):
    rng = np.random.default_rng(seed)
    return [(int(i), (rng.normal(size=width) * rng.choice([0.1, 1, 5])).tolist()) for i in range(n)]


@pytest.mark.parametrize("block", [2048, 7])
def test_nearest(monkeypatch, block):
    monkeypatch.setattr(centroids, "BLOCK", block)
    rng = np.random.default_rng(5)
    for scale in (3, 2**20, 2**40):
        rows = rng.integers(-scale, scale, (50, 4)).astype(object if scale > 2**27 else np.int64)
        middle = rng.integers(-scale, scale, (9, 4)).tolist() + [rows[0].tolist()] * 2
        got = centroids.nearest(rows, middle)
        want = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(middle)) for v in rows.tolist()]
        assert list(zip(got[1].tolist(), got[0].tolist(), strict=True)) == want


def test_against_a_plain_loop(spark):
    rows = vectors(1, 200)
    rows += [(300 + i, rows[3][1]) for i in range(90)]  # a common vector
    assert run(spark, rows, 6) == plain(rows, 6, 5, 3)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(2, 20, 2)
    rows += [(20, None), (21, [1.0, None]), (22, [nan, 0.0]), (23, [inf, 1.0]), (24, []), (25, [1.0]), (26, [1.0, 2.0, 3.0])]
    rows += [(None, [0.5, 0.5]), (None, [0.25, -0.5]), (3, [9.0, 9.0]), (3, [9.0, 9.0]), (3, [-0.001, 0.0])]
    assert run(spark, rows, 2) == plain(rows, 2, 5, 3)
    assert run(spark, rows, 2, k=60) == plain(rows, 2, 60, 3)  # every vector a start


def test_ties_and_empty_centroids(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(12)]  # equal starts
    assert run(spark, rows, 2, k=6) == plain(rows, 2, 6, 3)
    rows = [(0, [0.0]), (1, [1.0]), (2, [0.5])]
    assert run(spark, rows, 1, k=2, rounds=0) == plain(rows, 1, 2, 0)


def test_huge_numbers(spark):
    rows = vectors(3, 10, 2) + [(50, [3e38, -3e38]), (51, [3e38, 2.0]), (52, [1e9, -1e9]), (53, [2e5, 1.0])]
    assert run(spark, rows, 2) == plain(rows, 2, 5, 3)
    assert run(spark, rows, 2, k=1, rounds=1) == plain(rows, 2, 1, 1)


def test_nothing(spark):
    assert run(spark, [], 2) == [] and run(spark, [(1, None)], 2) == []

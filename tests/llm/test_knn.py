import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteloom.llm import knn


def plain_top(rows, k, is_query):
    fine = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, q in fine:
        if not is_query(i):
            continue
        # Scores are cut to a long first; equal ones then go by id.
        whole = ((sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in fine if j != i)
        scored = sorted((-max(min(s, 2**63 - 1), -(2**63)), j) for s, j in whole)
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<float>, score string"


def run(spark, rows, every, k=5):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    got = knn.top_k(df, F.col("vec_id") % every == 0, k).collect()
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got)


def vectors(seed, n, width=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width)) * 2
    return [(int(i), (centres[i % 6] + rng.normal(size=width) * rng.choice([0.1, 1])).tolist()) for i in range(n)]


@pytest.mark.parametrize("blocks", [(8192, 2048), (16, 4)])
def test_against_all_pairs(spark, monkeypatch, blocks):
    monkeypatch.setattr(knn, "BLOCK", blocks[0])
    monkeypatch.setattr(knn, "QUERY_BLOCK", blocks[1])
    monkeypatch.setattr(knn, "ANCHORS", 40)
    rows = vectors(1, 300)
    rows += [(300 + i, rows[7][1]) for i in range(60)]  # a common vector: ties by id
    assert run(spark, rows, 7) == plain_top(rows, 5, lambda i: i % 7 == 0)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(2, 12, 3)
    rows += [(20, None), (30, [1.0, None]), (40, [nan]), (50, [inf, 1.0]), (60, [-inf]), (None, [1.0])]
    rows += [(70, []), (71, [2.0]), (72, [0.5, -0.25, 1.0, 4.0]), (10, rows[3][1]), (10, rows[3][1]), (74, [-0.001])]
    rows += [(80, [3e38, -3e38]), (81, [3e38]), (82, [-3e38])]
    assert run(spark, rows, 10) == plain_top(rows, 5, lambda i: i % 10 == 0)


def test_few_and_no_candidates(spark):
    rows = vectors(3, 3)
    assert run(spark, rows, 1) == plain_top(rows, 5, lambda i: True)
    assert run(spark, rows[:1], 1) == [] and run(spark, [], 1) == []
    assert run(spark, [(1, []), (2, []), (0, [])], 2) == [(0, 1, 1, 0), (0, 2, 2, 0), (2, 1, 0, 0), (2, 2, 1, 0)]
    assert run(spark, rows, 100) == plain_top(rows, 5, lambda i: i == 0)


def cells_left_out(spark, rows, every):
    """Share of pairs of a query and a cell that is not its home which the bounds leave out."""
    points = knn.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    how = knn.plan(points)
    celled = knn._celled(points, how).withColumn("row", F.col("vec_id")).cache()
    queries = celled.filter(F.col("vec_id") % every == 0)
    home = knn._ranked(knn._met(queries.select("row", "vec_id", "v", "cell"), celled, how.width, 5), 5)
    bounds = home.groupBy("row").agg(F.when(F.count("*") == 5, F.min("score")).alias("bound"))
    away = knn._away(queries.join(bounds, "row", "left"), how, knn.extent(celled, how), 5)
    sent = away.groupBy("row").agg(F.count("*").alias("n"), F.countDistinct("cell").alias("d")).collect()
    assert all(r.n == r.d < len(how.pivots) for r in sent)
    return 1 - sum(r.n for r in sent) / (queries.count() * (len(how.pivots) - 1))


def test_queries_go_to_cells_in_reach_only(spark):
    rng = np.random.default_rng(4)
    centres = np.eye(16) * 8
    rows = [(i, (centres[i % 16] + rng.normal(size=16) * 0.05).tolist()) for i in range(800)]
    assert cells_left_out(spark, rows, 10) > 0.9


def test_candidates_move_once_a_pass(spark):
    """A block is copied only where too many queries ask for it."""
    rows = [(i, v, "x") for i, v in vectors(5, 400)]
    points = knn.quantised(spark.createDataFrame(rows, SCHEMA))
    how = knn.plan(points)
    celled = knn._celled(points, how).withColumn("row", F.col("vec_id"))
    asked = celled.select("row", "vec_id", "v", "cell")
    asked = asked.unionByName(asked.withColumn("row", F.col("row") + 1000))
    per_block = knn._met(asked, celled, how.width, 1)
    assert per_block.count() == 800  # one block a cell, and one answer of it for every query

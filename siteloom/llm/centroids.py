"""Centroid clustering of whole-number vectors, with distances from scalar lookup tables.

Vectors are quantised to whole numbers and written out once. A round reads them in batches: for every
dimension the whole numbers that occur in the batch are tabulated against all centroids, one squared
difference each, and the distances of the batch are gathers from these tables, summed up over the
dimensions. Tables hold no more rows than their batch has vectors, whatever the numbers are. A round
returns counts and componentwise sums per centroid, added up within the task first and then by Spark;
the driver gets one row per centroid, dimension and digit group, none per vector.

Sums are kept in digit groups of 40 bits, so they are exact whatever the vectors hold. Distances beyond the
range of a long are cut to it, sums of them as well.

Vectors that are null, of another length, or hold null or not finite components take no part. Starts
are the vectors with the smallest hash of the id; ties in the hash (repeated ids) go by the vector. A null id
is hashed as none and comes last. With fewer vectors than centroids every vector is a start; equal
starts leave all but the first of them without vectors, where they stay as they are. A vector at equal
distances goes to the smaller number. An empty table gives an empty result. Other columns are not read,
unless they are carried on; repeated rows count each."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.session import cut_lineage

SCALE = 256
CENTROIDS = 40
ROUNDS = 5
#: Vectors whose distances to all centroids are held at a time.
BLOCK = 2048
_DIGITS = 40
_LONG = 2**63 - 1


def quantised(vectors: DataFrame, width: int, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id`` and ``v``, whole numbers as doubles, of the vectors that take part."""
    x = F.col(vector)
    fine = (F.size(x) == width) & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))
    )
    # Doubles from 2^53 on are whole, and may be beyond a long.
    whole = F.transform(
        x,
        lambda c: F.when(F.abs(c.cast("double") * SCALE) < float(2**53), F.floor(c.cast("double") * SCALE).cast("double"))
        .otherwise(c.cast("double") * SCALE),
    )
    return vectors.filter(x.isNotNull() & fine).select(F.col(id).cast("long").alias("vec_id"), whole.alias("v"))


def starts(points: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The first centroids: at most ``k`` rows."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = points.orderBy(name.asc_nulls_last(), "v").limit(k).collect()
    return [[int(x) for x in r.v] for r in rows]


def _whole(lists: pa.Array, width: int) -> np.ndarray:
    """Vectors as longs, or as Python's whole numbers where squares could leave a long."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if not len(flat) or np.abs(flat).max() < 2**27:
        return flat.astype(np.int64).reshape(-1, width)
    return np.array([int(x) for x in flat.tolist()], dtype=object).reshape(-1, width)


def _table(values: np.ndarray, centroids: list[int]) -> np.ndarray:
    """Squared differences of whole numbers (rows) and one component of the centroids (columns)."""
    own = np.array(centroids, dtype=object)
    if values.dtype != object and (not len(own) or max(map(abs, centroids)) < 2**27):
        own = own.astype(np.int64)
    return (values[:, None] - own[None, :]) ** 2


def nearest(vectors: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest centroid."""
    n, width = vectors.shape
    cluster, distance = np.empty(n, dtype=np.int32), np.empty(n, dtype=vectors.dtype)
    tables = []
    for d in range(width):
        values, code = np.unique(vectors[:, d], return_inverse=True)
        tables.append((_table(values, [c[d] for c in centroids]), code))
    if any(t.dtype == object for t, _ in tables):
        tables = [(t.astype(object), code) for t, code in tables]
        distance = distance.astype(object)
    for at in range(0, n, BLOCK):
        part = slice(at, min(at + BLOCK, n))
        total = np.zeros((part.stop - at, len(centroids)), dtype=distance.dtype)
        for table, code in tables:
            total += table[code[part]]
        best = total.argmin(axis=1)  # the first of equal ones
        cluster[part] = best
        distance[part] = total[np.arange(len(best)), best]
    return cluster, distance


def _digit_groups(number: int) -> list[int]:
    """Groups of 40 bits, lowest first, all with the sign of the number."""
    sign, rest, out = (-1 if number < 0 else 1), abs(number), []
    while rest:
        out.append(sign * (rest & (2**_DIGITS - 1)))
        rest >>= _DIGITS
    return out


def _sums(points: DataFrame, centroids: list[list[int]], width: int) -> dict[tuple[int, int], int]:
    """Totals per centroid by dimension; dimension -1 counts vectors, -2 holds the distances (each
    cut to a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}
        for batch in batches:
            vectors = _whole(batch.column(0), width)
            cluster, distance = nearest(vectors, centroids)
            for j in np.unique(cluster).tolist():
                own = cluster == j
                columns = vectors[own].sum(axis=0).tolist()
                far = sum(min(int(x), _LONG) for x in distance[own].tolist())
                for d, x in [*enumerate(columns), (-1, int(own.sum())), (-2, far)]:
                    total[j, d] = total.get((j, d), 0) + int(x)
        rows = [(j, d, g, x) for (j, d), n in total.items() for g, x in enumerate(_digit_groups(n))]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["cluster", "d", "digits", "x"]
        )

    parts = points.select("v").mapInArrow(run, "cluster int, d int, digits int, x long")
    out: dict[tuple[int, int], int] = {}
    # One row per centroid, dimension and digit group.
    for r in parts.groupBy("cluster", "d", "digits").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
        out[r.cluster, r.d] = out.get((r.cluster, r.d), 0) + (int(r.x) << (_DIGITS * r.digits))
    return out


def moved(points: DataFrame, centroids: list[list[int]], width: int) -> list[list[int]]:
    """Centroids after one round: rounded down means; those without vectors stay."""
    sums = _sums(points, centroids, width)
    return [
        [sums.get((j, d), 0) // n for d in range(width)] if (n := sums.get((j, -1), 0)) else own
        for j, own in enumerate(centroids)
    ]


def cluster(
    vectors: DataFrame, width: int, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 2
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector of
    ``width`` components."""
    points = cut_lineage(quantised(vectors, width))
    centroids = starts(points, k, seed)
    for _ in range(rounds if centroids else 0):
        centroids = moved(points, centroids, width)
    sums = _sums(points, centroids, width) if centroids else {}
    inertia = [min(sums.get((j, -2), 0), _LONG) for j in range(len(centroids))]
    total = min(sum(sums.get((j, -2), 0) for j in range(len(centroids))), _LONG)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, distance = nearest(_whole(batch.column(1), width), centroids)
            far = [min(int(x), _LONG) for x in distance.tolist()] if distance.dtype == object else distance
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(found), pa.array(far, pa.int64()),
                    pa.array(np.array(inertia, dtype=np.int64)[found]),
                    pa.array(np.full(len(found), total, dtype=np.int64)),
                    pa.array([names[j] for j in found.tolist()], pa.string()),
                ],
                names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
            )

    schema = (
        "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    return points.select("vec_id", "v").mapInArrow(run, schema)

"""Exact top-k search by inner product as a Voronoi join.

Vectors are quantised to whole numbers and grouped with the nearest of some pivots, queries and
candidates alike; the number of pivots grows with the table up to a bound. Candidates stay in the
group of their pivot, cut into blocks of bounded size, and queries go to them. First every query is
solved in its home group: its k-th best score there, or among a bounded set of anchors (rows of the
table themselves), cannot be beaten by less. No candidate of a group scores above ``q.p + |q| R`` (p
its pivot, R its radius) or ``|q| N`` (N its longest vector), so then a query goes to just those other
groups that reach its bound. A task holds one block of candidates at a time, and queries pass it in
batches; a block is copied only where more than ``QUERY_BLOCK`` queries ask for it.

Vectors that are null or hold null or not finite components take no part. Shorter vectors count as
filled up with zeros. Ties go to the smaller id; rows that repeat an id count each as a candidate,
but never for a query of that id, and are answered each as a query. Scores beyond the range of a long
are cut to it. With fewer than k candidates all are returned; without queries, as in an empty table,
nothing is. Columns besides the id and the vector are not read, whatever their names."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.session import cut_lineage

SCALE = 256
#: Anchors: rows with the smallest hash of the id. Pivots are made of them.
ANCHORS = 1024
#: Most pivots; below, a quarter of the root of the number of rows.
PIVOTS = 512
#: Candidates of a block, and queries that pass it in one task.
BLOCK = 8192
QUERY_BLOCK = 1 << 17
#: Queries scored at once.
_STEP = 256
_EXACT = float(2**53)
_LONG = 2**63 - 1


def quantised(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id`` and ``v``, whole numbers as doubles, of the rows that take part."""
    x = F.col(vector)
    fine = x.isNotNull() & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))
    )


    def whole_number(c: Column) -> Column:
        scaled = c.cast("double") * SCALE
        # Doubles from here on are whole anyway, and may be beyond a long.
        return F.when(F.abs(scaled) < _EXACT, F.floor(scaled).cast("double")).otherwise(scaled)

    whole = F.transform(x, whole_number)
    return vectors.filter(fine & F.col(id).isNotNull()).select(
        F.col(id).cast("long").alias("vec_id"), whole.alias("v")
    )


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of equal width, short ones filled up with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    if not width:
        return np.zeros((len(sizes), 0))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), _within(sizes)] = flat
    return out


def _within(sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows as longs, exact."""
    if not queries.size or not candidates.size:
        return np.zeros((len(queries), len(candidates)), dtype=np.int64)
    reach = np.abs(queries).max() * np.abs(candidates).max() * queries.shape[1]
    if reach < _EXACT:
        return np.rint(queries @ candidates.T).astype(np.int64)
    whole = [np.array([[int(x) for x in r] for r in m], dtype=object) for m in (queries, candidates)]
    return np.clip(whole[0] @ whole[1].T, -_LONG - 1, _LONG).astype(np.int64)


@dataclass(frozen=True)
class Plan:
    """Pivots and anchors, at most ``PIVOTS`` and ``ANCHORS`` rows."""

    width: int
    pivots: np.ndarray
    anchor_ids: np.ndarray
    anchors: np.ndarray


def plan(points: DataFrame) -> Plan:
    size = points.agg(F.max(F.size("v")).alias("w"), F.count("*").alias("n")).first()
    width = size.w or 0
    rows = points.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(ANCHORS).collect()
    anchors = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        anchors[i, : len(r.v)] = r.v
    ids = np.array([r.vec_id for r in rows], dtype=np.int64)
    pivots = min(PIVOTS, max(8, round(size.n**0.5 / 4)))
    return Plan(width, _spread(anchors, pivots), ids, anchors)


def _spread(anchors: np.ndarray, most: int) -> np.ndarray:
    """Pivots: anchors far from each other, moved to the middle of their cells."""
    if not len(anchors):
        return anchors
    chosen = [0]
    far = ((anchors - anchors[0]) ** 2).sum(axis=1)
    while len(chosen) < min(most, len(anchors)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((anchors - anchors[chosen[-1]]) ** 2).sum(axis=1))
    pivots = anchors[chosen]
    for _ in range(10):
        cell = _nearest(anchors, pivots)[0]
        pivots = np.stack([anchors[cell == j].mean(axis=0) if (cell == j).any() else pivots[j]
                           for j in range(len(pivots))])
    return pivots


def _nearest(rows: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and distance of the nearest pivot."""
    square = (rows**2).sum(axis=1)[:, None] - 2 * rows @ pivots.T + (pivots**2).sum(axis=1)
    cell = square.argmin(axis=1)
    # Measured again, as the expanded form loses digits.
    return cell, np.sqrt(((rows - pivots[cell]) ** 2).sum(axis=1))


def _celled(points: DataFrame, how: Plan) -> DataFrame:
    """Points with ``cell``, ``distance`` to its pivot and ``norm``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column(1), how.width)
            cell, distance = _nearest(rows, how.pivots)
            norm = np.sqrt((rows**2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(distance), pa.array(norm)],
                names=["vec_id", "v", "cell", "distance", "norm"],
            )

    schema = "vec_id long, v array<double>, cell int, distance double, norm double"
    return points.mapInArrow(run, schema)


@dataclass(frozen=True)
class Extent:
    """Radius and longest vector of every cell; below zero if it is empty."""

    radius: np.ndarray
    norm: np.ndarray


def extent(celled: DataFrame, how: Plan) -> Extent:
    radius, norm = (np.full(max(len(how.pivots), 1), -1.0) for _ in range(2))
    # One row per pivot: bounded.
    for r in celled.groupBy("cell").agg(F.max("distance").alias("r"), F.max("norm").alias("n")).collect():
        radius[r.cell], norm[r.cell] = (x * (1 + 1e-9) + 1e-9 for x in (r.r, r.n))
    return Extent(radius, norm)


def _away(queries: DataFrame, how: Plan, far: Extent, k: int) -> DataFrame:
    """``row, vec_id, v, cell``: queries (with ``cell``, their home, and ``bound``, null if there is
    none) once for every other cell that reaches their bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(1).to_numpy(), _matrix(batch.column(2), how.width)
            home = batch.column(3).to_numpy()
            known = batch.column(4).to_numpy(zero_copy_only=False).astype(np.float64)
            bound = np.where(np.isnan(known), -np.inf, known)
            first = scores(rows, how.anchors).astype(np.float64)
            first[ids[:, None] == how.anchor_ids] = -np.inf
            if first.shape[1] >= k:
                bound = np.maximum(bound, np.partition(first, -k, axis=1)[:, -k])
            long = np.sqrt((rows**2).sum(axis=1))[:, None]
            reach = np.minimum(rows @ how.pivots.T + long * far.radius, long * far.norm)
            # Room for rounding: a cell is left out only if it is clearly out of reach.
            reach += 1e-6 * (1 + np.abs(reach))
            reach = np.clip(reach, -_LONG - 1, _LONG)  # as scores are
            asks = (reach >= bound[:, None]) & (far.radius >= 0)
            asks[np.arange(len(home)), home] = False
            # A batch per cell, none larger than the one given.
            for cell in np.flatnonzero(asks.any(axis=0)):
                chosen = pa.array(np.flatnonzero(asks[:, cell]))
                sent = [batch.column(i).take(chosen) for i in range(3)]
                cells = pa.array(np.full(len(chosen), cell, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*sent, cells], names=["row", "vec_id", "v", "cell"])

    schema = "row long, vec_id long, v array<double>, cell int"
    return queries.select("row", "vec_id", "v", "cell", "bound").mapInArrow(run, schema)


def _met(asked: DataFrame, celled: DataFrame, width: int, k: int) -> DataFrame:
    """``row, query_id, vec_id, score``: the ``k`` best for ``asked`` (``row, vec_id, v, cell``) in
    every block of their cell."""
    asking = asked.groupBy("cell").agg(F.count("*").alias("q"))
    # One row per pivot at most; written, so that its size is known.
    sizes = cut_lineage(
        celled.groupBy("cell").agg(F.count("*").alias("n")).join(asking, "cell").select(
            "cell",
            F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"),
            F.ceil(F.col("q") / QUERY_BLOCK).cast("int").alias("slices"),
        )
    )

    def dealt(size: str) -> Column:
        return F.pmod(F.xxhash64("row"), F.col(size)).cast("int")

    def every(size: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(size) - 1))

    columns = ["cell", "block", "slice", "asks", "row", "vec_id", "v"]
    candidates = celled.join(sizes, "cell").withColumn("block", dealt("blocks"))
    candidates = candidates.withColumn("slice", every("slices")).withColumn("asks", F.lit(0))
    queries = asked.join(sizes, "cell").withColumn("slice", dealt("slices"))
    queries = queries.withColumn("block", every("blocks")).withColumn("asks", F.lit(1))
    # A block of candidates in the order of ids, then the queries that pass it.
    order = ["cell", "block", "slice", "asks", "vec_id"]
    together = (
        candidates.select(columns).unionByName(queries.select(columns))
        .repartition("cell", "block", "slice").sortWithinPartitions(order)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
            rows, ids = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            turns = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for lo, hi in pairwise([0, *turns.tolist(), len(keys)]):
                if lo == hi:
                    continue
                if tuple(keys[lo, :3]) != at:
                    at, held, block = tuple(keys[lo, :3]), [], None
                if not keys[lo, 3]:
                    held.append((ids[lo:hi], _matrix(batch.column(6).slice(lo, hi - lo), width)))
                    continue
                if block is None:
                    block = [np.concatenate(x) for x in zip(*held, strict=True)]
                for i in range(lo, hi, _STEP):
                    j = min(i + _STEP, hi)
                    asks = _matrix(batch.column(6).slice(i, j - i), width)
                    yield _best(rows[i:j], ids[i:j], asks, *block, k)

    return together.mapInArrow(run, "row long, query_id long, vec_id long, score long")


def _best(rows: np.ndarray, ids: np.ndarray, asks: np.ndarray, others: np.ndarray, block: np.ndarray,
          k: int) -> pa.RecordBatch:
    """The ``k`` best of a block, in the order of ids, for some queries."""
    out: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64),) * 4]
    for row, id, found in zip(rows, ids, scores(asks, block), strict=True):
        free = np.flatnonzero(others != id)
        own = found[free]
        if len(own) > k:
            best = np.flatnonzero(own >= np.partition(own, -k)[-k])
            free, own = free[best], own[best]
        # The complement turns the order round without overflow; stable, so that ties go by id.
        best = np.argsort(~own, kind="stable")[:k]
        n = len(best)
        out.append((np.full(n, row), np.full(n, id), others[free[best]], own[best]))
    columns = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["row", "query_id", "vec_id", "score"])


def _ranked(best: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best others for every row of ``is_query`` (over
    ``vec_id``)."""
    points = quantised(vectors)
    how = plan(points)
    celled = _celled(points, how) if how.width else points.select(
        "vec_id", "v", F.lit(0).alias("cell"), F.lit(0.0).alias("distance"), F.lit(0.0).alias("norm"))
    # The row tells queries of one id apart.
    celled = cut_lineage(celled.withColumn("row", F.monotonically_increasing_id()))
    queries = celled.filter(is_query).select("row", "vec_id", "v", "cell")
    best = cut_lineage(_ranked(_met(queries, celled, how.width, k), k).drop("rank"))
    if len(how.pivots) > 1 and how.width:
        full = F.when(F.count("*") == k, F.min("score"))
        bounds = best.groupBy("row").agg(full.alias("bound"))
        away = _away(queries.join(bounds, "row", "left"), how, extent(celled, how), k)
        best = best.unionByName(_met(cut_lineage(away), celled, how.width, k))
    return _ranked(best, k).select("query_id", "rank", "vec_id", "score")

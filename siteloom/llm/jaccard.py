"""Exact self-join of texts by Jaccard similarity of their word n-grams, after the pigeonhole
principle on a partitioned universe of tokens.

Sets are put into size bands. Within a band, hashing splits the universe of tokens into segments, and
two linked sets can differ in no more than H(s) = 3 s / 17 tokens, s the smaller size. The smaller set
spends H(s) + 1 units on segments: one unit finds partners that agree in a segment, two units also
those that differ there by one token. So one of its probes must meet every partner. Units go where
they cost least: empty segments, which agree by chance, are left out as long as others can take
their units. The larger set lists all its segments, in its own band and in the band below where
partners of it may stand; in the bands of small sets it lists the one-deletion neighbours too.

Equal sets are one class from the start, so exact copies cost one row each. Sets that meet in a
signature are a family of the one among them that meets most often, its head. They are compared
with the head, links are joined to components, and what is left of a family outside the component of
its head is then compared with the others of the family, in blocks of bounded size and by counts of
tokens per bin, which only let pass what can be linked; pairs known to be connected are never
expanded. Every link is verified on the whole sets of 64-bit n-gram hashes.

Null and empty texts have no set and no link. Null ids take part; a component goes by its smallest
non-null id."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom.llm.rows import append_columns
from siteloom.session import cut_lineage

N = 4
SHARE, OF = 85, 100  # linked: OF * common >= SHARE * together
#: Bands up to this size list one-deletion neighbours.
DEEP = 48
#: Bits of the prefilters that spare a shuffle of rows without a partner. Fixed, so what the driver
#: holds is bounded; when they fill up, more rows are shuffled and the result is the same.
FILTER_BITS = 1 << 25
BINS = 256
#: Classes of a family compared with each other in one step.
BLOCK = 2048

_U = np.uint64
_rng = np.random.default_rng(9)
_BYTE = _rng.integers(1, 2**63, 256, dtype=_U)
_PLACE = _rng.integers(1, 2**63, N, dtype=_U) | _U(1)
_BASE, _SHORT = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@cache
def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, _BASE, dtype=_U))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of every word, A to Z in lower case."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    if not len(raw):
        return np.empty(0, _U)
    space = _SPACE[raw]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.empty(0, _U)
    letters = raw[~space]
    sizes = ends - starts
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    inside = np.arange(len(letters)) - np.repeat(first, sizes)
    longest = 1 << int(sizes.max()).bit_length()
    values = _BYTE[letters] * _powers(longest)[inside]
    return _mix(np.add.reduceat(values, first) + sizes.astype(_U))


def shingles(text: str | None) -> np.ndarray:
    """The set of a text, as ascending hashes of word n-grams; the whole of a shorter text is one."""
    words = word_hashes(text or "")
    n = len(words) - N + 1
    if not len(words):
        return words
    if n < 1:
        lone = (words * _PLACE[: len(words)]).sum(keepdims=True)
        return _mix(lone + _SHORT * np.array([len(words)], dtype=_U))
    return np.unique(_mix(sum(words[j : j + n] * _PLACE[j] for j in range(N))))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return OF * common >= SHARE * (len(a) + len(b) - common) and common > 0


def differing(size: int) -> int:
    """Most tokens in which a set and a linked set at least as large can differ."""
    return size * (OF - SHARE) // SHARE


@cache
def _band_of(size: int) -> tuple[int, int, int]:
    """Number, smallest and largest size of the band of ``size``."""
    number, low = 0, 1
    while (following := low * 3 // 2 + 1) <= size:
        number, low = number + 1, following
    return number, low, following - 1


def _segments(upper: int) -> int:
    most = differing(upper)
    return most + 1 + most // 12 + (upper > DEEP)


class _Split:
    """Segments of one set under the partition of one band."""

    def __init__(self, tokens: np.ndarray, band: tuple[int, int, int]):
        number, _, self.upper = band
        self.m = _segments(self.upper)
        at = (tokens >> _U(32)) * _U(self.m) >> _U(32)  # ascending, as the tokens are
        self.edges = np.searchsorted(at, np.arange(self.m + 1, dtype=_U))
        self.sizes = np.diff(self.edges)
        self.parts = _mix(tokens + _SHORT)
        sums = np.concatenate(([_U(0)], np.cumsum(self.parts)))
        self.sums = sums[self.edges[1:]] - sums[self.edges[:-1]]
        self.salt = (np.arange(self.m, dtype=_U) + _U(1) + (_U(number) << _U(32))) * _SHORT
        self.exact = _mix(self.sums + self.salt)

    def without_one(self, i: int) -> np.ndarray:
        own = self.parts[self.edges[i] : self.edges[i + 1]]
        return _mix(self.sums[i] - own + self.salt[i])


def _cost(size: int) -> float:
    """Expected partners of a signature of ``size`` tokens: each one divides them."""
    return 1 + 1e6 * 8.0**-size


def signatures(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures that a set probes with, and the others that it lists."""
    n = len(tokens)
    band = _band_of(n)
    probe, listed = [np.empty(0, _U)], [np.empty(0, _U)]
    if differing(band[2]):
        own = _Split(tokens, band)
        units = differing(n) + 1
        if band[2] > DEEP:
            order = np.argsort(-own.sizes, kind="stable")
            probe.append(own.exact[order[:units]])
            listed.append(own.exact[order[units:]])
        else:
            steps = []
            for i, size in enumerate(own.sizes.tolist()):
                once = _cost(size)
                steps.append((once, i, 1))
                twice = once + size * _cost(size - 1) if size else 1e9
                steps.append((max(once, twice - once), i, 2))
            spent = {i: level for _, i, level in sorted(steps)[:units]}
            for i in range(own.m):
                level = spent.get(i, 0)
                (probe if level else listed).append(own.exact[i : i + 1])
                (probe if level == 2 else listed).append(own.without_one(i))
    number, low, _ = band
    if number and -(-n * SHARE // OF) < low and differing(low - 1):
        below = _Split(tokens, _band_of(low - 1))
        listed.append(below.exact)
        if below.upper <= DEEP:
            listed += [below.without_one(i) for i in range(below.m)]
    first = np.unique(np.concatenate(probe))
    return first, np.setdiff1d(np.concatenate(listed), first)


def fingerprint(tokens: np.ndarray) -> int:
    """One number for a set, as a signed long."""
    total = _mix(tokens ^ _BASE).sum(keepdims=True) + _U(len(tokens))
    return int(_mix(total).view(np.int64)[0])


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    flat = np.concatenate(parts) if parts else np.empty(0, _U)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))


def described(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, class, probe, listed`` per row; the signatures of a class are given
    once per task. ``class`` is null without a set."""
    schema = "doc_id long, n_shingles long, class long, probe array<long>, listed array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        none = np.empty(0, _U)
        for batch in batches:
            sizes, classes, probes, rest = [], [], [], []
            for text in batch.column(1).to_pylist():
                tokens = shingles(text)
                own = fingerprint(tokens) if len(tokens) else None
                new = own is not None and own not in seen
                seen.add(own)
                first, other = signatures(tokens) if new else (none, none)
                sizes.append(len(tokens))
                classes.append(own)
                probes.append(first)
                rest.append(other)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(classes, pa.int64()),
                    _lists(probes),
                    _lists(rest),
                ],
                names=["doc_id", "n_shingles", "class", "probe", "listed"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _filter_of(df: DataFrame, column: str) -> np.ndarray:
    """Bit set of the values of ``column``, of fixed size."""
    bit = F.pmod(F.col(column), F.lit(FILTER_BITS))
    words = (
        df.select(F.floor(bit / 64).alias("at"), F.pmod(bit, F.lit(64)).cast("int").alias("bit"))
        .groupBy("at")
        .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
        .toArrow()
    )
    found = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    found[words["at"].to_numpy()] = words["bits"].to_numpy()
    return np.unpackbits(found.view(np.uint8), bitorder="little")


def _met(stored: DataFrame) -> DataFrame:
    """``sig, class, size`` of signatures that two classes or more list and one probes."""
    once = F.col("class").isNotNull()

    def rows(column: str, probes: bool) -> DataFrame:
        return stored.filter(once).select(
            F.explode(column).alias("sig"), "class", F.lit(probes).alias("probes")
        )

    groups = (
        rows("probe", True)
        .unionByName(rows("listed", False))
        .groupBy("sig")
        .agg(
            F.min("class").alias("first"),
            F.max("class").alias("last"),
            F.bool_or("probes").alias("probed"),
        )
        .filter("first < last and probed")
        .select("sig")
    )
    groups = cut_lineage(groups)
    bits = np.packbits(_filter_of(groups, "sig"), bitorder="little")
    context = stored.sparkSession.sparkContext
    held = context.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            for at in (2, 3):
                lists = batch.column(at)
                sigs = lists.flatten().to_numpy()
                where = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                place = sigs % FILTER_BITS
                there = (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0
                rows = pa.array(where[there])
                sizes = batch.column(1).take(rows).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(sigs[there]),
                        batch.column(0).take(rows),
                        pa.array(sizes),
                    ],
                    names=["sig", "class", "size"],
                )

    kept = (
        stored.filter(once)
        .select("class", "n_shingles", "probe", "listed")
        .mapInArrow(run, "sig long, class long, size long")
    )
    # A class may come from several tasks.
    return cut_lineage(kept.join(groups, "sig", "left_semi").distinct())


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``class, size, bins, tokens`` of the classes in ``wanted`` (and a few more)."""
    bits = np.packbits(_filter_of(wanted, "class"), bitorder="little")
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = held.value, set()
        for batch in batches:
            classes, sizes, bins, sets = [], [], [], []
            for text in batch.column(0).to_pylist():
                tokens = shingles(text)
                own = fingerprint(tokens) if len(tokens) else None
                if own is None or own in seen:
                    continue
                place = own % FILTER_BITS
                if not (bits[place >> 3] >> (place & 7)) & 1:
                    continue
                seen.add(own)
                classes.append(own)
                sizes.append(len(tokens))
                counts = np.bincount((tokens & _U(BINS - 1)).astype(np.int64), minlength=BINS)
                bins.append(np.minimum(counts, 255).astype(np.uint8).tobytes())
                sets.append(tokens.tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(classes, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(bins, pa.binary()),
                    pa.array(sets, pa.binary()),
                ],
                names=["class", "size", "bins", "tokens"],
            )

    made = docs.select("text").mapInArrow(run, "class long, size long, bins binary, tokens binary")
    return cut_lineage(made.join(wanted, "class", "left_semi"))


def _bins(column: pa.Array) -> np.ndarray:
    flat = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8)
    return flat.reshape(-1, BINS).astype(np.int16)


def _possible(total: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Whether sets of ``total`` tokens together can be linked if they differ in at least
    ``differ``: they have at most ``(total - differ) / 2`` in common."""
    return OF * (total - differ) >= SHARE * (total + differ)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The linked ones of ``pairs`` (``a, b``). Differing bin counts tell most others before any
    set is moved."""

    def rough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            differ = np.abs(_bins(batch.column(2)) - _bins(batch.column(3))).sum(axis=1)
            total = batch.column(4).to_numpy() + batch.column(5).to_numpy()
            yield batch.select([0, 1]).filter(pa.array(_possible(total, differ)))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good = [
                linked(np.frombuffer(x, _U), np.frombuffer(y, _U))
                for x, y in zip(a, b, strict=True)
            ]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    def beside(pairs: DataFrame, columns: list[str]) -> DataFrame:
        one = sets.dropDuplicates(["class"]).select(
            F.col("class").alias("a"), *[F.col(c).alias(f"{c}_a") for c in columns]
        )
        other = sets.dropDuplicates(["class"]).select(
            F.col("class").alias("b"), *[F.col(c).alias(f"{c}_b") for c in columns]
        )
        names = [f"{c}_{side}" for c in columns for side in "ab"]
        return pairs.join(one, "a").join(other, "b").select("a", "b", *names)

    close = cut_lineage(beside(pairs, ["bins", "size"]).mapInArrow(rough, "a long, b long"))
    return cut_lineage(beside(close, ["tokens"]).mapInArrow(exact, "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """``class, root``: smallest class reachable over ``edges`` (``a, b``), for classes with one.

    Every round takes the smallest root among neighbours and then the root of that root, so chains
    halve; each is written out, and the last one changes nothing."""
    both = cut_lineage(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    )
    roots = cut_lineage(
        both.groupBy(F.col("a").alias("class")).agg(F.least("class", F.min("b")).alias("root"))
    )
    while True:
        near = both.join(roots, both["b"] == roots["class"]).groupBy("a").agg(
            F.min("root").alias("near")
        )
        step = roots.join(near, roots["class"] == near["a"]).select(
            "class", "root", F.least("root", "near").alias("new")
        )
        step = cut_lineage(step)
        up = step.select(F.col("class").alias("new"), F.col("new").alias("top"))
        after = cut_lineage(
            step.join(up, "new").select("class", F.col("top").alias("root"), F.col("root").alias("was"))
        )
        changed = after.filter("root <> was").limit(1).count()
        roots = after.select("class", "root")
        if not changed:
            return roots


def _may_link(a: str, b: str) -> F.Column:
    low, high = F.least(a, b), F.greatest(a, b)
    return OF * low >= SHARE * high


def _families(met: DataFrame) -> DataFrame:
    """``head, class, size, head_size``: classes that meet in a signature, below the one of them
    that meets most often (the largest of several); heads are not in their own family."""
    often = met.groupBy("class").agg(F.count("*").alias("often"), F.max("size").alias("size"))
    rank = F.struct("often", "class", "size")
    heads = (
        met.select("sig", "class")
        .join(often, "class")
        .groupBy("sig")
        .agg(F.max(rank).alias("head"))
        .select("sig", F.col("head.class").alias("head"), F.col("head.size").alias("head_size"))
    )
    family = met.join(heads, "sig").filter(F.col("class") != F.col("head"))
    return cut_lineage(family.select("head", "class", "size", "head_size").distinct())


def _apart(families: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b``: pairs of a family that may be linked and are not known to be connected, one of them
    outside the component of the head."""
    tops = roots.select(F.col("class").alias("head"), F.col("root").alias("top"))
    known = (
        families.select("head", "class", "size")
        .join(roots, "class", "left")
        .join(tops, "head", "left")
        .withColumn("root", F.coalesce("root", "class"))
        .withColumn("outside", F.col("root") != F.coalesce("top", "head"))
        .select("head", "class", "size", "root", "outside")
    )
    known = cut_lineage(known)
    counts = known.groupBy("head").agg(F.count("*").alias("n"), F.count_if("outside").alias("out"))
    # A family of one has been compared with its head.
    counts = counts.filter("n > 1 and out > 0").select(
        "head",
        F.ceil(F.col("n") / BLOCK).alias("blocks"),
        F.ceil(F.col("out") / BLOCK).alias("outer_blocks"),
    )
    bins = sets.dropDuplicates(["class"]).select("class", "bins")
    rows = cut_lineage(known.join(counts, "head").join(bins, "class"))
    total = rows.agg(F.sum("outer_blocks").alias("n")).first().n or 0
    buckets = max(1, total // BLOCK)
    part, zero = F.xxhash64("class"), F.lit(0).cast("long")
    columns = ["head", "outer", "inner", "class", "size", "root", "bins"]

    def dealt(df: DataFrame, outer: F.Column, inner: F.Column) -> DataFrame:
        # One generator per step: a block of the family for a block of those outside.
        df = df.withColumn("outer", outer).withColumn("inner", inner).select(*columns)
        bucket = F.pmod(F.xxhash64("head", "outer", "inner"), F.lit(buckets))
        return df.withColumn("bucket", bucket).toDF(*columns, "bucket")

    def every(count: str) -> F.Column:
        return F.explode(F.sequence(zero, F.col(count) - 1))

    left = dealt(rows.filter("outside"), F.pmod(part, F.col("outer_blocks")), every("blocks"))
    right = dealt(rows, every("outer_blocks"), F.pmod(part, F.col("blocks")))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[np.ndarray] = [np.empty((0, 2), dtype=np.int64)]
        groups = [_by_family(t) for t in (left, right)]
        for key, (ids, sizes, roots, bins) in groups[0].items():
            if key not in groups[1]:
                continue
            others, other_sizes, other_roots, other_bins = groups[1][key]
            for i in range(len(ids)):
                differ = np.abs(other_bins - bins[i]).sum(axis=1)
                may = _possible(other_sizes + sizes[i], differ) & (other_roots != roots[i])
                near = others[may]
                pair = np.stack([np.minimum(near, ids[i]), np.maximum(near, ids[i])], axis=1)
                found.append(pair)
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return (
        left.groupBy("bucket")
        .cogroup(right.groupBy("bucket"))
        .applyInArrow(compare, "a long, b long")
        .distinct()
    )


def _by_family(table: pa.Table) -> dict[tuple[int, int, int], tuple[np.ndarray, ...]]:
    """Classes, sizes, roots and bins by head and blocks."""
    if not table.num_rows:
        return {}
    keys = np.stack([table[c].to_numpy() for c in ("head", "outer", "inner")], axis=1)
    order = np.lexsort(keys.T)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
    parts = [table[c].to_numpy()[order] for c in ("class", "size", "root")]
    parts.append(_bins(table["bins"])[order])
    ends = np.append(starts[1:], len(keys))
    return {
        tuple(keys[a].tolist()): tuple(p[a:b] for p in parts)
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True)
    }


def links(docs: DataFrame, stored: DataFrame) -> DataFrame:
    """``class, root`` of linked classes."""
    families = _families(_met(stored))
    members = families.select("class").union(families.select(F.col("head").alias("class")))
    sets = _sets(docs, cut_lineage(members.distinct()))
    stars = families.filter(_may_link("size", "head_size")).select(
        F.col("head").alias("a"), F.col("class").alias("b")
    )
    first = _verified(stars, sets)
    second = _verified(_apart(families, components(first), sets), sets)
    return components(first.unionByName(second))


def _rooted(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, class, root`` per row."""
    stored = cut_lineage(described(docs))
    roots = links(docs, stored)
    rows = stored.select("doc_id", "n_shingles", "class")
    named = rows.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    return cut_lineage(named.select("doc_id", "n_shingles", "class", "root"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (``doc_id, text``)."""
    named = _rooted(docs)
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("smallest"))
    return named.join(smallest.filter("root is not null"), "root", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("smallest")).alias(
            "component_id"
        ),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without the copies: of every component, the row with the smallest id
    (null last), one of several alike; all rows without a set. Columns besides ``doc_id`` and ``text`` go along,
    whatever their names."""
    own = [c if c in ("doc_id", "text") else f"_given_{i}" for i, c in enumerate(docs.columns)]
    return _one_of_each(docs.toDF(*own)).toDF(*docs.columns)


def _one_of_each(docs: DataFrame) -> DataFrame:
    named = _rooted(docs)
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("class"))
    best = named.filter("root is not null").groupBy("root").agg(F.min(rank).alias("best"))
    chosen = best.select("best.doc_id", "best.class")
    counts = named.groupBy("doc_id").agg(
        F.count("*").alias("_rows"), F.bool_and(F.col("root").isNull()).alias("_bare")
    )
    ids = (
        counts.join(chosen.select("doc_id", F.lit(True).alias("_chosen")).distinct(), "doc_id", "left")
        .filter("_bare or _chosen")
        .select("doc_id", "_rows", "_bare")
    )
    ids = cut_lineage(ids)
    columns = docs.columns
    # An id of one row stays or goes as a whole; rows that share an id are told apart by their set.
    # Ids are built into the hash table, so that texts are streamed past it and not sorted.
    matched = docs.join(ids.filter("doc_id is not null").hint("shuffle_hash"), "doc_id")
    plain = matched.filter("_rows = 1 or _bare").select(columns)
    field = [T.StructField("_class", T.LongType())]

    def classes(texts: list[str | None]) -> list[list]:
        sets = map(shingles, texts)
        return [[fingerprint(s) if len(s) else None for s in sets]]

    shared = matched.filter("_rows > 1 and not _bare").select(columns)
    shared = shared.unionByName(docs.filter("doc_id is null"))
    shared = append_columns(shared, ["text"], field, classes)
    pick = chosen.select(F.col("doc_id").alias("_id"), F.col("class").alias("_own"))
    told = shared.join(
        pick, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_class") == F.col("_own"))
    ).dropDuplicates(["_id", "_own"])
    return (
        plain.unionByName(told.select(columns))
        .unionByName(shared.filter("_class is null").select(columns))
    )

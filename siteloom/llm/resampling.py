"""Importance resampling towards a target: features are hashed into buckets, a bucket's gain is its log
ratio between target and source, and documents are drawn by weight plus Gumbel noise.

Texts are folded and cut into words as bytes, a part of a batch at a time. Words and runs of words
get numbers by exact dictionaries, so that every distinct feature of a part is hashed once. Distinct
features of equal length are laid out as one two-dimensional array of bytes, their CRCs are updated
column by column, all at once, and their buckets are scattered back to where the features stand. Rows
longer than ``STEP`` are taken as blocks of ``STEP`` columns, whose CRCs are folded by tables.

The rows are hashed twice, once for the counts and once for the weights: nothing but one number per
bucket leaves a task, and no features are stored. Ranks are numbered within ranges of the order, with
one row per range counted over all.

Null or empty texts and texts without words have no features and weight 0. Texts and words of any length count
whole. Equal scores go to the smaller id, then to fewer features, then in any order; null ids
are hashed as none and come last. Repeated rows are documents of their own. Without rows, or without target texts,
every gain is what the counts give, and the result has a row per document. Other columns are not
read."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.operators.prefix import running_rank
from siteloom.session import cut_lineage

BUCKETS = 10_000
#: Words in the longest feature.
RUN = 3
#: Fewest words of a document that may be drawn, and how many of 100 are.
LEAST_WORDS = 20
PER_CENT = 5
#: Bytes of text and words worked on at a time, bytes of a matrix, columns of a block of a long row.
PART = 2_000_000
WORDS = 250_000
CELLS = 4_000_000
STEP = 64
_BLANK = 32


def _fold_table() -> np.ndarray:
    """Bytes of words, with A-Z lowered, as themselves; all other bytes as a blank. Bytes from 128
    on are of characters beyond ASCII, which all belong to words."""
    table = np.full(256, _BLANK, dtype=np.uint8)
    for b in range(256):
        if b >= 128 or chr(b) in "0123456789" or chr(b).isalpha():
            table[b] = ord(chr(b).lower()) if b < 128 else b
    return table


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_FOLD = _fold_table()
_CRC = _crc_table()


def _columns(register: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """CRC registers after the bytes of ``columns``, one row of it after the other."""
    for column in columns:
        register = _CRC[register.astype(np.uint8) ^ column] ^ (register >> np.uint32(8))
    return register


def _step_tables() -> list[np.ndarray]:
    """What a register with one byte set is after ``STEP`` zero bytes, by place and value."""
    values = np.arange(256, dtype=np.uint32)
    zeros = np.zeros((STEP, 256), dtype=np.uint8)
    return [_columns(values << np.uint32(8 * k), zeros) for k in range(4)]


_STEP = _step_tables()


def _crc_rows(matrix: np.ndarray) -> np.ndarray:
    """CRC-32 of every row."""
    rows, length = matrix.shape
    register = np.full(rows, 0xFFFFFFFF, dtype=np.uint32)
    blocks = length // STEP if length > 2 * STEP else 0
    if blocks:
        parts = matrix[:, : blocks * STEP].reshape(rows * blocks, STEP)
        own = _columns(np.zeros(len(parts), dtype=np.uint32), parts.T).reshape(rows, blocks)
        for k in range(blocks):  # registers are linear: those of zeros and of the block add up
            shifted = [_STEP[b][(register >> np.uint32(8 * b)).astype(np.uint8)] for b in range(4)]
            register = shifted[0] ^ shifted[1] ^ shifted[2] ^ shifted[3] ^ own[:, k]
    return _columns(register, matrix[:, blocks * STEP :].T) ^ np.uint32(0xFFFFFFFF)


def crc32s(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of slices of a buffer, by groups of equal length."""
    out = np.empty(len(start), dtype=np.uint32)
    order = np.argsort(length, kind="stable")
    sizes, first = np.unique(length[order], return_index=True)
    ends = [*first[1:].tolist(), len(order)]
    for size, low, high in zip(sizes.tolist(), first.tolist(), ends, strict=False):
        group = order[low:high]
        many = max(1, CELLS // max(size, 1))
        for at in range(0, len(group), many):
            rows = group[at : at + many]
            if size <= STEP:
                matrix = flat[start[rows][None, :] + np.arange(size)[:, None]].T
            else:
                matrix = np.stack([flat[s : s + size] for s in start[rows].tolist()])
            out[rows] = _crc_rows(matrix)
    return out


def _numbered(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of every value's first place among distinct ones, and those first places."""
    number = pc.dictionary_encode(values).indices.to_numpy().astype(np.int64)
    first = np.empty(int(number.max()) + 1 if len(number) else 0, dtype=np.int64)
    first[number[::-1]] = np.arange(len(number))[::-1]
    return number, first


def _part_features(texts: list[str], buckets: int) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Words per text, and text number and bucket of every feature, some at a time."""
    raw = [t.encode() for t in texts]
    folded = _FOLD[np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)]
    inside = folded != _BLANK
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = end - start
    owner = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), start, side="right")
    # Words with one blank after each, and where they stand there.
    kept = inside.copy()
    kept[end] = True
    line = folded[kept]
    at = np.cumsum(size + 1) - (size + 1)
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(size),
        [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(folded[inside])],
    )

    def some() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for low in range(0, len(size), WORDS):
            high = min(low + WORDS + RUN - 1, len(size))  # runs that begin among these words
            number, _ = _numbered(words[low:high])
            kinds = int(number.max()) + 1
            run = number  # numbers of the runs of one word less
            for n in range(1, RUN + 1):
                begin = low + np.arange(min(WORDS, high - low - n + 1) if high - low >= n else 0)
                whole = owner[begin] == owner[begin + n - 1]
                if n > 1:
                    keys = run[: len(begin)] * kinds + number[n - 1 : n - 1 + len(begin)]
                    run, _ = _numbered(pa.array(keys))
                begin, own = begin[whole], run[: len(begin)][whole]
                if not len(begin):
                    continue
                own, first = _numbered(pa.array(own))
                left = begin[first]
                length = at[left + n - 1] + size[left + n - 1] - at[left]
                bucket = (crc32s(line, at[left], length) % np.uint32(buckets)).astype(np.int64)
                yield owner[begin], bucket[own]

    return np.bincount(owner, minlength=len(texts)), some()


def _parts(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Neighbouring texts of about ``PART`` characters together, with the number of the first."""
    at, own, letters = 0, [], 0
    for i, text in enumerate(texts):
        own.append(text or "")
        letters += len(own[-1])
        if letters >= PART:
            yield at, own
            at, own, letters = i + 1, [], 0
    if own:
        yield at, own


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, texts in _parts(batch.column(0).to_pylist()):
                for _, bucket in _part_features(texts, buckets)[1]:
                    total += np.bincount(bucket, minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], names=["bucket", "n"])

    rows = docs.select(text).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for r in rows.collect():  # one row per bucket
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """Rounded down, scaled log ratio of smoothed shares, per bucket."""
    m = len(source)
    all_source, all_target = float(source.sum()) + m, float(target.sum()) + m
    return np.array(
        [
            math.floor(scale * math.log((t + 1.0) * all_source / ((s + 1.0) * all_target)))
            for s, t in zip(source.tolist(), target.tolist(), strict=True)
        ],
        dtype=np.int64,
    )


def weighted(docs: DataFrame, gain: np.ndarray, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            words, features, weight = (np.zeros(n, dtype=np.int64) for _ in range(3))
            for at, texts in _parts(batch.column(1).to_pylist()):
                own = slice(at, at + len(texts))
                words[own], some = _part_features(texts, len(gain))
                for owner, bucket in some:
                    features[own] += np.bincount(owner, minlength=len(texts))
                    sums = np.bincount(owner, weights=gain[bucket], minlength=len(texts))
                    weight[own] += np.rint(sums).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, (words, features, weight))],
                names=["doc_id", "n_words", "n_features", "weight"],
            )

    source = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(id: str, seed: int, scale: int = 1000) -> F.Column:
    """Scaled Gumbel noise, rounded down, from a hash of the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-F.lit(float(scale)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(float(1 << 32))))).cast("long")


def resampled(
    docs: DataFrame, target: DataFrame, seed: int = 42, least_words: int = LEAST_WORDS, per_cent: int = PER_CENT
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document; rank is null unless drawn."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = weighted(docs, gain).withColumn("score", F.col("weight") + gumbel("doc_id", seed))
    fit = F.col("n_words") >= least_words
    # Dealt by ranges of the order and written, so that ranges stay as they are.
    stored = cut_lineage(scored.withColumn("_row", F.monotonically_increasing_id()))
    order = [
        (~fit).asc(), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("_row"),
    ]
    ranges = cut_lineage(stored.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    drawn = ranges.filter(fit).count() * per_cent // 100
    ranked = running_rank(ranges, [], order, F.col("_range"))
    rank = F.when(fit & (F.col("running_rank") <= drawn), F.col("running_rank").cast("long"))
    return ranked.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))

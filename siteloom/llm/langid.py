"""Language identification by rank order: the most frequent character n-grams of a text against
the ranked n-grams of each language, by out-of-place distance.

An n-gram is one to three characters of a lower-cased word, the word bounded by blanks on both
sides; anything but letters separates words. A profile is the list of the most frequent n-grams of
a language over all its training texts, ties in n-gram order. The distance of a text is the sum,
over its own most frequent n-grams, of how far each stands from its place in the profile; an n-gram
missing there costs the full profile length. The nearest profile wins, ties by name.

Texts without a letter, and null, are ``und`` with score 0. The whole text is read, however long.
Counting collapses per task before it is shuffled; prediction has no shuffle."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom.llm.rows import append_columns

#: n-grams per language profile, and n-grams of a text that are compared with it.
PROFILE = 400
UNKNOWN = "und"
#: Share of the training texts of a language that may lie below its low score, and the part of that
#: score which a text must reach.
LOW_SHARE = 0.05
LOW_PART = 0.65
_BITS = np.uint64(21)  # a code point
# Tell n-grams of one and two characters from longer ones that start at a blank.
_ONE, _PAIR = np.uint64(1 << 63), np.uint64(0x1FFFFF << 42)

_letters = np.zeros(0x110000, dtype=np.int8)  # 0: not looked up yet, 1: letter, 2: other


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text; every run of other characters is one 0, as are
    both ends."""
    raw = text.lower().encode("utf-32-le", "surrogatepass")
    points = np.frombuffer(raw, dtype=np.uint32)
    kinds = _letters[points]
    if not kinds.all():
        for p in np.unique(points[kinds == 0]).tolist():
            _letters[p] = 1 if chr(p).isalpha() else 2
        kinds = _letters[points]
    blank = kinds == 2
    points = np.where(blank, 0, points).astype(np.uint64)
    points = points[~(blank & np.concatenate(([False], blank[:-1])))]
    points = points[1:] if len(points) and points[0] == 0 else points
    points = points[:-1] if len(points) and points[-1] == 0 else points
    return np.concatenate(([0], points, [0])).astype(np.uint64) if len(points) else points


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """N-grams as numbers, ascending, and how often each occurs."""
    a = _codes(text or "")
    if not len(a):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    one = a[a > 0]
    two = _PAIR | (a[:-1] << _BITS) | a[1:]
    middle = a[1:-1] > 0  # a blank inside would join two words
    three = ((a[:-2] << (_BITS * np.uint64(2))) | (a[1:-1] << _BITS) | a[2:])[middle]
    ordered = np.sort(np.concatenate([_ONE | one, two, three]))
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return ordered[starts], np.diff(np.append(starts, len(ordered)))


def _top(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The most frequent n-grams in order of rank."""
    return grams[np.argsort(-counts, kind="stable")[:PROFILE]]


@dataclass(frozen=True)
class Profiles:
    """``ranks[i, j]``: place of ``grams[i]`` in the profile of ``names[j]``."""

    names: list[str]
    grams: np.ndarray
    ranks: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        top = _top(*gram_counts(text))
        if not len(top) or not self.names:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.grams, top), len(self.grams) - 1)
        known = self.grams[at] == top
        places = np.arange(len(top))[:, None]
        off = np.where(known[:, None], np.abs(self.ranks[at] - places), PROFILE)
        distance = np.minimum(off, PROFILE).sum(axis=0)
        best = int(np.argmin(distance))
        return self.names[best], 1.0 - float(distance[best]) / (PROFILE * len(top))


def learn(docs: DataFrame, lang: str = "lang") -> Profiles:
    """Profiles of every non-null value of ``lang``, from all rows of ``docs``.

    What reaches the driver is ``PROFILE`` n-grams for each language, however many rows."""
    schema = T.StructType(
        [
            T.StructField("lang", T.StringType()),
            T.StructField("gram", T.LongType()),
            T.StructField("n", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name, text in zip(names, texts, strict=True):
                parts.setdefault(name, []).append(gram_counts(text))
            for name, pieces in parts.items():
                grams, where = np.unique(np.concatenate([g for g, _ in pieces]), return_inverse=True)
                sums = np.bincount(where, np.concatenate([n for _, n in pieces]), len(grams))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * len(grams), pa.string()),
                        pa.array(grams.view(np.int64)),
                        pa.array(sums.astype(np.int64)),
                    ],
                    names=["lang", "gram", "n"],
                )

    known = docs.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), "text")
    counts = known.mapInArrow(run, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Numbers with the top bit are negative as longs; shifted, they order as unsigned.
    unsigned = F.col("gram").bitwiseXOR(F.lit(-(2**63)))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), unsigned)
    ranked = counts.withColumn("rank", F.row_number().over(order))
    rows = ranked.filter(F.col("rank") <= PROFILE).select("lang", "gram", "rank").collect()
    names = sorted({r.lang for r in rows})
    of = {name: j for j, name in enumerate(names)}
    grams = np.unique(np.array([r.gram for r in rows], dtype=np.int64).view(np.uint64))
    ranks = np.full((len(grams), len(names)), 2 * PROFILE, dtype=np.int32)
    for r in rows:
        at = np.searchsorted(grams, np.uint64(r.gram % 2**64))
        ranks[at, of[r.lang]] = r["rank"] - 1
    return Profiles(names, grams, ranks)


FIELDS = [
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
]


def identify(docs: DataFrame, profiles: Profiles, carry: list[str] | None = None) -> DataFrame:
    """``lang_pred`` and ``score`` (0 to 1) for every row, from ``text`` alone."""

    def compute(texts: list[str | None]) -> list[list]:
        found = [profiles.predict(t) for t in texts]
        return [[f[0] for f in found], [f[1] for f in found]]

    return append_columns(docs, ["text"], FIELDS, compute, carry)


def low_scores(docs: DataFrame, profiles: Profiles) -> dict[str, float]:
    """Per language, ``LOW_PART`` of the score that all but ``LOW_SHARE`` of the texts of ``docs``
    labelled and identified as that language reach. Scores count in thousandths, so a language
    has at most a thousand of them, however many rows."""
    scored = identify(docs.select("lang", "text"), profiles, ["lang"]).filter("lang = lang_pred")
    steps = scored.groupBy("lang", F.floor(F.col("score") * 1000).alias("step")).count()
    counts: dict[str, dict[int, int]] = {}
    for r in steps.collect():
        counts.setdefault(r["lang"], {})[r["step"]] = r["count"]
    low = {}
    for name, own in counts.items():
        left = LOW_SHARE * sum(own.values())
        for step in sorted(own):
            left -= own[step]
            if left < 0:
                low[name] = LOW_PART * step / 1000
                break
    return low


def identified(
    docs: DataFrame, profiles: Profiles, min_score: float | dict[str, float]
) -> DataFrame:
    """The rows with a known language and a score of at least ``min_score`` (one for all, or by
    language), as they came."""

    def least(name: str) -> float:
        return min_score.get(name, 0.0) if isinstance(min_score, dict) else min_score

    def compute(texts: list[str | None]) -> list[list]:
        found = [profiles.predict(t) for t in texts]
        return [[name != UNKNOWN and score >= least(name) for name, score in found]]

    field = T.StructField("known_language", T.BooleanType())
    return append_columns(docs, ["text"], [field], compute, None, field.name)

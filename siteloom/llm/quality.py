"""Quality rules: base counts, and lines marked as content or boilerplate by a conditional
random field.

Every line of a text becomes a few binary features (length, share of symbols and capitals, words
said twice in a row, copies within the text, ...); the most probable sequence of marks is found by Viterbi
decoding. A text is kept if enough of its words stand in content lines. The model is fitted on
labelled documents: lines of good documents count as content, lines of bad ones as boilerplate. Short
runs of lines of both are strung together for that, so that the marks change within a sequence.

Everything is local to a row, so there is no shuffle. Null text counts as no words; texts without
a word fail the base rule. Repeated rows get equal verdicts."""

from __future__ import annotations

import operator
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom.llm.crf import Crf, fit, viterbi
from siteloom.llm.rows import append_columns, long
from siteloom.session import cut_lineage

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MIN_CONTENT_SHARE = 0.5
#: Labelled documents per class that the model is fitted on, and the most lines one may have.
FIT_DOCUMENTS = 400
FIT_LINES = 120
#: Most lines of a run, and runs of a sequence, that the model is fitted on.
RUN_LINES = 6
RUNS = 12

_SYMBOL = re.compile("[#*$%&|<>]")
_DIGIT = re.compile("[0-9]")
_MULTIPLY = np.random.default_rng(8).integers(1, 2**63, WINDOW, dtype=np.uint64) | np.uint64(1)

# Steps of the graded features; a value gets the number of steps it reaches.
_STEPS = {
    "words": [1, 4, 8, 16, 40],
    "symbols": [0.02, 0.1, 0.3, 0.6],
    "capitals": [0.1, 0.3, 0.7],
    "stutter": [0.1, 0.3, 0.6],
    "digits": [0.02, 0.1, 0.3],
    "calls": [0.02, 0.1, 0.3],
    "copies": [2, 3, 6],
}
_OFFSET: dict[str, int] = {}
for _name, _steps in _STEPS.items():
    _OFFSET[_name] = sum(len(s) + 1 for s in list(_STEPS.values())[: len(_OFFSET)])
_FLAGS = sum(len(s) + 1 for s in _STEPS.values())
N_FEATURES = _FLAGS + 4  # bias, closed sentence, first line, last line


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of eight found twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.uint64)
    sums = sum(ids[j : j + n] * _MULTIPLY[j] for j in range(WINDOW))
    ordered = np.sort(sums)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    # Equal sums are nearly always equal windows; these few are compared in full.
    at = np.flatnonzero(np.isin(sums, twice))
    rows = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)[at]
    _, which, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    at = at[counts[which.ravel()] > 1]
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + WINDOW, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """Words, their characters, symbols, repeated lines, repeated words, and whether the rule
    on them fails."""
    text = text or ""
    # Bytes split at the ASCII white space exactly.
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(text.count(c) for c in " \t\n\v\f\r")
    lines = Counter(line for line in text.split("\n") if line.strip(" \t\n\v\f\r"))
    repeated = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * len(words)
    symbols = len(_SYMBOL.findall(text))
    return len(words), chars, symbols, lines.total() - len(lines), repeated, failed


def _grade(name: str, value: float) -> int:
    steps = _STEPS[name]
    return _OFFSET[name] + sum(value >= s for s in steps)


def line_features(text: str | None) -> tuple[list[list[int]], list[int]]:
    """Features and word counts of the lines that have a word."""
    lines = [s for s in (text or "").split("\n") if s.strip(" \t\n\v\f\r")]
    copies = Counter(lines)
    known: dict[str, tuple[list[int], int]] = {}
    features, sizes = [], []
    for i, line in enumerate(lines):
        if line not in known:
            words = line.split() or [line]
            n, chars = len(words), len(line)
            known[line] = (
                [
                    _grade("words", n),
                    _grade("symbols", len(_SYMBOL.findall(line)) / n),
                    _grade("capitals", sum(map(str.isupper, words)) / n),
                    _grade("stutter", sum(map(operator.eq, words, words[1:])) / n),
                    _grade("digits", len(_DIGIT.findall(line)) / chars),
                    _grade("calls", line.count("!") / n),
                    _grade("copies", copies[line]),
                    _FLAGS,
                ]
                + [_FLAGS + 1] * (words[-1][-1] in ".?!"),
                n,
            )
        own, n = known[line]
        features.append(own + [_FLAGS + 2] * (i == 0) + [_FLAGS + 3] * (i == len(lines) - 1))
        sizes.append(n)
    return features, sizes


def content_share(model: Crf, text: str | None) -> float:
    """Share of the words that stand in lines marked as content."""
    features, sizes = line_features(text)
    marks = viterbi(model, features)
    content = sum(n for n, mark in zip(sizes, marks, strict=True) if not mark)
    return content / sum(sizes) if sizes else 0.0


def spliced(
    documents: list[list[list[int]]], marks: list[int]
) -> tuple[list[list[list[int]]], list[list[int]]]:
    """Sequences of runs from all documents in mixed order, and the marks of their lines. Every line
    occurs once; the first and last line are those of the sequence."""
    rng = random.Random(8)
    ends = {_FLAGS + 2, _FLAGS + 3}
    runs = []
    for lines, mark in zip(documents, marks, strict=True):
        at = 0
        while at < len(lines):
            n = rng.randint(1, RUN_LINES)
            runs.append(([[f for f in x if f not in ends] for x in lines[at : at + n]], mark))
            at += n
    rng.shuffle(runs)
    sequences, states = [], []
    for k in range(0, len(runs), RUNS):
        own = runs[k : k + RUNS]
        sequence = [line for lines, _ in own for line in lines]
        sequence[0].append(_FLAGS + 2)
        sequence[-1].append(_FLAGS + 3)
        sequences.append(sequence)
        states.append([mark for lines, mark in own for _ in lines])
    return sequences, states


def fit_model(docs: DataFrame, labels: DataFrame) -> Crf | None:
    """Model from at most ``FIT_DOCUMENTS`` labelled documents per class, chosen by a hash of
    the id among those of at most ``FIT_LINES`` lines; None unless both classes occur.

    Only ids and line features of that bounded sample reach the driver."""
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    usable = docs.filter(F.col("text").isNotNull() & (lines <= FIT_LINES)).select("doc_id")
    marked = labels.filter(F.col("quality").isin(0, 1)).select("doc_id", "quality")
    marked = marked.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marked = marked.join(usable, "doc_id", "left_semi")
    marked = cut_lineage(marked)  # ids only, read once per class
    chosen: dict[int, int] = {}
    for quality in (0, 1):
        own = marked.filter(F.col("quality") == quality)
        rows = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCUMENTS).collect()
        chosen |= {r.doc_id: quality for r in rows}
    if len(set(chosen.values())) < 2:
        return None
    fields = [T.StructField("features", T.ArrayType(T.ArrayType(T.IntegerType())))]
    sample = docs.filter(F.col("doc_id").isin(list(chosen)) & (lines <= FIT_LINES))
    # Copies of an id count once, so the sample stays bounded.
    sample = sample.groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = append_columns(
        sample, ["text"], fields, lambda texts: [[line_features(t)[0] for t in texts]], ["doc_id"]
    ).collect()
    rows = sorted((r for r in rows if r.features), key=lambda r: r.doc_id)
    if len({chosen[r.doc_id] for r in rows}) < 2:
        return None
    documents = [[list(x) for x in r.features] for r in rows]
    return fit(*spliced(documents, [1 - chosen[r.doc_id] for r in rows]), N_FEATURES)


FIELDS = [
    *map(long, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("content_share", T.DoubleType()),
    T.StructField("kept", T.BooleanType()),
]


def judge(
    docs: DataFrame, model: Crf | None, carry: list[str] | None = None, keep: bool = False
) -> DataFrame:
    """Counts, content share and verdict per row of ``docs`` (column ``text``). Without a
    model, every line is content. ``keep``: only the kept rows, as they came."""

    def compute(texts: list[str | None]) -> list[list]:
        rows = []
        for text in texts:
            counts = base_counts(text)
            share = content_share(model, text) if model else float(counts[0] > 0)
            rows.append((*counts, share, not counts[-1] and share >= MIN_CONTENT_SHARE))
        return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in FIELDS]

    return append_columns(docs, ["text"], FIELDS, compute, carry, "kept" if keep else None)

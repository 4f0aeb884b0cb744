import itertools
import math
import random
import re
from collections import Counter

from siteloom.llm import crf, quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(8)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    n = len(words)
    return (
        n,
        sum(map(len, words)),
        len(re.findall("[#*$%&|<>]", text)),
        dups,
        len(covered),
        n < 20 or 100 * len(covered) > 30 * n,
    )


def test_base_counts(texts):
    loops = ["a b c d e f g h " * 3, "x " * 50, "a b c d e f g h i a b c d e f g h"]
    for text in texts + loops:
        assert quality.base_counts(text) == plain_counts(text)


def test_viterbi_is_the_best_of_all_paths():
    rng = random.Random(1)
    for n in (1, 2, 3, 6):
        model = crf.Crf(
            [rng.uniform(-2, 2) for _ in range(5)],
            [[rng.uniform(-1, 1) for _ in "ab"] for _ in "ab"],
        )
        items = [[f for f in range(5) if rng.random() < 0.5] for _ in range(n)]

        def score(path, items=items, model=model):
            own = sum(sum(model.emit[f] for f in x) for x, s in zip(items, path, strict=True) if s)
            return own + sum(model.move[a][b] for a, b in itertools.pairwise(path))

        best = max(itertools.product((0, 1), repeat=n), key=score)
        assert abs(score(crf.viterbi(model, items)) - score(best)) < 1e-9
    assert crf.viterbi(model, []) == []


def test_fit_learns_marks_and_runs():
    rng = random.Random(2)
    sequences, states = [], []
    for _ in range(60):
        marks = [int(i >= 5) for i in range(10)]
        states.append(marks)
        sequences.append([[0, 1 if (m if rng.random() < 0.8 else 1 - m) else 2] for m in marks])

    def right(model):
        return sum(
            a == b
            for x, y in zip(sequences, states, strict=True)
            for a, b in zip(crf.viterbi(model, x), y, strict=True)
        )

    # The process that made the data: four marks of five follow the feature, one switch.
    odds = math.log(4)
    truth = crf.Crf([0.0, odds, -odds], [[math.log(0.8), math.log(0.2)], [-20.0, 0.0]])
    alone = crf.Crf([0.0, odds, -odds], [[0.0, 0.0], [0.0, 0.0]])
    fitted = crf.fit(sequences, states, 3)
    assert right(fitted) > right(alone) and right(fitted) >= right(truth) - 12


GOOD = "Sentence {0}{1} of plain words{1} says a{1} few different{0} things{1} here."
BAD = "$$$ {} ### && %% BUY NOW ** $$$ || <> ## {} &&"


def corpus(spark):
    rows = []
    for i in range(40):
        line = GOOD if i % 2 else BAD
        rows.append((i, "\n".join(line.format(i, j) for j in range(6)), "x", i % 2))
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, quality int")


def test_model_keeps_content_and_drops_boilerplate(spark, texts):
    docs = corpus(spark)
    model = quality.fit_model(docs, docs.select("doc_id", "quality"))
    rows = quality.judge(docs, model, ["doc_id", "quality", "kept"]).collect()
    assert all(r.kept == bool(r.quality) for r in rows)
    # The old column of that name gave way; nothing else did.
    assert rows[0].asDict().keys() >= {"doc_id", "quality", "content_share"}
    kept = quality.judge(docs, model, keep=True)
    assert kept.columns == docs.columns and kept.count() == 20

    odd = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.judge(odd, model, ["doc_id"]).collect():
        assert plain_counts(texts[r.doc_id]) == tuple(r)[1:7]
        assert r.kept == (not r.base_failed and quality.content_share(model, texts[r.doc_id]) >= 0.5)


def test_without_labels_or_rows(spark):
    docs = corpus(spark)
    none = docs.select("doc_id", "quality").limit(0)
    assert quality.fit_model(docs, none) is None
    assert quality.fit_model(docs.limit(0), docs) is None
    rows = quality.judge(docs, None, ["doc_id"]).collect()
    assert all(r.kept for r in rows if not r.base_failed)
    assert quality.judge(docs.limit(0), None).count() == 0


def test_marks_change_within_a_text(spark):
    docs = corpus(spark)
    model = quality.fit_model(docs, docs.select("doc_id", "quality"))
    for marks in ([0, 0, 0, 1, 0, 0, 1, 0, 0, 0], [1, 1, 0, 0, 0, 0, 1], [0, 1] * 6):
        lines = [(BAD if mark else GOOD).format(i, 99) for i, mark in enumerate(marks)]
        features, sizes = quality.line_features("\n".join(lines))
        assert crf.viterbi(model, features) == marks
        content = sum(n for n, mark in zip(sizes, marks, strict=True) if not mark)
        assert quality.content_share(model, "\n".join(lines)) == content / sum(sizes)


def test_spliced_runs_hold_every_line_once():
    documents = [[[d, i] for i in range(1 + 7 * d % 23)] for d in range(30)]
    sequences, states = quality.spliced(documents, [d % 2 for d in range(30)])
    lines = [(x[0], x[1], mark) for s, m in zip(sequences, states, strict=True) for x, mark in zip(s, m, strict=True)]
    assert sorted(lines) == sorted((d, i, d % 2) for d in range(30) for i in range(len(documents[d])))
    assert sum(len(set(m)) > 1 for m in states) > len(states) / 2

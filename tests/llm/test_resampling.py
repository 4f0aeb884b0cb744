"""Checksums, features, weights and draws against plain code; the query against its SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from siteloom.llm import resampling

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return words, [zlib.crc32(f.encode()) % 10000 for f in runs]


def plain(rows, target):
    own = [(i, *features(t)) for i, t in rows]
    s, t = Counter(), Counter()
    for _, _, f in own:
        s.update(f)
    for text in target:
        t.update(features(text)[1])
    all_s, all_t = s.total() + 10000, t.total() + 10000
    gain = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in range(10000)]
    out = []
    for i, words, f in own:
        name = f"42:{'' if i is None else i}"
        h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        out.append((i, len(f), weight, score, len(words) >= 20))
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0], r[1]))
    drawn = fit[: len(fit) * 5 // 100]
    result = [(*r[:4], k + 1) for k, r in enumerate(drawn)]
    left = [(*r[:4], None) for r in out]
    for r in drawn:
        left.remove((*r[:4], None))
    return sorted(result + left, key=repr)


def run(spark, rows, target, parts=3):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, weight string, score int")
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    return sorted(map(tuple, resampling.resampled(docs.repartition(parts), goal).collect()), key=repr)


def test_checksums():
    rng = np.random.default_rng(1)
    flat = rng.integers(0, 256, 60_000).astype(np.uint8)
    length = np.concatenate([rng.integers(0, 400, 500), [0, 1, 63, 64, 65, 127, 128, 129, 192, 5000, 30_000]])
    start = np.array([rng.integers(0, len(flat) - n + 1) for n in length])
    got = resampling.crc32s(flat, start, length)
    assert got.tolist() == [zlib.crc32(flat[s : s + n].tobytes()) for s, n in zip(start, length, strict=True)]
    assert resampling.crc32s(flat, start[:0], length[:0]).tolist() == []


@pytest.mark.parametrize("sizes", [(2_000_000, 250_000, 4_000_000), (30, 4, 50), (1, 1, 1), (200, 7, 100)])
def test_features(monkeypatch, texts, sizes):
    for name, size in zip(("PART", "WORDS", "CELLS"), sizes, strict=True):
        monkeypatch.setattr(resampling, name, size)
    texts = [t if t is None else t[:3000] for t in texts]
    texts += ["x" * 700 + " É" + "ß" * 200 + " A1-b2_c3\x7f[d]`e`", "ends with a word", "starts", "日本 語", "-", "a\x00b"]
    got = [Counter() for _ in texts]
    words = []
    for at, own in resampling._parts(texts):
        n, some = resampling._part_features(own, 10_000)
        words += n.tolist()
        for owner, bucket in some:
            for i, b in zip(owner.tolist(), bucket.tolist(), strict=True):
                got[at + i][b] += 1
    assert words == [len(features(t)[0]) for t in texts]
    assert got == [Counter(features(t)[1]) for t in texts]


def test_against_plain_code(spark, texts):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)] + ["Ünï", "A9"]
    many = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    rows = list(enumerate([*texts, *many]))
    rows += [(7, many[3])] * 40 + [(None, many[4]), (None, many[5])]  # repeated rows, ids of none
    target = [many[0], many[1].upper(), None, "", "w1 w2 w3"]
    assert run(spark, rows, target) == plain(rows, target)


def test_nothing(spark):
    rows = [(1, "a b c"), (2, None)]
    assert run(spark, [], ["a b"]) == []
    assert run(spark, rows, []) == plain(rows, [])

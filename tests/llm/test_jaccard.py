import random
import re
from collections import Counter

import numpy as np
import pytest

from siteloom.llm import jaccard

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_set(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    if len(words) < 4:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)}


def plain_roots(sets):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 100 * common >= 85 * (len(a) + len(sets[j]) - common):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(sets))]


def plain_components(rows):
    """Smallest non-null id per component."""
    roots = plain_roots([plain_set(t) for _, t in rows])
    out = []
    for (doc_id, text), r in zip(rows, roots, strict=True):
        ids = [d for (d, _), x in zip(rows, roots, strict=True) if x == r and d is not None]
        out.append(doc_id if not plain_set(text) else min(ids, default=None))
    return out


def test_shingles(texts):
    seen = {}
    for text in texts:
        want = plain_set(text)
        got = jaccard.shingles(text)
        assert len(got) == len(want) and np.all(got[1:] > got[:-1])
        assert seen.setdefault(got.tobytes(), want) == want


@pytest.mark.parametrize("size", [1, 5, 6, 7, 12, 30, 47, 60, 100, 300])
def test_a_probe_meets_every_partner(size):
    """Sets at the very edge of the threshold, with differences spread or piled up."""
    rng = np.random.default_rng(size)
    for _ in range(60):
        a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        common = rng.permutation(a)
        lost = rng.integers(0, jaccard.differing(size) + 1)
        base = common[lost:]
        added = rng.integers(0, 2**64, rng.integers(0, size), dtype=np.uint64)
        for k in range(len(added), -1, -1):
            b = np.unique(np.concatenate([base, added[:k]]))
            if jaccard.linked(a, b):
                break
        else:
            continue
        small, large = sorted((a, b), key=len)
        probe, _ = jaccard.signatures(small)
        first, rest = jaccard.signatures(large)
        together = np.concatenate([first, rest])
        if jaccard.fingerprint(small) != jaccard.fingerprint(large):
            assert len(np.intersect1d(probe, together))


def test_components_against_all_pairs(spark, texts):
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    rows += [(1000, texts[9]), (1000, texts[9]), (None, texts[9]), (None, "no id at all here"), (7, None)]
    rng = random.Random(6)
    chain = [f"c{i}" for i in range(60)]
    for k in range(25):  # neighbours are linked, the ends are not
        rows.append((2000 + k, " ".join(chain)))
        chain[rng.randrange(60)] = f"n{k}"
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, sig int")
    got = Counter(tuple(r) for r in jaccard.jaccard_components(docs).collect())
    sizes = [len(plain_set(t)) for _, t in rows]
    want = Counter(zip([d for d, _ in rows], sizes, plain_components(rows), strict=True))
    assert got == want


def test_one_of_each(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(9, texts[9]), (12, texts[30]), (12, None), (None, texts[9]), (None, "lone text without id")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, root string")
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    roots = plain_roots([plain_set(t) for _, t in rows])
    of = {}
    for (d, t), r in zip(rows, roots, strict=True):
        if plain_set(t):
            of.setdefault(r, []).append((d is None, d, t))
    bare = sum(not plain_set(t) for _, t in rows)
    assert len(got) == len(of) + bare
    by_set = {frozenset(plain_set(t)): r for (_, t), r in zip(rows, roots, strict=True)}
    for r in got:
        if plain_set(r.text):
            best = min((n, d) for n, d, _ in of[by_set[frozenset(plain_set(r.text))]] if d is not None) \
                if any(d is not None for _, d, _ in of[by_set[frozenset(plain_set(r.text))]]) else (True, None)
            assert (r.doc_id is None, r.doc_id) == best
    assert jaccard.one_of_each(docs.limit(0)).count() == 0
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0


def test_long_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 400)], "a long, b long")
    roots = {r["class"]: r.root for r in jaccard.components(edges).collect()}
    assert roots == {**{i: 0 for i in range(101)}, 400: 400, 500: 400}

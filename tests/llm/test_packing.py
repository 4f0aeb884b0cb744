import itertools
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from siteloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_are_those_of_the_tokenizer(texts):
    special = ["x <|endoftext|> y", "İstanbul ΣΑΣ ΑΣ", "é café", "a b", "​zero", "'s's 'S it'S"]
    plain = Tokenizer.from_file(PATH)
    words = packing.WordIds(PATH)
    for text, raw in zip(texts + special, words(texts + special), strict=True):
        want = plain.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(raw, "<u4").tolist() == want, text


def test_forgetting_words_changes_nothing(texts, monkeypatch):
    whole = list(packing.WordIds(PATH)(texts))
    monkeypatch.setattr(packing, "CACHE", 5)
    assert list(packing.WordIds(PATH)(texts)) == whole


def test_words_of_letters_are_not_cut(texts):
    """Only words that may hold more than one piece go through the pattern, and each once."""
    words = packing.WordIds(PATH)
    asked, cut = [], words.split
    words.split = lambda word: asked.append(word) or cut(word)
    plain = Tokenizer.from_file(PATH)
    given = ["Alpha beta, Alpha's 12 beta,", "alpha ÉTÉ été x1"]
    for text, raw in zip(given * 2, words(given * 2), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert sorted(asked) == ["12", "alpha's", "beta,", "x1"]
    # What a text lacks is told by sets, not word by word.
    lookups = []

    class Known(dict):
        def __contains__(self, word):
            lookups.append(word)
            return super().__contains__(word)

    words.known = Known(words.known)
    assert len(list(words(["alpha beta, " * 500]))) == 1
    assert len(lookups) <= 2


def check(bins, lengths, size):
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= size for b in bins)


def test_search_empties_bins_that_best_fit_leaves():
    rng = random.Random(4)
    better = 0
    for _ in range(300):
        # Bins cut at random are full by construction.
        lengths = []
        for _ in range(8):
            cuts = sorted(rng.sample(range(1, 100), 3))
            lengths += [b - a for a, b in zip([0, *cuts], [*cuts, 100], strict=True)]
        rng.shuffle(lengths)
        first = packing.best_fit(lengths, 100)
        after = packing.local_search(first, lengths, 100)
        check(first, lengths, 100)
        check(after, lengths, 100)
        assert 8 <= len(after) <= len(first)
        better += len(after) < len(first)
    assert better > 30


def test_search_ends_on_hopeless_input():
    lengths = [60] * 3000
    bins = packing.local_search(packing.best_fit(lengths, 100), lengths, 100)
    assert len(bins) == 3000


def steps(a, b, size):
    """Plainly: does a move, an exchange of one for one, or of two for one from ``a`` to the fuller
    ``b`` raise the squared fill?"""
    outs = {0: [()], 1: [(x,) for x in a], 2: list(itertools.combinations(a, 2))}
    backs = {0: [()], 1: [(x,) for x in b], 2: list(itertools.combinations(b, 2))}
    for n, m in ((1, 0), (1, 1), (2, 1), (1, 2)):
        for out in outs[n]:
            for back in backs[m]:
                moved = sum(out) - sum(back)
                fa, fb = sum(a) - moved, sum(b) + moved
                if moved > 0 and fb <= size and fa**2 + fb**2 > sum(a) ** 2 + sum(b) ** 2:
                    return True
    return False


def test_search_leaves_no_step_between_any_two_bins():
    rng = random.Random(7)
    ended = 0
    for trial in range(150):
        low = rng.choice([1, 20, 31])
        lengths = [rng.randint(low, rng.choice([45, 60])) for _ in range(rng.randint(2, 60))]
        after = packing.local_search(packing.best_fit(lengths, 100), lengths, 100)
        check(after, lengths, 100)
        if len(after) == -(-sum(lengths) // 100):
            continue
        ended += 1
        own = [[lengths[i] for i in b] for b in after]
        for a, b in itertools.permutations(own, 2):
            if sum(a) <= sum(b):
                assert not steps(a, b, 100), (trial, a, b)
    assert ended > 20


def test_search_reaches_bins_beyond_any_window():
    """Figures of a plan that tries only some of the bins: 2,352 and 6,943."""
    for n, low, high, most in ((6000, 1300, 1450, 2260), (20_000, 700, 2000, 6820)):
        rng = random.Random(1)
        lengths = [rng.randint(low, high) for _ in range(n)]
        after = packing.local_search(packing.best_fit(lengths), lengths)
        check(after, lengths, packing.SEQUENCE)
        assert len(after) <= most


def test_pack(spark, texts):
    rows = [(i, t, "mine") for i, t in enumerate(texts)] + [(3, "one", "twice"), (None, "no id", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    tokenizer = Tokenizer.from_file(PATH)
    for size, block in ((64, 20), (4096, 10_000)):
        result = packing.pack(docs, PATH, size, block).collect()
        sequences = defaultdict(list)
        for r in result:
            sequences[r.sequence_id].append((r.offset, r.length))
        for own in sequences.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= size
        want, total = [], 0
        for doc_id, text, _ in rows:
            ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
            total += len(ids)
            for k, s in enumerate(range(0, len(ids), size)):
                own = ids[s : s + size]
                want.append((doc_id, k, s, len(own), zlib.crc32(own.tobytes())))
        assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in result)
        blocks = math.ceil(len(want) / block)
        assert len(sequences) <= math.ceil(total / size) * 1.02 + blocks
    assert packing.pack(docs.limit(0), PATH).count() == 0

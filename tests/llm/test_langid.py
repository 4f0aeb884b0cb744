import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siteloom.llm import langid


def plain_grams(text):
    cleaned = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    counts = Counter()
    for word in cleaned.split():
        padded = f"\0{word}\0"
        counts.update(word)
        counts.update(padded[i : i + 2] for i in range(len(padded) - 1))
        counts.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return counts


def decoded(gram):
    parts = [gram >> s & 0x1FFFFF for s in (42, 21, 0)]
    if gram >> 63:
        return chr(parts[2])
    return "".join(map(chr, parts[1:] if parts[0] == 0x1FFFFF else parts))


def test_gram_counts(texts):
    for text in [*texts, "ab", "Ab. ba", "é"]:
        grams, counts = langid.gram_counts(text)
        got = {decoded(g): n for g, n in zip(grams.tolist(), counts.tolist(), strict=True)}
        assert got == plain_grams(text)
        assert np.all(grams[1:] > grams[:-1])


def language(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(3)) for _ in range(n))


def corpus(spark):
    rng = random.Random(3)
    kinds = {"xx": ["ka", "lo", "mi"], "yy": ["str", "ung", "ach"], "zz": ["eau", "ou", "é"]}
    rows = [(i, language(rng, kinds[k], 30), k) for i in range(90) for k in [sorted(kinds)[i % 3]]]
    rows += [(900, "12 .,", "xx"), (901, None, "yy"), (902, "kalomi", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy_and_odd_rows(spark, texts):
    docs = corpus(spark)
    profiles = langid.learn(docs.filter("doc_id % 5 <> 0"))
    assert profiles.names == ["xx", "yy", "zz"]
    rows = {r.doc_id: r for r in langid.identify(docs, profiles).collect()}
    held = [r for r in rows.values() if r.doc_id < 90 and r.doc_id % 5 == 0]
    assert all(r.lang_pred == r.lang for r in held)
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert rows[900].lang_pred == rows[901].lang_pred == "und" and rows[901].score == 0
    assert rows[902].lang_pred == "xx"
    kept = langid.identified(docs, profiles, 0.0)
    assert kept.columns == docs.columns and kept.count() == 91
    odd = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    for r in langid.identify(odd, profiles).collect():
        letters = any(c.isalpha() for c in texts[r.doc_id] or "")
        assert (r.lang_pred == "und") == (not letters)


def test_profiles_count_all_texts(spark):
    docs = corpus(spark)
    profiles = langid.learn(docs)
    counts = Counter()
    rows = docs.filter("lang = 'yy'").collect()
    for r in rows:
        for g, n in zip(*langid.gram_counts(r.text), strict=True):
            counts[int(g)] += int(n)
    best = sorted(counts, key=lambda g: (-counts[g], g))[: langid.PROFILE]
    j = profiles.names.index("yy")
    own = {int(g): int(r) for g, r in zip(profiles.grams, profiles.ranks[:, j], strict=True)}
    assert [own[g] for g in best] == list(range(len(best)))


def test_nothing_learned(spark):
    docs = corpus(spark)
    empty = langid.learn(docs.limit(0))
    assert empty.predict("words") == ("und", 0.0)
    assert langid.identify(docs.limit(0), langid.learn(docs)).count() == 0


def test_stage_drops_random_letters_and_unlearned_languages(spark):
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    clean = spark.read.parquet(f"{folder}/documents.parquet")
    clean = clean.filter(F.size(F.split("text", r"\s+")) >= 20).select("doc_id", "text", "lang")
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    odd = [" ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(n)) for n in (30, 300, 3000)]
    odd += [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem"
        " i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja"
        " omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    ]
    # Rows without an id are judged, and nothing is learned from them.
    rows = spark.createDataFrame([(None, t, "en") for t in odd], "doc_id long, text string, lang string")
    kept = corpus_pipeline.language_id(spark, clean.unionByName(rows), folder).collect()
    assert not {r.text for r in kept} & set(odd)
    assert len(kept) == clean.count()


def test_low_scores_by_language(spark):
    docs = corpus(spark)
    profiles = langid.learn(docs)
    low = langid.low_scores(docs, profiles)
    scores = [r.score for r in langid.identify(docs, profiles).collect() if r.lang == r.lang_pred == "yy"]
    assert sorted(low) == ["xx", "yy", "zz"]
    assert low["yy"] == langid.LOW_PART * math.floor(sorted(scores)[1] * 1000) / 1000
    assert langid.low_scores(docs.limit(0), profiles) == {}
    assert langid.identified(docs, profiles, low).count() == 91

import hashlib
import random
from collections import Counter

from siteloom.llm import mixing

SCHEMA = "doc_id long, source string, lang string, topic string, n_tokens long, kept string"


def corpus(spark, n=3000):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        source = "hot" if rng.random() < 0.34 else rng.choice(["a", "b", None, ""])
        lang = rng.choice(["en"] * 6 + ["de", "fr", None])
        topic = rng.choice(["prose"] * 4 + ["table"])
        rows.append((i, source, lang, topic, rng.randrange(1, 60), "old"))
    rows += [rows[5], rows[5], (None, "a", "en", "prose", 7, "")]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_margins_meet_their_targets(spark):
    rows, docs = corpus(spark)
    got = mixing.mixed(docs, budget=0.2).collect()
    assert len(got) == len(rows)
    for at, name in enumerate(("source", "lang", "topic"), 1):
        tokens, weight = Counter(), Counter()
        for r in rows:
            tokens[r[at]] += r[4]
        for r in got:
            weight[r[name]] += r.n_tokens * r.probability
        total, roots = sum(weight.values()), sum(n**0.5 for n in tokens.values())
        for value, n in tokens.items():
            assert abs(weight[value] / total - n**0.5 / roots) < 1e-6, (name, value)
    assert abs(total - 0.2 * sum(r[4] for r in rows)) < 1e-3 * total
    drawn = sum(r.n_tokens for r in got if r.kept)
    assert abs(drawn / total - 1) < 0.15


def test_a_row_is_drawn_by_its_id_alone(spark):
    rows, docs = corpus(spark)
    got = mixing.mixed(docs.repartition(7), budget=0.3).collect()
    for r in got:
        text = "mix" + ("" if r.doc_id is None else str(r.doc_id))
        assert r.kept == (int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 16**13 < r.probability)
    assert all(0 < r.probability <= 1 for r in got)


def test_exhausted_cells_are_taken_whole(spark):
    docs = spark.createDataFrame(
        [(i, "big", "en", "prose", 50, "") for i in range(200)] + [(900, "tiny", "en", "prose", 3, "")], SCHEMA
    )
    got = {r.source: r.probability for r in mixing.mixed(docs, budget=0.5).collect()}
    assert got["tiny"] == 1.0 and 0.4 < got["big"] < 0.6


def test_tokens_topics_and_empty_table(spark, texts):
    docs = spark.createDataFrame([(i, t, "a", "en", "t") for i, t in enumerate(texts)],
                                 "doc_id long, text string, source string, lang string, topic string")
    counted = mixing.with_tokens(docs).withColumn("topic", mixing.topic_of("text"))
    for r in counted.collect():
        assert r.n_tokens == len(texts[r.doc_id] or "") // 4 + 1
        assert (r.topic is None) == (texts[r.doc_id] is None)
    assert mixing.mixed(counted).count() == len(texts)
    assert mixing.mixed(counted.limit(0)).count() == 0

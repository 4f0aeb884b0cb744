import zlib
import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from siteloom.llm import sharding


def plain_jump(key, shards):
    """The published loop."""
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * sharding.MULTIPLIER + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_follows_the_loop(spark):
    keys = [0, 1, 2, 2**31, 2**32 - 1, 2**32, 2**63, 2**64 - 1] + [
        int(hashlib.md5(str(i).encode()).hexdigest()[:16], 16) for i in range(500)
    ]
    df = spark.createDataFrame([(k >> 32, k & 0xFFFFFFFF, str(k)) for k in keys], "high long, low long, k string")
    counts = (1, 2, 24, 25, 100)
    rows = df.select(
        "k", *[sharding.jump_shard(F.col("high"), F.col("low"), n).alias(f"s{n}") for n in counts]
    ).collect()
    for r in rows:
        for n in counts:
            assert r[f"s{n}"] == plain_jump(int(r.k), n), (r.k, n)


def test_shards(spark, texts, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET", 2)  # many buckets per shard
    rows = [(i, t, "x") for i, t in enumerate(texts * 6)]
    rows += [(3, texts[20], "again")] * 40 + [(None, "no id", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").select("doc_id", "text")
    got = sharding.sharded(docs, 24).collect()
    assert len(got) == len(rows)
    want = sorted(
        (repr(d), 8 + len((t or "").encode()), None if t is None else zlib.crc32(t.encode()))
        for d, t, _ in rows
    )
    assert sorted(((repr(r.doc_id), r.size, r.text_crc32) for r in got), key=repr) == sorted(want, key=repr)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        key = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:16], 16)
        assert r.shard == plain_jump(key, 24) and r.grown_shard == plain_jump(key, 25)
        assert r.grown_shard in (r.shard, 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.sharded(docs.limit(0), 24).count() == 0

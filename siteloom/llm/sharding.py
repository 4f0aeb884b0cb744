"""Sharding by jump consistent hashing.

A key and the number of shards decide the shard, without a table; when a shard is appended, a key
either stays or moves to the new one. The key is 60 bits of the MD5 of the id. Slots within a shard
are gapless: rows are numbered inside buckets of bounded size, and one row per bucket is summed up
over the shard.

Null text has no bytes and a null checksum; a null id is hashed as empty. Rows that repeat an id share
its shard and get slots of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.session import cut_lineage

#: Rows numbered together in one task, about.
BUCKET = 4096
_OVERHEAD = 8
# Fixed value: the multiplier of the published algorithm's generator.
MULTIPLIER = 2862933555777941757
_M0, _M1, _M2 = (MULTIPLIER >> s & 0x3FFFFF for s in (0, 22, 44))


def _next_key(key: Column) -> Column:
    """``key * MULTIPLIER + 1`` modulo 2^64, for a struct of the high and low 32 bits; products
    stay below 2^63, so it holds under ANSI overflow checks."""
    low32 = F.lit(0xFFFFFFFF)
    low, high = key["low"], key["high"]
    # low * MULTIPLIER in three parts of 22 bits, shifted by 0, 22 and 44.
    p0, p1, p2 = (low * F.lit(m) for m in (_M0, _M1, _M2))
    r1 = p1.bitwiseAND(F.lit((1 << 42) - 1))  # what is above is shifted out of 64 bits
    r2 = p2.bitwiseAND(F.lit((1 << 20) - 1))
    # Low halves and carries of p0 + (r1 << 22) + (r2 << 44) + 1.
    s1_low = F.shiftleft(r1.bitwiseAND(F.lit((1 << 10) - 1)), 22)
    s1_high = F.shiftright(r1, 10)
    total_low = p0.bitwiseAND(low32) + s1_low + F.lit(1)
    total_high = F.shiftright(p0, 32) + s1_high + F.shiftleft(r2, 12) + F.shiftright(total_low, 32)
    # high * MULTIPLIER matters modulo 2^32 only.
    m_low, m_high = MULTIPLIER & 0xFFFF, MULTIPLIER >> 16 & 0xFFFF
    cross = (high * F.lit(m_low)) + F.shiftleft((high * F.lit(m_high)).bitwiseAND(F.lit(0xFFFF)), 16)
    return F.struct(
        (total_high + cross).bitwiseAND(low32).alias("high"),
        total_low.bitwiseAND(low32).alias("low"),
    )


def jump_shard(high: Column, low: Column, shards: int) -> Column:
    """Shard of a 64-bit key given as two longs of 32 bits. Every step jumps ahead by one shard at
    least, so ``shards`` steps are enough for any key."""
    start = F.struct(
        F.struct(high.alias("high"), low.alias("low")).alias("key"),
        F.lit(-1).cast("long").alias("at"),
        F.lit(0).cast("long").alias("next"),
    )

    def step(state: Column, _: Column) -> Column:
        key = _next_key(state["key"])
        # (key >> 33) + 1
        divisor = F.shiftright(key["high"], 1) + F.lit(1)
        jump = (state["next"] + F.lit(1)).cast("double") * (F.lit(float(1 << 31)) / divisor)
        moved = F.struct(
            key.alias("key"), state["next"].alias("at"), F.floor(jump).cast("long").alias("next")
        )
        return F.when(state["next"] < F.lit(shards), moved).otherwise(state)

    steps = F.sequence(F.lit(1), F.lit(shards))
    return F.aggregate(steps, start, step, lambda s: s["at"]).cast("int")


def sharded(docs: DataFrame, shards: int) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs``
    (``doc_id, text``)."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))

    def half(at: int) -> Column:
        return F.conv(F.substring(digest, at, 8), 16, 10).cast("long")

    keyed = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + _OVERHEAD).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        half(1).alias("high"),
        half(9).alias("low"),
        F.monotonically_increasing_id().alias("order"),
    )
    placed = keyed.select(
        "doc_id",
        "size",
        "text_crc32",
        "order",
        jump_shard(F.col("high"), F.col("low"), shards).alias("shard"),
        jump_shard(F.col("high"), F.col("low"), shards + 1).alias("grown_shard"),
    )
    # Written out: rows and their order number are the same for counting and numbering.
    placed = cut_lineage(placed)
    buckets = max(1, -(-placed.count() // (BUCKET * shards)))
    rows = placed.withColumn("bucket", F.pmod(F.xxhash64("order"), F.lit(buckets)))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        rows.groupBy("shard", "bucket")
        .agg(F.count("*").alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    inside = Window.partitionBy("shard", "bucket").orderBy("order")
    return (
        rows.withColumn("place", F.row_number().over(inside) - 1)
        .join(offsets, ["shard", "bucket"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("place") + F.col("offset")).cast("long").alias("slot"),
            "grown_shard",
        )
    )

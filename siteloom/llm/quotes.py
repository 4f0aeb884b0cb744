"""Quotation linking: messages without their quotes, in the order of replies.

A line that starts with ``>`` marks is a quote of that level; a run of lines of one level is a
passage. Passages, their paragraphs and their lines are normalised and hashed, and so is what every
message says itself. A passage belongs to the earlier message of its conversation that shares most
of its characters, the latest of several. A message answers the one that its outermost passage
belongs to, else the message before it. Only messages with quotes are taken apart into lines.

In the result a reply stands below the message it answers, before later answers to that. Turns that
answer the one before form a branch; sizes and offsets of branches are added up by pointer doubling,
in as many rounds as the logarithm of the deepest nesting, and siblings in buckets, so that no
conversation meets in one task.

A null text has no words; a message of a null conversation or turn is left as it is, without a link.
Rows that repeat a turn stand side by side, with positions of their own. Of equal passages the latest
earlier one is taken. Very long texts are taken apart by line, each within its row. An empty table
gives no rows. Columns besides the four that are read do not go along, whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.operators.prefix import running_max, running_rank
from siteloom.session import cut_lineage

_MARKS = r"^((?:[ \t]*>)+)"
_QUOTED = r"(?m)^[ \t]*>"
# A line that only introduces a quote.
_INTRODUCTION = r"(?i)^[ \t]*(on\b.{0,200}\bwrote|.{0,100}\b(said|writes)):[ \t\r]*$"
#: Turns ordered together in one task.
TURNS = 1000


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 1), "[ \t]", ""))


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\s\p{Punct}]+", " "))


def own_text(text: Column) -> Column:
    """The text without quoted lines and the lines that introduce them."""
    lines = F.split(text, "\n")
    kept = F.filter(
        lines,
        lambda line, i: (level(line) == 0)
        & ~(line.rlike(_INTRODUCTION) & (level(F.coalesce(F.get(lines, i + 1), F.lit(""))) > 0)),
    )
    plain = F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", "")
    return F.when(text.rlike(_QUOTED), plain).otherwise(text)


def _units(text: Column) -> Column:
    """Hashes and lengths of the text, its paragraphs and its lines, each once."""
    parts = F.concat(F.array(text), F.split(text, r"\n\s*\n"), F.split(text, "\n"))
    whole = F.filter(F.transform(parts, normalised), lambda s: s != "")
    return F.transform(
        F.array_distinct(whole),
        lambda s: F.struct(F.md5(s).alias("hash"), F.length(s).cast("long").alias("weight")),
    )


def passages(messages: DataFrame) -> DataFrame:
    """``message, conv_id, turn, passage, level, quote`` of every run of quoted lines."""
    lines = messages.filter(F.col("text").rlike(_QUOTED)).select(
        "message", "conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("at", "line")
    )
    lines = lines.withColumn("level", level(F.col("line"))).filter("level > 0")
    order = Window.partitionBy("message").orderBy("at")
    new = (F.lag("at").over(order) != F.col("at") - 1) | (F.lag("level").over(order) != F.col("level"))
    starts = lines.withColumn("start", F.coalesce(new, F.lit(True)).cast("int"))
    runs = starts.withColumn(
        "passage", F.sum("start").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    # One message's own lines: bounded by its text.
    line = F.struct("at", F.regexp_replace("line", _MARKS + "[ \t]?", "").alias("line"))
    return (
        runs.groupBy("message", "conv_id", "turn", "passage", "level")
        .agg(F.array_sort(F.collect_list(line)).alias("lines"))
        .withColumn("quote", F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
        .drop("lines")
    )


def linked_passages(messages: DataFrame, quoted: DataFrame) -> DataFrame:
    """``message, passage, level, original``: the turn that a passage was taken from."""
    asks = quoted.select(
        "message", "conv_id", "turn", "passage", "level", F.explode(_units(F.col("quote"))).alias("u")
    )
    says = (
        messages.join(quoted.select("conv_id").distinct(), "conv_id", "left_semi")
        .select("conv_id", "turn", F.explode(_units(F.col("own"))).alias("u"))
        .select("conv_id", "turn", "u.hash", "u.weight")
        .distinct()
    )
    asking = asks.select(
        "conv_id", "turn", "u.hash", "u.weight", "message", "passage", "level", F.lit(0).alias("kind")
    )
    both = asking.unionByName(says.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    # Asking rows come first within a turn, so that they see earlier turns only.
    found = running_max(
        both,
        ["conv_id", "hash"],
        [F.col("turn"), F.col("kind")],
        F.when(F.col("kind") == 1, F.col("turn")),
        F.floor(F.col("turn") / TURNS),
    ).filter("kind = 0 and running_max is not null")
    votes = found.groupBy("message", "passage", "level", "running_max").agg(
        F.sum("weight").alias("weight")
    )
    return votes.groupBy("message", "passage", "level").agg(
        F.max_by("running_max", F.struct("weight", "running_max")).alias("original")
    )


def _previous(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, before``: the turn before every turn."""
    turns = messages.select("conv_id", "turn").distinct()
    events = turns.withColumn("kind", F.explode(F.array(F.lit(0), F.lit(1))))
    found = running_max(
        events,
        ["conv_id"],
        [F.col("turn"), F.col("kind")],
        F.when(F.col("kind") == 1, F.col("turn")),
        F.floor(F.col("turn") / TURNS),
    )
    return found.filter("kind = 0").select("conv_id", "turn", F.col("running_max").alias("before"))


def reply_ordered(conversations: DataFrame) -> DataFrame:
    """``conv_id, position, turn, role, reply_to, quoted, depth, text`` per message, ``text``
    without quotes; ``quoted``: whether ``reply_to`` comes from a quote; ``depth``: quote
    levels."""
    messages = cut_lineage(
        conversations.select("conv_id", "turn", "role", "text")
        .withColumn("message", F.monotonically_increasing_id())
        .withColumn("own", own_text(F.col("text")))
    )
    placed = messages.filter("conv_id is not null and turn is not null")
    quoted = cut_lineage(passages(placed))
    links = cut_lineage(linked_passages(placed, quoted))
    answers = links.groupBy("message").agg(
        # The outermost passage, the first of several.
        F.min_by("original", F.struct("level", "passage")).alias("original")
    )
    depths = quoted.groupBy("message").agg(F.max("level").alias("depth"))
    # Rows that repeat a turn answer the same.
    by_turn = placed.select("message", "conv_id", "turn").join(answers, "message")
    by_turn = by_turn.groupBy("conv_id", "turn").agg(F.max("original").alias("original"))
    turns = _previous(placed).join(by_turn, ["conv_id", "turn"], "left")
    turns = cut_lineage(
        turns.withColumn("reply_to", F.coalesce("original", "before")).withColumn(
            "starts", F.col("before").isNull() | (F.col("reply_to") != F.col("before"))
        )
    )
    # Turns that answer the one before form a branch with it.
    branched = cut_lineage(
        running_max(
            turns,
            ["conv_id"],
            [F.col("turn")],
            F.when(F.col("starts"), F.col("turn")),
            F.floor(F.col("turn") / TURNS),
        ).withColumnRenamed("running_max", "branch")
    )
    ranked = running_rank(
        placed.select("message", "conv_id", "turn").join(
            branched.select("conv_id", "turn", "branch"), ["conv_id", "turn"]
        ),
        ["conv_id", "branch"],
        [F.col("turn"), F.col("message")],
        F.floor(F.col("turn") / TURNS),
    )
    offsets = _branch_offsets(branched, placed)
    positions = ranked.join(offsets, ["conv_id", "branch"]).select(
        "message", (F.col("offset") + F.col("running_rank")).cast("long").alias("position")
    )
    replies = turns.select("conv_id", "turn", "reply_to", F.col("original").isNotNull().alias("quoted"))
    return (
        messages.join(positions, "message", "left")
        .join(replies, ["conv_id", "turn"], "left")
        .join(depths, "message", "left")
        .select(
            "conv_id",
            "position",
            "turn",
            "role",
            "reply_to",
            F.coalesce("quoted", F.lit(False)).alias("quoted"),
            F.coalesce("depth", F.lit(0)).cast("int").alias("depth"),
            F.col("own").alias("text"),
        )
    )


def _branch_offsets(branched: DataFrame, placed: DataFrame) -> DataFrame:
    """``conv_id, branch, offset``: messages that stand before a branch. Below a branch, those come
    first that leave it last."""
    sizes = (
        placed.groupBy("conv_id", "turn")
        .agg(F.count("*").alias("n"))
        .join(branched.select("conv_id", "turn", "branch"), ["conv_id", "turn"])
        .groupBy("conv_id", "branch")
        .agg(F.sum("n").alias("n"))
    )
    heads = branched.filter(F.col("turn") == F.col("branch")).select("conv_id", "branch", "reply_to")
    parents = branched.select(
        "conv_id", F.col("turn").alias("reply_to"), F.col("branch").alias("parent")
    )
    tree = cut_lineage(heads.join(parents, ["conv_id", "reply_to"], "left").join(
        sizes, ["conv_id", "branch"]
    ))
    below = _summed(tree.select("conv_id", "branch", F.col("parent").alias("up"), F.col("n").alias("value")), True)
    nested = tree.filter("parent is not null").join(
        below.select("conv_id", "branch", F.col("value").alias("size")), ["conv_id", "branch"]
    )
    # The complement turns the order round without overflow.
    nested = cut_lineage(nested.withColumn("leaves", F.bitwise_not("reply_to")))
    # Siblings that leave later, then those that leave at the same turn and start before.
    by_turn = nested.groupBy("conv_id", "parent", "leaves").agg(F.sum("size").alias("size"))
    by_turn = _sum_before(by_turn, ["conv_id", "parent"], "leaves", "size").drop("size")
    beside = _sum_before(nested, ["conv_id", "parent", "leaves"], "branch", "size")
    above = tree.select("conv_id", F.col("branch").alias("parent"), F.col("n").alias("own"))
    steps = (
        beside.join(by_turn.withColumnRenamed("before", "later"), ["conv_id", "parent", "leaves"])
        .join(above, ["conv_id", "parent"])
        .select("conv_id", "branch", F.col("parent").alias("up"), F.expr("own + later + before").alias("value"))
    )
    roots = tree.filter("parent is null").select(
        "conv_id", "branch", F.col("parent").alias("up"), F.lit(0).cast("long").alias("value")
    )
    offsets = _summed(roots.unionByName(steps), False)
    return offsets.withColumnRenamed("value", "offset")


def _sum_before(df: DataFrame, keys: list[str], along: str, value: str) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over the rows of ``keys`` with less in ``along``,
    which no two of them share."""
    rows = df.withColumn("_bucket", F.floor(F.col(along) / TURNS))
    all_before = Window.unboundedPreceding, -1
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(*all_before)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(along).rowsBetween(*all_before)
    buckets = (
        rows.groupBy(*keys, "_bucket")
        .agg(F.sum(value).alias("_sum"))
        .withColumn("_earlier", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
        .drop("_sum")
    )
    rows = rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return (
        rows.join(buckets, [*keys, "_bucket"])
        .withColumn("before", F.col("_inside") + F.col("_earlier"))
        .drop("_bucket", "_inside", "_earlier")
    )


def _summed(tree: DataFrame, below: bool) -> DataFrame:
    """``conv_id, branch, value``: sums of ``value`` over a branch and all below it, else over it and
    all above it. ``up`` is the branch above, null at the top.

    A round doubles the way that every pointer ``up`` spans: what is summed there joins what is
    summed here. Branches whose pointer has passed the top take no part in joins on it."""
    node = ["conv_id", "branch"]
    now = cut_lineage(tree.select(*node, "up", "value"))
    while not (going := now.filter("up is not null")).isEmpty():
        there = now.select("conv_id", F.col("branch").alias("up"), F.col("up").alias("next"), F.col("value").alias("more"))
        moved = going.join(there, ["conv_id", "up"])
        still = now.filter("up is null")
        if below:
            gained = going.groupBy("conv_id", F.col("up").alias("branch")).agg(F.sum("value").alias("gain"))
            moved = moved.select(*node, F.col("next").alias("up"), "value").unionByName(still)
            moved = moved.join(gained, node, "left").withColumn(
                "value", F.col("value") + F.coalesce("gain", F.lit(0))
            ).drop("gain")
        else:
            moved = moved.select(*node, F.col("next").alias("up"), (F.col("value") + F.col("more")).alias("value"))
            moved = moved.unionByName(still)
        now = cut_lineage(moved.select(*node, "up", "value"))
    return now.select(*node, "value")

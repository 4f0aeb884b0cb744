"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted in cells of source, language and topic. Raking scales the token weights of the
cells to the target share of every source, then of every language, then of every topic, and again,
until all three margins hold. The weight of a cell over its tokens is the probability with which
its documents are drawn; a document is drawn if a hash of its id falls below it, so a draw can be
repeated and does not depend on the partitions.

A cell with fewer tokens than it is asked for is taken whole, with probability 1, and later rounds
let the others make up for it. Null is a value of
its own in every dimension. Null text has one token, the end token. Rows with equal ids share
their fate within a cell; a null id is drawn like an empty one. Without rows there are no cells
and no result rows.

Only cell counts are iterated on, never documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.session import cut_lineage

DIMENSIONS = ["source", "lang", "topic"]
#: Targets are token counts to this power: rare values gain, frequent ones lose.
FLATTEN = 0.5
#: Expected tokens drawn, as a share of all, if no cell runs out.
BUDGET = 0.5
ROUNDS = 10
SEED = "mix"


def with_tokens(docs: DataFrame) -> DataFrame:
    """``n_tokens``, four characters a token and one for the end."""
    length = F.coalesce(F.length("text"), F.lit(0))
    return docs.withColumn("n_tokens", F.floor(length / 4) + 1)


def topic_of(text: str) -> Column:
    """A coarse topic by the form of the text; the first that fits."""
    return (
        F.when(F.col(text).isNull(), F.lit(None))
        .when(F.col(text).contains("License"), "licensed")
        .when(F.col(text).contains(" | "), "table")
        .when(F.col(text).contains("@"), "contact")
        .when(F.length(text) >= 4000, "long")
        .otherwise("prose")
    )


def _keys(docs: DataFrame) -> DataFrame:
    """One text column per dimension that also tells null from empty."""
    key = {f"_{d}": F.coalesce(F.concat(F.lit("="), F.col(d).cast("string")), F.lit("")) for d in DIMENSIONS}
    return docs.withColumns(key)


def _targets(cells: DataFrame, dimension: str) -> DataFrame:
    """Target share of every value: its tokens to the power ``FLATTEN``, scaled to one."""
    own = cells.groupBy(dimension).agg(F.pow(F.sum("tokens").cast("double"), F.lit(FLATTEN)).alias("t"))
    return own.crossJoin(own.agg(F.sum("t").alias("all"))).select(
        dimension, (F.col("t") / F.col("all")).alias("target")
    )


def rake(
    cells: DataFrame,
    targets: dict[str, DataFrame],
    most: Column | None = None,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``cells`` (the dimensions, ``tokens``) with ``weight``: shares of the whole whose sums over
    every dimension meet ``targets`` (dimension, ``target``), as near as ``rounds`` rounds come.
    ``most``: what a cell can weigh at most; the others make up for it."""
    now = cut_lineage(cells.withColumn("weight", F.col("tokens").cast("double")))
    for i in range(rounds):
        if i and most is not None:
            now = now.withColumn("weight", F.least("weight", most))
        for dimension, target in targets.items():
            scale = (
                now.groupBy(dimension)
                .agg(F.sum("weight").alias("total"))
                .join(target, dimension)
                .select(dimension, (F.col("target") / F.col("total")).alias("scale"))
            )
            now = now.join(scale, dimension).withColumn("weight", F.col("weight") * F.col("scale"))
            # Every step reads the cells twice; written out, plans do not double with each.
            now = cut_lineage(now.drop("scale"))
    return now


def mixed(docs: DataFrame, budget: float = BUDGET, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` (``doc_id``, ``n_tokens`` and the dimensions) with ``probability`` and ``kept``."""
    keyed = _keys(docs)
    names = [f"_{d}" for d in DIMENSIONS]
    cells = cut_lineage(keyed.groupBy(*names).agg(F.sum("n_tokens").cast("long").alias("tokens")))
    targets = {n: cut_lineage(_targets(cells, n)) for n in names}
    total = cells.agg(F.sum("tokens").alias("total")).first().total or 1
    most = F.col("tokens") / F.lit(budget * total)
    weights = rake(cells, targets, most, rounds)
    rate = F.least(F.lit(1.0), F.col("weight") / most).alias("probability")
    drawn = cut_lineage(weights.select(*names, rate))
    text = F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    uniform = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(16**13)
    return (
        keyed.drop("probability", "kept")
        .join(drawn, names)
        .withColumn("kept", uniform < F.col("probability"))
        .drop(*names)
    )

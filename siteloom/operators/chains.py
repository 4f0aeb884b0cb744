"""Ends of chains: every row names the next one, and all are followed at once.

By pointer doubling, each round joins the open chains with what is known of the places they have come to,
so their lengths double and the rounds are as many as the logarithm of the longest chain. Chains
that have ended are not joined again. What never ends leads into a loop; a loop is cut at its smallest
node, which then is the end of all that leads into it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.operators.fetchlog import retry_choice
from siteloom.operators.links import with_canonical_url
from siteloom.session import cut_lineage


def _stored(df: DataFrame) -> DataFrame:
    """Rounds write URLs above all, which fill much less room this way."""
    return cut_lineage(df, compression="zstd")


def _followed(links: DataFrame, paths: bool) -> tuple[DataFrame, DataFrame | None]:
    """``node, end, hops, cost`` (and ``path``) of the chains that end, and the links of those that do not.

    ``links``: ``node, next, cost``, a row per node."""
    path = [F.array("node").alias("path")] if paths else []
    state = links.select("node", F.col("next").alias("at"), F.lit(1).cast("bigint").alias("hops"), "cost", *path)
    ended: list[DataFrame] = []
    still, before = _stored(state), -1
    while (left := still.count()) not in (0, before):
        before = left
        far = reduce(DataFrame.unionByName, [*ended, still.withColumn("done", F.lit(False))])
        more = [F.concat("path", F.coalesce("far_path", F.array().cast("array<string>"))).alias("path")] if paths else []
        stepped = _stored(
            still.join(
                far.withColumnsRenamed({"at": "far", "node": "at", **{c: f"far_{c}" for c in ("hops", "cost", "path", "done")}}),
                "at", "left",
            ).select(
                "node",
                F.coalesce("far", "at").alias("at"),
                (F.col("hops") + F.coalesce("far_hops", F.lit(0))).alias("hops"),
                (F.col("cost") + F.coalesce("far_cost", F.lit(0))).alias("cost"),
                *more,
                F.coalesce("far_done", F.lit(True)).alias("done"),
            )
        )
        ended.append(stepped.filter("done"))
        still = stepped.filter("not done").drop("done")
    if not ended:
        ended.append(still.withColumn("done", F.lit(True)))
    out = reduce(DataFrame.unionByName, ended).drop("done").withColumnRenamed("at", "end")
    return out, (links.join(still.select("node"), "node", "left_semi") if left else None)


def _loop_heads(links: DataFrame) -> DataFrame:
    """``node``: the smallest node of every loop. All chains of ``links`` lead into one.

    Steps and the smallest node met on them are doubled until no chain meets a smaller one: as many rounds as the
    logarithm of the longest chain, however many chains there are. From then on the smallest node never falls along a
    chain, so around a loop it is the same everywhere; it is the head if it is met again behind itself."""
    state = _stored(links.select("node", F.col("next").alias("at"), F.col("node").alias("least")))
    while True:
        far = state.select(F.col("node").alias("at"), F.col("at").alias("far"), F.col("least").alias("far_least"))
        stepped = _stored(
            state.join(far, "at").select(
                "node", F.col("far").alias("at"), F.least("least", "far_least").alias("least"), "far_least",
                (F.col("far_least") < F.col("least")).alias("fell"),
            )
        )
        if stepped.filter("fell").isEmpty():
            return stepped.filter("node = least and node = far_least").select("node")
        state = stepped.drop("far_least", "fell")


def follow(links: DataFrame, paths: bool = False) -> DataFrame:
    """Where every chain ends: ``node, end, hops, cost, looped``, with ``paths`` also ``path``, the nodes from
    ``node`` to the last before the end.

    ``links``: ``node``, ``next`` and optionally ``cost``, added up along the chain. Of several links of one node
    the smallest next counts; rows without a node or a next are left out. The end is the first node without a link. A
    chain that leads into a loop ends at the smallest node of it, and is ``looped``; that node ends at itself, with 0 hops.
    Paths are as long as their chains together, so ask for them where chains are short."""
    cost = F.col("cost") if "cost" in links.columns else F.lit(0)
    single = (
        links.filter("node is not null and next is not null")
        .groupBy("node").agg(F.min(F.struct("next", cost.cast("bigint").alias("cost"))).alias("x"))
        .select("node", "x.next", F.coalesce("x.cost", F.lit(0)).alias("cost"))
    )
    stored = _stored(single)
    straight, rest = _followed(stored, paths)
    straight = straight.withColumn("looped", F.lit(False))
    if rest is None:
        return straight
    rest = _stored(rest)
    heads = _stored(_loop_heads(rest))
    cut, _ = _followed(rest.join(heads, "node", "left_anti"), paths)
    none = [F.array().cast("array<string>").alias("path")] if paths else []
    own = heads.select(
        "node", F.col("node").alias("end"), F.lit(0).cast("bigint").alias("hops"), F.lit(0).cast("bigint").alias("cost"), *none
    )
    return straight.unionByName(cut.unionByName(own).withColumn("looped", F.lit(True)))


def discovery_paths(pages: DataFrame) -> DataFrame:
    """How each page was come to: ``site, url, root, hops, looped, known``.

    ``pages``: ``site, url, discovered_from``. ``root`` is the page that the path goes back to and ``hops`` the
    links from there; ``known`` tells whether the root is one of the pages. Pages that name each other in a ring are
    ``looped``, their root is the smallest of the ring. A page without a discoverer is its own root. A URL may be a
    page of several sites."""
    node = F.to_json(F.struct("site", "url")).alias("node")
    links = pages.filter("discovered_from is not null").select(
        node, F.to_json(F.struct("site", F.col("discovered_from").alias("url"))).alias("next")
    )
    # A node says its site and URL, so nothing else is moved with it.
    own = pages.select(node).distinct()
    found = own.join(follow(links), "node", "left").withColumn("end", F.coalesce("end", "node"))
    known = own.select(F.col("node").alias("end"), F.lit(True).alias("is_known"))
    return found.join(known, "end", "left").select(
        F.get_json_object("node", "$.site").alias("site"),
        F.get_json_object("node", "$.url").alias("url"),
        F.get_json_object("end", "$.url").alias("root"),
        F.coalesce("hops", F.lit(0)).cast("bigint").alias("hops"),
        F.coalesce("looped", F.lit(False)).alias("looped"),
        F.coalesce("is_known", F.lit(False)).alias("known"),
    )


def redirect_chains(attempts: DataFrame, max_attempts: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """What came of every requested URL, redirects followed.

    ``attempts``: the fetch log (``fetchlog.retry_reduction``) with ``location``, the target of an answer with a status
    of 300 to 399, and ``elapsed_ms``. A URL stands for the attempt that ended the matter. Result: ``requested_url``,
    ``final_url``, ``redirect_chain`` (the URLs asked before the final one, in order), ``looped``, and the ``status``,
    ``content_type``, ``ok``, ``error`` and ``attempts`` of the final URL; ``elapsed_ms`` adds up the whole chain. A loop is an
    error of its own. A final URL that the log does not hold was never reached."""
    # Redirects end the matter: they are judged before type and size. Those that lead to no page are errors.
    log = with_canonical_url(
        attempts.select(
            "url", "attempt", "status", "content_type", "body_bytes", "exception", "message", "elapsed_ms", "location"
        ),
        "location", "url",
    ).drop("location").withColumnRenamed("canonical_url", "location")
    chosen = retry_choice(log, max_attempts, max_bytes, redirects=True)
    own = _stored(chosen.withColumn("to", F.when(F.col("redirected"), F.col("location"))))
    ends = follow(
        own.filter("to is not null").select(F.col("url").alias("node"), F.col("to").alias("next"), F.col("elapsed_ms").alias("cost")),
        paths=True,
    )
    asked = own.select(F.col("url").alias("requested_url")).join(
        ends.withColumnRenamed("node", "requested_url"), "requested_url", "left"
    ).withColumn("final_url", F.coalesce("end", "requested_url")).withColumn("looped", F.coalesce("looped", F.lit(False)))
    last = own.select(F.col("url").alias("final_url"), "status", "content_type", "ok", "error", "attempt", "elapsed_ms")
    error = F.when(F.col("looped"), "redirect_loop").when(F.col("ok").isNull(), "unknown_error").otherwise(F.col("error"))
    return asked.join(last, "final_url", "left").select(
        "requested_url", "final_url",
        F.coalesce("path", F.array().cast("array<string>")).alias("redirect_chain"),
        "looped", "status", "content_type",
        (F.coalesce("ok", F.lit(False)) & ~F.col("looped")).alias("ok"),
        error.alias("error"),
        F.col("attempt").alias("attempts"),
        (F.coalesce("cost", F.lit(0)) + F.when(F.col("looped"), 0).otherwise(F.coalesce("elapsed_ms", F.lit(0)))).cast("bigint").alias("elapsed_ms"),
    )

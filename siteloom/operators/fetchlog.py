"""Fetch logs: retries reduced to outcomes, robots decisions, polite schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import text as T
from siteloom.operators.prefix import running_max, running_rank

# Exception types that count as time-out or connection trouble and are tried again.
RETRIED_EXCEPTIONS = [
    "Timeout", "ConnectTimeout", "ReadTimeout", "ConnectionError", "ProxyError", "SSLError",
]

#: Keys that one host or one prefix of it is dealt over.
SALTS = 16


def is_html(content_type: Column) -> Column:
    ct = F.coalesce(content_type, F.lit(""))
    return ct.startswith("text/html") | ct.contains("xhtml")


def _too_large(max_bytes: int | None) -> Column:
    if max_bytes is None:
        return F.lit(False)
    return F.coalesce(F.col("body_bytes") > max_bytes, F.lit(False))


def _attempt_result(max_bytes: int | None) -> Column:
    """What one attempt would mean if it were the last. The order of the tests counts: a
    404 served as plain text is rejected for its type."""
    status, exception = F.col("status"), F.col("exception")
    ct = F.coalesce(F.col("content_type"), F.lit(""))
    answered = exception.isNull()
    ok = (status >= 200) & (status < 300)
    error = (
        F.when(
            ~answered,
            F.concat_ws(": ", exception, F.coalesce(F.col("message"), F.lit(""))),
        )
        .when(
            ~is_html(ct),
            F.concat(F.lit("non_html_content_type:"), F.when(ct == "", "unknown").otherwise(ct)),
        )
        .when(_too_large(max_bytes), "page_too_large")
        .when(~ok, F.concat(F.lit("http_"), status.cast("string")))
    )
    return F.struct(
        error.isNull().alias("ok"),
        F.when(answered, status).alias("status"),
        error.alias("error"),
        F.when(answered, F.coalesce(F.col("final_url"), F.col("url")))
        .otherwise(F.col("url"))
        .alias("final_url"),
        F.when(error.isNull(), F.col("body")).alias("html"),
    )


def _is_terminal(max_attempts: int | None, max_bytes: int | None) -> Column:
    exception = F.col("exception")
    refused = ~is_html(F.col("content_type")) | _too_large(max_bytes)
    again = F.when(exception.isNull(), ~refused & (F.col("status") >= 500)).otherwise(
        exception.isin(RETRIED_EXCEPTIONS)
    )
    if max_attempts is None:
        return ~again
    return ~again | (F.col("attempt") >= max_attempts)


def _preference(terminal: Column) -> Column:
    """Smallest for the attempt that counts: whether it is no end, then the earliest end or else the
    latest attempt."""
    return F.struct(~terminal, F.when(terminal, F.col("attempt")).otherwise(-F.col("attempt")))


def retry_choice(
    attempts: DataFrame, max_attempts: int | None = None, max_bytes: int | None = None, redirects: bool = False
) -> DataFrame:
    """The attempt that counts of each URL, with all its columns and ``ok``, ``error``; of attempts
    logged twice, the one whose columns sort first. With ``redirects`` an answer with a status of 300 to
    399 and a ``location`` is ``redirected``, and no error. Meant for logs without bodies."""
    columns = [c for c in attempts.columns if c != "url"]
    status = F.col("status")
    moved = (status >= 300) & (status < 400) & F.col("location").isNotNull() if redirects else F.lit(False)
    moved = F.coalesce(moved & F.col("exception").isNull(), F.lit(False))
    preference = _preference(moved | _is_terminal(max_attempts, max_bytes))
    log = attempts if "body" in columns else attempts.withColumn("body", F.lit(None).cast("string"))
    log = log if "final_url" in columns else log.withColumn("final_url", F.col("url"))
    verdict = _attempt_result(max_bytes)
    return (
        log.select("url", *columns, moved.alias("redirected"), (verdict["ok"] & ~moved).alias("ok"),
                   F.when(~moved, verdict["error"]).alias("error"), preference.alias("p"))
        .groupBy("url")
        .agg(F.min(F.struct("p", *columns, "redirected", "ok", "error")).alias("x"))
        .select("url", *(f"x.{c}" for c in [*columns, "redirected", "ok", "error"]))
    )


def retry_reduction(
    attempts: DataFrame, max_attempts: int | None = None, max_bytes: int | None = None
) -> DataFrame:
    """One outcome per URL: the first attempt that ends the matter, or else the last there is.

    Every attempt of the log counts and bodies of any size do, unless the caller names the number
    of attempts after which a fetch was given up, or the size from which a body was refused.
    Attempts are chosen without their bodies, which are looked up for the chosen ones alone."""
    chosen = (
        attempts.select("url", "attempt", _preference(_is_terminal(max_attempts, max_bytes)).alias("p"))
        .groupBy("url")
        .agg(F.min_by("attempt", "p").alias("attempt"))
    )
    elapsed = F.col("elapsed_ms") if "elapsed_ms" in attempts.columns else F.lit(None)
    picked = attempts.join(chosen, ["url", "attempt"], "left_semi")
    # An attempt that was logged twice still is one.
    return (
        picked.select(
            "url", F.col("attempt").alias("attempts"), _attempt_result(max_bytes).alias("r"),
            "content_type", elapsed.cast("bigint").alias("elapsed_ms"),
        )
        .dropDuplicates(["url", "attempts"])
        .select("url", "attempts", "r.*", "content_type", "elapsed_ms")
    )


def robots_rules(robots: DataFrame) -> DataFrame:
    """Text of robots.txt files to their lines: ``host_key, entry, n, kind`` (agent or rule), ``name, arg``.

    ``robots``: ``host_key`` (scheme and host), ``status``, ``body``. Files that were not
    served with status 200 allow everything and yield no row. A group of agent lines and
    the rules below it form an entry; a blank line, or an agent line after a rule, starts
    the next one. Groups here are the lines of one file.
    """
    lines = (
        robots.filter(F.col("status") == 200)
        .select("host_key", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("n", "line"))
        .withColumn("bare", T.strip_text(F.regexp_replace("line", "#.*$", "")))
        .withColumn("name", F.lower(F.trim(F.substring_index("bare", ":", 1))))
        .withColumn(
            "arg",
            T.percent_decode(T.strip_text(F.regexp_replace("bare", "^[^:]*:", ""))),
        )
        .withColumn(
            "kind",
            F.when(F.col("line") == "", "blank")
            .when(~F.col("bare").contains(":"), None)
            .when(F.col("name") == "user-agent", "agent")
            .when(F.col("name").isin("allow", "disallow", "request-rate") | F.col("name").endswith("-delay"), "rule"),
        )
        .filter("kind is not null")
    )
    in_file = Window.partitionBy("host_key").orderBy("n")
    starts = (F.col("kind") == "blank") | (
        (F.col("kind") == "agent") & (F.coalesce(F.lag("kind").over(in_file), F.lit("")) == "rule")
    )
    entries = (
        lines.withColumn("starts", F.when(starts, 1).otherwise(0))
        .withColumn("entry", F.sum("starts").over(in_file))
        .filter("kind <> 'blank'")
    )
    in_entry = Window.partitionBy("host_key", "entry").orderBy("n")
    agents = F.count(F.when(F.col("kind") == "agent", 1)).over(in_entry)
    return entries.withColumn("agents_so_far", agents).filter("agents_so_far > 0").select(
        "host_key", "entry", "n", "kind", "name", "arg"
    )


def robots_index(rules: DataFrame, user_agent: str) -> DataFrame:
    """``host_key, prefix, n, allow``: the rules that count for us, a row per host and prefix.

    Of a host the first entry naming our agent counts, else the first entry for everybody. Of rules with one
    prefix the first counts."""
    ours = F.lit(user_agent.split("/")[0].lower())
    agent = F.when(F.col("kind") == "agent", F.lower("arg"))
    chosen = (
        rules.groupBy("host_key", "entry")
        .agg(
            F.bool_or(F.coalesce(agent == "*", F.lit(False))).alias("everybody"),
            F.bool_or(F.coalesce(ours.contains(agent), F.lit(False))).alias("named"),
            F.count_if(F.col("kind") == "rule").alias("n_rules"),
        )
        .filter("n_rules > 0 and (everybody or named)")
        .groupBy("host_key")
        .agg(F.min(F.struct("everybody", "entry")).alias("x"))
        .select("host_key", F.col("x.entry").alias("chosen"))
    )
    # A row per host: as many as there are files, whatever the planner makes of their size.
    return (
        rules.filter(F.col("name").isin("allow", "disallow"))
        .join(chosen.hint("merge"), "host_key")
        .filter(F.col("entry") == F.col("chosen"))
        .groupBy("host_key", F.col("arg").alias("prefix"))
        .agg(F.min(F.struct("n", ((F.col("name") == "allow") | (F.col("arg") == "")).alias("allow"))).alias("x"))
        .select("host_key", "prefix", "x.n", "x.allow")
    )


def robots_decisions(urls: DataFrame, rules: DataFrame, user_agent: str) -> DataFrame:
    """Add ``allowed``: the first rule whose prefix fits decides, and no rule means allowed.

    A URL looks itself up in the index by those prefixes of its path that have a length its host
    has rules of. Hosts and prefixes are spread over ``SALTS`` keys, as one may have most of the URLs. The planner
    takes the copies for as small as the files they come from, so the joins are told to merge."""
    index = robots_index(rules, user_agent)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    lengths = index.groupBy("host_key").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    target = T.percent_decode(F.regexp_extract("url", r"^[^:/?#]+://[^/?#]*([^#]*)", 1))
    asked = (
        urls.select("url").distinct()
        .withColumn("host_key", F.regexp_extract("url", r"^([^:/?#]+://[^/?#]*)", 1))
        .withColumn("robots_path", F.coalesce(F.nullif(target, F.lit("")), F.lit("/")))
        .withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int"))
        .join(lengths.withColumn("salt", salts).hint("merge"), ["host_key", "salt"])
        .withColumn("length", F.explode("lengths"))
        .filter(F.col("length") <= F.length("robots_path"))
        .withColumn("prefix", F.expr("left(robots_path, length)"))
    )
    blocked = (
        asked.join(index.withColumn("salt", salts).hint("merge"), ["host_key", "prefix", "salt"])
        .groupBy("url").agg(F.min(F.struct("n", "allow")).alias("x"))
        .filter("not x.allow")
        .select("url", F.lit(False).alias("allowed"))
    )
    return urls.join(blocked.hint("merge"), "url", "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))


def fetch_outcomes(
    attempts: DataFrame, rules: DataFrame | None = None, user_agent: str = "*"
) -> DataFrame:
    """Outcome per URL. With ``rules`` a forbidden URL is blocked, whatever the log says;
    without them robots files are not respected."""
    outcomes = retry_reduction(attempts)
    if rules is None:
        return outcomes
    judged = robots_decisions(outcomes, rules, user_agent)
    blocked = ~F.col("allowed")
    return judged.select(
        "url",
        F.when(blocked, 0).otherwise(F.col("attempts")).alias("attempts"),
        (F.col("ok") & ~blocked).alias("ok"),
        F.when(~blocked, F.col("status")).alias("status"),
        F.when(blocked, "blocked_by_robots_txt").otherwise(F.col("error")).alias("error"),
        F.when(blocked, F.col("url")).otherwise(F.col("final_url")).alias("final_url"),
        F.when(~blocked, F.col("html")).alias("html"),
        F.when(~blocked, F.col("content_type")).alias("content_type"),
        F.when(blocked, F.lit(0).cast("bigint")).otherwise(F.col("elapsed_ms")).alias("elapsed_ms"),
    )


def extraction_result(has_body: Column, thin: Column, rendered_with: Column) -> Column:
    return (
        F.when(~has_body, "failed")
        .when(~thin, "success")
        .when(rendered_with == "static", "partial_static_only")
        .otherwise("partial")
    )


def politeness_schedule(
    requests: DataFrame, delay_ms: int, bucket: Column, order: list[Column]
) -> DataFrame:
    """Earliest start per request so that starts on one host lie ``delay_ms`` apart.

    ``requests``: ``netloc`` and ``ready_ms`` (when the request could start). The i-th start
    is the largest of ready_j + (i - j) * delay over all j up to i, a running maximum."""
    numbered = running_rank(requests, ["netloc"], order, bucket)
    slack = F.col("ready_ms") - F.col("running_rank") * delay_ms
    return (
        running_max(numbered, ["netloc"], order, slack, bucket)
        .withColumn("start_ms", F.col("running_max") + F.col("running_rank") * delay_ms)
        .drop("running_max")
    )

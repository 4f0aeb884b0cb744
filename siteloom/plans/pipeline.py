"""Start URLs and what was fetched to reports, for all sites at once."""

from __future__ import annotations

from datetime import UTC, datetime
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.functions import urls as U
from siteloom.operators import frontier
from siteloom.operators.extract import page_fields, parse_chosen
from siteloom.operators.fetchlog import fetch_outcomes, robots_rules
from siteloom.operators.links import page_links
from siteloom.operators.profile import build_profiles
from siteloom.operators.report import nested_reports, invalid_reports, page_records
from siteloom.session import cut_lineage


class SiteReports(NamedTuple):
    records: DataFrame
    extract: DataFrame
    profiles: DataFrame
    reports: DataFrame


def report_sites(
    sites: DataFrame,
    attempts: DataFrame,
    robots: DataFrame | None = None,
    rendered: DataFrame | None = None,
    max_pages: int | None = None,
    max_depth: int | None = None,
    k: int = 1,
    user_agent: str = "*",
    latest_rendering: str | None = None,
) -> SiteReports:
    """Replay the visit of each site over a fetch log, read what it reached, and report.

    ``sites``: ``start_url``, a row per site. ``attempts``: the log (fetchlog.retry_reduction),
    keyed by canonical URL. ``robots``: robots.txt files, absent if they are not respected.
    ``rendered``: browser-rendered bodies by URL, absent without dynamic rendering; of several of a URL
    the one with the greatest ``latest_rendering`` counts (extract.latest_rendered). Start URLs that
    are one site, spelt differently, are visited once and get a report each. ``max_pages`` and ``max_depth`` are the budget of a site, None for all that can be reached. A start URL that
    is none gets a report of its own, with nothing but the reason."""
    started = datetime.now(UTC)
    seeds = frontier.seed_frontier(sites.select(F.col("start_url").alias("site"), "start_url"))
    # A site is known by its canonical start URL from here on.
    inputs = cut_lineage(seeds.select(F.col("url").alias("site"), F.col("site").alias("input_url")).distinct())
    roots = inputs.select("site", F.col("site").alias("start_url")).distinct()
    rules = None if robots is None else robots_rules(robots)
    outcomes = cut_lineage(fetch_outcomes(attempts, rules, user_agent))
    bodies = outcomes.filter("ok and html <> ''").select(
        F.xxhash64("url").alias("page_id"), "url", "final_url", "html"
    )
    # Read three times below (links, archive, fields).
    parsed = parse_chosen(bodies, rendered, latest_rendering)
    links = cut_lineage(page_links(parsed).select("url", "ord", "canonical_url", "anchor"))
    fetched, rows = frontier.replay(roots, parsed.select("url"), links, max_pages, max_depth, k)

    places = fetched.select("site", "seq", "url", "depth")
    extract = cut_lineage(page_fields(parsed.join(places, "url")))
    log = outcomes.select("url", "status", "ok", "error", "final_url")
    tried = (
        fetched.drop("fetched_ok")
        .join(log, "url", "left")
        .join(parsed.select("url", "rendered_with"), "url", "left")
        .withColumn("error", F.when(F.col("ok").isNull(), "unknown_error").otherwise(F.col("error")))
        .withColumn("ok", F.coalesce("ok", F.lit(False)))
        .withColumn("final_url", F.coalesce("final_url", "url"))
        .withColumn("rendered_with", F.coalesce("rendered_with", F.lit("static")))
    )
    records = cut_lineage(page_records(tried, extract))
    profiles = build_profiles(extract, roots)
    runs = (
        frontier.stop_reasons(fetched, rows, max_pages)
        .select("site", "stop_reason")
        .join(inputs, "site")
        # The records have been written by now: this run is over.
        .withColumn("started_at", F.lit(started))
        .withColumn("finished_at", F.lit(datetime.now(UTC)))
    )
    reports = nested_reports(records, profiles, runs, max_pages)
    good = U.canonical_url("start_url").isNotNull()
    invalid = sites.filter(~good).select(F.col("start_url").alias("input_url")).distinct()
    return SiteReports(
        records, extract, profiles, reports.unionByName(invalid_reports(invalid, reports.schema))
    )

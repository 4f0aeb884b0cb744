"""Audit rows, visit reports and health figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siteloom.functions import classify as C
from siteloom.functions import urls as U
from siteloom.operators.fetchlog import extraction_result

PAGE_FIELDS = [
    "url", "page_type", "final_url", "title", "http_status", "fetched_ok", "extraction_result",
    "error", "depth", "rendered_with", "discovered_from", "is_third_party",
]
COMPANY_FIELDS = [
    "company_name", "website", "description", "headquarters", "other_locations", "products",
    "services", "solutions", "industries", "emails", "phones", "social_links",
]


def page_records(tried: DataFrame, extract: DataFrame) -> DataFrame:
    """One audit row per URL tried.

    ``tried``: ``site, seq, url, depth, discovered_from, status, ok, error, final_url``, plus
    ``rendered_with``. ``extract``: ``site``, ``url`` and the fields of ``page_fields`` for pages
    that could be read; sites may share pages. A page without a body counts as failed even when the fetch went well.
    Category, flags and title of failed pages come from the URL alone."""
    fields = extract.select(
        "site",
        "url",
        "title",
        F.col("page_type").alias("read_type"),
        "is_thin_content",
        "has_body",
    )
    rows = tried.join(fields, ["site", "url"], "left")
    has_body = F.col("ok") & F.coalesce("has_body", F.lit(False))
    third_party = U.is_third_party_listing(F.col("url"))
    guess = C.url_guess(F.col("url"), F.col("depth"))
    return rows.select(
        "site",
        "seq",
        "url",
        F.when(has_body, F.col("read_type"))
        .otherwise(C.audit_type(guess, third_party))
        .alias("page_type"),
        F.nullif("final_url", "url").alias("final_url"),
        F.when(has_body, F.col("title")).alias("title"),
        F.col("status").alias("http_status"),
        has_body.alias("fetched_ok"),
        extraction_result(has_body, F.col("is_thin_content"), F.col("rendered_with")).alias(
            "extraction_result"
        ),
        F.when(~has_body, F.col("error")).alias("error"),
        "depth",
        F.when(has_body, F.col("rendered_with")).otherwise("static").alias("rendered_with"),
        "discovered_from",
        third_party.alias("is_third_party"),
    )


def page_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("site").agg(
        F.count("*").alias("pages_discovered"),
        F.count_if(F.col("fetched_ok")).alias("pages_fetched_ok"),
        F.count_if(~F.col("fetched_ok")).alias("pages_failed"),
    )


def nested_reports(
    records: DataFrame,
    profiles: DataFrame,
    runs: DataFrame,
    max_pages: int | None = None,
) -> DataFrame:
    """One nested report per run, with all its page records in their order (``seq``).

    ``runs``: ``site, input_url, started_at, finished_at, stop_reason``. ``max_pages``: the budget
    that the fetches had, if any, to be stated in the report."""
    page = F.struct("seq", F.struct(*PAGE_FIELDS).alias("page"))
    pages = (
        records.groupBy("site")
        .agg(F.array_sort(F.collect_list(page)).alias("all_pages"))
        .select("site", F.transform("all_pages", lambda p: p["page"]).alias("pages"))
    )
    company = profiles.select(
        F.col("website").alias("site"), F.struct(*COMPANY_FIELDS).alias("company")
    )
    meta = F.struct(
        _iso(F.col("started_at")).alias("started_at"),
        _iso(F.col("finished_at")).alias("finished_at"),
        "pages_discovered",
        "pages_fetched_ok",
        "pages_failed",
        F.lit(max_pages).cast("bigint").alias("max_pages_limit"),
        "stop_reason",
    ).alias("run_meta")
    return (
        runs.join(page_counts(records), "site")
        .join(pages, "site")
        .join(company, "site", "left")
        .select("site", "input_url", meta, "company", "pages")
    )


def invalid_reports(starts: DataFrame, schema: StructType) -> DataFrame:
    """Reports of start URLs (``input_url``) that no page can have: no pages and no company."""
    meta = F.struct(
        F.lit(None).cast("string").alias("started_at"),
        F.lit(None).cast("string").alias("finished_at"),
        *[F.lit(0).cast("bigint").alias(c) for c in
          ("pages_discovered", "pages_fetched_ok", "pages_failed")],
        F.lit(None).cast("bigint").alias("max_pages_limit"),
        F.lit("invalid_start_url").alias("stop_reason"),
    )
    return starts.select(
        F.lit(None).cast("string").alias("site"),
        "input_url",
        meta.alias("run_meta"),
        F.lit(None).cast(schema["company"].dataType).alias("company"),
        F.array().cast(schema["pages"].dataType).alias("pages"),
    )


def _iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def status_rollup(records: DataFrame) -> DataFrame:
    """Counts and rates per (site, page_type), per site and over all."""

    def rate(flag: Column) -> Column:
        return F.round(F.avg(flag.cast("int")), 6)

    return records.rollup("site", "page_type").agg(
        F.count("*").alias("pages"),
        rate(~F.col("fetched_ok")).alias("failed_rate"),
        rate(F.col("is_third_party")).alias("third_party_rate"),
        rate(F.col("rendered_with") == "dynamic").alias("dynamic_rate"),
    )

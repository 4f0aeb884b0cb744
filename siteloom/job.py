"""The whole pipeline as a job: tables in a folder to reports and stored tables.

    spark-submit --py-files siteloom.zip -m siteloom.job INPUT OUTPUT [options]
    python -m siteloom.job INPUT OUTPUT [options]

INPUT holds the Parquet tables ``sites`` (``start_url``), ``attempts`` (the fetch log) and, if there are any, ``robots`` and
``rendered``. OUTPUT gets ``reports`` (JSON, replaced), and ``companies`` and ``pages`` (tables, merged: the newest row of
a site or page counts).
"""

from __future__ import annotations

import argparse

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.plans.pipeline import report_sites
from siteloom.session import SETTINGS, cut_lineage
from siteloom.sources import store
from siteloom.sources.tables import table


def _optional(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    try:
        return table(spark, folder, name)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def run(
    spark: SparkSession,
    source: str,
    target: str,
    max_pages: int | None = None,
    max_depth: int | None = None,
    pages_per_round: int = 1,
    robots: bool = True,
    rendering: bool = True,
    user_agent: str = "*",
    latest_rendering: str | None = None,
) -> dict[str, int]:
    """Read, report, store; the number of reports by why their visit ended."""
    result = report_sites(
        table(spark, source, "sites"),
        table(spark, source, "attempts"),
        _optional(spark, source, "robots") if robots else None,
        _optional(spark, source, "rendered") if rendering else None,
        max_pages, max_depth, pages_per_round, user_agent, latest_rendering,
    )
    reports = cut_lineage(result.reports)
    store.write_reports(reports, f"{target}/reports")
    # Of several spellings of a start one is as good as another: they tell of the same site.
    read = reports.filter("site is not null and company is not null").dropDuplicates(["site"])
    store.merge_table(f"{target}/companies", store.company_rows(read), ["website"])
    store.merge_table(f"{target}/pages", store.page_rows(read), ["website", "url"])
    counts = reports.groupBy(F.col("run_meta.stop_reason").alias("reason")).count().collect()
    return {r.reason: r["count"] for r in counts}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siteloom.job", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("source", metavar="INPUT")
    p.add_argument("target", metavar="OUTPUT")
    p.add_argument("--max-pages", type=int, help="pages of a site at most (all)")
    p.add_argument("--max-depth", type=int, help="links from the start at most (any)")
    p.add_argument("--pages-per-round", type=int, default=1, help="1 is the exact order of a queue; more need fewer rounds")
    p.add_argument("--ignore-robots", action="store_true")
    p.add_argument("--no-rendering", action="store_true", help="do not use rendered bodies")
    p.add_argument("--user-agent", default="*")
    p.add_argument("--latest-rendering", metavar="COLUMN", help="column of rendered that tells the latest of several")
    return p


def main(arguments: list[str] | None = None) -> None:
    args = parser().parse_args(arguments)
    builder = SparkSession.builder.appName("siteloom")
    for key, value in SETTINGS.items():
        if not key.startswith("spark.siteloom."):
            builder = builder.config(key, value)
    counts = run(
        builder.getOrCreate(), args.source, args.target, args.max_pages, args.max_depth, args.pages_per_round,
        not args.ignore_robots, not args.no_rendering, args.user_agent, args.latest_rendering,
    )
    for reason, n in sorted(counts.items()):
        print(f"{reason}: {n}")


if __name__ == "__main__":
    main()

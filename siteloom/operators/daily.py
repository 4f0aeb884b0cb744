"""Figures of visits per site and day that can be merged over any span.

A day of a site is one row of sketches. Days add up without the visits themselves: distinct URLs by a theta
sketch, fetch times by a KLL sketch, and plain counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Theta sketches keep 2^LG_ENTRIES hashes: exact up to there, then within about 2 / sqrt(2^LG_ENTRIES) at 95%.
LG_ENTRIES = 12
#: KLL sketches of this size are off by at most about 1.33% of the ranks, and exact up to as many values.
KLL_SIZE = 200
#: Largest error of ranks, and largest relative error of distinct counts, that a figure may have.
RANK_ERROR = 0.0166
COUNT_ERROR = 0.0625


def daily_sketches(visits: DataFrame) -> DataFrame:
    """``site, day, visits, failed, urls, times``. ``visits``: ``site, ts, url, ok, elapsed_ms``."""
    return visits.groupBy("site", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("visits"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.theta_sketch_agg("url", LG_ENTRIES).alias("urls"),
        F.kll_sketch_agg_bigint(F.col("elapsed_ms").cast("bigint"), KLL_SIZE).alias("times"),
    )


def span_figures(days: DataFrame, keys: list[str], quantiles: list[float], span: Column | None = None) -> DataFrame:
    """Figures by ``keys`` over the days of ``span`` (None: all): ``visits``, ``failed_rate``, ``n_urls`` and one
    column ``ms_<per cent>`` per quantile. ``keys`` may be empty: all sites together."""
    chosen = days if span is None else days.filter(span)
    merged = chosen.groupBy(*keys).agg(
        F.sum("visits").alias("visits"),
        F.sum("failed").alias("failed"),
        F.theta_union_agg("urls", LG_ENTRIES).alias("urls"),
        F.kll_merge_agg_bigint("times", KLL_SIZE).alias("times"),
    )
    return merged.select(
        *keys,
        "visits",
        F.round(F.col("failed") / F.col("visits"), 6).alias("failed_rate"),
        F.theta_sketch_estimate("urls").alias("n_urls"),
        *[
            F.kll_sketch_get_quantile_bigint("times", F.lit(q)).alias(f"ms_{round(100 * q)}")
            for q in quantiles
        ],
    )

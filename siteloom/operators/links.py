"""Links of pages, the link graph of a site, and URL variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.functions import classify as C
from siteloom.functions import page as P
from siteloom.functions import urls as U
from siteloom.functions.markup import with_links
from siteloom.operators.prefix import running_rank


def with_canonical_url(df: DataFrame, url: str = "url", base: str | None = None) -> DataFrame:
    """Add ``canonical_url``. It comes out of a generator, because the optimizer does not
    move predicates below one: each filter on the result would else resolve the URL anew. Only
    spellings that are not common go through the lambdas of ``U.canonical_url``."""
    common = U.with_common_url(df, url, base, "_common")
    canonical = F.coalesce(F.col("_common"), U.canonical_url(url, base))
    return common.select(*df.columns, F.explode(F.array(canonical)).alias("canonical_url"))


def page_links(parsed: DataFrame) -> DataFrame:
    """One row per ``a[href]`` with its place on the page, text and canonical target.

    Relative links are resolved against ``final_url`` where the page was redirected,
    against ``url`` otherwise."""
    base = (
        F.coalesce(F.col("final_url"), F.col("url"))
        if "final_url" in parsed.columns
        else F.col("url")
    )
    anchors = (
        "transform(filter(elems, e -> e.tag = 'a' and e.href is not null), (e, i) ->"
        f" named_struct('ord', i, 'href', e.href, 'anchor', {P.anchor_text('e')},"
        " 'in_script', e.in_script, 'in_chrome', e.in_chrome))"
    )
    kept = [c for c in ("page_id", "site", "url", "depth") if c in parsed.columns]
    rows = parsed.select(*kept, base.alias("base"), F.expr(f"inline({anchors})"))
    return with_canonical_url(rows, "href", "base").drop("base")


def scanned_links(pages: DataFrame) -> DataFrame:
    """page_links off raw bodies (``html``), by patterns: no tree, and no flags of the element."""
    base = F.coalesce("final_url", "url") if "final_url" in pages.columns else F.col("url")
    kept = [c for c in ("page_id", "site", "url", "depth") if c in pages.columns]
    rows = with_links(pages.select(*kept, base.alias("base"), "html"))
    return with_canonical_url(rows, "href", "base").drop("base")


def link_graph(links: DataFrame) -> DataFrame:
    """Edges worth following: same site, no file, no trap."""
    to, source = F.col("canonical_url"), F.col("url")
    return links.filter(
        to.isNotNull() & U.is_same_site(to, source) & U.is_worth_reading(to)
    ).withColumn("category", C.classify_url(to, F.col("anchor")))


def canonical_pages(pages: DataFrame) -> DataFrame:
    return with_canonical_url(pages).withColumn(
        "site_key", U.site_key_of(F.col("canonical_url"))
    )


def distinct_urls(urls: DataFrame, order: str) -> DataFrame:
    """First row per canonical URL in the order of column ``order``."""
    return (
        urls.filter(F.col("canonical_url").isNotNull())
        .groupBy("canonical_url")
        .agg(F.min(order).alias(order))
    )


def variant_ranks(urls: DataFrame, order: str, bucket_rows: int = 1 << 16) -> DataFrame:
    """How many query variants of the same path came before a URL; 0 without a query.

    ``urls`` holds distinct canonical URLs with an integer column ``order``. One path may
    own a large part of all rows, so its variants are ranked bucket by bucket."""
    keyed = urls.withColumn("path_key", U.path_key(F.col("canonical_url"))).withColumn(
        "has_query", U.has_query(F.col("canonical_url"))
    )
    variants = running_rank(
        keyed.filter("has_query"),
        ["path_key"],
        [F.col(order)],
        F.floor(F.col(order) / bucket_rows),
    ).withColumn("variant_rank", F.col("running_rank") - 1)
    plain = keyed.filter("not has_query").withColumn("variant_rank", F.lit(0).cast("bigint"))
    return variants.drop("running_rank").unionByName(plain).drop("has_query")

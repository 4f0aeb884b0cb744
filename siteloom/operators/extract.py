"""Pages to fields: DataFrame in, DataFrame out, one row per page, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom import constants as K
from siteloom.functions import classify as C
from siteloom.functions import page as P
from siteloom.functions import text as T
from siteloom.functions import urls as U
from siteloom.session import cut_lineage
from siteloom.sources.html import outlines


def parse_pages(pages: DataFrame) -> DataFrame:
    """Page outlines, plus what must be read off the raw body: e-mails, and whether
    there is a body at all. The body itself does not come back from the workers."""
    return outlines(
        pages.withColumn("emails", T.emails_in(F.coalesce(F.col("html"), F.lit(""))))
        .withColumn("has_body", F.coalesce(F.col("html") != "", F.lit(False)))
    )


def page_fields(parsed: DataFrame, sample_chars: int | None = None) -> DataFrame:
    """All extracted fields and the page type. ``parsed`` may carry ``depth`` (distance
    at which the page was first seen); without it no page counts as the start page. The text
    sample is the whole visible text unless ``sample_chars`` cuts it.

    Three projections, each using the columns of the one before several times over, so
    that the optimizer keeps them apart and every text is put together once.
    """
    url = F.col("url")
    depth = F.col("depth") if "depth" in parsed.columns else F.lit(None).cast("int")
    kept = [c for c in parsed.columns if c not in ("elems", "texts", "page_type")]
    title, h1, visible = F.col("title"), F.col("h1"), F.col("visible")
    page_type = F.col("page_type")
    third_party = U.is_third_party_listing(url)

    texts = parsed.select(
        *kept,
        "elems",
        "texts",
        F.expr(P.title()).alias("title"),
        F.expr(P.h1()).alias("h1"),
        F.expr(P.visible_text()).alias("visible"),
        U.site_key_of(url).alias("own_site"),
        U.name_from_domain(url).alias("domain_name"),
    )
    named = texts.select(
        "*",
        F.expr(P.company_name("title", "h1", "domain_name")).alias("company_name_guess"),
        C.classify_content(url, title, h1, C.url_guess(url, depth)).alias("page_type"),
        F.expr(P.office_addresses()).alias("offices"),
    ).withColumn("url_name", U.taxonomy_name(url, page_type))
    return named.select(
        *kept,
        "title",
        "h1",
        F.expr(P.meta_description()).alias("meta_description"),
        T.text_sample(visible, sample_chars).alias("visible_text_sample"),
        F.coalesce(F.length(visible), F.lit(0)).alias("visible_chars"),
        P.phones("visible").alias("phones"),
        F.expr(P.social_links("own_site")).alias("social_links"),
        F.expr(P.address_candidates()).alias("address_candidates"),
        F.col("offices.hq").alias("headquarters_candidates"),
        F.col("offices.other").alias("other_location_candidates"),
        F.expr(P.bucket_items("page_type", "company_name_guess", "url_name")).alias(
            "heading_list_items"
        ),
        "company_name_guess",
        (F.coalesce(F.length(visible), F.lit(0)) < K.THIN_TEXT_CHARS).alias("is_thin_content"),
        third_party.alias("is_third_party"),
        C.audit_type(page_type, third_party).alias("page_type"),
    )


def extract_pages(pages: DataFrame) -> DataFrame:
    return page_fields(parse_pages(pages))


def latest_rendered(rendered: DataFrame, urls: DataFrame, latest: str | None = None) -> DataFrame:
    """``url, rendered_html``: one usable rendered body for each of ``urls`` that has one.

    ``rendered``: ``url``, ``ok``, ``html``, any number of rows per URL. The row with the greatest
    ``latest`` counts, of equal ones (or without that column named) the one whose body sorts last."""
    order = ([F.col(latest).alias("latest")] if latest else []) + [F.col("html").alias("html")]
    return (
        rendered.filter(F.col("ok") & (F.col("html") != ""))
        .join(urls.select("url").distinct(), "url", "left_semi")
        .groupBy("url")
        .agg(F.max(F.struct(*order)).alias("x"))
        .select("url", F.col("x.html").alias("rendered_html"))
    )


def _shell() -> Column:
    return F.coalesce(F.expr(P.is_js_shell()), F.lit(False))


def choose_body(static: DataFrame, rendered: DataFrame, latest: str | None = None) -> DataFrame:
    """Replace the body of script-filled pages by their browser-rendered one, where that
    succeeded (see latest_rendered). One row per page of ``static``.

    Shells are told in one parse, and only their ids are written out; only they are looked up and
    shuffled, all other pages go on as they are."""
    others = [c for c in static.columns if c != "html"]
    parsed = outlines(static.withColumn("has_body", F.col("html") != ""))
    shells = cut_lineage(parsed.filter(_shell()).select("page_id", "url"))
    usable = latest_rendered(rendered, shells, latest)
    swaps = cut_lineage(shells.join(usable, "url").dropDuplicates(["page_id"]).select("page_id", "rendered_html"))
    return static.join(swaps, "page_id", "left").select(
        *others,
        F.coalesce("rendered_html", "html").alias("html"),
        F.when(F.col("rendered_html").isNotNull(), "dynamic").otherwise("static").alias("rendered_with"),
    )


def parse_chosen(static: DataFrame, rendered: DataFrame | None, latest: str | None = None) -> DataFrame:
    """parse_pages of the bodies that count, with ``rendered_with``. Every body is parsed once, that of a
    shell once more in its rendered form; bodies are not written out, outlines are."""
    parsed = parse_pages(static.withColumn("rendered_with", F.lit("static")))
    if rendered is None:
        return cut_lineage(parsed)
    told = cut_lineage(parsed.withColumn("_shell", _shell()))
    shells = told.filter("_shell").drop("_shell")
    usable = latest_rendered(rendered, shells, latest)
    carried = [c for c in static.columns if c != "html"]
    swaps = shells.select(*carried).join(usable.withColumnRenamed("rendered_html", "html"), "url")
    again = cut_lineage(parse_pages(swaps.withColumn("rendered_with", F.lit("dynamic"))))
    left = shells.join(again.select("page_id"), "page_id", "left_anti")
    return told.filter("not _shell").drop("_shell").unionByName(left).unionByName(again.select(*left.columns))

"""Every operator as a query over the given tables or corpora derived from them.

List results are joined with '|' so that results compare as plain values."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.functions import classify as C
from siteloom.functions import markup as M
from siteloom.functions import noise as N
from siteloom.functions import page as P
from siteloom.functions import text as T
from siteloom.functions import urls as U
from siteloom.operators import chains, daily, fetchlog, frontier, links, profile, report
from siteloom.operators.extract import choose_body, extract_pages
from siteloom.plans import corpus
from siteloom.plans.pipeline import report_sites
from siteloom.session import BucketedTable, checkpoint_dir, cut_lineage
from siteloom.sources import store
from siteloom.sources.html import dom_nodes, outlines
from siteloom.sources.tables import deal, scan_pages, spread, table
from siteloom.streaming import feed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _long(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def _template(text: str) -> Column:
    """Text with ``{column}`` replaced; other braces stay."""
    parts = re.split(r"\{([a-z_]+)\}", text)
    return F.concat(*[F.col(p).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def _joined(c: str) -> Column:
    return F.array_join(c, "|").alias(c)


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- URLs -----------------------------------------------------------------------------


@query
def canonical_urls(spark, folder):
    pages = links.canonical_pages(table(spark, folder, "pages").select("page_id", "url"))
    return pages.select(
        "page_id", "canonical_url", "site_key", U.path_key(F.col("canonical_url")).alias("path_key")
    )


@query
def messy_urls(spark, folder):
    """Ports, case, dot segments, blank and tracking parameters, relative references."""
    key, seg = "{c_custkey}", "{lower(c_mktsegment)}"
    base = f"http://h{key}.test:80/a/b/c;v=1?q=0"
    cases = {
        "full": (
            f"HTTPS://WWW.Cust{key}.Test:443/Shop/../{seg}//x/./?b={{c_nationkey}}"
            "&utm_Source=z&a=&a=%7Eq+r#f",
            None,
        ),
        "parent": (f"../{seg}|x?y", base),
        "query": (f"?p={key}&sid=1", base),
        "host": (f"//Other.Test/{key}%zz/", base),
        "bare": (f"https://www.cust{key}.test", None),
        "port": (f" http://cust{key}.test:8080/a/ ", None),
        "mail": (f"mailto:c{key}@cust.test", base),
        "anchor": (f"#c{key}", base),
        "ftp": (f"ftp://cust{key}.test/", None),
        "slashes": (f"https://cust{key}.test//a///b/..", None),
    }
    customers = table(spark, folder, "customer")
    rows = customers.select(
        "c_custkey",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(kind).alias("kind"),
                        corpus._fill(url).alias("href"),
                        (corpus._fill(b) if b else F.lit(None).cast("string")).alias("base"),
                    )
                    for kind, (url, b) in cases.items()
                ]
            )
        ).alias("x"),
    ).select("c_custkey", "x.*")
    return rows.select(
        "c_custkey",
        "kind",
        F.when(F.col("base").isNull(), U.canonical_url("href"))
        .otherwise(U.canonical_url("href", "base"))
        .alias("canonical_url"),
    )


@query
def site_page_counts(spark, folder):
    return (
        links.canonical_pages(table(spark, folder, "pages").select("url"))
        .groupBy("site_key", "canonical_url")
        .agg(F.count("*").alias("n"))
        .groupBy("site_key")
        .agg(F.sum("n").alias("n_pages"), F.count("*").alias("n_urls"))
    )


@query
def url_variants(spark, folder):
    """Query variants of each page path of every shop, in order of first sight."""
    found = (
        corpus.shop_links(spark, folder, ["products"])
        .withColumn(
            "place",
            F.regexp_extract("url", "order-([0-9]+)", 1).cast("bigint") * 1000 + F.col("ord"),
        )
    )
    # Read three times below.
    distinct = cut_lineage(links.distinct_urls(found, "place"))
    return links.variant_ranks(distinct, "place").select(
        "canonical_url", "path_key", _long("variant_rank").alias("variant_rank")
    )


@query
def url_gates(spark, folder):
    """Every page link of the shops and of a few traps, with the gates it passes."""
    c = "{c_custkey}"
    paths = [
        f"login/{c}", f"a/Report-{c}.PDF", f"research/{c}", f"blueprint/{c}", f"v/page/{c}",
        f"products/{c}", f"business/{c}-co", f"business/register", f"biz/abcdefghijklm{c}",
        f"x/member/{c}/a-b", f"vendor//{c}-x", f"profile/",
    ]
    rows = table(spark, folder, "customer").select(
        "c_custkey",
        F.explode(
            F.array(*[corpus._fill("https://c" + c + ".test/" + p) for p in paths])
        ).alias("url"),
    )
    url = F.col("url")
    return rows.select(
        "url",
        U.has_non_html_extension(url).alias("is_file"),
        U.is_skip_path(url).alias("is_trap"),
        U.is_worth_reading(url).alias("is_worth"),
        U.is_third_party_listing(url).alias("is_third_party"),
    )


@query
def url_names(spark, folder):
    """Industry and solution names, and fallback company names, out of URLs."""
    rows = table(spark, folder, "customer").select(
        "c_custkey",
        F.explode(
            F.array(
                corpus._fill("https://www.mart{c_custkey}.test/Solutions/industry/"
                             "{lower(c_mktsegment)}-{c_custkey}-trade"),
                corpus._fill("https://hub{c_custkey}.test/solution/{lower(c_mktsegment)}-x2-flow/y"),
            )
        ).alias("url"),
    )
    url = F.col("url")
    return rows.select(
        "url",
        U.taxonomy_name(url, F.lit("industries")).alias("industry"),
        U.taxonomy_name(url, F.lit("solutions")).alias("solution"),
        U.taxonomy_name(url, F.lit("products")).alias("product"),
        U.name_from_domain(url).alias("domain_name"),
    )


# --- links of the raw pages --------------------------------------------------------------


@query
def link_inventory(spark, folder):
    found = links.scanned_links(scan_pages(spark, folder))
    return found.select("page_id", _long("ord").alias("ord"), "href", "anchor", "canonical_url")


@query
def link_graph(spark, folder):
    edges = links.link_graph(links.scanned_links(scan_pages(spark, folder)))
    return edges.groupBy("category").agg(
        F.count("*").alias("n_links"), F.count_distinct("canonical_url").alias("n_targets")
    )


@query
def orphan_links(spark, folder):
    """Link targets that are no page of the corpus, per site."""
    found = links.scanned_links(scan_pages(spark, folder))
    known = links.canonical_pages(table(spark, folder, "pages").select("url"))
    return (
        found.filter("canonical_url is not null")
        .join(known.select("canonical_url"), "canonical_url", "left_anti")
        .groupBy(U.site_key_of(F.col("canonical_url")).alias("site_key"))
        .agg(F.count("*").alias("n_links"))
    )


# --- fields of the raw pages ----------------------------------------------------------------


@query
def tag_counts(spark, folder):
    return (
        dom_nodes(outlines(scan_pages(spark, folder)))
        .groupBy("tag")
        .agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("n_pages"))
    )


@query
def article_paragraphs(spark, folder):
    """Paragraphs below the article of each page."""
    n = F.expr(P.count_below("article", "p")).alias("n_paragraphs")
    return outlines(scan_pages(spark, folder)).select("page_id", n).filter("n_paragraphs > 0")


#: Pairs of tags to be counted one below the other.
NESTED = [("nav", "a"), ("ul", "li"), ("article", "p"), ("body", "p"), ("html", "title"), ("article", "article")]


@query
def nested_tags(spark, folder):
    """How often one tag stands below another, for several pairs in one reading of the pages."""
    pairs = ", ".join(
        f"named_struct('outer_tag', '{o}', 'inner_tag', '{i}', 'n', {P.count_below(o, i)})" for o, i in NESTED
    )
    return outlines(scan_pages(spark, folder)).selectExpr("page_id", f"inline(array({pairs}))")


def _headed(spark, folder):
    """Title and first heading of every page, without a tree."""
    body = F.col("body")
    bodies = scan_pages(spark, folder).select("page_id", "url", M.without_hidden(F.col("html")).alias("body"))
    return bodies.select("page_id", "url", M.title(body).alias("title"), M.h1(body).alias("h1"))


@query
def page_titles(spark, folder):
    return _headed(spark, folder).select("page_id", "title", "h1")


@query
def page_names(spark, folder):
    named = outlines(scan_pages(spark, folder)).select(
        "*",
        F.expr(P.title()).alias("title"),
        F.expr(P.h1()).alias("h1"),
        U.name_from_domain(F.col("url")).alias("domain_name"),
    )
    name = F.expr(P.company_name("title", "h1", "domain_name"))
    return named.select("page_id", name.alias("company_name"))


@query
def page_texts(spark, folder):
    texts = scan_pages(spark, folder).select(
        "page_id", M.visible_text(M.without_hidden(F.col("html"))).alias("visible")
    )
    visible = F.col("visible")
    return texts.select(
        "page_id",
        _long(F.coalesce(F.length(visible), F.lit(0))).alias("visible_chars"),
        F.md5(visible.cast("binary")).alias("visible_md5"),
        (F.coalesce(F.length(visible), F.lit(0)) < 200).alias("is_thin"),
    )


@query
def page_types(spark, folder):
    named = _headed(spark, folder)
    url = F.col("url")
    return named.select(
        "page_id",
        C.classify_url(url).alias("url_type"),
        C.classify_content(url, F.col("title"), F.col("h1"), C.classify_url(url)).alias("page_type"),
    )


@query
def page_fields(spark, folder):
    """Description, contacts, links to social sites and addresses of the raw pages."""
    return extract_pages(scan_pages(spark, folder)).select(
        "page_id", "meta_description", _joined("emails"), _joined("phones"),
        F.array_join(F.transform("social_links", lambda s: s["href"]), "|").alias("social_links"),
        _joined("address_candidates"), _joined("headquarters_candidates"),
        _joined("other_location_candidates"), _joined("heading_list_items"), "is_third_party",
    )


@query
def site_profiles(spark, folder):
    """The flagship: every page of every site read and merged into facts of the site, pages in the
    order of their ids."""
    pages = scan_pages(spark, folder).select(
        "page_id", "url", "html", U.site_key_of(F.col("url")).alias("site"), F.col("page_id").alias("seq")
    )
    extract = cut_lineage(extract_pages(pages).drop("visible_text_sample"))
    return profile.company_facts(profile.profile_facts(extract))


@query
def page_emails(spark, folder):
    rows = scan_pages(spark, folder).select("page_id", T.emails_in(F.col("html")).alias("e"))
    return rows.select("page_id", F.explode("e").alias("email"))


@query
def document_emails(spark, folder):
    rows = spread(table(spark, folder, "documents"), "doc_id").select("doc_id", T.emails_in(F.col("text")).alias("e"))
    return rows.select("doc_id", F.explode("e").alias("email"))


@query
def document_phones(spark, folder):
    rows = spread(table(spark, folder, "documents"), "doc_id").select(
        "doc_id", F.explode(T.phones_in(T.clean_text(F.col("text")))).alias("phone")
    )
    return rows


@query
def conversation_contacts(spark, folder):
    text = T.clean_text(F.col("text"))
    return table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        F.array_join(T.emails_in(F.col("text")), "|").alias("emails"),
        F.array_join(T.phones_in(text), "|").alias("phones"),
    )


@query
def email_verdicts(spark, folder):
    """Addresses of suppliers and customers, half of them placeholders."""
    rows = table(spark, folder, "customer").select(
        F.explode(
            F.array(
                corpus._fill("c{c_custkey}@{lower(c_mktsegment)}.test"),
                corpus._fill("You@shop{c_custkey}.test"),
                corpus._fill("info{c_custkey}@Example.com"),
                corpus._fill("pic{c_custkey}@2x.JPEG"),
                corpus._fill("a{c_custkey}@sentry.io.test"),
            )
        ).alias("email")
    )
    return rows.select("email", T.valid_email(F.col("email")).alias("is_valid"))


@query
def phone_verdicts(spark, folder):
    rows = table(spark, folder, "customer").select(
        F.explode(
            F.array(
                corpus._fill("+{c_nationkey} {lpad(c_custkey, 7, '0')}"),
                corpus._fill("{c_custkey}"),
                corpus._fill("10 10-99 100-{100 + c_nationkey} {c_custkey}"),
                corpus._fill("99-10 999-100 {lpad(c_custkey, 6, '7')}"),
                corpus._fill("1{lpad(c_custkey, 9, '5')}{lpad(c_custkey, 6, '4')}"),
            )
        ).alias("phone")
    )
    return rows.select(
        "phone",
        _long(T.digit_count(F.col("phone"))).alias("digits"),
        T.range_list_like(F.col("phone")).alias("is_range_list"),
        T.valid_phone(F.col("phone")).alias("is_valid"),
    )


# --- item noise ---------------------------------------------------------------------------


def _candidates(spark, folder) -> DataFrame:
    """Lines of documents, and labels as listings show them, made of the other tables."""
    documents = spread(table(spark, folder, "documents"), "doc_id").select(
        F.explode(F.split("text", "\n")).alias("text"), F.col("lang").alias("bucket")
    )
    orders = deal(
        table(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus"), "o_orderkey"
    ).select(
        F.explode(
            F.array(
                F.date_format("o_orderdate", "dd/MM/yyyy"),
                F.date_format("o_orderdate", "MMM yyyy"),
                F.date_format("o_orderdate", "yyyy"),
                F.format_string("Established %s", F.date_format("o_orderdate", "yyyy")),
                corpus._fill("{cast(o_totalprice as bigint)}.5"),
                corpus._fill("{o_orderkey}% less {lower(o_orderstatus)}"),
                corpus._fill("Order {o_orderkey} *"),
            )
        ).alias("text"),
        F.lit("products").alias("bucket"),
    )
    customers = deal(
        table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "c_custkey"
    ).select(
        F.explode(
            F.array(
                corpus._fill("{initcap(c_mktsegment)}, Nation"),
                corpus._fill("{c_nationkey % 10}.5 out of 5 stars"),
                corpus._fill("{c_name} {c_name}"),
                corpus._fill("{c_mktsegment} & Sons"),
                corpus._fill("{initcap(c_mktsegment)} Industry"),
                corpus._fill("{c_mktsegment} WORKS {c_mktsegment}"),
                corpus._fill("Smart {c_mktsegment} this is smart {lower(c_mktsegment)} text"),
                corpus._fill("Boost: {c_name}"),
                corpus._fill("Located in {c_name}"),
                corpus._fill("Kingston {c_custkey}"),
                corpus._fill("{c_name} gst {c_custkey}"),
                corpus._fill("Contact us {c_custkey}"),
                corpus._fill("{initcap(c_mktsegment)}"),
            )
        ).alias("text"),
        F.when(F.col("c_nationkey") < 12, "industries").otherwise("solutions").alias("bucket"),
    )
    suppliers = table(spark, folder, "supplier").select("s_name", F.lit(None).cast("string"))
    return (
        documents.unionByName(orders)
        .unionByName(customers)
        .union(suppliers)
        .select(T.clean_text(F.col("text")).alias("text"), "bucket")
        .filter("text is not null")
        .withColumn("company_name", F.lit("Automobile"))
    )


@query
def noise_audit(spark, folder):
    """How many candidates each noise rule rejects, and how many any rule does."""
    flags = _candidates(spark, folder).select(
        F.expr(N.noise_flags("text", "bucket", "company_name")).alias("r")
    )
    counted = flags.agg(
        F.count("*").alias("candidates"),
        F.count_if(reduce(or_, [F.col(f"r.{name}") for name in N.RULE_NAMES])).alias("any_rule"),
        *[F.count_if(F.col(f"r.{name}")).alias(name) for name in N.RULE_NAMES],
    )
    names = ["candidates", "any_rule", *N.RULE_NAMES]
    return counted.select(
        F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])).alias("rule", "n")
    )


def _document_page(wrap_open: str, line_open: str, line_close: str, wrap_close: str) -> Column:
    escaped = F.replace(
        F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
        F.lit(">"), F.lit("&gt;"),
    )
    lines = F.replace(escaped, F.lit("\n"), F.lit(line_close + line_open))
    return F.concat(F.lit(wrap_open + line_open), lines, F.lit(line_close + wrap_close))


@query
def heading_items(spark, folder):
    """Documents as pages with one heading per line."""
    pages = spread(table(spark, folder, "documents"), "doc_id").select(
        F.col("doc_id").alias("page_id"),
        F.lit("Images").alias("name"),
        _document_page("<html><body><nav><h2>Menu</h2></nav><main>", "<h2>", "</h2>", "</main>").alias("html"),
    )
    items = outlines(pages).select("page_id", F.expr(P.heading_items("name")).alias("items"))
    return items.select("page_id", _long(F.size("items")).alias("n_items"), _joined("items"))


@query
def card_items(spark, folder):
    """Documents as pages with one card per line, read as a product listing."""
    pages = spread(table(spark, folder, "documents"), "doc_id").select(
        F.col("doc_id").alias("page_id"),
        F.lit("products").alias("bucket"),
        F.lit("Images").alias("name"),
        _document_page(
            "<html><body><footer><i>x</i><i>y</i><i>z</i></footer><div><div class='c b'>1</div>"
            "<div class='b c'>2</div>", "<div class='b c'>", "</div>", "</div>"
        ).alias("html"),
    )
    items = outlines(pages).select("page_id", F.expr(P.listing_items("bucket", "name")).alias("items"))
    return items.select("page_id", _long(F.size("items")).alias("n_items"), _joined("items"))


# --- supplier sites --------------------------------------------------------------------------


def _supplier_extract(spark, folder) -> DataFrame:
    return extract_pages(corpus.supplier_pages(spark, folder))


@query
def supplier_fields(spark, folder):
    return _supplier_extract(spark, folder).select(
        "url", "page_type", "is_third_party", "title", "company_name_guess", "meta_description"
    )


@query
def supplier_contacts(spark, folder):
    return _supplier_extract(spark, folder).select("url", _joined("emails"), _joined("phones"))


@query
def supplier_social(spark, folder):
    rows = _supplier_extract(spark, folder).select("url", F.explode("social_links").alias("s"))
    return rows.select("url", "s.platform", "s.href")


@query
def supplier_addresses(spark, folder):
    return _supplier_extract(spark, folder).select(
        "url",
        _joined("address_candidates"),
        _joined("headquarters_candidates"),
        _joined("other_location_candidates"),
    )


@query
def supplier_items(spark, folder):
    return _supplier_extract(spark, folder).select("url", _joined("heading_list_items"))


@query
def supplier_links(spark, folder):
    """Links of supplier pages resolved, gated and classified for the queue."""
    found = links.page_links(outlines(corpus.supplier_pages(spark, folder)))
    edges = links.link_graph(found)
    return edges.select(
        "url", _long("ord").alias("ord"), "canonical_url", "anchor", "category",
        _long(C.priority_class(F.col("category"))).alias("priority"), "in_chrome",
    )


@query
def company_profiles(spark, folder):
    """All pages of supplier sites parsed, extracted and merged into facts."""
    extract = cut_lineage(_supplier_extract(spark, folder).drop("visible_text_sample"))
    return profile.company_facts(profile.profile_facts(extract))


@query
def rendered_pages(spark, folder):
    """Script-filled start pages of shops replaced by their rendered body if there is one."""
    shops = deal(
        table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), "c_custkey"
    )
    url = corpus._fill("https://spa-{c_custkey}.test/")
    static = shops.select(
        F.col("c_custkey").alias("page_id"),
        url.alias("url"),
        F.when(
            F.col("c_nationkey") < 15,
            corpus._fill("<html><head><title>Loading</title></head><body>"
                         "<div id='root'>Loading...</div><script>go({c_custkey})</script></body></html>"),
        ).otherwise(
            corpus._fill("<html><head><title>{c_name}</title></head><body><h1>{c_name} static</h1><p>"
                         "{repeat('Plain words. ', 20)}</p></body></html>")
        ).alias("html"),
    )
    rendered = shops.select(
        url.alias("url"),
        (F.col("c_acctbal") > 2000).alias("ok"),
        F.when(F.col("c_mktsegment") == "BUILDING", "")
        .otherwise(corpus._fill("<title>Loading</title><h1>{c_name} app</h1><p>{repeat('Live words. ', 20)}</p>"))
        .alias("html"),
    )
    # Each was rendered before, with another body, and once more without one.
    runs = [
        rendered.filter("ok and html <> ''").withColumn("html", F.lit("<title>Before</title>")).withColumn("at", F.lit(1)),
        rendered.withColumn("at", F.lit(2)),
        rendered.withColumn("html", F.lit("")).withColumn("at", F.lit(3)),
    ]
    both = reduce(DataFrame.unionByName, runs)
    fields = extract_pages(choose_body(static, both, latest="at"))
    return fields.select(
        "url", "rendered_with", "title", "company_name_guess", "is_thin_content",
        fetchlog.extraction_result(
            F.col("has_body"), F.col("is_thin_content"), F.col("rendered_with")
        ).alias("extraction_result"),
    )


# --- frontier ----------------------------------------------------------------------------------


def _first_round(spark, folder):
    seeds = frontier.seed_frontier(corpus.shop_sites(spark, folder))
    found = seeds.select("site", "url", "depth").join(
        # Only these stand on start pages.
        corpus.shop_links(spark, folder, ["orders"]).select("url", "ord", "canonical_url", "anchor"),
        "url",
    )
    return seeds, seeds.unionByName(frontier.new_frontier_rows(seeds, found, max_depth=None))


@query
def frontier_round(spark, folder):
    """The queue of every shop after its start page was read."""
    _, rows = _first_round(spark, folder)
    return rows.select(
        "site", "url", _long("priority").alias("priority"), _long("depth").alias("depth"),
        "variant_rank", "ord", "discovered_from",
    )


@query
def next_urls(spark, folder):
    """What to fetch next: five URLs per shop, within a budget of four pages."""
    seeds, rows = _first_round(spark, folder)
    best = frontier.frontier_rank(rows, seeds, max_pages=4, k=5)
    return best.select("site", "url", _long("place").alias("place"))


@query
def queue_places(spark, folder):
    """The place of every URL that is left in the queue of its shop, without a budget."""
    seeds, rows = _first_round(spark, folder)
    best = frontier.frontier_rank(rows, seeds, max_pages=None, k=None)
    return best.select("site", "url", _long("place").alias("place"), _long("seq").alias("seq"))


@query
def visit_replay(spark, folder):
    """Best-first replay of all shops at once, one page per shop and round."""
    fetched, _ = frontier.replay(
        corpus.shop_sites(spark, folder),
        corpus.shop_archive(spark, folder),
        corpus.shop_links(spark, folder),
        max_pages=3,
        max_depth=3,
    )
    return fetched.select(
        "site", "url", _long("seq").alias("seq"), _long("depth").alias("depth"),
        "discovered_from", "fetched_ok",
    )


@query
def visit_stops(spark, folder):
    """Why a visit in one round of up to ten pages ended."""
    fetched, rows = frontier.replay(
        corpus.shop_sites(spark, folder),
        corpus.shop_archive(spark, folder),
        corpus.shop_links(spark, folder).filter("anchor like 'Order%'"),
        max_pages=10,
        max_depth=3,
        k=9,
    )
    return frontier.stop_reasons(fetched, rows, max_pages=10).select(
        "site", _long("tried").alias("tried"), "stop_reason"
    )


@query
def site_reach(spark, folder):
    # Read once, by the table of edges in buckets.
    edges = links.link_graph(corpus.shop_links(spark, folder)).select("url", "canonical_url")
    seeds = corpus.shop_sites(spark, folder).select("site", F.col("start_url").alias("url"))
    return (
        frontier.site_reach(seeds, edges, max_depth=None)
        .groupBy("site", _long("hops").alias("hops"))
        .agg(F.count("*").alias("n_urls"))
    )


@query
def discovery_tree(spark, folder):
    """Depth and fan-out of discovery in shops: start page, orders, products."""
    found = corpus.shop_links(spark, folder)
    site = F.regexp_extract("url", "^(https://[^/]+/)", 1)
    edges = found.filter("anchor <> 'Start'").select(
        site.alias("site"),
        F.col("canonical_url").alias("url"),
        F.when(F.col("anchor").startswith("Order"), 1)
        .when(F.col("anchor") == "See part", 2)
        .otherwise(3)
        .alias("depth"),
        F.col("url").alias("discovered_from"),
    )

    def first(found: DataFrame) -> DataFrame:
        # Orders behind the account area were never read, their products have no known parent.
        return (
            found.groupBy("site", "url")
            .agg(F.min(F.struct("depth", "discovered_from")).alias("f"))
            .select("site", "url", "f.*")
            .filter("url not like '%/account/%'")
        )

    # Read three times by the tree, as it lies.
    tree = BucketedTable(spark, "tree", ["site", "url"], compression="zstd")
    try:
        tree.add(edges, reduced=first)
        tree.add(
            corpus.shop_sites(spark, folder).select(
                "site", F.col("start_url").alias("url"), F.lit(0).alias("depth"),
                F.lit(None).cast("string").alias("discovered_from"),
            )
        )
        stats = cut_lineage(frontier.discovery_tree(tree.read()))
    finally:
        tree.forget()
    return stats.select(
        "site", *[_long(c).alias(c) for c in stats.columns if c != "site"]
    )


@query
def discovery_paths(spark, folder):
    """Every page of the shops' trails with the page that its discovery goes back to."""
    # Read three times by the paths.
    return chains.discovery_paths(cut_lineage(corpus.order_trail(spark, folder), compression="zstd"))


# --- fetch log -----------------------------------------------------------------------------------


@query
def retry_final(spark, folder):
    return fetchlog.retry_reduction(corpus.fetch_attempts(spark, folder)).select(
        "url", _long("attempts").alias("attempts"), "ok", _long("status").alias("status"),
        "error", "final_url", "html",
    )


@query
def fetch_outcomes(spark, folder):
    rules = fetchlog.robots_rules(corpus.robots_files(spark, folder))
    outcomes = fetchlog.fetch_outcomes(corpus.fetch_attempts(spark, folder), rules, corpus.AGENT)
    return outcomes.groupBy("ok", "error", _long("status").alias("status")).agg(
        F.count("*").alias("n"), F.sum(_long("attempts")).alias("attempts")
    )


@query
def redirect_chains(spark, folder):
    found = chains.redirect_chains(corpus.redirect_log(spark, folder))
    return found.select(
        "requested_url", "final_url", F.array_join("redirect_chain", "|").alias("redirect_chain"), "looped",
        _long("status").alias("status"), "content_type", "ok", "error", _long("attempts").alias("attempts"), "elapsed_ms",
    )


@query
def daily_figures(spark, folder):
    """Figures of a site over a span of days out of its daily sketches, held against the exact ones: counts as they are, and
    whether distinct URLs and quantiles are within the stated errors."""
    visits = table(spark, folder, "events").select(
        F.concat(F.lit("site-"), (F.col("user_id") % 10).cast("string")).alias("site"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("/"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type")).alias("url"),
        (F.col("event_type") != "error").alias("ok"),
        F.pmod(F.xxhash64("event_id"), F.lit(100_000)).alias("elapsed_ms"),
    )
    days = cut_lineage(daily.daily_sketches(visits))
    quantiles = [0.5, 0.9]
    merged = daily.span_figures(days, ["site"], quantiles)
    one = daily.span_figures(days, [], quantiles).withColumn("site", F.lit("all"))
    both = visits.unionByName(visits.withColumn("site", F.lit("all"))).join(
        merged.unionByName(one), "site"
    )
    below = [F.count_if(F.col("elapsed_ms") < F.col(c)).alias(f"under_{c}") for c in ("ms_50", "ms_90")]
    upto = [F.count_if(F.col("elapsed_ms") <= F.col(c)).alias(f"upto_{c}") for c in ("ms_50", "ms_90")]
    exact = both.groupBy("site", "visits", "failed_rate", "n_urls").agg(
        F.count("*").alias("n"), F.count_distinct("url").alias("n_distinct"), *below, *upto
    )

    def near(q: float, c: str) -> Column:
        n = F.col("n")
        return (F.col(f"under_{c}") / n <= q + daily.RANK_ERROR) & (F.col(f"upto_{c}") / n >= q - daily.RANK_ERROR)

    return exact.select(
        "site", "visits", "failed_rate", F.col("n_distinct").alias("n_urls"),
        (F.abs(F.col("n_urls") - F.col("n_distinct")) <= daily.COUNT_ERROR * F.col("n_distinct")).alias("urls_near"),
        (near(0.5, "ms_50") & near(0.9, "ms_90")).alias("times_near"),
    )


@query
def robots_decisions(spark, folder):
    rules = fetchlog.robots_rules(corpus.robots_files(spark, folder))
    urls = table(spark, folder, "orders").select(corpus.order_url().alias("url"))
    return fetchlog.robots_decisions(urls, rules, corpus.AGENT).select("url", "allowed")


@query
def politeness(spark, folder):
    """Twelve hours between requests of one host; a day's requests are one bucket."""
    schedule = fetchlog.politeness_schedule(
        corpus.request_log(spark, folder),
        delay_ms=12 * 3600 * 1000,
        bucket=F.floor(F.col("ready_ms") / 86_400_000),
        order=[F.col("ready_ms"), F.col("event_id")],
    )
    return schedule.select("event_id", "netloc", "start_ms")


# --- reports and stores ------------------------------------------------------------------------------


def _supplier_runs(spark, folder):
    """Whole supplier sites, and a page per supplier that was not there."""
    pages = corpus.supplier_pages(spark, folder)
    gone = pages.filter("seq = 0").select(
        "site", F.lit(1 << 40).alias("seq"), F.lit(1).alias("depth"),
        F.concat("site", F.lit("news/gone")).alias("url"),
    )
    fine = pages.select("site", "seq", "depth", "url")
    tried = fine.withColumn("ok", F.lit(True)).unionByName(gone.withColumn("ok", F.lit(False)))
    tried = tried.select(
        "*",
        F.when(F.col("seq") > 0, F.col("site")).alias("discovered_from"),
        F.when(F.col("ok"), 200).otherwise(404).alias("status"),
        F.when(~F.col("ok"), "http_404").alias("error"),
        F.when(F.col("seq") == 2, F.concat("url", F.lit("/"))).otherwise(F.col("url")).alias("final_url"),
        F.lit("static").alias("rendered_with"),
    )
    extract = extract_pages(pages)
    return tried, extract


@query
def page_audit(spark, folder):
    tried, extract = _supplier_runs(spark, folder)
    return report.page_records(tried, extract).select(
        "site", "seq", "url", "page_type", "final_url", "title",
        _long("http_status").alias("http_status"), "fetched_ok", "extraction_result", "error",
        _long("depth").alias("depth"), "rendered_with", "discovered_from", "is_third_party",
    )


@query
def status_rollup(spark, folder):
    tried, extract = _supplier_runs(spark, folder)
    return report.status_rollup(report.page_records(tried, extract))


def _supplier_reports(spark, folder):
    tried, extract = _supplier_runs(spark, folder)
    extract = cut_lineage(extract)
    # Read twice by the reports.
    records = cut_lineage(report.page_records(tried, extract))
    profiles = profile.build_profiles(extract)
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    runs = profiles.select(
        F.col("website").alias("site"),
        F.col("website").alias("input_url"),
        start.alias("started_at"),
        start.alias("finished_at"),
        F.lit("queue_exhausted").alias("stop_reason"),
    )
    return report.nested_reports(records, profiles, runs)


@query
def report_files(spark, folder):
    """Nested reports written as JSON, read back and flattened."""
    path = _scratch(spark, "reports")
    store.write_reports(_supplier_reports(spark, folder), path)
    back = store.read_reports(spark, path)
    meta = "run_meta."
    return back.select(
        "input_url",
        *[f"{meta}{c}" for c in ("pages_discovered", "pages_fetched_ok", "pages_failed",
                                 "max_pages_limit", "stop_reason")],
        F.col("company.company_name").alias("company_name"),
        F.col("company.headquarters").alias("headquarters"),
        F.array_join("company.emails", "|").alias("emails"),
        F.element_at("company.social_links", F.lit("twitter")).alias("twitter"),
        F.array_join(F.col("pages.extraction_result"), "|").alias("results"),
        F.array_join(F.transform("pages", lambda p: F.coalesce(p["error"], F.lit("-"))), "|").alias("errors"),
    )


@query
def report_shapes(spark, folder):
    """Reports of suppliers in three shapes, broken ones among them, read into one table; the rest as
    rejects."""
    s = table(spark, folder, "supplier")
    new = (
        '{"input_url":"https://s{s_suppkey}.test/","run_meta":{"pages_discovered":{s_nationkey},"stop_reason":"queue_exhausted"},'
        '"company":{"company_name":"{s_name}","emails":["a@s{s_suppkey}.test","b@s{s_suppkey}.test"],'
        '"social_links":{"twitter":"https://x.com/s{s_suppkey}"}},"pages":[{"url":"https://s{s_suppkey}.test/","http_status":200}]}'
    )
    old = (
        '{"input_url":"https://s{s_suppkey}.test/","pages_discovered":"{s_nationkey}","stop_reason":"queue_exhausted",'
        '"company":{"company_name":"{s_name}","emails":"a@s{s_suppkey}.test",'
        '"social_links":[{"platform":"twitter","url":"https://x.com/s{s_suppkey}"}]},"more":[1,{"x":null}]}'
    )
    other = '{"input_url":"https://s{s_suppkey}.test/","visit_meta":{"pages_discovered":-1},"pages":[{"http_status":"404"},7]}'
    kind = F.col("s_suppkey") % 6
    text = (
        F.when(kind == 0, _template(new)).when(kind == 1, _template(old)).when(kind == 2, _template(other))
        .when(kind == 3, F.left("s_text", F.lit(60))).when(kind == 4, F.concat(F.lit("["), F.col("s_suppkey").cast("string"), F.lit("]")))
        .otherwise(F.concat(F.lit('{"input_url":null,"n":'), F.col("s_suppkey").cast("string"), F.lit("}")))
    )
    path = _scratch(spark, "shapes")
    s.withColumn("s_text", _template(new)).select(text.alias("value")).write.text(path)
    reports, rejects = store.read_any_reports(spark, path)
    first = F.get("pages", F.lit(0))
    rows = reports.select(
        "input_url", F.col("run_meta.pages_discovered").alias("pages_discovered"), F.col("run_meta.stop_reason").alias("stop_reason"),
        F.col("company.company_name").alias("company_name"), F.array_join("company.emails", "|").alias("emails"),
        F.element_at("company.social_links", F.lit("twitter")).alias("twitter"),
        _long(F.size("pages")).alias("n_pages"), _long(first["http_status"]).alias("status"),
    )
    return rows.unionByName(rejects.select("record", "reason"), allowMissingColumns=True)


@query
def site_reports(spark, folder):
    """From start URLs and a fetch log to reports: visit, read, merge, with four pages each."""
    pages = corpus.supplier_pages(spark, folder)
    attempts = pages.select(
        "url", F.lit(1).alias("attempt"), F.lit(200).alias("status"),
        F.lit("text/html").alias("content_type"),
        F.octet_length("html").cast("bigint").alias("body_bytes"),
        F.col("html").alias("body"), F.col("url").alias("final_url"),
        F.lit(None).cast("string").alias("exception"), F.lit(None).cast("string").alias("message"),
    )
    home = pages.filter("seq = 0")
    # Two spellings of one start.
    sites = home.select(F.upper("url").alias("start_url")).unionByName(home.select(F.col("url").alias("start_url")))
    result = report_sites(sites, attempts, max_pages=4, max_depth=3, k=4)
    meta = "run_meta."
    return result.reports.select(
        "input_url", "site",
        *[f"{meta}{c}" for c in ("pages_discovered", "pages_fetched_ok", "pages_failed",
                                 "max_pages_limit", "stop_reason")],
        F.col("company.company_name").alias("company_name"),
        F.col("company.headquarters").alias("headquarters"),
        F.array_join("company.phones", "|").alias("phones"),
        F.array_join(F.col("pages.page_type"), "|").alias("page_types"),
        F.array_join(F.transform("pages", lambda p: F.coalesce(p["error"], F.lit("-"))), "|").alias("errors"),
    )


@query
def companies_upsert(spark, folder):
    """Two visits of suppliers: the second has other descriptions and fewer suppliers."""
    s = table(spark, folder, "supplier")
    site = F.concat(F.lit("https://s"), F.col("s_suppkey").cast("string"), F.lit(".test/"))

    def batch(rows, at, text):
        return rows.select(
            site.alias("website"), F.col("s_name").alias("company_name"),
            corpus._fill(text).alias("description"),
            F.to_json(F.array(F.lit("é"), corpus._fill("Nation {s_nationkey}"))).alias("other_locations"),
            F.lit(at).alias("seen_at"),
        )

    old = batch(s, "2024-01-01T00:00:00+00:00", "{s_name} old")
    new = batch(s.filter("s_acctbal > 3000"), "2024-02-01T00:00:00+00:00", "{s_name} new")
    late = batch(s.filter("s_acctbal < 1000"), "2023-12-01T00:00:00+00:00", "{s_name} stale")
    return store.upsert_companies(store.upsert_companies(old, new), late)


@query
def pages_replace(spark, folder):
    """Orders as pages of two runs; pages missing from the second run are kept."""
    o = table(spark, folder, "orders")

    def run(rows, at, kind):
        return rows.select(
            corpus._fill("https://shop-{o_custkey}.test/").alias("website"),
            corpus.order_url().alias("url"),
            F.lit(kind).alias("page_type"),
            _long("o_orderkey").alias("http_status"),
            F.lit(at).alias("seen_at"),
        )

    old = run(o.filter("o_orderstatus <> 'O'"), 1, "other")
    new = run(o.filter("o_orderstatus <> 'F'"), 2, "products")
    return store.replace_pages(old, new).withColumn("seen_at", _long("seen_at"))


@query
def stored_tables(spark, folder):
    """Company and page rows of reports, merged twice into partitioned tables."""
    reports = cut_lineage(_supplier_reports(spark, folder))
    companies, pages = _scratch(spark, "companies"), _scratch(spark, "pages")
    for _ in range(2):
        store.merge_table(companies, store.company_rows(reports), ["website"])
        store.merge_table(pages, store.page_rows(reports), ["website", "url"])
    c, p = store.read_table(spark, companies), store.read_table(spark, pages)
    return p.join(c.select("website", "company_name", "emails"), "website").select(
        "website", "company_name", "emails", "url", "page_type", _long("http_status").alias("http_status"),
        "fetched_ok", "extraction_result", "error",
    )


# --- streams -------------------------------------------------------------------------------------------


def _either(folder: str, name: str) -> str:
    """The path of a table for a stream, whether it is a file or a folder of files. Streams take a single file only
    as the match of a pattern."""
    return f"{folder}/{{{name}.parquet}}"


@query
def feed_extract(spark, folder):
    """Page files as a stream, fields appended; equal to the batch result."""
    out = _scratch(spark, "feed")
    pages = spread(feed.page_feed(spark, _either(folder, "pages")), "page_id")
    fields = feed.extract_feed(pages).select(
        "page_id", "title", "page_type", "company_name_guess",
        _long("visible_chars").alias("visible_chars"), _joined("emails"),
    )
    feed.run_to_end(fields, out, _scratch(spark, "feed-state"))
    return spark.read.parquet(out)


def _event_stream(spark, folder):
    return spark.readStream.schema(table(spark, folder, "events").schema).parquet(_either(folder, "events"))


@query
def feed_first_sightings(spark, folder):
    out = _scratch(spark, "sightings")
    seen = _event_stream(spark, folder).select(
        F.col("ts").cast("timestamp").alias("ts"),
        corpus._fill("HTTP://U{user_id}.Test/{event_type}/../{event_type}?utm_source=m#x").alias("url"),
    )
    first = feed.first_sightings(seen, "ts", "90 days")
    feed.run_to_end(first.select("canonical_url"), out, _scratch(spark, "sightings-state"))
    return spark.read.parquet(out)


@query
def fetch_health(spark, folder):
    log = corpus.outcome_log(table(spark, folder, "events"))
    health = feed.fetch_health(log, "ts", "1 day", "0 seconds")
    return health.select(
        _long(F.unix_seconds(F.col("window.start"))).alias("window_start"),
        "fetches", "failed_rate", "dynamic_rate", "third_party_rate",
    )


@query
def feed_health(spark, folder):
    """The same figures from a stream; windows still open at the end are updated in place."""
    out = _scratch(spark, "health")
    log = corpus.outcome_log(_event_stream(spark, folder))
    health = feed.fetch_health(log, "ts", "1 day", "10 minutes").select(
        _long(F.unix_seconds(F.col("window.start"))).alias("window_start"),
        "fetches", "failed_rate", "dynamic_rate", "third_party_rate",
    )
    feed.merge_to_end(health, out, _scratch(spark, "health-state"), ["window_start"])
    return store.read_table(spark, out).drop("batch")


@query
def feed_profiles(spark, folder):
    """Facts kept up to date from a stream of page files, of which some pages came before with
    another body."""
    landing, extract = _scratch(spark, "landing"), _scratch(spark, "extract")
    facts, state = _scratch(spark, "facts"), _scratch(spark, "profile-state")
    pages = corpus.supplier_pages(spark, folder)
    stale = F.concat(F.lit("<title>Old name</title><p>old@before.test</p>"), "html")
    schema = pages.schema
    for batch in (pages.filter("depth <= 1").withColumn("html", stale), pages):
        batch.write.mode("append").parquet(landing)
        stream = spark.readStream.schema(schema).parquet(landing)
        feed.refresh_profiles(extract_pages(stream), extract, facts, state)
    return store.read_table(spark, facts).filter("field is not null")

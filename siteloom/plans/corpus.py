"""Web corpora derived from the business tables, row by row.

The raw ``pages`` table has neither contact pages nor product listings nor links that lead
anywhere inside it. Suppliers, parts, customers and orders are what such sites are made
from, so each of their rows becomes a page, a link or a fetch, and everything here grows
with its table.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.operators.links import with_canonical_url
from siteloom.operators.prefix import running_rank
from siteloom.sources.tables import deal, spread, table


def _fill(template: str) -> Column:
    """Concatenate a template with ``{expression}`` slots."""
    parts = []
    for piece in template.replace("\n", "").split("{"):
        expression, brace, text = piece.partition("}")
        if brace:
            parts += [F.expr(expression).cast("string"), F.lit(text)]
        else:
            parts.append(F.lit(piece))
    return F.concat(*parts)


# --- supplier sites -----------------------------------------------------------------

HOME = """<html><head><title>{title}</title>{meta}
<style>p{css}</style><script>var mail = 'x';</script></head><body><header>{logo}<nav>
<a href="/about-us">About <b>us</b></a><a href="/contact#form">Contact</a>
<a href="/login">Login</a><a href="/brochure.pdf">Brochure</a>
<a href="?ref=nav&page=2">More</a></nav></header><h1>{s_name} works</h1>
<p>Supplying {n_name} since 1998 &amp; counting.</p><noscript>Enable scripts</noscript>
<footer><a href="https://www.linkedin.com/company/supplier-{s_suppkey}">in</a>
<a href="https://x.com/supplier{s_suppkey}">x</a>
<a href="https://twitter.com/old{s_suppkey}">t</a><a href="{site}blog">own</a>
<p>sales{s_suppkey}@supplier-{s_suppkey}.test, you@company.com, icon{s_suppkey}@2x.png</p>
</footer></body></html>"""

ABOUT = """<html><head><title>About | {s_name}</title>
<meta property="og:description" content="unused">
<meta name="description" content="{s_name} is based in {n_name},  {r_name}."></head><body>
<h1>About {s_name}</h1><address>{s_name}, Plot {s_suppkey}, {n_name}, {r_name}</address>
<div class="office-block">Branch hall {s_suppkey}, Dock Road, {n_name}</div>
<div id="navigation">Depot office {s_suppkey}, {r_name}</div></body></html>"""

CONTACT = """<html><head><title>Contact | {s_name}</title></head><body><h1>Contact Us</h1>
{label}<div>Branch Office: {s_suppkey} Side Street, {n_name}</div>
<p class="location">Yard {s_suppkey}, Quay Road, {n_name}</p>
<a href="tel:%2B91-{phone}"><svg></svg></a><p>Call +1 ({area}) 555-{line} now</p>
<p>support{s_suppkey}@supplier-{s_suppkey}.test</p></body></html>"""

PART = """<html><head><title>{p_name} | {p_brand}</title></head><body>
<nav class="crumbs"><a href="/categories">All categories</a></nav><main><h1>{p_name}</h1>
<a href="/products?category={p_type}&utm_source=x">{initcap(p_type)} range</a>
<div class="grid"><div class="card"><h3>{initcap(p_name)} {p_size}</h3>
<span class="badge">MOQ: {p_size} units</span><a href="/quote">Ask for Quote</a></div>
<div class="card"><p>Fits all</p><a href="/kits/{p_partkey}">{p_type} Kit</a>
<a href="/kits">Know More</a></div>
<div class="card"><h3>ACME {upper(p_name)} TRADING CO</h3><a href="/x">View Profile</a></div>
<div class="card">{initcap(p_name)} <i>spares</i></div>
</div></main><form><label>First name *</label></form>
<p>maintainer{p_partkey}@parts.test</p></body></html>"""

INDUSTRY = """<html><head><title>{p_type}</title></head><body><h1>{p_type} goods</h1>
<ul class="tiles"><li class="tile"><h4>{initcap(p_type)} Handling</h4></li>
<li class="tile"><h4>{initcap(p_type)} Automotive Industry</h4></li>
<li class="tile"><h4>Reduce {lower(p_type)} waste</h4></li></ul></body></html>"""

MEMBER = """<html><head><title>{c_name} Pvt Ltd</title>
<meta property="og:site_name" content="{c_name} Pvt Ltd"></head><body><h1>{c_name}</h1>
<address>{c_name}, Elsewhere Road, {n_name}</address>
<p>contact@member-{c_custkey}.test</p></body></html>"""

#: The agent that the robots files of shops know.
AGENT = "SiteloomBot/1.0"
PAGE_COLUMNS = ["page_id", "site", "seq", "depth", "url", "html"]


def _site(key: str) -> Column:
    return F.concat(
        F.lit("https://www.supplier-"), F.lpad(F.col(key).cast("string"), 9, "0"), F.lit(".test/")
    )


def _page(rows: DataFrame, path: str, seq: Column, depth: int, html: str) -> DataFrame:
    site = _site("s_suppkey")
    return (
        rows.withColumn("site", site)
        .withColumn("seq", seq.cast("bigint"))
        .withColumn("url", F.concat("site", _fill(path)))
        .withColumn("page_id", F.xxhash64("url"))
        .withColumn("depth", F.lit(depth))
        .withColumn("html", _fill(html))
        .select(*PAGE_COLUMNS)
    )


def supplier_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Sites of suppliers: home, about, contact, one page per part they are first to
    deliver, one per industry these belong to, and listings of other businesses."""
    nations = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    suppliers = deal(
        table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), "s_suppkey"
    ).join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    signals = (
        suppliers.withColumn("css", F.lit("{margin:0}"))
        .withColumn(
            "title",
            F.expr(
                "case n_regionkey when 3 then 'Welcome.' when 4 then"
                " concat('Home | ', s_name, ' of ', n_name, ' : Docs') else 'Start | Home' end"
            ),
        )
        .withColumn(
            "meta",
            F.expr(
                "case n_regionkey when 0 then"
                " concat('<meta property=\"og:site_name\" content=\" ', s_name, '  Ltd\">')"
                " when 1 then"
                " concat('<meta name=\"application-name\" content=\"', s_name, ' App\">')"
                " else '' end"
            ),
        )
        .withColumn(
            "logo",
            F.expr(
                "case n_regionkey when 2 then concat('<a class=\"navbar-brand x\" href=\"/\">"
                "<img alt=\"', s_name, ' Group\"></a>')"
                " when 4 then concat('<img class=\"logo\" alt=\"', s_name, ' Logo\">')"
                " else '' end"
            ),
        )
        .withColumn(
            "label",
            F.expr(
                "case when s_acctbal >= 5000 then concat('<div>Registered Office: ', s_suppkey,"
                " ' Main Street, ', n_name, '</div>') else '' end"
            ),
        )
        .withColumn("phone", F.lpad(F.col("s_suppkey").cast("string"), 10, "9"))
        .withColumn("area", F.expr("200 + s_nationkey"))
        .withColumn("line", F.expr("lpad(cast(s_suppkey % 10000 as string), 4, '0')"))
    )
    makers = table(spark, folder, "lineitem").groupBy("l_partkey").agg(
        F.min("l_suppkey").alias("s_suppkey")
    )
    parts = deal(
        table(spark, folder, "part").join(makers, F.col("p_partkey") == F.col("l_partkey"))
        .select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "s_suppkey"),
        "p_partkey",
    )
    industries = deal(
        parts.groupBy("s_suppkey", "p_type").agg(F.min("p_partkey").alias("p_partkey")), "p_partkey"
    )
    hosts = table(spark, folder, "supplier").groupBy("s_nationkey").agg(
        F.min("s_suppkey").alias("s_suppkey")
    )
    members = (
        deal(table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "c_custkey")
        .join(hosts, F.col("c_nationkey") == F.col("s_nationkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    far = 10**12
    pages = [
        _page(signals, "", F.lit(0), 0, HOME),
        _page(suppliers, "about-us", F.lit(1), 1, ABOUT),
        _page(signals, "contact", F.lit(2), 1, CONTACT),
        _page(industries, "solutions/industry/{lower(p_type)}-goods",
              F.col("p_partkey") + 100, 2, INDUSTRY),
        _page(parts, "products/p{p_partkey}", F.col("p_partkey") + far, 2, PART),
        _page(members, "business/member-{c_custkey}-{lower(c_mktsegment)}",
              F.col("c_custkey") + 2 * far, 2, MEMBER),
    ]
    out = pages[0]
    for p in pages[1:]:
        out = out.unionByName(p)
    return spread(out, "page_id")


# --- shops: a link graph over customers, orders and lines -----------------------------


def _shop(key: str) -> Column:
    return F.concat(F.lit("https://shop-"), F.col(key).cast("string"), F.lit(".test/"))


def _order_path() -> Column:
    area = (
        F.when(F.col("o_orderstatus") == "F", "news")
        .when(F.col("o_orderstatus") == "O", "projects")
        .otherwise("account")
    )
    return F.concat(area, F.lit("/order-"), F.col("o_orderkey").cast("string"))


def shop_sites(spark: SparkSession, folder: str) -> DataFrame:
    site = _shop("c_custkey")
    return table(spark, folder, "customer").select(site.alias("site"), site.alias("start_url"))


def _products(bought: DataFrame, *also: str) -> DataFrame:
    """Product pages of shops, a row per URL, with columns of ``bought`` that tell pages without a URL apart. They
    are told apart by their keys, which are shorter than the URL made of them; without one of them there is no URL."""
    keys = ["o_custkey", "l_partkey", "l_suppkey"]
    whole = reduce(and_, [F.col(c).isNotNull() for c in keys])
    told = [F.col(c).alias(c) if c in also else F.when(whole, F.col(c)).alias(c) for c in keys]
    url = F.concat(_shop("o_custkey"), _fill("products/part-{l_partkey}?supplier={l_suppkey}"))
    return deal(bought.select(*told), *keys).distinct().select(url.alias("url"), *also)


LINK_KINDS = ["orders", "products", "help"]


def shop_links(
    spark: SparkSession, folder: str, kinds: list[str] | None = None
) -> DataFrame:
    """Start pages link to orders, orders to products (with a query and a tracking tag),
    products back to the start and on to a help page. ``url, ord, href, anchor`` and the
    resolved ``canonical_url``. With ``kinds`` only those links are built."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    lines = (
        table(spark, folder, "lineitem")
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        .groupBy("l_orderkey", "l_partkey", "l_suppkey")
        .agg(F.min("l_linenumber").alias("l_linenumber"))
    )
    ranked = running_rank(
        orders, ["o_custkey"], [F.col("o_orderkey")], F.floor(F.col("o_orderkey") / 65536)
    )
    from_home = deal(ranked, "o_orderkey").select(
        _shop("o_custkey").alias("url"),
        (F.col("running_rank") - 1).alias("ord"),
        F.concat(F.lit("/"), _order_path(), F.lit("#top")).alias("href"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("anchor"),
    )
    bought = running_rank(
        lines,
        ["l_orderkey"],
        [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")],
        F.when(F.col("l_partkey").isNotNull(), F.floor(F.col("l_linenumber") / 4096)),
    ).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    from_order = bought.select(
        F.concat(_shop("o_custkey"), _order_path()).alias("url"),
        (F.col("running_rank") - 1).alias("ord"),
        _fill("../products/./part-{l_partkey}?utm_source=mail&supplier={l_suppkey}").alias("href"),
        F.lit("See part").alias("anchor"),
    )
    # Only lines with a place among those of their order are linked to.
    placed = table(spark, folder, "lineitem").filter("l_linenumber is not null and l_partkey is not null")
    owned = placed.select("l_orderkey", "l_partkey", "l_suppkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    from_product = _products(owned, "l_partkey").select(
        "url",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("ord"), F.lit("/").alias("href"), F.lit("Start").alias("anchor")),
                F.struct(
                    F.lit(1).alias("ord"), _fill("/help/part-{l_partkey}").alias("href"),
                    F.lit("Help").alias("anchor"),
                ),
            )
        ).alias("l"),
    ).select("url", F.col("l.ord").cast("bigint").alias("ord"), "l.href", "l.anchor")
    built = dict(zip(LINK_KINDS, (from_home, from_order, from_product), strict=True))
    links = reduce(DataFrame.unionByName, [built[k] for k in kinds or LINK_KINDS])
    return with_canonical_url(links, "href", "url")


def shop_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Pages that could be fetched: all but the most expensive orders."""
    orders = table(spark, folder, "orders")
    kept = orders.filter(F.col("o_totalprice") <= 400_000)
    order_pages = kept.select(F.concat(_shop("o_custkey"), _order_path()).alias("url"))
    homes = shop_sites(spark, folder).select(F.col("site").alias("url"))
    bought = table(spark, folder, "lineitem").join(
        orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    products = _products(bought).select("url")
    return homes.unionByName(order_pages).unionByName(products)


# --- fetches ------------------------------------------------------------------------------


def order_url() -> Column:
    return F.concat(_shop("o_custkey"), F.lit("orders/"), F.col("o_orderkey").cast("string"))


def fetch_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as URLs, their lines as attempts, the flags of a line as what happened."""
    lines = (
        table(spark, folder, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(
            F.max("l_returnflag").alias("flag"),
            F.max("l_linestatus").alias("line_status"),
            F.max(F.round(F.col("l_tax") * 100).cast("int")).alias("tax"),
            F.max(F.col("l_quantity").cast("int")).alias("quantity"),
        )
    )
    rows = lines.join(
        table(spark, folder, "orders").select("o_orderkey", "o_custkey"),
        F.col("l_orderkey") == F.col("o_orderkey"),
    ).withColumn("url", order_url())
    answered = "flag <> 'R'"
    return rows.select(
        "url",
        F.col("l_linenumber").alias("attempt"),
        F.expr(
            f"case when {answered} then case when flag = 'N' then"
            " case line_status when 'F' then 503 else 500 end"
            " when line_status = 'F' and tax > 5 then 404 else 200 end end"
        ).alias("status"),
        F.expr(
            f"case when {answered} then case when tax = 8 then 'application/pdf'"
            " when tax = 7 then '' when quantity < 10 then 'application/xhtml+xml'"
            " else 'text/html; charset=utf-8' end end"
        ).alias("content_type"),
        F.expr("cast(case when quantity >= 49 then 6000000 else quantity * 1000 end as bigint)")
        .alias("body_bytes"),
        F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("body"),
        F.expr("case when quantity between 40 and 45 then concat(url, '/moved') else url end")
        .alias("final_url"),
        F.expr(
            "case when flag = 'R' then case when line_status = 'F' then 'ReadTimeout'"
            " when tax <= 4 then 'ConnectionError' else 'InvalidURL' end end"
        ).alias("exception"),
        F.expr("case when flag = 'R' then concat('line ', l_linenumber) end").alias("message"),
    )


def robots_files(spark: SparkSession, folder: str) -> DataFrame:
    """One robots.txt per customer's shop, in a style that depends on the segment."""
    body = F.expr(
        "case c_mktsegment"
        " when 'BUILDING' then 'User-agent: *\\nDisallow: /orders/1\\nAllow: /orders\\n'"
        " when 'AUTOMOBILE' then concat('User-agent: *\\nDisallow: /\\n\\n# ours\\n"
        "User-agent: otherbot\\nuser-agent: SiteloomBot # us\\nAllow: /orders/2\\n"
        "Request-rate: 1/5\\nDisallow: /orders/', c_nationkey % 10, '\\n')"
        " when 'HOUSEHOLD' then"
        " 'Sitemap: /s.xml\\nUser-agent: otherbot\\nDisallow: /\\nUser-agent: *\\nDisallow:\\n'"
        " when 'FURNITURE' then"
        " 'Disallow: /\\nUser-agent: *\\n\\nDisallow: /orders/1\\n\\nUser-agent: *\\n"
        "Disallow: /%6Frders/3\\n'"
        " else 'User-agent: *\\nDisallow: /\\n' end"
    )
    return table(spark, folder, "customer").select(
        F.concat(F.lit("https://shop-"), F.col("c_custkey").cast("string"), F.lit(".test")).alias(
            "host_key"
        ),
        F.when(F.col("c_mktsegment") == "MACHINERY", 404).otherwise(200).alias("status"),
        body.alias("body"),
    )


def request_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as requests: the user is the host, the time is when it could start."""
    return table(spark, folder, "events").select(
        "event_id",
        F.concat(F.lit("user-"), F.col("user_id").cast("string"), F.lit(".test")).alias("netloc"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ready_ms"),
    )


def outcome_log(events: DataFrame) -> DataFrame:
    """Events as finished fetches, for health figures."""
    kind = F.col("event_type")
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        (kind != "error").alias("fetched_ok"),
        F.when(kind == "click", "dynamic").otherwise("static").alias("rendered_with"),
        (kind == "purchase").alias("is_third_party"),
    )


# --- chains ---------------------------------------------------------------------------------


def order_trail(spark: SparkSession, folder: str) -> DataFrame:
    """Order pages of a shop that each lead on to the next one: ``site, url, discovered_from``. The
    first is found on the start page, on a page nobody has, or on the last order, by customer."""
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey")
    ranked = running_rank(
        orders, ["o_custkey"], [F.col("o_orderkey")], F.floor(F.col("o_orderkey") / 65536)
    )
    before = ranked.select(
        "o_custkey", F.col("o_orderkey").alias("before"), (F.col("running_rank") + 1).alias("running_rank")
    )
    last = orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("last"))
    site, kind = _shop("o_custkey"), F.col("o_custkey") % 3

    def at(key: str) -> Column:
        return F.concat(site, F.lit("orders/"), F.col(key).cast("string"))

    trail = ranked.join(before, ["o_custkey", "running_rank"], "left").join(last, "o_custkey").select(
        site.alias("site"),
        at("o_orderkey").alias("url"),
        F.when(F.col("before").isNotNull(), at("before"))
        .when(kind == 0, site)
        .when(kind == 1, F.concat(site, F.lit("old")))
        .otherwise(at("last"))
        .alias("discovered_from"),
    )
    starts = shop_sites(spark, folder).select("site", F.col("start_url").alias("url"))
    return trail.unionByName(starts.withColumn("discovered_from", F.lit(None).cast("string")))


def redirect_log(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of orders as requests: each is sent on to the next line of its order, the last one answers or,
    in orders under way, sends back to the first. Some are refused at the first attempt."""
    lines = (
        table(spark, folder, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(
            F.max("l_returnflag").alias("flag"),
            F.max(F.round(F.col("l_tax") * 100).cast("int")).alias("tax"),
            F.max(F.col("l_quantity").cast("int")).alias("quantity"),
        )
    )
    last = lines.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("last"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    rows = (
        lines.join(last, "l_orderkey")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .withColumn("url", F.concat(order_url(), F.lit("/"), F.col("l_linenumber").cast("string")))
        .withColumn("attempt", F.explode(F.expr("case when tax = 8 then array(1, 2) else array(1) end")))
        .withColumn("refused", F.expr("tax = 8 and attempt = 1"))
    )
    return rows.select(
        "url", "attempt",
        F.expr("case when refused then 503 when l_linenumber < last then 301 when o_orderstatus = 'P' then 302"
               " when flag = 'R' then 404 else 200 end").alias("status"),
        F.expr("case when tax = 7 then 'application/pdf' else 'text/html' end").alias("content_type"),
        F.lit(1000).cast("bigint").alias("body_bytes"),
        F.lit(None).cast("string").alias("exception"),
        F.lit(None).cast("string").alias("message"),
        F.col("quantity").cast("bigint").alias("elapsed_ms"),
        F.expr("case when refused then null when l_linenumber < last then concat('./', l_linenumber + 1, '#moved')"
               " when o_orderstatus = 'P' then '1?utm_source=loop' end").alias("location"),
    )

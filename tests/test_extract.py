"""Field and item rules on small pages, one per rule."""

import time

import pytest
from pyspark.sql import functions as F

from siteloom import constants as K
from siteloom.functions import page as P
from siteloom.operators.extract import choose_body, extract_pages, page_fields, parse_chosen, parse_pages
from siteloom.operators.links import page_links
from siteloom.sources.html import dom_nodes, outlines


def cards(*bodies, tag="div"):
    return "<body><main>" + "".join(f'<{tag} class="c">{b}</{tag}>' for b in bodies) + "</main></body>"


LONG = "Word " * 60
# name: (url, html)
PAGES = {
    "og": (
        "https://saw.test/",
        '<head><title>Saw | Home</title><meta property="og:site_name" content="  Saw \n Works ">'
        '<meta name="description" content="We make saws."></head><body><h1>Built to last</h1></body>',
    ),
    "og_empty": (
        "https://saw.test/",
        '<meta property="og:site_name" content=""><meta name="application-name" content="Saw App">',
    ),
    "og_blank": ("https://saw.test/", '<meta property="og:site_name" content="  "><title>Saw</title>'),
    "logo_word": (
        "https://saw.test/",
        '<title>Saw Works - Home</title><header><img alt="Saw logo"><img alt="Second"></header>',
    ),
    "logo_alt": (
        "https://saw.test/",
        '<title>T</title><a class="navbar-brand big"><span><img alt="Saw Mill"></span></a>',
    ),
    "generic_title": ("https://saw.test/", "<title>Loading...</title><h1>Saw <b>Inc</b> AG</h1>"),
    "longest_part": ("https://saw.test/", "<title>Home | Saws: E-commerce – About us</title>"),
    "domain_name": ("https://www.brightworks.test/", "<body>No title at all.</body>"),
    "og_description": (
        "https://saw.test/",
        '<meta name="description"><meta property="og:description" content="From og">',
    ),
    "emails": (
        "https://saw.test/contact",
        "<body>boss@saw.io or icon@site.png, you@saw.io, x@example.com, Zed@saw.io"
        "<!-- hidden@saw.io --><script>var a='in@script.io'</script></body>",
    ),
    "phones": (
        "https://saw.test/contact",
        '<body><p>Call +91 422 2345678 now, 12-34</p><a href="TEL:%2B49%20(30)%201234567"><svg/></a>'
        '<a href="tel:12"></a><noscript><a href="tel:+4988888888"></a></noscript></body>',
    ),
    "ranges": ("https://saw.test/", "<p>Size: 10 10-99 100-499 500+ people</p>"),
    "social": (
        "https://www.github.com/",
        '<a href="https://github.com/features">a</a><a href="//www.linkedin.com/co/saw">b</a>'
        '<a href="https://in.linkedin.com/x">c</a><a href="https://x.com/saw">d</a>'
        '<a href="https://twitter.com/saw">e</a><a href="/linkedin.com">f</a>',
    ),
    "social_other": ("https://saw.test/", '<a href="https://github.com/saw">Follow</a>'),
    "addresses": (
        "https://saw.test/about",
        '<body><div id="head-office">1 Long Street, Town</div><address>Short</address>'
        '<p class="my-location">2 Long Street, Town</p><p id="location">3 Long Street, Town</p>'
        '<div itemtype="http://schema.org/PostalAddress">4 Long Street</div>'
        '<i class="office">tiny</i><p class="address">2 Long Street, Town</p></body>',
    ),
    "offices": (
        "https://saw.test/contact",
        "<div>Registered Office: Plot 12, Hill Road</div><div>Branch office <b>5th Cross</b> Town</div>"
        "<div>Registered office address 7</div><section><div>Registered office address 7</div></section>",
    ),
    "thin": ("https://saw.test/", "<p>short</p>"),
    "thick": ("https://saw.test/", f"<p>{LONG}</p>"),
    "headings": (
        "https://saw.test/x",
        "<title>Saw Works</title><nav><h2>Support desk</h2></nav><main><h2>Circular Saws</h2>"
        "<h3>About Us</h3><h4>GST</h4><h2>Kingston Saws</h2><h2>Explore by trade</h2><h2>Saw works</h2>"
        "<ul><li><a>Jig Saws</a></li><li>No link</li><li><a>circular saws</a></li></ul>"
        "<div><li><a>Not in a list</a></li></div></main><div class='unavailable'><h2>Lost</h2></div>"
        "<footer><h2>Careers</h2></footer>",
    ),
    "cards": (
        "https://saw.test/products",
        cards(
            "<h3>Water Saw</h3><span>GST Verified</span><a>Ask for Quote</a>",
            "<h3>Get Best Price</h3><a>Call now</a><a>Band Saw</a>",
            "Plain <i>Saw</i>", "<h3>water saw</h3>", "<h3>ALFA SAW TRADING HOUSE</h3>",
            "<h3>Saw Pvt Ltd</h3>", "<h3>70% less dust</h3>", "<h3>3M 3M</h3>", "<h3>Pune, Town</h3>",
            "<h3>Read how one mill cut all of its saw times by more than half.</h3>",
            "<h3>Stay sharp always</h3>", "<h3>First name *</h3>", "<h3>4.5/5</h3>", "<h3>Jan 2024</h3>",
            "<h3>Saws & Blades this is Saws & Blades text</h3>", "<h3>1,234</h3>", "x",
        ),
    ),
    "two_cards": ("https://saw.test/products", cards("<h3>A Saw</h3>", "<h3>B Saw</h3>")),
    "class_order": (
        "https://saw.test/services",
        '<p class="a b">Tile One</p><p class="b a">Tile Two</p><p class="a  b">Tile Three</p>',
    ),
    "taxonomy": (
        "https://saw.test/industries",
        '<div><a href="/industries?filter=t">Textiles</a><a href="/list?tag=c">Chemicals</a>'
        '<a href="/business/x">Evening</a></div><nav><a href="/categories/z">Hidden</a></nav>',
    ),
    "industry_suffix": (
        "https://saw.test/industries",
        cards("<h3>Car Industry</h3>", "<h3>Steel Industries</h3>", "<h3>Acme LLP</h3>"),
    ),
    "industry_elsewhere": (
        "https://saw.test/products",
        cards("<h3>Car Industry</h3>", "<h3>Steel Saw</h3>", "<h3>Acme LLP</h3>"),
    ),
    "url_name": ("https://saw.test/solutions/cold-cutting", "<h2>Old heading</h2>"),
    "url_name_known": (
        "https://saw.test/solutions/cold-cutting",
        cards("<h3>Hot Cutting</h3>", "<h3>cold cutting</h3>", "<h3>Wet Cutting</h3>"),
    ),
    "form": (
        "https://saw.test/products",
        cards("<h3>One Saw</h3>", "<h3>Two Saw</h3>", "<h3>Red Saw</h3>")
        + "<form><label>A *</label><label>B b</label><select><option>Peru<option>Chad<option>Mali</select></form>",
    ),
    "no_listing": ("https://saw.test/products", "<h1>About saws</h1><p>A family firm.</p>"),
    "nested_groups": (
        "https://saw.test/products",
        "<div><ul><li><b>Rip Saw</b></li><li><b>Bow Saw</b></li><li><b>Pit Saw</b></li></ul></div>"
        "<div><h2>Last group</h2></div><div><h2>Other group</h2></div>",
    ),
    "broken": ("https://saw.test/", "<html><body><h1>Broken<div><p>Unclosed tags here"),
    "third_party": ("https://saw.test/business/other-mill-12", "<title>Other Mill</title>"),
    "empty": ("https://saw.test/empty", ""),
}


@pytest.fixture(scope="module")
def fields(spark):
    rows = [(i, name, url, html) for i, (name, (url, html)) in enumerate(PAGES.items())]
    pages = spark.createDataFrame(rows, "page_id long, case string, url string, html string")
    return {r.case: r for r in extract_pages(pages).collect()}


@pytest.mark.parametrize(
    "case, name",
    [
        ("og", "Saw Works"), ("og_empty", "Saw App"), ("og_blank", None), ("logo_word", "Saw Works"),
        ("logo_alt", "Saw Mill"), ("generic_title", "Saw Inc AG"), ("longest_part", "commerce"),
        ("domain_name", "Brightworks"),
    ],
)
def test_company_name(fields, case, name):
    assert fields[case].company_name_guess == name


def test_description(fields):
    assert fields["og"].meta_description == "We make saws."
    assert fields["og_description"].meta_description == "From og"
    assert fields["thin"].meta_description is None


def test_contacts(fields):
    # Read off the raw body, so comments and scripts count.
    assert fields["emails"].emails == ["Zed@saw.io", "boss@saw.io", "hidden@saw.io", "in@script.io"]
    assert fields["phones"].phones == ["+49 (30) 1234567", "+91 422 2345678"]
    assert fields["ranges"].phones == []


def test_social_links(fields):
    found = {s.platform: s.href for s in fields["social"].social_links}
    assert found == {"linkedin": "//www.linkedin.com/co/saw", "twitter": "https://x.com/saw"}
    assert [s.href for s in fields["social_other"].social_links] == ["https://github.com/saw"]


def test_addresses(fields):
    assert fields["addresses"].address_candidates == [
        "Short", "1 Long Street, Town", "2 Long Street, Town", "4 Long Street",
    ]
    offices = fields["offices"]
    assert offices.headquarters_candidates == [
        "Registered Office: Plot 12, Hill Road", "Registered office address 7",
    ]
    assert offices.other_location_candidates == [
        "Branch office 5th Cross Town", "Registered office address 7",
    ]


def test_office_stems_cover_all_keywords():
    for keyword in K.HQ_OFFICE_KEYWORDS + K.OTHER_OFFICE_KEYWORDS:
        assert any(stem in keyword for stem in P.OFFICE_STEMS)


def test_thin(fields):
    assert fields["thin"].is_thin_content and not fields["thick"].is_thin_content
    assert fields["empty"].is_thin_content and not fields["empty"].has_body


@pytest.mark.parametrize(
    "case, items",
    [
        ("headings", ["Circular Saws", "Jig Saws"]),
        ("cards", ["Water Saw", "Band Saw", "Plain Saw"]),
        ("two_cards", ["A Saw", "B Saw"]),
        ("class_order", ["Tile One", "Tile Two", "Tile Three"]),
        ("taxonomy", ["Textiles", "Chemicals", "Evening"]),
        ("industry_suffix", ["Car Industry", "Steel Industries"]),
        ("industry_elsewhere", ["Steel Saw"]),
        ("url_name", ["Cold Cutting"]),
        ("url_name_known", ["Hot Cutting", "cold cutting", "Wet Cutting"]),
        ("form", ["One Saw", "Two Saw", "Red Saw"]),
        ("no_listing", []),
        ("nested_groups", ["Rip Saw Bow Saw Pit Saw", "Last group", "Other group",
                           "Rip Saw", "Bow Saw", "Pit Saw"]),
    ],
)
def test_items(fields, case, items):
    assert fields[case].heading_list_items == items


def test_page_types(fields):
    assert fields["third_party"].page_type == "third_party_listing"
    assert fields["third_party"].is_third_party
    assert fields["headings"].page_type == "projects"  # "work" in its title
    assert fields["cards"].page_type == "products"


def test_broken_markup(fields):
    assert fields["broken"].h1 == "Broken Unclosed tags here"


def test_start_page_is_home_whatever_its_path(spark):
    rows = [(1, "https://saw.test/en/index", "<title>Our products</title>", 0),
            (2, "https://saw.test/en/index", "<title>Our products</title>", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, depth int")
    got = {r.page_id: r.page_type for r in extract_pages(pages).collect()}
    assert got == {1: "home", 2: "products"}


def test_outline(spark):
    html = (
        "<p>one<b>two<p>three<br>four</b></i><ul><li>a<li>b</ul>"
        "<table><tr><td>x<td>y<tr><td>z</table><script>var s = '<p>';</script><!-- note -->"
    )
    page = outlines(spark.createDataFrame([(1, html)], "page_id long, html string"))
    nodes = dom_nodes(page).orderBy("node_id").collect()
    tags = [n.tag for n in nodes]
    assert tags == ["body", "p", "b", "p", "br", "ul", "li", "li", "table", "tr", "td", "td", "tr",
                    "td", "script"]
    by_id = {n.node_id: n for n in nodes}
    assert [by_id[n.parent].tag for n in nodes if n.tag in ("li", "tr")] == ["ul", "ul", "table", "table"]
    texts = page.select(F.explode("texts").alias("t")).select("t.s", "t.kind").collect()
    assert [t.s for t in texts if t.kind == "text"] == ["one", "two", "three", "four", "a", "b", "x", "y", "z"]
    assert [t.kind for t in texts][-2:] == ["raw", "comment"]


def test_links_keep_order_and_duplicates(spark):
    html = (
        '<a href="/a">Contact<b> Us</b></a><a name="x">no</a><noscript><a href="/a">again</a></noscript>'
        '<nav><a href="?q=1#f">  spaced  text </a></nav><a href="">empty</a><a href="mailto:x@y.z">m</a>'
    )
    df = spark.createDataFrame([(7, "https://saw.test/d/p", html)], "page_id long, url string, html string")
    got = page_links(outlines(df)).orderBy("ord").collect()
    assert [(r.ord, r.href, r.anchor, r.canonical_url, r.in_script, r.in_chrome) for r in got] == [
        (0, "/a", "ContactUs", "https://saw.test/a", False, False),
        (1, "/a", "again", "https://saw.test/a", True, False),
        (2, "?q=1#f", "spaced  text", "https://saw.test/d/p?q=1", False, True),
        (3, "", "empty", None, False, False),
        (4, "mailto:x@y.z", "m", None, False, False),
    ]


def test_links_resolve_against_the_redirect_target(spark):
    df = spark.createDataFrame(
        [(1, "https://saw.test/a/b", "https://saw.test/c/d", '<a href="e">x</a>')],
        "page_id long, url string, final_url string, html string",
    )
    assert page_links(outlines(df)).first().canonical_url == "https://saw.test/c/e"


def test_shells_are_replaced_by_rendered_bodies(spark):
    shell = '<title>Loading</title><body><div id="root">Loading...</div><script>go()</script></body>'
    rows = [
        (1, "u1", shell), (2, "u2", shell), (3, "u3", f"<div id='root'>{LONG}</div>"), (4, "u4", ""),
        (5, "u5", "<p>Nearly nothing</p>"), (6, "u6", f"<p>{'a b' * 30}</p>"), (7, "u7", shell),
    ]
    static = spark.createDataFrame(rows, "page_id long, url string, html string")
    live = "<h1>Live Mill</h1>"
    rendered = spark.createDataFrame(
        [("u1", True, live), ("u2", False, live), ("u3", True, live), ("u4", True, live),
         ("u5", True, live), ("u6", True, live), ("u7", True, "")],
        "url string, ok boolean, html string",
    )
    got = {r.page_id: r for r in choose_body(static, rendered).collect()}
    assert {i for i, r in got.items() if r.rendered_with == "dynamic"} == {1, 5}
    assert got[1].html == live and got[2].html == shell and len(got) == 7


def test_one_rendering_per_page(spark):
    """Of several renderings the latest usable one counts; pages stay single."""
    shell = '<div id="root"></div>'
    static = spark.createDataFrame(
        [(1, "u1", shell), (2, "u2", shell), (3, "u3", f"<h1>Plain</h1><p>{LONG}</p>"), (4, "u1", shell)],
        "page_id long, url string, html string",
    )
    rendered = spark.createDataFrame(
        [("u1", True, "<h1>Old</h1>", 1), ("u1", True, "<h1>New</h1>", 2), ("u1", True, "", 3), ("u1", False, "x", 4),
         ("u1", True, "<h1>New</h1>", 2), ("u3", True, "<h1>No shell</h1>", 9), ("u9", True, "<h1>No page</h1>", 1)],
        "url string, ok boolean, html string, at int",
    )
    want = [(1, "dynamic", "New"), (2, "static", None), (3, "static", "Plain"), (4, "dynamic", "New")]
    bodies = extract_pages(choose_body(static, rendered, "at"))
    assert sorted((r.page_id, r.rendered_with, r.h1) for r in bodies.collect()) == want
    parsed = page_fields(parse_chosen(static, rendered, "at"))
    assert sorted((r.page_id, r.rendered_with, r.h1) for r in parsed.collect()) == want
    alone = page_fields(parse_chosen(static, None))
    assert {r.rendered_with for r in alone.collect()} == {"static"} and alone.count() == 4
    unnamed = choose_body(static, rendered).filter("page_id = 1").first()
    assert unnamed.html == "<h1>Old</h1>"


def test_shell_needs_little_text(spark):
    rows = [(1, "<div id='app'>x</div>"), (2, f"<p>{LONG}</p>"), (3, ""), (4, "<p>" + "x" * 60 + "</p>")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("url", F.lit("u"))
    got = parse_pages(df).select("page_id", F.expr(P.is_js_shell()).alias("shell")).collect()
    assert {r.page_id: r.shell for r in got} == {1: True, 2: False, 3: False, 4: False}


def test_unclosed_tags_are_read_once(spark):
    started = time.perf_counter()
    html = "<title>T</title><p>x</p>" + "<a href=" * 200_000
    rows = spark.createDataFrame([(1, "https://a.test/", html)], "page_id long, url string, html string")
    assert extract_pages(rows).select("title").first().title == "T"
    assert time.perf_counter() - started < 60


def test_pages_of_any_size_are_read(spark):
    html = "<title>T</title>" + "<p>some words here</p>" * 300_000
    rows = spark.createDataFrame([(1, "https://a.test/", html)], "page_id long, url string, html string")
    assert len(html) > 5_000_000 and extract_pages(rows).select("title").first().title == "T"


def test_tags_below_tags(spark):
    html = "<div><p>a</p><div><p>b</p><p>c</p></div></div><p>d</p><div></div><section><div><div><p>e</p></div></div></section>"
    df = spark.createDataFrame([(1, "u", html), (2, "u", ""), (3, "u", None)], "page_id long, url string, html string")
    pairs = [("div", "p"), ("div", "div"), ("section", "p"), ("p", "div"), ("body", "p"), ("nav", "p")]
    got = outlines(df).select("page_id", *[F.expr(P.count_below(*p)) for p in pairs]).collect()
    assert sorted(map(tuple, got)) == [(1, 7, 2, 1, 0, 5, 0), (2, 0, 0, 0, 0, 0, 0), (3, 0, 0, 0, 0, 0, 0)]

"""Fields read by patterns against the tree, on odd and on random pages."""

import html
import random
import time

import pytest
from pyspark.sql import functions as F

from siteloom.functions import markup as M
from siteloom.functions import page as P
from siteloom.operators import links
from siteloom.plans.catalog import QUERIES
from siteloom.sources.html import outlines

ODD = [
    "<p>one<b>two<p>three<br>four</b></i><ul><li>a<li>b</ul><script>var s = '<p>';</script><!-- note -->",
    "<title>a &amp b &copy2; &#128; &#x41; &notit; &nope; &#0; &#xD800; &#55555555555; &</title><h1>x<br>y</h1>",
    "a<!--x-->b <!-- open", "x <script> y < z", "<title> </title>t", "<h1>A <p>B</h1>", "no tags", "", "<", "a < b > c", None,
    "<a title='href=1' href = x y>t</a>", "<a href>e</a><a HREF='a&amp;b'>q<b> w</b></a><a href=z/>p</a>",
    "tail <a href='x", "x <?php echo", "<p>t</p> <!doctype", "<noscript>n <a href=1>k</a></noscript>v<title>no</title>",
    "<div><h1>h</div>t", "<title>x<!-- c -->y</title>", "<style>a{}</style><template><p>q</p></template>z",
    "&lt;b&gt; &nbsp;&hellip;&amp;amp;", "<a href=1>x<a href=2>y</a> z", "<table><tr><td><a href=1>x<td>y</table>",
    "<SCRIPT>if (a<b) {}</Script ><H1 Class=x>Up</H1>", "<h1><b>one</b> <i>two</i></h1><h1>no</h1>", "<abbr>x</abbr><article>y</article>",
    "<a href='  /a b '> <img alt=x> t </a>", "<h1 title='a>b'>x</h1>", "<a name=n>no</a><a href='#'>yes</a>", "<title>one</title><title>two</title>",
    "<a href='x'/>after<a href=/>root</a><a href=y/ >z</a>", "<a class=navbar-brand /><img alt=no><header/><img alt=no>",
]


def random_page(rng):
    words = ["a", "Mill &amp; Co", "x &lt; y", " two  words ", "\n", "é", "&nbsp;", "1 < 2", "&#8364;", ""]

    def part(depth):
        kind = rng.choice(["text", "text", "tag", "void", "comment", "script", "link", "hidden"])
        if kind == "text" or depth > 4:
            return rng.choice(words)
        inner = "".join(part(depth + 1) for _ in range(rng.randrange(4)))
        if kind == "tag":
            tag = rng.choice(["div", "span", "b", "section", "em"])
            return f"<{tag} class=\"c > d\">{inner}</{tag}>"
        if kind == "link":
            before = rng.choice(["", 'title="href=no" '])
            value = rng.choice(['="/x?a=1&amp;b=2"', "='y'", "=z", ""])
            return f"<a {before}href{value}>{rng.choice(words)}<b>t</b></a>"
        return {
            "void": "<br/>", "comment": "<!-- <a href=c>c</a> -->", "script": "<script>var a = '<a href=s>';</script>",
            "hidden": "<noscript><a href=\"/n\">n</a></noscript>",
        }[kind]

    head = f"<title>{rng.choice(words)}{rng.choice(['', '<!-- c -->'])}T</title>" if rng.random() < 0.8 else ""
    top = f"<h1 id='q'>{rng.choice(words)}<b>H</b>{rng.choice(words)}</h1>" if rng.random() < 0.8 else ""
    return f"<!DOCTYPE html><html><head>{head}</head><body>{part(0)}{top}{''.join(part(0) for _ in range(6))}</body></html>"


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(21)
    bodies = ODD + [random_page(rng) for _ in range(400)]
    rows = [(i, "https://saw.test/d/", b) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)


def test_texts(pages):
    body = F.col("body")
    scanned = pages.withColumn("body", M.without_hidden(F.col("html"))).select(
        "page_id", M.title(body).alias("title"), M.h1(body).alias("h1"), M.visible_text(body).alias("visible")
    )
    tree = outlines(pages).select("page_id", *[F.expr(e).alias(n) for n, e in
                                               (("title", P.title()), ("h1", P.h1()), ("visible", P.visible_text()))])
    got, want = ({r.page_id: tuple(r) for r in df.collect()} for df in (scanned, tree))
    bodies = {r.page_id: r.html for r in pages.collect()}
    assert {i: (bodies[i], got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_links(pages):
    columns = ["page_id", "ord", "href", "anchor", "canonical_url"]
    got = links.scanned_links(pages).select(columns).collect()
    want = links.page_links(outlines(pages)).select(columns).collect()
    assert len(want) > 300 and sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)


NAMES = [
    '<meta property="og:site_name" content=" A &amp; B ">', '<meta property=og:site_name content="">', "<meta content=c name='application-name'>",
    "<meta name=application-name>", "<img alt='The logo'>", "<img alt='My Logo'>", "<img class='big logo' alt='L'>", "<img class=logos alt=M>",
    "<a class='x navbar-brand' href=/><img alt=N></a>", "<a class=navbar-brand>t</a><img alt=O>", "<header><p><img alt=P></p></header>",
    "<header></header><img alt=Q>", "<header><img></header>", "<title>Home</title>", "<title>One - Longer one | Home</title>", "<h1>H1</h1>",
    "<noscript><img class=logo alt=R></noscript>", "<a class=navbar-brand><a href=1><img alt=S></a>", "<img class=logo>", "<meta property='og:site_name' content='  '>",
]


def test_names(spark):
    rng = random.Random(23)
    bodies = NAMES + ["".join(rng.sample(NAMES, 3)) for _ in range(250)] + ODD
    rows = [(i, "https://www.saw-mill.test/d/", b) for i, b in enumerate(bodies)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    body = F.col("body")
    told = pages.withColumn("body", M.without_hidden(F.col("html"))).select(
        "page_id", M.title(body).alias("title"), M.h1(body).alias("h1"), M.meta(body, "property", "og:site_name").alias("g"),
        M.meta(body, "name", "application-name").alias("a"), M.logo_name(body).alias("l"), F.lit("Saw").alias("d"),
    )
    got = told.select("page_id", F.expr(P.company_name("title", "h1", "d", "g", "a", "l")).alias("name"))
    tree = outlines(pages).select("page_id", "elems", "texts", F.expr(P.title()).alias("title"), F.expr(P.h1()).alias("h1"), F.lit("Saw").alias("d"))
    want = tree.select("page_id", F.expr(P.company_name("title", "h1", "d")).alias("name"))
    a, b = ({r.page_id: r["name"] for r in df.collect()} for df in (got, want))
    assert {i: (bodies[i], a[i], b[i]) for i in b if a[i] != b[i]} == {}


def test_character_references(spark):
    rng = random.Random(22)
    names = list(html.entities.html5)
    texts = ["&" + n for n in rng.sample(names, 400)] + ["&" + n.rstrip(";") + "zz" for n in rng.sample(names, 300)]
    texts += [f"&#{n}{e}" for n in [*range(0, 180), 0xD800, 0xFDD0, 0xFFFE, 0xFFFF, 0x1F600, 0x10FFFF, 0x110000, 10**12] for e in ("", ";")]
    texts += [f"&#x{n:X};" for n in (0, 0x80, 0x1F600, 0x1FFFE)] + ["&", "&&", "a&b;c", "&#;", "&#x;", "&amp;lt;", None, "&ampamp;"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", M.unescaped(F.col("t")).alias("u")).collect():
        assert r.u == (None if r.t is None else html.unescape(r.t)), r.t


@pytest.mark.parametrize("piece", ["<a href=", "<a href='x", "<!--", "<script>", "<h1", "&amp", "<a href=x>", "<div><h1>", "\"'<a "])
def test_long_broken_pages_are_read_once(spark, piece):
    started = time.perf_counter()
    body = "<title>T</title><p>x</p>" + piece * 100_000
    df = spark.createDataFrame([(1, "https://a.test/", body), (2, "https://a.test/", body + ">")], "page_id long, url string, html string")
    told = df.withColumn("body", M.without_hidden(F.col("html")))
    assert [r[0] for r in told.select(M.title(F.col("body")), M.h1(F.col("body")), M.visible_text(F.col("body"))).collect()] == ["T", "T"]
    links.scanned_links(df).count()
    assert time.perf_counter() - started < 60


@pytest.mark.parametrize("name", ["page_titles", "page_types", "page_texts", "link_inventory", "link_graph", "orphan_links"])
def test_no_python_step(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Python" not in plan

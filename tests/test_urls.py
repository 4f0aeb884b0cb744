import random

import pytest
from pyspark.sql import functions as F

from siteloom import constants as K
from siteloom.functions import classify as C
from siteloom.functions import urls as U
from siteloom.operators.links import with_canonical_url

CANONICAL = [
    ("/team", "https://mill.test/", "https://mill.test/team"),
    ("https://mill.test/team#lead", None, "https://mill.test/team"),
    ("https://mill.test", None, "https://mill.test/"),
    ("https://mill.test/p?utm_source=a&UTM_Medium=b", None, "https://mill.test/p"),
    ("https://mill.test/p?kind=pumps", None, "https://mill.test/p?kind=pumps"),
    ("https://mill.test/p?b=2&a=1&a=", None, "https://mill.test/p?a=&a=1&b=2"),
    ("mailto:a@mill.test", None, None),
    ("tel:+4912345678", "https://mill.test/", None),
    ("javascript:go(0)", "https://mill.test/", None),
    ("#top", "https://mill.test/", None),
    ("ftp://mill.test/f", None, None),
    ("", "https://mill.test/", None),
    (None, "https://mill.test/", None),
    ("HTTPS://Mill.TEST/Team", None, "https://mill.test/Team"),
    ("https://m.test:443/a/../b//c/?x=", None, "https://m.test/b/c/?x="),
    ("http://m.test:80/", None, "http://m.test/"),
    ("https://m.test:80/", None, "https://m.test:80/"),
    ("https://m.test/about/", None, "https://m.test/about/"),
    ("../c", "http://m.test/a/b/d", "http://m.test/a/c"),
    ("?y=2", "http://m.test/a/b?x=1#f", "http://m.test/a/b?y=2"),
    ("", "http://m.test/a", None),
    ("//other.test/z", "http://m.test/a", "http://other.test/z"),
    ("../../../x", "http://m.test/a", "http://m.test/x"),
    ("g;v=1", "http://m.test/a/b", "http://m.test/a/g"),
    ("a|b%zz", "http://m.test/", "http://m.test/a|b%zz"),
    ("/s?q=a b+c%21~*", "http://m.test/", "http://m.test/s?q=a+b+c%21~%2A"),
    ("x y/ü", "http://m.test/", "http://m.test/x y/ü"),
    (" \t/pad\n", "http://m.test/", "http://m.test/pad"),
    ("https://m.test//a", None, "https://m.test//a"),
    ("https://m.test///a", None, "https://m.test/a"),
]


def test_canonical_url(spark):
    rows = [(i, u, b) for i, (u, b, _) in enumerate(CANONICAL)]
    df = spark.createDataFrame(rows, "i int, url string, base string")
    got = df.select(
        "i",
        F.when(F.col("base").isNull(), U.canonical_url("url"))
        .otherwise(U.canonical_url("url", "base"))
        .alias("c"),
    ).collect()
    result = {r.i: r.c for r in got}
    for i, (url, base, expected) in enumerate(CANONICAL):
        assert result[i] == expected, (url, base)


@pytest.mark.parametrize(
    "url, root, same",
    [
        ("https://www.mill.test/x", "https://mill.test/", True),
        ("https://mill.test:8080/x", "http://www.mill.test/", True),
        ("https://blog.mill.test/x", "https://mill.test/", False),
        ("https://other.test/x", "https://mill.test/", False),
    ],
)
def test_same_site(spark, url, root, same):
    row = spark.range(1).select(U.is_same_site(F.lit(url), F.lit(root)).alias("s")).first()
    assert row.s is same


def test_gates(spark):
    url = F.col("url")
    cases = {
        "https://m.test/list.pdf": (True, False, False),
        "https://m.test/logo.PNG?x=1": (True, False, False),
        "https://m.test/about": (False, False, False),
        "https://m.test/login": (False, True, False),
        "https://m.test/blog/tag/news": (False, True, False),
        "https://m.test/research": (False, True, False),
        "https://m.test/homepage/x": (False, True, False),
        "https://m.test/?q=login": (False, False, False),
        "https://m.test/business/some-mill-12345": (False, False, True),
        "https://m.test/vendor/abcdefghijklmnop": (False, False, True),
        "https://m.test/business/abcdefghijklmno": (False, False, False),
        "https://m.test/about-us": (False, False, False),
        "https://m.test/member//a-b": (False, False, True),
        "https://m.test/business/x/business/a-b": (False, False, False),
        "https://m.test/profile/": (False, False, False),
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    got = df.select(
        "url", U.has_non_html_extension(url), U.is_skip_path(url), U.is_third_party_listing(url)
    ).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == cases


def test_names_in_urls(spark):
    cases = {
        ("https://m.test/solutions/industry/health-care", "industries"): "Health Care",
        ("https://m.test/solutions/industry/health-care", "solutions"): None,
        ("https://m.test/solutions/data-move-2024", "solutions"): "Data Move",
        ("https://m.test/solution/x", "products"): None,
        ("https://m.test/industries/2024", "industries"): None,
    }
    df = spark.createDataFrame(list(cases), "url string, bucket string")
    got = df.select("url", "bucket", U.taxonomy_name(F.col("url"), F.col("bucket"))).collect()
    assert {(r[0], r[1]): r[2] for r in got} == cases
    name = spark.range(1).select(U.name_from_domain(F.lit("https://www.brightworks.test/a")))
    assert name.first()[0] == "Brightworks"


CATEGORIES = [
    ("https://m.test/", "", "home"),
    ("https://m.test", "", "home"),
    ("https://m.test/about-us", "", "about"),
    ("https://m.test/company/contact", "", "contact"),
    ("https://m.test/products/saws", "", "products"),
    ("https://m.test/xyz", "", "other"),
    ("https://m.test/p/12", "Contact Us", "contact"),
    ("https://m.test/solutions/industry/health", "", "industries"),
    ("https://m.test/solutions/industry", "", "industries"),
    ("https://m.test/solutions/data-move", "", "solutions"),
    ("https://m.test/articles/shaping-industry-2026", "", "blog_news"),
    ("https://m.test/case-studies/a", "", "projects"),
]


def test_categories(spark):
    df = spark.createDataFrame(CATEGORIES, "url string, anchor string, want string")
    got = df.select("url", "want", C.classify_url(F.col("url"), F.col("anchor")).alias("c"))
    for r in got.collect():
        assert r.c == r.want, r.url


def test_content_decides_only_for_other(spark):
    rows = [
        ("https://m.test/p/1", "About the mill", None, "other", "about"),
        ("https://m.test/p/1", None, "Our Services", "other", "services"),
        ("https://m.test/p/1", None, None, "other", "other"),
        ("https://m.test/", "Mill Solutions", "x", "home", "home"),
    ]
    df = spark.createDataFrame(rows, "url string, title string, h1 string, guess string, want string")
    cols = [F.col(c) for c in ("url", "title", "h1", "guess")]
    for r in df.select("want", C.classify_content(*cols).alias("c")).collect():
        assert r.c == r.want


PIECES = [
    "..", ".", "a", "B-c", "...", ".x", "p;v=1", "", "a:b", "%zz", "é", "x y", "a..", "\n", "//", "http://H.test", "http://h.test",
    "https://h-1.test/a/b", "https://a.b.test:443", "https://.", "?", "?a=1", "?b=2&a=1", "?a=2&a-b=1&a=1", "?utm_source=x",
    "?a=1&UTM_Source=y&b=", "?a", "?=1", "?a=1&&b=2", "?a=b=c", "?x=%41", "#f", "mailto:x", "\t", "?c=/../",
]
BASES = [
    "http://h.test/a/b/c;v=1?q=0", "https://h.test", "http://h-2.test/x/y/z", "https://h.test/a/../b/", "https://h.test/a//b",
    "http://h.test:80/a/b", "https://H.test/a", "https://h.test/a:/b#x?y", "https://h.test/a?b/c/d", None, "", "/rel",
    "https://h.test/.a/b/",
]


def test_common_urls_agree_with_the_rule(spark):
    """Random URLs: what the compiled steps give is what the whole rule gives, and common ones are not left to it."""
    chance = random.Random(3)

    def url():
        return "".join(chance.choice(PIECES) + chance.choice(["", "/"]) for _ in range(chance.randint(0, 5)))

    rows = [(url(), chance.choice(BASES)) for _ in range(6000)]
    common = ["../c", "./c?utm_source=m&b=2&a=1", "/s/#top", "../../x/./y", "https://m.test/a/../b?x="]
    rows += [(u, "http://m.test/a/b/d?x=1") for u in common]
    df = spark.createDataFrame(rows, "url string, base string")
    for base in (None, "base"):
        both = with_canonical_url(U.with_common_url(df, "url", base, "common"), "url", base)
        got = both.withColumn("rule", U.canonical_url("url", base)).collect()
        assert all(r.canonical_url == r.rule for r in got)
        assert all(r.common is None or r.common == r.rule for r in got)
        if base:
            assert {r.url for r in got if r.common and r.base == "http://m.test/a/b/d?x=1"} == set(common)


def test_a_path_is_worked_out_once_for_all_categories(spark):
    rows = spark.createDataFrame([("https://a.test/products/x", "More")], "url string, anchor string")
    typed = rows.select(C.classify_url(F.col("url"), F.col("anchor")).alias("c"))
    plan = typed._jdf.queryExecution().analyzed().toString()
    assert typed.first().c == "products"
    # The scan and one use, not one for every category.
    assert plan.count("url#") < len(K.CATEGORY_KEYWORDS)


def test_gates_take_one_search(spark):
    """Both gates of a URL are one pattern; the same authority is told without one."""
    chance = random.Random(4)
    words = [*K.SKIP_PATH_KEYWORDS, *K.NON_HTML_EXTENSIONS, "/", "x", "?", "#", ".", "P", "\n"]
    urls = ["https://m.test/" + "".join(chance.choice(words) for _ in range(chance.randint(0, 4))) for _ in range(3000)]
    roots = ["https://m.test/a", "http://www.m.test:80/", "https://m.test?x", "m.test", "//M.test/", "https://o.test/", None]
    df = spark.createDataFrame([(u, chance.choice(roots)) for u in [*urls, "", "m.test", None]], "url string, root string")
    url, root = F.col("url"), F.col("root")
    got = df.select(
        U.is_worth_reading(url).alias("worth"), (~U.has_non_html_extension(url) & ~U.is_skip_path(url)).alias("rule"),
        U.is_same_site(url, root).alias("same"), (U.site_key_of(url) == U.site_key_of(root)).alias("key"),
    )
    assert all(r.worth == r.rule and r.same == r.key for r in got.collect())
    plan = df.select(U.is_worth_reading(url).alias("w"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 1 and plan.count("regexp_extract") == 1

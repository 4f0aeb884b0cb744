"""A small site with everything that can go wrong, from start URL to report."""

import pytest

from siteloom.plans.pipeline import report_sites
from tests.test_fetchlog import ATTEMPTS, answer, failure

R = "http://mill.test"
TEXT = "<p>" + "Sawing since ages. " * 20 + "</p>"
NAV = "".join(
    f'<a href="{h}">{t}</a>'
    for h, t in [
        ("/about", "About"), ("/products", "Products"), ("/services?utm_source=x", "Services"), ("/contact", "Contact"),
        ("/broken", "Broken"), ("/missing", "Missing"), ("/moved", "Moved"), ("/app", "App"), ("/list.pdf", "List"),
        ("/closed/1", "Closed"), ("/business/other-mill", "Other"), ("http://elsewhere.test/", "Out"), ("/blank", "Blank"),
    ]
)
BODIES = {
    "/": f'<title>Mill | Home</title><meta property="og:site_name" content="Mill Works"><nav>{NAV}</nav>{TEXT}',
    "/about": f'<meta name="description" content="All about us."><address>Mill, 4 River Road</address>{TEXT}'
    "<p>+91 80 1234 5678, hello@mill.io</p>",
    "/products": "<main><h2>Rip Saw</h2><h2>Bow Saw</h2></main>"
    + "".join(f'<nav><a href="/products?kind={i}">Kind {i}</a></nav>' for i in range(1, 9)),
    "/services": "<h2>Sharpening</h2>",
    "/contact": "<address>Mill Branch, Hill Street</address>help@mill.io",
    "/moved": '<a href="next">n</a>',
    "/app": '<title>Loading</title><div id="root">Loading...</div><script>x</script>',
    "/closed/1": "closed@mill.io",
    "/business/other-mill": '<meta property="og:site_name" content="Other Mill"><address>Other, Far Road</address>'
    '<p>boss@other.io</p><a href="/late">l</a>',
    "/blank": "",
}


@pytest.fixture(scope="module")
def result(spark):
    log = [answer(R + p, 1, 200, body=b, final=R + "/new/home" if p == "/moved" else None) for p, b in BODIES.items()]
    log += [answer(R + "/broken", i, 500) for i in (1, 2, 3)] + [answer(R + "/missing", 1, 404)]
    log += [answer(R + f"/products?kind={i}", 1, 200, body=f"<h1>Kind {i}</h1>") for i in range(1, 9)]
    log += [failure(R + "/late", i, "ReadTimeout") for i in (1, 2, 3)]
    robots = [(R, 200, "User-agent: *\nDisallow: /closed\n")]
    rendered = [(R + "/app", True, f"<title>Loading</title><h1>Mill App</h1>{TEXT}")]
    reports = report_sites(
        spark.createDataFrame([(R,), ("HTTP://Mill.test:80/",), ("mailto:nobody",), (R,)], "start_url string"),
        spark.createDataFrame(log, ATTEMPTS),
        spark.createDataFrame(robots, "host_key string, status int, body string"),
        spark.createDataFrame(rendered, "url string, ok boolean, html string"),
        max_pages=25,
        max_depth=3,
        k=25,
    )
    return reports


def test_records(result):
    got = {r.url.removeprefix(R): r for r in result.records.collect()}
    assert got["/"].page_type == "home" and got["/"].seq == 0
    assert not any("pdf" in u or "elsewhere" in u for u in got)
    assert "/services" in got and "/new/next" in got and "/products?kind=8" in got
    errors = {u: r.error for u, r in got.items() if not r.fetched_ok}
    assert errors == {
        "/broken": "http_500", "/missing": "http_404", "/closed/1": "blocked_by_robots_txt", "/blank": None,
        "/new/next": "unknown_error", "/late": "ReadTimeout: m",
    }
    assert got["/moved"].final_url == R + "/new/home" and got["/about"].final_url is None
    assert got["/app"].rendered_with == "dynamic" and got["/app"].title == "Loading"
    assert got["/business/other-mill"].page_type == "third_party_listing"
    assert got["/late"].discovered_from == R + "/business/other-mill"


def test_report(result):
    other, report, bad = sorted(result.reports.collect(), key=lambda r: (r.site is None, r.input_url))
    assert other.input_url == "HTTP://Mill.test:80/"  # one site, two spellings, a report each
    assert other.site == report.site and other.company == report.company and other.pages == report.pages
    assert bad.input_url == "mailto:nobody" and bad.run_meta.stop_reason == "invalid_start_url"
    assert bad.pages == [] and bad.company is None
    assert report.run_meta.started_at < report.run_meta.finished_at
    assert report.input_url == R and report.site == R + "/"
    assert report.run_meta.stop_reason == "queue_exhausted"
    assert report.run_meta.pages_discovered == len(report.pages) == report.run_meta.pages_fetched_ok + 6
    company = report.company
    assert company.company_name == "Mill Works" and company.description == "All about us."
    assert company.headquarters == "Mill, 4 River Road" and company.other_locations == ["Mill Branch, Hill Street"]
    assert company.emails == ["hello@mill.io", "help@mill.io"] and company.phones == ["+91 80 1234 5678"]
    assert company.products == ["Rip Saw", "Bow Saw"] and company.services == ["Sharpening"]

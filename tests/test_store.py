import bisect
import json
import random
import time
from datetime import datetime

from pyspark.sql import functions as F

from siteloom.operators import daily
from siteloom.operators.extract import extract_pages
from siteloom.operators.profile import build_profiles
from siteloom.operators.report import page_counts, nested_reports, page_records, status_rollup
from siteloom.plans.catalog import QUERIES, _scratch
from siteloom.sources import store
from siteloom.streaming import feed

TRIED = (
    "site string, seq int, url string, depth int, discovered_from string, status int, ok boolean,"
    " error string, final_url string, rendered_with string"
)
S = "https://mill.test:8080/"


def example(spark):
    pages = spark.createDataFrame(
        [
            (1, S, 0, 0, f"<title>Mühle | Home</title><p>{'Text ' * 60}</p><a href='https://x.com/m'>x</a>"),
            (2, S + "about", 1, 1, "<title>About</title><p>kurz</p>"),
            (3, S + "empty", 2, 1, ""),
            (4, S + "business/other-co", 3, 1, "<title>Other</title>"),
        ],
        "page_id long, url string, seq int, depth int, html string",
    ).withColumn("site", F.lit(S))
    extract = extract_pages(pages)
    tried = spark.createDataFrame(
        [
            (S, 0, S, 0, None, 200, True, None, S, "static"),
            (S, 1, S + "about", 1, S, 200, True, None, S + "about-us", "dynamic"),
            (S, 2, S + "empty", 1, S, 200, True, None, S + "empty", "static"),
            (S, 3, S + "business/other-co", 1, S, 200, True, None, S + "business/other-co", "static"),
            (S, 4, S + "news/x", 1, S, 404, False, "http_404", S + "news/x", "static"),
        ],
        TRIED,
    )
    records = page_records(tried, extract)
    runs = spark.createDataFrame([(S, S, "queue_exhausted")], "site string, input_url string, stop_reason string")
    at = F.lit("2024-05-01 10:00:00.25").cast("timestamp")
    runs = runs.withColumn("started_at", at).withColumn("finished_at", at)
    return records, nested_reports(records, build_profiles(extract), runs)


def test_audit_rows(spark):
    records, _ = example(spark)
    got = {r.seq: r for r in records.collect()}
    assert [got[i].extraction_result for i in range(5)] == [
        "success", "partial", "failed", "partial_static_only", "failed",
    ]
    assert got[0].final_url is None and got[1].final_url == S + "about-us"
    # Fetched, but nothing in it: failed without an error.
    assert not got[2].fetched_ok and got[2].error is None and got[2].http_status == 200
    assert got[3].page_type == "third_party_listing" and got[3].is_third_party and got[3].fetched_ok
    assert got[4].page_type == "blog_news" and got[4].error == "http_404" and got[4].title is None
    counts = page_counts(records).first()
    assert (counts.pages_discovered, counts.pages_fetched_ok, counts.pages_failed) == (5, 3, 2)
    total = status_rollup(records).filter("site is null").first()
    assert total.pages == 5 and total.failed_rate == 0.4 and total.dynamic_rate == 0.2


def test_report_json(spark):
    _, reports = example(spark)
    path = _scratch(spark, "json")
    store.write_reports(reports, path)
    line = spark.read.text(path).select("value").first().value
    report = json.loads(line)
    assert list(report) == ["input_url", "run_meta", "company", "pages"]
    assert report["run_meta"]["started_at"].startswith("2024-05-01T10:00:00.250000")
    assert report["company"]["company_name"] == "Mühle" and "Mühle" in line
    assert report["company"]["headquarters"] is None and report["pages"][0]["error"] is None
    assert report["company"]["social_links"] == {"twitter": "https://x.com/m"}
    assert len(report["pages"]) == 5 and report["pages"][3]["is_third_party"] is True
    folders = [f.rsplit("part=", 1)[1].split("/")[0] for f in spark.read.json(path).inputFiles()]
    assert len(folders) == 1 and 0 <= int(folders[0]) < store.PARTS
    back = store.read_reports(spark, path).first()
    assert back.pages[1].final_url == S + "about-us" and back.company.products == []


def test_pretty_printed_report_files_are_read(spark, tmp_path):
    _, reports = example(spark)
    one = json.loads(reports.drop("site").toJSON().first())
    (tmp_path / "a.json").write_text(json.dumps(one, indent=2, ensure_ascii=False), encoding="utf-8")
    back = store.read_reports(spark, str(tmp_path), multi_line=True)
    assert back.selectExpr("explode(pages) p").selectExpr("p.url").count() == 5


def test_merges(spark):
    _, reports = example(spark)
    path = _scratch(spark, "table")
    rows = store.page_rows(reports)
    assert "final_url" not in rows.columns and "is_third_party" not in rows.columns
    store.merge_table(path, rows, ["website", "url"])
    later = rows.filter("url not like '%about%'").withColumn("title", F.lit("new")).withColumn(
        "seen_at", F.lit("2025-01-01T00:00:00Z")
    )
    store.merge_table(path, later, ["website", "url"])
    got = {r.url: r.title for r in store.read_table(spark, path).collect()}
    assert len(got) == 5 and got[S + "about"] == "About" and got[S] == "new"
    companies = store.company_rows(reports)
    assert json.loads(companies.first().social_links) == {"twitter": "https://x.com/m"}
    stale = companies.withColumn("seen_at", F.lit("2020")).withColumn("company_name", F.lit("old"))
    assert store.upsert_companies(companies, stale).first().company_name == "Mühle"
    assert store.upsert_companies(stale, companies).first().company_name == "Mühle"


def test_feed_in_two_runs_equals_one_batch(spark):
    folder, out, state = (_scratch(spark, n) for n in ("in", "out", "state"))
    pages = spark.createDataFrame(
        [(i, f"https://m{i}.test/", f"<title>Mill {i}</title>") for i in range(6)], feed.PAGE_FEED_SCHEMA
    )
    for half in (pages.filter("page_id < 3"), pages.filter("page_id >= 3")):
        half.write.mode("append").parquet(folder)
        stream = feed.extract_feed(feed.page_feed(spark, folder)).select("page_id", "title")
        feed.run_to_end(stream, out, state)
    want = extract_pages(pages).select("page_id", "title").collect()
    assert sorted(spark.read.parquet(out).collect()) == sorted(want)


def test_profiles_follow_the_feed(spark):
    folder, extract, table, state = (_scratch(spark, n) for n in ("in", "ex", "pr", "st"))
    schema = "page_id long, site string, seq long, depth int, url string, html string"

    def add(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        feed.refresh_profiles(extract_pages(stream), extract, table, state)

    a, b = "https://a.test/", "https://b.test/"
    add((1, a, 5, 1, a + "x", "<title>First A</title>"), (2, b, 0, 0, b, "<title>B Mill</title>"))
    time.sleep(1)
    add((3, a, 0, 0, a, "<title>Real A</title>"))

    def names():
        rows = store.read_table(spark, table).filter("field = 'company_name'").collect()
        return {r.website: r.value for r in rows}

    assert names() == {a: "Real A", b: "B Mill"}
    time.sleep(1)
    add((2, b, 0, 0, b, "<p>now@b.test</p>"), (4, a, 7, 1, a + "y", "<p>x</p>"))
    # What the newer version of a page no longer says is gone.
    assert names() == {a: "Real A", b: "B"}
    mails = store.read_table(spark, table).filter("field = 'emails'").collect()
    assert [(r.website, r.value) for r in mails] == [(b, "now@b.test")]


def test_two_starts_on_one_host_share_pages(spark):
    pages = spark.createDataFrame(
        [(k, S, S, 0, 0, "<title>Home</title>") for k in (1,)] + [(2, S, S + "about", 1, 1, "<title>About</title>"),
         (3, S + "about", S + "about", 0, 0, "<title>About</title>")],
        "page_id long, site string, url string, seq int, depth int, html string",
    )
    tried = spark.createDataFrame(
        [(r.site, r.seq, r.url, r.depth, None, 200, True, None, r.url, "static") for r in pages.collect()], TRIED
    )
    got = sorted((r.site, r.url, r.page_type) for r in page_records(tried, extract_pages(pages)).collect())
    assert got == [(S, S, "home"), (S, S + "about", "about"), (S + "about", S + "about", "home")]


def test_reports_of_any_shape(spark, tmp_path):
    _, reports = example(spark)
    new = json.loads(reports.drop("site").toJSON().first())
    old = {
        "input_url": "http://old.test", "pages_failed": "3", "stop_reason": None,
        "company": {"emails": "a@old.test", "social_links": [{"platform": "github", "url": "g"}, {"url": "x"}], "products": [1, "b"], "new": {}},
        "pages": [{"url": "u", "http_status": "200", "fetched_ok": 1}, 5, None],
    }
    bare = {"input_url": "http://bare.test", "visit_meta": {"pages_failed": "many"}, "pages": None, "company": None}
    lines = [json.dumps(new), json.dumps(old), "", json.dumps(bare), '{"input_url": "cut', "[1]", "7", "{}", '{"input_url": 5}', "  "]
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "a.json").write_text("\n".join(lines), encoding="utf-8")
    rows, rejects = store.read_any_reports(spark, str(tmp_path / "l"))
    got = {r.input_url: r for r in rows.collect()}
    assert set(got) == {S, "http://old.test", "http://bare.test"}
    assert got[S] == store.read_reports(spark, str(tmp_path / "l")).filter(F.col("input_url") == S).first()
    r = got["http://old.test"]
    assert r.run_meta.pages_failed == 3 and r.company.emails == ["a@old.test"] and r.company.social_links == {"github": "g"}
    assert r.company.products == ["1", "b"] and [p.http_status for p in r.pages] == [200, None, None] and r.company.phones is None
    assert got["http://bare.test"].company is None and got["http://bare.test"].run_meta.pages_failed is None
    bad = sorted((x.record, x.reason) for x in rejects.collect())
    assert bad == [("7", "not_an_object"), ("[1]", "not_an_object"), ('{"input_url": "cut', "not_json"),
                   ('{"input_url": 5}', "no_company_and_no_pages"), ("{}", "no_input_url")]
    # A file each, printed over several lines.
    for i, one in enumerate([new, old]):
        (tmp_path / "f" / str(i)).mkdir(parents=True)
        (tmp_path / "f" / str(i) / "r.json").write_text(json.dumps(one, indent=2), encoding="utf-8")
    (tmp_path / "f" / "x.json").write_text("{\n 'no'", encoding="utf-8")
    rows, rejects = store.read_any_reports(spark, str(tmp_path / "f"), multi_line=True)
    assert {r.input_url for r in rows.collect()} == {S, "http://old.test"} and rejects.count() == 1


def test_sketches_of_days_add_up(spark):
    """Merged over any span they are within the stated errors; small spans are exact."""
    rng = random.Random(31)
    rows = [
        (f"s{rng.random() < 0.1:d}", datetime(2024, 1, 1 + rng.randrange(9), 5), f"/{int(rng.paretovariate(0.5)) % 20_000}",
         rng.random() < 0.9, int(rng.expovariate(0.01)))
        for _ in range(40_000)
    ]
    visits = spark.createDataFrame(rows, "site string, ts timestamp, url string, ok boolean, elapsed_ms int")
    days = daily.daily_sketches(visits).cache()
    assert days.count() == 18
    for low, high in ((1, 9), (2, 5), (3, 3)):
        span = F.dayofmonth("day").between(low, high)
        got = daily.span_figures(days, ["site"], [0.0, 0.5, 0.99], span).collect()
        for r in got:
            mine = [x for x in rows if x[0] == r.site and low <= x[1].day <= high]
            urls, times = {x[2] for x in mine}, sorted(x[4] for x in mine)
            assert r.visits == len(mine) and abs(r.failed_rate - sum(not x[3] for x in mine) / len(mine)) < 1e-6
            assert abs(r.n_urls - len(urls)) <= (0 if len(urls) < 4096 else daily.COUNT_ERROR * len(urls))
            for q, value in ((0.5, r.ms_50), (0.99, r.ms_99)):
                n = len(times)
                assert bisect.bisect_left(times, value) / n <= q + daily.RANK_ERROR
                assert bisect.bisect_right(times, value) / n >= q - daily.RANK_ERROR
            assert r.ms_0 == times[0]
    assert daily.span_figures(days, [], [0.5]).first().visits == 40_000
    assert daily.span_figures(days, ["site"], [0.5], F.lit(False)).count() == 0
    days.unpersist()


def test_feed_queries_read_files_and_folders(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"https://s.test/{i}", f"<title>t{i}</title>") for i in range(6)], feed.PAGE_FEED_SCHEMA)
    for kind, parts in (("folder", 3), ("file", 1)):
        folder = tmp_path / kind
        rows.repartition(parts).write.parquet(str(folder / "pages.parquet"))
        if kind == "file":
            (folder / "pages.parquet").rename(folder / "written")
            next((folder / "written").glob("part-*")).rename(folder / "pages.parquet")
            (folder / "other.parquet").write_bytes((folder / "pages.parquet").read_bytes())
        found = QUERIES["feed_extract"](spark, str(folder))
        assert sorted((r.page_id, r.title) for r in found.collect()) == [(i, f"t{i}") for i in range(6)]


def test_merges_leave_few_files(spark, tmp_path):
    """As many files as partitions, however many tasks the rows come from."""
    path = str(tmp_path / "merged")
    for at in (1, 2):
        rows = spark.range(0, 2000, 1, 40).selectExpr("concat('s', id) as website", f"{at} as seen_at")
        store.merge_table(path, rows, ["website"])
    assert len(list((tmp_path / "merged").rglob("*.parquet"))) <= store.PARTS
    assert store.read_table(spark, path).groupBy("seen_at").count().collect() == [(2, 2000)]


def test_a_batch_of_the_feed_is_extracted_once(spark):
    """Merging, the sites touched and the marks of their partitions go by the rows as they were written."""
    folder, extract, table, state = (_scratch(spark, n) for n in ("once", "once-ex", "once-pr", "once-st"))
    schema = "page_id long, site string, seq long, depth int, url string, html string"
    pages = [(i, f"https://m{i % 3}.test/", i, 1, f"https://m{i % 3}.test/p{i}", f"<title>Mill {i}</title>") for i in range(12)]
    spark.createDataFrame(pages, schema).coalesce(1).write.parquet(folder)
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def noted(html):
        read.add(1)
        return html

    stream = spark.readStream.schema(schema).parquet(folder).withColumn("html", noted.asNondeterministic()("html"))
    feed.refresh_profiles(extract_pages(stream), extract, table, state)
    assert read.value == len(pages)
    assert store.read_table(spark, table).filter("field is not null").select("website").distinct().count() == 3

import random
import urllib.robotparser

from pyspark.sql import functions as F

from siteloom.operators import fetchlog
from siteloom.operators.prefix import running_max, running_rank

ATTEMPTS = (
    "url string, attempt int, status int, content_type string, body_bytes long, body string,"
    " final_url string, exception string, message string"
)
HTML = "text/html; charset=utf-8"


def answer(url, attempt, status, ct=HTML, size=10, body="<p>", final=None):
    return (url, attempt, status, ct, size, body, final or url, None, None)


def failure(url, attempt, exception, message="m"):
    return (url, attempt, None, None, None, None, None, exception, message)


LOG = [
    answer("ok", 1, 200),
    answer("gone", 1, 404),
    answer("denied", 1, 403),
    answer("busy", 1, 500), answer("busy", 2, 503), answer("busy", 3, 500),
    answer("late", 1, 500), answer("late", 2, 200),
    answer("moved", 1, 200, final="ok"),
    answer("pdf", 1, 200, "application/pdf"),
    answer("plain404", 1, 404, "text/plain"),
    answer("untyped", 1, 200, None),
    answer("xhtml", 1, 200, "application/xhtml+xml"),
    answer("shout", 1, 200, "TEXT/HTML"),
    answer("huge", 1, 200, size=5_000_001),
    answer("limit", 1, 200, size=5_000_000),
    answer("huge500", 1, 500, size=6_000_000),
    answer("empty", 1, 200, body=""),
    failure("slow", 1, "ReadTimeout"), failure("slow", 2, "ReadTimeout"), failure("slow", 3, "ConnectionError", "refused"),
    failure("odd", 1, "InvalidURL"), answer("odd", 2, 200),
    failure("cut", 1, "ReadTimeout"), failure("cut", 2, "ReadTimeout", "second"),
]


def test_outcomes(spark):
    got = {r.url: r for r in fetchlog.retry_reduction(spark.createDataFrame(LOG, ATTEMPTS), 3, 5_000_000).collect()}
    errors = {u: r.error for u, r in got.items()}
    assert errors == {
        "ok": None, "gone": "http_404", "denied": "http_403", "busy": "http_500", "late": None, "moved": None,
        "pdf": "non_html_content_type:application/pdf", "plain404": "non_html_content_type:text/plain",
        "untyped": "non_html_content_type:unknown", "xhtml": None, "shout": "non_html_content_type:TEXT/HTML",
        "huge": "page_too_large", "limit": None, "huge500": "page_too_large", "empty": None,
        "slow": "ConnectionError: refused", "odd": "InvalidURL: m", "cut": "ReadTimeout: second",
    }
    assert got["busy"].status == 500 and got["busy"].attempts == 3
    assert got["late"].attempts == 2 and got["moved"].final_url == "ok"
    assert got["slow"].status is None and got["gone"].html is None
    assert got["empty"].ok and got["empty"].html == ""


FILES = {
    "http://a.test": "User-agent: *\nDisallow: /private\nAllow: /\n",
    "http://b.test": "User-agent: siteloombot\nDisallow: /x\n\nUser-agent: *\nDisallow: /\n",
    "http://c.test": "# nothing\n\nDisallow: /\nUser-agent: *\n\nDisallow: /y\n",
    "http://d.test": "User-agent: other\nUser-agent: *\nDisallow:\n",
    "http://e.test": "User-agent: *\nAllow: /p/ok\nDisallow: /p # end\nUser-agent: loombot\nRequest-rate: 1/3\nDisallow: /q\n",
    "http://f.test": "user-AGENT : *\r\nDISALLOW : /caf%C3%A9\r\nnonsense\r\nDisallow: *\r\n",
    "http://g.test": "User-agent: *\nDisallow: /a\n\nUser-agent: *\nDisallow: /b\n",
}
PATHS = ["", "/", "/private/1", "/x/1", "/y", "/p", "/p/ok/1", "/q", "/caf%C3%A9/1", "/a", "/b?c=d"]


def test_robots_agree_with_the_standard_parser(spark):
    files = [(h, 200, body) for h, body in FILES.items()] + [("http://z.test", 404, "User-agent: *\nDisallow: /")]
    rules = fetchlog.robots_rules(spark.createDataFrame(files, "host_key string, status int, body string"))
    urls = [(h + p,) for h, _, _ in files for p in PATHS] + [("http://unknown.test/a",)]
    got = fetchlog.robots_decisions(spark.createDataFrame(urls, "url string"), rules, "SiteloomBot/1.0").collect()
    parsers = {}
    for host, body in FILES.items():
        parsers[host] = urllib.robotparser.RobotFileParser()
        parsers[host].parse(body.splitlines())
    assert len(got) == len(urls)
    for r in got:
        host = "/".join(r.url.split("/")[:3])
        want = parsers[host].can_fetch("SiteloomBot/1.0", r.url) if host in parsers else True
        assert r.allowed is want, r.url


def test_blocked_urls_are_never_ok(spark):
    rules = fetchlog.robots_rules(
        spark.createDataFrame([("http://a.test", 200, FILES["http://a.test"])], "host_key string, status int, body string")
    )
    log = spark.createDataFrame([answer("http://a.test/private", 1, 200), answer("http://a.test/", 1, 200)], ATTEMPTS)
    got = {r.url: r for r in fetchlog.fetch_outcomes(log, rules).collect()}
    assert got["http://a.test/private"].error == "blocked_by_robots_txt"
    assert not got["http://a.test/private"].ok and got["http://a.test/private"].html is None
    assert got["http://a.test/"].ok
    assert all(r.ok for r in fetchlog.fetch_outcomes(log).collect())


def test_extraction_result(spark):
    rows = [(False, True, "static"), (True, False, "static"), (True, True, "static"), (True, True, "dynamic")]
    df = spark.createDataFrame(rows, "b boolean, t boolean, r string")
    got = df.select(fetchlog.extraction_result(F.col("b"), F.col("t"), F.col("r"))).collect()
    assert [r[0] for r in got] == ["failed", "success", "partial_static_only", "partial"]


def test_running_values_over_buckets(spark):
    rng = random.Random(3)
    # Key 0 holds most rows.
    rows = [(0 if rng.random() < 0.7 else rng.randrange(5), i, rng.randrange(1000)) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, o long, v int")
    bucket = F.floor(F.col("o") / 64)
    ranked = running_rank(df, ["k"], [F.col("o")], bucket)
    both = running_max(ranked, ["k"], [F.col("o")], F.col("v"), bucket)
    got = {(r.k, r.o): (r.running_rank, r.running_max) for r in both.collect()}
    want = {}
    for key in range(5):
        best = -1
        for n, (_, o, v) in enumerate(sorted(r for r in rows if r[0] == key)):
            best = max(best, v)
            want[key, o] = (n + 1, best)
    assert got == want


def test_ranks_after_earlier_rows(spark):
    rows = [("a", i) for i in range(300)] + [("b", i) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, o long")
    earlier = spark.createDataFrame([("a", 40), ("c", 9)], "k string, n long")
    got = running_rank(df, ["k"], [F.col("o")], F.floor(F.col("o") / 16), earlier).collect()
    assert {(r.k, r.o): r.running_rank for r in got} == {(k, o): o + 1 + 40 * (k == "a") for k, o in rows}


def test_polite_starts(spark):
    rng = random.Random(4)
    rows = [(f"h{rng.randrange(3)}", i, rng.randrange(100_000)) for i in range(400)]
    df = spark.createDataFrame(rows, "netloc string, id long, ready_ms long")
    got = fetchlog.politeness_schedule(
        df, 500, F.floor(F.col("ready_ms") / 5000), [F.col("ready_ms"), F.col("id")]
    ).collect()
    starts = {r.id: r.start_ms for r in got}
    last = {}
    for host, i, ready in sorted(rows, key=lambda r: (r[2], r[1])):
        start = max(ready, last.get(host, -10**9) + 500)
        last[host] = start
        assert starts[i] == start


def test_robots_of_many_hosts_are_not_broadcast(spark):
    files = spark.createDataFrame(
        [(f"http://h{i}", 200, "User-agent: *\nDisallow: /a\nAllow: /b\n") for i in range(50)],
        "host_key string, status int, body string",
    )
    urls = spark.createDataFrame([(f"http://h{i}/{p}",) for i in range(60) for p in "abc"], "url string")
    judged = fetchlog.robots_decisions(urls, fetchlog.robots_rules(files), "x")
    # Tables this small are broadcast wherever the planner may choose.
    assert "Broadcast" not in judged._jdf.queryExecution().executedPlan().toString()
    blocked = {r.url for r in judged.filter("not allowed").collect()}
    assert blocked == {f"http://h{i}/a" for i in range(50)}

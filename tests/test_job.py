"""The job from a folder of tables to reports and stored tables."""

from siteloom import job
from siteloom.plans.catalog import _scratch
from siteloom.sources import store
from tests.test_fetchlog import ATTEMPTS, answer

R = "http://mill.test"
SHELL = '<div id="root"></div>'


def test_folder_to_folder(spark, capsys):
    source, target = _scratch(spark, "job-in"), _scratch(spark, "job-out")
    home = f"<title>Mill</title><a href=/a>A</a><a href=/b>B</a><a href=/closed>C</a><p>{'words ' * 50}</p>"
    log = [answer(R + "/", 1, 200, body=home), answer(R + "/a", 1, 200, body=SHELL), answer(R + "/b", 1, 404),
           answer(R + "/closed", 1, 200, body="<h1>x</h1>")]
    tables = {
        "sites": spark.createDataFrame([(R,), ("HTTP://mill.test",), ("no url",)], "start_url string"),
        "attempts": spark.createDataFrame(log, ATTEMPTS),
        "robots": spark.createDataFrame([(R, 200, "User-agent: *\nDisallow: /closed")], "host_key string, status int, body string"),
        "rendered": spark.createDataFrame([(R + "/a", True, "<title>Live</title>", 1), (R + "/a", True, "<title>Later</title>", 2)],
                                          "url string, ok boolean, html string, at int"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{source}/{name}.parquet")
    job.main([source, target, "--max-pages", "10", "--pages-per-round", "5", "--latest-rendering", "at"])
    assert capsys.readouterr().out.split("\n")[:2] == ["invalid_start_url: 1", "queue_exhausted: 2"]
    reports = store.read_reports(spark, f"{target}/reports")
    assert sorted(r.input_url for r in reports.collect()) == ["HTTP://mill.test", R, "no url"]

    def pages():
        return {r.url.removeprefix(R): r for r in store.read_table(spark, f"{target}/pages").collect()}

    got = pages()
    assert got["/closed"].error == "blocked_by_robots_txt" and got["/b"].error == "http_404"
    assert got["/a"].title == "Later" and got["/a"].rendered_with == "dynamic"
    assert [r.company_name for r in store.read_table(spark, f"{target}/companies").collect()] == ["Mill"]
    # Again, with other switches: the tables are merged.
    job.main([source, target, "--max-pages", "2", "--pages-per-round", "5", "--ignore-robots", "--no-rendering"])
    assert "max_pages_reached: 2" in capsys.readouterr().out
    again = pages()
    assert len(again) == 4 and again["/a"].rendered_with == "static" and again["/b"].error == "http_404"

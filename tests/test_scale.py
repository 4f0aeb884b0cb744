"""What keeps large tables from ending in one task or in one worker's memory."""

import cProfile

import pyarrow as pa

from pyspark.sql import functions as F

from siteloom.operators import frontier
from siteloom.plans import corpus
from siteloom.plans.catalog import QUERIES, _candidates
from siteloom.sources import html, tables
from siteloom.session import BucketedTable
from siteloom.sources.tables import TASKS_PER_CORE

TABLES = {
    "region": [("r_regionkey int, r_name string", [(0, "ASIA")])],
    "nation": [("n_nationkey int, n_name string, n_regionkey int", [(0, "INDIA", 0)])],
    "supplier": [("s_suppkey long, s_name string, s_nationkey int, s_acctbal double", [(1, "S1", 0, 6000.0)])],
    "part": [("p_partkey long, p_name string, p_brand string, p_type string, p_size int", [(7, "bolt", "B", "STEEL", 3)])],
    "customer": [("c_custkey long, c_name string, c_nationkey int, c_mktsegment string, c_acctbal double",
                  [(i, f"C{i}", 0, "BUILDING", 1.0) for i in range(40)])],
    "orders": [("o_orderkey long, o_custkey long, o_orderdate date, o_totalprice double, o_orderstatus string", [])],
    "lineitem": [("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int", [(1, 7, 1, 1), (1, 7, 1, 2), (2, 7, 1, 1)])],
    "documents": [("doc_id long, text string, lang string", [(1, "a\nb", "en")])],
}


def _tables(spark, folder):
    for name, [(schema, rows)] in TABLES.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def _dealt(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("REPARTITION_BY_NUM")


def test_rows_of_costly_pages_are_dealt_without_a_setting(spark, tmp_path):
    folder = _tables(spark, tmp_path)
    spark.conf.set(tables.SPREAD, "false")
    try:
        pages = corpus.supplier_pages(spark, folder)
        assert _dealt(pages) >= 4
        assert pages.count() == 5 + 40
        assert _dealt(_candidates(spark, folder)) == 2
    finally:
        spark.conf.set(tables.SPREAD, "true")
    assert tables.deal(spark.range(9), "id").rdd.getNumPartitions() == tables.TASKS_PER_CORE * 4


def test_outlines_leave_the_worker_in_short_batches():
    pages = pa.record_batch({"page_id": list(range(3000)), "html": ["<p>a</p><p>b</p>" * 10] * 3000})
    sizes, ids = [], []
    for part in html._parse_batches(iter([pages])):
        names = part.schema.names
        sizes.append(sum(len(x) for n in ("elems", "texts") for x in part.column(names.index(n)).to_pylist()))
        ids += part.column(names.index("page_id")).to_pylist()
    assert ids == list(range(3000))
    assert max(sizes) < 21_000


def test_outlines_take_few_calls_an_element():
    """Most of the time of supplier pages is spent here, call by call."""
    page = "<div class='card x'><h3>Name &amp; more</h3><a href='/kits/1'>See  kit</a><p>Text</p></div>" * 200
    profile = cProfile.Profile()
    profile.enable()
    elems, _ = html._Outline().outline(page)
    profile.disable()
    assert len(elems) == 801  # and the body
    calls = sum(entry.callcount for entry in profile.getstats())
    assert calls < 45 * len(elems)


def test_variants_and_trees_read_a_stored_copy(spark, tmp_path):
    folder = _tables(spark, tmp_path)
    for name in ("url_variants", "discovery_tree"):
        scans = QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
        # The lines of orders are read before, into the copy.
        assert "l_partkey" not in scans


def test_shop_links_are_dealt(spark, tmp_path):
    """Products of a small table come out of many tasks, one row per URL; without a key there is no URL."""
    spark.createDataFrame([(1, 7, "F"), (2, 7, "O")], "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(
        str(tmp_path / "orders.parquet")
    )
    lines = [(1, 1, 5, 3), (2, 1, 5, 3), (2, 2, 6, 3), (1, 2, 5, None), (2, 3, 5, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(
        str(tmp_path / "lineitem.parquet")
    )
    found = corpus.shop_links(spark, str(tmp_path), ["help"])
    assert found.rdd.getNumPartitions() == TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    rows = found.filter("ord = 1").collect()
    shop = "https://shop-7.test/"
    assert sorted((r.url or "", r.href) for r in rows) == [
        ("", "/help/part-5"), (f"{shop}products/part-5?supplier=3", "/help/part-5"),
        (f"{shop}products/part-6?supplier=3", "/help/part-6"),
    ]


def test_edges_are_told_apart_in_their_buckets(spark):
    stored = BucketedTable(spark, "edges_test", ["url"])
    try:
        stored.add(spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c"), (None, "c"), (None, "c")], "url string, to string"), distinct=True)
        assert stored.read().count() == 3
    finally:
        stored.forget()


def test_a_tree_is_read_in_its_buckets(spark, monkeypatch):
    """Pages and parents are not shuffled again; what is stored was grouped where it was dealt."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    tree = BucketedTable(spark, "tree_test", ["site", "url"])
    dealt = []

    def least(rows):
        found = rows.groupBy("site", "url").agg(F.min(F.struct("depth", "discovered_from")).alias("f"))
        dealt.append(found._jdf.queryExecution().executedPlan().toString())
        return found.select("site", "url", "f.*")

    edges = [("s", "b", 2, "c"), ("s", "b", 1, "a"), ("s", "c", 1, "a"), ("s", "d", 2, "gone")]
    schema = "site string, url string, depth int, discovered_from string"
    try:
        tree.add(spark.createDataFrame(edges, schema), reduced=least)
        # A start that is there twice counts twice, and so does what it led to.
        tree.add(spark.createDataFrame([("s", "a", 0, None)] * 2, schema))
        stats = frontier.discovery_tree(tree.read())
        plan = stats._jdf.queryExecution().executedPlan().toString()
        # Children by their parent, pages by their parent, and the result.
        assert plan.count("Exchange hashpartitioning") == 3 and dealt[0].count("Exchange") == 1
        got = {r.depth: tuple(r)[2:] for r in stats.collect()}
        assert got == {0: (2, 2, 2, 0), 1: (4, 0, 0, 0), 2: (1, 0, 0, 1)}
    finally:
        tree.forget()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_product_links_rank_no_lines(spark, tmp_path):
    """Products are told apart by the keys of their lines; places among the lines of an order are not asked for."""
    folder = _tables(spark, tmp_path)
    plan = corpus.shop_links(spark, folder, ["help"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan

"""Chains against a plain walk; odd chains by hand."""

import random

from siteloom.operators import chains, fetchlog


def plain(links):
    to = {}
    for node, after, _ in links:
        if node is not None and after is not None:
            to[node] = min(to.get(node, after), after)
    cost = {n: min((c or 0) for m, a, c in links if m == n and a == to[n]) for n in to}
    out = {}
    for node in to:
        seen = [node]
        while seen[-1] in to and to[seen[-1]] not in seen:
            seen.append(to[seen[-1]])
        looped = seen[-1] in to
        end = min(seen[seen.index(to[seen[-1]]) :]) if looped else seen[-1]
        path, at = [], node
        while at != end:
            path.append(at)
            at = to[at]
        out[node] = (end, len(path), sum(cost[p] for p in path), looped, path)
    return out


def followed(spark, links):
    df = spark.createDataFrame(links, "node string, next string, cost long")
    rows = chains.follow(df, paths=True).collect()
    return {r.node: (r.end, r.hops, r.cost, r.looped, r.path) for r in rows}


def test_random_chains(spark):
    rng = random.Random(3)
    links = [(f"n{i:02}", f"n{rng.randrange(60):02}", rng.randrange(9)) for i in range(45) if i % 5]
    links += [("a", "n03", 1), ("a", "b", 2), (None, "a", 1), ("c", None, 1), ("self", "self", 4), ("to", "self", None)]
    links += [(f"long{i:03}", f"long{i + 1:03}", 1) for i in range(150)]
    links += [(f"ring{i:02}", f"ring{(i + 1) % 30:02}", 1) for i in range(30)] + [("tail2", "tail1", 1), ("tail1", "ring17", 5)]
    assert followed(spark, links) == plain(links)


def test_no_links(spark):
    assert followed(spark, []) == {}


def test_discovery(spark):
    pages = [("s", "a", None), ("s", "b", "a"), ("s", "c", "b"), ("s", "d", "gone"), ("s", "e", "f"), ("s", "f", "e"),
             ("t", "b", "c"), ("t", "c", None), ("s", "b", "a")]
    df = spark.createDataFrame(pages, "site string, url string, discovered_from string")
    got = sorted(map(tuple, chains.discovery_paths(df).collect()))
    assert got == [
        ("s", "a", "a", 0, False, True), ("s", "b", "a", 1, False, True), ("s", "c", "a", 2, False, True),
        ("s", "d", "gone", 1, False, False), ("s", "e", "e", 0, True, True), ("s", "f", "e", 1, True, True),
        ("t", "b", "c", 1, False, True), ("t", "c", "c", 0, False, True),
    ]


LOG = "url string, attempt int, status int, content_type string, body_bytes long, exception string, message string, elapsed_ms long, location string"


def test_redirects(spark):
    def row(url, status, location=None, attempt=1, kind="text/html", exception=None):
        return (f"http://h.test/{url}", attempt, status, kind, 10, exception, None, 7, location)

    log = [
        row("a", 503), row("a", 301, "b", 2), row("b", 302, "/c#x", kind="image/png"), row("c", 200),
        row("d", 301, "http://else.test/gone"), row("x", 301, "y"), row("y", 307, "x"), row("z", 301, "y"),
        row("n", 304), row("m", 301, "mailto:a@b.c"), row("t", None, exception="ReadTimeout"), row("p", 301, "t"),
    ]
    got = {
        r.requested_url[14:]: (r.final_url, [p[14:] for p in r.redirect_chain], r.looped, r.ok, r.error, r.attempts, r.elapsed_ms)
        for r in chains.redirect_chains(spark.createDataFrame(log, LOG)).collect()
    }
    h = "http://h.test/"
    assert got == {
        "a": (h + "c", ["a", "b"], False, True, None, 1, 21),
        "b": (h + "c", ["b"], False, True, None, 1, 14),
        "c": (h + "c", [], False, True, None, 1, 7),
        "d": ("http://else.test/gone", ["d"], False, False, "unknown_error", None, 7),
        "x": (h + "x", [], True, False, "redirect_loop", 1, 0),
        "y": (h + "x", ["y"], True, False, "redirect_loop", 1, 7),
        "z": (h + "x", ["z", "y"], True, False, "redirect_loop", 1, 14),
        "n": (h + "n", [], False, False, "http_304", 1, 7),
        "m": (h + "m", [], False, False, "http_301", 1, 7),
        "t": (h + "t", [], False, False, "ReadTimeout: ", 1, 7),
        "p": (h + "t", ["p"], False, False, "ReadTimeout: ", 1, 14),
    }


def test_bodies_of_chosen_attempts(spark):
    """An attempt logged twice is one; fields of the answer come along."""
    schema = LOG.replace(", location string", ", body string, final_url string")
    one = ("u", 1, 500, "text/html", 1, None, None, 3, "x", None)
    two = ("u", 2, 200, "text/html", 1, None, None, 4, "body", "v")
    rows = fetchlog.retry_reduction(spark.createDataFrame([one, two, two], schema)).collect()
    assert [tuple(r) for r in rows] == [("u", 2, True, 200, None, "v", "body", "text/html", 4)]


def test_rounds_follow_the_longest_loop(spark, monkeypatch):
    """Many short loops take no more rounds than a few."""
    written, cut = [], chains.cut_lineage
    monkeypatch.setattr(chains, "cut_lineage", lambda df, **how: written.append(df) or cut(df, **how))

    def tables(loops):
        written.clear()
        links = [(f"n{i}-{k}", f"n{i}-{(k + 1) % 3}", 1) for i in range(loops) for k in range(3)]
        assert followed(spark, links) == plain(links)
        return len(written)

    assert tables(300) == tables(3)


def test_loop_heads_are_on_loops(spark):
    """Tails hold smaller nodes than the loop that they lead into; loops of all lengths, and of one node."""
    links = [("a0", "a1", 1), ("a1", "z5", 2), ("z5", "m", 3), ("m", "z9", 4), ("z9", "z5", 5), ("s", "s", 6), ("b", "s", 7)]
    for n in (2, 4, 7, 8, 9):
        links += [(f"l{n}-{k}", f"l{n}-{(k + 1) % n}", 1) for k in range(n)]
        links += [(f"a{n}-{k}", f"a{n}-{k + 1}" if k < n else f"l{n}-1", 1) for k in range(n + 1)]
    assert followed(spark, links) == plain(links)


def test_discovery_keeps_odd_texts(spark):
    """Sites and URLs that JSON must escape, and pages without one of them."""
    pages = [('s"', "a\\b", None), ('s"', "t\tü\n", "a\\b"), ("", "", None), (None, "x", "y"), ("s", None, "x"), (None, None, None)]
    df = spark.createDataFrame(pages, "site string, url string, discovered_from string")
    got = {(r.site, r.url): (r.root, r.hops, r.known) for r in chains.discovery_paths(df).collect()}
    assert got == {
        ('s"', "a\\b"): ("a\\b", 0, True), ('s"', "t\tü\n"): ("a\\b", 1, True), ("", ""): ("", 0, True),
        (None, "x"): ("y", 1, False), ("s", None): ("x", 1, False), (None, None): (None, 0, True),
    }

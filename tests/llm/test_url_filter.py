from __future__ import annotations

from kilnspark.llm import url_filter

SCHEMA = "page_id long, url string, html string, host string, rule string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", "clash") for i, u, h in rows], SCHEMA)


def test_rules_by_longest_fit(spark):
    rows = [
        (1, "https://A.Example.ORG/es/x?q#f", None),
        (2, "http://example.org/en/12", ""),
        (3, "http://sub.example.org/en/2", ""),
        (4, "http://notexample.org/es/", ""),
        (5, "http://shop.com/fr/1", ""),
        (6, "http://shop.com/de/1#x", ""),
        (7, "http://shop.com?x=/de/", ""),
        (8, "no scheme", ""),
        (9, None, None),
        (9, None, None),
        (10, "http://x.org", ""),
        (11, "ftp://h/a://b/c", ""),
    ]
    got = {r.page_id: r for r in url_filter.url_filter(pages(spark, rows)).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert (got[2].rule, got[2].verdict) == ("example.org/en/1", "block")
    assert (got[3].rule, got[3].verdict) == ("org/", "allow")
    assert got[4].rule == "org/"
    assert got[5].rule == "com/fr/" and got[6].rule == "com/de/" and got[6].path == "/de/1"
    assert (got[7].host, got[7].path, got[7].rule) == ("shop.com", "", None)
    assert (got[8].host, got[9].host, got[9].path, got[9].verdict) == ("", "", "", "allow")
    assert got[10].rule is None
    assert (got[11].host, got[11].path) == ("h", "/a://b/c")


def test_trust_and_distrust_walk_over_links(spark):
    link = '<a href="http://{}/x">y</a>'.format
    rows = [
        (1, "http://good.org/", link("friend.net")),
        (2, "http://friend.net/", link("far.net")),
        (3, "http://bad.com/de/", ""),
        (4, "http://shill.net/", link("bad.com") * 3),
        (5, "http://alone.net/", ""),
        (6, "http://far.net/", ""),
    ]
    got = {r.host: r for r in url_filter.url_filter(pages(spark, rows)).collect()}
    assert got["friend.net"].trust > got["far.net"].trust > 0 == got["alone.net"].trust
    assert got["shill.net"].distrust > 0 and got["shill.net"].verdict == "block"
    assert got["friend.net"].verdict == got["alone.net"].verdict == "allow"


def test_distrust_walks_back_over_a_long_chain(spark):
    rows = [(i, f"http://h{i}.net/", f"<a href=http://h{i + 1}.net/x>y</a>") for i in range(59)] + [(59, "http://h59.net/", "<a href=//bad.com/de/>y</a>" + "long " * 400_000), (60, "http://bad.com/de/", "")]
    got = {r.page_id: r for r in url_filter.url_filter(pages(spark, rows)).collect()}
    assert all(got[i].distrust > 0 and got[i].verdict == "block" for i in range(60))


def test_propagation_matches_dense_iteration(spark):
    edges = [("a", "b", 1.0), ("a", "c", 3.0), ("b", "c", 1.0), ("c", "a", 2.0)]
    hosts = spark.createDataFrame([("a", 1.0, 0.0), ("b", 0.0, 0.5), ("c", 0.0, 0.0)], "host string, trusted double, blocked double")
    got = {r.host: (r.trust, r.distrust) for r in url_filter.propagate(hosts, spark.createDataFrame(edges, "src string, dst string, weight double")).collect()}
    seeds = {"a": (0.15, 0.0), "b": (0.0, 0.075), "c": (0.0, 0.0)}
    now = dict(seeds)
    out = {n: sum(w for s, _, w in edges if s == n) for n in "abc"}
    into = {n: sum(w for _, d, w in edges if d == n) for n in "abc"}
    for _ in range(300):
        after = {n: list(seeds[n]) for n in "abc"}
        for s, d, w in edges:
            after[d][0] += 0.85 * w / out[s] * now[s][0]
            after[s][1] += 0.85 * w / into[d] * now[d][1]
        now = {n: tuple(v) for n, v in after.items()}
    for n in "abc":
        assert abs(got[n][0] - now[n][0]) < 1e-9 and abs(got[n][1] - now[n][1]) < 1e-9


def test_main_path_is_native(spark, sf_dir):
    plan = url_filter.op3_url_filter(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty(spark):
    assert url_filter.url_filter(pages(spark, [])).count() == 0

from quillgraph.llm import urls

CASES = {
    "http://example.com/en/1": ("example.com", "/en/1", "example.com/en/", "block"),
    "https://www.Example.COM/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
    "https://a.www.example.com/en/x?q#f": ("a.www.example.com", "/en/x", "www.example.com/en/", "allow"),
    "http://a.example.com/de/1": ("a.example.com", "/de/1", "com/", "allow"),
    "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
    "ftp://x.net/es/9": ("x.net", "/es/9", "net/es/", "block"),
    "http://net/fr/": ("net", "/fr/", "net/fr/", "block"),
    "http://shop.com": ("shop.com", "", None, None),
    "http://shop.com?x=/y": ("shop.com", "", None, None),
    "noscheme.com/en/": ("", "", None, None),
    "a://b://c/d": ("b:", "//c/d", None, None),
    "": ("", "", None, None),
}


def test_hosts_paths_and_rules(spark):
    rows = [(k, u) for k, u in enumerate(CASES)] + [(99, None), (0, "http://example.com/en/1")]
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in rows], "page_id long, url string, host string, rule int")
    got = urls.judge(pages, spark.createDataFrame([], "page_id long, bad int")).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = CASES.get(dict(rows).get(r.page_id) or "", ("", "", None, None))
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")


def test_domains(spark):
    hosts = {"a.b.example.co.uk": ("example.co.uk", "co.uk"), "www.x.com": ("x.com", "com"), "x.com:80": ("x.com", "com"), "localhost": ("localhost", "localhost"), "": ("", ""), "co.uk": ("co.uk", "co.uk")}
    frame = spark.createDataFrame([(h,) for h in hosts], "h string")
    got = {r.h: (r.d, r.s) for r in frame.select("h", urls.domain_of(frame["h"]).alias("d"), urls.suffix_of(frame["h"]).alias("s")).collect()}
    assert got == hosts


def test_reputation_shrinks_to_the_domain(spark):
    seen = [("bad.evil.org", 1)] * 40 + [("b2.evil.org", 1)] * 30 + [("good.org", 0)] * 60 + [("fine.org", 0)] * 60 + [("once.fine.org", 1)]
    hosts = sorted({h for h, _ in seen} | {"new.evil.org", "new.fine.org"})
    found = {r.host: r for r in urls.host_reputation(spark.createDataFrame(seen, "host string, bad int"), spark.createDataFrame([(h,) for h in hosts], "host string")).collect()}
    assert found["bad.evil.org"].low > 0.8 and found["good.org"].high < 0.2
    assert found["new.evil.org"].mean > 0.5 > found["new.fine.org"].mean
    assert found["once.fine.org"].mean < 0.9 and found["once.fine.org"].n == 1

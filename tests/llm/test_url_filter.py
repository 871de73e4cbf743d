import pytest

from umbra.llm.url_filter import RULES, judge_urls, rule_table


def brute(url, rules=RULES):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else None
    return host, path, best[3] if best else None, best[4] if best else ("block" if host == "" else "allow")


URLS = [
    None, "", "no scheme", "http://", "https://org/", "https://org", "http://EXAMPLE.org/es/x", "http://a.b.example.org/es", "http://example.org/en/12?x#y", "http://badexample.org/es/",
    "x://a.com/fr/?q", "x://a.com/de/1#f", "x://a.com/DE/1", "x://com/fr/", "x://user@a.org:80/p", "://a.org/", "x://a..org/", "x://.org/", "x://a.org?x=/es/", "http://ä.org/é/ü", "x://y.com/fr/://z.org/de/",
    "x://" + "a." * 3000 + "org/" + "p" * 5000,
]


def test_against_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)] + [(0, "https://org/", "h", "r")] * 2, "page_id long, url string, host string, rule string")
    rows = judge_urls(pages, rule_table(spark)).collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(r["page"]["url"]), r["page"]["url"]


@pytest.mark.parametrize("limit", [0, 50_000])
def test_precedence_and_large_tables(spark, limit, monkeypatch):
    monkeypatch.setattr("umbra.llm.url_filter.BROADCAST_RULES", limit)
    rules = (("allow", "net", "/"), ("block", "x.net", "/"), ("allow", "x.net", "/a/b"), ("block", "x.net", "/a/b"), ("allow", "y.x.net", "/"))
    pages = spark.createDataFrame([(1, "s://q.net/"), (2, "s://x.net/"), (3, "s://z.x.net/a/bc"), (4, "s://y.x.net/"), (5, "s://other/")], "page_id long, url string")
    rows = {r["page"]["page_id"]: r["rule"] for r in judge_urls(pages, rule_table(spark, rules)).collect()}
    assert rows == {i: brute(u, rules)[2] for i, u in [(1, "s://q.net/"), (2, "s://x.net/"), (3, "s://z.x.net/a/bc"), (4, "s://y.x.net/"), (5, "s://other/")]}


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "s://a.org/")], "page_id long, url string")
    assert judge_urls(pages.limit(0), rule_table(spark)).count() == 0
    assert judge_urls(pages, rule_table(spark).limit(0)).first()["verdict"] == "allow"

import pytest

from keelson.llm import queries, urlfilter

URLS = ["http://example.com/en/71?x", "https://EXAMPLE.com/en/8", "http://a.net/de/1", "http://example.net/de/8#x", "ftp://sub.example.net/de/80", "http://x.org/es", "http://x.org/es/", "nothing", None, "http://com/en/", "://", "http://h?/en/", "http://commons/en/", "http://user@com:80/en/", "a://b://c/d", "http://é.com/en/é"]


def brute(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        for c in "?#":
            rest = rest.split(c, 1)[0]
        host, slash, tail = rest.partition("/")
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + tail
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.key), len(r.host), r.verdict == "block"), default=None)
    return host, path, best and best.key, best.verdict if best else "allow"


@pytest.mark.parametrize("local", [True, False])
def test_against_brute_force(spark, local):
    rules = [*queries.URL_RULES, urlfilter.Rule("block", "é.com", ""), urlfilter.Rule("allow", "a.net", "/de/1")]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(URLS)] * 2, "page_id long, url string, Host string")
    found = urlfilter.filter_urls(pages, rules, max_local_rules=10 if local else 1)
    got = sorted((r["page_id"], r["host_2"], r["path"], r["rule"], r["verdict"]) for r in found.collect())
    want = sorted((i, *brute(u, rules)) for i, u in enumerate(URLS) for _ in range(2))
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_collisions_are_confirmed_by_strings(tmp_path, monkeypatch):
    monkeypatch.setattr(urlfilter.xxhash, "xxh64_intdigest", lambda b: 1)
    name, files = urlfilter.DigestArray.files([urlfilter.Rule("block", "a", "/x"), urlfilter.Rule("allow", "b", "/y")])
    for kind, content in files.items():
        (tmp_path / f"{name}.{kind}").write_bytes(content)
    index = urlfilter.DigestArray(str(tmp_path), name)
    assert index.probe([("b", "/y"), ("c", "/z")]) == [("b/y", "allow"), None]


@pytest.mark.parametrize("limit", [10, 1])
def test_contradictions_are_refused(spark, limit):
    pages = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    rules = [urlfilter.Rule("block", "a", ""), urlfilter.Rule("allow", "a", ""), urlfilter.Rule("allow", "b", "")]
    with pytest.raises(ValueError):
        urlfilter.filter_urls(pages, rules, max_local_rules=limit)
    same_string = [urlfilter.Rule("block", "a", "b/x"), urlfilter.Rule("allow", "ab", "/x")]
    assert urlfilter.filter_urls(pages, same_string, max_local_rules=limit).first()["verdict"] == "allow"


@pytest.mark.parametrize("limit", [10, 1])
def test_long_hosts(spark, limit):
    long = "a." * 500_000 + "example.net"
    urls = [f"http://{long}/de/80", "http://" + "x" * 1_000_000 + "/en/", "http://" + "." * 1_000_000 + "com/en/", "http://com./en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [*queries.URL_RULES, urlfilter.Rule("block", "", "/en/")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(pages, rules, max_local_rules=limit).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_no_rules_and_no_rows(spark):
    pages = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    assert urlfilter.filter_urls(pages, []).first()["verdict"] == "allow"
    assert urlfilter.filter_urls(pages.limit(0), queries.URL_RULES).collect() == []

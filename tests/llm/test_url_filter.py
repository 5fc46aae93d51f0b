import re

import pytest

from flowloom.llm import url_filter
from flowloom.llm.queries import ALLOW_RULES, BLOCK_RULES, QUERIES, SQL


def slow(url, allow, block):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = m.groups() if m else ("", "")
    host = re.sub("[A-Z]", lambda c: c[0].lower(), host)
    fits = []
    for rule in {*allow, *block}:
        h, _, p = rule.partition("/")
        p = rule[len(h) :]
        if host and (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(rule), rule))
    rule = max(fits)[1] if fits else None
    return host, path, rule, "block" if rule in block else "allow"


URLS = [None, "", "no scheme/en/", "http://", "http://EXAMPLE.com/en/x", "http://a.example.com?/en/", "https://www.example.com/en", "https://x.www.example.com/en/#a", "ftp://net/es/", "http://a.net/fr/1?q#z", "http://Ünet/fr/", "http://anet/es/", "http://a..com/", "http://com/", "http://x/y://z.net/es/", "http://example.com:80/en/", "http://" + "a." * 5000 + "net/es/" + "b/" * 5000, "\n://a\nb.com/x\ny"]


@pytest.fixture(scope="module")
def urls(spark):
    return spark.createDataFrame([(i, u, "h", "p", "r") for i, u in enumerate([*URLS, *URLS[:6]])], "page_id long, url string, host string, path string, rule string")


def check(got, pairs, allow, block):
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *slow(u, allow, block))) for i, u in pairs)


def test_edge_urls(urls):
    got = url_filter.judge_urls(urls, ALLOW_RULES, BLOCK_RULES).collect()
    check(got, enumerate([*URLS, *URLS[:6]]), ALLOW_RULES, BLOCK_RULES)
    assert {r["verdict"] for r in url_filter.judge_urls(urls, [], []).collect()} == {"allow"}
    with pytest.raises(ValueError):
        url_filter.judge_urls(urls, [], ["/path/"])
    assert url_filter.judge_urls(urls.limit(0), ALLOW_RULES, BLOCK_RULES).collect() == []


def test_whole_table(spark, sf):
    pages = [(r["page_id"], r["url"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = QUERIES["op3_url_filter"](spark, sf)
    check(got.collect(), pages, ALLOW_RULES, BLOCK_RULES)
    plan = got._jdf.queryExecution().toString()
    assert "Join" not in plan and "Python" not in plan and "Arrow" not in plan
    assert "op3_url_filter" in SQL


def test_lists_as_tables_and_conflicts(spark, urls):
    table = lambda rules: spark.createDataFrame([(r,) for r in rules] + [(None,), (rules[0],)], "rule string")
    allow = [*ALLOW_RULES, "net/es/"]
    got = url_filter.judge_urls(urls, table(allow), table(BLOCK_RULES)).collect()
    check(got, enumerate([*URLS, *URLS[:6]]), allow, BLOCK_RULES)


@pytest.mark.parametrize("segment_keys", [1 << 16, 40])
def test_long_lists_are_exact(spark, segment_keys):
    """Levels beyond the first are needed here, and with few keys a segment several passes."""
    pages = spark.range(4000).selectExpr("id AS page_id", "concat('http://h', id % 700, '.s', id % 13, '.org/p', id % 5, '/x') AS url")
    allow = [f"h{i}.s{i % 13}.org/p{i % 5}" for i in range(0, 90, 2)]
    block = [f"s{i}.org/p{i % 5}" for i in range(0, 13, 3)] + [f"h{i}.s{i % 13}.org" for i in range(1, 120, 2)]
    got = url_filter.judge_urls(pages, allow, block, segment_keys=segment_keys).collect()
    check(got, [(r["page_id"], r["url"]) for r in pages.collect()], allow, block)


def test_levels_alternate_until_exact(spark):
    universe = spark.range(20000).selectExpr("concat('k', id) AS key")
    listed = universe.filter("abs(hash(key)) % 7 = 0")
    cascade = url_filter.build_cascade(listed, universe)
    assert len(cascade.levels) > 2
    have = {r["key"] for r in universe.filter(cascade.has(universe["key"])).collect()}
    assert have == {r["key"] for r in listed.collect()}

import re

import duckdb

from tessera.llm import url_filter as U

URLS = [None, "", "no scheme/com/en/x", "http://a.example.com/en/7x?q", "https://EXAMPLE.com/en/8", "https://x.net/de/8", "http://example.net/de/88#t", "http://sub.example.net/de/7", "http://a.org/es/", "http://a.org/ES/", "http://com/en/", "http://xcom/en/", "x://com", "http://a.com:80/en/1", "http://u@a.com/en/1", "://b.com/en/?://c", "http://spam-farm.x.fr/a", "http://cheap-pills/", "http://a.fr/click-bait/1", "http://a.fr/doorway/x/index.html", "http://a.fr/affiliate/redirect?x", "http://spam-farmer.fr/", "HTTP://WWW.CASINO.IT/", "http://a.com/en/7\nx", "http://q.fr/?sessionid=1&autogen=2", "http://q.fr/sessionidx=1&autogen=", "http://a.com?x=/en/", "http://a.com#/en/"]


def brute(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (re.sub("[A-Z]", lambda x: x.group().lower(), m.group(1)), m.group(2)) if m else ("", "")
    best = None
    for verdict, h, p in U.HOST_RULES:
        if m and (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = verdict, h + p
    low = re.sub("[A-Z]", lambda x: x.group().lower(), url or "")
    if not best and any(re.search(U.pattern_rule(p).regex, low, re.S) for p in U.PATTERNS):
        return host, path, None, "block"
    return host, path, best and best[1], best[0] if best else "allow"


def test_against_brute_force_and_sql(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    rows = {r["page_id"]: tuple(r)[1:5] for r in U.filter_urls(pages).collect()}
    assert rows == {k: brute(u) for k, u in enumerate(URLS)}
    con = duckdb.connect()
    con.sql("create table pages (page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", list(enumerate(URLS)))
    assert {r[0]: r[1:] for r in con.sql(U.ORACLE_SQL).fetchall()} == rows


def test_only_candidates_run():
    rules = [U.pattern_rule(f"/word{k}/") for k in range(1000)]
    index = U.RuleIndex(rules, {})
    assert index.judge("http://a.b/word77/x")[3:] == ("block", 1)
    assert index.judge("http://a.b/other/x")[3:] == ("allow", 0)
    assert U.RuleIndex([U.pattern_rule("*")], {}).judge("http://a")[4] == 1  # a rule without a token always runs
    rare = U.RuleIndex([U.pattern_rule("/common/rare/")], {b"common": 50, b"rare": 2})
    assert set(rare.by) == {b"rare"}


def test_tokens_are_whole():
    assert U.pattern_rule("abc/def").tokens == ()  # both may go on beyond the pattern
    assert U.pattern_rule("/abc/def").tokens == (b"abc",)
    assert U.host_rule("block", "example.com", "/en/7").tokens == (b"example", b"com", b"en")


def test_odd_rows(spark):
    pages = spark.createDataFrame([(None, None, "x"), (1, "http://a.com/en/", "x"), (1, "http://a.com/en/", "x")], "page_id long, url string, host string")
    rows = U.filter_urls(pages).collect()
    assert len(rows) == 3 and rows[1] == rows[2] and rows[0]["host"] == "" and rows[0]["verdict"] == "allow"
    assert U.filter_urls(pages.limit(0)).collect() == []

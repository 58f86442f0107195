from __future__ import annotations

from larderflow.llm import url_filter

RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es"),
    ("block", "a.net", "/x/y"), ("allow", "a.net", "/x/y"), ("block", "org", "/Long/path/"),
)


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url[url.index("://") + 3 :]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:end], rest[end:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, h, p in RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (0, "", ""), (len(h + p), verdict, h + p))
    return host, path, best and best[2], best[1] if best else "allow"


URLS = [
    "http://Example.com/en/a", "https://www.example.com/en/?q=1", "http://x.www.example.com/en/b#c", "http://example.com/EN/a", "http://com/",
    "http://com", "http://telecom/", "http://b.net/estate", "http://b.net/e/s", "https://a.net/x/yes?://", "ftp://q.a.net/x/y/z", "x.org/Long/path/",
    "://org/Long/path/é", "http://org/Long/pat", "http://org?/Long/path/", None, "", "http://", "http:///en/", "a://b://c/d", "http://É.com/\nz",
    "http://" + "a." * 3000 + "com/" + "p/" * 3000, "http://user@Example.COM:80/en/",
]


def test_equals_plain_rules(spark):
    rows = [(k, u, "h", "p", "r") for k, u in enumerate(URLS)] + [(None, URLS[0], "h", "p", "r"), (0, URLS[0], "h", "p", "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string, rule string")
    result = url_filter.judge(pages, url_filter.rule_table(spark, RULES))
    assert result.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(str, map(tuple, result.collect()))) == sorted(str((r[0], *plain(r[1]))) for r in rows)


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://example.com/en/")], "page_id long, url string")
    assert [tuple(r) for r in url_filter.judge(pages, url_filter.rule_table(spark, ())).collect()] == [(1, "example.com", "/en/", None, "allow")]
    assert url_filter.judge(pages.limit(0), url_filter.rule_table(spark, RULES)).collect() == []

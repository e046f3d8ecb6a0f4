import duckdb

from geoloom.llm import queries, urls

URLS = [
    None, "", "nothing", "http://", "http://COM/en/", "http://com/en", "https://a.b.com/en/x?y#z", "http://xcom/en/", "http://.com/en/1", "http://example.com/en/7", "http://www.EXAMPLE.com/en/71/a", "http://myexample.com/en/7",
    "http://example.net/de/8", "http://x.net/de/8", "http://example.net/de/9", "x://y://example.org/es/1", "http://example.com?q=/en/7", "http://example.com#/en/", "http://example.com:80/en/7", "http://com./en/", "ftp://org/es/" + "a" * 5000,
    "http://éx.com/en/é", "http://com/en/\n7",
]


def plain(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(h, p, v) for r, v in urls.RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    best = max(fits, key=lambda f: (len(f[0]), len(f[1])), default=None)
    return host, path, f"{best[0]}/{best[1]}" if best else None, best[2] if best else urls.DEFAULT


def test_awkward_urls(spark):
    rows = [(k, u, "a", "b") for k, u in enumerate(URLS + URLS[5:9])]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string, host string")
    for got in (urls.filtered(pages), urls.joined(pages, spark.createDataFrame(urls.RULES, "rule string, verdict string"))):
        assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()) == [(k, *plain(u)) for k, u, *_ in rows] or sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()), key=lambda r: r[0]) == [(k, *plain(u)) for k, u, *_ in rows]
    assert urls.filtered(pages.limit(0)).count() == 0


def test_colliding_keys(tmp_path, monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda b: len(b) % 3)
    rules = [(f"h{k}.org/p{k}", "block") for k in range(20)]
    (tmp_path / "i").write_bytes(urls.build(rules))
    index = urls.Index(str(tmp_path / "i"))
    assert [index.find([r.encode()])[0] >= 0 for r, _ in rules] == [True] * 20
    assert index.find([b"h1.org/p2", b""]).tolist() == [-1, -1]


def test_sql_gives_the_same(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    want = con.execute(f"select page_id, host, path, rule, verdict from ({queries.OP1_SQL}) order by 1").fetchall()
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in queries.op1_url_filter(spark, sf).select("page_id", "host", "path", "rule", "verdict").collect())
    assert [tuple(r) for r in want] == got or sorted(want, key=lambda r: r[0]) == sorted(got, key=lambda r: r[0])


def test_columns_of_the_users_stay(spark):
    rows = [(1, "http://com/en/", 7, 8, 9), (2, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, _judged int, _hit int, _judged_ int")
    for got in (urls.filtered(pages), urls.joined(pages, spark.createDataFrame(urls.RULES, "rule string, verdict string"))):
        assert sorted((r.page_id, r["_judged"], r["_hit"], r["_judged_"], r.verdict) for r in got.collect()) == [(1, 7, 8, 9, "block"), (2, None, None, None, "allow")]

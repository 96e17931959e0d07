"""Which links of a page count for the URL filter."""

from prooflake.llm import queries, url_filter

GOOD = ['<link rel="canonical" href="http://a/x">', "<LINK href='http://a/x' rel='alternate canonical'>", "<link href=http://a/x rel=canonical>", '<link rel="canonical"href="http://a/x"/>', '<meta http-equiv="refresh" content="0; url=http://a/x">', '<link data-href="http://b" rel=canonical href="http://a/x">']
BAD = ['<!-- <link rel="canonical" href="http://a/x"> -->', '<script>var s = \'<link rel="canonical" href="http://a/x">\';</script>', '<link data-rel="canonical" href="http://a/x">', '<link rel="noncanonical" href="http://a/x">', '<link rel="canonical-like" href="http://a/x">', '<!-- never ends <link rel="canonical" href="http://a/x">', '<style>x</style><template><link rel="canonical" href="http://a/x"></template>', '<link rel="canonical" data-href="http://a/x">', "<meta data-http-equiv=refresh content='0; url=http://a/x'>", None, ""]


def test_links(spark):
    rows = [(f"http://p/{i}", h) for i, h in enumerate(GOOD + BAD)] + [("http://p/long", "<!--" + "x" * 200_000 + "--> canonical " + GOOD[0])]
    got = url_filter.links(spark.createDataFrame(rows, "url string, html string")).collect()
    assert sorted((r.src, r.dst) for r in got) == sorted([(f"http://p/{i}", "http://a/x") for i in range(len(GOOD))] + [("http://p/long", "http://a/x")])


def test_empty_and_repeated_rows(spark):
    rules = [("block", "a", "/")]
    rows = [(1, "http://p/1", GOOD[0]), (1, "http://p/1", GOOD[0]), (2, "http://q/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("page_id", "url", "html", "'x' as host", "1 as verdict", "2 as via")
    assert sorted((r.page_id, r.verdict) for r in url_filter.judged(df, rules).collect()) == [(1, "block"), (1, "block"), (2, "allow")]
    assert url_filter.judged(df.where("false"), rules).count() == 0


def test_query_rules(spark, tmp_path):
    urls = ["http://a.net/de/1", "http://example.net/de/8", "http://example.net/de/1", "http://a.com/en/7", "http://example.com/en/7", "http://a.org/es/"]
    spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op6_url_filter(spark, str(tmp_path)).orderBy("page_id").collect()
    want = [("net/de/", "allow"), ("example.net/de/8", "block"), ("net/de/", "allow"), ("com/en/", "block"), ("example.com/en/7", "allow"), ("org/es/", "block")]
    assert [(r.rule, r.verdict) for r in got] == want

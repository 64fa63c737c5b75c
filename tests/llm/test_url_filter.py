from corpusmill.llm.url_filter import judge_urls

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("a.example.com", "", "block"), ("", "/x", "block"), ("b-c", "/", "block")]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut].lower(), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in RULES if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_matches_brute_force(spark):
    urls = [None, "", "x", "http://", "://", "http://EXAMPLE.com/en/7", "http://example.com/en/8?q", "http://m.a.example.com", "http://xcom/en/",
            "http://a.b.com/en/1#f", "http://q.b-c/1", "http://b.c/x1", "http://b-c.b/xx", "https://u@h.com:80/en/?a://b", "http://com/en/\n2", "http://example.com/x"]
    urls += urls[:6] + [f"http://h{i}.example.com/en/{i}" for i in range(50)]
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(df, RULES).collect()}
    assert got == {i: brute(u) for i, u in enumerate(urls)}


def test_blocks_of_rules_agree(spark, monkeypatch):
    ties = [("a", "/xx", "block"), ("b.a", "/", "allow"), ("com", "/en/7", "block"), ("example.com", "", "allow"), ("a", "/xx", "allow"), ("", "b", "block")]
    urls = [f"http://h{i % 7}.example.com/en/{i}" for i in range(60)] + ["http://b.a/xx", "http://b.a/x", "http://a/xx", "http://com/en/7", "http://example.com/en/7"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for rules in (RULES, ties, ties[::-1], RULES + ties):
        whole = sorted(map(str, judge_urls(df, rules).collect()))
        for n in (1, 2):
            with monkeypatch.context() as m:
                m.setattr("corpusmill.llm.url_filter.BLOCK", n)
                assert sorted(map(str, judge_urls(df, rules).collect())) == whole
        with monkeypatch.context() as m:
            m.setattr(f"{__name__}.RULES", rules)
            want = {i: brute(u) for i, u in enumerate(urls)}
        got = {r.page_id: (r.host, r.path, r.rule) for r in judge_urls(df, rules).collect()}
        assert got == {i: w[:3] for i, w in want.items()}


def test_empty(spark):
    assert judge_urls(spark.createDataFrame([], "page_id long, url string"), RULES).collect() == []
    assert judge_urls(spark.createDataFrame([(1, "http://a/")], "page_id long, url string"), []).first().verdict == "allow"

from statloom.llm.url_filter import judge_urls, path_rule, word_rule


def verdicts(spark, urls, **options):
    rows = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = judge_urls(rows, **options).orderBy("page_id")
    return [(r.host, r.path, r.rule, r.verdict) for r in got.collect()]


def test_rules_hosts_and_paths(spark):
    urls = [
        None, "", "no scheme/x", "http://a.org", "http://a.ORG/", "HTTP://X.Example.org/es/1?q#f", "http://example.org/en/12",
        "http://example.org/en/2", "https://notexample.org/es/1", "http://c.com/fr/", "http://c.com/FR/", "http://c.com/de/9#x",
        "http://casino-win.example.net/en/1", "http://a.casino.org/x", "http://h.net?x=http://b.org/", "http:///p",
        "http://c.com:80/de/1", "http://x.net/Free-Bets", "http://x.net/" + "a/" * 5_000, "http://x.net/a\nb",
    ]
    assert verdicts(spark, urls) == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.org", "", None, "allow"),
        ("a.org", "/", "org/", "allow"), ("x.example.org", "/es/1", "example.org/es/", "block"),
        ("example.org", "/en/12", "example.org/en/1", "block"), ("example.org", "/en/2", "org/", "allow"),
        ("notexample.org", "/es/1", "org/", "allow"), ("c.com", "/fr/", "com/fr/", "allow"), ("c.com", "/FR/", None, "allow"),
        ("c.com", "/de/9", "com/de/", "block"), ("casino-win.example.net", "/en/1", None, "block"),
        ("a.casino.org", "/x", "org/", "allow"), ("h.net", "", None, "allow"), ("", "/p", None, "allow"),
        ("c.com:80", "/de/1", None, "allow"), ("x.net", "/Free-Bets", None, "block"),
        ("x.net", "/" + "a/" * 5_000, None, "allow"), ("x.net", "/a\nb", None, "allow"),
    ]


def test_own_rules_and_empty_table(spark):
    rules = [path_rule("a.b", "/x/y", "block"), word_rule("w", "[^a-z]foo[^a-z]", ["foo"])]
    assert [v for *_, v in verdicts(spark, ["http://a.b/x/y2", "http://a.b/x", "http://q/foo/"], rules=rules)] == [
        "block", "allow", "block",
    ]
    assert verdicts(spark, []) == []

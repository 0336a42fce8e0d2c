from isohyet.llm import url_rules

CASES = [
    ("http://a.example.org/es/x", "a.example.org", "/es/x", "example.org/es/"),
    ("https://EXAMPLE.org/en/1234?q#f", "example.org", "/en/1234", "example.org/en/1"),
    ("https://example.org/en/2", "example.org", "/en/2", "org/"),
    ("https://notexample.org/es/", "notexample.org", "/es/", "org/"),
    ("http://x.com/fr/#a://b", "x.com", "/fr/", "com/fr/"),
    ("http://x.com/de/?u=http://y.org/", "x.com", "/de/", "com/de/"),
    ("http://x.com/FR/", "x.com", "/FR/", None),
    ("http://x.org?a=1", "x.org", "", None),
    ("http://org/", "org", "/", "org/"),
    ("http:///path", "", "/path", None),
    ("no scheme", "", "", None),
    ("", "", "", None),
    (None, "", "", None),
    ("http://a..org/", "a..org", "/", "org/"),
    ("http://ÄÖ.Org/ü", "ÄÖ.org", "/ü", "org/"),
    ("a\nb://x.org/\ny", "x.org", "/\ny", "org/"),
    ("http://" + "l." * 3000 + "com/fr/" + "p/" * 3000, "l." * 3000 + "com", "/fr/" + "p/" * 3000, "com/fr/"),
]
ACTION = {h + p: a for h, p, a in url_rules.RULES}


def expected():
    out = [(i, h, p, r, ACTION.get(r, "allow")) for i, (_, h, p, r) in enumerate(CASES)]
    return sorted(out + out[:1] * 2 + [(None, *out[0][1:])], key=repr)


def pages(spark):
    rows = [(i, u, "x", "y", 1) for i, (u, *_) in enumerate(CASES)]
    return spark.createDataFrame(rows + rows[:1] * 2 + [(None, CASES[0][0], "x", "y", 1)], "page_id long, url string, host string, rule string, digest long")


def test_rules_by_brute_force(spark):
    got = url_rules.filter_urls(pages(spark), url_rules.rule_table(spark, url_rules.RULES)).collect()
    assert sorted(map(tuple, got), key=repr) == expected()


def test_shuffled_rules_agree(spark, monkeypatch):
    monkeypatch.setattr(url_rules, "BROADCAST_RULES", 0)
    got = url_rules.filter_urls(pages(spark), url_rules.rule_table(spark, url_rules.RULES)).collect()
    assert sorted(map(tuple, got), key=repr) == expected()


def test_empty_tables(spark):
    rules = url_rules.rule_table(spark, url_rules.RULES)
    assert url_rules.filter_urls(pages(spark).limit(0), rules).count() == 0
    none = url_rules.filter_urls(pages(spark), rules.limit(0)).collect()
    assert len(none) == len(expected()) and all(r.rule is None and r.verdict == "allow" for r in none)

import random

from folioflux.llm import urls


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        for k, c in enumerate(rest):
            if c in "/?#":
                host, tail = rest[:k], rest[k:]
                break
        else:
            host, tail = rest, ""
        path = tail.split("?")[0].split("#")[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if r[0] and (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), r[0].count("."), r[2]), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else default


def check(spark, links, rules):
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(links)], "page_id long, url string, host string, verdict string")
    got = urls.judge(pages, urls.rule_table(spark, rules)).collect()
    assert sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got) == sorted((k, *brute(u, rules)) for k, u in enumerate(links))


def test_random_rules_against_brute_force(spark):
    rng = random.Random(3)
    labels, parts = ["a", "b", "com", "co-m", "éa"], ["", "/", "/x", "/x/y", "/xy", "/é"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 4)))
    rules = [(h, p, v) for (h, p), v in {(host(), rng.choice(parts)): rng.choice(["allow", "block"]) for _ in range(40)}.items()]
    odd = [None, "", "no scheme", "://", "http://", "HTTP://A.Com/X", "http://com?x/y", "x://b.com#/x", "http://a.com/\U0010ffff", "http://com\n/x", "a://b://com/x"]
    check(spark, odd + [f"http://{host()}{rng.choice(parts)}{rng.choice(['', 'z', '/z', '?q', '#f'])}" for _ in range(400)] * 2, rules)


def test_rule_tables(spark):
    links = ["http://www.example.com/en/7", "http://x.org/"]
    check(spark, links, [("com", "/en/", "block"), ("example.com", "/en/7", "allow")])
    pages = spark.createDataFrame([(1, links[0])], "page_id long, url string")
    none = urls.rule_table(spark, [])
    assert urls.judge(pages, none).first()["verdict"] == "allow"
    twice = urls.rule_table(spark, [("com", "/en/", "allow"), ("com", "/en/", "block"), (None, "/", "block"), ("com", None, "block"), ("", "/", "block")])
    assert urls.judge(pages, twice).first()["verdict"] == "block"
    assert urls.judge(pages.limit(0), twice).count() == 0
    assert urls.judge(pages.union(pages), twice).count() == 2


def test_hot_labels_repeats_and_long_urls(spark, monkeypatch):
    monkeypatch.setattr(urls, "ROWS_A_SALT", 50)
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "", "block"), ("b.net", "/x", "allow")]
    links = [f"http://www.example.com/en/{k}" for k in range(300)] + ["http://b.net/x"] * 300 + ["http://a.cn/en/"] * 200 + [None] * 100 + ["http://example.com/en/7" + "x" * 300_000, "http://" + "a." * 3000 + "com/en/"]
    check(spark, links, rules)
    same = spark.createDataFrame([(1, "http://b.net/x")] * 500, "page_id long, url string").repartition(5)
    assert {tuple(r)[4:] for r in urls.judge(same, urls.rule_table(spark, rules)).collect()} == {("b.net/x", "allow")}


def test_too_many_labels_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(urls, "MAX_LABELS", 3)
    monkeypatch.setattr(urls, "ROWS_A_SALT", 20)
    rules = [(f"a.l{k}", "/x", "block") for k in range(30)]
    check(spark, [f"http://a.l{k % 40}/x/{k}" for k in range(200)] + ["http://a.l1/x"] * 100 + ["http://a.none/x"] * 100, rules)


def test_rules_of_too_many_levels_are_refused(spark):
    import pytest

    rules = urls.rule_table(spark, [("a" + ".a" * k, "/", "block") for k in range(140)])
    with pytest.raises(ValueError, match="128"):
        urls.judge(spark.createDataFrame([(1, "http://a/")], "page_id long, url string"), rules)

import random

import pytest

from tidecast.llm import urls
from tidecast.llm.urls import RULES, judge_urls, rule_table

URLS = [
    (1, "https://Shop.Example.NET/en/x?q=1"),
    (2, "https://example.net/fr/"),
    (3, "http://notexample.net/en/"),
    (4, "http://example.com/de/#a"),
    (5, "http://a.b.example.com/de"),
    (6, "ftp://w3.org/fr/x"),
    (7, "no scheme"),
    (8, None),
    (9, ""),
    (None, "http://x.net"),
    (1, "https://Shop.Example.NET/en/x?q=1"),
    (10, "a://b://c.net/"),
    (11, "http://net/"),
    (12, "http://x.net./"),
]


def expected(url):
    import re

    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else "allow"


def test_rules_by_definition(spark):
    got = judge_urls(spark.createDataFrame(URLS, "page_id long, url string"), rule_table(spark)).collect()
    assert sorted(map(repr, got)) == sorted(repr(g) for g in got)
    want = sorted((str(i), *map(str, expected(u))) for i, u in URLS)
    assert sorted(tuple(map(str, r)) for r in got) == want


def test_nested_rules_and_clashing_columns(spark):
    rules = rule_table(spark, [("block", "com", "/"), ("allow", "a.com", "/x/"), ("block", "a.com", "/x/y"), ("allow", "b.a.com", "/"), ("block", None, "/")])
    df = spark.createDataFrame([(1, "h://b.a.com/x/yz", "k"), (2, "h://c.a.com/x/z", "k"), (3, "h://aa.com/x/", "k")], "page_id long, url string, host string")
    got = {r.page_id: (r.rule, r.verdict) for r in judge_urls(df, rules).collect()}
    assert got == {1: ("a.com/x/y", "block"), 2: ("a.com/x/", "allow"), 3: ("com/", "block")}


@pytest.mark.parametrize("rules", [[], RULES])
def test_empty_tables(spark, rules):
    table = rule_table(spark, rules) if rules else spark.createDataFrame([], "verdict string, host string, path string")
    assert judge_urls(spark.createDataFrame([], "page_id long, url string"), table).collect() == []
    if not rules:
        one = judge_urls(spark.createDataFrame([(1, "http://x.net/")], "page_id long, url string"), table).collect()
        assert [tuple(r) for r in one] == [(1, "x.net", "/", None, "allow")]


@pytest.mark.parametrize("sweep", [500_000, 3])
def test_nested_hosts_and_paths_equal_brute_force(spark, monkeypatch, sweep):
    """Also where a host's URLs are dealt to several sweeps, and without broadcasts."""
    if sweep == 3:
        monkeypatch.setattr(urls, "SWEEP_URLS", sweep)
        monkeypatch.setattr(urls, "small", lambda df, rows=0: df)
    r = random.Random(7)
    host = lambda: ".".join(r.choice("abé") for _ in range(r.randint(1, 4)))
    path = lambda: "/" + "".join(r.choice("x/yß") for _ in range(r.randint(0, 5)))
    rules = list({(h, p): (r.choice(["block", "allow"]), h, p) for h, p in ((host(), path()) for _ in range(150))}.values())
    hot = [(i, "h://a.b.a/x/xy") for i in range(40)]  # one host and path holds many rows
    rows = hot + [(i, f"h://{host()}{path()}") for i in range(200)] + [(900, "h://" + "a." * 5000 + "a/x"), (901, "h://a.b/" + "x" * 200_000)]
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rule_table(spark, rules)).collect()
    want = []
    for i, u in rows:
        h, p = u[4:].split("/", 1)
        p = "/" + p
        fits = [(len(rh + rp), len(rh), v, rh + rp) for v, rh, rp in rules if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
        best = max(fits, default=None)  # of rules equally long the longer host wins
        want.append((i, h, p, best and best[3], best[2] if best else "allow"))
    key = lambda x: tuple(map(str, x))
    assert sorted((tuple(x) for x in got), key=key) == sorted(want, key=key)

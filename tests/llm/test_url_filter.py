import math

from pairloom.llm.url_filter import judge, threshold_of

CASES = [
    (1, "https://www.Example.com/en/x?q=1", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    (2, "http://example.com/en/a", "example.com", "/en/a", "example.com/en/", "block"),
    (3, "http://a.example.com/en/a", "a.example.com", "/en/a", "example.com/en/", "block"),
    (4, "http://example.com/fr", "example.com", "/fr", "com/", "allow"),
    (5, "http://example.com", "example.com", "", None, None),
    (6, "http://x.net/es/1#f", "x.net", "/es/1", "net/es/", "block"),
    (7, "http://x.net/de/1", "x.net", "/de/1", None, None),
    (8, None, "", "", None, "allow"),
    (9, "no scheme/en/", "", "", None, "allow"),
    (10, "a://b?c://d.com/", "b", "", None, None),
    (11, "http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    (None, "http://net/fr/x", "net", "/fr/x", "net/fr/", "block"),
]


def test_rules_and_parts(spark):
    pages = spark.createDataFrame([c[:2] for c in CASES], "page_id long, url string").selectExpr("*", "1 as name", "2 as score", "3 as gram")
    got = {r.page_id: r for r in judge(pages).collect()}
    for i, _, host, path, rule, verdict in CASES:
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ((verdict,) if verdict else ("allow", "block"))


def test_held_out_kinds_of_urls(spark):
    good = [(i, f"https://site{i % 40}.com/library/history-of-article-{i}") for i in range(400)]
    bad = [(1000 + i, f"https://x{i % 40}.net/es/casino-bonus-win-{i}") for i in range(400)]
    new = [(2000 + i, f"https://other{i}.org/library/history-of-something-{i}") for i in range(40)] + [(3000 + i, f"https://y{i}.org/casino-bonus-win-{i}") for i in range(40)]
    rows = judge(spark.createDataFrame(good + bad + new + new[:5], "page_id long, url string")).collect()
    held = [r for r in rows if r.page_id >= 2000]
    assert len(held) == 85 and sum((r.verdict == "allow") == (r.page_id < 3000) for r in held) >= 80


def witten_bell(names):
    """By order and context how often each character follows, and a function of a name."""
    follows = {}
    for name, n in names:
        s = "\x02" * 4 + name + "\x03"
        for i in range(4, len(s)):
            for k in range(5):
                row = follows.setdefault(s[i - k : i], {})
                row[s[i]] = row.get(s[i], 0) + n

    def logs(name):
        s, out = "\x02" * 4 + name + "\x03", []
        for i in range(4, len(s)):
            p = 1 / 256
            for k in range(5):
                row = follows.get(s[i - k : i], {})
                if row:
                    p = (row.get(s[i], 0) + len(row) * p) / (sum(row.values()) + len(row))
            out.append(math.log(p))
        return sum(out) / len(out)

    return logs


def test_scores_and_verdicts_against_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    odd = [(-1, None), (-2, "no scheme"), (-3, "http://" + "a/" * 9000), (-4, "http://shop.example.org/x"), (-4, "http://shop.example.org/x"), (None, "https://Example.COM/en/ü?q=1")]
    pages = pages.union(spark.createDataFrame(odd, pages.schema)).selectExpr("*", "1 as name", "2 as gram", "3 as host")
    rows = judge(pages).collect()
    assert len(rows) == pages.count()
    half = {r.name: r.half for r in spark.createDataFrame([(x,) for x in {r.host + r.path for r in rows}], "name string").selectExpr("name", "pmod(xxhash64(name), 2) half").collect()}
    names = {}
    for r in rows:
        if r.rule:
            key = r.host + r.path, r.verdict
            names[key] = names.get(key, 0) + 1
    model = lambda verdict, halves: witten_bell([(x, n) for (x, v), n in names.items() if v == verdict and half[x] in halves])
    good, bad = model("allow", (0, 1)), model("block", (0, 1))
    others = {h: (model("allow", (1 - h,)), model("block", (1 - h,))) for h in (0, 1)}
    counts = {}
    for (x, v), n in names.items():
        held = others[half[x]][0](x) - others[half[x]][1](x)
        key = math.floor(max(-10, min(10, held)) * 1000), v
        counts[key] = counts.get(key, 0) + n
    threshold = threshold_of([(at, v, n) for (at, v), n in counts.items()])
    for r in rows:
        name = r.host + r.path
        if not name:
            assert (r.score, r.verdict) == (None, "allow")
            continue
        score = good(name) - bad(name)
        assert abs(r.score - score) < 1e-6
        if not r.rule and abs(score - threshold) > 1e-6:
            assert r.verdict == ("block" if score < threshold else "allow")
    assert {r.verdict for r in rows if not r.rule} == {"allow", "block"}


def test_threshold():
    assert threshold_of([(5, "allow", 3)]) is None
    assert threshold_of([(-10, "block", 5), (20, "allow", 9)]) == (-9 + 20) / 2 / 1000
    assert threshold_of([(1, "block", 9), (2, "allow", 1), (3, "block", 1), (4, "allow", 9)]) in (0.002, 0.004)


def test_one_class_and_empty(spark):
    rows = judge(spark.createDataFrame([(1, "http://a.com/x"), (2, "http://b.org/y")], "page_id long, url string")).collect()
    assert [(r.rule, r.verdict) for r in sorted(rows)] == [("com/", "allow"), (None, "allow")]
    assert judge(spark.createDataFrame([], "page_id long, url string")).count() == 0

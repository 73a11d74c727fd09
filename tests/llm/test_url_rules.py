"""URL rules: fixed rules against brute force, mined rules on planted signals, edge cases."""

import random
import time

from sieveline.llm import url_rules as U

COLUMNS = "page_id long, url string"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]


def fixed(host, path):
    fit = [(h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=lambda r: len(r[0]), default=(None, None))


URLS = ["http://a.com/x", "http://a.com", "https://EXAMPLE.com/en/1", "http://www.example.com/en/1?q=1#f", "http://m.www.example.com/en/",
        "http://badexample.com/en/1", "http://x.net/es/1", "http://x.net/es", "http://net/fr/a", "http://a.network/es/1", None, "",
        "no scheme.com/en/", "ftp://h.org?x=://b.com/", "http://h.org#/es/", "://x.net/fr/", "http://x.net/ES/", "http://é.com/", "http://a.com/a\nb?c",
        "http:///en/", "a://b://example.com/en/", "http://example.com:80/en/", "HTTP://x.com?/en/"]


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def test_fixed_rules(spark):
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(URLS)], COLUMNS + ", host string")
    got = {r.page_id: r for r in U.filter_urls(df, labels(spark)).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path = split(u)
        rule, verdict = fixed(host, path)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict or "allow"), u


def test_mined_rules_find_planted_combination(spark):
    """Only host and step together are bad; either alone is mostly good."""
    rng = random.Random(1)
    pages, marks = [], []
    for i in range(1500):
        host, step = rng.choice(["spam", "news", "shop"]), rng.choice(["win", "blog", "faq"])
        pages.append((i, f"http://{host}.org/{step}/{i}?ref=a"))
        bad = rng.random() < (0.9 if (host, step) == ("spam", "win") else 0.03)
        if i % 2:
            marks += [(i, 0 if bad else 1, 0)] if rng.random() < 0.8 else [(i, 1, int(bad)), (i, 1, 0)]
    got = U.filter_urls(spark.createDataFrame(pages, COLUMNS), labels(spark, marks)).collect()
    for r in got:
        planted = "spam.org" in r.url and "/win/" in r.url
        assert (r.verdict == "block") == planted, (r.url, r.mined_rule)
        if planted:
            assert r.mined_rule == "host=spam.org step=win" and r.confidence > 0.8 and r.rule is None


def test_rules_agree_with_counting_and_keep_to_the_bounds(spark):
    rng = random.Random(2)
    rows = [([f"t{k}" for k in rng.sample(range(8), 3)], rng.random() < 0.3) for _ in range(400)]
    rows = [(t, b or {"t1", "t2"} <= set(t)) for t, b in rows]
    rules = U.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), 0.01, 0.5, 1.1, 5).collect()
    assert any(r.needs == ["t1", "t2"] and r.label == U.BAD for r in rules)
    for r in rules:
        fit = [b for t, b in rows if set(r.needs) <= set(t)]
        right = sum(b == (r.label == U.BAD) for b in fit)
        assert abs(r.confidence - right / len(fit)) < 1e-9 and r.confidence >= 0.5 and r.lift >= 1.1
        assert r.anchor in r.needs
        for s in rules:
            assert not (s.label == r.label and set(s.needs) < set(r.needs) and s.confidence >= r.confidence
                        and s.needs[0] in r.needs)


def test_edge_tables(spark):
    df = spark.createDataFrame([(None, "http://x.org/1"), (None, None), (1, "http://x.org/1"), (1, "http://x.org/1")], COLUMNS)
    got = U.filter_urls(df, labels(spark, [(1, None, None), (None, 0, 1)])).collect()
    assert len(got) == 4 and {r.verdict for r in got} == {"allow"}
    assert U.filter_urls(df.limit(0), labels(spark)).count() == 0


def test_rules_on_steps_deep_in_the_path(spark):
    rng = random.Random(3)
    pages, marks = [], []
    for i in range(600):
        step = rng.choice(["casino-bonus", "city", "sport"])
        pages.append((i, f"http://h.org/{i}/{rng.randint(2000, 2020)}/01/02/archive/{step}/"))
        marks.append((i, 0 if step == "casino-bonus" else 1, 0))
    got = U.filter_urls(spark.createDataFrame(pages, COLUMNS), labels(spark, marks)).collect()
    for r in got:
        assert (r.verdict == "block") == ("casino-bonus" in r.url) and (r.verdict == "allow" or r.mined_rule == "step=casino-bonus")


def test_many_fixed_steps_do_not_blow_up(spark):
    """300 urls of one site with 40 fixed steps; the telling step behind them is still found, very long urls are matched."""
    rng = random.Random(4)
    fixed_steps = "/".join(f"s{'abcdefghij'[k % 10]}{'abcdefghij'[k // 10]}" for k in range(40))
    pages, marks = [], []
    for i in range(300):
        step = rng.choice(["pills-cheap", "recipes", "weather"])
        pages.append((i, f"http://deep.site.org/{i}/{fixed_steps}/{step}/x?a=1&b=2#f"))
        marks.append((i, 0 if step == "pills-cheap" else 1, 0))
    pages.append((1000, "http://other.org/" + "/".join(f"w{i}x" for i in range(20_000)) + "/pills-cheap"))
    start = time.time()
    got = U.filter_urls(spark.createDataFrame(pages, COLUMNS), labels(spark, marks)).collect()
    assert time.time() - start < 120
    assert all((r.verdict == "block") == ("pills-cheap" in r.url) for r in got)
    assert {r.mined_rule for r in got if r.verdict == "block"} == {"step=pills-cheap"}


def test_mining_tokens(spark):
    rows = [(["all", "a", "aa", "b"], True), (["all", "a", "aa"], True), (["all", "c"], False), (["all", "c", "b"], False)]
    pages = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    got = sorted((r.token, r.label) for r in U.mining_tokens(pages).collect())
    assert got == [("aa", U.BAD), ("c", U.GOOD)]  # a goes with aa, b has no lift, all is everywhere


def test_a_combination_is_found_whose_tokens_tell_nothing_apart(spark):
    """Bad are the pages that have both tokens or none (each alone has lift 1), and a token that only other pages have
    next to its companion decides too."""
    pages, marks = [], []
    for i in range(400):
        a, b = i % 2, i // 2 % 2
        pages.append((i, f"http://{'one' if a else 'two'}.org/{'left' if b else 'right'}/{i}"))
        marks.append((i, int(a != b), 0))
    got = U.filter_urls(spark.createDataFrame(pages, COLUMNS), labels(spark, marks)).collect()
    assert all((r.verdict == "block") == (("one" in r.url) == ("left" in r.url)) for r in got)
    # key=z and step=spam-page stand in the same labelled pages; pages with one of them are judged as well.
    pages = [(i, f"http://h{i % 3}.org/{'spam-page?z=1' if i % 4 == 0 else 'x'}#{i}") for i in range(200)]
    unseen = [(1000, "http://h1.org/spam-page"), (1001, "http://h1.org/x?z=2")]
    got = U.filter_urls(spark.createDataFrame(pages + unseen, COLUMNS), labels(spark, [(i, int(i % 4 != 0), 0) for i in range(200)]),
                        document=U.F.col("page_id")).collect()
    assert {r.verdict for r in got if r.page_id >= 1000} == {"block"}

"""URL rules against plain string work, and the model on held-out URLs."""

import random
from collections import Counter

import numpy as np
import pytest

from ixlake.llm.urls import FEATURES, RULES, Rule, fit, judge_urls, labelled_sample, sparse_rows

SCHEMA = "page_id long, url string, html string, host int, verdict string, score string"


def make(spark, rows):
    return spark.createDataFrame([(i, u, "<p>", 1, "x", "y") for i, u in rows], SCHEMA)


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host_end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:host_end])
    path = rest[host_end:]
    path_end = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return host, path[:path_end]


def plain_rule(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def test_given_pages(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    urls = {r["page_id"]: r["url"] for r in table.collect()}
    result = judge_urls(table).collect()
    assert Counter(r["page_id"] for r in result) == Counter(urls.keys())
    for r in result:
        host, path = plain_parts(urls[r["page_id"]])
        rule = plain_rule(host, path, RULES)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule.name if rule else None)
        if rule:
            assert r["verdict"] == ("allow" if rule.allow else "block")
        else:
            assert r["verdict"] == ("allow" if r["score"] >= 0.5 else "block")


ODD = [
    None, "", "no scheme", "://", "http://", "http:///", "http://ORG/", "http://org", "HTTP://WWW.Example.ORG/es/1?x=/fr/",
    "http://example.org/es", "http://badexample.org/es/", "http://a.example.org/en/19#://x", "x://y://z.com/fr/", "http://É.COM/de/",
    "http://com/fr/", "http://a.com?/fr/", "http://a.com#/fr/", "http://a.com/fr/#a?b", "http://a.org:80/", "http://a.net/" + "long/" * 40_000,
    "http://a.com/de/\n/x", "line\nbreak://b.org/x",
]


def test_odd_urls(spark):
    rows = [(i, u) for i, u in enumerate(ODD)] + [(None, "http://a.org/x"), (3, "http://a.org/x"), (3, "http://a.org/x")]
    result = judge_urls(make(spark, rows)).collect()
    assert len(result) == len(rows)
    wanted = Counter()
    for i, u in rows:
        host, path = plain_parts(u)
        rule = plain_rule(host, path, RULES)
        wanted[(i, host, path, rule.name if rule else None)] += 1
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"]) for r in result) == wanted
    assert all(r["verdict"] in ("allow", "block") and 0 <= r["score"] <= 1 for r in result)


def test_empty_table_and_one_verdict(spark):
    assert judge_urls(make(spark, [])).collect() == []
    only_blocked = judge_urls(make(spark, [(1, "http://a.com/de/1"), (2, "http://a.net/x")])).collect()
    assert {r["verdict"] for r in only_blocked} == {"block"}
    unknown = judge_urls(make(spark, [(1, "http://a.net/x"), (2, None)])).collect()
    assert {r["verdict"] for r in unknown} == {"allow"}


def _invented(draw):
    bad = draw.random() < 0.3
    host = f"{draw.choice(['casino', 'pills', 'win'] if bad else ['news', 'shop', 'blog'])}{draw.randrange(1000)}.net"
    path = "/" + "/".join(draw.choice(["free-bonus", "click", "deal"] if bad else ["article", "about", "post"]) for _ in range(2))
    return f"https://{host}{path}/{draw.randrange(10**6)}", not bad


def test_model_on_held_out_urls(spark):
    draw = random.Random(5)
    known = [_invented(draw) for _ in range(400)]
    asked = [_invented(draw) for _ in range(400)]
    labelled = spark.createDataFrame([*known, ("http://x.net/", None), (None, True)], "url string, allow boolean")
    result = judge_urls(make(spark, [(i, u) for i, (u, _) in enumerate(asked)]), (), labelled).collect()
    right = sum((r["verdict"] == "allow") == asked[r["page_id"]][1] for r in result)
    assert right >= 0.97 * len(asked) and all(r["rule"] is None for r in result)


def test_fit_is_the_optimum_and_repeats():
    draw = random.Random(6)
    rows = [_invented(draw) for _ in range(60)]
    parts = [plain_parts(u) for u, _ in rows]
    allow = np.array([a for _, a in rows])
    hosts, paths = [h for h, _ in parts], [p for _, p in parts]
    one, two = fit(hosts, paths, allow), fit(hosts, paths, allow)
    assert np.array_equal(one.weights, two.weights) and one.bias == two.bias
    # The slope of the loss is near zero.
    found_rows, found, values = sparse_rows(hosts, paths)
    own = np.where(allow, 0.5 / allow.sum(), 0.5 / (~allow).sum())
    error = own * (one.scores(hosts, paths) - allow)
    slope = np.bincount(found, values * error[found_rows], FEATURES) + 1e-4 * one.weights
    assert np.abs(slope).max() < 1e-3 and abs(error.sum()) < 1e-3


def test_host_and_path_are_told_apart():
    one, two = sparse_rows(["abc"], ["def"]), sparse_rows(["def"], ["abc"])
    assert set(one[1]).isdisjoint(two[1])
    assert np.isclose((one[2] ** 2).sum(), 1)


def test_sample_is_bounded_and_repeats(spark):
    rows = [(f"h{i % 50}", f"/{i % 70}", i % 2 == 0) for i in range(2000)]
    table = spark.createDataFrame(rows, "host string, path string, allow boolean")
    one = labelled_sample(table, 20)
    assert one == labelled_sample(table.repartition(7), 20)
    assert Counter(allow for _, _, allow in one) == {True: 20, False: 20}


def test_too_many_rules_are_refused(spark):
    with pytest.raises(ValueError, match="rules"):
        judge_urls(make(spark, []), [Rule(f"h{i}", "/", True) for i in range(1001)])

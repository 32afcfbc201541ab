import re

import pytest

from pyspark.sql import functions as F
from tidewell.llm.url_filter import ORDINARY, RULES, UNWANTED, filter_urls, labelled_urls, train, url_features, url_parts

LOWER = {i: i + 32 for i in range(65, 91)}


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest, re.S)[0]
    path = re.match(r"[^?#]*", rest[len(host) :], re.S)[0]
    host, best = host.translate(LOWER), None
    for action, rule in RULES:
        rule_host, rule_path = rule.split("/", 1)
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith("/" + rule_path):
            if best is None or len(rule) > len(best[1]):
                best = action, rule
    return host, path, best and best[1], best and best[0]


@pytest.fixture(scope="module")
def model(spark):
    return train(labelled_urls(spark))


URLS = [
    None, "", "no scheme", "http://", "https://EXAMPLE.com/en/7", "https://example.com/en/71?x=1", "http://a.b.com/en/#x", "http://com/en/", "http://xcom/en/1",
    "http://site.net/de/8", "http://example.net/de/8", "http://sub.example.net/de/81", "ftp://x.org/es/", "http://x.org/ES/", "http://x.org?/es/", "a://b://c/d",
    "http://münchen.com/en/ü", "http://a.com/en/\nnext?q", "http://" + "a" * 40_000 + ".com/" + "p" * 40_000, "http://example.com#/en/", "http://x.y/%20?a=1&b=2",
]


def test_parts_and_rules(spark, model):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([*URLS, *URLS])], "page_id bigint, url string")
    got = {r.page_id: r for r in filter_urls(pages, *model).collect()}
    assert len(got) == 2 * len(URLS)
    for i, u in enumerate([*URLS, *URLS]):
        host, path, rule, verdict = brute(u)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule), u
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))


def test_held_out_urls(spark, model):
    fresh = labelled_urls(spark, 9000).exceptAll(labelled_urls(spark, 6000))
    pages = fresh.selectExpr("url", "blocked AS page_id")
    got = filter_urls(pages, *model, rules=()).selectExpr("page_id AS blocked", "verdict = 'block' AS b").toPandas()
    assert (got.blocked == got.b).mean() > 0.9


def test_urls_of_other_words(spark):
    """On words that no training url has, shape alone tells some of the unwanted (0.38 as measured) and hardly any of the others (0.03)."""
    made = train(labelled_urls(spark, 6000, UNWANTED[::2], ORDINARY[::2]))
    pages = labelled_urls(spark, 4000, UNWANTED[1::2], ORDINARY[1::2]).selectExpr("url", "blocked AS page_id")
    got = filter_urls(pages, *made, rules=()).selectExpr("page_id AS blocked", "verdict = 'block' AS b").toPandas()
    assert got.b[got.blocked].mean() > 0.3 and got.b[~got.blocked].mean() < 0.05


def test_parameters_are_counted_as_such(spark):
    urls = [("http://a/?x=1&y=2#z=3", 2), ("http://a/b=c", 0), ("http://a/?&&q", 1), ("http://a/?=a=b=", 1), (None, 0)]
    rows = spark.createDataFrame(urls, "url string, n int").withColumns(url_parts(F.col("url")))
    assert [r.n_params for r in rows.select("n", *url_features(F.col("url"))).collect()] == [n for _, n in urls]


def test_a_table_of_ones_own(spark):
    rows = [(f"http://good{i % 50}.org/a/{i}", False) for i in range(200)] + [(f"http://evil{i % 50}-x.org/a/{i}", True) for i in range(200)]
    own = train(spark.createDataFrame(rows, "url string, blocked boolean"))
    pages = spark.createDataFrame([(1, "http://good7.org/a/1"), (2, "http://evil9-x.org/a/7")], "page_id bigint, url string")
    assert {r.page_id: r.verdict for r in filter_urls(pages, *own, rules=()).collect()} == {1: "allow", 2: "block"}


def test_empty(spark, model):
    assert filter_urls(spark.createDataFrame([], "page_id bigint, url string"), *model).count() == 0


def test_clashing_names(spark, model):
    own = ("host", "path", "rule", "ruled", "features", "score", "verdict", "probability", "prediction", "rawPrediction", "mark", "odds", "host_length", "row")
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id bigint, url string").selectExpr("*", *[f"'own' AS {c}" for c in own])
    got = filter_urls(pages, *model, carry=pages.columns).first()
    assert got.host == "a.com" and got.features == "own" and got["row"] == "own"


def test_no_python_in_the_plan(spark, model):
    plan = filter_urls(spark.createDataFrame([(1, "http://a.com/x")], "page_id bigint, url string"), *model)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

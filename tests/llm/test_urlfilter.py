"""The URL filter against a loop over all rules, with a roomy filter and with one that lets everything pass."""

import re

import pytest
from pyspark.sql import functions as F

from glyphmark.llm import urlfilter

PAGES = "page_id long, url string, html string, host string, rule string, keys string"
URLS = [
    None, "", "no scheme/en/", "http://", "http://a.net", "http://a.net/", "HTTP://A.Example.NET/en/x?q#f", "http://example.net/en", "http://notexample.net/en/1", "http://example.net?/en/",
    "http://x.example.com/de/", "http://example.com/de", "http://example.com/DE/1", "http://org/fr/", "http://b.org/fr/x", "http://borg/fr/x", "http://bad.com/page?b=2&a=1", "https://www.bad.com/page/?a=1&utm_source=x&b=2#top",
    "http://bad.com:80/page?a=1&b=2", "http://bad.com/page?a=1", "http://user@bad.com/page?a=1&b=2", "x://y://net/z", "http://ÄÖ.net/ü", "http://" + "a." * 3000 + "net/" + "p/" * 5000, "http://a.net/\n?x", "http://bad.com/page?b=2&a=1",
]


def _plain(url, listed, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "block" if url in listed else "allow"


@pytest.mark.parametrize("most", [64, 16 << 20])
def test_matches_plain_rules(spark, most):
    pages = spark.createDataFrame([(k, u, "h", "clash", "clash", "clash") for k, u in enumerate(URLS)], PAGES).repartition(5)
    rules = [*urlfilter.RULES, ("a.net", "", "allow"), ("com", "/page", "allow"), ("bad.com", "/page", "block"), ("net", "/z", "allow"), ("bad.com", "/pag", "allow")]
    rule_df = spark.createDataFrame([*rules, rules[0], (None, "/", "block"), ("net", None, "block")], "host string, path string, action string")
    listed = spark.createDataFrame([(None,), ("",), ("http://nowhere",), ("http://nowhere",)], "url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(pages, listed, rule_df, most).collect()}
    assert got == {k: _plain(u, (), rules) for k, u in enumerate(URLS)}


def test_listed_urls_by_canonical_form(spark):
    pages = spark.createDataFrame([(k, u, "h", "clash", "clash", "clash") for k, u in enumerate(URLS)], PAGES)
    none = spark.createDataFrame([], "host string, path string, action string")
    listed = spark.createDataFrame([("http://bad.com/page?a=1&b=2",)], "url string")
    hit = urlfilter.filter_urls(pages, listed, none).where("verdict = 'block'").collect()
    assert sorted(r.page_id for r in hit) == [16, 17, 18, 20, 25] and all(r.listed for r in hit)
    allow = spark.createDataFrame([("com", "/", "allow")], "host string, path string, action string")
    assert [r.page_id for r in urlfilter.filter_urls(pages, listed, allow).where("verdict = 'block'").collect()] == [18]  # a rule's host is the whole host, port included
    assert urlfilter.filter_urls(pages.limit(0), listed, allow).count() == 0


def test_filter_loses_no_key_and_few_others_pass(spark):
    keys = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"))
    words = urlfilter.build_filter(keys)
    tried = spark.range(40000).select(F.concat(F.lit("k"), "id").alias("key")).select(F.xxhash64("key").alias("a"), F.xxhash64(F.lit(1), "key").alias("b")).toPandas()
    passed = urlfilter.may_hold(words, tried.a.to_numpy(), tried.b.to_numpy())
    assert words.nbytes == 8 * 8 * 625 and passed[:20000].all() and passed[20000:].mean() < 0.005

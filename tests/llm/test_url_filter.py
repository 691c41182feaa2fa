"""URL filters against trying every rule on every URL."""

from __future__ import annotations

import random
import re

import pytest

from riskfold.llm import url_filter as uf
from riskfold.llm.queries import URL_RULES, op11_url_filter
from riskfold.llm.url_filter import Rule
from tests.conftest import SF_MID

UPPER_TO_LOWER = {i: i + 32 for i in range(65, 91)}


def plain(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
        host = host.translate(UPPER_TO_LOWER)
    hosts, patterns = [], []
    for r in rules:
        key = (len(r.rule), r.rule, r.verdict == "block", r.verdict)
        if not r.pattern:
            rule_host, slash, rule_path = r.rule.partition("/")
            rule_host = rule_host.translate(UPPER_TO_LOWER)
            if url is not None and (host == rule_host or host.endswith("." + rule_host)) and path.startswith(slash + rule_path):
                hosts.append(key)
        elif url is not None:
            small, text = url.translate(UPPER_TO_LOWER), r.rule.translate(UPPER_TO_LOWER)
            regex = "".join({"*": "(?s:.*)", "^": r"(?:[^a-z0-9]|\A|\Z)"}.get(c) or re.escape(c) for c in text)
            if re.search(regex, small):
                patterns.append(key)
    rule = max(hosts) if hosts else None
    pattern = max(patterns) if patterns and not hosts else None
    return host, path, rule and rule[1], (rule or pattern or [default])[-1], pattern and pattern[1]


def judged(df):
    return sorted((r.page_id, r.host, r.path, r.rule, r.verdict, r.pattern) for r in df.collect())


def test_all_pages(spark):
    rows = spark.read.parquet(f"{SF_MID}/pages.parquet").select("page_id", "url").collect()
    assert judged(op11_url_filter(spark, SF_MID)) == sorted((r.page_id, *plain(r.url, URL_RULES)) for r in rows)


ODD = [None, "", "http://", "://", "http://NET/x", "http://net", "http://a.net/?q", "http://evilnet/", "http://Example.NET/en/a",
       "http://example.net/EN/", "http://a.b.org/fr/", "://org/fr/x://net/", "http://net:80/", "http://\u00e9.net/\nx#f",
       "no scheme net/ spam", "http://x.test/spam", "http://x.test/spamming", "http://x.test/?a=SPAM&b", "http://\u0130.net/",
       "http://user@net/", "http://net?x/", "http://net#/en/", "http://[::1]/", "http://x.test/a.b+c(d)", "http://.net/", "http://net/" + "y" * 50_000,
       "http://x.test/ads/banner.js", "http://x.test/ads/deep/er/b.js", "http://example.net/en/", "http://example.net/en"]


@pytest.mark.parametrize("per_block", [3, 4000])
def test_odd_urls_and_rules(spark, monkeypatch, per_block):
    monkeypatch.setattr(uf, "RULES_PER_BLOCK", per_block)
    rules = [*URL_RULES, Rule("Net", "allow"), Rule("x.test/a.b+c(", "block"), Rule("*evil*", "block", True), Rule("^ads^*.js", "block", True),
             Rule("x.test/", "allow"), Rule("\u00e9.net/", "allow"), Rule("banner", "allow", True), Rule("net/", "allow")]
    rows = [(i % 20, u) for i, u in enumerate(ODD)] + [(None, "http://net/")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'clash' AS host", "1 AS rule", "2 AS tokens", "'x' AS small")
    key = lambda r: (r[0] is None, r[0] or 0, r[1:3], str(r[3:]))
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict, r.pattern) for r in uf.judge(df, rules).collect()]
    assert sorted(got, key=key) == sorted([(i, *plain(u, rules)) for i, u in rows], key=key)


def test_many_rules(spark):
    """Thousands of rules over random URLs: the index loses no fit."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    word = lambda: rng.choice(words)
    rules = [Rule(f"{word()}.{word()}/" + (f"{word()}/" if rng.random() < 0.5 else word()[:2]), rng.choice(["allow", "block"])) for _ in range(2000)]
    rules += [Rule(f"/{word()}*{word()}^", rng.choice(["allow", "block"]), True) for _ in range(300)]
    rules = list({r.rule: r for r in rules}.values())
    urls = [f"http://{word()}.{word()}.{word()}/{word()}/{word()}?{word()}={word()}" for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert judged(uf.judge(df, rules, "block")) == sorted((i, *plain(u, rules, "block")) for i, u in enumerate(urls))


def test_rarest_token_and_defined_cases(spark):
    assert uf.rule_tokens(Rule("a.Example.net/en/us", "block")) == ["a", "example", "net", "en"]
    assert uf.rule_tokens(Rule("net", "block")) == ["net"]
    assert uf.rule_tokens(Rule("^ads^*/banner*.js", "block", True)) == ["ads"]
    empty = spark.createDataFrame([], "page_id long, url string")
    assert uf.judge(empty, URL_RULES).count() == 0
    some = spark.createDataFrame([(1, "http://a/")], "page_id long, url string")
    assert judged(uf.judge(some, [], "block")) == [(1, "a", "/", None, "block", None)]
    with pytest.raises(ValueError):
        uf.judge(some, [Rule("a/", "maybe")])


def test_main_path_is_one_projection(spark):
    plan = op11_url_filter(spark, SF_MID)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Join", "Python", "Arrow", "from_json")) and "html" not in plan

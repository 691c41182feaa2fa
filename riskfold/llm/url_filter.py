"""URL filters: pattern rules found by their rarest literal token.

A rule is either a *host rule* (``example.net/en/``: its host and all
subdomains, on paths that start with the rule's) or a *pattern* over the whole
URL in small letters (``*`` any run of characters, ``^`` one character other
than a letter or digit, or an end of the URL; the rest literally).  The tokens
of a rule are the runs of ASCII letters and digits that a fitting URL must
hold as whole tokens.  How often each of these tokens occurs is counted over
all URLs, and a rule is filed under its rarest one.  A URL looks up its own
tokens; only the rules found there run their regular expression.  A rule
without any such token is a candidate of every URL.

All of it is DataFrame expressions.  The index of a block of rules is one
constant (an array of hash buckets), so judging is a single projection: no
join, no shuffle, and nothing that a hot host could fill.  Blocks hold
``RULES_PER_BLOCK`` rules at most; further blocks are further expressions of
the same projection, so a list of any length keeps the constants bounded.

The longest host rule that fits decides.  If none does, the longest pattern
that fits; if none does, ``default``.  Of equally long ones the last in byte
order decides; of two verdicts for one rule, ``block``.

Defined results: a null URL or one without ``://`` has an empty host and path,
so only patterns can fit it (a null URL: none).  An empty URL is judged like
any other.  Repeated rows and ids come back as often as they were given, a
null ``page_id`` stays null, an empty table gives an empty result, and columns
other than ``page_id`` and ``url`` are not looked at.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules in one constant of the plan (a few hundred bytes each).
RULES_PER_BLOCK = 4000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_INDEX = "array<array<struct<token: string, rule: string, size: int, block: boolean, host: boolean, regex: string>>>"


class Rule(NamedTuple):
    rule: str
    verdict: str            # "allow" or "block"
    pattern: bool = False   # a pattern instead of a host rule


#: Patterns for pages that no host rule decides.
SPAM_PATTERNS = [Rule(f"^{word}^", "block", True) for word in ("casino", "gambling", "pills", "porn", "spam", "xxx")]


def ascii_lower(text: str | Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII letters made small) and path of a URL."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1))
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def url_tokens(url: Column) -> Column:
    """The distinct tokens of a URL, and the empty one."""
    return F.array_distinct(F.concat(F.split(ascii_lower(url), "[^a-z0-9]+"), F.array(F.lit(""))))


def rule_tokens(rule: Rule) -> list[str]:
    """Tokens that every fitting URL holds."""
    text = rule.rule.translate(str.maketrans(_UPPER, _LOWER))
    if rule.pattern:
        return re.findall("(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])", text)
    return re.findall("(?<![a-z0-9])[a-z0-9]+(?=[^a-z0-9])", text if "/" in text else text + "/")


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", lambda m: rf"\x{{{ord(m[1]):x}}}", text)


def rule_regex(rule: Rule) -> str:
    """A host rule is matched on host and path in one string, a pattern on
    the URL in small letters."""
    if rule.pattern:
        text = rule.rule.translate(str.maketrans(_UPPER, _LOWER))
        return "(?s)" + "".join({"*": ".*", "^": "(?:[^a-z0-9]|\\A|\\z)"}.get(c) or _quoted(c) for c in text)
    host, slash, path = rule.rule.partition("/")
    host = host.translate(str.maketrans(_UPPER, _LOWER))
    return f"\\A(?:[^/]*\\.)?{_quoted(host)}" + (_quoted(slash + path) if slash else "(?:/|\\z)")


def token_counts(urls: DataFrame, tokens: set[str]) -> dict[str, int]:
    """In how many rows of ``url`` each of the rules' tokens occurs: a row for
    each of these tokens at most."""
    if not tokens:
        return {}
    wanted = F.broadcast(urls.sparkSession.createDataFrame([(t,) for t in sorted(tokens)], "token string"))
    found = urls.select(F.explode(url_tokens(F.col("url"))).alias("token")).join(wanted, "token").groupBy("token").count()
    return {r["token"]: r["count"] for r in found.collect()}


def _bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def _index(urls: DataFrame, rules: Sequence[Rule], counts: dict[str, int]) -> tuple[Column, int]:
    """The rules of a block as a constant: buckets of rules by their token,
    and how many."""
    filed = [(min(rule_tokens(r), key=lambda t: (counts.get(t, 0), t), default=""), r) for r in rules]
    buckets = 1 << len(filed).bit_length()
    tokens = urls.sparkSession.createDataFrame([(t,) for t in sorted({t for t, _ in filed})], "token string")
    at = {r["token"]: r["at"] for r in tokens.select("token", _bucket(F.col("token"), buckets).alias("at")).collect()}
    table: list[list[dict]] = [[] for _ in range(buckets)]
    for token, r in filed:
        table[at[token]].append({"token": token, "rule": r.rule, "size": len(r.rule), "block": r.verdict == "block",
                                 "host": not r.pattern, "regex": rule_regex(r)})
    return F.from_json(F.lit(json.dumps(table)), _INDEX), buckets  # folded once, when the plan is made


def _best(fits: Column, host: bool) -> Column:
    """The deciding one of the fitting rules of a kind."""
    kind = F.filter(fits, lambda c: c["host"] if host else ~c["host"])
    return F.array_max(F.transform(kind, lambda c: F.struct(c["size"], c["rule"], c["block"])))


def judge(pages: DataFrame, rules: Sequence[Rule], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (the host rule that decided), verdict, and
    pattern (the pattern that decided)."""
    wrong = [r for r in rules if r.verdict not in ("allow", "block")]
    if wrong:
        raise ValueError(f"a verdict is allow or block, not {wrong[0].verdict!r}")
    urls = pages.select("page_id", "url")
    counts = token_counts(urls, {t for r in rules for t in rule_tokens(r)})
    host, path = host_and_path(F.col("url"))
    rows = urls.select("page_id", host.alias("host"), path.alias("path"), ascii_lower(F.col("url")).alias("small"),
                       url_tokens(F.col("url")).alias("tokens"))
    fits = []
    for start in range(0, len(rules), RULES_PER_BLOCK):
        index, buckets = _index(urls, rules[start:start + RULES_PER_BLOCK], counts)
        candidates = F.flatten(F.transform("tokens", lambda t: F.filter(
            F.get(index, _bucket(t, buckets)), lambda c: c["token"] == t)))
        fits.append(F.filter(candidates, lambda c: F.regexp_like(
            F.when(c["host"], F.concat("host", "path")).otherwise(F.col("small")), c["regex"])))
    none = F.array().cast(_INDEX.removeprefix("array<").removesuffix(">"))
    fit = F.coalesce(F.concat(*fits), none) if fits else none
    rows = rows.select("page_id", "host", "path", fit.alias("fit"))
    rows = rows.select("page_id", "host", "path", _best(F.col("fit"), True).alias("h"), _best(F.col("fit"), False).alias("p"))
    blocked = F.coalesce(F.col("h.block"), F.col("p.block"), F.lit(default == "block"))
    return rows.select("page_id", "host", "path", F.col("h.rule").alias("rule"),
                       F.when(blocked, "block").otherwise("allow").alias("verdict"),
                       F.when(F.col("h").isNull(), F.col("p.rule")).alias("pattern"))

"""Thousands of rules of every kind against a run of each on each URL."""

import random
import re

import pytest
from keyloom.llm import url_filter
from keyloom.llm.url_filter import LISTED, PATTERNS, Rule, prefix_rule, word_rule

LETTERS = "abcdefghij"


def name(rng):
    return "".join(rng.choice(LETTERS) for _ in range(rng.randrange(1, 4)))


def url(rng):
    host = ".".join(rng.choice([name(rng), name(rng).upper(), f"{name(rng)}-{name(rng)}", "poker"]) for _ in range(rng.randrange(1, 4))) + rng.choice([".org", ".com", ".COM:80"])
    if rng.random() < 0.05:
        host = "10.0.7." + str(rng.randrange(256))
    path = "".join("/" + rng.choice([name(rng), name(rng) + ".php", "en", "ES", "cgi-bin", "x.zip", ""]) for _ in range(rng.randrange(0, 4)))
    query = rng.choice(["", "?", f"?{name(rng)}={name(rng)}/.org/", f"?replytocom={name(rng)}&sid=0123456789abcdef", f"?a=.{name(rng)}.com/"])
    return f"https://{host}{path}{query}" + rng.choice(["", "#top", "#/x.org/"])


def parts(u):
    if u is None or "://" not in u:
        return "", "", ""
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    query = re.match(r"(\?[^#]*)?", rest[len(host) + len(path) :]).group()
    lower = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return lower, path, query


def judge(u, rules):
    host, path, query = parts(u)
    fit = [r for r, regex in rules if regex.search(host + path + (query if r.query else ""))] if u is not None else []
    listed = max(((len(r.rule), r.rule, r.verdict) for r in fit if r.listed), default=None)
    pattern = max(((r.verdict == "block", r.rule, r.verdict) for r in fit if not r.listed), default=None)
    verdict = (listed or pattern or (0, "", "allow"))[2]
    return host, path, listed and listed[1], pattern and pattern[1], verdict


@pytest.mark.parametrize("broadcast", [True, False])
def test_equal_to_every_rule_on_every_url(spark, monkeypatch, broadcast):
    rng = random.Random(11 + broadcast)
    rules = {}
    while len(rules) < 2500:
        tokens = (name(rng), name(rng))
        rule = rng.choice(
            [
                prefix_rule(rng.choice(["allow", "block"]), f"{rng.choice(['', name(rng) + '.'])}{rng.choice(['org', 'com'])}/{rng.choice(['', name(rng), name(rng) + '/', 'ES/'])}"),
                word_rule(rng.choice(["allow", "block"]), *tokens[: rng.randrange(1, 3)]),
                Rule(f"p:{tokens[0]}", "block", rf"/{tokens[0]}(?:/|$)", tokens[:1]),
                Rule(f"q:{tokens}", "allow", rf"[?&]{tokens[0]}={tokens[1]}(?:[/&]|$)", tokens, query=True),
            ]
        )
        rules[rule.rule] = rule
    rules = [*rules.values(), *LISTED, *PATTERNS, Rule("z:always", "block", "[ab][cd]"), Rule("z:always-q", "allow", r"=[a-c]{2}/", query=True)]
    urls = [url(rng) for _ in range(300)] + [None, "", "nothing", "https://", "x://?", "https://" + "a" * 50_000 + ".org/" + "b/" * 20_000 + "x.zip"]
    urls += urls[:40]
    if not broadcast:
        monkeypatch.setattr(url_filter, "BROADCAST_RULES", 10)
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'t' AS tail", "'s' AS site", "1 AS salt", "'r' AS rule", "'h' AS host", "'k' AS token")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.pattern, r.verdict) for r in url_filter.filter_urls(pages, rules).collect())
    each = [(r, re.compile(r.regex)) for r in rules]
    want = sorted((i, *judge(u, each)) for i, u in enumerate(urls))
    assert got == want
    assert {"z:always", "path:archive", "host:address", "query:session"} <= {w[4] for w in want}


def test_no_rules_no_rows_and_bad_tokens(spark):
    pages = spark.createDataFrame([(1, "https://a.b/"), (2, None)], "page_id long, url string")
    assert [tuple(r) for r in url_filter.filter_urls(pages, []).select("host", "verdict").collect()] == [("a.b", "allow"), ("", "allow")]
    assert url_filter.filter_urls(pages.limit(0), [Rule("any", "block", ".")]).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, [Rule("any", "block", ".")]).collect()} == {"block", "allow"}
    with pytest.raises(ValueError, match="token"):
        Rule("bad", "block", "x", ("A-b",))

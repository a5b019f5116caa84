"""URL filters: pattern rules found through their rarest literal token.

A rule is a regular expression with the literal tokens that any URL it matches must hold whole.
The tokens of all URLs are counted once; each rule is indexed under its rarest one. A URL's own
tokens then fetch candidate rules by an equi-join, and only those candidates run their regular
expression. A rule without a token can be indexed nowhere: such rules are candidates of every URL,
under one of ``SALTS`` keys that each URL holds one of, so that no key has all of them. Every step
is a DataFrame operation.

A verdict depends on the URL alone, so distinct URLs are judged and joined back: one very common
URL costs one judgement, and the join back is one whose hot side Spark can split. A null URL, or
one without "://", has an empty host and path, matches no rule and is allowed; a repeated row is
repeated in the result. Very long URLs are read whole. Without rules, or without rows, every row
there is comes out allowed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.text import ascii_lower
from keyloom.sources import read_table

#: The rule table travels to every task up to this many rules; a longer list is joined by shuffle.
BROADCAST_RULES = 10_000
SALTS = 64
_TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """``rule`` names it; ``tokens`` are lower-cased literals, runs of a-z and 0-9 that stand whole in
    every URL it fits, none where there are no such. ``regex`` is searched in the host and path, with
    ``query`` also in ? and the query.

    A list rule (``listed``) beats every pattern rule; among list rules the longest name wins.
    """

    rule: str
    verdict: str
    regex: str
    tokens: tuple[str, ...] = ()
    listed: bool = False
    query: bool = False

    def __post_init__(self) -> None:
        if not all(map(_TOKEN.fullmatch, self.tokens)):
            raise ValueError(f"{self.rule}: a token that no URL can hold")


def prefix_rule(verdict: str, rule: str) -> Rule:
    """A rule such as ``example.org/es/``: that host and its subdomains, paths with that start."""
    host, slash, path = rule.partition("/")
    path = slash + path
    # The last token of a path may be the start of a longer one, unless a slash ends it.
    whole = path if path.endswith("/") else path.rpartition("/")[0]
    tokens = tuple(dict.fromkeys(_TOKEN.findall(host) + _TOKEN.findall(whole.lower())))
    return Rule(rule, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tokens, True)


def word_rule(verdict: str, *words: str) -> Rule:
    """Hosts with a label that holds ``words`` joined by hyphens."""
    return Rule("-".join(words), verdict, rf"^(?:[^/]*[.-])?{'-'.join(map(re.escape, words))}(?:[.-][^/]*)?(?:/|$)", tuple(words))


#: The host lists of the contract.
LISTED = [
    prefix_rule("allow", "org/"),
    prefix_rule("block", "example.org/es/"),
    prefix_rule("block", "example.org/en/1"),
    prefix_rule("allow", "com/fr/"),
    prefix_rule("block", "com/de/"),
]

#: Words of gambling, advertising, pharmacy and adult hosts.
PATTERNS = [
    word_rule("block", "casino"),
    word_rule("block", "poker"),
    word_rule("block", "bets"),
    word_rule("block", "betting"),
    word_rule("block", "pills"),
    word_rule("block", "viagra"),
    word_rule("block", "porn"),
    word_rule("block", "xxx"),
    word_rule("block", "adult"),
    word_rule("block", "ads"),
    word_rule("block", "adserver"),
    word_rule("block", "tracker"),
    word_rule("block", "torrent"),
    word_rule("block", "warez"),
    word_rule("block", "payday", "loans"),
]

#: Paths and queries of pages without prose of their own (log-in forms, endless
#: calendars, sessions, replies, archives, bare addresses).
PATTERNS += [
    Rule("path:login", "block", r"/(?:wp-login|xmlrpc)\.php$", ("php",)),
    Rule("path:cgi", "block", r"/cgi-bin/", ("cgi", "bin")),
    Rule("path:calendar", "block", r"/calendar/[0-9]{4}/[0-9]{2}(?:/|$)", ("calendar",)),
    Rule("path:casino-bonus", "block", r"/[^/]*(?:casino|poker)-bonus(?:[/.-]|$)", ("bonus",)),
    Rule("path:archive", "block", r"\.(?:zip|exe|apk|dmg|iso)$"),
    Rule("query:reply", "block", r"[?&]replytocom=", ("replytocom",), query=True),
    Rule("query:session", "block", r"[?&;](?:phpsessid|jsessionid|sid)=[0-9a-f]{16,}", query=True),
    Rule("query:affiliate", "block", r"[?&](?:affid|aff_id|affiliate_id)=", query=True),
    Rule("host:address", "block", r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?(?:/|$)"),
]


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_query(url: Column) -> Column:
    """? and what follows up to # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1), F.lit(""))


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != ""))


def rule_index(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """(token, rule, verdict, regex, listed, query): each rule under the rarest of its tokens in ``urls``,
    one without tokens under every salt."""
    spark = urls.sparkSession
    named = ["rule", "verdict", "regex", "listed", "query"]
    table = spark.createDataFrame([(r.rule, r.verdict, r.regex, list(r.tokens), r.listed, r.query) for r in rules], "rule string, verdict string, regex string, tokens array<string>, listed boolean, query boolean")
    wanted = table.select(F.explode("tokens").alias("token")).distinct()
    wanted = F.broadcast(wanted) if len(rules) <= BROADCAST_RULES else wanted
    seen = urls.select(F.explode("tokens").alias("token")).join(wanted, "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    each = table.select(*named, F.explode("tokens").alias("token")).join(seen, "token", "left")
    rarest = each.groupBy(*named).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("best"))
    always = table.where(F.size("tokens") == 0).distinct().select(F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), *named)
    return rarest.select(F.col("best.token").alias("token"), *named).union(always.select(F.concat(F.lit("#"), "salt"), *named))


def filter_urls(pages: DataFrame, rules: list[Rule], *, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (the list rule that won, or null), pattern and verdict.

    Columns of ``pages`` that have one of those names are replaced. Among pattern rules those that
    block win, then the last name.
    """
    pages = pages.drop(*[c for c in ("host", "path", "rule", "pattern", "verdict") if c != url_col])
    urls = pages.select(F.col(url_col).alias("_u")).where(F.col("_u").isNotNull()).distinct()
    urls = urls.select("_u", F.concat(url_host(F.col("_u")), url_path(F.col("_u"))).alias("site"), url_query(F.col("_u")).alias("tail"))
    urls = urls.withColumn("tokens", _tokens(F.concat_ws("/", "site", "tail")))
    index = rule_index(urls, rules)
    index = F.broadcast(index) if len(rules) <= BROADCAST_RULES else index
    held = F.col("tokens")
    if not all(r.tokens for r in rules):
        held = F.array_append(held, F.concat(F.lit("#"), F.pmod(F.xxhash64("_u"), F.lit(SALTS))))
    fetched = urls.select("_u", "site", "tail", F.explode(held).alias("token")).join(index, "token")
    fits = fetched.where(F.rlike(F.when(F.col("query"), F.concat("site", "tail")).otherwise(F.col("site")), F.col("regex")))
    longest = F.struct(F.length("rule").alias("n"), "rule", "verdict")
    won = fits.groupBy("_u").agg(
        F.max(F.when(F.col("listed"), longest)).alias("_list"),
        F.max(F.when(~F.col("listed"), F.struct((F.col("verdict") == "block").alias("blocks"), "rule", "verdict"))).alias("_pattern"),
    )
    out = pages.join(won, pages[url_col] == won["_u"], "left").drop("_u")
    return out.withColumns(
        {
            "host": url_host(F.col(url_col)),
            "path": url_path(F.col(url_col)),
            "rule": F.col("_list.rule"),
            "pattern": F.col("_pattern.rule"),
            "verdict": F.coalesce("_list.verdict", "_pattern.verdict", F.lit("allow")),
        }
    ).drop("_list", "_pattern")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, LISTED + PATTERNS).select("page_id", "host", "path", "rule", "verdict", "pattern")


def _oracle() -> str:
    """The same rules as plain SQL: every rule against every URL."""
    listed = ", ".join(f"('{r.rule}', '{r.verdict}', '{r.rule.partition('/')[0]}', '/{r.rule.partition('/')[2]}')" for r in LISTED)
    patterns = ", ".join(f"('{r.rule}', '{r.verdict}', '{r.regex}', {r.query})" for r in PATTERNS)
    return rf"""
WITH parts AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
    coalesce(regexp_extract(url, '^.*?://[^?#]*(\?[^#]*)', 1, 's'), '') AS tail,
    row_number() OVER () AS row_id
  FROM pages
), listed(rule, verdict, rhost, rpath) AS (VALUES {listed}),
patterns(rule, verdict, regex, query) AS (VALUES {patterns}),
won AS (
  SELECT row_id, max({{'n': length(rule), 'rule': rule, 'verdict': verdict}}) AS w FROM parts, listed
  WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY row_id
), hit AS (
  SELECT row_id, max({{'blocks': verdict = 'block', 'rule': rule, 'verdict': verdict}}) AS p FROM parts, patterns
  WHERE regexp_matches(host || path || CASE WHEN query THEN tail ELSE '' END, regex) GROUP BY row_id
)
SELECT page_id, host, path, w.rule AS rule, coalesce(w.verdict, p.verdict, 'allow') AS verdict, p.rule AS pattern
FROM parts LEFT JOIN won USING (row_id) LEFT JOIN hit USING (row_id)
"""


QUERIES = {"op6_url_filter": op6_url_filter}
ORACLES = {"op6_url_filter": _oracle()}

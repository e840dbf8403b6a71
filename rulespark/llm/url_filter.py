"""URL filters: pattern rules indexed by their rarest literal token.

A URL is cut into lower-case tokens ``[a-z0-9]+``. Each pattern rule lists literal tokens of which every match of its regular
expression holds all as whole tokens. The rule is filed under the one that the fewest URLs hold; the URL's tokens fetch the rules
filed under them, and only those run their regular expressions, in the order of the rules. Rules without literal tokens can't be indexed
and run on each URL; of those registered none is without.

Before the patterns, site rules (host suffix, path prefix) decide: they are filed by host, and a URL looks up its host and the hosts
above it. The longest that fits wins, on equal length the one with the longer host. A URL that neither decides is allowed.

Rows: one per input row. Null, empty and malformed URLs (no ``://``) have empty host and path; patterns still see a malformed URL's
text. Repeated rows stay repeated. Other columns, of whatever name, are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .common import map_rows, schema_of

TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class SiteRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """``regex`` runs on the lower-cased URL; ``literals`` are tokens that all its matches hold."""

    name: str
    verdict: str
    regex: str
    literals: tuple[str, ...]


SITE_RULES = (
    SiteRule("allow", "org", "/"),
    SiteRule("block", "example.org", "/es/"),
    SiteRule("block", "example.org", "/en/1"),
    SiteRule("allow", "com", "/fr/"),
    SiteRule("block", "com", "/de/"),
)

# Words that name spam trades, as whole tokens of the host.
PATTERN_RULES = (
    PatternRule("casino", "block", r"://[^/?#]*\bcasino\b", ("casino",)),
    PatternRule("free bets", "block", r"://[^/?#]*\bfree-bets\b", ("free", "bets")),
    PatternRule("cheap pills", "block", r"://[^/?#]*\bcheap-pills\b", ("cheap", "pills")),
    PatternRule("adult", "block", r"://[^/?#]*\bxxx\b", ("xxx",)),
    PatternRule("adult", "block", r"://[^/?#]*\bporn\b", ("porn",)),
    PatternRule("payday loans", "block", r"://[^/?#]*\bpayday-loan\b", ("payday", "loan")),
    PatternRule("payday loans", "block", r"://[^/?#]*\bpayday-loans\b", ("payday", "loans")),
    PatternRule("payday loans", "block", r"://[^/?#]*\bpaydayloan\b", ("paydayloan",)),
    PatternRule("payday loans", "block", r"://[^/?#]*\bpaydayloans\b", ("paydayloans",)),
    PatternRule("replica watches", "block", r"://[^/?#]*\breplica-watches\b", ("replica", "watches")),
    PatternRule("tracker pixel", "block", r"/(?:pixel|beacon)\.gif\b", ("gif",)),
)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or where ``://`` is missing."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), path


def token_counts(urls: DataFrame, url_col: str, wanted: set[str]) -> dict[str, int]:
    """How many URLs hold each of ``wanted``; the result has a row for each literal of the rules at most."""
    if not wanted:
        return {}
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.col(f"`{url_col}`")), F.lit("([a-z0-9]+)"), F.lit(1)))
    held = F.array_intersect(tokens, F.array(*[F.lit(w) for w in sorted(wanted)]))
    rows = urls.select(F.explode(held).alias("token")).groupBy("token").count().collect()
    return {r["token"]: r["count"] for r in rows}


def index_sites(sites: tuple[SiteRule, ...]) -> dict[str, list[SiteRule]]:
    """By host, the longest path first."""
    by_host: dict[str, list[SiteRule]] = {}
    for rule in sorted(sites, key=lambda r: -len(r.path)):
        by_host.setdefault(rule.host, []).append(rule)
    return by_host


def site_rule(by_host: dict[str, list[SiteRule]], host: str, path: str) -> SiteRule | None:
    best, at = None, host
    while True:
        own = next((r for r in by_host.get(at, ()) if path.startswith(r.path)), None)
        if own and (best is None or (len(own.name), len(own.host)) > (len(best.name), len(best.host))):
            best = own
        _, dot, at = at.partition(".")
        if not dot:
            return best


def index_rules(rules: tuple[PatternRule, ...], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Numbers of the rules by their rarest literal, and of those without one."""
    by_token: dict[str, list[int]] = {}
    rest = []
    for i, rule in enumerate(rules):
        if rule.literals:
            by_token.setdefault(min(rule.literals, key=lambda t: (counts.get(t, 0), t)), []).append(i)
        else:
            rest.append(i)
    return by_token, rest


def filter_urls(urls: DataFrame, id_col: str = "page_id", url_col: str = "url", sites: tuple[SiteRule, ...] = SITE_RULES, patterns: tuple[PatternRule, ...] = PATTERN_RULES) -> DataFrame:
    """``id``, ``host``, ``path``, ``rule`` (deciding site rule or null), ``verdict``, ``pattern`` (deciding pattern rule or null)."""
    counts = token_counts(urls, url_col, {t for r in patterns for t in r.literals})
    by_token, rest = index_rules(patterns, counts)
    by_host = index_sites(sites)
    compiled = [re.compile(r.regex) for r in patterns]

    def judge(key, url):
        host, path = split_url(url)
        if rule := site_rule(by_host, host, path):
            return key, host, path, rule.name, rule.verdict, None
        low = (url or "").lower()
        for i in sorted({i for t in TOKEN.findall(low) for i in by_token.get(t, ())}.union(rest)):
            if compiled[i].search(low):
                return key, host, path, None, patterns[i].verdict, patterns[i].name
        return key, host, path, None, "allow", None

    kind = urls.schema[id_col].dataType.simpleString()
    picked = urls.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"))
    return map_rows(picked, judge, schema_of(f"id {kind}, host string, path string, rule string, verdict string, pattern string"))

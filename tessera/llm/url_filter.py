"""URL filters: pattern rules found by their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(rb"[a-z0-9]+")
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Host and path rules, as verdict, host, path.
HOST_RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Filter patterns. * stands for anything, ^ for a separator or the end, || for the start of a host's label.
PATTERNS = ("||spam-farm^", "||cheap-pills^", "||casino^", "||free-prizes^", "||adult-chat^", "/click-bait/", "/doorway/*/index", "/affiliate/redirect^", "^sessionid=*^autogen=")


@dataclass(frozen=True)
class Rule:
    verdict: str
    name: str | None  # of host and path rules, which come before patterns
    regex: str
    tokens: tuple[bytes, ...]  # tokens that every url it fits contains whole
    length: int


def host_rule(verdict: str, host: str, path: str) -> Rule:
    # the path is a prefix: its last token may go on in the url
    sure = f"{host}{path}" if re.search(r"[^A-Za-z0-9]$", path) or not path else f"{host}{path}".rstrip("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    return Rule(verdict, host + path, rf"(?:[^/]*\.)?{re.escape(host)}" + (re.escape(path) if path else r"(?:/|$)"), tuple(_TOKEN.findall(sure.encode().lower())), len(host + path))


def pattern_rule(pattern: str, verdict: str = "block") -> Rule:
    body = pattern.removeprefix("||")
    regex = "".join({"*": ".*", "^": r"(?:[^a-z0-9_.%-]|\.|$)"}.get(c, re.escape(c)) for c in body)
    if pattern.startswith("||"):
        regex = r"^[^/?#]*://(?:[^/?#]*\.)?" + regex
    # a token counts only if a delimiter of the pattern itself stands on both sides
    edge = "^" if pattern.startswith("||") else "*"
    framed = f"{edge}{body}*"
    tokens = [m.group().encode() for m in re.finditer(r"[a-z0-9]+", framed) if framed[m.start() - 1] != "*" and framed[m.end()] != "*"]
    return Rule(verdict, None, regex, tuple(tokens), len(pattern))


class RuleIndex:
    """Rules by their rarest token; counts: how many urls hold a token (absent: none, the rarest)."""

    def __init__(self, rules: list[Rule], counts: dict[bytes, int]):
        self.by: dict[bytes, list[Rule]] = {}
        self.rest: list[Rule] = []
        self._compiled: dict[str, re.Pattern] = {}
        for rule in rules:
            slot = self.by.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []) if rule.tokens else self.rest
            slot.append(rule)

    def regex(self, rule: Rule) -> re.Pattern:
        """Compiled when the rule is first a candidate."""
        if (found := self._compiled.get(rule.regex)) is None:
            found = self._compiled[rule.regex] = re.compile(rule.regex, re.DOTALL)
        return found

    def judge(self, url: str | None, default: str = "allow") -> tuple[str, str, str | None, str, int]:
        """host, path, rule, verdict, number of rules whose regular expression ran."""
        m = _URL.search(url) if url else None
        host, path = (m.group(1).translate(_UPPER), m.group(2)) if m else ("", "")
        low = (url or "").translate(_UPPER)
        found = [*self.rest]
        for token in set(_TOKEN.findall(low.encode("utf-8", "surrogatepass"))):
            found += self.by.get(token, ())
        named = pattern = None
        for rule in found:
            if rule.name is not None:
                if m and (named is None or rule.length > named.length) and self.regex(rule).match(host + path):
                    named = rule
            elif (pattern is None or (rule.length, rule.verdict) > (pattern.length, pattern.verdict)) and self.regex(rule).search(low):
                pattern = rule
        best = named or pattern
        return host, path, named.name if named else None, best.verdict if best else default, len(found)


def default_rules() -> list[Rule]:
    return [host_rule(*r) for r in HOST_RULES] + [pattern_rule(p) for p in PATTERNS]


def token_counts(pages: DataFrame, rules: list[Rule], url: str = "url") -> dict[bytes, int]:
    """In how many urls each token of the rules occurs, over all pages; as many rows as the rules have tokens at most."""
    known = sorted({t.decode() for r in rules for t in r.tokens})
    tokens = F.array_intersect(F.split(F.lower(F.col(url)), "[^a-z0-9]+"), F.array(*[F.lit(t) for t in known]))
    rows = pages.select(F.explode(tokens).alias("t")).groupBy("t").count().collect()
    return {r["t"].encode(): r["count"] for r in rows}


def filter_urls(pages: DataFrame, rules: list[Rule] | None = None, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict and n_candidates for every row of pages, in one narrow pass.

    Host and path rules go first, the longest that fits wins; then filter patterns, the longest again; else allow. A
    null url or one without :// has an empty host and path, and patterns still look at it. Rows are judged each on its
    own, so repeated rows give repeated results and an empty table none."""
    rules = default_rules() if rules is None else rules
    # its size is that of the rules, which don't grow with the pages
    shared = pages.sparkSession.sparkContext.broadcast(RuleIndex(rules, token_counts(pages, rules, url)))
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            host, path, rule, verdict, n = ([*x] for x in zip(*map(index.judge, b.column(1).to_pylist()), strict=True)) if b.num_rows else ([],) * 5
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(n, pa.int64())], ["key", "host", "path", "rule", "verdict", "n_candidates"])

    return pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url")).mapInArrow(run, f"key {kind}, host string, path string, rule string, verdict string, n_candidates long").withColumnRenamed("key", key)


ORACLE_SQL = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, position('://' IN coalesce(url, '')) AS p FROM pages),
s AS (SELECT page_id, url, CASE WHEN p > 0 THEN substr(url, p + 3) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, url, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM s),
x AS (SELECT page_id, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
  translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT *, CASE
  WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/7') THEN 'example.com/en/7'
  WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/de/8') THEN 'example.net/de/8'
  WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/en/') THEN 'com/en/'
  WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/de/') THEN 'net/de/'
  WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM x)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(low, '^[^/?#]*://([^/?#]*[.])?(spam-farm|cheap-pills|casino|free-prizes|adult-chat)([^a-z0-9_.%-]|[.]|$)') THEN 'block'
  WHEN regexp_matches(low, '/click-bait/|/doorway/.*/index|/affiliate/redirect([^a-z0-9_.%-]|[.]|$)|([^a-z0-9_.%-]|[.])sessionid=.*([^a-z0-9_.%-]|[.])autogen=') THEN 'block'
  ELSE 'allow' END AS verdict FROM r
"""

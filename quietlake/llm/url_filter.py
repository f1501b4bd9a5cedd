"""URL filter: host and path rules first, then a weighted vocabulary found by Aho-Corasick.

The vocabulary is a versioned table, ``url_terms.tsv``, of strict and soft terms in several
languages with their weights; a caller may pass another.
"""

from __future__ import annotations

import csv
import functools
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

#: So many different soft terms reject a URL, if their weights come to as much; a strict one always does.
SOFT_HITS = 2


@functools.cache
def terms() -> tuple[tuple[str, str, float], ...]:
    """Term, kind (strict or soft) and weight, from the table. Read by the driver alone."""
    with Path(__file__).with_name("url_terms.tsv").open(newline="") as f:
        rows = csv.DictReader((x for x in f if not x.startswith("#")), delimiter="\t")
        return tuple((r["term"], r["kind"], float(r["weight"])) for r in rows)


#: (verdict, rule); a rule is a host and the start of a path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def host_path(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    ends = [i for c in "/?#" if (i := rest.find(c)) >= 0]
    cut = min(ends, default=len(rest))
    path = rest[cut:]
    ends = [i for c in "?#" if (i := path.find(c)) >= 0]
    host = rest[:cut].encode().translate(common.LOWER).decode()
    return host, path[: min(ends, default=len(path))]


def rule_for(host: str, path: str, rules=RULES) -> tuple[str, str] | None:
    """The longest rule (by its text) for the host or a domain above it whose path starts the path."""
    best = None
    for verdict, rule in rules:
        top, slash, rest = rule.partition("/")
        if (host == top or host.endswith("." + top)) and path.startswith(slash + rest) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return best


class Vocabulary:
    """Strict and soft terms, found where no letter or digit touches them."""

    def __init__(self, of: tuple[tuple[str, str, float], ...], soft_hits: int = SOFT_HITS) -> None:
        import ahocorasick

        self.soft_hits = soft_hits
        self.automaton = ahocorasick.Automaton()
        for term, kind, weight in of:
            self.automaton.add_word(term, (term, kind, weight))
        if of:
            self.automaton.make_automaton()
        self.empty = not of

    def hits(self, url: str) -> tuple[set[str], dict[str, float]]:
        """The different strict terms, and the soft ones with their weights."""
        strict, soft = set(), {}
        if self.empty:
            return strict, soft
        line = url.encode("utf-8", "replace").translate(common.LOWER).decode()
        for end, (term, kind, weight) in self.automaton.iter(line):
            start = end + 1 - len(term)
            before, after = line[start - 1 : start] if start else "", line[end + 1 : end + 2]
            if _alnum(before) or _alnum(after):
                continue
            if kind == "strict":
                strict.add(term)
            else:
                soft[term] = weight
        return strict, soft

    def judged(self, url: str) -> tuple[bool, int, int]:
        """Whether the URL is rejected, and its numbers of strict and soft hits."""
        strict, soft = self.hits(url)
        return bool(strict) or len(soft) >= self.soft_hits and sum(soft.values()) >= self.soft_hits, len(strict), len(soft)


def _alnum(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


NEW = [T.StructField("host", T.StringType(), False), T.StructField("path", T.StringType(), False), T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType(), False), T.StructField("strict_hits", T.IntegerType(), False), T.StructField("soft_hits", T.IntegerType(), False)]


def judge_urls(pages: DataFrame, rules=RULES, vocabulary: tuple[tuple[str, str, float], ...] | None = None, soft_hits: int = SOFT_HITS) -> DataFrame:
    """``pages(page_id, url)`` with host, path, rule, verdict, strict_hits and soft_hits.

    A null or empty URL, or one without ``://``, has empty host and path; no rule fits it and
    the vocabulary is applied to its text, so null is allowed. Repeated rows are judged alike.
    Only the two columns are read; an empty table gives no rows.
    """

    listed = terms() if vocabulary is None else vocabulary

    def make():
        found = Vocabulary(listed, soft_hits)

        def work(_: pa.RecordBatch, urls: list[bytes]) -> list:
            out: list[list] = [[] for _ in NEW]
            for raw in urls:
                url = raw.decode("utf-8", "replace")
                host, path = host_path(url)
                rule = rule_for(host, path, rules)
                rejected, a, b = found.judged(url)
                verdict = rule[0] if rule else "block" if rejected else "allow"
                for to, x in zip(out, (host, path, rule and rule[1], verdict, a, b), strict=True):
                    to.append(x)
            return out

        return work

    return common.map_text(pages.select("page_id", "url"), "url", make, NEW).drop("url")


def sql() -> str:
    """The same verdicts in SQL, from the rules and the table above."""
    strict = [t for t, kind, _ in terms() if kind == "strict"]
    soft = [(t, w) for t, kind, w in terms() if kind == "soft"]
    low = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    found = lambda t: f"regexp_matches({low}, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::INT"
    fits = lambda r: f"(host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}')"
    longest = sorted(RULES, key=lambda x: -len(x[1]))
    return f"""
WITH p AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, url, regexp_extract(rest, '^[^/?#]*') AS host0, regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM p),
g AS (SELECT page_id, url, translate(host0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path,
      {' + '.join(map(found, strict))} AS strict_hits, {' + '.join(found(t) for t, _ in soft)} AS soft_hits,
      {' + '.join(f"{w} * {found(t)}" for t, w in soft)} AS soft_weight FROM h)
SELECT page_id, host, path, CASE {' '.join(f"WHEN {fits(r)} THEN '{r}'" for _, r in longest)} END AS rule,
       CASE {' '.join(f"WHEN {fits(r)} THEN '{v}'" for v, r in longest)} WHEN strict_hits > 0 OR soft_hits >= {SOFT_HITS} AND soft_weight >= {SOFT_HITS} THEN 'block' ELSE 'allow' END AS verdict,
       strict_hits::INT AS strict_hits, soft_hits::INT AS soft_hits
FROM g"""

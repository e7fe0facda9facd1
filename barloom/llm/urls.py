"""URL filters: host and path rules, then a weighted vocabulary found by Aho-Corasick."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import ascii_lower

# Fixed values: (verdict, host, path); a rule holds for its host and all subdomains.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
# Terms that reject alone, and terms of which several distinct ones reject.
STRICT = ["casino", "adult", "porn", "xxx", "pills", "viagra", "escort", "warez"]
SOFT = ["free", "bets", "bet", "win", "cheap", "spam", "farm", "ads", "track", "bonus", "poker", "sex", "loan", "discount"]
SOFT_LIMIT = 2  #: distinct soft terms that reject


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://`` up to ``/ ? #``, A-Z lower-cased; then up to ``? #``. No ``://`` or null: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text (host + path) and verdict of the longest rule that fits, else nulls; equally long rules: the first listed."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def term_hits(strict: list[str], soft: list[str]):
    """UDF: strict hits, soft hits and distinct soft terms of a lower-cased URL. A hit has no ASCII letter or digit on either side."""
    words = [(w, 0) for w in strict] + [(w, 1) for w in soft if w not in set(strict)]
    edge = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")

    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine = ahocorasick.Automaton()
        for w, kind in words:
            machine.add_word(w, (w, kind))
        if words:
            machine.make_automaton()
        for urls in batches:
            out = []
            for u in urls:
                counts, seen = [0, 0], set()
                for end, (w, kind) in machine.iter(u) if u and words else ():
                    start = end - len(w)
                    if (start < 0 or u[start] not in edge) and (end + 1 == len(u) or u[end + 1] not in edge):
                        counts[kind] += 1
                        if kind:
                            seen.add(w)
                out.append((counts[0], counts[1], len(seen)))
            yield pd.DataFrame(out, columns=["strict", "soft", "distinct_soft"])

    return F.pandas_udf(hits, "strict long, soft long, distinct_soft long")


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, strict=STRICT, soft=SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """(key, host, path, rule, verdict, strict_hits, soft_hits, distinct_soft) for every row.

    The longest fitting rule decides; without one a URL is blocked at one strict hit or ``soft_limit`` distinct soft terms. A null URL has
    empty host and path, no hits and is allowed; null or repeated keys keep their rows; other columns are not read.
    """
    d = pages.select(F.col(key).alias("key"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"))
    host, path = host_and_path(F.col("url"))
    d = d.select("key", host.alias("host"), path.alias("path"), term_hits(strict, soft)(ascii_lower(F.col("url"))).alias("hit"))
    name, ruled = longest_rule(F.col("host"), F.col("path"), rules)
    method = F.when((F.col("hit.strict") >= 1) | (F.col("hit.distinct_soft") >= soft_limit), "block").otherwise("allow")
    return d.select(F.col("key").alias(key), "host", "path", name.alias("rule"), F.coalesce(ruled, method).alias("verdict"), F.col("hit.strict").alias("strict_hits"),
                    F.col("hit.soft").alias("soft_hits"), F.col("hit.distinct_soft").alias("distinct_soft"))


def sql(rules=RULES, strict=STRICT, soft=SOFT, soft_limit: int = SOFT_LIMIT) -> str:
    """DuckDB text over ``pages``."""
    has = lambda w: f"regexp_matches(u, '(^|[^a-z0-9]){w}([^a-z0-9]|$)')"
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    by_length = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    name = " ".join(f"WHEN {fits(h, p)} THEN '{h + p}'" for _, h, p in by_length)
    ruled = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in by_length)
    count = lambda ws: " + ".join(f"(CASE WHEN {has(w)} THEN 1 ELSE 0 END)" for w in ws)
    low = f"translate({{}}, '{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'}', '{'abcdefghijklmnopqrstuvwxyz'}')"
    return f"""WITH a AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
b AS (SELECT page_id, {low.format('url')} AS u, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM a),
c AS (SELECT page_id, u, {low.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM b)
SELECT page_id, host, path, CASE {name} END AS rule,
CASE {ruled} WHEN ({count(strict)}) >= 1 OR ({count(soft)}) >= {soft_limit} THEN 'block' ELSE 'allow' END AS verdict FROM c"""

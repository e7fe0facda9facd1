"""Quality rules as a bitmask ledger.

Every text is measured once and every rule judged once; the ledger keeps the measurements and one long whose bits are the rules that failed. A
policy is a version, a mask and the number of its rules that may fail: applying one, changing one or comparing two is bit arithmetic on the ledger,
texts are not read again. Ablations group the ledger by the failed bits within a mask, at most one row for each pattern that occurs, and follow from
those counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bullet_lines", "n_cut_lines", "n_letter_words", "longest_word")
WINDOW = 3  #: words of a repeated window
SPACES = " \t\n\v\f\r"
_symbols = regex.compile(r"[#*$%&|<>]")
_letter = regex.compile(r"\p{L}")


class Shapes(dict):
    """(code points, whether it holds a letter) of each word seen by this worker; the cache only spares work."""

    def __missing__(self, word: bytes) -> tuple[int, bool]:
        if len(self) > 300_000:
            self.clear()
        w = word.decode()
        self[word] = found = (len(w), _letter.search(w) is not None)
        return found


_shapes = Shapes()


@dataclass(frozen=True)
class Rule:
    """A named test of the measurements; ``fails`` is SQL over them that is never null. ``bit`` is its place in the ledger, never reused."""

    bit: int
    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    """A version: texts with more than ``allowed`` failed rules of ``soft``, or any of ``hard``, go. Both hold rule names."""

    version: str
    hard: tuple[str, ...]
    soft: tuple[str, ...] = ()
    allowed: int = 0


# The first two rules are the base, the others use whole numbers so that every engine decides alike.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "many_words", "n_words > 1000000"),
    Rule(3, "short_words", "word_chars < 2 * n_words"),
    Rule(4, "long_words", "word_chars > 14 * n_words"),
    Rule(5, "symbols", "10 * n_symbols > n_words"),
    Rule(6, "repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule(7, "bullets", "100 * n_bullet_lines > 90 * n_lines"),
    Rule(8, "cut_lines", "100 * n_cut_lines > 30 * n_lines"),
    Rule(9, "few_letters", "100 * n_letter_words < 70 * n_words"),
    Rule(10, "unbroken_run", "longest_word > 1000"),
)
BASE = ("few_words", "repeated_words")
POLICIES = (
    Policy("base", BASE),
    Policy("v1", (*BASE, "many_words", "short_words", "long_words", "symbols", "repeated_lines", "bullets", "cut_lines", "few_letters", "unbroken_run")),
    Policy("v2", (*BASE, "symbols", "few_letters"), ("many_words", "short_words", "long_words", "repeated_lines", "bullets", "cut_lines", "unbroken_run"), 1),
)
CURRENT = "v2"


def measure(text: str) -> tuple[int, ...]:
    """``MEASURES`` of one whole text; windows are compared by their words, not by hashes."""
    words = text.encode().split()
    n = len(words)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    repeated = 0
    if n > WINDOW:
        window = ids
        for step in range(1, WINDOW):  # number the runs of 2, then 3 words
            window = np.unique(window[:-1] * len(number) + ids[step:], return_inverse=True)[1]
        twice = np.bincount(window)[window] > 1
        covered = np.zeros(n, dtype=bool)
        for step in range(WINDOW):
            covered[step:n - WINDOW + 1 + step] |= twice
        repeated = int(covered.sum())
    shapes = [_shapes[w] for w in number]
    lettered = np.array([has for _, has in shapes], dtype=np.int64)
    lines = Counter(line for line in text.split("\n") if line.strip(SPACES))
    shown = [(line.strip(SPACES), c) for line, c in lines.items()]
    n_lines = sum(lines.values())
    return (n, len(text) - sum(map(text.count, SPACES)), len(_symbols.findall(text)), n_lines - len(lines), repeated, n_lines,
            sum(c for s, c in shown if s.startswith(("-", "*", "•"))), sum(c for s, c in shown if s.endswith(("...", "…"))),
            int((np.bincount(ids, minlength=len(number)) * lettered).sum()), max((size for size, _ in shapes), default=0))


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, measurements) of every row."""
    src = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measure(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(MEASURES)))], names=["key", *MEASURES])

    kind = src.schema[0].dataType.simpleString()
    return src.mapInArrow(run, f"key {kind}, " + ", ".join(f"{m} long" for m in MEASURES)).withColumnRenamed("key", key)


def mask(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    bits = {r.name: r.bit for r in rules}
    return sum(1 << bits[n] for n in set(names))


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, measurements, failed): one row for every row of ``docs``; bit b of ``failed`` is set where the rule of bit b fails.

    A null text counts as empty: all measurements are 0, so that only rules on counts fail. Null and repeated keys keep their rows; other columns
    are not read; an empty table gives an empty ledger. At most 63 rules, each with a bit of its own.
    """
    if len({r.bit for r in rules}) < len(rules) or any(not 0 <= r.bit < 63 for r in rules):
        raise ValueError("every rule needs a bit of its own from 0 to 62")
    failed = F.lit(0).cast("long")
    for r in rules:
        failed = failed.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return measured(docs, key, text).withColumn("failed", failed)


def keeps(policy: Policy, rules: tuple[Rule, ...] = RULES, failed: Column | str = "failed") -> Column:
    """Whether a policy keeps a row of the ledger."""
    c = F.col(failed) if isinstance(failed, str) else failed
    within = lambda names: c.bitwiseAND(F.lit(mask(names, rules)).cast("long"))
    return (within(policy.hard) == 0) & (F.bit_count(within(policy.soft)) <= policy.allowed)


def verdicts(book: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with one column ``keep_<version>`` a policy."""
    return book.select("*", *(keeps(p, rules).alias(f"keep_{p.version}") for p in policies))


def ablations(book: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(version, rule, n_failed, n_alone, n_kept, n_kept_without): for each rule of each policy, rows that fail it, rows that go by it alone (they
    stay without it), and rows kept with and without it. An empty ledger gives zeros."""
    every = sum(1 << r.bit for r in rules)
    patterns = book.groupBy(F.col("failed").bitwiseAND(F.lit(every).cast("long")).alias("failed")).agg(F.count("*").alias("n"))  # map-side; as many rows as patterns
    parts = []
    for p in policies:
        for r in rules:
            if r.name in (*p.hard, *p.soft):
                less = Policy(p.version, tuple(n for n in p.hard if n != r.name), tuple(n for n in p.soft if n != r.name), p.allowed)
                parts.append(F.struct(F.lit(p.version).alias("version"), F.lit(r.name).alias("rule"), (F.col("failed").bitwiseAND(F.lit(1 << r.bit).cast("long")) != 0).alias("fails"),
                                      keeps(p, rules).alias("with"), keeps(less, rules).alias("without")))
    names = book.sparkSession.createDataFrame([(p.version, r.name) for p in policies for r in rules if r.name in (*p.hard, *p.soft)], "version string, rule string")
    each = patterns.select("n", F.explode(F.array(*parts)).alias("p")).select("n", "p.*")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n")).otherwise(0)), F.lit(0)).alias
    sums = each.groupBy("version", "rule").agg(total(F.col("fails"))("n_failed"), total(~F.col("with") & F.col("without"))("n_alone"), total(F.col("with"))("n_kept"), total(F.col("without"))("n_kept_without"))
    return names.join(sums, ["version", "rule"], "left").na.fill(0)


def decided(docs: DataFrame, version: str = CURRENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, measurements, failed, base_failed, kept) of every row by one policy version; a row that fails the base is never kept."""
    book = ledger(docs, key=key, text=text)
    policy = next(p for p in POLICIES if p.version == version)
    base = ~keeps(next(p for p in POLICIES if p.version == "base"))
    return book.withColumn("base_failed", base).withColumn("kept", ~base & keeps(policy))


def sql() -> str:
    """DuckDB twin of ``decided``."""
    policy, base = next(p for p in POLICIES if p.version == CURRENT), next(p for p in POLICIES if p.version == "base")
    failed = " | ".join(f"(CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END)" for r in RULES)
    ok = lambda p: f"failed & {mask(p.hard)} = 0 AND bit_count(failed & {mask(p.soft)}) <= {p.allowed}"
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: {{'i': i, 's': hash(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])}})) AS g FROM d WHERE len(w) > 2),
g3 AS (SELECT doc_id, list(g.i) AS i FROM g GROUP BY doc_id, g.s HAVING count(*) > 1),
gi AS (SELECT doc_id, unnest(i) AS i FROM g3),
rw AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM gi, (VALUES (0), (1), (2)) s(k) GROUP BY 1),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
lw AS (SELECT doc_id, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (regexp_matches(s, '^[-*•]')) AS n_bullet_lines,
 count(*) FILTER (regexp_matches(s, '(\.\.\.|…)$')) AS n_cut_lines FROM lw GROUP BY 1),
m AS (SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
 coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_bullet_lines, 0) AS n_bullet_lines,
 coalesce(n_cut_lines, 0) AS n_cut_lines, len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words, coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS longest_word
 FROM d LEFT JOIN rw USING (doc_id) LEFT JOIN ln USING (doc_id)),
f AS (SELECT *, {failed} AS failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, CAST(failed AS BIGINT) AS failed,
 NOT ({ok(base)}) AS base_failed, ({ok(base)}) AND ({ok(policy)}) AS kept FROM f"""

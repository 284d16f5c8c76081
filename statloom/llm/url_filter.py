"""URL filters: pattern rules indexed by their rarest literal token.

Each rule names the literal tokens every matching URL must hold. One aggregation over all URLs counts
how often those literals occur; a rule is filed under its rarest one. A URL's own tokens then fetch
the rules filed under them from a hash index, and only the fetched rules run their regular
expression. The index is a constant of the plan, bounded by the caller's list of rules, so URLs are
judged where they are read: no shuffle, no join, and a host that holds a third of all rows costs no
more than any other.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from statloom.llm.text import lower_ascii

TOKEN_BREAK = r"[^0-9A-Za-z]+"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched against host + path; ``weight`` decides between several that fit."""

    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    weight: int


def path_rule(host: str, path: str, verdict: str) -> Rule:
    """A rule for a host with all subdomains and every path that starts with ``path``; longest wins."""
    tokens = [t for t in re.split(TOKEN_BREAK, host) if t]
    whole = path if path.endswith("/") else path.rpartition("/")[0]
    tokens += [t for t in re.split(TOKEN_BREAK, whole) if t]
    return Rule(host + path, verdict, f"^([^/]*\\.)?{re.escape(host)}{re.escape(path)}", tuple(tokens), len(host + path))


def word_rule(name: str, pattern: str, literals: Sequence[str], verdict: str = "block") -> Rule:
    """A rule on the URL's wording; path rules, which are explicit, go before it."""
    return Rule(name, verdict, pattern, tuple(literals), 0)


# Explicit host and path rules.
PATH_RULES = (
    path_rule("org", "/", "allow"),
    path_rule("example.org", "/es/", "block"),
    path_rule("example.org", "/en/1", "block"),
    path_rule("com", "/fr/", "allow"),
    path_rule("com", "/de/", "block"),
)

# Hosts and paths whose wording marks unwanted pages.
WORD_RULES = (
    word_rule("w-adult", r"(^|[^0-9a-z])adult[^0-9a-z]", ["adult"]),
    word_rule("w-casino", r"(^|[^0-9a-z])casino([^0-9a-z]|$)", ["casino"]),
    word_rule("w-bets", r"(^|[^0-9a-z])free[^0-9a-z]bets([^0-9a-z]|$)", ["free", "bets"]),
    word_rule("w-spam", r"(^|[^0-9a-z])spam[^0-9a-z]", ["spam"]),
    word_rule("w-pills", r"(^|[^0-9a-z])cheap[^0-9a-z]pills([^0-9a-z]|$)", ["cheap", "pills"]),
    word_rule("w-ads", r"(^|[^0-9a-z])ads[^0-9a-z]track([^0-9a-z]|$)", ["ads", "track"]),
    word_rule("w-porn", r"(^|[^0-9a-z])porn([^0-9a-z]|$)", ["porn"]),
    word_rule("w-xxx", r"(^|[^0-9a-z])xxx([^0-9a-z]|$)", ["xxx"]),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path; both empty without ``://`` or if null."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return host, path


def _tokens(key: Column) -> Column:
    return F.array_distinct(F.split(key, TOKEN_BREAK))


def literal_counts(urls: DataFrame, rules: Sequence[Rule], url_column: str = "url") -> dict[str, int]:
    """In how many URLs each literal of the rules stands; counts of all rows, one row a literal."""
    literals = sorted({t for r in rules for t in r.literals})
    host, path = url_parts(F.col(f"`{url_column}`"))
    words = F.filter(_tokens(F.lower(F.concat(host, path))), lambda t: t.isin(literals))
    counted = urls.select(F.explode(words).alias("token")).groupBy("token").count()
    return {t: 0 for t in literals} | {r["token"]: r["count"] for r in counted.collect()}


def judge_urls(
    urls: DataFrame,
    rules: Sequence[Rule] = PATH_RULES + WORD_RULES,
    url_column: str = "url",
    default: str = "allow",
) -> DataFrame:
    """The rows with the columns host, path, rule and verdict put in place of any of these names.

    ``rule`` is the name of the fitting path rule with the greatest weight (then the smallest name),
    null if none fits; ``fits`` names every fitting rule. Without a path rule the verdict is block if a
    wording rule blocks, else ``default``. Null and empty URLs and those without ``://`` have empty
    host and path, fit no path rule and get the default; repeated rows are each judged.
    """
    counts = literal_counts(urls, rules, url_column)
    rarest = [min(r.literals, key=lambda t: (counts[t], t)) for r in rules]
    buckets = max(1, 2 * len(rules))
    filed: list[list[int]] = [[] for _ in range(buckets)]
    spark = urls.sparkSession
    placed = spark.range(1).select(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(buckets)) for t in rarest]).first()
    for number, bucket in enumerate(placed or ()):
        filed[bucket].append(number)
    entry = "array<struct<number: int, token: string, name: string, verdict: string, pattern: string, weight: int>>"

    def constant(numbers: list[int]) -> Column:
        entries = [
            F.struct(
                F.lit(n).alias("number"),
                F.lit(rarest[n]).alias("token"),
                F.lit(rules[n].name).alias("name"),
                F.lit(rules[n].verdict).alias("verdict"),
                F.lit(rules[n].pattern).alias("pattern"),
                F.lit(rules[n].weight).alias("weight"),
            )
            for n in numbers
        ]
        return F.array(*entries).cast(entry)

    index = F.array(*[constant(numbers) for numbers in filed])
    host, path = url_parts(F.col(f"`{url_column}`"))
    fresh = ("host", "path", "rule", "verdict", "fits")
    kept = [F.col(f"`{c}`") for c in urls.columns if c not in fresh or c == url_column]
    key = F.col("__key")
    fetched = F.flatten(
        F.transform(
            _tokens(F.lower(key)),
            lambda t: F.filter(
                F.element_at(index, (F.pmod(F.xxhash64(t), F.lit(buckets)) + 1).cast("int")),
                lambda r: r["token"] == t,
            ),
        )
    )
    fitting = F.filter(fetched, lambda r: F.rlike(F.when(r["weight"] > 0, key).otherwise(F.lower(key)), r["pattern"]))
    ranked = F.array_sort(
        F.transform(
            F.filter(F.col("__fits"), lambda r: r["weight"] > 0),
            lambda r: F.struct((-r["weight"]).alias("order"), r["name"].alias("name"), r["verdict"].alias("verdict")),
        )
    )
    wording = F.exists(F.col("__fits"), lambda r: (r["weight"] == 0) & (r["verdict"] == "block"))
    return (
        urls.select(*kept, host.alias("__host"), path.alias("__path"))
        .withColumn("__key", F.concat("__host", "__path"))
        .withColumn("__fits", fitting)
        .withColumn("__best", F.get(ranked, F.lit(0)))
        .select(
            *kept,
            F.col("__host").alias("host"),
            F.col("__path").alias("path"),
            F.col("__best.name").alias("rule"),
            F.coalesce(F.col("__best.verdict"), F.when(wording, "block").otherwise(default)).alias("verdict"),
            F.array_sort(F.array_distinct(F.transform("__fits", lambda r: r["name"]))).alias("fits"),
        )
    )


def verdict_sql(view: str, rules: Sequence[Rule] = PATH_RULES + WORD_RULES, default: str = "allow") -> str:
    """The same judgement as plain SQL: every rule against every URL of ``view`` (page_id, url)."""

    def test(rule: Rule) -> str:
        key = "host || path" if rule.weight else "lower(host || path)"
        return f"regexp_matches({key}, '{rule.pattern}')"

    explicit = sorted((r for r in rules if r.weight), key=lambda r: (-r.weight, r.name))
    names = " ".join(f"WHEN {test(r)} THEN '{r.name}'" for r in explicit)
    verdicts = " ".join(f"WHEN {test(r)} THEN '{r.verdict}'" for r in explicit)
    wording = " OR ".join(test(r) for r in rules if not r.weight and r.verdict == "block") or "false"
    return f"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM {view}),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '(?s)^[^/?#]*(/[^?#]*)', 1) AS path FROM cut)
SELECT page_id, host, path, CASE {names} END AS rule,
  CASE {verdicts} WHEN {wording} THEN 'block' ELSE '{default}' END AS verdict FROM parts"""

"""URL filter by rules and a Bloom filter cascade (operator 5).

The first level holds the listed keys; the next holds the keys of the corpus
that the level before took for listed by mistake, and so on, until no key of
the corpus is mistaken. As the corpus's complete key universe went through
every level, membership of its keys is exact, and a row is tested against a
few bitmaps instead of a join. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import cut_lineage
from shoplens.llm.decontamination import LOWER, UPPER

BITS_PER_KEY = 10
HASHES = 5
MAX_KEYS = 5_000_000      # at most 6.25 MB a level; beyond, keys are joined instead

# fixed values: verdict, host, path of the rules
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
LISTED_TERMS = ("spam", "pills", "casino", "malware")
LISTED_MARKS = ("###", "***", "$$$")  # a page with all of them is taken for machine-made


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, else nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, what).otherwise(verdict)
    return text, verdict


@dataclass
class Level:
    bits: DataFrame   # one row, one array of longs
    size: int         # bits
    seed: int

    def has(self, key: Column) -> Column:
        words, out = self.bits.scalar(), F.lit(True)
        for j in range(HASHES):
            at = F.pmod(F.xxhash64(key, F.lit(self.seed * HASHES + j)), F.lit(self.size))
            word = F.get(words, F.floor(at / 64).cast("int"))
            out = out & (F.call_function("shiftright", word, (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return out


def _encode(keys: DataFrame, n: int, seed: int) -> Level:
    size = 64 * max(1, -(-n * BITS_PER_KEY // 64))
    at = F.explode(F.array(*[F.pmod(F.xxhash64("key", F.lit(seed * HASHES + j)), F.lit(size)) for j in range(HASHES)]))
    ones = keys.select(at.alias("at")).select(
        (F.col("at") / 64).cast("long").alias("w"), F.expr("shiftleft(1L, int(at % 64))").alias("b"))
    zeros = keys.sparkSession.range(size // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b"))
    words = ones.union(zeros).groupBy("w").agg(F.bit_or("b").alias("b"))
    # size // 64 rows, bounded by MAX_KEYS
    packed = words.agg(F.array_sort(F.collect_list(F.struct("w", "b"))).alias("x")).select(
        F.transform("x", lambda e: e["b"]).alias("bits"))
    return Level(cut_lineage(packed), size, seed)


def build_cascade(universe: DataFrame, listed: DataFrame) -> list[Level] | None:
    """Levels for the distinct ``key`` of both; None if there are more than MAX_KEYS listed keys.

    ``listed`` keys outside the universe need no encoding: they are never asked.
    """
    known = cut_lineage(universe.select("key").distinct()
                        .join(listed.select(F.col("key"), F.lit(True).alias("on")).distinct(), "key", "left"))
    inside, outside = known.where("on").select("key"), known.where("on is null").select("key")
    levels: list[Level] = []
    n = inside.count()
    while n:
        if n > MAX_KEYS:
            return None
        levels.append(_encode(inside, n, len(levels)))
        mistaken = cut_lineage(outside.where(levels[-1].has(F.col("key"))))
        inside, outside = mistaken, inside
        n = inside.count()
    return levels


def is_listed(levels: list[Level], key: Column) -> Column:
    """Exact for keys of the universe: the first level that lacks the key decides."""
    out = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        out = F.when(levels[i].has(key), out).otherwise(F.lit(i % 2 == 1))
    return out


def judge(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of each row of ``pages`` (page_id, url).

    ``listed`` has the blocked hosts as ``key``. Null urls and urls without
    ``://`` have empty host and path and fit no rule. Repeated rows are judged
    each; an empty table gives an empty result; an empty list blocks nothing.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    levels = build_cascade(rows.select(F.col("host").alias("key")), listed)
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    if levels is None:  # more keys than every task should hold: the same answer by a join
        rows = rows.join(listed.select(F.col("key").alias("host"), F.lit(True).alias("hit")).distinct(), "host", "left")
        blocked = F.coalesce("hit", F.lit(False))
    else:
        blocked = is_listed(levels, F.col("host"))
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(
        verdict, F.when(blocked, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))


def listed_hosts(pages: DataFrame, terms=LISTED_TERMS, marks=LISTED_MARKS) -> DataFrame:
    """The list of the registered query: hosts with a page that holds all marks, or with a listed term in their name.

    What the pages of a host hold can't be told from a url, so the other pages
    of the host are judged by lookup. Null pages hold no mark.
    """
    named, marked = F.lit(False), F.lit(True)
    for t in terms:
        named = named | F.col("key").contains(t)
    for m in marks:
        marked = marked & F.coalesce(F.col("html").contains(m), F.lit(False))
    return pages.select(host_of(F.col("url")).alias("key"), "html").where(named | marked).select("key").distinct()


ORACLE = r"""
WITH p AS (SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, html FROM pages),
bad AS (SELECT DISTINCT host FROM p WHERE regexp_matches(host, 'spam|pills|casino|malware')
    OR contains(html, '###') AND contains(html, '***') AND contains(html, '$$$')),
r AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
    ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) t(v, h, pre)),
m AS (SELECT p.page_id, p.host, p.path, arg_max(r.h || r.pre, length(r.h || r.pre)) AS rule, arg_max(r.v, length(r.h || r.pre)) AS v
    FROM p LEFT JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.pre)
    GROUP BY p.page_id, p.host, p.path)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM m
"""

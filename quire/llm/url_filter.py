"""URL filters by a Bloom filter cascade, in DataFrame expressions only.

Every url is expanded into its candidate keys: each domain suffix of the host with each prefix of
the path that ends in a slash. The complete key universe is the set of candidates of the whole
corpus. Level 0 is a Bloom filter of the listed keys; level 1 holds the universe's keys that level 0
lets through by mistake; level 2 holds the listed keys that level 1 catches by mistake, and so on
until no mistake is left. The first level that rejects a key decides, so membership is exact for
every key of the universe and no url is joined with the list.

Sizes: the list is a parameter of bounded size (MAX_LISTED); a level holds bits for either listed keys
or for the few universe keys that passed all levels before, about (1 %)^level of the universe. Their
number is counted before anything is brought to the driver; above MAX_LEVEL_KEYS the build raises.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import materialise, table

#: Bounds of what the driver holds: listed keys, and keys of one level.
MAX_LISTED = 1_000_000
MAX_LEVEL_KEYS = 5_000_000
BITS_PER_KEY = 10
HASHES = 7
#: The contract's rules, (host, path, verdict): fixed values.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_of(url: Column) -> Column:
    """Host after the first ://, A-Z lower-cased; empty for null or a url without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidates(host: Column, path: Column, depth: int) -> Column:
    """Keys (host suffix + path prefix), longest host first, then longest path: array of string.

    depth: the most path segments any rule has; longer prefixes can't be listed, so they aren't made."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.split(path, "/")
    ends = F.least(F.size(parts) - 1, F.lit(depth + 1))
    prefixes = F.when(
        ends >= 1,
        F.transform(F.sequence(ends, F.lit(1)), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/"))),
    ).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def _positions(key: Column, level: int, m: int) -> list[Column]:
    h1, h2 = F.xxhash64(key, F.lit(2 * level)), F.xxhash64(key, F.lit(2 * level + 1))
    return [F.pmod(F.pmod(h1, F.lit(1 << 40)) + F.lit(i) * F.pmod(h2, F.lit(1 << 40)), F.lit(m)) for i in range(HASHES)]


@dataclass
class Level:
    number: int
    m: int
    words: list[int]


def _level(keys: DataFrame, number: int, n: int) -> Level:
    m = max(64, n * BITS_PER_KEY // 64 * 64 + 64)
    pos = keys.select(F.explode(F.array(*_positions(F.col("key"), number, m))).alias("p"))
    words = pos.groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b"))
    dense = [0] * (m // 64)
    for w, b in words.collect():  # m / 64 rows at most, see MAX_LEVEL_KEYS
        dense[w] = b
    return Level(number, m, dense)


def passes(key: Column, level: Level) -> Column:
    bits = F.split(F.lit(",".join(map(str, level.words))), ",").cast("array<bigint>")  # folds to one literal
    hit = [F.call_function("shiftrightunsigned", F.get(bits, F.floor(p / 64).cast("int")), (p % 64).cast("int")).bitwiseAND(F.lit(1)) == 1 for p in _positions(key, level.number, level.m)]
    return reduce(lambda a, b: a & b, hit)


def build(listed: DataFrame, universe: DataFrame) -> list[Level]:
    """Cascade of the listed keys (column key) over the complete universe (column key)."""
    n = listed.count()
    if n > MAX_LISTED:
        raise ValueError(f"{n} listed keys; the bound is {MAX_LISTED}")
    levels: list[Level] = []
    if not n:
        return levels
    inside, outside = listed, None
    for number in range(40):
        levels.append(_level(inside, number, n))
        if outside is None:
            outside = materialise(universe.where(passes(F.col("key"), levels[0])).distinct().join(F.broadcast(listed), "key", "left_anti"), "cascade")
            wrong = outside
        else:
            wrong = outside.where(passes(F.col("key"), levels[-1]))
        n = wrong.count()
        if not n:
            return levels
        if n > MAX_LEVEL_KEYS:
            raise ValueError(f"level {number + 1} has {n} keys; the bound is {MAX_LEVEL_KEYS}")
        inside, outside = wrong, inside
    raise ValueError("the cascade doesn't end")


def member(key: Column, levels: list[Level]) -> Column:
    """Exact for keys of the universe: the first level that rejects the key decides, an even one says no."""
    out = F.lit(bool(len(levels) % 2))
    for level in reversed(levels):
        out = F.when(~passes(key, level), F.lit(bool(level.number % 2))).otherwise(out)
    return out


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages(page_id, url).

    Null and malformed urls have empty host and path, no rule and the default verdict; so have urls
    whose path is empty. Repeated rows are judged each by itself; other columns are ignored."""
    spark = pages.sparkSession
    depth = max((p.count("/") - 1 for _, p, _ in rules), default=0)
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    keyed = urls.withColumn("keys", candidates(F.col("host"), F.col("path"), depth))
    universe = keyed.select(F.explode("keys").alias("key"))
    rows = [(h + p, v) for h, p, v in rules]
    schema = "key string, verdict string"
    either = build(spark.createDataFrame(rows, schema).select("key"), universe)
    blocked = build(spark.createDataFrame([r for r in rows if r[1] == "block"], schema).select("key"), universe)
    hits = F.filter("keys", lambda k: member(k, either)) if either else F.array().cast("array<string>")
    found = keyed.withColumn("rule", F.get(hits, F.lit(0)))
    said = F.when(member(F.col("rule"), blocked), F.lit("block")).otherwise(F.lit("allow")) if blocked else F.lit("allow")
    return found.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNull(), F.lit(default)).otherwise(said).alias("verdict"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES)


OP9_SQL = r"""
WITH u AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT page_id, host, path, h || p AS rule, v,
    row_number() OVER (PARTITION BY page_id ORDER BY length(h) DESC, length(p) DESC) AS k
  FROM u LEFT JOIN r ON (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""

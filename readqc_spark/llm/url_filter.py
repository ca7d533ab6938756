"""URL verdicts: longest rule by host and path, else a list of canonical URLs behind a blocked Bloom filter.

The filter is a table of blocks of four 64-bit lanes, about one for eight listed URLs, MOST_BLOCKS at most (some 26 MB), so it is
broadcast. A list too long for that lets more URLs through to the join, which stays exact.
URLs that it passes go on to an exact hash join with the list, which removes the false positives. All of it is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS, MOST_BLOCKS, PER_BLOCK, LANES = 65536, 1 << 18, 8, 4
#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


def host_of(url: Column) -> Column:
    """After the first ://, up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host, up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host and path without the trailing slash, and the sorted query without tracking parameters. Null without ://."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.rlike(p, F.lit(TRACKING))))
    rest = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(F.contains(url, F.lit("://")), F.concat(F.regexp_replace(host_of(url), r":(80|443)$", ""), F.regexp_replace(path_of(url), r"/+$", ""), rest))


def _lanes(c: Column) -> list[Column]:
    h = F.xxhash64(F.lit("lanes"), c)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(63).cast("int")) for k in range(LANES)]


def blocks_for(n: int) -> int:
    """How many blocks a list of n URLs gets: a power of two."""
    return min(max(1 << max(n // PER_BLOCK, 1).bit_length(), 1024), MOST_BLOCKS)


def bloom(listed: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """block, lane0 to lane3 of the keys in column url_key: at most blocks rows."""
    bits = listed.select(F.pmod(F.xxhash64("url_key"), F.lit(blocks)).cast("int").alias("block"), *[x.alias(f"lane{k}") for k, x in enumerate(_lanes(F.col("url_key")))])
    return bits.groupBy("block").agg(*[F.expr(f"bit_or(lane{k})").alias(f"lane{k}") for k in range(LANES)])


def by_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; both null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, at, under in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(under))
        rule, verdict = F.when(fits, F.lit(at + under)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def url_verdicts(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, listed for each row of pages (page_id, url). listed: column url, any spelling.

    Null urls and urls without :// have empty host and path, fit no rule, are on no list and so are allowed. Repeated rows each get
    their row; a list that repeats a URL counts it once. Very long urls are compared whole. An empty list blocks nothing, an empty table
    gives an empty result. Other columns, whatever their names, aren't looked at.
    """
    keys = listed.select(canonical(listed["url"].cast("string")).alias("url_key")).filter("url_key is not null").distinct()
    blocks = blocks_for(keys.count())
    page = pages.select("page_id", pages["url"].cast("string").alias("url"))
    page = page.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical(F.col("url")).alias("url_key"))
    page = page.withColumns({"block": F.pmod(F.xxhash64("url_key"), F.lit(blocks)).cast("int"), **{f"bit{k}": x for k, x in enumerate(_lanes(F.col("url_key")))}})
    passes = F.col("url_key").isNotNull()
    for k in range(LANES):
        passes = passes & (F.coalesce(F.col(f"lane{k}"), F.lit(0)).bitwiseAND(F.col(f"bit{k}")) == F.col(f"bit{k}"))
    tested = page.join(F.broadcast(bloom(keys, blocks)), "block", "left").withColumn("passes", passes).select("page_id", "host", "path", "url_key", "passes")
    exact = tested.filter("passes").join(keys.withColumn("listed", F.lit(True)), "url_key", "left").select("page_id", "host", "path", F.coalesce("listed", F.lit(False)).alias("listed"), F.lit(True).alias("passed"))
    out = exact.unionByName(tested.filter("not passes").select("page_id", "host", "path", F.lit(False).alias("listed"), F.lit(False).alias("passed")))
    rule, verdict = by_rule(F.col("host"), F.col("path"), rules)
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed", "passed")

"""URL verdicts: a blocked Bloom filter in front of an exact hash join, and rules.

The listed canonical URLs are folded into 64-bit blocks: one hash picks the block, six
more groups of bits of a second hash set bits of that block, which are or-ed in the
aggregation. A page's URL is a possible hit if all its bits stand in its block; the
blocks are broadcast (their number follows the list's length, up to a bound). Possible hits, and they alone, are
joined exactly with the list, which removes the false positives. All native functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

MOST = 1 << 22  # blocks of 8 bytes; beyond 16 million URLs more false positives pass on to the join
EACH = 4  # URLs of a block
HASHES = 6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The labels of hosts whose pages the registered query lists.
JUNK = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
#: (verdict, host, path)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def rest(url: Column) -> Column:
    """What follows the first `://`; empty if there is none."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(rest(url), "^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without a leading `www.` or `m.`, and path without slashes at its end; neither scheme, query nor fragment."""
    return F.concat(F.regexp_replace(host(url), "^(www|m)\\.", ""), F.regexp_replace(path(url), "/+$", ""))


def rule(h: Column, p: Column, rules=RULES) -> Column:
    """struct(name, verdict) of the longest rule that fits, null if none does."""
    out = None
    for verdict, on, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((h == on) | F.endswith(h, F.lit("." + on))) & F.startswith(p, F.lit(start))
        value = F.struct(F.lit(on + start).alias("name"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("long")


def _bits(key: Column) -> Column:
    h = F.xxhash64(key, F.lit("bits"))
    out = F.lit(0).cast("long")
    for i in range(HASHES):
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return out


def blocks_for(n: int) -> int:
    """Blocks for a list of n URLs: a power of two, MOST at most."""
    return min(MOST, 1 << max(0, (n // EACH).bit_length()))


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, bits) of a table with a column `listed`; at most `blocks` rows."""
    return listed.where("listed is not null").groupBy(_block(F.col("listed"), blocks).alias("block")).agg(F.bit_or(_bits(F.col("listed"))).alias("bits"))


def maybe(df: DataFrame, key: str, blooms: DataFrame, blocks: int) -> DataFrame:
    """`df` with a boolean `maybe`: whether the filter, of at most MOST blocks, lets the key pass."""
    at, bits = unused(df, "block", "bits")
    held = F.broadcast(blooms.select(F.col("block").alias(at), F.col("bits").alias(bits)))
    own = _bits(F.col(key))
    out = df.withColumn(at, _block(F.col(key), blocks)).join(held, at, "left")
    return out.withColumn("maybe", F.coalesce(F.col(bits).bitwiseAND(own) == own, F.lit(False))).drop(at, bits)


def judge(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, blocks: int | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) for each row of `pages`.

    `listed` has a column `listed` of canonical URLs, repeats and nulls allowed. The rule
    that fits decides; without one, a listed page is blocked and any other allowed. A null
    URL, or one without `://`, has an empty host and path and is allowed unless the empty
    URL is listed. Rows that repeat are each judged; other columns are not read; an empty
    table gives no rows, an empty list lists nothing.
    """
    own = listed.select("listed").where("listed is not null").distinct()
    blocks = blocks or blocks_for(own.count())
    rows = pages.select(F.col(id_col).alias("page_id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"), canonical(F.col(url_col)).alias("key"))
    tested = maybe(rows, "key", bloom(own, blocks), blocks)
    # possible hits only take part in the exact join; AQE splits a hot URL's rows
    hits = tested.where("maybe").join(own.select(F.col("listed").alias("key"), F.lit(True).alias("hit")), "key", "left").select("page_id", "host", "path", F.coalesce("hit", F.lit(False)).alias("listed"))
    rest_ = tested.where("not maybe").select("page_id", "host", "path", F.lit(False).alias("listed"))
    r = rule(F.col("host"), F.col("path"), rules)
    return hits.unionAll(rest_).withColumn("__rule", r).select(
        "page_id", "host", "path", F.col("__rule.name").alias("rule"),
        F.coalesce(F.col("__rule.verdict"), F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed",
    )


def junk_list(pages: DataFrame, labels: tuple[str, ...] = JUNK) -> DataFrame:
    """The list of the registered query: canonical URLs of pages on a host with one of the labels."""
    h = host(F.col("url"))
    return pages.where(F.coalesce(h.rlike(pattern(labels)), F.lit(False))).select(canonical(F.col("url")).alias("listed"))


def pattern(labels: tuple[str, ...]) -> str:
    return f"(^|[.])({'|'.join(labels)})([.]|$)"

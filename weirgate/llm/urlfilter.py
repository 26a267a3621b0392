"""URL filters: rules by host and path, and a list behind a blocked Bloom filter, natively.

Listed URLs are canonicalised. A blocked Bloom filter of them (one row for each 512-bit block, of bounded number,
joined by broadcast) lets possible hits through; an exact hash join with the list removes the false positives.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirgate.llm.store import heavy_join

#: Blocks of the filter at most, bits for each listed URL, words of 64 bits in a block, and bits set for a URL.
MAX_BLOCKS, URL_BITS, BLOCK_WORDS, PROBES = 1 << 15, 12, 8, 6
#: Query parameters that don't change the page.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "fbclid", "gclid"]

#: (verdict, host, path)
Rule = tuple[str, str, str]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _tail(url: Column) -> Column:
    """What follows the first ``://``; null where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_tail(url), r"^([^/?#]*+)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_tail(url), r"^[^/?#]*+([^?#]*+)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www., m. or a default port, path without a closing slash or index page, and sorted query parameters that matter."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^(?:www\.|m\.)", ""), r":(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/index\.html?$", "/"), r"(?<=.)/$", "")
    path = F.when(path == "", "/").otherwise(path)
    query = F.split(F.regexp_extract(F.coalesce(_tail(url), F.lit("")), r"^[^?#]*+\?([^#]*+)", 1), "&")
    kept = F.array_sort(F.filter(query, lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(TRACKING)))
    return F.when(F.coalesce(host, F.lit("")) == "", F.lit(None).cast("string")).otherwise(F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.concat_ws("&", kept))).otherwise("")))


def rule_name(rule: Rule) -> str:
    return rule[1] + rule[2]


def match_rule(host: Column, path: Column, rules: list[Rule], value) -> Column:
    """``value(rule)`` of the longest rule that fits (a host and its subdomains, a path's beginning); null if none does."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(rule_name(r)), rule_name(r))):
        fits = ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def _bits(key: Column) -> list[tuple[Column, Column]]:
    """(word, mask) of each probe within a block."""
    out = []
    for k in range(PROBES):
        h = F.xxhash64(key, F.lit(k + 1))
        out.append((F.pmod(h, F.lit(BLOCK_WORDS)).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(h, 8), F.lit(64)).cast("int"))))
    return out


def build_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 ... w7): the filter of the column ``canonical``; at most ``blocks`` rows of eight longs."""
    key = F.col("canonical")
    masks = [reduce(lambda a, b: a.bitwiseOR(b), [F.when(word == w, mask).otherwise(F.lit(0).cast("long")) for word, mask in _bits(key)]) for w in range(BLOCK_WORDS)]
    rows = listed.select(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), *[m.alias(f"m{w}") for w, m in enumerate(masks)])
    return rows.groupBy("block").agg(*[F.bit_or(f"m{w}").alias(f"w{w}") for w in range(BLOCK_WORDS)])


def possible(key: Column) -> Column:
    """Whether all bits of ``key`` are set in the joined block's words."""
    words = F.array(*[F.col(f"w{w}") for w in range(BLOCK_WORDS)])
    return reduce(lambda a, b: a & b, [F.get(words, word).bitwiseAND(mask) != 0 for word, mask in _bits(key)])


def judge_urls(pages: DataFrame, rules: list[Rule], listed: DataFrame, key: str = "page_id") -> DataFrame:
    """One row for each row of ``pages``: the key, url, host, path, canonical, rule, listed, verdict.

    A fitting rule decides; else a listed URL (``listed.url``, compared in canonical form) is blocked; all others are
    allowed. A URL that is null or has no ``://`` has an empty host and path, fits no rule and is never listed.
    Repeated rows and URLs keep their rows; other columns are ignored.
    """
    url = F.col("url").cast("string")
    rows = pages.select(F.col(key), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canonical"))
    rows = rows.withColumn("rule", match_rule(F.col("host"), F.col("path"), rules, rule_name))
    rows = rows.withColumn("said", match_rule(F.col("host"), F.col("path"), rules, lambda r: r[0]))
    names = listed.select(canonical(F.col("url").cast("string")).alias("canonical")).where("canonical is not null").distinct()
    blocks = max(16, min(MAX_BLOCKS, 1 << ((names.count() * URL_BITS) // (64 * BLOCK_WORDS)).bit_length()))
    bloom = F.broadcast(build_filter(names, blocks))
    marked = rows.withColumn("block", F.pmod(F.xxhash64("canonical"), F.lit(blocks))).join(bloom, "block", "left")
    marked = marked.withColumn("maybe", F.coalesce(F.col("canonical").isNotNull() & possible(F.col("canonical")), F.lit(False))).drop("block", *[f"w{w}" for w in range(BLOCK_WORDS)])
    exact = names.withColumn("hit", F.lit(True))
    hits = heavy_join(marked.where("maybe"), exact, "canonical", "left").withColumn("listed", F.coalesce("hit", F.lit(False)))
    columns = [key, "url", "host", "path", "canonical", "rule", "said", "listed"]
    out = hits.select(*columns).unionByName(marked.where("not maybe").withColumn("listed", F.lit(False)).select(*columns))
    return out.withColumn("verdict", F.coalesce("said", F.when(F.col("listed"), "block").otherwise("allow"))).drop("said")

"""Secret scans with corpus-wide ownership frequency, natively.

Candidates are found by patterns. Their hashes are then aggregated over the whole corpus by distinct repositories and
owners: a value that many owners hold is a widely copied example, one that stays with a single owner looks live.
Looser patterns (vendor prefixes, mixed random-looking tokens) are reported only where ownership confirms them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirgate.llm import spans as S
from weirgate.llm.store import heavy_join, materialize

#: Owners from which on a value counts as a widely copied example.
EXAMPLE_OWNERS = 3
BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "vendor", "random"]

ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
#: A key of fewer characters fails, and so does every later start in the same run: the bound can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"
VENDOR, VENDOR_PREFIX = r"[A-Za-z0-9_.-]{20,}+", r"^(?:gh[opsu]_|xox[abprs]-|sk-|sk_live_|rk_live_|glpat-|npm_|AIza|ya29\.|eyJ)"
RANDOM = r"[A-Za-z0-9+/_-]{24,}+"


def base_spans(text: Column) -> Column:
    """Spans of the three base kinds in a non-null text, by start, then kind as listed."""
    assign = F.filter(S.find(text, ASSIGN, "assign", 1), lambda s: F.length(s["value"]) >= 8)
    return S.by_start(F.concat(assign, S.find(text, ACCESS, "access", gate=text.contains("AKIA")), S.find(text, HEX, "hex")), KINDS)


def looser_spans(text: Column) -> Column:
    """Candidates of the looser kinds; a random token must hold lower case, capitals and at least three digits."""
    mixed = F.filter(S.find(text, RANDOM, "random"), lambda s: s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[0-9][^0-9]*[0-9][^0-9]*[0-9]"))
    vendor = F.filter(S.find(text, VENDOR, "vendor"), lambda s: s["value"].rlike(VENDOR_PREFIX))
    return F.concat(vendor, mixed)


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, repositories, owners) of candidate rows (hash, repo, owner); every step combines before it shuffles."""
    pairs = candidates.select("hash", "owner", "repo").distinct()
    by_owner = pairs.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("repositories"), F.count(F.lit(1)).alias("owners"))


def scan_secrets(docs: DataFrame, owner: Column, repo: Column, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, base, spans (kind, start, end, value, verdict, owners, repositories).

    ``base`` are the base spans. ``spans`` are those with a verdict (``live`` for one owner, ``example`` from
    ``example_owners`` on, else ``shared``), and the looser candidates that are live and overlap no base span. A null
    text is empty; a null owner or repository counts as one of its own; repeated rows get equal answers.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), owner.cast("string").alias("owner"), repo.cast("string").alias("repo"), text.alias("text"))
    found = slim.select("doc_id", "owner", "repo", base_spans(F.col("text")).alias("base"), looser_spans(F.col("text")).alias("more"))
    loose = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    table = materialize(found.select("doc_id", "owner", "repo", "base", loose.alias("more")).withColumn("uid", F.monotonically_increasing_id()), "secrets")
    some = (F.size("base") > 0) | (F.size("more") > 0)
    rows = table.where(some).select("uid", "owner", "repo", F.explode(F.concat("base", "more")).alias("s"))
    rows = rows.select("uid", "s", F.sha2(F.col("s.value"), 256).alias("hash"), F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repo", F.lit("")).alias("repo"))
    judged = heavy_join(rows.select("uid", "s", "hash"), ownership(rows), "hash")
    verdict = F.when(F.col("owners") <= 1, "live").when(F.col("owners") >= example_owners, "example").otherwise("shared")
    kept = judged.withColumn("verdict", verdict).where(F.col("s.kind").isin(BASE) | (F.col("verdict") == "live"))
    full = F.struct(F.col("s.kind").alias("kind"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.value").alias("value"), "verdict", "owners", "repositories")
    lists = kept.groupBy("uid").agg(F.collect_list(full).alias("spans"))
    kind = "array<struct<kind:string,start:int,end:int,value:string,verdict:string,owners:bigint,repositories:bigint>>"
    joined = table.where(some).join(lists, "uid", "left").select("doc_id", "base", F.coalesce(S.by_start(F.col("spans"), KINDS), F.array().cast(kind)).alias("spans"))
    return joined.unionByName(table.where(~some).select("doc_id", "base", F.array().cast(kind).alias("spans")))

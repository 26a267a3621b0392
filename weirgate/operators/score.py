"""Scoring findings and deciding on a text; Catalyst expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirgate.rules import data


def noisy_or(weights: Column) -> Column:
    """Thousandths left unexplained are scaled down by each weight in turn, rounding down; the rest is the score."""
    rest = F.aggregate(weights, F.lit(1000), lambda r, w: F.floor(r * (1000 - w) / 1000).cast("int"))
    return F.greatest(F.lit(0), F.least(F.lit(1000), 1000 - rest))


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def combine(findings: DataFrame, keys: list[str], standalone: list[str] | None = None) -> DataFrame:
    """(keys, score, families, corroborated) of finding rows (keys, rule_id, family, severity, weight, doc_like).

    Per rule the heaviest finding counts. Rules of a family meet in a noisy-or under the family's cap, in the order of
    their ids; a document-like text damps some families to a share of their heaviest rule. A lone imperative family is
    halved. Families meet in a noisy-or again, in the order of their names.
    """
    rules = findings.groupBy(*keys, "family", "rule_id").agg(F.max("weight").alias("weight"), F.max(F.col("doc_like")).alias("doc_like"), F.max((F.col("severity") == "critical") & F.col("rule_id").isin(standalone or [])).alias("decisive"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rule_id", "weight"))), lambda x: x["weight"])
    family = rules.groupBy(*keys, "family").agg(ordered.alias("weights"), F.max("doc_like").alias("doc_like"), F.max("decisive").alias("decisive"))
    cap = F.coalesce(_map(data.FAMILY_CAPS)[F.col("family")], F.lit(1000))
    damped = F.col("doc_like") & F.col("family").isin(data.DAMPED_FAMILIES)
    weight = F.when(damped, F.least(cap, F.floor(F.array_max("weights") * data.DOC_DAMPING / 1000).cast("int"))).otherwise(F.least(cap, noisy_or(F.col("weights"))))
    family = family.select(*keys, "family", weight.alias("weight"), "decisive")
    all_of = F.array_sort(F.collect_list(F.struct("family", "weight")))
    text = family.groupBy(*keys).agg(all_of.alias("f"), F.max("decisive").alias("decisive"))
    lone = (F.size("f") == 1) & (F.col("f")[0]["family"] == "imperative")
    weights = F.transform("f", lambda x: F.when(lone, F.floor(x["weight"] * data.LONE_IMPERATIVE / 1000).cast("int")).otherwise(x["weight"]))
    score = F.floor((noisy_or(weights) + 5) / 10).cast("int")
    return text.select(*keys, score.alias("score"), F.size("f").cast("long").alias("families"), ((F.size("f") >= 2) | F.col("decisive")).alias("corroborated"))


def combine_array(findings: Column, doc_like: Column, standalone: list[str] | None = None) -> Column:
    """struct(score, families, corroborated) of a text's array of findings: :func:`combine` within a row, without a shuffle.

    The families are those of ``FAMILY_CAPS``; findings of others count nothing. No findings score 0.
    """

    def family(name: str) -> Column:
        own = F.filter(findings, lambda f: f["family"] == name)
        rules = F.array_sort(F.array_distinct(F.transform(own, lambda f: f["rule_id"])))
        weights = F.transform(rules, lambda r: F.array_max(F.transform(own, lambda f: F.when(f["rule_id"] == r, f["weight"]))))
        cap = F.lit(data.FAMILY_CAPS[name])
        weight = F.least(cap, noisy_or(weights))
        if name in data.DAMPED_FAMILIES:
            weight = F.when(doc_like, F.least(cap, F.floor(F.array_max(weights) * data.DOC_DAMPING / 1000).cast("int"))).otherwise(weight)
        if name == "imperative":
            weight = F.when(F.forall(findings, lambda f: f["family"] == name), F.floor(weight * data.LONE_IMPERATIVE / 1000).cast("int")).otherwise(weight)
        return F.when(F.size(own) > 0, weight)

    weights = F.array_compact(F.array(*map(family, sorted(data.FAMILY_CAPS))))
    decisive = F.exists(findings, lambda f: (f["severity"] == "critical") & f["rule_id"].isin(standalone or []))
    figures = F.struct(F.floor((noisy_or(weights) + 5) / 10).cast("int").alias("score"), F.size(weights).cast("long").alias("families"), ((F.size(weights) >= 2) | decisive).alias("corroborated"))
    return F.when(F.size(findings) > 0, figures).otherwise(F.struct(F.lit(0).alias("score"), F.lit(0).cast("long").alias("families"), F.lit(False).alias("corroborated")))


def decide(score: Column, corroborated: Column, degraded: Column, flag_at=40, block_at=70, action: str = "block", on_degraded: str = "flag", strict_degraded: bool = False) -> Column:
    """The action for a score.

    From ``flag_at`` on the configured action is taken, but a block becomes a flag below ``block_at`` or without
    corroboration. A text of which only part was seen is blocked where ``on_degraded`` says so; where that says flag it is
    flagged at least, and from ``flag_at`` on gets the configured action (a block needs corroboration here too, unless
    ``strict_degraded``).
    """
    flag_at, block_at = (v if isinstance(v, Column) else F.lit(v) for v in (flag_at, block_at))
    high = F.lit(action) if action != "block" else F.when(corroborated, "block").otherwise("flag")
    low = F.lit(action if action != "block" else "flag")
    banded = F.when(score >= block_at, high).when(score >= flag_at, low).otherwise("allow")
    if on_degraded == "allow":
        return banded
    if on_degraded == "block":
        return F.when(degraded, "block").otherwise(banded)
    taken = F.lit(action) if strict_degraded else high
    return F.when(degraded, F.when(score >= flag_at, taken).otherwise("flag")).otherwise(banded)


def rank(action: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, data.ACTIONS)), action)


def worst_action(verdicts: DataFrame, keys: list[str], enforce: bool = True) -> DataFrame:
    """(keys, action, items): the worst action of each call's items; without ``enforce`` a block only flags."""
    action = F.col("action") if enforce else F.when(F.col("action") == "block", "flag").otherwise(F.col("action"))
    return verdicts.groupBy(*keys).agg(F.max_by(action, rank(action)).alias("action"), F.count(F.lit(1)).alias("items"))


def headline(verdicts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The item of each call that explains its verdict: highest score, then worst action, then the first in ``order``."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc(rank(F.col("action"))), *order)
    return verdicts.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def blocked_stub(action: Column, findings: Column, ruleset: str) -> Column:
    """The result that takes a blocked one's place, as JSON: counts only, nothing of the content."""
    text = F.format_string("[weirgate] content withheld · %d finding(s) · ruleset %s · action %s", findings.cast("long"), F.lit(ruleset), action)
    block = F.struct(F.lit("text").alias("type"), text.alias("text"))
    return F.to_json(F.struct(F.lit(True).alias("isError"), F.array(block).alias("content")))

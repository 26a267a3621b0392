"""Measuring a detector on labelled rows: threshold sweeps, breakdowns, spans, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rates(caught: Column, positives: Column, fired: Column, negatives: Column) -> list[Column]:
    recall = F.when(positives > 0, caught / positives).otherwise(F.lit(1.0))
    precision = F.when(caught + fired > 0, caught / (caught + fired)).otherwise(F.lit(1.0))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
    return [recall.alias("recall"), F.when(negatives > 0, fired / negatives).otherwise(F.lit(0.0)).alias("fpr"), precision.alias("precision"), f1.alias("f1")]


def sweep(scored: DataFrame, thresholds: list[int]) -> DataFrame:
    """Metrics of (positive, score) rows at every threshold; each row is scored once and met by all thresholds.

    The rows are first counted by score, so the thresholds meet at most as many rows as there are scores. margin: how
    far the highest negative below the threshold lies under the lowest positive at or above it.
    """
    by_score = scored.groupBy("score").agg(F.sum(F.col("positive").cast("long")).alias("p"), F.sum((~F.col("positive")).cast("long")).alias("n"))
    grid = by_score.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    over = F.col("score") >= F.col("threshold")
    total = grid.groupBy("threshold").agg(
        F.sum("p").alias("positives"), F.sum("n").alias("negatives"), F.sum(F.when(over, F.col("p")).otherwise(0)).alias("caught"), F.sum(F.when(over, F.col("n")).otherwise(0)).alias("fired"),
        F.min(F.when(over & (F.col("p") > 0), F.col("score"))).alias("low"), F.max(F.when(~over & (F.col("n") > 0), F.col("score"))).alias("high"),
    )
    rates = _rates(F.col("caught"), F.col("positives"), F.col("fired"), F.col("negatives"))
    return total.select("threshold", "positives", "negatives", "caught", "fired", *rates, (F.col("low") - F.col("high")).alias("margin"))


def choose(swept: DataFrame, most_fpr: float = 0.02, least_margin: int = 4) -> DataFrame:
    """The operating point: few false positives, then enough margin, then recall, then the higher threshold."""
    return swept.orderBy(F.desc(F.col("fpr") < most_fpr), F.desc(F.coalesce(F.col("margin"), F.lit(0)) >= least_margin), F.desc("recall"), F.desc("threshold")).limit(1)


def breakdown(rows: DataFrame, family: str = "family") -> DataFrame:
    """(family, positive, total, caught) of (family, positive, fired) rows, and an ``all`` row for each label."""
    return rows.groupingSets([[family, "positive"], ["positive"]], family, "positive").agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("fired").cast("long")).alias("caught")).withColumn(family, F.coalesce(family, F.lit("all")))


def match_spans(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(kind, truth, matched, stray): spans of (id, kind, start, end) that agree exactly, and found ones that don't."""
    keys = ["id", "kind", "start", "end"]
    t, f = truth.select(*keys).distinct().withColumn("t", F.lit(1)), found.select(*keys).distinct().withColumn("f", F.lit(1))
    both = t.join(f, keys, "full_outer")
    return both.groupBy("kind").agg(F.count("t").alias("truth"), F.sum(F.when(F.col("t").isNotNull() & F.col("f").isNotNull(), 1).otherwise(0)).alias("matched"), F.sum(F.when(F.col("t").isNull(), 1).otherwise(0)).alias("stray"))


def nearest_rank(rows: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Per key the value at place floor(q * n) of the sorted values (the last at most): counts by value, not value lists."""
    from pyspark.sql import Window

    by = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys).orderBy(value)
    run = by.withColumn("_upto", F.sum("_c").over(w)).withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))
    at = lambda q: F.least(F.col("_n") - 1, F.floor(F.lit(q) * F.col("_n")))
    return run.groupBy(*keys).agg(F.max("_n").alias("n"), *[F.min(F.when(F.col("_upto") > at(q), F.col(value))).alias(name) for name, q in quantiles.items()])


def score_bands(rows: DataFrame) -> DataFrame:
    """(band, corroborated, items) of scores: 0, 1-19, 20-39, 40-69, 70+."""
    s = F.col("score")
    band = F.when(s == 0, "0").when(s < 20, "1-19").when(s < 40, "20-39").when(s < 70, "40-69").otherwise("70+")
    return rows.groupBy(band.alias("band"), "corroborated").agg(F.count(F.lit(1)).alias("items"))


#: The places of a latency summary.
LATENCY = {"min": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "max": 1.0}


def latency_stats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key n, min, mean, p50, p95, p99 and max of ``value``."""
    return nearest_rank(rows, keys, value, LATENCY).join(rows.groupBy(*keys).agg(F.avg(value).alias("mean")), keys)


def added_latency(guarded: DataFrame, direct: DataFrame, keys: list[str]) -> DataFrame:
    """The difference of two tables of latency stats, figure by figure, for the keys that both have; n is the lesser."""
    g, d = guarded.alias("g"), direct.alias("d")
    differ = [(F.col(f"g.{c}") - F.col(f"d.{c}")).alias(c) for c in (*LATENCY, "mean")]
    return g.join(d, keys).select(*keys, F.least("g.n", "d.n").alias("n"), *differ)

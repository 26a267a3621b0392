"""The second tier: which verdicts are judged, what a judgement changes, and the plug-in that asks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirgate.operators.score import rank
from weirgate.session import ship


def in_band(score: Column, corroborated: Column, degraded: Column, flag_at=40, block_at=70, band_from=None) -> Column:
    """Whole texts from ``band_from`` (else ``flag_at``) on; in the block band only uncorroborated ones."""
    low = F.lit(flag_at if band_from is None else band_from)
    return ~degraded & F.when(score >= block_at, ~corroborated).otherwise(score >= low)


def apply(action: Column, judged: Column, label: Column, confidence: Column, act: str = "flag", least: float = 0.0) -> Column:
    """Raises an action to ``act`` when the judge called injection with enough confidence; never lowers one."""
    raised = judged & (label == "injection") & (confidence >= least) & (rank(F.lit(act)) > rank(action))
    return F.when(F.coalesce(raised, F.lit(False)), act).otherwise(action)


def ask(items: DataFrame, judge: Callable[[str], dict], failures: int = 5, text: str = "text") -> DataFrame:
    """(digest, label, confidence, reason) of every different text; ``judge`` is called once for each.

    After ``failures`` errors in a row a partition stops asking (its breaker is open) and every 32nd text tries again.
    """
    ship(items.sparkSession)
    distinct = items.select(F.sha2(text, 256).alias("digest"), F.col(text).alias("text")).groupBy("digest").agg(F.first("text").alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bad = skipped = 0
        for f in frames:
            out = []
            for digest, t in zip(f["digest"], f["text"], strict=True):
                if bad >= failures and (skipped := skipped + 1) % 32:
                    out.append((digest, None, None, "open"))
                    continue
                try:
                    said = judge(t)
                    if said.get("label") not in ("injection", "benign"):
                        raise ValueError("no such label")
                    out.append((digest, said["label"], float(said.get("confidence", 1.0)), said.get("reason")))
                    bad = 0
                except Exception as e:  # a judge may fail in any way; the verdict then stays as it is
                    bad += 1
                    out.append((digest, None, None, type(e).__name__))
            yield pd.DataFrame(out, columns=["digest", "label", "confidence", "reason"])

    return distinct.mapInPandas(run, "digest string, label string, confidence double, reason string")


def sample_bytes(text: str, most: int) -> str:
    """Head and tail of a text that is longer than ``most`` UTF-8 bytes, cut at characters."""
    raw = text.encode()
    if len(raw) <= most:
        return text
    half = most // 2
    return raw[:half].decode(errors="ignore") + "\n[...]\n" + raw[len(raw) - half :].decode(errors="ignore")

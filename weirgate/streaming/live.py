"""The stateful rules over streams, and sinks that run a micro-batch at a time."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weirgate.functions.text import shape
from weirgate.operators import audit, detect
from weirgate.operators.policy import Combination, matches, tool_key
from weirgate.session import ship

#: Calls that a session remembers at most; the oldest go.
MOST_MARKS = 512


def findings_stream(content: DataFrame) -> DataFrame:
    """(id, findings) of a stream of content(id, text, kind): the native detectors are stateless expressions."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return content.select("id", detect.native_findings(text, F.col("kind"), shape(text)["doc_like"]).alias("findings"))


def completes(masks: list[int], current: int, patterns: int) -> bool:
    """Whether ``current`` matches a pattern and all patterns can be dealt to different calls (Hall's condition)."""
    if not current:
        return False
    return all(sum(bool(m & s) for m in masks) >= s.bit_count() for s in range(1, 1 << patterns))


def combination_stream(calls: DataFrame, combination: Combination, enforce: bool = False, most: int = MOST_MARKS, forget: bool = True) -> DataFrame:
    """(session_id, call_id, at_ms, hit) of a stream of calls; a session's recent calls are its state.

    Calls of a micro-batch are taken by time, then by call_id. With ``enforce`` a call that hits is denied and leaves no
    mark. With ``forget`` a session is dropped once the window has passed in processing time since its last batch (such a
    query never counts as idle); without, its state stays.
    """
    ship(calls.sparkSession)
    bits = sum((matches(tool_key(F.col("server_name"), F.col("tool_name")), g).cast("int") * (1 << i) for i, g in enumerate(combination.all_of)), F.lit(0))
    rows = calls.select(F.col("session_id").cast("string").alias("session_id"), "call_id", "at_ms", bits.alias("mask"))
    window, n = combination.window_ms, len(combination.all_of)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if forget and state.hasTimedOut:
            state.remove()
            return
        marks: list[list[int]] = json.loads(state.get[0]) if state.exists else []
        batch = pd.concat(list(frames)).sort_values(["at_ms", "call_id"], kind="stable")
        hits = []
        for at, mask in zip(batch["at_ms"].tolist(), batch["mask"].tolist(), strict=True):
            marks = [m for m in marks if m[0] >= at - window]
            hit = completes([m[1] for m in marks] + [mask], mask, n)
            hits.append(hit)
            if mask and not (hit and enforce):
                marks = [*marks, [at, mask]][-most:]
        state.update((json.dumps(marks),))
        if forget:
            state.setTimeoutDuration(max(1, window))
        yield pd.DataFrame({"session_id": key[0], "call_id": batch["call_id"].to_numpy(), "at_ms": batch["at_ms"].to_numpy(), "hit": hits})

    return rows.groupBy("session_id").applyInPandasWithState(step, "session_id string, call_id long, at_ms long, hit boolean", "marks string", "append", GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout)


def audit_sink(path: str, chain: str, order: str, columns: list[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that chains each micro-batch's records on to the log at ``path``.

    A batch is written to a folder of its own number, so one that is repeated after a failure replaces itself. Each
    chain goes on from its head in the folders before.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        built = audit.build_chain(batch.withColumn("_chain", F.col(chain).cast("string")), "_chain", order, columns)
        heads = None
        try:
            before = spark.read.parquet(path).where(F.col("batch") < number)
            heads = audit.heads(before).select("chain", (F.col("seq") + 1).alias("next"), "head")
        except Exception as e:  # no log yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        if heads is not None:
            built = audit.extend_chain(built, heads)
        built.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/part={number}")

    return write

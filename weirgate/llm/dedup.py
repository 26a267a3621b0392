"""Exact deduplication with a heavy-hitter split.

A Misra-Gries summary of every partition finds the digests that may be frequent; their winners are verified
exactly and broadcast (at most ``counters`` rows), so copies of a hot text are settled where they are read.
All other digests take the ordinary shuffle: winners by a partially aggregated minimum, then a join by digest, where no
digest holds more than about ``2 / counters`` of the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgate.llm.store import keep_rows, materialize, row_hash, texts
from weirgate.llm.textkernel import lean, text_bytes

#: Deleted before texts are compared.
BLANKS = b" \t\n\v\f\r"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = text_bytes(batch.column("text"))
        view = memoryview(data)
        sha, length = [], np.zeros(batch.num_rows, np.int64)
        for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
            sha.append(hashlib.sha256(bytes(view[a:b]).translate(None, BLANKS)).digest())
            length[i] = np.count_nonzero((data[a:b] & 0xC0) != 0x80)  # code points begin at bytes that don't continue one
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_hash"), pa.array(sha, pa.binary()), pa.array(length)], ["doc_id", "row_hash", "digest", "length"])


def digests(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, row_hash, digest, length) of every row, stored once; null text counts as empty."""
    slim = texts(docs, row_hash().alias("row_hash"))
    table = slim.mapInArrow(lean(_digest), "doc_id long, row_hash long, digest binary, length long")
    return materialize(table.withColumn("uid", F.monotonically_increasing_id()), "digests")


def prune(counts: dict[bytes, int], counters: int) -> dict[bytes, int]:
    """The Misra-Gries step: take the (counters + 1)-th largest count from all, keep what is above zero."""
    if len(counts) <= counters:
        return counts
    cut = sorted(counts.values(), reverse=True)[counters]
    return {k: v - cut for k, v in counts.items() if v > cut}


def misra_gries(table: DataFrame, counters: int) -> DataFrame:
    """(digest, bound): at most ``counters`` digests, among them every one with over 2 / counters of all rows."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, int] = {}
        for batch in batches:
            for value in batch.column(0).to_pylist():
                kept[value] = kept.get(value, 0) + 1
                if len(kept) > 4 * counters:
                    kept = prune(kept, counters)
        kept = prune(kept, counters)
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.binary()), pa.array(list(kept.values()), pa.int64())], ["digest", "bound"])

    local = table.select("digest").mapInArrow(summary, "digest binary, bound long")
    return local.groupBy("digest").agg(F.sum("bound").alias("bound")).orderBy(F.desc("bound"), "digest").limit(counters)


def exact_dedup(docs: DataFrame, counters: int = 256) -> DataFrame:
    """One row for each row of ``docs``: uid, doc_id, row_hash, digest, length, keep_id, group_size, kept.

    Texts are equal when identical after deleting blanks; the longest original stays, then the smallest
    doc_id, then (repeated rows) the first as read. Null texts count as empty and are equal to each other and
    to blank ones; a null doc_id sorts first. An empty table gives an empty result; other columns are ignored.
    """
    table = digests(docs)
    spark = table.sparkSession
    heavy = [bytes(r.digest) for r in misra_gries(table, counters).where(F.col("bound") > 1).collect()]
    best = F.min(F.struct((-F.col("length")).alias("l"), "doc_id", "uid")).alias("best")
    columns = ["uid", "doc_id", "row_hash", "digest", "length", "keep_id", "group_size", "kept"]

    def winners(rows: DataFrame) -> DataFrame:
        found = rows.groupBy("digest").agg(best, F.count(F.lit(1)).alias("group_size"))
        return found.select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.uid").alias("keep_uid"), "group_size")

    def settle(rows: DataFrame, won: DataFrame) -> DataFrame:
        return rows.join(won, "digest").withColumn("kept", F.col("uid") == F.col("keep_uid")).select(*columns)

    if not heavy:
        return settle(table, winners(table))
    marks = F.broadcast(spark.createDataFrame([(h,) for h in heavy], "digest binary"))
    hot, cold = table.join(marks, "digest", "left_semi"), table.join(marks, "digest", "left_anti")
    verified = spark.createDataFrame([tuple(r) for r in winners(hot).collect()], "digest binary, keep_id long, keep_uid long, group_size long")
    return settle(hot, F.broadcast(verified)).unionByName(settle(cold, winners(cold)))


def drop_copies(docs: DataFrame, counters: int = 256) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with all their columns (texts included).

    Texts equal but for blanks are copies, null ones and blank ones too; of repeated rows one stays. Column names may be
    any; an empty table gives an empty result.
    """
    return keep_rows(docs, exact_dedup(docs, counters).select("doc_id", "row_hash", F.col("kept").alias("stays")))

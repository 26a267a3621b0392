"""A training-corpus pipeline: language ID, exact dedup, near dedup, decontamination, packing.

Each stage gets what the one before it kept, as a Parquet table, and all but the last return the columns of
``documents``. Counted as part of the ``llm`` subpackage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from weirgate.llm import decontam, dedup, langid, packing, setjoin, store
from weirgate.llm.queries import remainder, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language is found: null texts and texts without a letter too. Repeated rows go together."""
    return langid.keep_identified(docs, langid.fit(docs, remainder(3) != 1))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of each group of texts that are identical but for blanks: the longest, then the smallest doc_id (null first)."""
    return dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near duplicates: the smallest doc_id (null first). Texts without words stay."""
    return setjoin.one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark window occurs. Texts without words stay, and all rows if the benchmark is empty."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into training sequences; one row for each piece. A null text is empty: its closing id alone."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("decontamination", benchmark_leaks),
    ("packing", pack),
]

#: SQL can't express the language model, nor packing by a tokenizer: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each result written to the shared folder and read again.

    An empty table goes through all stages and gives no piece. Extra columns are carried to the last stage, whatever their
    names.
    """
    docs = table(spark, sf_dir, "documents")
    root = f"{store.checkpoint_root(spark)}/weirgate/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        store.release(spark)
        docs = spark.read.parquet(f"{root}/{name}")
    return docs

"""Sources and sinks of the engine's own formats: text files, tool results, audit logs, locks, policies."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirgate.functions.text import mime_of
from weirgate.operators.policy import Combination, Policy, ScanOverride, ToolRule

CONTENT = "array<struct<type:string,text:string>>"
RECORD = T.StructType([T.StructField(n, T.LongType() if n == "seq" else T.StringType()) for n in ("chain", "seq", "body", "prev_hash", "hash")])


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """content(id, text, kind, mime_type): a row for each file."""
    rows = spark.read.text(path, wholetext=True).withColumn("id", F.col("_metadata.file_path"))
    return rows.select("id", F.col("value").alias("text"), F.lit("resource").alias("kind"), mime_of(F.col("id")).alias("mime_type"))


def result_texts(results: DataFrame, result: str = "result") -> DataFrame:
    """The text blocks of tool results (JSON with ``content``, or ``contents`` for resources), with their places."""
    blocks = F.from_json(F.coalesce(F.get_json_object(result, "$.content"), F.get_json_object(result, "$.contents")), CONTENT)
    rows = results.select("*", F.posexplode(blocks).alias("place", "block"))
    return rows.where((F.coalesce(F.col("block.type"), F.lit("text")) == "text") & F.col("block.text").isNotNull()).withColumn("text", F.col("block.text")).drop("block")


def replace_texts(result: Column, texts: Column) -> Column:
    """The result with the text of each text block replaced; ``texts`` is a map from place to new text.

    All else is carried through as it is: other blocks, other fields of a block and of the result. Blocks are those of
    ``content``, else of ``contents``; a result with neither list, or that isn't JSON, comes back unchanged.
    """

    @F.pandas_udf("string")
    def replaced(results: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([_replace(r, {e["key"]: e["value"] for e in n} if n is not None else {}) for r, n in zip(results, new, strict=True)])

    return replaced(result, F.map_entries(F.transform_keys(texts, lambda k, _: k.cast("string"))))


def _replace(text: str | None, new: dict[str, str]) -> str | None:
    try:
        result = json.loads(text or "")
    except ValueError:
        return text
    key = next((k for k in ("content", "contents") if isinstance(result, dict) and isinstance(result.get(k), list)), None)
    if key is None:
        return text
    for place, block in enumerate(result[key]):
        whole = isinstance(block, dict) and block.get("type") == "text" and isinstance(block.get("text"), str)
        if whole and new.get(str(place)) is not None:
            block["text"] = new[str(place)]
    return json.dumps(result, ensure_ascii=False, separators=(",", ":"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """An audit log of JSON lines with the line number as ``line``; blank lines are dropped, a bad one fails.

    Files are read in splits: a line's number is where its split begins in the file, then its place among the rows that
    the split's task reads, so it grows along the file but has gaps.
    """
    place = F.col("_metadata.file_block_start").cast("decimal(20,0)") * F.lit(1 << 33).cast("decimal(11,0)") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), place.alias("line"), F.col("value").alias("text")).where("trim(text) <> ''")
    return rows.select("file", "line", F.from_json("text", RECORD, {"mode": "FAILFAST"}).alias("r")).select("file", "line", "r.*")


def write_log(log: DataFrame, path: str) -> None:
    """One file for each chain, lines in order of seq."""
    lines = log.select("chain", F.to_json(F.struct("chain", "seq", "body", "prev_hash", "hash")).alias("value"), "seq")
    lines.repartition("chain").sortWithinPartitions("chain", "seq").select("chain", "value").write.partitionBy("chain").text(path)


def read_lock(spark: SparkSession, path: str) -> DataFrame:
    """(server_name, name, hash) of a lock file; hashes must be 64 hex digits."""
    kind = "struct<servers:map<string,struct<setHash:string,tools:map<string,struct<hash:string>>>>>"
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("lock"))
    servers = rows.select(F.explode("lock.servers").alias("server_name", "s"))
    tools = servers.select("server_name", F.explode("s.tools").alias("name", "t")).select("server_name", "name", F.col("t.hash").alias("hash"))
    return tools.select("server_name", "name", F.when(F.col("hash").rlike("^[0-9a-f]{64}$"), F.col("hash")).otherwise(F.raise_error(F.lit("a hash must be 64 hex digits"))).alias("hash"))


def lock_document(hashed: DataFrame) -> DataFrame:
    """One row, ``value``: the lock of a hash table, keys sorted. Catalogues are small; servers are combined per server first."""
    tools = F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.struct("hash")))))
    by = hashed.groupBy("server_name").agg(tools.alias("tools"))
    servers = F.map_from_entries(F.array_sort(F.collect_list(F.struct("server_name", F.struct("tools")))))
    return by.agg(servers.alias("servers")).select(F.to_json(F.struct("servers")).alias("value"))


def parse_policy(text: str) -> Policy:
    """A policy from YAML or JSON; unknown keys are an error."""
    try:
        import yaml

        raw = yaml.safe_load(text) or {}
    except ImportError:
        raw = json.loads(text)
    extra = set(raw) - {"tools", "identities", "servers", "scan", "combinations"}
    if extra:
        raise ValueError(f"unknown policy keys: {sorted(extra)}")
    from weirgate.functions.text import duration_ms

    tools = [ToolRule(t["match"], t.get("action", "allow"), tuple(t.get("roles", ())), t.get("note", "")) for t in raw.get("tools", [{"match": "*"}])]
    overrides = [ScanOverride(k, dict(v)) for k, v in (raw.get("scan", {}).get("overrides") or {}).items()]
    combos = [Combination(c["id"], tuple(c["all_of"]), duration_ms(c.get("window", "10m")), c.get("action", "deny")) for c in raw.get("combinations", [])]
    return Policy(tuple(tools), {k: list(v.get("roles", [])) for k, v in raw.get("identities", {}).items()}, {k: list(v.get("roles", [])) for k, v in raw.get("servers", {}).items()}, tuple(overrides), tuple(combos))

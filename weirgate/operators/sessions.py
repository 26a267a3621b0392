"""Whose call is it: trace and session headers, address keys, idle gaps, bearer tokens, protocol eras."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the first protocol version of the modern era.
MODERN_FROM = "2026-07-28"
#: The baggage member that names a session (a parameter).
SESSION_MEMBER = "session-id"


def traceparent_id(header: Column) -> Column:
    """The trace id of a strict W3C traceparent (version 00 has nothing behind the flags; ff is no version); else null."""
    h = header
    version, trace = F.regexp_extract(h, "^([0-9a-f]{2})-", 1), F.regexp_extract(h, "^[0-9a-f]{2}-([0-9a-f]{32})-([0-9a-f]{16})-[0-9a-f]{2}(?:$|-)", 1)
    parent = F.regexp_extract(h, "^[0-9a-f]{2}-[0-9a-f]{32}-([0-9a-f]{16})-", 1)
    good = (trace != "") & (version != "ff") & ~trace.rlike("^0+$") & ~parent.rlike("^0+$") & ((version != "00") | (F.length(h) == 55)) & (F.length(h) <= 512)
    return F.when(good, trace)


def baggage_session(header: Column, member: str = SESSION_MEMBER) -> Column:
    """The first member of that name with a value that can be decoded and isn't empty; else null."""
    parts = F.transform(F.split(header, ","), lambda p: F.trim(F.element_at(F.split(p, ";"), 1)))
    named = F.filter(parts, lambda p: F.trim(F.substring_index(p, "=", 1)) == member)
    values = F.filter(F.transform(named, lambda p: F.try_url_decode(F.trim(F.regexp_replace(p, "^[^=]*=", "")))), lambda v: v.isNotNull() & (v != ""))
    return F.get(values, 0)


def address_key(name: Column, version: Column, address: Column) -> Column:
    return F.sha2(F.concat_ws("\u0000", F.coalesce(name, F.lit("")), F.coalesce(version, F.lit("")), F.coalesce(address, F.lit(""))), 256)


def idle_sessions(rows: DataFrame, key: str, at: str, timeout_ms: int) -> DataFrame:
    """``rows`` with ``binding``: the number of the idle-gap session of its key. A gap of exactly the timeout splits."""
    w = Window.partitionBy(key).orderBy(at)
    gap = F.coalesce((F.col(at) - F.lag(at).over(w) >= timeout_ms).cast("long"), F.lit(0))
    return rows.withColumn("_gap", gap).withColumn("binding", F.sum("_gap").over(w)).drop("_gap")


def attribute(requests: DataFrame, timeout_ms: int = 1_800_000) -> DataFrame:
    """``requests`` with session_id, exact, rung: trace, then baggage, then the session header, then client and address.

    The lowest rung binds requests of one client and address until they are idle for ``timeout_ms``; it is not exact.
    """
    key = address_key(F.col("client_name"), F.col("client_version"), F.col("remote_address"))
    rows = requests.withColumn("_key", key).withColumn("_trace", traceparent_id(F.col("traceparent"))).withColumn("_bag", baggage_session(F.col("baggage")))
    header = F.when(F.trim("mcp_session_id") != "", F.trim("mcp_session_id"))
    rows = rows.withColumn("_head", header).withColumn("_low", F.coalesce("_trace", "_bag", "_head").isNull())
    low = idle_sessions(rows.where("_low"), "_key", "at_ms", timeout_ms)
    high = rows.where(~F.col("_low")).withColumn("binding", F.lit(None).cast("long"))
    both = high.unionByName(low)
    session = F.coalesce("_trace", "_bag", "_head", F.concat_ws("#", F.substring("_key", 1, 16), "binding"))
    rung = F.when(F.col("_trace").isNotNull(), "traceparent").when(F.col("_bag").isNotNull(), "baggage").when(F.col("_head").isNotNull(), "header").otherwise("address")
    return both.withColumn("session_id", session).withColumn("rung", rung).withColumn("exact", rung != "address").drop("_key", "_trace", "_bag", "_head", "_low", "binding")


def identity(flag: Column, env: Column, client: Column) -> Column:
    """A named identity: command line, then environment, then the client's own name (at most 128 characters, no controls)."""
    said = lambda c: F.when(F.trim(c) != "", F.trim(c))
    own = F.when((F.length(client) <= 128) & ~client.rlike(r"[\p{Cc}\p{Cf}]"), said(client))
    return F.coalesce(said(flag), said(env), own)


def bearer_identity(requests: DataFrame, tokens: DataFrame) -> DataFrame:
    """``requests`` (authorization) with ``identity``: of the first token row (by ordinal) whose SHA-256 the bearer token has."""
    token = F.regexp_extract("authorization", r"^(?i:bearer) +([^ ]+)$", 1)
    first = tokens.groupBy("token_sha256").agg(F.min_by("identity", "ordinal").alias("identity"))
    return requests.withColumn("token_sha256", F.when(token != "", F.sha2(token, 256))).join(first, "token_sha256", "left").drop("token_sha256")


def era(version: Column, boundary: str = MODERN_FROM) -> Column:
    return F.when(version >= boundary, "modern").otherwise("legacy")


def era_refusal(client: Column, server: Column, boundary: str = MODERN_FROM) -> Column:
    """Whether the two sides speak protocols of different eras."""
    return era(client, boundary) != era(server, boundary)

"""Hash-chained audit logs: build, verify, checkpoints, display."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirgate.session import ship

#: Fixed value: what the first record of a chain points to.
GENESIS = "0" * 64


#: A record's text with these slots filled is what its hash is taken of.
PREV_SLOT, SEQ_SLOT = '"prevHash":""', '"seq":-1'


def body(columns: list[str]):
    """The canonical text of a record: a JSON object with its keys sorted, among them empty slots for ``prevHash`` and
    ``seq``; null fields are left out. Fields may not have these two names."""
    if {"prevHash", "seq"} & set(columns):
        raise ValueError("prevHash and seq are set by the chain")
    slots = {"prevHash": F.lit("").alias("prevHash"), "seq": F.lit(-1).alias("seq")}
    return F.to_json(F.struct(*(slots.get(c, c) for c in sorted([*columns, *slots]))))


def record_hash(text, seq, prev):
    """The hash of a record: of its canonical text with its place and the hash before it."""
    linked = F.replace(text, F.lit(PREV_SLOT), F.concat(F.lit('"prevHash":"'), prev, F.lit('"')))
    return F.sha2(F.replace(linked, F.lit(SEQ_SLOT), F.concat(F.lit('"seq":'), seq.cast("string"))), 256)


def _hash(text: str, seq: int, prev: str) -> str:
    return hashlib.sha256(text.replace(PREV_SLOT, f'"prevHash":"{prev}"').replace(SEQ_SLOT, f'"seq":{seq}').encode()).hexdigest()


def build_chain(records: DataFrame, chain: str, order: str, columns: list[str]) -> DataFrame:
    """(chain, seq, body, prev_hash, hash) of every record, chained by ``order`` within ``chain``.

    The hash of a record needs the one before it, so a chain is folded by one task; its rows come as sorted Arrow
    batches (the chain's last hash is carried on), never as a whole.
    """
    ship(records.sparkSession)
    w = Window.partitionBy(chain).orderBy(order)
    rows = records.select(F.col(chain).cast("string").alias("chain"), (F.row_number().over(w) - 1).cast("long").alias("seq"), body(columns).alias("body"))

    def fold(batches):
        own, last = None, GENESIS
        for frame in batches:
            prev, now = [], []
            for c, n, text in zip(frame["chain"], frame["seq"], frame["body"], strict=True):
                p = last if c == own else GENESIS
                own, last = c, _hash(text, n, p)
                prev.append(p)
                now.append(last)
            yield pd.DataFrame({"chain": frame["chain"], "seq": frame["seq"], "body": frame["body"], "prev_hash": prev, "hash": now})

    # the window has dealt the rows by chain and sorted them already
    return rows.mapInPandas(fold, "chain string, seq long, body string, prev_hash string, hash string")


def verify_chain(log: DataFrame, chain: str = "chain", line: str = "line") -> DataFrame:
    """(chain, records, ok, at, reason): the first fault of each log, walked in the order of ``line``.

    Faults are a seq that isn't the place in the file, a prev_hash that isn't the hash before, or a hash that isn't the
    record's own, checked in that order. Logs are checked side by side, each in one task after a sort.
    """
    w = Window.partitionBy(chain).orderBy(line)
    rows = log.withColumn("place", (F.row_number().over(w) - 1).cast("long")).withColumn("before", F.coalesce(F.lag("hash").over(w), F.lit(GENESIS)))
    reason = F.when(F.col("seq") != F.col("place"), "sequence").when(F.col("prev_hash") != F.col("before"), "link").when(F.col("hash") != record_hash(F.col("body"), F.col("seq"), F.col("prev_hash")), "hash")
    marked = rows.withColumn("reason", reason)
    first = F.min(F.when(F.col("reason").isNotNull(), F.struct("place", "reason")))
    return marked.groupBy(chain).agg(F.count(F.lit(1)).alias("records"), first.alias("f")).select(chain, "records", F.col("f").isNull().alias("ok"), F.col("f.place").alias("at"), F.col("f.reason").alias("reason"))


def checkpoints(log: DataFrame, every: int, chain: str = "chain") -> DataFrame:
    """(chain, seq, head) of every ``every``-th record."""
    return log.where((F.col("seq") + 1) % every == 0).select(chain, "seq", F.col("hash").alias("head"))


def heads(log: DataFrame, chain: str = "chain") -> DataFrame:
    """(chain, seq, head) of the last record of each chain."""
    return log.groupBy(chain).agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("head"))


def match_checkpoints(log: DataFrame, points: DataFrame, chain: str = "chain") -> DataFrame:
    """``points`` with ``matches``: whether the log still has that head there."""
    own = log.select(chain, "seq", F.col("hash").alias("_hash"))
    return points.join(own, [chain, "seq"], "left").withColumn("matches", F.coalesce(F.col("_hash") == F.col("head"), F.lit(False))).drop("_hash")


def fingerprint(key: bytes):
    """A pandas UDF: HMAC-SHA256 of a text under a key that stays out of the plan."""
    import hmac

    @F.pandas_udf("string")
    def tag(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else hmac.new(key, t.encode(), hashlib.sha256).hexdigest())

    return tag


def show(log: DataFrame, chain: str = "chain") -> DataFrame:
    return log.select(chain, "seq", F.format_string("#%d %s %s", "seq", F.substring("hash", 1, 12), F.substring("body", 1, 4096)).alias("line"))


def extend_chain(built: DataFrame, heads: DataFrame) -> DataFrame:
    """Records of :func:`build_chain`, chained on to ``heads`` (chain, next, head) of the logs that they continue."""
    ship(built.sparkSession)
    w = Window.partitionBy("chain").orderBy("seq")
    rows = built.join(heads, "chain", "left").withColumn("_n", F.row_number().over(w)).select("chain", "seq", "body", F.coalesce("next", F.lit(0)).cast("long").alias("next"), F.coalesce("head", F.lit(GENESIS)).alias("head"))

    def fold(batches):
        chain, last = None, None
        for frame in batches:
            prev, now = [], []
            for c, n, text, head in zip(frame["chain"], frame["seq"] + frame["next"], frame["body"], frame["head"], strict=True):
                p = last if c == chain else head
                chain, last = c, _hash(text, n, p)
                prev.append(p)
                now.append(last)
            yield pd.DataFrame({"chain": frame["chain"], "seq": frame["seq"] + frame["next"], "body": frame["body"], "prev_hash": prev, "hash": now})

    return rows.mapInPandas(fold, "chain string, seq long, body string, prev_hash string, hash string")

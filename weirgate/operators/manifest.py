"""Tool catalogues: canonical JSON, hashes, locks and their differences."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgate.session import ship

FIELDS = ["name", "title", "description", "input_schema", "output_schema", "annotations"]
SCHEMA = "server_name string, position long, name string, title string, description string, input_schema string, output_schema string, annotations string"


def _plain(value):
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, float) and value.is_integer() and abs(value) < 2**53:
        return int(value)
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def canonical_json(value) -> str:
    """Keys sorted, no blanks, characters as they are; numbers that aren't finite are null."""
    return json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_tool(row) -> str:
    """The text that a tool's hash is taken of: absent descriptions are empty, absent schemas null, other absent fields left out."""
    load = lambda v: None if v is None or v != v else json.loads(v)
    text = lambda v: None if v is None or v != v else v
    out = {"name": text(row["name"]), "description": text(row["description"]) or "", "inputSchema": load(row["input_schema"]), "annotations": load(row["annotations"])}
    if text(row["title"]) is not None:
        out["title"] = row["title"]
    if load(row["output_schema"]) is not None:
        out["outputSchema"] = load(row["output_schema"])
    return canonical_json(out)


def hash_tools(tools: DataFrame) -> DataFrame:
    """(server_name, position, name, hash) of a tool table in ``SCHEMA``; rows without a name are dropped.

    JSON has no canonical form among the built-in functions, so the text is made in one Arrow pass; the hash is native.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"server_name": f["server_name"], "position": f["position"], "name": f["name"], "canonical": [canonical_tool(r) for r in f.to_dict("records")]})

    ship(tools.sparkSession)
    rows = tools.where("name is not null and name <> ''").select("server_name", "position", *FIELDS)
    return rows.mapInPandas(run, "server_name string, position long, name string, canonical string").select("server_name", "position", "name", F.sha2("canonical", 256).alias("hash"))


def hash_text(name, description, input_schema, annotations):
    """The native form for tools with neither title nor output schema, whose schemas are canonical texts already."""
    quote = lambda c: F.to_json(F.struct(c.alias("v")))
    part = lambda c: F.regexp_extract(quote(F.coalesce(c, F.lit(""))), r'(?s)^\{"v":(.*)\}$', 1)
    return F.sha2(F.concat(F.lit('{"annotations":'), F.coalesce(annotations, F.lit("null")), F.lit(',"description":'), part(description), F.lit(',"inputSchema":'), F.coalesce(input_schema, F.lit("null")), F.lit(',"name":'), part(name), F.lit("}")), 256)


def lock_servers(hashed: DataFrame) -> DataFrame:
    """(server_name, tools, set_hash): how many, and the hash of the JSON list of [name, hash] in the order advertised.

    A server's catalogue is one row here; catalogues are small (they are sent in one answer).
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", "name", "hash"))), lambda x: F.to_json(F.array(x["name"], x["hash"])))
    return hashed.groupBy("server_name").agg(F.count(F.lit(1)).alias("tools"), F.sha2(F.concat(F.lit("["), F.concat_ws(",", ordered), F.lit("]")), 256).alias("set_hash"))


def diff(pinned: DataFrame, current: DataFrame) -> DataFrame:
    """(server_name, name, change): tools that were added, removed or altered between two hash tables."""
    a = pinned.select("server_name", "name", F.col("hash").alias("was"))
    b = current.select("server_name", "name", F.col("hash").alias("now"))
    both = a.join(b, ["server_name", "name"], "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "altered")
    return both.select("server_name", "name", change.alias("change")).where("change is not null")


def diff_lists(changes: DataFrame) -> DataFrame:
    """(server_name, added, removed, altered): sorted names, comma-joined."""
    of = lambda c: F.concat_ws(",", F.array_sort(F.collect_list(F.when(F.col("change") == c, F.col("name"))))).alias(c)
    return changes.groupBy("server_name").agg(of("added"), of("removed"), of("altered"))


def page_walks(pages: DataFrame) -> DataFrame:
    """(server_name, walk, tools, complete, malformed) of listed pages (server_name, walk, page, name, last).

    A walk is malformed when a name comes twice or is missing; an incomplete walk can report no removals.
    """
    names = pages.groupBy("server_name", "walk", "name").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("last")).alias("last"))
    bad = (F.col("n") > 1) | F.col("name").isNull() | (F.col("name") == "")
    return names.groupBy("server_name", "walk").agg(F.count(F.lit(1)).alias("tools"), F.bool_or("last").alias("complete"), F.bool_or(bad).alias("malformed"))


def sticky_halt(checks: DataFrame) -> DataFrame:
    """``checks`` (server_name, at, pin, matched) with ``halted``: a mismatch halts the server until its pin changes.

    The first mismatch of each pin is a minimum, combined before its shuffle, so a busy server is not sorted in one task.
    Checks at the very time of the mismatch are halted; a null server or pin is one of its own.
    """
    halts = checks.where(~F.col("matched")).groupBy(F.col("server_name").alias("_server"), F.col("pin").alias("_pin")).agg(F.min("at").alias("_halt"))
    joined = checks.join(halts, F.col("server_name").eqNullSafe(F.col("_server")) & F.col("pin").eqNullSafe(F.col("_pin")), "left")
    return joined.withColumn("halted", F.coalesce(F.col("at") >= F.col("_halt"), F.lit(False))).drop("_server", "_pin", "_halt")


def first_use(pinned, matched, on_first: str = "write", on_mismatch: str = "halt"):
    """What to do with a server: pass when it matches, else by the settings for a missing pin and a mismatch."""
    return F.when(~pinned, on_first).when(matched, "pass").otherwise(on_mismatch)


def described_text(tool: dict, most_nodes: int = 5000, most_depth: int = 8) -> str:
    """Title, description, texts of annotations, and every title and description in the schemas, one a line."""
    lines = [tool[k] for k in ("title", "description") if isinstance(tool.get(k), str)]
    lines += [v for v in (tool.get("annotations") or {}).values() if isinstance(v, str)]
    queue = [(tool[k], 0) for k in ("inputSchema", "outputSchema") if tool.get(k) is not None]
    seen = 0
    while queue and seen < most_nodes:
        node, depth = queue.pop(0)
        seen += 1
        if isinstance(node, dict):
            lines += [node[k] for k in ("title", "description") if isinstance(node.get(k), str)]
        if depth < most_depth:
            queue += [(v, depth + 1) for v in (node.values() if isinstance(node, dict) else node if isinstance(node, list) else ()) if isinstance(v, dict | list)]
    return "\n".join(lines)

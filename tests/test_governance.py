"""Policies, sessions, catalogues, audit logs, judge and streams."""

from __future__ import annotations

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from weirgate.functions import spans as S
from weirgate.functions import text as T
from weirgate.functions.text import duration_ms
from weirgate.operators import audit, judge, manifest, policy, sessions
from weirgate.sources import exports, files
from weirgate.streaming import live


def calls(spark, rows):
    return spark.createDataFrame(rows, "call_id long, session_id string, server_name string, tool_name string, identity string, at_ms long")


def dealt(globs, tools):
    """Whether every glob has a call of its own, by trying all."""
    fits = [[i for i, t in enumerate(tools) if policy.re.match(policy.glob_pattern(g).replace(r"\z", r"\Z"), t)] for g in globs]
    return any(len(set(p)) == len(p) for p in itertools.product(*fits))


def test_combinations_match_brute_force(spark):
    r = random.Random(4)
    c = policy.Combination("c", ("s__a*", "s__*b", "s__ab"), 50)
    rows = [(i, f"z{r.randrange(4)}", "s", r.choice(["a", "b", "ab", "x"]), None, r.randrange(0, 400, 10)) for i in range(160)]
    got = {x.call_id: x.hit for x in policy.combination_hits(calls(spark, rows), c).collect()}
    for row in rows:
        seen = [f"s__{o[3]}" for o in rows if o[1] == row[1] and row[5] - 50 <= o[5] and (o[5], o[0]) <= (row[5], row[0])]
        mine = any(dealt((g,), [f"s__{row[3]}"]) for g in c.all_of)
        assert got[row[0]] == (mine and dealt(c.all_of, seen)), row


def test_stream_agrees_with_batch(spark, tmp_path):
    c = policy.Combination("c", ("s__a*", "s__*b"), 60)
    r = random.Random(9)
    rows = [(i, f"z{i % 3}", "s", r.choice(["a", "b", "ab", "x"]), None, i * 10) for i in range(60)]
    batch = {x.call_id: x.hit for x in policy.combination_hits(calls(spark, rows), c).collect()}
    frame = calls(spark, rows)
    for k in range(3):
        frame.where(f"call_id >= {k * 20} AND call_id < {k * 20 + 20}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.combination_stream(stream, c, forget=False).writeStream.format("memory").queryName("hits").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {x.call_id: x.hit for x in spark.table("hits").collect()} == batch


def test_access(spark):
    p = policy.Policy((policy.ToolRule("a__x*", "deny", ("guest",)), policy.ToolRule("a__?y", "deny")), {"g": ["guest"]}, {"b": ["admin"]})
    rows = [(1, "", "a", "xx", "g", 0), (2, "", "a", "xx", None, 0), (3, "", "a", "zy", "g", 0), (4, "", "b", "q", "g", 0), (5, "", "a", "x\n", "g", 0)]
    got = {r.call_id: (r.decision, r.reason, r.rule) for r in policy.access(calls(spark, rows), p).collect()}
    assert got == {1: ("deny", "rule", 0), 2: ("allow", "default", None), 3: ("deny", "rule", 1), 4: ("deny", "server", None), 5: ("allow", "default", None)}
    with pytest.raises(ValueError):
        policy.Policy(combinations=(policy.Combination("one", ("a",)),))
    assert duration_ms("10m") == 600_000


def test_idle_gap_of_exactly_the_timeout_splits(spark):
    rows = [(i, "z", "s", "t", None, at) for i, at in enumerate([0, 99, 199, 298])]
    got = sessions.idle_sessions(calls(spark, rows), "session_id", "at_ms", 100)
    assert [r.binding for r in got.orderBy("call_id").collect()] == [0, 0, 1, 1]


def test_headers(spark):
    good = "00-" + "a" * 32 + "-" + "b" * 16 + "-01"
    rows = [(good, "x=1,session-id=a%20b;p"), ("ff" + good[2:], "session-id=%zz,session-id=ok"), ("00-" + "0" * 32 + good[35:], "session-id="), (good + "-x", None), ("01" + good[2:] + "-x", "sessionid=1")]
    got = spark.createDataFrame(rows, "t string, b string").select(sessions.traceparent_id(F.col("t")).alias("t"), sessions.baggage_session(F.col("b")).alias("b")).collect()
    assert [r.t for r in got] == ["a" * 32, None, None, None, "a" * 32]
    assert [r.b for r in got] == ["a b", "ok", None, None, None]


def test_manifests(spark):
    assert manifest.canonical_json({"b": [1.0, float("inf")], "a": "ş"}) == '{"a":"ş","b":[1,null]}'
    row = ("s", 0, "t", None, "d", '{"z": 1, "a": 2}', None, None)
    tools = spark.createDataFrame([row, ("s", 1, None, *row[3:]), ("s", 2, "u", "title", *row[4:])], manifest.SCHEMA)
    hashed = manifest.hash_tools(tools)
    assert hashed.count() == 2
    same = spark.createDataFrame([("s", 5, "t", None, "d", '{"a":2,"z":1}', None, None)], manifest.SCHEMA)
    assert {(r.name, r.change) for r in manifest.diff(hashed, manifest.hash_tools(same)).collect()} == {("u", "removed")}
    native = spark.createDataFrame([("t", "d")], "n string, d string").select(manifest.hash_text(F.col("n"), F.col("d"), F.lit('{"a":2,"z":1}'), F.lit(None).cast("string")).alias("h")).first().h
    assert native == hashed.where("name = 't'").first().hash


def test_audit_log_round_trip_and_tampering(spark, tmp_path):
    rows = spark.createDataFrame([(k, i, f"t{i}") for k in ("a", "b") for i in range(7)], "chain string, n int, what string")
    log = audit.build_chain(rows, "chain", "n", ["n", "what"])
    files.write_log(log, str(tmp_path / "log"))
    back = files.read_log(spark, str(tmp_path / "log") + "/chain=*")
    assert all(r.ok for r in audit.verify_chain(back).collect()) and back.count() == 14
    swapped = back.withColumn("line", F.when(F.col("chain") == "a", -F.col("line")).otherwise(F.col("line")))
    assert {r.chain: (r.ok, r.reason) for r in audit.verify_chain(swapped).collect()} == {"a": (False, "sequence"), "b": (True, None)}
    assert all(r.matches for r in audit.match_checkpoints(back, audit.checkpoints(back, 3)).collect())


def test_audit_sink_goes_on_from_the_last_head(spark, tmp_path):
    write = live.audit_sink(str(tmp_path / "log"), "k", "n", ["n"])
    for number, rows in enumerate(([("a", 1), ("b", 2)], [("a", 3), ("a", 4), ("c", 5)], [("b", 6)])):
        write(spark.createDataFrame(rows, "k string, n int"), number)
    log = spark.read.parquet(str(tmp_path / "log")).withColumn("line", F.col("seq"))
    assert {(r.chain, r.records, r.ok) for r in audit.verify_chain(log).collect()} == {("a", 3, True), ("b", 2, True), ("c", 1, True)}


def test_judge(spark):
    asked = spark.createDataFrame([("bad",), ("bad",), ("fine",), ("boom",)], "text string")

    def answer(text):
        if text == "boom":
            raise RuntimeError
        return {"label": "injection" if text == "bad" else "benign", "confidence": 0.9}

    got = {r.digest: r.label for r in judge.ask(asked, answer).collect()}
    assert sorted(map(str, got.values())) == ["None", "benign", "injection"]
    rows = spark.createDataFrame([("allow", True, "injection", 0.9), ("block", True, "injection", 0.9), ("allow", True, "benign", 0.9), ("allow", False, "injection", 0.9), ("allow", True, None, None)], "a string, j boolean, l string, c double")
    assert [r[0] for r in rows.select(judge.apply(F.col("a"), F.col("j"), F.col("l"), F.col("c"))).collect()] == ["flag", "block", "allow", "allow", "allow"]
    assert judge.sample_bytes("é" * 50, 11) == "éé\n[...]\néé"


def test_results_and_exports(spark):
    result = json.dumps({"content": [{"type": "text", "text": "one"}, {"type": "image", "text": None}, {"type": "text", "text": "two"}]})
    df = spark.createDataFrame([(result,)], "result string")
    assert [(r.place, r.text) for r in files.result_texts(df).orderBy("place").collect()] == [(0, "one"), (2, "two")]
    new = df.select(files.replace_texts(F.col("result"), F.create_map(F.lit(2), F.lit("X"))).alias("r")).first().r
    assert [b.get("text") for b in json.loads(new)["content"]] == ["one", None, "X"]
    line = spark.range(1).select(exports.syslog_line(13, F.lit("app"), F.lit(0), F.lit("é" * 3000), 100).alias("l")).first().l
    assert len(line.encode()) <= 100 and line.startswith("<13>1 1970-01-01T00:00:00.000Z - app")


def test_policy_files():
    p = files.parse_policy('{"tools": [{"match": "a__*", "action": "deny", "roles": ["r"]}], "identities": {"u": {"roles": ["r"]}}, "combinations": [{"id": "c", "all_of": ["a", "b"], "window": "30s"}]}')
    assert p.tools[0].roles == ("r",) and p.combinations[0].window_ms == 30_000
    with pytest.raises(ValueError):
        files.parse_policy('{"tool": []}')


def test_display_quotes_are_json_without_unsafe_characters(spark):
    texts = ["", "plain é 日本", 'a"b\\c', "\b\t\n\f\r\x00\x1f\x7f\x85", "‮abc​  ­", "\U000e0041\U0001f600", "\\u202e"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.display_quoted(F.col("t")).alias("q")).collect()
    assert all(json.loads(r.q) == r.t for r in got)
    assert [r.q for r in got][3:6] == ['"\\b\\t\\n\\f\\r\\u0000\\u001f\\u007f\\u0085"', '"\\u202eabc\\u200b\\u2028\\u2029\\u00ad"', '"\\udb40\\udc41\U0001f600"']
    assert spark.range(1).select(T.display_quoted(F.lit(None).cast("string")).alias("q")).first().q is None


def test_names_and_spans_within(spark):
    row = spark.range(1)
    one = lambda c: row.select(c.alias("c")).first().c
    named = policy.Policy(servers={"a": []}, combinations=(policy.Combination("c", ("x*", "y*"), action="flag"),))
    assert [one(policy.server_name_check(F.lit(s), p, e)) for s, p, e in (("a", named, True), ("b", named, True), ("b", named, False), (None, named, True), ("b", policy.Policy(), True))] == ["ok", "error", "event", "error", "ok"]
    assert [one(policy.name_too_long(F.lit(t), named)) for t in ("x" * 4096, "x" * 4097, "\U0001f600" * 2049)] == [None, "flag", "flag"]
    spans = F.array(F.struct(F.lit(2).alias("start"), F.lit(5).alias("end")))
    assert [one(S.within(F.lit(a), F.lit(b), spans)) for a, b in ((2, 5), (3, 4), (1, 4), (4, 6))] == [True, True, False, False]

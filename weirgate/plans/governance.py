"""Registered queries over calls, sessions, catalogues, audit logs, judgements and metrics; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgate.functions import text as T
from weirgate.operators import audit, evaluate, judge, manifest, policy, score, sessions
from weirgate.plans import detection
from weirgate.sources import exports

POLICY = policy.Policy(
    tools=(
        policy.ToolRule("srv1__*", "deny", ("guest",)), policy.ToolRule("*__purchase", "allow", ("admin", "buyer")), policy.ToolRule("*__purchase", "deny"),
        policy.ToolRule("srv?__err*r", "deny", ("guest", "buyer")), policy.ToolRule("srv2__view"),
    ),
    roles={"u0": ["admin"], "u1": ["guest"], "u2": ["buyer", "guest"], "u3": [], "u4": ["buyer"]},
    servers={"srv3": ["admin", "buyer"], "srv4": ["nobody"]},
    overrides=(policy.ScanOverride("srv1__*", {"action": "block", "flag_at": 30}), policy.ScanOverride("*__view", {"block_at": 90, "on_degraded": "block"}), policy.ScanOverride("srv?__click", {"action": "strip"})),
    combinations=(policy.Combination("view-then-buy", ("*__view", "*__purchase"), 86_400_000), policy.Combination("two-clicks", ("*__click", "srv*__click"), 43_200_000), policy.Combination("three", ("*__error", "*__view", "*__*i*"), 172_800_000)),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark, sf_dir) -> DataFrame:
    """Events as tool calls."""
    e = _table(spark, sf_dir, "events")
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select(F.col("event_id").alias("call_id"), F.col("user_id").alias("session_id"), F.concat(F.lit("srv"), F.col("user_id") % 5).alias("server_name"), F.col("event_type").alias("tool_name"), F.when(F.col("user_id") % 7 < 6, F.concat(F.lit("u"), F.col("user_id") % 7)).alias("identity"), at.alias("at_ms"))


CALLS = "calls AS (SELECT event_id AS call_id, user_id AS session_id, 'srv' || user_id % 5 AS server_name, event_type AS tool_name, CASE WHEN user_id % 7 < 6 THEN 'u' || user_id % 7 END AS identity, epoch_us(ts) // 1000 AS at_ms FROM events)"


def _like(glob: str) -> str:
    return "(server_name || '__' || tool_name) LIKE '" + glob.replace("_", "\\_").replace("*", "%").replace("?", "_") + "' ESCAPE '\\'"


def _roles_sql() -> str:
    return "CASE identity " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in POLICY.roles.items() if v) + " ELSE []::VARCHAR[] END"


def access_first_match(spark, sf_dir):
    return policy.access(calls(spark, sf_dir), POLICY).select("call_id", "admitted", F.coalesce("rule", F.lit(-1)).alias("rule"), "decision", "reason")


ACCESS_FIRST_MATCH = f"""WITH {CALLS}, r AS (SELECT *, {_roles_sql()} AS roles FROM calls),
a AS (SELECT *, CASE server_name {" ".join(f"WHEN '{k}' THEN list_has_any(roles, {v!r})" for k, v in POLICY.servers.items())} ELSE true END AS admitted FROM r),
b AS (SELECT *, CASE WHEN admitted THEN CASE {" ".join(f"WHEN {_like(t.match)}" + (f" AND list_has_any(roles, {list(t.roles)!r})" if t.roles else "") + f" THEN {i}" for i, t in enumerate(POLICY.tools))} END END AS rule FROM a)
SELECT call_id, admitted, coalesce(rule, -1) AS rule, CASE WHEN NOT admitted THEN 'deny' ELSE coalesce(({[t.action for t in POLICY.tools]!r})[rule + 1], 'allow') END AS decision,
  CASE WHEN NOT admitted THEN 'server' WHEN rule IS NOT NULL THEN 'rule' ELSE 'default' END AS reason FROM b"""


def scan_override(spark, sf_dir):
    return policy.scan_settings(calls(spark, sf_dir), POLICY).select("call_id", *policy.SCAN_DEFAULTS)


def _override_sql(name: str, value) -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return "CASE " + " ".join(f"WHEN {_like(o.match)} THEN {lit(o.values.get(name, value))}" for o in POLICY.overrides) + f" ELSE {lit(value)} END AS {name}"


SCAN_OVERRIDE = f"WITH {CALLS} SELECT call_id, {', '.join(_override_sql(k, v) for k, v in policy.SCAN_DEFAULTS.items())} FROM calls"


def _combination(c: policy.Combination):
    def query(spark, sf_dir):
        return policy.combination_hits(calls(spark, sf_dir), c).select("call_id", "hit")

    return query


def _combination_sql(c: policy.Combination) -> str:
    n = len(c.all_of)
    marks = ", ".join(f"{_like(g)} AS m{i}" for i, g in enumerate(c.all_of))
    sets = [[i for i in range(n) if s >> i & 1] for s in range(1, 1 << n)]
    enough = " AND ".join(f"count(*) FILTER (WHERE {' OR '.join(f'p.m{i}' for i in s)}) >= {len(s)}" for s in sets)
    mine = " OR ".join(f"h.m{i}" for i in range(n))
    return f"""WITH {CALLS}, m AS (SELECT *, {marks} FROM calls)
SELECT h.call_id, bool_or({mine}) AND {enough} AS hit FROM m AS h JOIN m AS p ON p.session_id = h.session_id AND p.at_ms >= h.at_ms - {c.window_ms}
  AND (p.at_ms < h.at_ms OR p.at_ms = h.at_ms AND p.call_id <= h.call_id) GROUP BY h.call_id"""


def idle_gap_sessions(spark, sf_dir):
    return sessions.idle_sessions(calls(spark, sf_dir), "session_id", "at_ms", 21_600_000).select("call_id", "binding")


IDLE_GAP_SESSIONS = f"""WITH {CALLS}, g AS (SELECT *, coalesce(CASE WHEN at_ms - lag(at_ms) OVER (PARTITION BY session_id ORDER BY at_ms) >= 21600000 THEN 1 END, 0) AS gap FROM calls)
SELECT call_id, (sum(gap) OVER (PARTITION BY session_id ORDER BY at_ms))::BIGINT AS binding FROM g"""


def _requests(spark, sf_dir):
    c = calls(spark, sf_dir)
    hexa = lambda n: F.lpad(F.lower(F.hex(F.col("call_id") * 2654435761)), n, "0")
    trace = F.concat(F.when(F.col("call_id") % 3 == 0, "ff").otherwise("00"), F.lit("-"), F.when(F.col("call_id") % 4 == 0, "0" * 32).otherwise(hexa(32)), F.lit("-"), hexa(16), F.lit("-01"))
    bag = F.concat(F.lit("a=1, session-id="), F.when(F.col("call_id") % 5 == 0, "%zz").otherwise(F.concat(F.lit("s%20"), F.col("session_id"))), F.lit(";p=1"))
    return c.select("call_id", "at_ms", F.when(F.col("call_id") % 2 == 0, trace).alias("traceparent"), F.when(F.col("call_id") % 7 < 2, bag).alias("baggage"), F.when(F.col("call_id") % 6 == 1, F.concat(F.lit("m"), "session_id")).alias("mcp_session_id"), F.lit("cli").alias("client_name"), F.lit("1").alias("client_version"), F.concat(F.lit("10.0.0."), F.col("session_id") % 40).alias("remote_address"))


def session_ladder(spark, sf_dir):
    return sessions.attribute(_requests(spark, sf_dir), 3_600_000).select("call_id", "session_id", "rung", "exact")


SESSION_LADDER = rf"""WITH {CALLS}, q AS (SELECT call_id, at_ms, lpad(lower(to_hex(call_id * 2654435761)), 32, '0') AS t, CASE WHEN call_id % 2 = 0 AND call_id % 3 <> 0 AND call_id % 4 <> 0 THEN 1 END AS traced,
    CASE WHEN call_id % 7 < 2 AND call_id % 5 <> 0 THEN 's ' || session_id END AS bag, CASE WHEN call_id % 6 = 1 THEN 'm' || session_id END AS head,
    sha256('cli' || chr(0) || '1' || chr(0) || '10.0.0.' || session_id % 40) AS k FROM calls),
p AS (SELECT *, CASE WHEN traced = 1 THEN t END AS trace FROM q),
low AS (SELECT call_id, sum(gap) OVER (PARTITION BY k ORDER BY at_ms) AS binding FROM (
  SELECT call_id, k, at_ms, coalesce(CASE WHEN at_ms - lag(at_ms) OVER (PARTITION BY k ORDER BY at_ms) >= 3600000 THEN 1 END, 0) AS gap FROM p WHERE trace IS NULL AND bag IS NULL AND head IS NULL))
SELECT p.call_id, coalesce(trace, bag, head, k[1:16] || '#' || binding) AS session_id, CASE WHEN trace IS NOT NULL THEN 'traceparent' WHEN bag IS NOT NULL THEN 'baggage' WHEN head IS NOT NULL THEN 'header' ELSE 'address' END AS rung,
  coalesce(trace, bag, head) IS NOT NULL AS exact FROM p LEFT JOIN low USING (call_id)"""


def bearer_auth(spark, sf_dir):
    c = calls(spark, sf_dir).select("call_id", F.concat(F.when(F.col("call_id") % 3 == 0, "Basic ").otherwise("bearer "), F.lit("tok"), F.col("session_id") % 9).alias("authorization"))
    tokens = spark.range(6).select(F.sha2(F.concat(F.lit("tok"), F.col("id") % 4), 256).alias("token_sha256"), F.concat(F.lit("id"), "id").alias("identity"), F.col("id").alias("ordinal"))
    return sessions.bearer_identity(c, tokens).select("call_id", "identity")


BEARER_AUTH = f"WITH {CALLS} SELECT call_id, CASE WHEN call_id % 3 <> 0 AND session_id % 9 < 4 THEN 'id' || session_id % 9 END AS identity FROM calls"


# --- catalogues and audit --------------------------------------------------------------------------------------


def _tools(spark, sf_dir, version: int) -> DataFrame:
    p = _table(spark, sf_dir, "part").where(F.col("p_partkey") % 13 != version)
    note = F.when((F.lit(version) > 0) & (F.col("p_partkey") % 17 == 0), "!").otherwise("")
    return p.select(F.concat(F.lit("srv"), F.col("p_partkey") % 9).alias("server_name"), F.col("p_partkey").cast("long").alias("position"), F.concat(F.lit("tool"), "p_partkey").alias("name"), F.lit(None).cast("string").alias("title"), F.concat(F.col("p_name"), note).alias("description"), F.concat(F.lit('{"type": "object", "n": '), "p_partkey", F.lit("}")).alias("input_schema"), F.lit(None).cast("string").alias("output_schema"), F.lit(None).cast("string").alias("annotations"))


def _tools_sql(version: int) -> str:
    note = "CASE WHEN p_partkey % 17 = 0 THEN '!' ELSE '' END" if version else "''"
    text = f"""'{{"annotations":null,"description":' || to_json(p_name || {note}) || ',"inputSchema":{{"n":' || p_partkey || ',"type":"object"}},"name":"tool' || p_partkey || '"}}'"""
    return f"SELECT 'srv' || p_partkey % 9 AS server_name, p_partkey AS position, 'tool' || p_partkey AS name, sha256({text}) AS hash FROM part WHERE p_partkey % 13 <> {version}"


def manifest_hash(spark, sf_dir):
    return manifest.hash_tools(_tools(spark, sf_dir, 0)).select("server_name", "name", "hash")


MANIFEST_HASH = f"SELECT server_name, name, hash FROM ({_tools_sql(0)})"


def manifest_lock(spark, sf_dir):
    return manifest.lock_servers(manifest.hash_tools(_tools(spark, sf_dir, 0)))


MANIFEST_LOCK = f"""SELECT server_name, count(*) AS tools, sha256('[' || string_agg('["' || name || '","' || hash || '"]', ',' ORDER BY position, name, hash) || ']') AS set_hash FROM ({_tools_sql(0)}) GROUP BY server_name"""


def manifest_diff(spark, sf_dir):
    return manifest.diff_lists(manifest.diff(manifest.hash_tools(_tools(spark, sf_dir, 0)), manifest.hash_tools(_tools(spark, sf_dir, 1))))


MANIFEST_DIFF = f"""WITH d AS (SELECT coalesce(a.server_name, b.server_name) AS server_name, coalesce(a.name, b.name) AS name,
    CASE WHEN a.hash IS NULL THEN 'added' WHEN b.hash IS NULL THEN 'removed' WHEN a.hash <> b.hash THEN 'altered' END AS change
  FROM ({_tools_sql(0)}) a FULL JOIN ({_tools_sql(1)}) b ON a.server_name = b.server_name AND a.name = b.name)
SELECT server_name, {", ".join(f"coalesce(string_agg(name, ',' ORDER BY name) FILTER (change = '{c}'), '') AS {c}" for c in ("added", "removed", "altered"))} FROM d WHERE change IS NOT NULL GROUP BY server_name"""


def sticky_halts(spark, sf_dir):
    c = calls(spark, sf_dir).select("call_id", "server_name", F.struct("at_ms", "call_id").alias("at"), F.floor(F.col("at_ms") / 604_800_000).alias("pin"), (F.col("call_id") % 97 != 0).alias("matched"))
    return manifest.sticky_halt(c).select("call_id", "halted")


STICKY_HALTS = f"WITH {CALLS} SELECT call_id, max((call_id % 97 = 0)::INT) OVER (PARTITION BY server_name, at_ms // 604800000 ORDER BY at_ms, call_id ROWS UNBOUNDED PRECEDING) = 1 AS halted FROM calls"


def _chain(spark, sf_dir):
    return audit.build_chain(calls(spark, sf_dir).withColumn("_chain", F.col("session_id").cast("string")), "_chain", "call_id", ["call_id", "tool_name", "at_ms"])


_CHAIN_SQL = f"""WITH RECURSIVE {CALLS}, r AS (SELECT session_id::VARCHAR AS chain, row_number() OVER (PARTITION BY session_id ORDER BY call_id) - 1 AS seq,
    '{{"at_ms":' || at_ms || ',"call_id":' || call_id || ',"prevHash":"' AS before, ',"tool_name":"' || tool_name || '"}}' AS after FROM calls),
k AS (SELECT chain, seq, repeat('0', 64) AS prev_hash, sha256(before || repeat('0', 64) || '","seq":' || seq || after) AS hash FROM r WHERE seq = 0
  UNION ALL SELECT r.chain, r.seq, k.hash, sha256(r.before || k.hash || '","seq":' || r.seq || r.after) FROM k JOIN r ON r.chain = k.chain AND r.seq = k.seq + 1)"""


def audit_build(spark, sf_dir):
    return _chain(spark, sf_dir).select("chain", "seq", "prev_hash", "hash")


AUDIT_BUILD = f"{_CHAIN_SQL} SELECT chain, seq, prev_hash, hash FROM k"


def audit_heads(spark, sf_dir):
    return audit.heads(_chain(spark, sf_dir))


AUDIT_HEADS = f"{_CHAIN_SQL} SELECT chain, max(seq) AS seq, max_by(hash, seq) AS head FROM k GROUP BY chain"


def audit_tamper(spark, sf_dir):
    """Logs with a changed body, a changed link, a lost line or none of these, and what verification says of them."""
    log = _chain(spark, sf_dir).withColumn("line", F.col("seq"))
    n = F.col("chain").cast("long")
    log = log.where(~((n % 5 == 1) & (F.col("seq") == 3)))
    log = log.withColumn("body", F.when((n % 5 == 2) & (F.col("seq") == 4), F.concat("body", F.lit(" "))).otherwise(F.col("body")))
    log = log.withColumn("prev_hash", F.when((n % 5 == 3) & (F.col("seq") == 5), audit.GENESIS).otherwise(F.col("prev_hash")))
    return audit.verify_chain(log).withColumn("at", F.coalesce("at", F.lit(-1)))


AUDIT_TAMPER = f"""{_CHAIN_SQL}, n AS (SELECT chain, count(*) AS c FROM k GROUP BY chain), x AS (SELECT chain, chain::BIGINT % 5 AS m, c FROM n)
SELECT chain, CASE WHEN m = 1 AND c > 3 THEN c - 1 ELSE c END AS records,
  NOT (m = 1 AND c > 4 OR m = 2 AND c > 4 OR m = 3 AND c > 5) AS ok,
  CASE WHEN m = 1 AND c > 4 THEN 3 WHEN m = 2 AND c > 4 THEN 4 WHEN m = 3 AND c > 5 THEN 5 ELSE -1 END AS at,
  CASE WHEN m = 1 AND c > 4 THEN 'sequence' WHEN m = 2 AND c > 4 THEN 'hash' WHEN m = 3 AND c > 5 THEN 'link' END AS reason FROM x"""


def audit_checkpoints(spark, sf_dir):
    return audit.checkpoints(_chain(spark, sf_dir), 10)


AUDIT_CHECKPOINTS = f"{_CHAIN_SQL} SELECT chain, seq, hash AS head FROM k WHERE (seq + 1) % 10 = 0"


# --- judge and metrics -----------------------------------------------------------------------------------------


def judge_band(spark, sf_dir):
    s = detection.score_combine(spark, sf_dir)
    judged = judge.in_band(F.col("score"), F.col("corroborated"), F.col("item") % 9 == 0, band_from=20)
    label, sure = F.when(F.col("item") % 2 == 0, "injection").otherwise("benign"), F.col("item") % 10 / 10
    action = F.when(F.col("score") >= 70, "strip").when(F.col("score") >= 40, "flag").otherwise("allow")
    return s.select("item", judged.alias("judged"), judge.apply(action, judged, label, sure, "flag", 0.3).alias("action"))


JUDGE_BAND = f"""WITH {detection._FINDINGS_SQL}, j AS (SELECT *, item % 9 <> 0 AND CASE WHEN score >= 70 THEN NOT corroborated ELSE score >= 20 END AS judged FROM scored)
SELECT item, judged, CASE WHEN score >= 70 THEN 'strip' WHEN score >= 40 THEN 'flag' WHEN judged AND item % 2 = 0 AND item % 10 >= 3 THEN 'flag' ELSE 'allow' END AS action FROM j"""


def score_distribution(spark, sf_dir):
    return evaluate.score_bands(detection.score_combine(spark, sf_dir))


SCORE_DISTRIBUTION = f"WITH {detection._FINDINGS_SQL} SELECT CASE WHEN score = 0 THEN '0' WHEN score < 20 THEN '1-19' WHEN score < 40 THEN '20-39' WHEN score < 70 THEN '40-69' ELSE '70+' END AS band, corroborated, count(*) AS items FROM scored GROUP BY ALL"


def _scored(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id")
    return docs.select("doc_id", F.col("lang").alias("family"), (F.col("toxic") == 1).alias("positive"), ((F.col("n_chars") * 31 + F.col("toxic") * 40) % 100).cast("int").alias("score"))


_SCORED_SQL = "s AS (SELECT doc_id, lang AS family, toxic = 1 AS positive, ((n_chars * 31 + toxic * 40) % 100)::INT AS score FROM documents JOIN labels USING (doc_id))"
THRESHOLDS = list(range(20, 81, 2))


def metrics_sweep(spark, sf_dir):
    s = evaluate.sweep(_scored(spark, sf_dir), THRESHOLDS)
    return s.select("threshold", "positives", "negatives", "caught", "fired", *[F.round(c, 6).alias(c) for c in ("recall", "fpr", "precision", "f1")], "margin")


METRICS_SWEEP = f"""WITH {_SCORED_SQL}, g AS (SELECT threshold, count(*) FILTER (positive) AS positives, count(*) FILTER (NOT positive) AS negatives,
    count(*) FILTER (positive AND score >= threshold) AS caught, count(*) FILTER (NOT positive AND score >= threshold) AS fired,
    min(score) FILTER (positive AND score >= threshold) - max(score) FILTER (NOT positive AND score < threshold) AS margin
  FROM s, (SELECT unnest({THRESHOLDS}) AS threshold) GROUP BY threshold),
h AS (SELECT *, caught / positives AS r, fired / negatives AS q, CASE WHEN caught + fired > 0 THEN caught / (caught + fired) ELSE 1 END AS p FROM g)
SELECT threshold, positives, negatives, caught, fired, round(r, 6) AS recall, round(q, 6) AS fpr, round(p, 6) AS precision, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, margin FROM h"""


def family_breakdown(spark, sf_dir):
    return evaluate.breakdown(_scored(spark, sf_dir).withColumn("fired", F.col("score") >= 40))


FAMILY_BREAKDOWN = f"WITH {_SCORED_SQL} SELECT coalesce(family, 'all') AS family, positive, count(*) AS total, count(*) FILTER (score >= 40) AS caught FROM s GROUP BY GROUPING SETS ((family, positive), (positive))"


def percentiles(spark, sf_dir):
    return evaluate.nearest_rank(_table(spark, sf_dir, "documents"), ["lang"], "n_chars", {"p50": 0.5, "p95": 0.95, "p99": 0.99, "top": 1.0})


PERCENTILES = "WITH l AS (SELECT lang, list(n_chars ORDER BY n_chars) AS v, count(*) AS n FROM documents GROUP BY lang) SELECT lang, n, " + ", ".join(f"v[least(n - 1, floor({q} * n)::BIGINT) + 1] AS {k}" for k, q in (("p50", "0.5"), ("p95", "0.95"), ("p99", "0.99"), ("top", "1.0"))) + " FROM l"


def span_matching(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    span = lambda shift: e.select(F.col("user_id").alias("id"), F.col("event_type").alias("kind"), (F.col("event_id") % 50).alias("start"), (F.col("event_id") % 50 + shift).alias("end"))
    return evaluate.match_spans(span(5).where("start < 40"), span(5).where("start > 10"))


SPAN_MATCHING = """WITH a AS (SELECT DISTINCT user_id AS id, event_type AS kind, event_id % 50 AS s FROM events)
SELECT kind, count(*) FILTER (s < 40) AS truth, count(*) FILTER (s > 10 AND s < 40) AS matched, count(*) FILTER (s >= 40) AS stray FROM a GROUP BY kind"""


def telemetry_records(spark, sf_dir):
    record = exports.otlp_record(F.col("at_ms"), F.lit("tool.call"), F.lit("tool_call"), {"server": F.col("server_name"), "tool": F.col("tool_name"), "call": F.col("call_id")}, F.col("call_id") % 3 == 0, ("call",))
    return calls(spark, sf_dir).select("call_id", F.sha2(record, 256).alias("record"), exports.syslog_line(13, F.lit("weirgate"), F.col("at_ms"), F.concat_ws(" ", "server_name", "tool_name"), 80).alias("line"))


TELEMETRY_RECORDS = f"""WITH {CALLS} SELECT call_id, sha256('{{"timeUnixNano":"' || at_ms * 1000000 || '","severityNumber":' || CASE WHEN call_id % 3 = 0 THEN '13,"severityText":"WARN"' ELSE '9,"severityText":"INFO"' END || ',"eventName":"tool.call","body":{{"stringValue":"tool_call"}},"attributes":[{{"key":"server","value":{{"stringValue":"' || server_name || '"}}}},{{"key":"tool","value":{{"stringValue":"' || tool_name || '"}}}},{{"key":"call","value":{{"intValue":' || call_id || '}}}}]}}') AS record,
  ('<13>1 ' || strftime(make_timestamp_ms(at_ms), '%Y-%m-%dT%H:%M:%S.') || lpad((at_ms % 1000)::VARCHAR, 3, '0') || 'Z - weirgate - - - ' || server_name || ' ' || tool_name)[1:80] AS line FROM calls"""


def server_names(spark, sf_dir):
    c = calls(spark, sf_dir).withColumn("tool_name", F.repeat("tool_name", F.col("call_id") % 1000))
    return c.select("call_id", policy.server_name_check(F.col("server_name"), POLICY).alias("server"), policy.name_too_long(F.col("tool_name"), POLICY).alias("name"))


SERVER_NAMES = f"""WITH {CALLS} SELECT call_id, CASE WHEN server_name IN ({", ".join(f"'{k}'" for k in POLICY.servers)}) THEN 'ok' ELSE 'error' END AS server,
  CASE WHEN length(tool_name) * (call_id % 1000) > {policy.MAX_TRACKED_NAME} THEN 'deny' END AS name FROM calls"""


def latency_added(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("event_type", (F.col("event_id") * 37 % 1009).alias("direct"), (F.col("event_id") * 41 % 2003).alias("guarded"))
    stats = [evaluate.latency_stats(e, ["event_type"], c) for c in ("guarded", "direct")]
    return evaluate.added_latency(*stats, ["event_type"]).withColumn("mean", F.round("mean", 6))


_STATS_SQL = ", ".join(f"list_sort(list({{0}}))[least(count(*) - 1, floor({q} * count(*))::BIGINT) + 1] AS {k}" for k, q in evaluate.LATENCY.items())
LATENCY_ADDED = f"""WITH e AS (SELECT event_type, event_id * 37 % 1009 AS direct, event_id * 41 % 2003 AS guarded FROM events),
g AS (SELECT event_type, count(*) AS n, avg(guarded) AS mean, {_STATS_SQL.format("guarded")} FROM e GROUP BY 1), d AS (SELECT event_type, count(*) AS n, avg(direct) AS mean, {_STATS_SQL.format("direct")} FROM e GROUP BY 1)
SELECT event_type, least(g.n, d.n) AS n, {", ".join(f"g.{k} - d.{k} AS {k}" for k in evaluate.LATENCY)}, round(g.mean - d.mean, 6) AS mean FROM g JOIN d USING (event_type)"""


def blocked_stubs(spark, sf_dir):
    c = calls(spark, sf_dir)
    return c.select("call_id", score.blocked_stub(F.when(F.col("call_id") % 2 == 0, "block").otherwise("flag"), F.col("call_id") % 7, "r1").alias("stub"))


BLOCKED_STUBS = """SELECT event_id AS call_id, '{"isError":true,"content":[{"type":"text","text":"[weirgate] content withheld · ' || event_id % 7 || ' finding(s) · ruleset r1 · action ' || CASE WHEN event_id % 2 = 0 THEN 'block' ELSE 'flag' END || '"}]}' AS stub FROM events"""


def display_quotes(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    shown = F.concat(F.lit("\x1b\x08\u202e\\\""), F.when(F.col("doc_id") % 3 == 0, F.lit("\U000e0041\u2028")).otherwise(F.lit("\x7f\u200b")), "text")
    return d.select("doc_id", F.sha2(T.display_quoted(shown), 256).alias("quoted"))


DISPLAY_QUOTES = r"""WITH t AS (SELECT doc_id, chr(27) || chr(8) || chr(8238) || chr(92) || '"' || CASE WHEN doc_id % 3 = 0 THEN chr(917569) || chr(8232) ELSE chr(127) || chr(8203) END || text AS s FROM documents),
q AS (SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(s, '\', '\\'), '"', '\"'), chr(8), '\b'), chr(9), '\t'), chr(10), '\n'), chr(12), '\f'), chr(13), '\r') AS s FROM t)
SELECT doc_id, sha256('"' || list_reduce(list_prepend(s, list_distinct(regexp_extract_all(s, '[\p{Cc}\p{Cf}\x{2028}\x{2029}]'))), lambda a, ch: replace(a, ch, CASE WHEN unicode(ch) < 65536 THEN '\u' || format('{:04x}', unicode(ch))
  ELSE '\u' || format('{:04x}', 55296 + ((unicode(ch) - 65536) >> 10)) || '\u' || format('{:04x}', 56320 + ((unicode(ch) - 65536) & 1023)) END)) || '"') AS quoted FROM q"""


def queries() -> dict:
    own = (access_first_match, scan_override, idle_gap_sessions, session_ladder, bearer_auth, manifest_hash, manifest_lock, manifest_diff, sticky_halts, audit_build, audit_heads, audit_tamper, audit_checkpoints, judge_band, score_distribution, metrics_sweep, family_breakdown, percentiles, span_matching, telemetry_records, server_names, latency_added, blocked_stubs, display_quotes)
    return {f.__name__: f for f in own} | {f"combination_{c.id.replace('-', '_')}": _combination(c) for c in POLICY.combinations}


def oracle_sql() -> dict[str, str]:
    own = {k.lower(): v for k, v in globals().items() if k.isupper() and isinstance(v, str) and k.lower() in queries()}
    return own | {f"combination_{c.id.replace('-', '_')}": _combination_sql(c) for c in POLICY.combinations}

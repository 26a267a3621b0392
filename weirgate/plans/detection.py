"""Registered queries over texts: normalisation, recognisers, detectors, scoring; with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgate.functions import checksums as C
from weirgate.functions import spans as S
from weirgate.functions import text as X
from weirgate.operators import detect, kernel, recognise, score
from weirgate.plans.content import content, content_sql, quoted
from weirgate.rules import data

ROWS = f"WITH c AS ({content_sql()})\n"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _count_sql(pattern: str, column: str = "text") -> str:
    return f"len(regexp_extract_all({column}, {quoted(pattern)}))"


# --- normalisation ---------------------------------------------------------------------------------------------


def text_shape(spark, sf_dir):
    c = content(spark, sf_dir).select("id", X.shape(F.col("text")).alias("s"), X.byte_length(F.col("text")).alias("n_bytes"))
    return c.select("id", "n_bytes", "s.headings", "s.code_chars", "s.comments", "s.doc_like")


TEXT_SHAPE = ROWS + rf"""
SELECT id, strlen(text)::BIGINT AS n_bytes, headings, code_chars, comments, headings >= 3 OR code_chars * 4 > length(text) AS doc_like FROM (
  SELECT id, text, {_count_sql("(?m)^#{1,6}[ \\t\\n\\f\\r]")} AS headings, {_count_sql("(?s)<!--.*?-->")} AS comments,
    (coalesce(list_sum(list_transform(regexp_extract_all(text, '(?s)```.*?```|~~~.*?~~~'), lambda x: length(x))), 0)
     + coalesce(list_sum(list_transform(regexp_extract_all(regexp_replace(text, '(?s)```.*?```|~~~.*?~~~', chr(10), 'g'), '`[^`\n]+`'), lambda x: length(x))), 0))::BIGINT AS code_chars
  FROM c)"""


def fold_skeleton(spark, sf_dir):
    folded = X.case_fold(F.col("text"))
    return content(spark, sf_dir).select("id", F.sha2(folded, 256).alias("folded"), F.sha2(X.skeleton_fold(folded), 256).alias("skeleton"), F.sha2(X.keyword_fold(F.col("text")), 256).alias("keyword"))


FOLD_SKELETON = ROWS + f"""
SELECT id, sha256(f) AS folded, sha256(translate(f, '{X.ACCENTS + X.LOOKALIKES}', '{X.PLAIN + X.LATIN}')) AS skeleton,
       sha256(translate(lower(replace(text, 'İ', 'i')), '{X.ACCENTS}', '{X.PLAIN}')) AS keyword
FROM (SELECT id, text, lower(translate(text, '{X.UPPER_TR}', '{X.LOWER_TR}')) AS f FROM c)"""


def hidden_characters(spark, sf_dir):
    return content(spark, sf_dir).select("id", X.hidden(F.col("text")).alias("h")).select("id", "h.tags", "h.bidi", "h.overrides", "h.depth", "h.zero_width", "h.variation", "h.rtl")


HIDDEN_CHARACTERS = ROWS + f"""
SELECT id, {_count_sql(X.TAGS)} AS tags, {_count_sql(X.BIDI)} AS bidi, {_count_sql(chr(91) + "\\x{202D}\\x{202E}]")} AS overrides,
  {_count_sql("[\\x{202A}\\x{202B}\\x{202D}\\x{202E}\\x{2066}-\\x{2068}]")} - {_count_sql("[\\x{202C}\\x{2069}]")} AS depth,
  {_count_sql(X.ZERO_WIDTH)} AS zero_width, {_count_sql(X.VARIATION)} AS variation, regexp_matches(text, {quoted(X.RTL)}) AS rtl FROM c"""


def fnv_split(spark, sf_dir):
    return content(spark, sf_dir).select("id", X.fnv1a32(F.col("id")).alias("hash")).select("id", "hash", F.when(F.col("hash") % 2 == 0, "calibration").otherwise("validation").alias("split"))


FNV_SPLIT = ROWS + """
SELECT id, hash, CASE WHEN hash % 2 = 0 THEN 'calibration' ELSE 'validation' END AS split FROM (
  SELECT id, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(id, ''), lambda x: ascii(x)::BIGINT)), lambda h, x: xor(h, x) * 16777619 % 4294967296) AS hash FROM c)"""


# --- identifiers -----------------------------------------------------------------------------------------------

#: Candidates without lookaround, each between characters that may not adjoin it; group 1 is the candidate.
_SQL_CANDIDATES = {
    "tckn": ("[0-9]+", "length(v) = 11 AND v[1] <> '0'"),
    "vkn": ("[0-9]+", "length(v) = 10"),
    "ssn_us": ("[0-9-]+", r"regexp_full_match(v, '[0-9]{3}-[0-9]{2}-[0-9]{4}')"),
    "mbi_us": ("[A-Za-z0-9-]+", r"regexp_full_match(v, '[1-9][A-Za-z][A-Za-z0-9][0-9]-?[A-Za-z][A-Za-z0-9][0-9]-?[A-Za-z]{2}[0-9]{2}')"),
    "atc": ("[A-Za-z0-9]+", r"regexp_full_match(v, '[ABCDGHJLMNPRSV][0-9]{2}[A-Z]{2}[0-9]{2}')"),
    "email": (r"(?i)\b[a-z0-9._%+-]{1,64}@[a-z0-9.-]{1,255}\.[a-z]{2,24}\b", r"NOT regexp_matches(v, '(?i)@(example\.(com|org|net)|.*\.(invalid|test|localhost))$')"),
    "iban": (r"\b[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{1,4}){2,8}\b", "true"),
}


def _d(i: int, v: str = "v") -> str:
    return f"{v}[{i + 1}]::INT"


def _tckn_sql() -> str:
    odd, even, ten = ("(" + " + ".join(_d(i) for i in r) + ")" for r in (range(0, 9, 2), range(1, 8, 2), range(10)))
    return f"((({odd} * 7 - {even}) % 10 + 10) % 10 = {_d(9)} AND {ten} % 10 = {_d(10)})"


def _vkn_sql() -> str:
    parts = [f"(CASE WHEN ({_d(i)} + {9 - i}) % 10 = 0 THEN 0 WHEN (({_d(i)} + {9 - i}) % 10) * {2 ** (9 - i)} % 9 = 0 THEN 9 ELSE (({_d(i)} + {9 - i}) % 10) * {2 ** (9 - i)} % 9 END)" for i in range(9)]
    return f"((10 - ({' + '.join(parts)}) % 10) % 10 = {_d(9)})"


_IBAN_SQL = f"""(regexp_full_match(w, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{1,30}}')
  AND CASE {" ".join(f"WHEN w[1:2] = '{k}' THEN length(w) = {n}" for k, n in C.IBAN_LENGTHS.items())} ELSE true END
  AND list_reduce(list_prepend(0::BIGINT, list_transform(string_split(w[5:] || w[1:4], ''), lambda x: CASE WHEN x >= 'A' THEN ascii(x) - 55 ELSE x::BIGINT END)),
      lambda r, x: CASE WHEN x > 9 THEN (r * 100 + x) % 97 ELSE (r * 10 + x) % 97 END) = 1)"""

_VALID_SQL = {
    "tckn": _tckn_sql(),
    "vkn": _vkn_sql(),
    "iban": _IBAN_SQL.replace("w", "replace(v, ' ', '')").replace("lambda replace(v, ' ', '')", "lambda w"),
    "ssn_us": "(v[1:3] NOT IN ('000', '666') AND v[1] <> '9' AND v[5:6] <> '00' AND v[8:11] <> '0000')",
    "mbi_us": rf"regexp_full_match(upper(replace(v, '-', '')), '[1-9][{C.MBI_LETTERS}][{C.MBI_LETTERS}0-9][0-9][{C.MBI_LETTERS}][{C.MBI_LETTERS}0-9][0-9][{C.MBI_LETTERS}]{{2}}[0-9]{{2}}')",
}


def _identifier(kind: str):
    def query(spark, sf_dir):
        spans = recognise.recognise(F.col("text"), kind)
        return content(spark, sf_dir).select("id", F.size(spans).cast("long").alias("n"), S.show(spans).alias("spans"))

    return query


def _identifier_sql(kind: str) -> str:
    pattern, shape = _SQL_CANDIDATES[kind]
    p, valid = quoted(pattern), _VALID_SQL.get(kind, "true")
    return ROWS + f"""
, m AS (SELECT id, regexp_extract_all(text, {p}) AS m, string_split_regex(text, {p}) AS p FROM c),
x AS (SELECT id, m[i] AS v, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s
      FROM (SELECT id, m, p, unnest(list_filter(range(1, len(m) + 1), lambda i: length(m[i]) >= 5)) AS i FROM m)),
y AS (SELECT id, '{kind}:' || s || ':' || (s + length(v)) AS t, s FROM (SELECT * FROM x WHERE {shape}) WHERE {valid})
SELECT c.id, count(t) AS n, coalesce(string_agg(t, ',' ORDER BY s), '') AS spans FROM c LEFT JOIN y ON c.id = y.id GROUP BY c.id"""


def mask_email(spark, sf_dir):
    docs = _table(spark, sf_dir, "pages").select(F.concat(F.lit("page-"), "page_id").alias("id"), F.col("html").alias("text")).unionByName(content(spark, sf_dir).select("id", "text"))
    spans = recognise.recognise(F.col("text"), "email")
    return docs.select("id", F.size(spans).cast("long").alias("n"), F.sha2(recognise.mask_text(F.col("text"), spans), 256).alias("masked"))


MASK_EMAIL = ROWS + rf"""
, t AS (SELECT 'page-' || page_id AS id, coalesce(html, '') AS text FROM pages UNION ALL SELECT id, text FROM c),
e AS (SELECT id, text, regexp_extract_all(text, {quoted(_SQL_CANDIDATES["email"][0])}) AS m, string_split_regex(text, {quoted(_SQL_CANDIDATES["email"][0])}) AS p FROM t),
f AS (SELECT id, p, list_transform(m, lambda v: CASE WHEN {_SQL_CANDIDATES["email"][1]} THEN '[EMAIL:***]' ELSE v END) AS r, list_filter(m, lambda v: {_SQL_CANDIDATES["email"][1]}) AS k FROM e)
SELECT id, len(k) AS n, sha256(array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || coalesce(r[i], '')), '')) AS masked FROM f"""


def pii_card(spark, sf_dir):
    spans = recognise.recognise(F.col("text"), "card")
    schemes = F.transform(spans, lambda s: F.concat_ws(":", C.card_scheme(F.regexp_replace(s["value"], "[ -]", "")), F.regexp_replace(s["value"], "[ -]", "")))
    return content(spark, sf_dir).select("id", F.size(spans).cast("long").alias("n"), F.concat_ws(",", schemes).alias("cards"))


# every character that may stand beside a number is doubled, so that two neighbours don't share their border
PII_CARD = ROWS + r"""
, w AS (SELECT id, regexp_replace(text, '([^0-9.])', '\1\1', 'g') AS text FROM c),
v AS (SELECT id, list_transform(regexp_extract_all(text, '(?:^|[^0-9.])((?:[0-9](?:  |--)?){12,18}[0-9])(?:$|[^0-9.])', 1), lambda x: regexp_replace(x, '[ -]', '', 'g')) AS v FROM w),
s AS (SELECT id, list_filter(list_transform(v, lambda d: CASE
    WHEN regexp_matches(d, '^97[89]') THEN NULL
    WHEN list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 0 THEN CASE WHEN d[-i]::INT * 2 > 9 THEN d[-i]::INT * 2 - 9 ELSE d[-i]::INT * 2 END ELSE d[-i]::INT END)) % 10 <> 0 THEN NULL
    WHEN d[1] = '4' AND length(d) IN (13, 16, 19) THEN 'visa:' || d
    WHEN regexp_matches(d, '^(5[1-5]|22[2-9]|2[3-6][0-9]|27[01]|2720)') AND length(d) = 16 THEN 'mastercard:' || d
    WHEN regexp_matches(d, '^3[47]') AND length(d) = 15 THEN 'amex:' || d
    WHEN starts_with(d, '9792') AND length(d) IN (16, 19) THEN 'troy:' || d
    WHEN starts_with(d, '62') AND length(d) BETWEEN 16 AND 19 THEN 'unionpay:' || d
    WHEN regexp_matches(d, '^(6011|65|64[4-9])') AND length(d) = 16 THEN 'discover:' || d END), lambda x: x IS NOT NULL) AS k FROM v)
SELECT id, len(k) AS n, array_to_string(k, ',') AS cards FROM s"""


def gs1_check(spark, sf_dir):
    code = F.lpad(F.col("p_partkey").cast("string"), 14, "0")
    return _table(spark, sf_dir, "part").select("p_partkey", C.gs1(code).alias("valid"))


GS1_CHECK = """
SELECT p_partkey, (10 - list_sum(list_transform(range(1, 14), lambda i: d[14 - i]::INT * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END)) % 10) % 10 = d[14]::INT AS valid
FROM (SELECT p_partkey, lpad(p_partkey::VARCHAR, 14, '0') AS d FROM part)"""


# --- detectors and score ---------------------------------------------------------------------------------------


def _ids(findings: Column) -> Column:
    return F.concat_ws(",", F.array_sort(F.transform(findings, lambda f: F.concat_ws(":", f["rule_id"], f["weight"].cast("string")))))


def exfil_detector(spark, sf_dir):
    return content(spark, sf_dir).select("id", _ids(detect.exfil_findings(F.col("text"))).alias("findings"))


_TOOL_SQL = [p.replace(detect.L, r"(?:^|[^A-Za-z0-9_])").replace(detect.R, r"(?:$|[^A-Za-z0-9_])") for p in (detect.TOOL_CALL, detect.TOOL_CALL_TR)]
EXFIL_DETECTOR = ROWS + rf"""
SELECT id, array_to_string(list_sort(list_concat(
  list_transform(regexp_extract_all(text, {quoted(detect.BEACON)}), lambda m: CASE WHEN regexp_matches(m, {quoted(detect.CARRIES)}) THEN 'exfil.beacon-payload:720' ELSE 'exfil.beacon:460' END),
  CASE WHEN regexp_matches(text, {quoted(_TOOL_SQL[0])}) OR regexp_matches(text, {quoted(_TOOL_SQL[1])}) THEN ['exfil.tool-invocation:640'] ELSE [] END)), ',') AS findings FROM c"""


def unicode_detector(spark, sf_dir):
    """Tag characters, direction controls and dense zero-width characters."""
    return content(spark, sf_dir).select("id", _ids(detect.unicode_findings(F.col("text"))).alias("findings"))


# pictures are doubled, so that a joiner's two neighbours are its own
UNICODE_DETECTOR = ROWS + f"""
, h AS (SELECT id, {_count_sql(X.TAGS)} AS tags, {_count_sql(X.BIDI)} AS bidi, {_count_sql(chr(91) + "\\x{202D}\\x{202E}]")} AS overrides,
  {_count_sql("[\\x{202A}\\x{202B}\\x{202D}\\x{202E}\\x{2066}-\\x{2068}]")} - {_count_sql("[\\x{202C}\\x{2069}]")} AS depth, regexp_matches(text, {quoted(X.RTL)}) AS rtl,
  {_count_sql(X.ZERO_WIDTH)} - (regexp_matches(text, {quoted("^\\x{FEFF}")})::INT
    + len(regexp_extract_all(regexp_replace(text, {quoted(f"({X.PICTURE})")}, '\\1\\1', 'g'), {quoted(X.PICTURE + "\\x{200D}" + X.PICTURE)}))
    + len(regexp_extract_all(text, {quoted(X.COMPLEX + X.ZERO_WIDTH)}))) AS bad FROM c)
SELECT id, array_to_string(list_sort(list_concat(
  CASE WHEN tags > 0 THEN ['unicode.tag-block:950'] ELSE [] END,
  CASE WHEN bidi > 0 AND (overrides > 0 AND NOT rtl OR depth <> 0) THEN ['unicode.bidi-override:720'] ELSE [] END,
  CASE WHEN bad >= 8 THEN ['unicode.zero-width-density:680'] WHEN bad >= 4 THEN ['unicode.zero-width-density:420'] ELSE [] END)), ',') AS findings FROM h"""


def frame_detector(spark, sf_dir):
    return content(spark, sf_dir).select("id", _ids(detect.frame_findings(F.col("text"), F.col("id").endswith("7"))).alias("findings"))


_FRAMES = " + ".join(f"regexp_matches(text, {quoted(p)})::INT" for p in detect.FRAME_MARKS.values())
FRAME_DETECTOR = ROWS + f"""
SELECT id, CASE WHEN n >= 2 THEN 'frame.role-injection:600' WHEN n = 1 AND NOT ends_with(id, '7') THEN 'frame.role-injection:380' ELSE '' END AS findings
FROM (SELECT id, {_FRAMES} AS n FROM c)"""


def anomaly_detector(spark, sf_dir):
    return content(spark, sf_dir).select("id", _ids(detect.anomaly_findings(F.col("text"))).alias("findings"))


_COMMAND, _ASIDE = (p.replace(detect.L, r"(?:^|[^A-Za-z0-9_])").replace(detect.R, r"(?:$|[^A-Za-z0-9_])") for p in (detect.COMMAND, detect.ASIDE))
ANOMALY_DETECTOR = ROWS + rf"""
, d AS (SELECT id, text, regexp_extract_all(text, {quoted(X.COMMENT)}) AS comments, floor(length(text) * 4 / 5)::INT AS cut,
               CASE WHEN regexp_matches(text, {quoted(detect.HIDDEN_CSS)}) THEN substr(text, length(string_split_regex(text, {quoted(detect.HIDDEN_CSS)})[1]) + 1, 300) ELSE '' END AS after FROM c)
SELECT id, array_to_string(list_sort(list_concat(
  CASE WHEN regexp_matches(after, {quoted(_COMMAND)}) THEN ['anomaly.css-hidden:480'] ELSE [] END,
  list_transform(list_filter(comments, lambda x: regexp_matches(x, {quoted(_COMMAND)})), lambda x: 'anomaly.comment-directive:300'),
  CASE WHEN length(text) > 120 AND (regexp_matches(substr(text, 1, cut), '^[ \t\n\f\r\v]*[\[{{]') OR len(list_filter(string_split(substr(text, 1, cut), chr(10)), lambda l: NOT contains(l, ',') AND trim(l) <> '')) = 0)
        AND regexp_matches(substr(text, cut + 1), {quoted(_COMMAND)}) AND regexp_matches(substr(text, cut + 1), {quoted(_ASIDE)}) THEN ['anomaly.data-appendix:360'] ELSE [] END)), ',') AS findings FROM d"""


def literal_rules(spark, sf_dir):
    return content(spark, sf_dir).select("id", _ids(detect.literal_findings(F.col("text"), F.col("kind"))).alias("findings"))


LITERAL_RULES = ROWS + r"""
, f AS (SELECT id, kind, lower(translate(text, 'İIÇĞÖŞÜ', 'iıçğöşü')) AS t FROM c)
SELECT id, array_to_string(list_sort(CASE WHEN kind NOT IN ('tool_result', 'resource') THEN [] ELSE list_concat(
  CASE WHEN contains(t, '.env') THEN ['inj.en.secret.dotenv:300'] ELSE [] END,
  CASE WHEN len(list_filter(string_split(t, 'you are now '), lambda x: NOT regexp_matches(x, '^(logged|ready|able|connected|online|signed|set)(?:$|[^A-Za-z0-9_])'))) - CASE WHEN regexp_matches(t, '^(logged|ready|able|connected|online|signed|set)(?:$|[^A-Za-z0-9_])') THEN 0 ELSE 1 END > 0 THEN ['inj.en.role.you-are-now:540'] ELSE [] END,
  CASE WHEN regexp_matches(t, '(?:^|[^\p{L}\p{N}])drop table(?:$|[^\p{L}\p{N}])') THEN ['inj.en.data-poison.drop-table:640'] ELSE [] END,
  CASE WHEN regexp_matches(t, '(?:^|[^\p{L}\p{N}])developer mode(?:$|[^\p{L}\p{N}])') THEN ['inj.en.jailbreak.developer-mode:460'] ELSE [] END) END), ',') AS findings FROM f"""

#: A finding table made of numbers, alike in both engines: (rule number, family, severity) by event.
_FAMILIES = ["signature", "imperative", "unicode", "encoding", "exfil", "frame", "anomaly"]


def _findings(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    family = F.element_at(F.array(*map(F.lit, _FAMILIES)), (F.pmod(F.col("event_id") * 7 + F.col("user_id"), F.lit(7)) + 1).cast("int"))
    item = F.floor(F.col("event_id") / 4)
    return e.select(
        item.cast("long").alias("item"), family.alias("family"), F.concat_ws(".", family, F.pmod("event_id", F.lit(3)).cast("string")).alias("rule_id"),
        F.when(F.pmod("event_id", F.lit(11)) == 0, "critical").otherwise("high").alias("severity"), (F.pmod(F.col("event_id") * 37, F.lit(600)) + 100).cast("int").alias("weight"), (F.pmod(item, F.lit(5)) == 0).alias("doc_like"),
    ).where("weight % 3 <> 0")


_FINDINGS_SQL = f"""
f AS (SELECT event_id // 4 AS item, (['{"', '".join(_FAMILIES)}'])[(event_id * 7 + user_id) % 7 + 1] AS family, event_id % 3 AS r,
             event_id % 11 = 0 AS critical, event_id * 37 % 600 + 100 AS weight, (event_id // 4) % 5 = 0 AS doc_like FROM events WHERE (event_id * 37 % 600 + 100) % 3 <> 0),
g AS (SELECT item, family, family || '.' || r AS rule_id, max(weight) AS weight, max(doc_like) AS doc_like,
             bool_or(critical AND family || '.' || r IN ('unicode.0', 'exfil.1')) AS decisive FROM f GROUP BY ALL),
h AS (SELECT item, family, list(weight ORDER BY rule_id) AS w, bool_or(doc_like) AS doc_like, bool_or(decisive) AS decisive FROM (SELECT item, family, rule_id, max(weight) AS weight, bool_or(doc_like) AS doc_like, bool_or(decisive) AS decisive FROM g GROUP BY ALL) GROUP BY item, family),
k AS (SELECT item, family, decisive, least(CASE family {" ".join(f"WHEN '{a}' THEN {b}" for a, b in data.FAMILY_CAPS.items())} END,
        CASE WHEN doc_like AND family IN ('signature', 'imperative') THEN list_max(w) * 450 // 1000
             ELSE 1000 - list_reduce(list_prepend(1000::BIGINT, w), lambda r, x: r * (1000 - x) // 1000) END) AS weight FROM h),
n AS (SELECT item, list(weight ORDER BY family) AS w, list(family ORDER BY family) AS fam, bool_or(decisive) AS decisive FROM k GROUP BY item),
scored AS (SELECT item, len(fam) AS families, len(fam) >= 2 OR decisive AS corroborated,
             ((1000 - list_reduce(list_prepend(1000::BIGINT, CASE WHEN fam = ['imperative'] THEN [w[1] * 500 // 1000] ELSE w END), lambda r, x: r * (1000 - x) // 1000)) + 5) // 10 AS score FROM n)"""


def score_combine(spark, sf_dir):
    return score.combine(_findings(spark, sf_dir), ["item"], ["unicode.0", "exfil.1"])


SCORE_COMBINE = f"WITH {_FINDINGS_SQL} SELECT item, score, families, corroborated FROM scored"


def decide_actions(spark, sf_dir):
    scored = score_combine(spark, sf_dir).withColumn("degraded", F.pmod("item", F.lit(9)) == 0)
    args = (F.col("score"), F.col("corroborated"), F.col("degraded"))
    return scored.select("item", *[score.decide(*args, 40, 70, a, d).alias(f"{a}_{d}") for a in ("flag", "strip", "block") for d in ("allow", "flag", "block")])


def _decide_sql(action: str, degraded: str) -> str:
    high = f"'{action}'" if action != "block" else "CASE WHEN corroborated THEN 'block' ELSE 'flag' END"
    low = action if action != "block" else "flag"
    first = {"allow": "", "flag": f"WHEN item % 9 = 0 THEN CASE WHEN score >= 40 THEN {high} ELSE 'flag' END", "block": "WHEN item % 9 = 0 THEN 'block'"}[degraded]
    return f"CASE {first} WHEN score >= 70 THEN {high} WHEN score >= 40 THEN '{low}' ELSE 'allow' END AS {action}_{degraded}"


DECIDE_ACTIONS = f"WITH {_FINDINGS_SQL} SELECT item, {', '.join(_decide_sql(a, d) for a in ('flag', 'strip', 'block') for d in ('allow', 'flag', 'block'))} FROM scored"


def worst_action(spark, sf_dir):
    scored = score_combine(spark, sf_dir).withColumn("action", score.decide(F.col("score"), F.col("corroborated"), F.lit(False)))
    return score.worst_action(scored.withColumn("call", F.floor(F.col("item") / 3).cast("long")), ["call"])


WORST_ACTION = f"""WITH {_FINDINGS_SQL},
a AS (SELECT item // 3 AS call, CASE WHEN score >= 70 AND corroborated THEN 4 WHEN score >= 40 THEN 2 ELSE 1 END AS r FROM scored)
SELECT call, (['allow', 'flag', 'strip', 'block'])[max(r)] AS action, count(*) AS items FROM a GROUP BY call"""


def verdict_summary(spark, sf_dir):
    """Texts by kind and action, from the native detectors."""
    c = content(spark, sf_dir).withColumn("doc_like", X.shape(F.col("text"))["doc_like"])
    found = c.select("kind", "doc_like", detect.native_findings(F.col("text"), F.col("kind"), F.col("doc_like")).alias("findings"))
    # a generator's fields are made once; those of a struct would be made anew for each use
    scored = found.select("kind", F.inline(F.array(score.combine_array(F.col("findings"), F.col("doc_like")))))
    verdicts = scored.select("kind", score.decide(F.col("score"), F.col("corroborated"), F.lit(False)).alias("action"))
    return verdicts.groupBy("kind", "action").agg(F.count(F.lit(1)).alias("items"))


_CAPS = "CASE family " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in data.FAMILY_CAPS.items()) + " ELSE 1000 END"
_DAMPED = ", ".join(map(quoted, data.DAMPED_FAMILIES))
VERDICT_SUMMARY = f"""
WITH d AS (SELECT id, doc_like FROM ({TEXT_SHAPE})), k AS ({ROWS} SELECT id, kind FROM c),
fr AS ({ROWS} SELECT c.id, {_FRAMES} AS n, doc_like FROM c JOIN d USING (id)),
every AS (SELECT id, findings FROM ({UNICODE_DETECTOR}) UNION ALL SELECT id, findings FROM ({EXFIL_DETECTOR}) UNION ALL SELECT id, findings FROM ({ANOMALY_DETECTOR})
  UNION ALL SELECT id, findings FROM ({LITERAL_RULES})
  UNION ALL SELECT id, CASE WHEN n >= 2 THEN 'frame.role-injection:600' WHEN n = 1 AND NOT doc_like THEN 'frame.role-injection:380' ELSE '' END FROM fr),
f AS (SELECT id, unnest(string_split(findings, ',')) AS r FROM every WHERE findings <> ''),
rules AS (SELECT id, string_split(r, ':')[1] AS rule, max(string_split(r, ':')[2]::INT) AS weight FROM f GROUP BY ALL),
families AS (SELECT id, CASE WHEN rule LIKE 'inj.%' THEN 'signature' ELSE string_split(rule, '.')[1] END AS family, list(weight ORDER BY rule) AS w FROM rules GROUP BY ALL),
weighed AS (SELECT id, family, least({_CAPS}, CASE WHEN doc_like AND family IN ({_DAMPED}) THEN list_max(w) * {data.DOC_DAMPING} // 1000
  ELSE 1000 - list_reduce(list_prepend(1000, w), lambda r, x: r * (1000 - x) // 1000) END) AS weight FROM families JOIN d USING (id)),
scored AS (SELECT id, (1005 - list_reduce(list_prepend(1000, list(weight ORDER BY family)), lambda r, x: r * (1000 - x) // 1000)) // 10 AS score, count(*) >= 2 AS corroborated FROM weighed GROUP BY id),
v AS (SELECT kind, CASE WHEN score >= 70 AND corroborated THEN 'block' WHEN score >= 40 THEN 'flag' ELSE 'allow' END AS action FROM k LEFT JOIN scored USING (id))
SELECT kind, action, count(*) AS items FROM v GROUP BY ALL"""


def kernel_findings(spark, sf_dir):
    """Findings of the sequential matchers by family and rule."""
    found = kernel.scan(content(spark, sf_dir)).select("id", F.explode("findings").alias("f"))
    return found.groupBy(F.col("f.family").alias("family"), F.col("f.rule_id").alias("rule_id")).agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("id").alias("texts"))


def kernel_identifiers(spark, sf_dir):
    """Keyword-bound identifiers of each text."""
    return kernel.scan(content(spark, sf_dir)).select("id", F.size("identifiers").cast("long").alias("n"), F.concat_ws(",", F.transform("identifiers", lambda i: F.concat_ws(":", i["kind"], i["start"].cast("string"), i["end"].cast("string")))).alias("spans"))


def kernel_verdicts(spark, sf_dir):
    """Verdicts from all detectors together."""
    return kernel.verdicts(content(spark, sf_dir), action="block").select("id", "score", "families", "corroborated", "action", "degraded")


def queries() -> dict:
    out = {f.__name__: f for f in (text_shape, fold_skeleton, hidden_characters, fnv_split, mask_email, pii_card, gs1_check, unicode_detector, exfil_detector, frame_detector, anomaly_detector, literal_rules, score_combine, decide_actions, worst_action, verdict_summary, kernel_findings, kernel_identifiers, kernel_verdicts)}
    return out | {f"pii_{k}": _identifier(k) for k in ("tckn", "vkn", "iban", "email", "ssn_us", "mbi_us", "atc", "phone")}


def oracle_sql() -> dict[str, str]:
    own = {k: v for k, v in globals().items() if k.isupper() and isinstance(v, str) and k.lower() in queries()}
    return {k.lower(): v for k, v in own.items()} | {f"pii_{k}": _identifier_sql(k) for k in _SQL_CANDIDATES}

"""The registered queries of this subpackage: thin digests of its operators, each over a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgate.llm import decontam, dedup, langid, lmscore, packing, pii, secretscan, setjoin, toxicity, urlfilter
from weirgate.llm import spans as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int) -> Column:
    """crc32 of doc_id as text, modulo ``n``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, remainder(3) != 1)
    found = langid.identify(docs, model)
    return found.select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lmscore.score_documents(table(spark, sf_dir, "documents"), remainder(7) != 2)
    return scored.select("doc_id", (remainder(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder(4) != 2)
    return toxicity.score(docs, model).select("doc_id", (remainder(4) == 2).alias("held_out"), "score", "predicted")


def _has_verdict(verdict: str):
    return lambda s: s["verdict"] == verdict


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source stands for an owner, a document for a repository."""
    found = secretscan.scan_secrets(table(spark, sf_dir, "documents"), F.col("source"), F.col("doc_id"))
    counts = [F.size(S.of_kind(F.col("base"), k)).cast("long").alias(f"n_{k}") for k in secretscan.BASE]
    by_verdict = [F.size(F.filter("spans", _has_verdict(v))).cast("long").alias(f"n_{v}") for v in ("live", "example")]
    return found.select("doc_id", *counts, F.sha2(S.show(F.col("base")), 256).alias("base_sha256"), S.show(F.col("spans")).alias("spans"), *by_verdict)


#: Fixed by the query's contract: (verdict, host, path).
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Labels of hosts whose pages make up the list that the query blocks.
SPAM_LABELS = ["casino-win", "ads-track", "free-bets", "spam-farm", "cheap-pills", "adult-x"]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    listed = pages.where(urlfilter.host_of(F.col("url")).rlike(rf"(?:^|\.)(?:{'|'.join(SPAM_LABELS)})\.")).select("url")
    return urlfilter.judge_urls(pages, URL_RULES, listed).select("page_id", "host", "path", "rule", "verdict")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.jaccard_components(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.sanitise(table(spark, sf_dir, "documents"))
    counts = [F.size(S.of_kind(F.col("base"), k)).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(S.show(F.col("base")), 256).alias("base_sha256"), S.show(F.col("spans")).alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_language_id, op2_lm_score, op3_toxicity, op4_secret_scan, op5_url_filter, op6_ngram_jaccard, op7_packing, op8_exact_dedup, op9_decontamination, op10_pii)
    return {f.__name__: f for f in every}


_DEDUP_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS place,
         first(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r
"""



def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _span_sql(kind: str, pattern: str, group: int = 0, where: str = "true", source: str = "t") -> str:
    """Rows (uid, kind, s, e, v) of the matches that meet ``where`` (on ``v``)."""
    p = _quoted(pattern)
    return f"""
  SELECT uid, '{kind}' AS kind, g[i] + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s,
         g[i] + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) + length(m[i]) AS e, v[i] AS v
  FROM (SELECT uid, m, v, list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x)))) AS g,
               unnest(range(1, len(m) + 1)) AS i
        FROM (SELECT uid, regexp_extract_all(text, {p}) AS m, regexp_extract_all(text, {p}, {group}) AS v, string_split_regex(text, {p}) AS p
              FROM {source} WHERE regexp_matches(text, {p})))
  WHERE {where.replace('v', 'v[i]') if where != 'true' else where}"""


def _secret_sql() -> str:
    plain = secretscan.ASSIGN.replace("*+", "*").replace("]++", "]+")
    base = [
        _span_sql("assign", plain, 1, "length(v) >= 8"),
        _span_sql("access", "AKIA[A-Z0-9]+", 0, "length(v) >= 16"),
        _span_sql("hex", "[0-9a-f]{32,}"),
    ]
    more = [
        _span_sql("vendor", secretscan.VENDOR.replace("}+", "}"), 0, f"regexp_matches(v, {_quoted(secretscan.VENDOR_PREFIX)})".replace("v,", "v,")),
        _span_sql("random", secretscan.RANDOM.replace("}+", "}"), 0, "regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9][^0-9]*[0-9][^0-9]*[0-9]')"),
    ]
    rank = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(secretscan.KINDS)) + " END"
    return f"""
WITH t AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS text FROM documents),
base AS ({" UNION ALL ".join(base)}),
more AS (SELECT * FROM ({" UNION ALL ".join(more)}) AS m
         WHERE NOT EXISTS (SELECT 1 FROM base AS b WHERE b.uid = m.uid AND b.s < m.e AND m.s < b.e)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM more),
own AS (SELECT v, count(DISTINCT owner) AS owners FROM every JOIN t USING (uid) GROUP BY v),
kept AS (SELECT every.*, CASE WHEN owners <= 1 THEN 'live' WHEN owners >= {secretscan.EXAMPLE_OWNERS} THEN 'example' ELSE 'shared' END AS verdict
         FROM every JOIN own USING (v) WHERE kind IN ('assign', 'access', 'hex') OR owners <= 1),
b AS (SELECT uid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, {rank}) AS shown FROM base GROUP BY uid),
k AS (SELECT uid, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, {rank}, e) AS spans, count(*) FILTER (verdict = 'live') AS n_live,
             count(*) FILTER (verdict = 'example') AS n_example FROM kept GROUP BY uid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(shown, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM t LEFT JOIN b USING (uid) LEFT JOIN k USING (uid)"""


def _url_sql() -> str:
    host = "translate(regexp_extract(tail, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ranked = sorted(URL_RULES, key=lambda r: -len(urlfilter.rule_name(r)))
    fits = {r: f"((host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}'))" for r in ranked}
    case = lambda value: "CASE " + " ".join(f"WHEN {fits[r]} THEN '{value(r)}'" for r in ranked) + " END"
    spam = _quoted(rf"(?:^|\.)(?:{'|'.join(SPAM_LABELS)})\.")
    tracking = ", ".join(_quoted(x) for x in urlfilter.TRACKING)
    return rf"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS tail FROM pages),
b AS (SELECT page_id, coalesce({host}, '') AS host, coalesce(regexp_extract(tail, '^[^/?#]*([^?#]*)', 1), '') AS path,
             list_sort(list_filter(string_split(regexp_extract(coalesce(tail, ''), '^[^?#]*\?([^#]*)', 1), '&'), lambda q: q <> '' AND string_split(q, '=')[1] NOT IN ({tracking}))) AS query FROM a),
c AS (SELECT *, regexp_replace(regexp_replace(host, '^(?:www\.|m\.)', ''), ':(?:80|443)$', '') AS h,
             regexp_replace(regexp_replace(path, '/index\.html?$', '/'), '(.)/$', '\1') AS p FROM b),
d AS (SELECT *, CASE WHEN h <> '' THEN h || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END END AS canonical,
             {case(urlfilter.rule_name)} AS rule, {case(lambda r: r[0])} AS said FROM c),
listed AS (SELECT DISTINCT canonical FROM d WHERE regexp_matches(host, {spam}) AND canonical IS NOT NULL)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN d.canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) AS verdict FROM d"""


def oracle_sql() -> dict[str, str]:
    return {"op4_secret_scan": _secret_sql(), "op5_url_filter": _url_sql(), "op8_exact_dedup": _DEDUP_SQL}

"""Injection detectors that are pure Catalyst expressions.

Each gives an array of findings (rule_id, family, severity, weight). Order-dependent matchers (phrases, imperatives,
encoded runs) are in ``kernel``.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from weirgate.functions import text as X
from weirgate.rules import data

FINDING = "array<struct<rule_id:string,family:string,severity:string,weight:int>>"
L, R = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
W_L, W_R = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"

#: Shapes of a self-fetching link, parameters that carry data, and phrases that call a tool.
BEACON = r"(?i)!\[[^\]]*\]\((https?://[^)]+)\)|<img[^>]+src\s*=|<iframe[^>]+src\s*=|url\((https?://[^)]+)\)"
CARRIES = r"(?i)[?&](q|d|c|data|prompt|context|text|payload)=[A-Za-z0-9+/=_-]{16,}|[?&][a-z]{1,12}=[A-Za-z0-9+/_-]{32,}"
TOOL_CALL = rf"(?i){L}(call the [A-Za-z0-9_]+ tool|use [A-Za-z0-9_]+ with the|invoke the [A-Za-z0-9_]+ tool|send (it|the (transcript|contents|conversation)) to){R}"
TOOL_CALL_TR = rf"(?i){L}([A-Za-z0-9_]+ aracını çağır|[A-Za-z0-9_]+ ile gönder|aracını kullan){R}"
#: Marks of a chat template or a role.
FRAME_MARKS = {
    "frame.chatml": r"<\|im_(start|end)\|>",
    "frame.role-tag": r"<\|(system|user|assistant)\|>",
    "frame.llama": r"\[INST\]|\[/INST\]|<<SYS>>",
    "frame.heading-system": r"(?im)^###\s*(system|sistem)\s*:",
    "frame.role-line": r"(?im)^(human|assistant|system)\s*:",
    "frame.xml-system": r"(?i)<(system|instructions)>",
    "frame.banner": r"(?i)---\s*(yeni talimatlar|new instructions|end of document)\s*---",
}
#: Lower-case pieces of which a mark has at least one.
FRAME_SIGNS = {
    "frame.chatml": ["<|im_"],
    "frame.role-tag": ["<|"],
    "frame.llama": ["[inst]", "[/inst]", "<<sys>>"],
    "frame.heading-system": ["###"],
    "frame.role-line": ["human", "assistant", "system"],
    "frame.xml-system": ["<system", "<instructions"],
    "frame.banner": ["---"],
}
#: Styles that hide text, words of a command, and words of an aside to the reader.
HIDDEN_CSS = r"""(?i)(display\s*:\s*none|visibility\s*:\s*hidden|font-size\s*:\s*0|opacity\s*:\s*0|aria-hidden\s*=\s*["']?true)"""
COMMAND = rf"(?i){L}(ignore|disregard|reveal|send|delete|yok say|göster|gönder|sil){R}"
ASIDE = rf"(?i){L}(the assistant|note for|now|şimdi){R}"


def none() -> Column:
    return F.array().cast(FINDING)


def finding(rule_id, family: str, severity, weight) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(lit(rule_id).alias("rule_id"), F.lit(family).alias("family"), lit(severity).alias("severity"), lit(weight).cast("int").alias("weight"))


def _any(text: Column, *words: str) -> Column:
    """Whether one of the words occurs: the cheap necessary condition that goes before a pattern."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def _where(gate: Column, found: Column) -> Column:
    return F.when(F.coalesce(gate, F.lit(False)), found).otherwise(none())


def _if(condition: Column, one: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.array(one)).otherwise(none())


def unicode_findings(text: Column) -> Column:
    """Hidden characters: any tag; direction controls without a right-to-left script or unbalanced; dense zero-width signs."""
    h = X.hidden(text)
    bad = h["zero_width"] - h["allowed_zero_width"]
    return _where(text.rlike(X.HIDDEN), F.concat(
        _if(h["tags"] > 0, finding("unicode.tag-block", "unicode", "critical", 950)),
        _if((h["bidi"] > 0) & (((h["overrides"] > 0) & ~h["rtl"]) | (h["depth"] != 0)), finding("unicode.bidi-override", "unicode", "high", 720)),
        _if(bad >= 4, finding("unicode.zero-width-density", "unicode", F.when(bad >= 8, "high").otherwise("medium"), F.when(bad >= 8, 680).otherwise(420))),
    ))


def exfil_findings(text: Column) -> Column:
    """Self-fetching links (heavier when a parameter carries data) and a phrase that calls a tool."""
    links = F.regexp_extract_all(text, F.lit(BEACON), F.lit(0))
    each = F.transform(links, lambda m: F.when(m.rlike(CARRIES), finding("exfil.beacon-payload", "exfil", "high", 720)).otherwise(finding("exfil.beacon", "exfil", "medium", 460)))
    low = F.lower(text)
    called = (_any(low, "call the ", " with the", "invoke the ", "send ") & text.rlike(TOOL_CALL)) | (_any(low, "arac", " ile g") & text.rlike(TOOL_CALL_TR))
    return F.concat(_where(_any(text, "://", "<"), each), _if(called, finding("exfil.tool-invocation", "exfil", "high", 640)))


def frame_findings(text: Column, doc_like: Column) -> Column:
    """Two different marks of a chat template, or one outside a document-like text."""
    low = F.lower(text)
    kinds = reduce(lambda a, b: a + b, [(_any(low, *FRAME_SIGNS[k]) & text.rlike(p)).cast("int") for k, p in FRAME_MARKS.items()])
    found = F.when(kinds >= 2, F.array(finding("frame.role-injection", "frame", "high", 600)))
    found = found.when((kinds >= 1) & ~doc_like, F.array(finding("frame.role-injection", "frame", "medium", 380))).otherwise(none())
    return _where(_any(low, *{w for signs in FRAME_SIGNS.values() for w in signs}), found)


def anomaly_findings(text: Column) -> Column:
    """A hiding style before a command; a comment with a command (one finding each); a command behind structured data."""
    low = F.lower(text)
    at = F.regexp_instr(text, F.lit(HIDDEN_CSS))
    css = _any(low, "display", "visibility", "font-size", "opacity", "aria-hidden") & (at > 0) & text.substr(at, F.lit(300)).rlike(COMMAND)
    comments = F.filter(F.regexp_extract_all(text, F.lit(X.COMMENT), F.lit(0)), lambda c: c.rlike(COMMAND))
    cut = F.floor(F.length(text) * 4 / 5).cast("int")
    head, tail = text.substr(F.lit(1), cut), text.substr(cut + 1, F.length(text))
    rows = F.forall(F.split(head, "\n"), lambda line: line.contains(",") | (F.trim(line) == ""))
    commanded = _any(low, "ignore", "disregard", "reveal", "send", "delete", "yok say", "göster", "gönder", "sil")
    appendix = commanded & (F.length(text) > 120) & tail.rlike(COMMAND) & tail.rlike(ASIDE) & (head.rlike(r"^\s*[\[{]") | rows)
    return _where(commanded, F.concat(
        _if(css, finding("anomaly.css-hidden", "anomaly", "high", 480)),
        _where(text.contains("<!--"), F.transform(comments, lambda c: finding("anomaly.comment-directive", "anomaly", "low", 300))),
        _if(appendix, finding("anomaly.data-appendix", "anomaly", "medium", 360)),
    ))


def literal_pattern(value: str) -> str:
    """A literal on word borders; one that begins with a sign needs none."""
    quoted = re.escape(value).replace(r"\ ", " ")
    return f"{W_L}{quoted}{W_R}" if value[0].isalnum() else quoted


def literal_findings(text: Column, kind: Column, rules: list[dict] | None = None) -> Column:
    """Literal and regex rules on the case-folded text; a cheap ``contains`` goes before the pattern."""
    folded = X.case_fold(text)
    parts = []
    for rule in rules or data.RULES:
        p = rule["pattern"]
        if p["kind"] == "phrase":
            continue
        word = p["value"] if p["kind"] == "literal" else p["prefilter"]
        surface = F.when(folded.contains(word), folded)
        hit = surface.rlike(literal_pattern(word) if p["kind"] == "literal" else p["source"].replace(r"\b", R)) & kind.isin(rule["contentKinds"])
        parts.append(_if(hit, finding(rule["id"], "signature", rule["severity"], rule["weight"])))
    return F.concat(*parts)


def native_findings(text: Column, kind: Column, doc_like: Column) -> Column:
    """All findings of this module for a text (null: empty)."""
    text = F.coalesce(text, F.lit(""))
    return F.concat(unicode_findings(text), exfil_findings(text), frame_findings(text, doc_like), anomaly_findings(text), literal_findings(text, kind))

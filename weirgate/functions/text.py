"""Normalising projections as Catalyst expressions: folds, document shape, hidden characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Capital letters whose lower case is Turkish, and look-alikes (diacritics, then Cyrillic, then Greek).
UPPER_TR, LOWER_TR = "İIÇĞÖŞÜ", "iıçğöşü"
ACCENTS, PLAIN = "çğıöşüâîû", "cgiosuaiu"
LOOKALIKES, LATIN = "аеорсуіхѕԁορν", "aeopcyixsdopv"

#: Ranges of invisible characters and of scripts written from right to left.
TAGS = r"[\x{E0000}-\x{E007F}]"
BIDI = r"[\x{202A}-\x{202E}\x{2066}-\x{2069}]"
ZERO_WIDTH = r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{00AD}]"
VARIATION = r"[\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]"
RTL = r"[\x{0590}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]"
COMPLEX = r"[\x{0600}-\x{06FF}\x{0900}-\x{0DFF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]"
PICTURE = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2190}-\x{21FF}]"

#: Any character that a hidden-character rule looks at.
HIDDEN = r"[\x{E0000}-\x{E007F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{00AD}]"

FENCE = r"(?s)```.*?```|~~~.*?~~~"
INLINE = r"`[^`\n]+`"
COMMENT = r"(?s)<!--.*?-->"
HEADING = r"(?m)^#{1,6}\s"


def case_fold(c: Column) -> Column:
    """Lower case with the Turkish pairs; the table goes first, since ``lower('İ')`` is two code points."""
    return F.lower(F.translate(c, UPPER_TR, LOWER_TR))


def skeleton_fold(c: Column) -> Column:
    """Case-folded text with diacritics and look-alikes as plain Latin; the length stays."""
    return F.translate(c, ACCENTS + LOOKALIKES, PLAIN + LATIN)


def keyword_fold(c: Column) -> Column:
    """The fold of keyword matching: no look-alikes, and I stays i."""
    return F.translate(F.lower(F.translate(c, "İ", "i")), ACCENTS, PLAIN)


def byte_length(c: Column) -> Column:
    return F.octet_length(c).cast("long")


def sampled(c: Column, most: int) -> Column:
    """Head and tail, a line break between them, of a text of more than ``most`` UTF-8 bytes; at most that many together."""
    half = (most - 1) // 2
    raw = F.encode(c, "UTF-8")
    head = F.regexp_replace(F.make_valid_utf8(F.substring(raw, 1, half).cast("string")), "\uFFFD+$", "")
    tail = F.regexp_replace(F.make_valid_utf8(F.substring(raw, -half, half).cast("string")), "^\uFFFD+", "")
    return F.when(F.octet_length(c) <= most, c).otherwise(F.concat(head, F.lit("\n"), tail))


def _total(c: Column, pattern: str) -> Column:
    return F.aggregate(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.lit(0), lambda n, m: n + F.length(m))


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("long")


def _if_has(gate: Column, figure: Column) -> Column:
    """``figure`` where a cheap necessary condition holds, else 0; null stays null."""
    return F.when(~gate, F.lit(0)).otherwise(figure)


def shape(c: Column) -> Column:
    """struct(headings, code_chars, comments, doc_like). Inline code counts outside fences only, as does a fence's end."""
    fenced = c.contains("```") | c.contains("~~~")
    rest = F.when(fenced, F.regexp_replace(c, FENCE, "\n")).otherwise(c)
    code = (_if_has(fenced, _total(c, FENCE)) + _if_has(c.contains("`"), _total(rest, INLINE))).cast("long")
    headings = _if_has(c.contains("#"), count(c, HEADING))
    return F.struct(headings.alias("headings"), code.alias("code_chars"), _if_has(c.contains("<!--"), count(c, COMMENT)).alias("comments"), ((headings >= 3) | (code * 4 > F.length(c))).alias("doc_like"))


def hidden(c: Column) -> Column:
    """struct(tags, bidi, overrides, depth, zero_width, allowed_zero_width, variation, rtl): what the hidden-character rules need."""
    opens = count(c, r"[\x{202A}\x{202B}\x{202D}\x{202E}\x{2066}-\x{2068}]")
    closes = count(c, r"[\x{202C}\x{2069}]")
    allowed = count(c, rf"^\x{{FEFF}}|(?<={PICTURE})\x{{200D}}(?={PICTURE})|(?<={COMPLEX}){ZERO_WIDTH}")
    return F.struct(
        count(c, TAGS).alias("tags"), count(c, BIDI).alias("bidi"), count(c, r"[\x{202D}\x{202E}]").alias("overrides"), (opens - closes).alias("depth"),
        count(c, ZERO_WIDTH).alias("zero_width"), allowed.alias("allowed_zero_width"), count(c, VARIATION).alias("variation"), c.rlike(RTL).alias("rtl"),
    )


def fnv1a32(c: Column) -> Column:
    """FNV-1a over the code points of an ASCII id, as an unsigned 32-bit number."""
    step = lambda h, ch: h.bitwiseXOR(F.ascii(ch).cast("long")) * 16777619 % 4294967296
    return F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), F.lit(2166136261).cast("long"), step)


def duration_ms(text: str) -> int:
    """``500ms``, ``30s``, ``10m``, ``2h`` or ``1d`` in milliseconds."""
    import re

    found = re.fullmatch(r"(\d+)(ms|s|m|h|d)", text.strip())
    if not found:
        raise ValueError(f"not a duration: {text!r}")
    return int(found[1]) * {"ms": 1, "s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}[found[2]]


def mime_of(path: Column) -> Column:
    """The mime type that a file name's ending stands for."""
    return F.when(path.endswith(".md"), "text/markdown").when(path.endswith(".json"), "application/json").when(path.endswith(".html"), "text/html").otherwise("text/plain")


#: Characters that aren't shown as they are, and those with a short escape in JSON.
UNSAFE = r"[\p{Cc}\p{Cf}\x{2028}\x{2029}]"
SHORT_ESCAPES = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def display_quoted(c: Column) -> Column:
    """A JSON string that is safe to print: control, format and separator characters are written as UTF-16 escapes."""
    quoted = c
    for plain, escaped in SHORT_ESCAPES.items():
        quoted = F.replace(quoted, F.lit(plain), F.lit(escaped))
    units = lambda ch: F.regexp_replace(F.lower(F.hex(F.encode(ch, "UTF-16BE"))), "(.{4})", r"\\u$1")
    kinds = F.array_distinct(F.regexp_extract_all(quoted, F.lit(UNSAFE), F.lit(0)))
    return F.concat(F.lit('"'), F.aggregate(kinds, quoted, lambda s, ch: F.replace(s, ch, units(ch))), F.lit('"'))

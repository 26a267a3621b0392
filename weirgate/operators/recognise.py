"""Recognisers of personal identifiers with exact spans, and masking; Catalyst expressions only.

Word borders are ASCII (written as lookarounds, since Java's ``\\b`` is not). A phone number's span begins at the number
even where the candidate begins with a space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weirgate.functions import checksums as C
from weirgate.functions import spans as S

BASE_KINDS = ["tckn", "vkn", "iban", "card", "phone", "email"]
NATIVE_KINDS = [*BASE_KINDS, "ssn_us", "mbi_us", "atc"]
#: What a mask is called, and how many last digits it may keep.
LABELS = {"tckn": "TCKN", "vkn": "VKN", "iban": "IBAN", "card": "CARD", "phone": "PHONE", "email": "EMAIL", "health_ref": "MRN", "health_date": "DATE", "gs1_serial": "GS1", "ssn_us": "SSN", "mbi_us": "MBI", "icd10": "ICD10", "atc": "ATC"}
KEEP_TAIL = {"iban": 4, "card": 4}

L, R = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
#: Candidates of each kind.
CANDIDATES = {
    "tckn": r"(?<![0-9])[1-9][0-9]{10}(?![0-9])",
    "vkn": r"(?<![0-9])[0-9]{10}(?![0-9])",
    "iban": rf"{L}[A-Z]{{2}}[0-9]{{2}}(?:[ ]?[A-Z0-9]{{1,4}}){{2,8}}{R}",
    "card": r"(?<![0-9.])(?:[0-9][ -]?){12,18}[0-9](?![0-9.])",
    "phone": r"(?<![0-9])(?:\+90|0090|0)?[ ]?\(?5[0-9]{2}\)?[ ]?[0-9]{3}[ ]?[0-9]{2}[ ]?[0-9]{2}(?![0-9])",
    "email": rf"(?:{L}(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))[A-Za-z0-9._%+-]{{1,64}}@[A-Za-z0-9.-]{{1,255}}\.[A-Za-z]{{2,24}}{R}",
    "ssn_us": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "mbi_us": r"(?<![A-Za-z0-9])[1-9][A-Za-z][A-Za-z0-9][0-9]-?[A-Za-z][A-Za-z0-9][0-9]-?[A-Za-z]{2}[0-9]{2}(?![A-Za-z0-9])",
    "atc": r"(?<![A-Za-z0-9])[ABCDGHJLMNPRSV][0-9]{2}[A-Z]{2}[0-9]{2}(?![A-Za-z0-9])",
}
#: Keywords that speak for a candidate next to them, and domains that stand for no one.
KEYWORDS = {"tckn": r"tc|t\.?c\.?|tckn|kimlik", "vkn": "vkn|vergi", "card": "kart|card|kredi", "phone": "tel|telefon|gsm|cep|ara|phone|mobile"}
NO_ONE = r"(?i)@(example\.(com|org|net)|.*\.(invalid|test|localhost))$"
#: A cheap necessary condition of each kind.
GATES = {"email": "@", "ssn_us": "-"}
WINDOW = 40


def _near(text: Column, at: Column, kind: str) -> Column:
    start = F.greatest(at - WINDOW, F.lit(0))
    return text.substr(start + 1, at + WINDOW - start).rlike(rf"(?i){L}(?:{KEYWORDS[kind]}){R}")


def _valid(kind: str, text: Column, strict: bool):
    def ok(s: Column) -> Column:
        value = s["value"]
        if kind in ("tckn", "vkn"):
            good = getattr(C, kind)(value)
            return good if strict else good | _near(text, s["start"], kind)
        if kind == "iban":
            return C.iban(F.regexp_replace(value, " ", ""))
        if kind == "card":
            digits = F.regexp_replace(value, "[ -]", "")
            good = C.card_scheme(digits).isNotNull() & C.luhn(digits)
            return ~digits.rlike("^97[89]") & (good if strict else good | _near(text, s["start"], kind))
        if kind == "phone":
            return value.rlike(r"^(\+90|0090)") | _near(text, s["start"], kind) if strict else F.lit(True)
        if kind == "email":
            return ~value.rlike(NO_ONE)
        if kind == "ssn_us":
            return C.ssn(F.regexp_replace(value, "-", ""))
        if kind == "mbi_us":
            return C.mbi(F.regexp_replace(value, "-", ""))
        return F.lit(True)

    return ok


def recognise(text: Column, kind: str, strict: bool = True) -> Column:
    """Spans (kind, start, end, value) of one kind in a text; null and empty texts have none."""
    text = F.coalesce(text, F.lit(""))
    found = S.find(text, CANDIDATES[kind], kind, gate=text.contains(GATES[kind]) if kind in GATES else None)
    if kind == "phone":
        lead = lambda s: F.length(s["value"]) - F.length(F.ltrim(s["value"]))
        found = F.transform(found, lambda s: F.struct(s["kind"].alias("kind"), (s["start"] + lead(s)).alias("start"), s["end"].alias("end"), F.ltrim(s["value"]).alias("value")))
    return F.filter(found, _valid(kind, text, strict))


def recognise_all(text: Column, kinds: list[str] | None = None, strict: bool = True) -> Column:
    """Spans of some kinds, by start, then by the order of the kinds."""
    kinds = kinds or BASE_KINDS
    return S.by_start(F.concat(*[recognise(text, k, strict) for k in kinds]), kinds)


def mask_of(span: Column, keep_last: int = 0) -> Column:
    """``[LABEL:***]``, with the last digits where the kind and ``keep_last`` allow it."""
    label = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])[span["kind"]]
    keep = F.coalesce(F.create_map(*[F.lit(x) for pair in KEEP_TAIL.items() for x in pair])[span["kind"]], F.lit(0))
    keep = F.least(keep, F.lit(keep_last))
    digits = F.regexp_replace(span["value"], "[^0-9]", "")
    tail = F.when((keep > 0) & (F.length(digits) >= keep), F.substr(digits, F.length(digits) - keep + 1, keep)).otherwise("")
    return F.concat(F.lit("["), label, F.lit(":***"), tail, F.lit("]"))


def mask_text(text: Column, spans: Column, keep_last: int = 0) -> Column:
    """The text with every span (sorted; an overlapping later one is dropped) masked."""
    return S.replace(F.coalesce(text, F.lit("")), spans, lambda s: mask_of(s, keep_last))

"""The rule set that is shipped. Everything here is a fixed value."""

from __future__ import annotations

TOOL_RESULT, RESOURCE, TOOL_DESCRIPTION = "tool_result", "resource", "tool_description"
_USUAL = [TOOL_RESULT, RESOURCE]


def _phrase(rule_id, tokens, gap, match, severity, weight, locale, kinds=None):
    pattern = {"kind": "phrase", "tokens": tokens, "maxGap": gap, "tokenMatch": match}
    return {"id": rule_id, "pattern": pattern, "severity": severity, "weight": weight, "locale": locale, "contentKinds": kinds or _USUAL, "standalone": False, "quotedDamping": 300}


def _literal(rule_id, value, severity, weight, damping=300):
    return {"id": rule_id, "pattern": {"kind": "literal", "value": value}, "severity": severity, "weight": weight, "locale": "en", "contentKinds": _USUAL, "standalone": False, "quotedDamping": damping}


#: The rules.
RULES = [
    _phrase("inj.en.override.ignore-previous", ["ignore", "previous", "instruction"], 3, "prefix", "high", 640, "en", [*_USUAL, TOOL_DESCRIPTION]),
    _phrase("inj.en.override.disregard-guidance", ["disregard", "guidance"], 4, "prefix", "high", 560, "en"),
    _phrase("inj.en.override.new-instructions", ["new", "instruction"], 2, "prefix", "medium", 460, "en"),
    _phrase("inj.tr.override.talimat-yok-say", ["talimat", "yok", "say"], 4, "prefix", "high", 640, "tr"),
    _phrase("inj.tr.override.talimat-yoksay", ["talimat", "yoksay"], 3, "prefix", "high", 620, "tr"),
    _phrase("inj.en.reveal-system-prompt", ["system", "prompt"], 2, "exact", "high", 520, "en"),
    _phrase("inj.en.secret.api-key", ["api", "key"], 1, "exact", "medium", 440, "en"),
    _literal("inj.en.secret.dotenv", ".env", "low", 300, 200),
    {"id": "inj.en.role.you-are-now", "pattern": {"kind": "regex", "source": r"you are now (?!(logged|ready|able|connected|online|signed|set)\b)", "prefilter": "you are now"}, "severity": "high", "weight": 540, "locale": "en", "contentKinds": _USUAL, "standalone": False, "quotedDamping": 300},
    _phrase("inj.en.role.unrestricted-assistant", ["unrestricted", "assistant"], 2, "prefix", "high", 520, "en"),
    _phrase("inj.tr.role.artik-asistan", ["artik", "asistan"], 5, "prefix", "high", 520, "tr"),
    _phrase("inj.en.persistence.remember-future", ["remember", "future", "session"], 4, "prefix", "high", 600, "en"),
    _literal("inj.en.data-poison.drop-table", "drop table", "critical", 640),
    _literal("inj.en.jailbreak.developer-mode", "developer mode", "high", 460),
]

#: Verbs that name an agent's action, and phrases that are harmless commands.
VERBS_EN = """ignore disregard forget override bypass disable reveal print output repeat send email post upload fetch curl
exfiltrate delete remove execute run invoke call write append grant pretend act roleplay assume remember store obey comply
stop continue copy export leak expose dump transmit forward share paste echo display show enable""".split()
VERBS_TR = """yoksay gonline gönder gonder sil kaldır kaldir göster goster yaz çağır cagir calistir çalıştır ilet paylaş paylas
unut aç ac kapat devral onayla uygula kopyala yükle yukle indir dışarı sızdır sizdir aktar yansıt yansit açıkla acikla
hatırla hatirla sakla boyun davran rolünü rolunu""".split()
BENIGN = [
    "run npm", "run npx", "npm install", "npm run", "see the docs", "see the documentation", "contact support", "try again",
    "please try again", "lütfen tekrar deneyin", "daha fazla bilgi için", "see below", "refer to", "note that",
    "for more information", "read the", "set the environment", "do not commit", "lütfen önce", "kontrol edin",
    "tekrar çalıştırın", "tekrar deneyiniz", "göz atın", "başvurunuzu", "not alın",
]

#: Keywords of the identifiers that need one next to them, Turkish ones first.
KEYWORDS = {
    "health_ref": [
        "hasta no", "hasta numarası", "hasta kayıt no", "protokol no", "protokol numarası", "dosya no", "dosya numarası", "kayıt no",
        "yatış no", "takip no", "takip numarası", "e-reçete no", "reçete no", "reçete numarası", "rapor no", "e-rapor no",
        "provizyon no", "poliçe no", "poliçe numarası", "medula takip no", "medula takip numarası", "epikriz no",
        "mrn", "medical record number", "medical record no", "patient id", "patient no", "patient number", "chart number", "chart no",
        "encounter id", "member id", "member number", "subscriber id", "health plan id", "insurance id", "policy number", "policy no",
        "claim number", "claim no", "claim id", "subscriber number", "policy holder id", "policyholder id", "beneficiary id",
        "medicare id", "insurance number", "prescription number", "prescription no", "claim #",
    ],
    "health_date": [
        "doğum tarihi", "doğum", "d.t.", "yatış", "yatış tarihi", "taburcu", "taburcu tarihi", "taburculuk", "ölüm tarihi",
        "vefat tarihi", "ameliyat tarihi", "dob", "date of birth", "birth date", "birthdate", "born", "admission",
        "admission date", "admitted", "discharge", "discharge date", "discharged", "date of death", "date of service",
        "service date", "surgery date",
    ],
    "ssn_us": ["ssn", "social security", "social security number"],
    "icd10": ["tanı", "tanılar", "ön tanı", "ek tanı", "teşhis", "icd", "diagnosis", "diagnoses", "primary diagnosis", "dx"],
    "gs1_serial": ["karekod", "seri", "seri no", "parti", "lot", "its", "ilaç", "udi", "gtin", "serial", "batch", "dispensed"],
    "profile_tckn": ["hasta", "sigortalı", "sgk", "yabancı kimlik", "ykn"],
    "profile_phone": ["faks", "fax"],
    "exclude_health_ref": [
        "kargo", "kurye", "gönderi", "sipariş", "faaliyet raporu", "kasko", "trafik sigortası", "konut sigortası", "dask", "araç",
        "yenileme", "courier", "shipping", "shipment", "tracking", "parcel", "freight", "vehicle", "car insurance",
        "auto insurance", "home insurance", "annual report", "renews", "renewal",
    ],
    "exclude_health_date": ["kubernetes", "k8s", "webhook", "admission controller", "batarya", "akü", "battery", "voltage", "cluster"],
    "strong_health_ref": [
        "hasta", "reçete", "protokol", "medula", "epikriz", "provizyon", "patient", "prescription", "mrn", "medical record", "claim",
        "member", "subscriber", "insurance", "policy holder", "policyholder", "beneficiary", "medicare", "health plan",
    ],
    "strong_health_date": [
        "doğum tarihi", "d.t.", "yatış tarihi", "taburcu tarihi", "ölüm tarihi", "vefat tarihi", "ameliyat tarihi", "dob",
        "date of birth", "birth date", "birthdate", "admission date", "discharge date", "date of death", "date of service",
        "service date", "surgery date",
    ],
}
#: The kinds that the health profile adds.
HEALTH_PROFILE = ["health_ref", "health_date", "gs1_serial", "ssn_us", "mbi_us"]

#: The most that a family of findings may weigh, in thousandths.
FAMILY_CAPS = {"signature": 900, "imperative": 480, "unicode": 950, "encoding": 900, "exfil": 850, "frame": 800, "anomaly": 520}
#: Families that a document-like shape damps, and damping factors in thousandths.
DAMPED_FAMILIES, DOC_DAMPING, LONE_IMPERATIVE = ["signature", "imperative"], 450, 500
ACTIONS = ["allow", "flag", "strip", "block"]

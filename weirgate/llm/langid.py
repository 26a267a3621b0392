"""Language identification of whole, possibly mixed texts.

Every word gets a score for each learned language: the log-likelihood of its hashed character trigrams. The
script of its letters narrows the candidates to languages that were written in that script in training. A Viterbi
pass over the words, with a penalty for every switch, labels spans; the document's language is the one with the
most evidence in its spans. Everything up to the Viterbi pass is done on whole arrays of code points.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirgate.llm.store import small_batches, texts
from weirgate.llm.textkernel import lean

#: Buckets for trigrams, and labelled documents to learn from (a bound; a sample by hash beyond it).
BUCKETS, MAX_TRAIN_DOCS = 1 << 16, 20_000
#: What a change of language costs along the path, in units of a word's log-likelihood.
SWITCH = 20.0
#: Characters worked on at once (a longer document is taken whole).
CHUNK = 1 << 18

#: First code points of script ranges (Unicode blocks, coarse) and their names; each goes on to the next.
SCRIPT_RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"),
    (0x0B80, "tamil"), (0x0C00, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "latin"), (0x2C00, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"),
    (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"),
    (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"),
    (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x323B0, "other"),
]
SCRIPTS = sorted({name for _, name in SCRIPT_RANGES})

_tables: dict[str, np.ndarray] = {}


def _table() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: whether it's a letter, and its script."""
    if not _tables:
        letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        script = np.zeros(0x110000, np.uint8)
        ends = [a for a, _ in SCRIPT_RANGES[1:]] + [0x110000]
        for (a, name), b in zip(SCRIPT_RANGES, ends, strict=True):
            script[a:b] = SCRIPTS.index(name)
        _tables.update(letters=letters, script=script)
    return _tables["letters"], _tables["script"]


def script_of(char: str) -> str:
    return SCRIPT_RANGES[bisect.bisect_right([a for a, _ in SCRIPT_RANGES], ord(char)) - 1][1]


@dataclass
class Spelling:
    """Words of some texts: document, code point range and script of each; the bucket of the trigram around every
    letter (with a border sign at both ends of a word), and where each word's begin."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    script: np.ndarray
    grams: np.ndarray
    begin: np.ndarray


def spell(texts: list[str], buckets: int = BUCKETS) -> Spelling:
    """Words are runs of letters; their trigrams are taken in lower case."""
    letters, scripts = _table()
    offset = np.concatenate([[0], np.cumsum(np.array([len(t) + 2 for t in texts], np.int64))])
    joined = "".join(f"\n{t}\n" for t in texts)
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters[raw]
    edge = np.diff(is_letter.view(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    low = joined.lower()
    low = low if len(low) == len(raw) else "".join(map(_lower, joined))
    codes = np.where(is_letter, np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32), np.uint32(1))
    mixed = codes * np.uint32(0x9E3779B1)
    mixed[1:] ^= codes[:-1] * np.uint32(0x85EBCA77)
    mixed[:-1] += codes[1:] * np.uint32(0xC2B2AE3D)
    at = np.flatnonzero(is_letter)
    h = mixed[at]
    h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - (buckets - 1).bit_length())
    doc = np.searchsorted(offset, start, side="right") - 1
    size = end - start
    begin = np.cumsum(size) - size
    return Spelling(doc, start - offset[doc] - 1, end - offset[doc] - 1, scripts[raw[start]], h, begin)


def _lower(char: str) -> str:
    low = char.lower()
    return low if len(low) == 1 else char


def _pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > CHUNK:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


class Model:
    """Log-likelihoods [language][bucket], and which languages each script may be."""

    def __init__(self, languages: list[str], logs: np.ndarray, allowed: np.ndarray, prior: np.ndarray):
        self.languages, self.logs, self.allowed, self.prior = languages, logs, allowed, prior

    def word_scores(self, s: Spelling) -> np.ndarray:
        """[word, language]: the trigrams' log-likelihood relative to the word's best language, bounded below."""
        if not len(s.begin):
            return np.zeros((0, len(self.languages)), np.float32)
        out = np.empty((len(s.begin), len(self.languages)), np.float32)
        for k in range(len(self.languages)):
            out[:, k] = np.add.reduceat(self.logs[k][s.grams], s.begin)
        out -= out.max(axis=1, keepdims=True)
        np.maximum(out, -2 * SWITCH, out=out)
        narrowed = ~self.allowed[s.script] & self.allowed[s.script].any(axis=1, keepdims=True)
        out[narrowed] = -4 * SWITCH
        return out


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best path through ``scores`` [word, language] with a penalty for each switch."""
    totals = scores.sum(axis=0, dtype=np.float64)
    best = int(totals.argmax())
    gain = np.cumsum(scores - scores[:, best : best + 1], axis=0, dtype=np.float64)
    low = np.minimum(np.minimum.accumulate(np.vstack([np.zeros(scores.shape[1]), gain[:-1]]), axis=0), 0)
    if (gain - low).max(initial=0) <= switch / 2:  # no run of words gains enough to pay for leaving one language
        return np.full(len(scores), best)
    own = range(scores.shape[1])
    rows = scores.tolist()
    v = rows[0]
    came: list[list[int] | None] = [None]  # None: everyone stays
    for row in rows[1:]:
        high = max(v)
        top, floor = v.index(high), high - switch
        if min(v) >= floor:
            came.append(None)
            v = [x + y for x, y in zip(v, row, strict=True)]
        else:
            came.append([k if v[k] >= floor else top for k in own])
            v = [(x if x >= floor else floor) + y for x, y in zip(v, row, strict=True)]
    path = np.empty(len(scores), np.int64)
    state = path[-1] = v.index(max(v))
    for t in range(len(scores) - 1, 0, -1):
        if came[t] is not None:
            state = came[t][state]
        path[t - 1] = state
    return path


def fit(docs: DataFrame, train: Column, max_train_docs: int = MAX_TRAIN_DOCS, buckets: int = BUCKETS) -> Model:
    """Learn from text and lang of the rows that meet ``train``; at most about ``max_train_docs``, chosen by a hash of the text."""
    rows = small_batches(docs).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.coalesce(train, F.lit(False)).alias("t")).where("t and text is not null and lang is not null").drop("t")
    n = docs.where(F.coalesce(train, F.lit(False)) & F.col("lang").isNotNull()).count()
    if n > max_train_docs:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.lit(max(1, (1 << 20) * max_train_docs // n)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}

        def give() -> Iterator[pa.RecordBatch]:
            for lang, (sums, seen, total) in held.items():
                full = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(full)), pa.array(full), pa.array(sums[full])], ["lang", "slot", "n"])
                used = np.flatnonzero(seen)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(used) + 1)), pa.array(np.append(-1 - used, -1000)), pa.array(np.append(seen[used], total))], ["lang", "slot", "n"])
            held.clear()

        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for lo, hi in _pieces(texts):
                by = {}
                for t, lang in zip(texts[lo:hi], langs[lo:hi], strict=True):
                    by.setdefault(lang, []).append(t)
                for lang, own in by.items():
                    s = spell(own, buckets)
                    if lang not in held:
                        if len(held) == 64:  # languages held at once
                            yield from give()
                        held[lang] = [np.zeros(buckets, np.int64), np.zeros(len(SCRIPTS), np.int64), np.zeros(1, np.int64)]
                    held[lang][0] += np.bincount(s.grams, minlength=buckets)
                    held[lang][1] += np.bincount(s.script, minlength=len(SCRIPTS))
                    held[lang][2] += len(own)
        yield from give()

    table = rows.mapInArrow(lean(count), "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(table["lang"].unique().tolist())
    counts = np.zeros((buckets, len(languages)))
    scripts = np.zeros((len(SCRIPTS), len(languages)))
    prior = np.zeros(len(languages))
    column = table["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy() if len(table) else np.zeros(0, np.int64)
    slot, n = table["slot"].to_numpy().astype(np.int64), table["n"].to_numpy()
    gram, script, total = slot >= 0, (slot < 0) & (slot > -1000), slot == -1000
    counts[slot[gram], column[gram]] = n[gram]
    scripts[-1 - slot[script], column[script]] = n[script]
    prior[column[total]] = n[total]
    counts += 0.1
    logs = np.ascontiguousarray(np.log(counts / counts.sum(axis=0, keepdims=True)).T.astype(np.float32))
    share = scripts / np.maximum(scripts.sum(axis=0, keepdims=True), 1)
    return Model(languages, logs, share > 1e-3, prior / max(prior.sum(), 1))


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))


def label(texts: list[str], model: Model, switch: float = SWITCH) -> Iterator[tuple[str, float, list[dict]]]:
    """(language, score, spans) of every text; spans are code point ranges from a run's first word to its last."""
    for lo, hi in _pieces(texts):
        s = spell(texts[lo:hi], model.logs.shape[1] if model.languages else BUCKETS)
        scores = model.word_scores(s) if model.languages else None
        cut = np.searchsorted(s.doc, np.arange(hi - lo + 1))
        for d in range(hi - lo):
            a, b = int(cut[d]), int(cut[d + 1])
            if a == b or scores is None:
                yield "und", 0.0, []
                continue
            own = scores[a:b]
            path = viterbi(own, switch)
            letters = s.end[a:b] - s.start[a:b]
            weight = np.bincount(path, weights=letters, minlength=len(model.languages))
            totals = own.sum(axis=0, dtype=np.float64)
            rank = np.lexsort((-model.prior, -totals, -weight))
            top = int(rank[0])
            lead = max(0.0, totals[top] - np.delete(totals, top).max()) if len(totals) > 1 else 30.0
            score = weight[top] / weight.sum() * (1 - 0.5 * np.exp(-lead / 4))
            turns = np.flatnonzero(np.append(True, path[1:] != path[:-1]))
            spans = [{"start": int(s.start[a + i]), "end": int(s.end[a + j - 1]), "lang": model.languages[path[i]]} for i, j in zip(turns.tolist(), np.append(turns[1:], b - a).tolist(), strict=True)]
            yield model.languages[top], float(score), spans


def identify(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """One row for each row of ``docs``: doc_id, lang_pred, score (0 to 1), spans (start, end, lang).

    A text that is null or has no letter is ``und`` with score 0 and no spans, as is every text when nothing was
    learned. Only the text is looked at; repeated rows get equal answers; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(label([t or "" for t in batch.column("text").to_pylist()], shared.value, switch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], _SPANS)], ["doc_id", "lang_pred", "score", "spans"])

    slim = texts(docs)
    return slim.mapInArrow(lean(run), "doc_id long, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.1) -> DataFrame:
    """The rows of ``docs`` whose language is known with a score of ``least`` or more, with all their columns.

    Null texts and texts without a letter go, as does everything when nothing was learned. Repeated rows stay or go
    together; column names may be any; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            good = [lang != "und" and score >= least for lang, score, _ in label([t or "" for t in texts], shared.value)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return small_batches(docs).mapInArrow(lean(run), docs.schema)

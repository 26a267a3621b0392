"""Toxicity scoring: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities of a fixed and of a learned lexicon, how near second-person words and lexicon words
stand, shares of capitals, punctuation, digits and obfuscated words, repeated characters, and length. The learned
lexicon, the trees and the calibration come from a bounded sample of labelled training rows; the lexicon used for a
training row's features is learned from the other folds, and the calibration sees out-of-fold scores only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirgate.llm.store import small_batches, texts
from weirgate.llm.textkernel import lean

#: Labelled rows to learn from (a bound; a sample by hash of the text beyond it), folds, and words in the learned lexicon.
MAX_TRAIN_ROWS, FOLDS, LEXICON_WORDS = 16_000, 4, 400
#: A text whose score is at least this is predicted toxic.
THRESHOLD = 0.3

#: Insults that the fixed lexicon starts with, and second-person words.
INSULTS = "idiot idiots moron morons stupid loser losers worthless clown trash pathetic dumb scum jerk fool ugly disgusting garbage imbecile hate".split()
SECOND_PERSON = "you your yours youre yourself u ur tu toi te ton ta vous votre du dich dir dein ihr euch usted tú ti su".split()
_LEET = str.maketrans("013457@$!", "oieastasi")
_WORD = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"[^\W\d_]+(?:[013457@$!*.\-]+[^\W\d_]+)+")
_CAPS = re.compile(r"[A-ZÀ-ÖØ-Þ]{3,}")
_INSULTS, _SECOND = frozenset(INSULTS), frozenset(SECOND_PERSON)
NAMES = ["fixed", "learned", "learned_sum", "learned_max", "fixed_count", "obfuscated", "near_second", "second", "capitals", "capital_words", "punctuation", "exclaim", "digits", "repeats", "inside", "length"]


def words_of(text: str) -> tuple[list[str], dict[str, str]]:
    """Tokens between blanks in lower case, and the word in each distinct one: its longest run of letters, the first of equals."""
    tokens = text.lower().split()
    return tokens, {t: t if t.isalpha() else max(_WORD.findall(t), key=len, default="") for t in set(tokens)}


def _unmask(token: str) -> str:
    """What an obfuscated word stands for: look-alikes turned to letters, other signs dropped."""
    return "".join(filter(str.isalpha, token.lower().translate(_LEET)))


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    """Values of ``NAMES``; a text without words gives zeros for rates of words. ``lexicon``: word -> weight (log-odds), learned."""
    tokens, word_of = words_of(text)
    n, size = max(len(tokens), 1), max(len(text), 1)
    kinds = set(word_of.values())
    bad, strong, seconds = kinds & _INSULTS, kinds & lexicon.keys(), kinds & _SECOND
    fixed = learned = 0
    total = top = 0.0
    second = near = 0
    words: list[str] = [word_of[t] for t in tokens] if bad or strong or seconds else []
    if bad or strong:
        mine = [i for i, w in enumerate(words) if w in bad or w in strong]
        fixed = sum(words[i] in bad for i in mine)
        weights = [lexicon[words[i]] for i in mine if words[i] in strong]
        learned, total, top = len(weights), sum(weights), max(weights, default=0.0)
        if seconds:
            s = np.array([i for i, w in enumerate(words) if w in seconds])
            slot = np.searchsorted(s, mine)
            gap = np.minimum(np.abs(s[np.minimum(slot, len(s) - 1)] - mine), np.abs(s[np.maximum(slot - 1, 0)] - mine))
            near = int((gap <= 5).sum())
    if seconds:
        second = sum(words.count(w) for w in seconds)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    kind = _KIND[raw]
    count = np.bincount(kind, minlength=5)
    obfuscated = 0
    if _between_letters(_SIGN[raw], kind):
        obfuscated = sum((m := _unmask(t)) in _INSULTS or lexicon.get(m, 0.0) > 1.5 for t in _MASKED.findall(text))
    same = (raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]) & (raw[2:] != 32)
    repeats = int((same[1:] & ~same[:-1]).sum()) + int(same[:1].sum())
    caps = len(_CAPS.findall(text)) if count[1] > 2 else 0
    letters = int(count[0] + count[1])
    return [fixed / n, learned / n, total / n, top, float(fixed), obfuscated / n, near / n, second / n, float(count[1]) / max(letters, 1), caps / n, float(count[3]) / size, text.count("!") / n, float(count[2]) / size, repeats / n, float(learned), float(np.log1p(len(tokens)))]


def _kinds() -> np.ndarray:
    """Of each byte: 0 letter or part of a character beyond ASCII, 1 capital, 2 digit, 3 sign, 4 blank or control."""
    out = np.zeros(256, np.uint8)
    out[:128] = 4
    out[33:127] = 3
    out[48:58], out[65:91], out[97:123] = 2, 1, 0
    return out


_KIND = _kinds()
#: Bytes that stand between letters in ``_MASKED``.
_SIGN = np.isin(np.arange(256), list(b"013457@$!*.-"))


def _between_letters(sign: np.ndarray, kind: np.ndarray) -> bool:
    """Whether a run of such signs, of any length, stands between letters: what ``_MASKED`` needs."""
    begin, end = np.flatnonzero(~sign[:-1] & sign[1:]), np.flatnonzero(sign[:-1] & ~sign[1:])
    end = end[1:] if len(sign) and sign[0] else end  # a run at the start has no letter before it
    begin = begin[: len(end)]  # nor has one at the end a letter behind it
    return bool(((kind[begin] <= 1) & (kind[end + 1] <= 1)).any())


class Trees:
    """Gradient-boosted regression trees on binned features, logistic loss, Newton leaves."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.1, bins: int = 64, ridge: float = 2.0, least: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = rounds, depth, rate, bins, ridge, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        b = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], 1)
        mean = min(max(y.mean(), 1e-4), 1 - 1e-4) if len(y) else 0.5
        self.start = float(np.log(mean / (1 - mean)))
        raw = np.full(len(y), self.start)
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(self.rounds if 0 < y.sum() < len(y) else 0):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(b, p - y, p * (1 - p))
            self.trees.append(tree)
            raw += self._walk(tree, b)
        return self

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray):
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
        node = np.zeros(len(b), np.int64)
        for k in range(size):
            own = np.flatnonzero(node == k)
            if not len(own):
                continue
            gs, hs = g[own].sum(), h[own].sum()
            value[k] = -self.rate * gs / (hs + self.ridge)
            if k >= 2**self.depth - 1:
                continue
            best = (1e-6, -1, 0)
            for f in range(b.shape[1]):
                width = len(self.edges[f]) + 1
                if width < 2:
                    continue
                left_g = np.cumsum(np.bincount(b[own, f], g[own], width))[:-1]
                left_h = np.cumsum(np.bincount(b[own, f], h[own], width))[:-1]
                gain = left_g**2 / (left_h + self.ridge) + (gs - left_g) ** 2 / (hs - left_h + self.ridge) - gs**2 / (hs + self.ridge)
                gain[(left_h < self.least) | (hs - left_h < self.least)] = 0
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (float(gain[at]), f, at)
            if best[1] >= 0:
                feature[k], cut[k] = best[1], best[2]
                node[own] = 2 * k + 1 + (b[own, best[1]] > best[2])
        return feature, cut, value

    @staticmethod
    def _walk(tree, b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(b), np.int64)
        rows = np.arange(len(b))
        while True:
            f = feature[node]
            deeper = f >= 0
            if not deeper.any():
                return value[node]
            node = np.where(deeper, 2 * node + 1 + (b[rows, np.maximum(f, 0)] > cut[node]), node)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], 1) if len(x) else np.zeros((0, 1), np.int64)
        out = np.full(len(x), self.start)
        for t in self.trees:
            out += self._walk(t, b)
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: sorted x knots and non-decreasing means."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, first x, last x
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([b, 1.0, a, a])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, _, last = blocks.pop()
            p = blocks[-1]
            p[0], p[1], p[3] = (p[0] * p[1] + m * w) / (p[1] + w), p[1] + w, last
    knots = [v for b in blocks for v in (b[2], b[3])]
    means = [b[0] for b in blocks for _ in (0, 1)]
    return np.array(knots), np.array(means)


class Model:
    def __init__(self, lexicon: dict[str, float], trees: Trees, knots: np.ndarray, means: np.ndarray):
        self.lexicon, self.trees, self.knots, self.means = lexicon, trees, knots, means

    def scores(self, texts: list[str]) -> np.ndarray:
        """Calibrated probabilities; a little of the raw score keeps their order within a level."""
        x = np.array([features(t, self.lexicon) for t in texts], np.float64).reshape(-1, len(NAMES))
        raw = self.trees.raw(x)
        level = np.interp(raw, self.knots, self.means) if len(self.knots) else np.full(len(x), 0.0)
        return np.clip(0.98 * level + 0.02 / (1 + np.exp(-raw)), 0, 1)


def _lexicon(table, fold: int | None, words: int) -> dict[str, float]:
    """The ``words`` words with the highest smoothed log-odds of toxic against other documents, outside ``fold``."""
    rows = table if fold is None else table[table["fold"] != fold]
    if not len(rows):
        return {}
    all_docs = rows[rows["word"] == ""][["bad", "n"]].sum()
    bad_docs, docs = float(all_docs["bad"]), float(all_docs["n"])
    by = rows[rows["word"] != ""].groupby("word")[["bad", "n"]].sum()
    by = by[by["bad"] >= 3]
    odds = np.log((by["bad"] + 0.25) / (bad_docs + 1)) - np.log((by["n"] - by["bad"] + 0.25) / (docs - bad_docs + 1))
    strength = odds * np.sqrt(by["bad"])
    best = strength[odds > 1.5].sort_values(ascending=False, kind="stable").index[:words]
    return {w: float(odds[w]) for w in best}


def fit(docs: DataFrame, labels: DataFrame, train: Column, max_rows: int = MAX_TRAIN_ROWS, folds: int = FOLDS, words: int = LEXICON_WORDS) -> Model:
    """Learn from documents that meet ``train`` and have a non-null ``toxic`` label (the largest, where there are several)."""
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = marks.count()
    rows = small_batches(docs).where(train).select(F.col("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    if n > max_rows:  # the same hash decides on the labels' side, so that few texts are moved
        share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(max(1, (1 << 20) * max_rows // n))
        rows, marks = rows.where(share), marks.where(share)
    sample = rows.join(marks, "doc_id").select("text", "toxic", F.pmod(F.xxhash64("text"), F.lit(folds)).cast("int").alias("fold"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[str, int], list[int]] = {}
            for t, y, f in zip(*(batch.column(k).to_pylist() for k in ("text", "toxic", "fold")), strict=True):
                for w in {*words_of(t)[1].values(), ""}:
                    c = seen.setdefault((w, f), [0, 0])
                    c[0] += y
                    c[1] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.int32()), pa.array([c[0] for c in seen.values()], pa.int64()), pa.array([c[1] for c in seen.values()], pa.int64())], ["word", "fold", "bad", "n"])

    sums = sample.mapInArrow(count, "word string, fold int, bad long, n long").groupBy("word", "fold").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    # a word that no toxic document has can't enter; of the rest each must be in two such documents: bounded by the sample's toxic rows
    some = sums.groupBy("word").agg(F.sum("bad").alias("b")).where("b >= 2 and word <> ''").select("word")
    table = sums.join(some, "word", "left_semi").unionByName(sums.where("word = ''")).toPandas()
    lexicons = [_lexicon(table, f, words) for f in range(folds)]
    full = _lexicon(table, None, words)
    shared = docs.sparkSession.sparkContext.broadcast((lexicons, full))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, y, f = (batch.column(k).to_pylist() for k in ("text", "toxic", "fold"))
            x = [features(a, shared.value[0][k]) for a, k in zip(t, f, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.int32()), pa.array(f, pa.int32())], ["x", "y", "fold"])

    got = sample.mapInArrow(lean(describe), "x array<double>, y int, fold int").toPandas()
    x = np.array(got["x"].tolist(), np.float64).reshape(-1, len(NAMES))
    y, fold = got["y"].to_numpy().astype(float), got["fold"].to_numpy()
    order = np.lexsort((*x.T, y, fold))  # the rows' order from Spark isn't fixed
    x, y, fold = x[order], y[order], fold[order]
    out = np.zeros(len(y))
    for k in range(folds):
        own = fold == k
        if own.any():
            out[own] = Trees().fit(x[~own], y[~own]).raw(x[own])
    knots, means = isotonic(out, y) if len(y) else (np.zeros(0), np.zeros(0))
    return Model(full, Trees().fit(x, y), knots, means)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: doc_id, score (0 to 1), predicted (1 from ``threshold`` on).

    Only the text is looked at; a null text is scored as an empty one; with nothing learned every score is low.
    Repeated rows get equal answers; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.scores([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return texts(docs).mapInArrow(lean(run), "doc_id long, score double, predicted int")

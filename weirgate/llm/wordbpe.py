"""A vectorised front end for the lower-casing word BPE vocabulary (``word_bpe_49k.json``).

Gives the ids that the tokenizers library gives. Texts whose characters and their lower-case forms are all single
and below U+0300 go through numpy: NFC leaves them as they are, words are cut by character class, and each distinct word
is merged once and kept in a hash table. All other texts go to the library as a whole, as do those that hold the
string of one of the file's added tokens (which the library turns to that token's id).
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from weirgate.llm.textkernel import U64, mix

FILE = "word_bpe_49k.json"
_LIMIT = 0x300
#: Longest word that is merged here; longer ones go to the library.
_LONG = 24
#: Words kept in a worker's table; it is emptied beyond that.
_MOST_WORDS = 3 << 20
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)


def _classes() -> np.ndarray:
    out = np.full(_LIMIT, _OTHER, np.uint8)
    for c in range(_LIMIT):
        kind = unicodedata.category(chr(c))[0]
        if c in (9, 10, 11, 12, 13, 32, 0x85, 0xA0):
            out[c] = _SPACE
        elif kind == "L":
            out[c] = _LETTER
        elif kind == "N":
            out[c] = _DIGIT
    return out


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {}, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return [out[b] for b in range(256)]


class WordBpe:
    def __init__(self, path: str | None = None):
        path = path or public_tokenizers.path(FILE)
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, self.added = file["model"], [t["content"] for t in file["added_tokens"]]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        symbols = _byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + end] for s in symbols], np.int64)
        self.size = max(vocab.values()) + 1
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pair = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        mask = 1
        while mask < 4 * len(pair):
            mask *= 2
        self.mask = mask - 1
        self.pair_key, self.pair_rank = np.full(mask, -1, np.int64), np.full(mask, 1 << 40, np.int64)
        for rank, key in enumerate(pair.tolist()):
            slot = (key * 0x9E3779B97F4A7C15 >> 20) & self.mask
            while self.pair_key[slot] >= 0:
                slot = (slot + 1) & self.mask
            self.pair_key[slot], self.pair_rank[slot] = key, rank
        self.made = made
        self.lower = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(_LIMIT)], np.uint32)
        self.plain = np.array([len(chr(c).lower()) == 1 for c in range(_LIMIT)]) & (self.lower < _LIMIT)
        self.kind = _classes()
        self.codes = np.random.default_rng(7).integers(1, 2**63, 1024, dtype=np.uint64) * U64(2) + U64(1)
        self._clear()

    def _clear(self) -> None:
        self.slots = 1 << 16
        self.keys, self.where = np.zeros(self.slots, np.uint64), np.full(self.slots, -1, np.int64)
        self.known = 0
        self.pool, self.used = np.zeros(1 << 18, np.uint32), 0
        self.begin, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)

    def _rank(self, key: np.ndarray) -> np.ndarray:
        """Merge rank of each pair key, 2**40 where there is none."""
        slot = ((key.astype(np.uint64) * U64(0x9E3779B97F4A7C15)) >> U64(20)).astype(np.int64) & self.mask
        out = np.full(len(key), 1 << 40, np.int64)
        at = np.arange(len(key))
        while len(at):
            there = self.pair_key[slot]
            hit = there == key[at]
            out[at[hit]] = self.pair_rank[slot[hit]]
            more = ~hit & (there >= 0)
            at, slot = at[more], (slot[more] + 1) & self.mask
        return out

    def merge(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each of some short words (UTF-8, lower case)."""
        n = len(texts)
        size = np.array([len(t) for t in texts], np.int64)
        width = int(size.max())
        raw = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(n, width)
        ids = self.inner[raw]
        rows = np.arange(n)
        ids[rows, size - 1] = self.final[raw[rows, size - 1]]
        none = 1 << 40
        inside = np.arange(width - 1)[None, :] < (size - 1)[:, None] if width > 1 else np.zeros((n, 0), bool)
        rank = np.full((n, max(width - 1, 0)), none, np.int64)
        if inside.any():
            rank[inside] = self._rank((ids[:, :-1] * self.size + ids[:, 1:])[inside])
        live = rows
        columns = np.arange(width)
        while width > 1 and len(live):
            best = rank[live].argmin(axis=1)
            low = rank[live, best]
            go = low < none
            live, best, low = live[go], best[go], low[go]
            if not len(live):
                break
            sub = ids[live]
            sub[np.arange(len(live)), best] = self.made[low]
            source = np.minimum(columns[None, :] + (columns[None, :] > best[:, None]), width - 1)
            sub = np.take_along_axis(sub, source, axis=1)
            ids[live] = sub
            size[live] -= 1
            r = rank[live]
            shift = np.minimum(columns[None, :-1] + (columns[None, :-1] > best[:, None]), width - 2)
            r = np.take_along_axis(r, shift, axis=1)
            last = size[live] - 1
            k = np.arange(len(live))
            for side in (best - 1, best):
                ok = (side >= 0) & (side < last)
                r[k[ok], side[ok]] = self._rank(sub[k[ok], side[ok]] * self.size + sub[k[ok], side[ok] + 1])
            r[columns[None, :-1] >= last[:, None]] = none
            rank[live] = r
        return [ids[i, : size[i]].astype(np.uint32) for i in range(n)]

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Number of each word hash in the table, -1 where it is new."""
        out = np.full(len(h), -1, np.int64)
        at, slot, mask = np.arange(len(h)), (h >> U64(17)).astype(np.int64) & (self.slots - 1), self.slots - 1
        while len(at):
            w = self.where[slot]
            hit = (w >= 0) & (self.keys[slot] == h[at])
            out[at[hit]] = w[hit]
            more = ~hit & (w >= 0)
            at, slot = at[more], (slot[more] + 1) & mask
        return out

    def _insert(self, h: np.ndarray, number: np.ndarray) -> None:
        if (self.known + len(h)) * 2 > self.slots:
            full = self.where >= 0
            h, number = np.concatenate([self.keys[full], h]), np.concatenate([self.where[full], number])
            while len(h) * 3 > self.slots:
                self.slots *= 2
            self.keys, self.where = np.zeros(self.slots, np.uint64), np.full(self.slots, -1, np.int64)
        mask = self.slots - 1
        slot = (h >> U64(17)).astype(np.int64) & mask
        at = np.arange(len(h))
        while len(at):
            free = self.where[slot] < 0
            s, a = slot[free], at[free]
            self.where[s], self.keys[s] = number[a], h[a]  # of those that want one slot, the last stays
            lost = self.where[s] != number[a]
            at = np.concatenate([at[~free], a[lost]])
            slot = np.concatenate([(slot[~free] + 1) & mask, (s[lost] + 1) & mask])
        self.known = int((self.where >= 0).sum())

    def _learn(self, cp: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> None:
        h, first = np.unique(h, return_index=True)
        texts = ["".join(map(chr, cp[a:b].tolist())) for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        raw = [t.encode() for t in texts]
        ids: list[np.ndarray] = [None] * len(raw)  # type: ignore[list-item]
        order = sorted((i for i in range(len(raw)) if len(raw[i]) <= _LONG), key=lambda i: len(raw[i]))
        for lo in range(0, len(order), 8192):
            part = order[lo : lo + 8192]
            for i, x in zip(part, self.merge([raw[i] for i in part]), strict=True):
                ids[i] = x
        for i in range(len(raw)):
            if ids[i] is None:
                ids[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        count = np.array([len(x) for x in ids], np.int64)
        base = len_known = self._total
        need = base + len(ids)
        while need > len(self.begin):
            self.begin, self.length = np.append(self.begin, np.zeros_like(self.begin)), np.append(self.length, np.zeros_like(self.length))
        grown = self.used + int(count.sum())
        while grown > len(self.pool):
            self.pool = np.append(self.pool, np.zeros_like(self.pool))
        self.pool[self.used : grown] = np.concatenate(ids)
        self.begin[base:need] = self.used + np.concatenate([[0], np.cumsum(count)[:-1]])
        self.length[base:need] = count
        self.used, self._count = grown, need
        self._insert(h, np.arange(len_known, need))

    _count = 0

    @property
    def _total(self) -> int:
        if not self.known:
            self._count = 0
        return self._count

    def _fast(self, texts: list[str]) -> list[np.ndarray]:
        joined = " ".join(texts)
        cp = self.lower[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
        n = len(cp)
        kind = self.kind[cp]
        begins = kind != _SPACE
        begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        quote = np.flatnonzero((cp == 39) & begins)
        quote = quote[quote + 1 < n]
        quote = quote[kind[quote + 1] == _LETTER]  # a lone ' before letters may open 's, 't, 're, 've, 'm, 'll, 'd
        if len(quote):
            one = cp[quote + 1]
            two = np.where(quote + 2 < n, cp[np.minimum(quote + 2, n - 1)], 0)
            single = np.isin(one, [115, 116, 109, 100])
            double = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
            for which, k in ((single, 2), (double & ~single, 3)):
                q = quote[which]
                begins[q + 1] = False
                after = q + k
                ok = after < n
                after = after[ok]
                begins[after[kind[after] == _LETTER]] = True
        start = np.flatnonzero(begins)
        if not len(start):
            return [np.zeros(0, np.uint32)] * len(texts)
        gaps = np.flatnonzero(kind == _SPACE)
        end = np.append(start[1:], n)
        if len(gaps):
            slot = np.searchsorted(gaps, start)
            end = np.minimum(end, np.append(gaps, n)[slot])
        p, inv = _powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.codes[cp] * p[:n], out=sums[1:])
        h = mix((sums[end] - sums[start]) * inv[start] + (end - start).astype(np.uint64))
        which = self._find(h)
        new = which < 0
        if new.any():
            if self._total > _MOST_WORDS:
                self._clear()
                new[:] = True
            self._learn(cp, start[new], end[new], h[new])
            which[new] = self._find(h[new])
        count = self.length[which].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(count)])
        flat = self.pool[np.repeat(self.begin[which] - total[:-1], count) + np.arange(total[-1])]
        sizes = np.array([len(t) for t in texts], np.int64) + 1
        border = np.concatenate([[0], np.cumsum(sizes)])
        cut = total[np.searchsorted(start, border)]
        return [flat[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text, as uint32."""
        out: list[np.ndarray] = [None] * len(texts)  # type: ignore[list-item]
        fast, size = [], 0
        for i, t in enumerate(texts):
            if not t:
                out[i] = np.zeros(0, np.uint32)
            elif (t.isascii() or self._plain(t)) and not any(a in t for a in self.added):
                fast.append(i)
                size += len(t)
                if size > 1 << 20:
                    self._give(out, fast, texts)
                    fast, size = [], 0
            else:
                out[i] = np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32)
        self._give(out, fast, texts)
        return out

    def _plain(self, text: str) -> bool:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return bool(points.max() < _LIMIT) and bool(self.plain[points].all())

    def _give(self, out, which, texts) -> None:
        if which:
            for i, ids in zip(which, self._fast([texts[i] for i in which]), strict=True):
                out[i] = ids


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    from weirgate.llm.textkernel import _power

    return _power(n)

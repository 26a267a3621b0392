"""Language-model scoring with a log-frequency Bloom filter (Talbot and Osborne, 2007).

Unigrams and bigrams of the training documents are counted exactly (hash-partitioned, pre-aggregated in sorted
runs). Each count c is quantised to q = floor(log2 c) + 1 and the filter gets the entries (n-gram, 1) ... (n-gram, q).
A count is read back by probing level after level until one is absent. The filter is cut into segments by n-gram
hash and grows with the number of entries; no n-gram is left out of it, and no task holds all of it.

Documents are cut into blocks. Each block sends its distinct words and bigrams once to the tasks that hold their
segments, and the answers come back to the block: levels from the filter, and for the unigram score that the query
also shows, exact counts of the words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgate.llm.store import materialize, parts_for, plan_bytes, small_batches
from weirgate.llm.textkernel import SPACED, U64, chunks, lean, mix, text_bytes, words

#: The end of a text, as a token.
END = np.uint64(0x6A09E667F3BCC909)
#: Bytes of text in a block.
BLOCK_BYTES = 6 << 20
#: Most bytes of the filter that a task holds at a time (it takes more of it in turn), bits for each entry, and probes for each entry.
MAX_FILTER_BYTES, ENTRY_BITS, PROBES = 64 << 20, 7, 4


def token_stream(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the documents, each closed by END, and where each document's tokens begin."""
    hashes, counts = [], []
    for lo, hi in chunks(off):
        w = words(data, off[lo : hi + 1], SPACED)
        hashes.append(np.insert(w.hash, w.first[1:], END))
        counts.append(w.count + 1)
    n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(n)])


def bigrams(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of adjacent token pairs within documents, and the index of each pair's second token."""
    if len(tokens) < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    second = np.ones(len(tokens), bool)
    second[first[:-1]] = False
    at = np.flatnonzero(second)
    return bigram_hash(tokens[at - 1], tokens[at]), at


def bigram_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * U64(0x9E3779B97F4A7C15) + mix(right + U64(1)))


def key_bits(docs: DataFrame) -> int:
    """Bits of a bigram's hash that are kept: so many that at most about one in a thousand shares its own."""
    return min(64, max(40, (plan_bytes(docs) * 8).bit_length() + 6))


def sorted_runs(keys: np.ndarray, counts: np.ndarray, bits: int = 64) -> bytes:
    """Sorted distinct keys (of whose 64 bits only the top ``bits`` are set) as byte planes of their differences, and their counts."""
    keys = keys >> U64(64 - bits)
    steps = np.diff(keys, prepend=U64(0)) if len(keys) else keys
    width = max(1, (int(steps[1:].max(initial=0)).bit_length() + 7) // 8) if len(keys) else 1
    planes = steps.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes() if len(keys) else b""
    head = np.array([len(keys), width + 256 * bits, int(keys[0]) if len(keys) else 0], np.uint64).tobytes()
    low = np.minimum(counts, 255).astype(np.uint8)
    return head + planes + zlib.compress(low.tobytes() + counts[counts >= 255].astype(np.int64).tobytes(), 1)


def read_runs(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, width, first = np.frombuffer(blob[:24], np.uint64).tolist()
    bits, width = divmod(width, 256)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :width] = np.frombuffer(blob[24 : 24 + n * width], np.uint8).reshape(width, n).T
    steps = steps.reshape(-1).view(np.uint64).copy()
    steps[0] = first
    rest = zlib.decompress(blob[24 + n * width :])
    counts = np.frombuffer(rest[:n], np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(rest[n:], np.int64)
    return np.cumsum(steps, dtype=np.uint64) << U64(64 - bits), counts


def _shards(keys: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Sorted keys by their top ``bits``."""
    edge = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << U64(64 - bits)) if bits else np.array([0])
    edge = np.append(edge, len(keys))
    for s in range(1 << bits):
        if edge[s] < edge[s + 1]:
            yield s, keys[edge[s] : edge[s + 1]], counts[edge[s] : edge[s + 1]]


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[begin], np.add.reduceat(counts, begin) if len(begin) else counts


#: Stands for a null doc_id within blocks.
NO_ID = -(1 << 63)
_PARTS = "kind int, block long, shard int, rows int, blob binary, ids binary"


def _part(kind: int, block: int, shard: int, rows: int, blob: bytes, ids: bytes = b"") -> tuple:
    return kind, block, shard, rows, blob, ids


def _cut(block_bytes: int):
    """Rows of kind 0: a block's documents as positions in its own word list, and that list. Block numbers hold the partition's, so they're unique."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        def close(block: int, held) -> Iterator[tuple]:
            ids, train, tokens, n = (np.concatenate([x[k] for x in held]) for k in range(4))
            vocab, spot = np.unique(tokens, return_inverse=True)
            seen = np.bincount(spot[np.repeat(train, n)], minlength=len(vocab))
            own = sorted_runs(vocab, seen)
            head = np.array([len(ids), len(own)], np.int64).tobytes()
            body = np.ascontiguousarray(spot.astype(np.uint32)).view(np.uint8).reshape(-1, 4).T.tobytes()
            yield _part(0, block, 0, len(ids), head + train.astype(np.uint8).tobytes() + n.astype(np.int64).tobytes() + own + zlib.compress(body, 1), ids.tobytes())

        for number, held in enumerate(_held(batches, block_bytes)):
            yield from _batches(close((TaskContext.get().partitionId() << 32) + number, held))

    return cut


def _block(blob: bytes) -> tuple[np.ndarray, ...]:
    """Of a row of kind 0: which documents train, tokens of each, the block's words, how often they occur in training, and the tokens as positions among them."""
    docs, own = np.frombuffer(blob[:16], np.int64).tolist()
    at = 16 + 9 * docs
    train, n = np.frombuffer(blob[16 : 16 + docs], np.uint8) > 0, np.frombuffer(blob[16 + docs : at], np.int64)
    planes = np.frombuffer(zlib.decompress(blob[at + own :]), np.uint8).reshape(4, -1)
    return train, n, *read_runs(blob[at : at + own]), np.ascontiguousarray(planes.T).reshape(-1).view(np.uint32).astype(np.int64)


def _held(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[list[tuple[np.ndarray, ...]]]:
    """Lists of (ids, train, tokens, tokens of each document) of about ``block_bytes`` of text."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        data, off = text_bytes(batch.column("text"))
        ids, train = np.asarray(batch.column("doc_id")), np.asarray(batch.column("train"))
        for lo, hi in chunks(off):
            tokens, first = token_stream(data, off[lo : hi + 1])
            held.append((ids[lo:hi], train[lo:hi], tokens, np.diff(first)))
            size += int(off[hi] - off[lo])
            if size >= block_bytes:
                yield held
                held, size = [], 0
    if held:
        yield held


def _asked(shard_bits: int, bits: int):
    """Rows of kind 1 and 2: the distinct words and bigrams of a block and how often they occur in training."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(block: int, blob: bytes) -> Iterator[tuple]:
            train, n, vocab, seen, spot = _block(blob)
            for s, k, c in _shards(vocab, seen, shard_bits):
                yield _part(1, block, s, len(k), sorted_runs(k, c))
            pair, at = bigrams(vocab[spot], np.concatenate([[0], np.cumsum(n)]))
            pair, taught = short_key(pair, bits), np.repeat(train, n)[at]
            own, often = np.unique(pair[taught], return_counts=True)
            keys = np.union1d(own, pair[~taught])
            counts = np.zeros(len(keys), np.int64)
            counts[np.searchsorted(keys, own)] = often
            for s, k, c in _shards(keys, counts, shard_bits):
                yield _part(2, block, s, len(k), sorted_runs(k, c, bits))

        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                yield from _batches(rows(block, blob))

    return asked


def short_key(keys: np.ndarray, bits: int) -> np.ndarray:
    """The keys with all but their top ``bits`` cleared."""
    return keys >> U64(64 - bits) << U64(64 - bits)


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    names = ["kind", "block", "shard", "rows", "blob", "ids"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    held: list[tuple] = []
    size = 0
    for r in rows:
        held.append(r)
        size += len(r[4]) + len(r[5])
        if size > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names)


def _count(max_filter_bytes: int):
    def count(key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _counted(key, group, max_filter_bytes)

    return count


def _counted(key: tuple, group: Iterator[pa.RecordBatch], max_filter_bytes: int) -> Iterator[pa.RecordBatch]:
    """Of a shard: kind 3: its n-grams that occur in training, their occurrences, and those that occur once; kind 4 (words) and 5
    (bigrams): total counts (of words) and levels by the filter, for each block that asked, in the order of its keys."""
    order, shard = (k.as_py() for k in key)
    parts = [(b, *read_runs(blob)) for batch in group for b, blob in zip(batch.column("block").to_pylist(), batch.column("blob").to_pylist(), strict=True)]
    keys, counts = _merge([p[1:] for p in parts])
    level = filter_levels(keys, counts, max_filter_bytes)

    def rows() -> Iterator[tuple]:
        yield _part(3, order, shard, len(keys), np.array([(counts > 0).sum(), counts.sum(), (counts == 1).sum()], np.int64).tobytes())
        for block, k, _ in parts:
            at = np.searchsorted(keys, k)
            own = counts[at] if order == 1 else counts[:0]
            yield _part(3 + order, block, shard, len(k), zlib.compress(np.minimum(own, 255).astype(np.uint8).tobytes() + own[own >= 255].tobytes(), 1), zlib.compress(level[at].tobytes(), 1))

    yield from _batches(rows())


def levels_of(counts: np.ndarray) -> np.ndarray:
    """floor(log2 c) + 1."""
    return np.frexp(counts.astype(np.float64))[1]


def _expected(top: int) -> np.ndarray:
    """What a count of each level is taken for: the geometric middle of its range."""
    q = np.arange(top + 1)
    lo, hi = 2.0 ** (q - 1), 2.0**q - 1
    return np.where(q == 0, 0.0, np.sqrt(lo * np.maximum(hi, lo)))


class Filter:
    """Segments of a log-frequency Bloom filter; n-grams of order 1 and 2 live in the same ones."""

    def __init__(self, shard_bits: int, segment_bits: int, top: int, floor: int, tokens: int, types: int, weight: float, bits: np.ndarray, key_bits: int = 64):
        self.shard_bits, self.segment_bits, self.top, self.floor = shard_bits, segment_bits, top, floor
        self.tokens, self.types, self.weight, self.bits = tokens, types, weight, bits
        self.expected, self.key_bits = _expected(top), key_bits

    @staticmethod
    def slots(keys: np.ndarray, level: int, segment_bits: int) -> list[np.ndarray]:
        h = mix(keys + U64(level * 0x9E3779B97F4A7C15 % (1 << 64)))
        step = mix(h + U64(0x632BE59BD9B4E019)) | U64(1)
        return [(h + U64(k) * step) % U64(segment_bits) for k in range(PROBES)]

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Quantised counts by repeated probes: level after level while all bits of an entry are set."""
        level = np.zeros(len(keys), np.int64)
        at = np.arange(len(keys))
        base = (keys >> U64(64 - self.shard_bits) if self.shard_bits else np.zeros(len(keys), np.uint64)) * U64(self.segment_bits)
        for q in range(self.floor, self.top + 1):
            own, there = keys[at], base[at]
            alive = np.ones(len(at), bool)
            for slot in self.slots(own, q, self.segment_bits):
                spot = there[alive] + slot[alive]
                alive[alive] = (self.bits[spot >> U64(3)] >> (spot & U64(7)).astype(np.uint8)) & 1 == 1
                if not alive.any():
                    break
            at = at[alive]
            if not len(at):
                break
            level[at] = q
        return level

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Expected counts."""
        return self.expected[self.levels(keys)]


def segment(keys: np.ndarray, counts: np.ndarray) -> Filter:
    """The filter of some n-grams; a count of 0 has no entry."""
    level = levels_of(counts)
    top = max(1, int(level.max(initial=0)))
    size = max(64, int(level.sum()) * ENTRY_BITS + 63) // 64 * 64
    flags = np.zeros(size, np.uint8)
    for q in range(1, top + 1):
        for slot in Filter.slots(keys[level >= q], q, size):
            flags[slot] = 1
    return Filter(0, size, top, 1, int(counts.sum()), int((counts > 0).sum()), 0.0, np.packbits(flags, bitorder="little"))


def filter_levels(keys: np.ndarray, counts: np.ndarray, max_filter_bytes: int) -> np.ndarray:
    """What the filter gives for each of the sorted keys; of its segment ``max_filter_bytes`` are held at a time."""
    out = np.zeros(len(keys), np.uint8)
    entries = np.cumsum(levels_of(counts), dtype=np.int64)
    lo = done = 0
    while lo < len(keys):
        hi = max(lo + 1, int(np.searchsorted(entries, done + max_filter_bytes * 8 // ENTRY_BITS, side="right")))
        out[lo:hi] = segment(keys[lo:hi], counts[lo:hi]).levels(keys[lo:hi])
        lo, done = hi, int(entries[hi - 1])
    return out


class Figures:
    """What the score takes from the whole of the training documents."""

    def __init__(self, counted: DataFrame):
        sums = {1: np.zeros(3, np.int64), 2: np.zeros(3, np.int64)}
        for r in counted.where("kind = 3").select("block", "blob").collect():
            sums[r.block] += np.frombuffer(r.blob, np.int64)
        self.types, self.tokens = int(sums[1][0]), int(sums[1][1])
        _, pairs, once = sums[2].tolist()
        self.weight = min(0.9, max(0.05, 1 - once / pairs)) if pairs else 0.0  # Good-Turing: the share of seen continuations
        self.expected = _expected(64)

    def score(self, levels: np.ndarray, spot: np.ndarray, first: np.ndarray, at: np.ndarray, pair_levels: np.ndarray) -> np.ndarray:
        """log10 probability of each document: bigrams (of which ``at`` has the second tokens) interpolated with add-one unigrams."""
        known = self.expected[levels]
        p = ((known + 1) / (self.tokens + self.types + 1))[spot]
        left, right = known[spot[at - 1]], known[spot[at]]
        joint = np.minimum(self.expected[pair_levels], np.minimum(left, right))  # no n-gram is more frequent than its parts
        w = np.where(left > 0, self.weight, 0.0)
        p[at] = (1 - w) * p[at] + w * joint / np.maximum(left, 1)
        sums = np.concatenate([[0.0], np.cumsum(np.log10(p))])
        return sums[first[1:]] - sums[first[:-1]]


_OUT = "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(figures: Figures, bits: int):
    def score(key: tuple, group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group.column(k).to_pylist() for k in ("kind", "shard", "blob", "ids")), strict=True), key=lambda r: r[:2])
        blob, ids = rows[0][2:]
        train, n, vocab, _, spot = _block(blob)
        levels = {k: np.frombuffer(b"".join(zlib.decompress(r[3]) for r in rows if r[0] == k), np.uint8) for k in (4, 5)}
        counts = []
        for raw, k in ((zlib.decompress(r[2]), len(zlib.decompress(r[3]))) for r in rows if r[0] == 4):
            own = np.frombuffer(raw[:k], np.uint8).astype(np.int64)
            own[own == 255] = np.frombuffer(raw[k:], np.int64)
            counts.append(own)
        counts = np.concatenate(counts)
        first = np.concatenate([[0], np.cumsum(n)])
        pair, at = bigrams(vocab[spot], first)
        back = np.unique(short_key(pair, bits), return_inverse=True)[1]
        logs = np.log10((counts + 1) / (figures.tokens + figures.types + 1))[spot]
        base = np.add.reduceat(logs, first[:-1])
        known = np.add.reduceat((counts > 0)[spot].astype(np.int64), first[:-1])
        return pa.table([pa.array(np.frombuffer(ids, np.int64), mask=np.frombuffer(ids, np.int64) == NO_ID), train, n, known, np.full(len(n), figures.tokens), base, figures.score(levels[4], spot, first, at, levels[5][back])], names=[x.split()[0] for x in _OUT.split(", ")])

    return score


def score_documents(docs: DataFrame, train, block_bytes: int = BLOCK_BYTES, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """One row for each row of ``docs`` (in ``_OUT``); ``train`` is a condition on its columns.

    Tokens are words between blanks, A-Z in lower case, and one end of text. A null text is empty (its end
    remains); a null doc_id stays null (so does the smallest long); repeated rows count as often as they occur; with no training row
    every token is unknown; an empty table gives an empty result. Other columns are ignored.
    """
    slim = small_batches(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.col("text").cast("string").alias("text"))
    shard_bits = min(17, max(4, (parts_for(slim, 16 << 20) - 1).bit_length()))
    kept = key_bits(slim)
    parts = materialize(slim.mapInArrow(lean(_cut(block_bytes)), _PARTS), "blocks")
    counted = materialize(parts.mapInArrow(lean(_asked(shard_bits, kept)), _PARTS).groupBy("kind", "shard").applyInArrow(_count(max_filter_bytes), _PARTS), "counts")
    figures = Figures(counted)
    return parts.unionByName(counted.where("kind > 3")).groupBy("block").applyInArrow(_score(figures, kept), _OUT)

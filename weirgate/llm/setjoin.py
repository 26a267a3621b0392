"""N-gram Jaccard self-join with PartEnum signatures (Arasu, Ganti and Kaushik, 2006).

A document is the set of its distinct five-word shingles. Sets are dealt into size bands, each twice as wide as the
one before; a set near the upper end of its band also takes part in the next one, so two sets within the ratio 4/3
always meet in a band.

Signatures. A band's shingle domain is hashed into first-level partitions of three second-level cells each, and the
subsets of two cells are enumerated: a signature is one partition, two of its cells and the set's projection on them
(empty projections are left out). One differing shingle changes at most two of a partition's three signatures, a second
one the third. Linked sets differ in at most (|A| + |B|) / 7 shingles, so a set can count, from the cells that it
occupies, how many signatures of the first m partitions it must share with every set that it links with; it takes the
smallest m for which these are :func:`wanted`. The smaller m of two linked sets holds for both.

Candidates. Sets that share as many signatures as either must are candidates. A signature held by more than ``bucket``
sets is crowded: it gives its holders only a link to its hottest holder (the one with most crowded signatures), and as
much less is asked of them elsewhere. Sets that hold so many crowded signatures that nothing is left to ask are joined
among each other by :mod:`weirgate.llm.crowded`. Every candidate is verified on whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirgate.llm import blocks
from weirgate.llm.crowded import rare_prefix_pairs
from weirgate.llm.graph import components, merge_components
from weirgate.llm.store import heavy_join, keep_rows, materialize, parts_for, row_hash, texts
from weirgate.llm.textkernel import SPACED, U64, chunks, lean, mix, text_bytes, windows, words

#: Words in a shingle.
SHINGLE = 5
#: Second-level cells of a partition; subsets leave out one of them.
CELLS = 3
#: Members of a signature that are paired with each other.
BUCKET = 32
#: Signatures that a worker collects before it deals them to partitions or thins out crowded ones.
HELD = 1 << 18
#: Leaders are tried for a set with a crowded signature for every ``LED`` shingles: the hottest of so many.
LED, LEADERS = 8, 4
#: Part numbers that signatures are dealt to at least.
PART_NUMBERS = 512
#: Shingles of sets with crowded signatures that a task joins.
CROWDED_SHINGLES = 1 << 21
#: Sets from this size on are told apart by four bytes of each hash, smaller ones by two.
WIDE = 1 << 12
#: Pairs held in a worker at once.
PIECE = 1 << 17
#: Bytes of stored sets for each task that pairs are verified in.
SETS_BYTES = 4 << 20
#: Bytes of a Bloom filter that tells which documents' sets are needed, and of its segments.
BLOOM_BYTES, SEGMENT = 8 << 20, 1 << 13
#: Stands for more crowded signatures than any set has, and for the sizes from here on.
ALL, LARGE = 1 << 30, (1 << 16) - 1
#: Bytes of a signature that are shuffled. Its part number goes with them; more collisions only make more candidates.
SIG_BYTES = 5


def shingle_sets(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    w = words(data, off, SPACED)
    h, at = windows(w.hash, w.first, SHINGLE)
    bounds = np.searchsorted(at, w.first)
    out = []
    for d, n in enumerate(w.count.tolist()):
        if n >= SHINGLE:
            out.append(np.unique(h[bounds[d] : bounds[d + 1]]))
        elif n:
            out.append(windows(w.hash[w.first[d] : w.first[d + 1]], np.array([0, n]), n)[0] ^ U64(n))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_class(shingles: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def wanted(n: int) -> int:
    """Signatures that a set of ``n`` shingles must share with each set that it links with."""
    return 2 + min(n, LARGE) // 32


def bands(n: int) -> list[int]:
    """Lower ends of the bands in which a set of ``n`` shingles takes part."""
    low = 1 << (n.bit_length() - 1)
    return [low, 2 * low] if 4 * n >= 6 * low else [low]


def partitions(low: int) -> int:
    """First-level partitions of a band."""
    return 6 + (9 * low) // 25


def signatures(s: np.ndarray) -> tuple[np.ndarray, int]:
    """The set's signatures, and how many it shares at least with any set that it links with (in one band)."""
    n, out, shared = len(s), [], ALL
    for low in bands(n) if n else []:
        parts = partitions(low)
        salt = U64((low * 0x9E3779B97F4A7C15) % (1 << 64))
        h = mix(s ^ salt)
        cell = (h % U64(CELLS * parts)).astype(np.int64)
        sums = np.zeros(CELLS * parts, np.uint64)
        np.add.at(sums, cell, mix(h + salt))
        count = np.bincount(cell, minlength=CELLS * parts).reshape(parts, CELLS)
        occupied = (count > 0).sum(axis=1)
        single, several = np.cumsum(occupied == 1), np.cumsum(occupied > 1)
        # in its own band a set's partners end with the band
        differ = (n + (min(4 * n // 3, 2 * low - 1) if n >= low else 4 * n // 3)) // 7
        safe = np.maximum(2 * single + 3 * several - 2 * differ, 2 * several + single - differ)
        m = min(int(np.argmax(safe >= wanted(n))) if safe[-1] >= wanted(n) else parts - 1, parts - 1)
        shared = min(shared, int(safe[m]))
        sums = sums.reshape(parts, CELLS)[: m + 1]
        names = np.arange((m + 1) * CELLS, dtype=np.uint64).reshape(m + 1, CELLS) * U64(0xA24BAED4963EE407) + salt
        sig = mix(sums.sum(axis=1, dtype=np.uint64)[:, None] - sums + mix(names))
        rest = count[: m + 1].sum(axis=1)[:, None] - count[: m + 1]
        out.append(sig[rest > 0])
    return np.concatenate(out) if out else np.zeros(0, np.uint64), shared if out else 0


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    data, off = text_bytes(batch.column("text"))
    for lo, hi in chunks(off):
        yield from enumerate(shingle_sets(data, off[lo : hi + 1]), lo)


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, cls = [0] * batch.num_rows, [0] * batch.num_rows
        for i, s in _sets(batch):
            n[i], cls[i] = len(s), set_class(s)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_hash"), pa.array(n, pa.int64()), pa.array(cls, pa.int64())], ["doc_id", "row_hash", "n_shingles", "class"])


#: Packed rows: signatures with their holders (class, size) at part 0 or more; crowded ones, as (leader, class, size,
#: number of signatures), at part -1 - p for p 0 or more.
_HELD = blocks.schema("sig", "class", "n", "many")


def _signature_rows(parts: int, bucket: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # sets of this partition's rows; copies add nothing
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            for _, s in _sets(batch):
                if not len(s) or (c := set_class(s)) in seen:
                    continue
                seen.add(c)
                own, shared = signatures(s)
                held.append((own, np.full(len(own), c, np.int64), np.full(len(own), min(len(s), LARGE), np.uint16)))
                size += len(own)
                if shared < wanted(len(s)):  # nothing can be asked of it
                    yield _crowd_rows(parts, [(np.array([c]), np.array([c]), np.array([min(len(s), LARGE)], np.uint16), np.array([ALL]))])
                if size > HELD:
                    yield from _dealt(held, parts, bucket)
                    held, size = [], 0
        if held:
            yield from _dealt(held, parts, bucket)

    return rows


def _dealt(held: list[tuple[np.ndarray, ...]], parts: int, bucket: int) -> Iterator[pa.RecordBatch]:
    sig, cls, n = (np.concatenate(x) for x in zip(*held, strict=True))
    sig, cls, n, crowd = _thin(sig, cls, n, bucket)
    if crowd is not None:
        yield _crowd_rows(parts, [crowd])
    own = sig.view(np.uint8).reshape(-1, 8)[:, :SIG_BYTES]  # the low bytes
    out = blocks.deal((mix(sig) % U64(parts)).astype(np.int64), sig=own, **{"class": cls}, n=n)
    yield pa.RecordBatch.from_arrays([*out.columns, pa.array([b""] * out.num_rows, pa.binary())], [*out.schema.names, "many"])


def _crowd_rows(parts: int, crowds: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Packed (leader, class, n, number of crowded signatures), by class."""
    leader, cls, n, many = (np.concatenate(x) for x in zip(*crowds, strict=True))
    order = np.lexsort((leader, cls))
    leader, cls, n, many = leader[order], cls[order], n[order], many[order]
    fresh_pair = np.append(True, (cls[1:] != cls[:-1]) | (leader[1:] != leader[:-1]))
    begin = np.flatnonzero(fresh_pair)
    many = np.add.reduceat(many, begin)
    cls, leader, n = cls[begin], leader[begin], n[begin]
    part = (cls.view(np.uint64) % U64(parts)).astype(np.int64)
    out = blocks.deal(part, sig=leader, **{"class": cls}, n=n.astype(np.uint16), many=many.astype(np.int64))
    return pa.RecordBatch.from_arrays([pa.array((-1 - np.asarray(out.column(0))).astype(np.int32)), *out.columns[1:]], out.schema.names)


def _thin(sig: np.ndarray, cls: np.ndarray, n: np.ndarray, bucket: int):
    """Without all but the hottest ``bucket`` + 1 holders of each signature that more hold; these come as (leader, class, n, 1)."""
    order = np.argsort(sig)
    begin, count = blocks.runs(sig[order])
    if not (count > bucket + 1).any():
        return sig, cls, n, None
    which, at = blocks.spread(begin[count > bucket + 1], count[count > bucket + 1])
    at = order[at]
    by = np.lexsort((cls[at], which))
    at, which = at[by], which[by]
    again = np.append(False, (cls[at][1:] == cls[at][:-1]) & (which[1:] == which[:-1]))
    stays = np.ones(len(sig), bool)
    stays[at[again]] = False
    at, which, leader, place = _hottest(cls, at[~again], which[~again])
    out = place > bucket
    stays[at[out]] = False
    crowd = (leader[out], cls[at[out]], n[at[out]], np.ones(int(out.sum()), np.int64))
    return sig[stays], cls[stays], n[stays], crowd


def _hottest(cls: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, ...]:
    """Entries ``at`` of groups ``which``, hottest class of each group first; then that class, and the place in the group.

    A class is the hotter, the more of these groups it is in.
    """
    _, place, heat = np.unique(cls[at], return_inverse=True, return_counts=True)
    by = np.lexsort((cls[at], -heat[place], which))
    at, which = at[by], which[by]
    begin, count = blocks.runs(which)
    return at, which, np.repeat(cls[at[begin]], count), np.arange(len(at)) - np.repeat(begin, count)


#: A pair a < b of classes, their sizes and the signatures they share; or, packed by class, crowded signatures.
_FOUND = "a long, b long, na int, nb int, n long, " + blocks.schema("leader", "class", "size", "many")


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can be linked."""
    return 4 * np.minimum(x, y) >= 3 * np.maximum(x, y)


def _collide(parts: int, bucket: int):
    def collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            crowd = np.asarray(batch.column("part")) < 0
            if crowd.any():
                yield _crowd_out(batch.filter(pa.array(crowd)))
                batch = batch.filter(pa.array(~crowd))
            held.append((_signatures_of(batch), blocks.entries(batch.column("class"), np.int64), blocks.entries(batch.column("n"), np.uint16)))
            size += len(held[-1][0])
            if size > 4 * HELD:  # crowded signatures are thinned out as they come
                *rest, excess = _thin(*(np.concatenate(x) for x in zip(*held, strict=True)), bucket)
                held, size = [tuple(rest)], 0
                if excess is not None:
                    yield _crowd_out(_crowd_rows(parts, [excess]))
        if not held:
            return
        sig, cls, n = _shared(held)
        del held
        begin, count = blocks.runs(sig)
        tallies: list[np.ndarray] = []
        small = count <= bucket
        for step in range(1, bucket):  # members ``step`` apart, in all small buckets at once
            rest = count[small] - step
            if not (rest > 0).any():
                break
            _, i = blocks.spread(begin[small][rest > 0], rest[rest > 0])
            for lo in range(0, len(i), PIECE):
                k = i[lo : lo + PIECE]
                k = k[_near(n[k], n[k + step])]
                tallies.append(_tally(cls, n, k, k + step))
                if sum(map(len, tallies)) > PIECE:  # the parts of a pair's count are added up later
                    yield _pairs_out(_add(tallies))
                    tallies = []
        if tallies:
            yield _pairs_out(_add(tallies))
        if not small.all():
            which, at = blocks.spread(begin[~small], count[~small])
            at, _, leader, _ = _hottest(cls, at, which)
            yield _crowd_out(_crowd_rows(parts, [(leader, cls[at], n[at], np.ones(len(at), np.int64))]))

    return collide


def _signatures_of(batch: pa.RecordBatch) -> np.ndarray:
    own = blocks.entries(batch.column("sig"), np.uint8).reshape(-1, SIG_BYTES)
    sig = np.zeros((len(own), 8), np.uint8)
    sig[:, :SIG_BYTES] = own
    size = blocks.sizes(batch.column("sig"), SIG_BYTES)
    return sig.view(np.uint64).ravel() | (np.repeat(np.asarray(batch.column("part")), size).astype(np.uint64) << U64(8 * SIG_BYTES))


def _shared(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """The signatures that several entries have, sorted by signature and class, without repeats."""
    sig, cls, n = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(sig)
    begin, count = blocks.runs(sig[order])
    _, at = blocks.spread(begin[count > 1], count[count > 1])
    order = order[at]
    order = order[np.lexsort((cls[order], sig[order]))]
    sig, cls, n = sig[order], cls[order], n[order].astype(np.int64)
    own = np.ones(len(sig), bool)
    own[1:] = (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])
    return sig[own], cls[own], n[own]


_PAIR = np.dtype([("a", np.int64), ("b", np.int64), ("na", np.int32), ("nb", np.int32), ("n", np.int64)])


def _tally(cls: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How often each pair occurs; within a signature classes are in order, so a < b."""
    out = np.zeros(len(i), _PAIR)
    out["a"], out["b"], out["na"], out["nb"], out["n"] = cls[i], cls[j], n[i], n[j], 1
    return _add([out])


def _add(parts: list[np.ndarray]) -> np.ndarray:
    x = np.concatenate(parts)
    x = x[np.lexsort((x["b"], x["a"]))]
    begin = np.flatnonzero(np.append(True, (x["a"][1:] != x["a"][:-1]) | (x["b"][1:] != x["b"][:-1]))) if len(x) else np.zeros(0, np.int64)
    out = x[begin].copy()
    if len(x):
        out["n"] = np.add.reduceat(x["n"], begin)
    return out


def _empty(type_: pa.DataType, n: int) -> pa.Array:
    return pa.nulls(n, type_)


def _pairs_out(x: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(np.ascontiguousarray(x[k])) for k in _PAIR.names]
    return pa.RecordBatch.from_arrays([*columns, _empty(pa.int32(), len(x)), *(_empty(pa.binary(), len(x)) for _ in range(4))], [*_PAIR.names, "part", "leader", "class", "size", "many"])


def _crowd_out(batch: pa.RecordBatch) -> pa.RecordBatch:
    part = (-1 - np.asarray(batch.column("part"))).astype(np.int32)
    none = [_empty(t, len(part)) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())]
    return pa.RecordBatch.from_arrays([*none, pa.array(part), *batch.columns[1:]], [*_PAIR.names, "part", "leader", "class", "size", "many"])


def _crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each class of the partition: its size, how many crowded signatures it holds, and those of its leaders that lead
    most, if it holds a signature for every ``LED`` shingles (the others are left to the join on rare prefixes)."""
    leader, cls, n, many = blocks.gather(batches, leader=np.int64, **{"class": np.int64}, size=np.uint16, many=np.int64)
    order = np.lexsort((leader, cls))
    leader, cls, n, many = leader[order], cls[order], n[order], many[order]
    pair = np.flatnonzero(np.append(True, (cls[1:] != cls[:-1]) | (leader[1:] != leader[:-1]))) if len(cls) else np.zeros(0, np.int64)
    if not len(pair):
        return
    leader, cls, n, many = leader[pair], cls[pair], n[pair], np.add.reduceat(many, pair)
    begin, count = blocks.runs(cls)
    total = np.minimum(np.add.reduceat(many, begin), ALL)
    size = n[begin].astype(np.int32)
    tried = LED * total >= size
    # a leader that many of the partition's classes (a random share of all) have in common is likely to be central
    _, who = np.unique(leader, return_inverse=True)
    by = np.lexsort((leader, -np.bincount(who, weights=np.minimum(many, ALL - 1))[who], cls))
    place = np.arange(len(by)) - np.repeat(begin, count)
    led = by[(place < LEADERS) & np.repeat(tried, count)]
    off = np.append(0, np.cumsum(np.where(tried, np.minimum(count, LEADERS), 0))).astype(np.int32)
    leaders = pa.ListArray.from_arrays(pa.array(off), pa.array(leader[led]))
    yield pa.RecordBatch.from_arrays([pa.array(cls[begin]), pa.array(size), pa.array(total), leaders], ["class", "size", "crowded", "leaders"])


def _bloom_slots(ids: np.ndarray, bits: int) -> np.ndarray:
    h = mix(ids.view(np.uint64))
    return np.stack([mix(h + U64(k)) % U64(bits) for k in range(4)])


def _passes(flags: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids the filter passes."""
    slots = _bloom_slots(ids, len(flags) * 8)
    return ((flags[slots >> U64(3)] >> (U64(7) - (slots & U64(7))).astype(np.uint8)) & 1).all(axis=0).astype(bool)


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    merged: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(bits, np.uint8)
            merged[k] = merged[k] | own if k in merged else own
    yield pa.RecordBatch.from_arrays([pa.array(list(merged), pa.int32()), pa.array([x.tobytes() for x in merged.values()], pa.binary())], ["part", "bits"])


def _bloom(ids: DataFrame, nbytes: int) -> np.ndarray:
    """A Bloom filter of at most ``nbytes`` of the one long column of ``ids``; if too full, it only passes more. Segments are merged by key."""
    bits = int(min(nbytes * 8, max(1 << 16, 1 << (ids.count() * 12).bit_length())))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(bits, bool)
        for batch in batches:
            flags[_bloom_slots(np.asarray(batch.column(0)), bits).ravel()] = True
        rows = np.packbits(flags).reshape(-1, min(SEGMENT, bits // 8))
        some = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([rows[k].tobytes() for k in some], pa.binary())], ["part", "bits"])

    out = np.zeros((bits // 8 // min(SEGMENT, bits // 8), min(SEGMENT, bits // 8)), np.uint8)
    segments = ids.mapInArrow(build, "part int, bits binary").repartition("part").mapInArrow(_union, "part int, bits binary")
    for r in segments.collect():  # at most ``nbytes``
        out[r.part] |= np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def _passed(shared):
    """(class, set) of each document that the filter passes; a partition gives each set once."""

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        flags = shared.value
        seen: set[int] = set()
        for batch in batches:
            passes = _passes(flags, np.asarray(batch.column("doc_id").fill_null(0)))
            for _, s in _sets(batch.filter(pa.array(passes))):
                if len(s) and (c := set_class(s)) not in seen:
                    seen.add(c)
                    yield c, s

    return passed


def short(s: np.ndarray) -> bytes:
    """A set by two bytes of each hash (four from ``WIDE`` shingles on): what two sets share of it is what they share or more."""
    return s.astype(np.uint16 if len(s) < WIDE else np.uint32).tobytes()


def _needed(shared):
    """Rows (class, short set, set) of the documents that the filter passes."""
    passed = _passed(shared)

    def rows(held: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        cls, brief, whole = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(brief, pa.binary()), pa.array(whole, pa.binary())], ["class", "short", "shingles"])

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for c, s in passed(batches):
            held.append((c, short(s), s.tobytes()))
            size += len(s)
            if size > 1 << 17:
                yield rows(held)
                held, size = [], 0
        if held:
            yield rows(held)

    return needed


def _holders(shared):
    """Rows (class, set) of the classes that the filter passes."""

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(pa.array(_passes(shared.value, np.asarray(batch.column(0)))))
            yield pa.RecordBatch.from_arrays(kept.columns, ["class", "set"])

    return holders


def _short_set(data: pa.Buffer | bytes) -> np.ndarray:
    wide = len(data) >= 4 * WIDE
    return np.frombuffer(data, np.uint32 if wide else np.uint16)


def most_shared(x: bytes, y: bytes) -> tuple[int, int, int]:
    """The sizes of two short sets, and the most that the sets can share."""
    p, q = _short_set(x), _short_set(y)
    if len(p) >= WIDE and len(q) >= WIDE:
        u, v = np.isin(p, q).sum(), np.isin(q, p).sum()
    else:
        u, v = _marked(p, q), _marked(q, p)
    return len(p), len(q), int(min(u, v))


def _marked(p: np.ndarray, q: np.ndarray) -> int:
    marks = np.zeros(1 << 16, bool)
    marks[q.astype(np.uint16)] = True
    return marks[p.astype(np.uint16)].sum()


def shared_shingles(x: bytes, y: bytes) -> tuple[int, int, int]:
    """The sizes of two sets, and how many shingles they share."""
    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    few, many = (p, q) if len(p) <= len(q) else (q, p)
    at = np.minimum(np.searchsorted(many, few), len(many) - 1)
    return len(p), len(q), int((many[at] == few).sum())


def _similar(percent: int, count):
    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            left, right = batch.column("sa"), batch.column("sb")
            for i in range(batch.num_rows):
                x, y, both = count(left[i].as_buffer(), right[i].as_buffer())
                ok[i] = 100 * both >= percent * (x + y - both)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], ["a", "b"])

    return similar


class _Documents:
    """Whole sets, made again from the texts of the documents concerned."""

    def __init__(self, slim: DataFrame, first: DataFrame, percent: int):
        self.slim, self.first, self.percent = slim, first, percent

    def filter_for(self, nodes: DataFrame):
        """A broadcast Bloom filter of the documents that stand for these classes."""
        ids = materialize(self.first.join(nodes, "class", "left_semi").select(F.coalesce("doc_id", F.lit(0)).alias("id")), "ids")
        return self.slim.sparkSession.sparkContext.broadcast(_bloom(ids, BLOOM_BYTES))

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link: first by short sets, which keep every link, then by whole ones."""
        degrees = materialize(_ends(pairs).groupBy("class").agg(F.count(F.lit(1)).alias("degree")), "degrees")
        sets = materialize(self.slim.mapInArrow(lean(_needed(self.filter_for(degrees))), "class long, short binary, shingles binary"), "sets")
        parts = parts_for(sets, SETS_BYTES)
        near = materialize(_meet(pairs, degrees, sets.select("class", F.col("short").alias("set")), parts, _similar(self.percent, most_shared)), "near")
        ids = _bloom(_ends(near).distinct(), BLOOM_BYTES)
        whole = sets.select("class", "shingles").mapInArrow(lean(_holders(self.slim.sparkSession.sparkContext.broadcast(ids))), "class long, set binary")
        return _meet(near, degrees, whole, parts, _similar(self.percent, shared_shingles))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class")))


def _meet(pairs: DataFrame, degrees: DataFrame, sets: DataFrame, parts: int, check) -> DataFrame:
    """The pairs (a, b) that ``check`` passes on their sets.

    Sets are dealt by class once, for both ends of the pairs. Of each pair the class with more pairs in ``degrees`` goes to
    the other: few classes have as many pairs, so none gets very many sets. The set of a class with very many pairs is copied
    before it goes, so that no task sends all of them.
    """
    a, b = (degrees.select(F.col("class").alias(x), F.col("degree").alias(f"d{x}")) for x in "ab")
    more = F.expr("da > db or da = db and a > b")
    dealt = pairs.join(a, "a").join(b, "b").select(F.when(more, F.col("a")).otherwise(F.col("b")).alias("away"), F.when(more, F.col("b")).otherwise(F.col("a")).alias("home"), F.floor(F.greatest("da", "db") / 64).cast("int").alias("most"))
    dealt = materialize(dealt.withColumn("salt", F.pmod(F.xxhash64("home"), F.col("most") + 1).cast("int")), "dealt")
    own = sets.repartition(parts, "class").dropDuplicates(["class"])
    going = own.select(F.col("class").alias("away"), F.col("set").alias("sa"))
    sent = dealt.where("most = 0").join(going, "away").select("away", "home", "sa")
    wide = dealt.where("most > 0")
    if not wide.isEmpty():
        copies = going.join(wide.select("away", "most").distinct(), "away").select("away", "sa", F.explode(F.sequence(F.lit(0), F.col("most"))).alias("salt"))
        sent = sent.unionByName(wide.join(copies, ["away", "salt"]).select("away", "home", "sa"))
    both = sent.join(own.select(F.col("class").alias("home"), F.col("set").alias("sb")), "home")
    return both.select(F.least("away", "home").alias("a"), F.greatest("away", "home").alias("b"), "sa", "sb").mapInArrow(lean(check), "a long, b long")


def jaccard_components(docs: DataFrame, percent: int = 75, bucket: int = BUCKET, rows_bytes: int = 4 << 20) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reached by links).

    Two documents link when 100 * intersection >= ``percent`` * union (75 or more). Fewer than five words make
    one shingle of the whole sequence; a null or wordless text has none and stands alone. Repeated rows and
    copies fall into one component; a null doc_id counts as the smallest; other columns are ignored; an empty table
    gives an empty result.
    """
    return _rows_of_components(docs, percent, bucket, rows_bytes).drop("row_hash")


def _rows_of_components(docs: DataFrame, percent: int = 75, bucket: int = BUCKET, rows_bytes: int = 4 << 20) -> DataFrame:
    """As ``jaccard_components``, with the hash of each row's text, which tells rows of one doc_id apart."""
    if percent < 75:
        raise ValueError("the bands are laid out for a similarity of 0.75 or more")
    slim = texts(docs)
    hashed = texts(docs, row_hash().alias("row_hash"))
    table = materialize(hashed.mapInArrow(lean(_classes), "doc_id long, row_hash long, n_shingles long, class long"), "classes")
    first = materialize(table.where("n_shingles > 0").groupBy("class").agg(F.min(F.struct(F.col("doc_id").alias("d"))).alias("m")).select("class", F.col("m.d").alias("doc_id")), "first")
    parts = parts_for(slim, rows_bytes)
    fine = parts * max(1, -(-PART_NUMBERS // parts))  # many part numbers even out the tasks' load
    rows = slim.mapInArrow(lean(_signature_rows(fine, bucket)), _HELD)
    found = materialize(rows.repartition(parts, "part").mapInArrow(lean(_collide(fine, bucket)), _FOUND), "collisions")
    packed = found.where("part is not null").select("part", "leader", "class", "size", "many")
    crowd = materialize(packed.repartition(parts, "part").mapInArrow(lean(_crowded), "class long, size int, crowded long, leaders array<long>"), "crowded")
    tallied = found.where("part is null").groupBy("a", "b").agg(F.sum("n").alias("n"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    # what a set may share in crowded signatures isn't counted there, so that much less is asked of it
    la, lb = (crowd.select(F.col("class").alias(x), F.col("crowded").alias(f"l{x}")) for x in "ab")
    tallied = tallied.join(la, "a", "left").join(lb, "b", "left")
    full, less = ([wanted_column(F.col(f"n{x}")) - F.coalesce(f"l{x}", F.lit(0)) * k for x in "ab"] for k in (0, 1))
    # if nothing is left to ask of either, the join on rare prefixes finds the pair
    asked = F.when(F.greatest(*less) > 0, F.greatest(*less)).otherwise(F.greatest(*full))
    pairs = materialize(tallied.where(F.col("n") >= asked).select("a", "b", "n"), "pairs")
    whole = _Documents(slim, first, percent)
    # first, each set with the one that it shares most with, and with its leader: that joins most groups
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b")
    led = crowd.select("class", F.explode("leaders").alias("leader")).join(crowd.select(F.col("class").alias("leader"), F.col("crowded").alias("heat")), "leader")
    led = led.groupBy("class").agg(F.max_by("leader", F.struct("heat", "leader")).alias("leader")).where("leader <> class")
    led = led.select(F.least("leader", "class").alias("a"), F.greatest("leader", "class").alias("b"))
    tried = materialize(best.unionByName(led).distinct(), "best")
    roots = materialize(components(materialize(whole.links(tried), "links")), "roots")
    # then all candidates that are still apart, and those that only crowded signatures could have told
    lost = crowd.where(F.col("crowded") >= wanted_column(F.col("size")))
    rest = _apart(pairs.select("a", "b"), roots)
    if shingles := lost.agg(F.sum("size")).first()[0]:
        rest = rest.unionByName(rare_prefix_pairs(slim, _passed(whole.filter_for(lost)), roots, 1 + shingles // CROWDED_SHINGLES, PIECE))
    rest = materialize(rest.distinct().join(tried, ["a", "b"], "left_anti"), "apart")
    if not rest.isEmpty():
        roots = materialize(merge_components(roots, materialize(whole.links(rest), "links")), "roots")
    reach = first.join(roots, first["class"] == roots.node, "left").select("class", F.coalesce("root", "class").alias("root"), "doc_id")
    least = reach.groupBy("root").agg(F.min(F.struct(F.col("doc_id").alias("d"))).alias("m"))
    names = materialize(heavy_join(reach.select("class", "root"), least, "root").select("class", F.col("m.d").alias("component")), "names")
    lone = table.where("n_shingles = 0").select("doc_id", "row_hash", "n_shingles", F.col("doc_id").alias("component_id"))
    joined = heavy_join(table.where("n_shingles > 0"), names, "class")
    return joined.select("doc_id", "row_hash", "n_shingles", F.col("component").alias("component_id")).unionByName(lone)


def wanted_column(n: Column) -> Column:
    """:func:`wanted` as an expression."""
    return 2 + F.floor(F.least(n, F.lit(LARGE)) / 32)


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    a, b = (roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
    both = pairs.join(a, "a", "left").join(b, "b", "left")
    return both.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def one_of_each(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` that stay when one document (the smallest doc_id) of each component does, with all their columns.

    Rows of one doc_id with different texts stay or go each by its own component; of repeated rows (same doc_id and text)
    that stay, one does. Null and wordless texts stand alone and stay. A null doc_id counts as the smallest. Column names
    may be any; an empty table gives an empty result.
    """
    found = _rows_of_components(docs, percent)
    return keep_rows(docs, found.select("doc_id", "row_hash", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("stays")))

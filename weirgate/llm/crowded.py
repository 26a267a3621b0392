"""Pairs of sets that only share crowded signatures: a join on rare prefixes.

Within the sets concerned every shingle is counted, and each set is put in order from its rarest shingle to its most
common one. Two linked sets of sizes x <= y share 3 (x + y) / 7 shingles or more, so the first shingle that they share
stands at a place of at most x - 3 (x + y) / 7 in the one and y - 3 (x + y) / 7 in the other (places from 0). For a set
on its own that is n / 4 at most; shingles that no other set has fill the first places and need no join. What is common
to very many sets stands last, so a passage shared by many brings sets together only if they are made of little else.
Pairs of one component are skipped before they are made, a shingle's largest component as a whole. Others are made only
if the sets' parity bitmaps allow a link: each shingle flips one bit, so sets differ in at least as many shingles as their
bitmaps in bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgate.llm import blocks
from weirgate.llm.textkernel import U64, lean, mix

#: Shingles that a worker collects before it deals them to partitions.
HELD = 1 << 20


#: Different pairs (16 bytes each) that a worker collects before it passes them on.
PAIRS = 1 << 20
#: 64-bit words of a parity bitmap.
WORDS = 8


def parity(s: np.ndarray) -> np.ndarray:
    """The set's bitmap: bit k is the parity of the number of shingles that hash to it."""
    odd = np.bincount((mix(s ^ U64(0x51ED270B)) % U64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _part(values: np.ndarray, parts: int) -> np.ndarray:
    return (mix(values.view(np.uint64)) % U64(parts)).astype(np.int64)


def _tokens(passed: Callable, parts: int):
    """Packed (token, class, n) at part 0 or more; each class with its bitmap at part -1 - p."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def dealt() -> Iterator[pa.RecordBatch]:
            count = np.array([len(s) for s, _, _ in held])
            token = np.concatenate([s for s, _, _ in held])
            cls = np.array([c for _, c, _ in held], np.int64)
            yield _wide(blocks.deal(_part(token, parts), token=token, **{"class": np.repeat(cls, count)}, n=np.repeat(count, count).astype(np.int32)))
            named = blocks.deal(_part(cls, parts), **{"class": cls}, n=count.astype(np.int32), bits=np.stack([x for _, _, x in held]))
            yield _wide(pa.RecordBatch.from_arrays([pa.array(-1 - np.asarray(named.column("part"))), *named.columns[1:]], named.schema.names))

        for c, s in passed(batches):
            held.append((s, c, parity(s)))
            size += len(s)
            if size > HELD:
                yield from dealt()
                held.clear()
                size = 0
        if held:
            yield from dealt()

    return tokens


_ROWS = ("token", "class", "n", "many", "bits")


def _wide(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with all of ``_ROWS``; columns that it lacks are empty."""
    none = pa.array([b""] * batch.num_rows, pa.binary())
    return pa.RecordBatch.from_arrays([batch.column("part"), *(batch.column(k) if k in batch.schema.names else none for k in _ROWS)], ["part", *_ROWS])


def _counted(parts: int):
    """From whole partitions by shingle: shingles that several sets have, with that count, dealt by class as the bitmaps are."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            named = np.asarray(batch.column("part")) < 0
            if named.any():
                own = batch.filter(pa.array(named))
                yield pa.RecordBatch.from_arrays([pa.array(-1 - np.asarray(own.column("part"))), *own.columns[1:]], own.schema.names)
            held.append(batch.filter(pa.array(~named)))
        token, cls, n = blocks.gather(held, token=np.uint64, **{"class": np.int64}, n=np.int32)
        order = np.argsort(token)
        begin, count = blocks.runs(token[order])
        _, at = blocks.spread(begin[count > 1], count[count > 1])
        order = order[at]
        order = order[np.lexsort((cls[order], token[order]))]
        token, cls, n = token[order], cls[order], n[order]
        own = np.ones(len(token), bool)
        own[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
        token, cls, n = token[own], cls[own], n[own]
        begin, count = blocks.runs(token)
        many = np.repeat(count, count)
        some = many > 1
        if some.any():
            yield _wide(blocks.deal(_part(cls[some], parts), token=token[some], **{"class": cls[some]}, n=n[some], many=many[some].astype(np.int64)))

    return counted


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From whole partitions by class: each set's bitmap, its joinable shingles in order, and the place of the first."""
    batches = list(batches)
    named = [batch.filter(pa.array(blocks.sizes(batch.column("bits"), 1) > 0)) for batch in batches]
    held = [batch.filter(pa.array(blocks.sizes(batch.column("bits"), 1) == 0)) for batch in batches]
    del batches
    names, bits = blocks.gather(named, **{"class": np.int64}, bits=np.uint64)
    names, at = np.unique(names, return_index=True)
    bits = bits.reshape(-1, WORDS)[at]
    token, cls, n, many = blocks.gather(held, token=np.uint64, **{"class": np.int64}, n=np.int32, many=np.int64)
    order = np.lexsort((token, many, cls))
    token, cls, n = token[order], cls[order], n[order].astype(np.int64)
    begin, count = blocks.runs(cls)
    size = n[begin]
    alone = size - count
    take = np.clip(size // 4 + 1 - alone, 0, count)
    begin, alone, size, take = begin[take > 0], alone[take > 0], size[take > 0], take[take > 0]
    for lo, hi in blocks.pieces(take, HELD):
        cut = [token[b : b + t].tobytes() for b, t in zip(begin[lo:hi], take[lo:hi], strict=True)]
        own = cls[begin[lo:hi]]
        maps = [x.tobytes() for x in bits[np.searchsorted(names, own)]]
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(size[lo:hi]), pa.array(alone[lo:hi]), pa.array(cut, pa.binary()), pa.array(maps, pa.binary())], ["class", "n", "first", "tokens", "bits"])


_PLACES = {"token": np.uint64, "who": np.int64, "place": np.int64, "class": np.int64, "root": np.int64, "n": np.int64, "bits": np.uint64}


def _places(parts: int):
    """Packed, by shingle: its places, each with the index in its row's sets; and these sets."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, root, n, first = (np.asarray(batch.column(k)) for k in ("class", "root", "n", "first"))
            token, bits = blocks.entries(batch.column("tokens"), np.uint64), blocks.entries(batch.column("bits"), np.uint64).reshape(-1, WORDS)
            who, place = blocks.spread(first, blocks.sizes(batch.column("tokens"), 8))
            part = _part(token, parts)
            order = np.argsort(part, kind="stable")
            token, who, place, part = token[order], who[order], place[order], part[order]
            own = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (who[1:] != who[:-1]))) if len(part) else np.zeros(0, np.int64)
            # sets are in order in each part, so each takes the next index of its part's row
            index = np.cumsum(np.append(0, (part[1:] != part[:-1]) | (who[1:] != who[:-1]))) if len(part) else own
            begin, count = blocks.runs(part)
            index = index - np.repeat(index[begin], count) if len(part) else index
            near = blocks.deal(part, token=token, who=index, place=place)
            sets = blocks.deal(part[own], **{"class": cls[who[own]]}, root=root[who[own]], n=n[who[own]], bits=bits[who[own]])
            if near.num_rows:
                yield pa.RecordBatch.from_arrays([*near.columns, *sets.columns[1:]], ["part", *_PLACES])

    return places


def _joined(piece: int):
    """From whole partitions by shingle: pairs of sets of different components whose places allow a link."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        token, who, place, cls, root, n, bits = blocks.gather(held, **_PLACES)
        rows = np.concatenate([np.zeros(0, np.int64), *(blocks.sizes(batch.column("token"), 8) for batch in held)])
        sets = np.concatenate([np.zeros(0, np.int64), *(blocks.sizes(batch.column("class"), 8) for batch in held)])
        del held
        who += np.repeat(np.cumsum(sets) - sets, rows)
        bits = bits.reshape(-1, WORDS)
        order = np.lexsort((root[who], token))
        token, who, place = token[order], who[order], place[order]
        cls, root, n = cls[who], root[who], n[who]
        group = np.cumsum(np.append(0, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
        pair = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (root[1:] != root[:-1]))) if len(token) else np.zeros(0, np.int64)
        size = np.diff(np.append(pair, len(token)))
        # of each shingle's components the one with most sets
        by = np.lexsort((-size, group[pair]))
        largest = by[blocks.runs(group[pair][by])[0]] if len(by) else by
        in_largest = np.zeros(len(pair), bool)
        in_largest[largest] = True
        major = np.repeat(in_largest, size)
        key = group << np.int64(32)
        minor, main = (np.flatnonzero(x)[np.argsort((key + n)[x], kind="stable")] for x in (~major, major))
        # limits for the larger set's size: by similarity, and by the smaller one's place
        most = np.minimum(4 * n // 3, (7 * (n - place)) // 3 - n)
        for x, y, strict in ((minor, minor, None), (main, minor, False), (minor, main, True)):
            sizes = (key + n)[y]
            low = np.arange(len(x)) + 1 if strict is None else np.searchsorted(sizes, (key + n)[x], side="right" if strict else "left")
            high = np.searchsorted(sizes, (key + np.maximum(most, 0))[x], side="right")
            count = np.maximum(high - low, 0)
            held: list[np.ndarray] = []
            for lo, hi in blocks.pieces(count, piece):
                which, j = blocks.spread(low[lo:hi], count[lo:hi])
                i, j = x[lo:hi][which], y[j]
                ok = (root[i] != root[j]) & (7 * (n[j] - place[j]) >= 3 * (n[i] + n[j]))
                i, j = i[ok], j[ok]
                apart = np.zeros(len(i), np.int64)
                for w in range(WORDS):
                    apart += np.bitwise_count(bits[who[i], w] ^ bits[who[j], w])
                ok = 7 * apart <= n[i] + n[j]
                i, j = i[ok], j[ok]
                held.append(np.stack([np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j])], axis=1))
                if sum(map(len, held[1:])) > piece:  # sets that share several shingles meet several times
                    held = [_once(held)]
                    if len(held[0]) > PAIRS:
                        yield _pairs(held)
                        held = []
            if held:
                yield _pairs(held)

    return joined


def _once(held: list[np.ndarray]) -> np.ndarray:
    x = np.concatenate(held)
    x = x[np.lexsort((x[:, 1], x[:, 0]))]
    return x[np.append(True, (x[1:] != x[:-1]).any(axis=1))] if len(x) else x


def _pairs(held: list[np.ndarray]) -> pa.RecordBatch:
    x = _once(held)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, k])) for k in (0, 1)], ["a", "b"])


def rare_prefix_pairs(slim: DataFrame, passed: Callable, roots: DataFrame, parts: int, piece: int) -> DataFrame:
    """Pairs (a, b), a < b, of classes of different ``roots`` (node, root) that may link, among the sets that ``passed`` gives."""
    tokens = slim.mapInArrow(lean(_tokens(passed, parts)), blocks.schema(*_ROWS)).repartition(parts, "part")
    counted = tokens.mapInArrow(lean(_counted(parts)), blocks.schema(*_ROWS)).repartition(parts, "part")
    prefixes = counted.mapInArrow(lean(_prefixes), "class long, n long, first long, tokens binary, bits binary")
    rooted = prefixes.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    places = rooted.mapInArrow(lean(_places(parts)), blocks.schema(*_PLACES)).repartition(parts, "part")
    return places.mapInArrow(lean(_joined(piece)), "a long, b long").distinct()

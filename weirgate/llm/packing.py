"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows. A piece goes into the window that it fills best; when none
has room, the fullest is completed with the head of the piece, emitted, and the rest is placed anew. When a
partition ends, its open windows are merged: their pieces run on from one window into the next, so at most one
window is left unfilled. Those leftovers (less than one window for each partition) are merged the same way in
two further rounds, and the very last one is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgate.llm.store import materialize, texts
from weirgate.llm.textkernel import lean

#: Tokens in a window, open windows for each partition, groups in the first merging round, and the id after a document.
LENGTH, OPEN, GROUPS, CLOSING = 2048, 24, 64, 1

_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"

#: (doc_id, start, ids, tokens of its document)
Piece = tuple[int, int, np.ndarray, int]


class Packer:
    """Open windows of one partition. ``emit`` gets (sequence number, pieces) of each window that is full."""

    def __init__(self, length: int, most: int, emit: Callable[[int, list[Piece]], None], first: int = 0):
        self.length, self.most, self.emit = length, most, emit
        self.next = first
        self.windows: dict[int, list[Piece]] = {}
        self.room: dict[int, int] = {}

    def add(self, doc: int, ids: np.ndarray) -> None:
        for at in range(0, len(ids), self.length):
            self.place((doc, at, ids[at : at + self.length], len(ids)))

    def place(self, piece: Piece) -> None:
        doc, start, ids, total = piece
        while len(ids):
            n = len(ids)
            fits = [(r, w) for w, r in self.room.items() if r >= n]
            if fits:
                window = min(fits)[1]
            elif n == self.length or len(self.room) < self.most:
                window = self.next
                self.next += 1
                self.windows[window], self.room[window] = [], self.length
            else:  # the fullest is completed and goes
                window = min((r, w) for w, r in self.room.items())[1]
            part, ids = ids[: self.room[window]], ids[self.room[window] :]
            self.windows[window].append((doc, start, part, total))
            start += len(part)
            self.room[window] -= len(part)
            if not self.room[window]:
                del self.room[window]
                self.emit(window, self.windows.pop(window))

    def finish(self) -> list[Piece]:
        """Merge the open windows; the pieces of the one that stays unfilled."""
        left = [p for w in sorted(self.windows, key=lambda w: (self.room[w], w)) for p in self.windows[w]]
        self.windows, self.room = {}, {}
        return run_on(left, self.length, self._whole)

    def _whole(self, pieces: list[Piece]) -> None:
        self.emit(self.next, pieces)
        self.next += 1


def run_on(pieces: list[Piece], length: int, emit: Callable[[list[Piece]], None]) -> list[Piece]:
    """Lay pieces end to end in windows of ``length``; the pieces of the last, if it isn't full."""
    held: list[Piece] = []
    room = length
    for doc, start, ids, total in pieces:
        while len(ids):
            part, ids = ids[:room], ids[room:]
            held.append((doc, start, part, total))
            start += len(part)
            room -= len(part)
            if not room:
                emit(held)
                held, room = [], length
    return held


class _Rows:
    def __init__(self):
        self.rows: list[tuple] = []

    def window(self, number: int | None, pieces: list[Piece]) -> None:
        """Rows of one window; with no number it's a leftover, whose ids are kept."""
        offset = 0
        for doc, start, ids, total in pieces:
            raw = np.ascontiguousarray(ids, "<u4").tobytes()
            self.rows.append((doc, start, len(ids), zlib.crc32(raw), total, number, offset, raw if number is None else None))
            offset += len(ids)

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [[] for _ in _NAMES]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "ids" else pa.int64()) for c, k in zip(columns, _NAMES, strict=True)], _NAMES)


_ENCODERS: dict[str | None, object] = {}


def _encoder(path: str | None):
    from weirgate.llm.wordbpe import WordBpe

    if path not in _ENCODERS:
        _ENCODERS[path] = WordBpe(path)
    return _ENCODERS[path]


def _pack(path: str | None, length: int, most: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, rows = _encoder(path), _Rows()
        packer = Packer(length, most, rows.window, TaskContext.get().partitionId() << 32)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts = batch.column("text")
            for lo in range(0, len(ids), 512):
                for doc, tokens in zip(ids[lo : lo + 512], encoder.encode([t or "" for t in texts.slice(lo, 512).to_pylist()]), strict=True):
                    packer.add(doc, np.append(tokens, np.uint32(CLOSING)))
                yield rows.batch()
        rows.window(None, packer.finish())
        yield rows.batch()

    return pack


def _merge(length: int, base: int, last: bool):
    """Run the leftovers of a group on into whole windows; in the last round the rest is cut at powers of two."""

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        rows = _Rows()
        number = base + (key[0].as_py() << 32)
        raw = sorted(zip(*(table.column(k).to_pylist() for k in ("part", "offset", "doc_id", "start", "ids", "doc_tokens")), strict=True), key=lambda r: r[:2])
        pieces = [(doc, start, np.frombuffer(ids, "<u4"), total) for _, _, doc, start, ids, total in raw]

        def whole(held: list[Piece]) -> None:
            nonlocal number
            rows.window(number, held)
            number += 1

        left = run_on(pieces, length, whole)
        if last:
            while left:
                size = 1 << (sum(len(p[2]) for p in left).bit_length() - 1)
                done: list[list[Piece]] = []
                rest = run_on(left, size, done.append)
                whole(done[0])
                left = [p for more in done[1:] for p in more] + rest
        elif left:
            rows.window(None, left)
        return pa.Table.from_batches([rows.batch()])

    return merge


def pack_documents(docs: DataFrame, length: int = LENGTH, open_windows: int = OPEN, tokenizer_path: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document gets its ids and a closing id 1, so a null or empty text is one token. Sequences hold
    ``length`` ids, but for at most a few whose length is a power of two. A null doc_id stays null; repeated
    rows are packed each; an empty table gives an empty result; other columns are ignored.
    """
    slim = texts(docs)
    done = materialize(slim.mapInArrow(lean(_pack(tokenizer_path, length, open_windows)), _SCHEMA).withColumn("part", F.spark_partition_id()), "packed")
    out, rest = done.where("sequence_id is not null"), done.where("sequence_id is null")
    first = rest.groupBy(F.pmod("part", F.lit(GROUPS)).cast("long").alias("g")).applyInArrow(_merge(length, 1 << 62, False), _SCHEMA)
    first = materialize(first.withColumn("part", F.spark_partition_id()), "packed")
    last = first.where("sequence_id is null").groupBy(F.lit(0).cast("long").alias("g")).applyInArrow(_merge(length, (1 << 62) + (1 << 61), True), _SCHEMA)
    names = [n for n in _NAMES if n != "ids"]
    return out.select(*names).unionByName(first.where("sequence_id is not null").select(*names)).unionByName(last.select(*names))

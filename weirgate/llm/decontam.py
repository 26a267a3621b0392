"""Benchmark decontamination as a prefix-filtered set join.

Every benchmark window (ten consecutive words, or a whole shorter item) is joined on its necessary prefix
token: the window's rarest word by corpus frequency. Containment must be complete, so a prefix of one token
is enough. A candidate position is kept only if the window fits into the document there (length and position
bounds) and is then verified word by word. The benchmark side is broadcast in blocks of bounded size, one pass
over the documents for each block, so it may be of any size.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgate.llm.store import materialize, small_batches, texts
from weirgate.llm.textkernel import ALNUM, chunks, lean, text_bytes, windows, words

#: Words in a window.
WINDOW = 10
#: Bytes of benchmark text in one broadcast block.
BLOCK_BYTES = 16 << 20


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """Lists of (item_id, text), each of ``block_bytes`` at most (or one item); read one partition at a time."""
    block: list[tuple[str, str]] = []
    size = 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).where("i is not null and t is not null")
    for r in rows.toLocalIterator():
        if block and size + len(r.t) * 4 > block_bytes:
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size += len(r.t) * 4
    if block:
        yield block


class Index:
    """Windows of some benchmark items, looked up by the hash of their rarest word."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        data, off = text_bytes(pa.array([t for _, t in items], pa.string()))
        w = words(data, off, ALNUM)
        self.vocabulary = np.unique(w.hash)
        owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for d, (item, _) in enumerate(items):
            own = [w.word(i) for i in range(w.first[d], w.first[d + 1])]
            for i in range(max(1, len(own) - window + 1) if own else 0):
                owners[tuple(own[i : i + window])].add(item)
        self.windows = list(owners)
        self.items = [sorted(owners[x]) for x in self.windows]

    def order(self, counts: dict[int, int]) -> None:
        """Choose each window's prefix token by ``counts`` (hash -> occurrences in the corpus; none: 0)."""
        flat = b" ".join(b" ".join(x) for x in self.windows)
        all_words = words(np.frombuffer(flat, np.uint8), np.array([0, len(flat)], np.int64), ALNUM)
        sizes = np.array([len(x) for x in self.windows], np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        token, shift, key = [], [], []
        by_size: dict[int, np.ndarray] = {}
        for size in np.unique(sizes).tolist():
            by_size[size] = windows(all_words.hash, np.array([0, len(all_words.hash)]), size)[0]
        for k, size in enumerate(sizes.tolist()):
            own = all_words.hash[begin[k] : begin[k + 1]].tolist()
            at = min(range(size), key=lambda i: (counts.get(own[i], 0), own[i], i))
            token.append(own[at])
            shift.append(at)
            key.append(by_size[size][begin[k]])
        order = np.argsort(np.array(token, np.uint64), kind="stable")
        self.token, self.shift = np.array(token, np.uint64)[order], np.array(shift, np.int64)[order]
        self.size, self.key, self.which = sizes[order], np.array(key, np.uint64)[order], order
        self.tokens, self.begin = np.unique(self.token, return_index=True)
        self.stop = np.append(self.begin[1:], len(self.token))

    def hits(self, w) -> tuple[np.ndarray, np.ndarray]:
        """Verified occurrences: (first word, window number) in the words ``w`` of some documents."""
        if not len(w.hash) or not len(self.tokens):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        slot = np.minimum(np.searchsorted(self.tokens, w.hash), len(self.tokens) - 1)
        at = np.flatnonzero(self.tokens[slot] == w.hash)
        slot = slot[at]
        doc = np.searchsorted(w.first, at, side="right") - 1
        found, which = [], []
        keys = {size: _window_keys(w, size) for size in np.unique(self.size).tolist()}
        fan = self.stop[slot] - self.begin[slot]
        step = 0
        while len(at):  # entry number ``step`` of every position's list
            live = fan > step
            at, slot, doc, fan = at[live], slot[live], doc[live], fan[live]
            entry = self.begin[slot] + step
            step += 1
            start, size = at - self.shift[entry], self.size[entry]
            fits = (start >= w.first[doc]) & (start + size <= w.first[doc + 1])
            s, e, z = start[fits], entry[fits], size[fits]
            for length, key in keys.items():
                same = (z == length) & (key[np.minimum(s, len(key) - 1)] == self.key[e]) if len(key) else np.zeros(len(s), bool)
                found.append(s[same])
                which.append(self.which[e[same]])
        s, k = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found, which))
        exact = [i for i, (a, b) in enumerate(zip(s.tolist(), k.tolist(), strict=True)) if all(w.word(a + j) == x for j, x in enumerate(self.windows[b]))]
        return s[exact], k[exact]


def _window_keys(w, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on; borders are checked by the caller."""
    return windows(w.hash, np.array([0, len(w.hash)]), size)[0]


def _spans(index: Index, w) -> list[tuple[list[tuple[int, int]], list[str]]]:
    """For each document the hit word ranges (merged, relative to the document) and the items that occur."""
    start, which = index.hits(w)
    doc = np.searchsorted(w.first, start, side="right") - 1
    out: list[tuple[list[tuple[int, int]], list[str]]] = [([], []) for _ in range(len(w.first) - 1)]
    for d in np.unique(doc).tolist():
        own = doc == d
        ranges: list[tuple[int, int]] = []
        items: set[str] = set()
        for a, k in sorted(zip((start[own] - w.first[d]).tolist(), which[own].tolist(), strict=True)):
            b = a + len(index.windows[k])
            items.update(index.items[k])
            if ranges and a <= ranges[-1][1]:
                ranges[-1] = (ranges[-1][0], max(b, ranges[-1][1]))
            else:
                ranges.append((a, b))
        out[d] = (ranges, sorted(items))
    return out


def _counts(docs: DataFrame, vocabulary: np.ndarray) -> dict[int, int]:
    """Occurrences in all documents of the words with these hashes (a bounded block's)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        total = np.zeros(len(vocab), np.int64)
        for batch in batches:
            data, off = text_bytes(batch.column(0))
            for lo, hi in chunks(off):
                h = words(data, off[lo : hi + 1], ALNUM).hash
                slot = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
                total += np.bincount(slot[vocab[slot] == h], minlength=len(vocab))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(vocab[seen].view(np.int64)), pa.array(total[seen])], ["h", "n"])

    if not len(vocabulary):
        return {}
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(lean(count), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return {r.h % (1 << 64): r.n for r in rows.collect()}


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, row_hash, n_words, ranges (hit words, merged), items (sorted).

    Null and empty texts have no words and no hits; items that are null or have no word match nothing; with an
    empty benchmark nothing is hit. Repeated rows get the same answer each; other columns are ignored.
    """
    spark = docs.sparkSession
    slim = texts(docs, F.xxhash64("text").alias("row_hash"))
    schema = "doc_id long, row_hash long, n_words long, ranges array<struct<start:long,end:long>>, items array<string>"
    passes = []
    for block in _blocks(benchmark, block_bytes) if benchmark is not None else ():
        index = Index(block, window)
        index.order(_counts(slim, index.vocabulary))
        passes.append(slim.mapInArrow(lean(_scan(spark.sparkContext.broadcast(index))), schema))
    if not passes:
        passes = [slim.mapInArrow(lean(_scan(None)), schema)]
    if len(passes) == 1:
        return passes[0]
    # several blocks: the hit rows of the later passes are merged into those of the first
    keyed = materialize(passes[0].withColumn("copy", F.lit(0)), "contamination")
    merged = keyed
    for more in passes[1:]:
        merged = merged.unionByName(more.where("size(items) > 0").dropDuplicates(["doc_id", "row_hash"]).withColumn("copy", F.lit(1)))
    later = merged.where("copy = 1").groupBy("doc_id", "row_hash").agg(F.flatten(F.collect_list("ranges")).alias("r2"), F.flatten(F.collect_list("items")).alias("i2"))
    later = later.select(F.col("doc_id").alias("d2"), F.col("row_hash").alias("h2"), "r2", "i2")
    both = keyed.join(later, keyed.doc_id.eqNullSafe(later.d2) & (keyed.row_hash == later.h2), "left")
    rows = F.array_sort(F.concat("ranges", F.coalesce("r2", F.array().cast("array<struct<start:long,end:long>>"))))
    fold = F.aggregate(rows, F.array().cast("array<struct<start:long,end:long>>"), lambda x, r: F.when((F.size(x) > 0) & (r.start <= F.element_at(x, -1).end), F.concat(F.slice(x, 1, F.size(x) - 1), F.array(F.struct(F.element_at(x, -1).start.alias("start"), F.greatest(F.element_at(x, -1).end, r.end).alias("end"))))).otherwise(F.concat(x, F.array(r))))
    items = F.array_sort(F.array_distinct(F.concat("items", F.coalesce("i2", F.array().cast("array<string>")))))
    return both.select("doc_id", "row_hash", "n_words", fold.alias("ranges"), items.alias("items"))


def _scan(shared):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_bytes(batch.column("text"))
            n_words: list[int] = []
            found: list[tuple[list[tuple[int, int]], list[str]]] = []
            for lo, hi in chunks(off):
                w = words(data, off[lo : hi + 1], ALNUM, hashes=shared is not None)
                n_words += w.count.tolist()
                found += _spans(shared.value, w) if shared is not None else [([], [])] * (hi - lo)
            ranges = pa.array([[{"start": a, "end": b} for a, b in r] for r, _ in found], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_hash"), pa.array(n_words, pa.int64()), ranges, pa.array([i for _, i in found], pa.list_(pa.string()))], ["doc_id", "row_hash", "n_words", "ranges", "items"])

    return scan


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, with all their columns; nothing is shuffled.

    Null and wordless texts have no window and stay; items without words match nothing, so an empty benchmark keeps every
    row. Repeated rows stay or go together; column names may be any; an empty table gives an empty result.
    """
    slim = docs.select(F.col("text").cast("string").alias("text"))
    for block in _blocks(benchmark, block_bytes):
        index = Index(block, window)
        index.order(_counts(slim, index.vocabulary))
        docs = small_batches(docs).mapInArrow(lean(_keep(docs.sparkSession.sparkContext.broadcast(index))), docs.schema)
    return docs


def _keep(shared):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_bytes(batch.column(batch.schema.get_field_index("text")).cast(pa.string()))
            clean = np.ones(batch.num_rows, bool)
            for lo, hi in chunks(off):
                w = words(data, off[lo : hi + 1], ALNUM)
                start, _ = shared.value.hits(w)
                clean[lo + np.searchsorted(w.first, start, side="right") - 1] = False
            yield batch.filter(pa.array(clean))

    return keep


def sha256_of(items: list[str]) -> str:
    """The digest that the query shows for a list of items."""
    return hashlib.sha256(",".join(items).encode()).hexdigest()

"""Dedup, near dedup, decontamination, packing and LM scoring against brute force on a small, awkward table."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import fixtures
from weirgate.llm import decontam, dedup, graph, lmscore, packing, setjoin, store
from weirgate.llm.textkernel import lower_ascii
from weirgate.llm.wordbpe import WordBpe


@pytest.fixture(scope="module")
def docs(spark):
    return fixtures.documents(spark).repartition(5).cache()


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(t or ""))


def test_exact_dedup(docs):
    rows = fixtures.rows()
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append((-len(r[1] or ""), -1 if r[0] is None else r[0]))
    by = {hashlib.sha256(k.encode()).hexdigest(): (min(v)[1], len(v)) for k, v in groups.items()}
    for counters in (2, 256):
        got = dedup.exact_dedup(docs, counters).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("h")).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (-1 if r.keep_id is None else r.keep_id, r.group_size) == by[r.h]
        assert sum(r.kept for r in got) == len(by)
    kept = dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(by)


def test_misra_gries_keeps_every_frequent_value():
    counts = {}
    for v in [b"a"] * 400 + [bytes([i % 251, i // 251]) for i in range(500)] + [b"b"] * 300:
        counts[v] = counts.get(v, 0) + 1
        if len(counts) > 40:
            counts = dedup.prune(counts, 10)
    assert {b"a", b"b"} <= set(dedup.prune(counts, 10))


def components(rows):
    sets, parent = [], list(range(len(rows)))
    for r in rows:
        w = words(r[1])
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    out, least = Counter(), {}
    for i, r in enumerate(rows):
        key = -1 if r[0] is None else r[0]
        least[find(i)] = min(key, least.get(find(i), key))
    for i, r in enumerate(rows):
        out[(r[0], len(sets[i]), least[find(i)] if sets[i] else r[0])] += 1
    return out


def clusters(seed_words):
    """Chains of near copies, each a step from the one before, and one crowded group."""
    out, k = [], 1000
    for n in (6, 14, 40, 64, 90, 400):
        own = fixtures.prose(n * 7, n + 4, 5000).split()
        for step in range(5):
            out.append((k, " ".join(own), "en", "s", None, True, "x"))
            k += 1
            own = list(own)
            own[(step * 11) % len(own)] = f"step{step}"
    base = fixtures.prose(4711, seed_words, 5000).split()
    for i in range(45):
        own = list(base)
        own[i % len(own)] = f"own{i}"
        out.append((k + i, " ".join(own), "en", "s", None, True, "x"))
    shared = fixtures.prose(815, 58, 5000)
    out += [(k + 100 + i, f"{shared} tail{i} end{i} of{i}", "en", "s", None, True, "x") for i in range(40)]
    out += [(k + 200 + i, f"{shared} {fixtures.prose(900 + i, 30, 5000)}", "en", "s", None, True, "x") for i in range(20)]
    return out


def test_jaccard_components_match_all_pairs(spark, docs):
    for bucket, rows in ((32, fixtures.rows() + clusters(70)), (4, clusters(50))):
        table = spark.createDataFrame(rows, fixtures.SCHEMA).repartition(4)
        got = Counter((r.doc_id, r.n_shingles, None if r.component_id is None else r.component_id) for r in setjoin.jaccard_components(table, bucket=bucket, rows_bytes=1 << 16).collect())
        want = Counter({(d, n, None if c == -1 and d is None else c): v for (d, n, c), v in components(rows).items()})
        assert got == want


def test_one_of_each_component_stays(spark):
    table = spark.createDataFrame(clusters(60), fixtures.SCHEMA)
    kept = setjoin.one_of_each(table)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in components(clusters(60))}


def test_rows_of_one_doc_id_stay_or_go_each_by_its_component(spark):
    one, other = fixtures.prose(1, 80), fixtures.prose(2, 80)
    rows = [(1, one), (7, one + " more"), (7, other), (9, other + " more"), (None, None)]
    kept = setjoin.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([rows[0], rows[2], rows[4]], key=str)


def test_signatures_of_linked_sets_meet():
    r = np.random.default_rng(5)
    for n in [*range(1, 70), 100, 150, 191, 192, 200, 500, 575, 577, 1500]:
        for _ in range(3):
            a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
            drop = int(r.integers(0, n // 4 + 1))
            b = np.unique(np.concatenate([a[drop:], r.integers(0, 2**63, max(0, (n - 4 * drop) // 5), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if not len(b) or 4 * both < 3 * (len(a) + len(b) - both):
                continue
            (x, p), (y, q) = setjoin.signatures(a), setjoin.signatures(b)
            assert len(np.intersect1d(x, y)) >= min(p, q) >= 1, (n, drop, len(b))


def items():
    base = [t for t in fixtures.texts() if t and 20 < len(t) < 4000]
    picks = [" ".join(words(base[k])[k : k + 14]) for k in (1, 3, 6)]
    return [(1, picks[0]), (2, picks[1].upper()), (3, picks[2].replace(" ", ", ")), (4, "one two three"), (5, ""), (6, None), (7, "never seen in any of the texts here at all ok"), (8, "x"), (10, picks[0])]


def hits(text, bench):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(t or ""))
    w, hit, found = find(text), set(), set()
    for item, t in bench:
        own = find(t)
        for k in range(max(1, len(own) - 9) if own else 0):
            win = own[k : k + 10]
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_contamination_matches_brute_force(spark, docs):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    want = Counter()
    for r in fixtures.rows():
        if len(r[1] or "") < 20_000:
            n, h, found = hits(r[1], items())
            want[(r[0], n, h, tuple(found))] += 1
    assert sum(bool(k[2]) for k in want) >= 4
    for size in (1 << 20, 200):
        got = decontam.contamination(docs.where("text is null or length(text) < 20000"), bench, block_bytes=size).collect()
        assert Counter((r.doc_id, r.n_words, sum(x.end - x.start for x in r.ranges), tuple(r["items"])) for r in got) == want
        clean = decontam.clean_documents(docs.where("text is null or length(text) < 20000"), bench, block_bytes=size)
        assert clean.columns == docs.columns and clean.count() == sum(v for k, v in want.items() if not k[2])
    none = decontam.contamination(docs, bench.where("item_id is null")).collect()
    assert len(none) == len(fixtures.rows()) and not any(r["items"] for r in none)


def test_packing_is_an_exact_round_trip(docs):
    bpe = WordBpe().library
    rows = fixtures.rows()
    got = packing.pack_documents(docs, length=256, open_windows=3).collect()
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == 256 or at & (at - 1) == 0
    assert sum(sum(p[1] for p in v) < 256 for v in sequences.values()) <= 8
    pieces = Counter((r.doc_id, r.doc_tokens, r.start, r.length, r.ids_crc32) for r in got)
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r[0]].append(bpe.encode(r[1] or "", add_special_tokens=False).ids + [1])
    for (doc, total, start, length, crc), n in pieces.items():
        fits = [x for x in by_doc[doc] if len(x) == total and zlib.crc32(np.array(x[start : start + length], "<u4").tobytes()) == crc]
        assert len(fits) >= n or len(fits) >= 1
    for doc, texts in by_doc.items():
        assert sum(r.length for r in got if r.doc_id == doc) == sum(map(len, texts))


def test_word_bpe_equals_the_library():
    b = WordBpe()
    texts = ["It's o'clock 'Ss 'REady ''ve x'llama", "İstanbul ſt é̂ 中文", "<|endoftext|> 12³ ½ a1b2", "\x00\x1c\x85\xa0", "a" * 100, *[t or "" for t in fixtures.texts()[:40]]]
    for t, ids in zip(texts, b.encode(texts), strict=True):
        assert ids.tolist() == b.library.encode(t, add_special_tokens=False).ids, t[:60]


def test_word_bpe_gives_added_tokens_as_the_file_does():
    fresh = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["a <|endoftext|> b", "<|startoftext|>x", "<|ENDOFTEXT|> <|endoftext", "é<|endoftext|><|endoftext|> 中", "plain", "<|endoftext|>"]
    got = [ids.tolist() for ids in WordBpe().encode(texts)]
    assert got == [fresh.encode(t, add_special_tokens=False).ids for t in texts] and got[0] == [320, 49407, 321]


def test_word_bpe_takes_every_low_code_point():
    b = WordBpe()
    texts = [t for c in map(chr, range(0x300)) for t in (c, f"a{c}b {c} 1{c}", f"It{c}s")]
    for t, ids in zip(texts, b.encode(texts), strict=True):
        assert ids.tolist() == b.library.encode(t, add_special_tokens=False).ids, ascii(t)


def test_lm_scores(spark, docs):
    rows = [r for r in fixtures.rows() if r[0] is not None and len(r[1] or "") < 20_000]
    table = spark.createDataFrame(rows, fixtures.SCHEMA).repartition(3)
    got = lmscore.score_documents(table, F.col("doc_id") % 3 != 1, block_bytes=4000).collect()
    tokens = lambda t: [*words(t), "\n"]
    counts = Counter(w for r in rows if r[0] % 3 != 1 for w in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    texts = {r[0]: r[1] for r in rows}
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    for r in got:
        t = tokens(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(w in counts for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert r.score < 0
    taught = [r for r in got if r.train and r.n_tokens > 20]
    assert sum(r.score for r in taught) > sum(r.base_score for r in taught)
    untaught = lmscore.score_documents(table, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in untaught)


def test_a_small_filter_leaves_no_ngram_out(spark):
    rows = [(i, fixtures.prose(i, 300, 900)) for i in range(24)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    whole, cut = ({r.doc_id: r for r in lmscore.score_documents(table, F.col("doc_id") % 3 != 1, block_bytes=4000, max_filter_bytes=size).collect()} for size in (64 << 20, 128))
    tokens = lambda t: [*words(t), "\n"]
    taught = [tokens(t) for i, t in rows if i % 3 != 1]
    one, two = Counter(w for t in taught for w in t), Counter(p for t in taught for p in zip(t, t[1:], strict=False))
    n, v = sum(one.values()), len(one)
    middle = lambda c: lmscore._expected(64)[int(c).bit_length()]
    weight = min(0.9, max(0.05, 1 - sum(c == 1 for c in two.values()) / sum(two.values())))
    for i, t in rows:
        t, want = tokens(t), 0.0
        for k, w in enumerate(t):
            p = (middle(one[w]) + 1) / (n + v + 1)
            left = middle(one[t[k - 1]]) if k else 0
            want += math.log10((1 - weight) * p + weight * min(middle(two[t[k - 1], w]), left, middle(one[w])) / left if left else p)
        # false positives of the filter are rare and only add to counts
        assert math.isclose(whole[i].score, want, rel_tol=0.03) and math.isclose(cut[i].score, want, rel_tol=0.03), (i, whole[i].score, cut[i].score, want)


def test_filter_never_underestimates_and_keeps_errors_rare():
    keys = lmscore.mix(np.arange(20_000, dtype=np.uint64))
    counts = np.minimum(1 + np.arange(20_000) % 90, 70)
    bits = np.zeros(1 << 19, np.uint8)
    for q in range(1, 8):
        for slot in lmscore.Filter.slots(keys[lmscore.levels_of(counts) >= q], q, 1 << 19):
            bits[slot] = 1
    f = lmscore.Filter(0, 1 << 19, 7, 1, 1, 1, 0.5, np.packbits(bits, bitorder="little"))
    assert (f.counts(keys) >= f.expected[lmscore.levels_of(counts)] - 1e-9).all()
    assert (f.counts(lmscore.mix(np.arange(10**6, 10**6 + 20_000, dtype=np.uint64))) > 0).mean() < 0.15


def test_runs_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        keys = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        counts = r.integers(0, 5000, len(keys))
        k, c = lmscore.read_runs(lmscore.sorted_runs(keys, counts))
        assert (k == keys).all() and (c == counts).all()


def test_empty_tables(spark):
    empty = fixtures.empty(spark)
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert dedup.exact_dedup(empty).count() == 0
    assert setjoin.jaccard_components(empty).count() == 0
    assert packing.pack_documents(empty).count() == 0
    assert decontam.contamination(empty, bench).count() == 0
    assert lmscore.score_documents(empty, F.lit(True)).count() == 0


def test_components_by_one_task_and_by_all(spark):
    r = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 900, (600, 2))] + [(k, k + 1) for k in range(2000, 2100)] + [(5000, k) for k in range(5001, 5090)] + [(7, 7), (None, 3)]
    table = spark.createDataFrame(edges, "a long, b long").repartition(4)
    parent = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    want = {x: find(x) for x in parent}
    for most in (0, 1 << 20):
        assert {r.node: r.root for r in graph.components(table, most).collect()} == want
    assert graph.components(table.limit(0), 0).collect() == graph.components(table.limit(0)).collect() == []
    half, rest = table.where("pmod(xxhash64(a, b), 2) = 0"), table.where("pmod(xxhash64(a, b), 2) = 1")
    merged = graph.merge_components(graph.components(half), rest)
    assert {r.node: r.root for r in merged.collect()} == want


CLASHING = "doc_id int, text string, hash_of_row string, KEY_of_row int, text_of_row int, mark_of_row boolean, _hash int, stays int, `a.b` int, uid int"


def clashing(spark):
    near = fixtures.prose(11, 60)
    texts = ["same text here", "same  text here ", near, near + " more", None, "", "one word more", "one word more", "!!!"]
    ids = [3, 4, 5, 6, 7, 8, 9, 9, None]
    rows = [(i, t, f"h{k}", k, k, True, k, k, k, k) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, CLASHING).repartition(3), rows


def test_kept_rows_come_whole_whatever_their_columns_are_called(spark):
    table, rows = clashing(spark)
    for kept, want in ((dedup.drop_copies(table), {"h1", "h2", "h3", "h4", "h8"}), (setjoin.one_of_each(table), {"h0", "h2", "h4", "h5", "h8"})):
        assert kept.columns == table.columns
        got = [tuple(r) for r in kept.collect()]
        assert set(got) <= set(rows) and len(got) == len(want) + 1  # and one of the repeated rows
        assert {r[2] for r in got} - {"h6", "h7"} == want


def test_rows_are_kept_alike_by_broadcast_and_by_shuffle(spark):
    hot = [(1, "hot", k) for k in range(300)] + [(k, f"t{k % 40}", k) for k in range(2, 90)] + [(None, None, 0), (None, None, 1)]
    table = spark.createDataFrame(hot, "doc_id long, text string, extra int").repartition(4)
    decided = table.select("doc_id", store.row_hash().alias("row_hash"), (F.coalesce("doc_id", F.lit(0)) % 3 != 2).alias("stays"))
    few, many = (sorted(map(tuple, store.keep_rows(table, decided, most).collect()), key=str) for most in (1 << 20, 0))
    assert few == many
    assert sorted((r[0] or 0, r[1] or "") for r in few) == sorted({(d or 0, t or "") for d, t, _ in hot if (d or 0) % 3 != 2})


def test_crowded_groups_match_all_pairs(spark):
    base, passage = fixtures.prose(21, 90, 4000).split(), fixtures.prose(22, 60, 4000)
    rows = []
    for i in range(160):  # from near copies to loose ones
        own = list(base)
        for j in range(i // 16):
            own[(i * 7 + j * 9) % 90] = f"edit{i}x{j}"
        rows.append((i, " ".join(own[: 90 - (i % 5) * 4]), "en", "s", None, True, "x"))
    rows += [(1000 + i, f"{passage} {fixtures.prose(500 + i, 14 + i % 30, 4000)}", "en", "s", None, True, "x") for i in range(120)]
    table = spark.createDataFrame(rows, fixtures.SCHEMA).repartition(5)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in setjoin.jaccard_components(table, bucket=8, rows_bytes=1 << 15).collect())
    assert got == components(rows)


def shuffled_bytes(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_sets_are_dealt_once_to_be_verified(spark):
    hub = fixtures.prose(31, 400, 5000).split()
    texts = [" ".join(w if j != 9 + 5 * (i % 40) else f"edit{i}" for j, w in enumerate(hub)) for i in range(80)]  # one class has very many pairs
    texts += [fixtures.prose(600 + i // 4, 400, 5000) + f" tail{i}" for i in range(240)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    table = store.materialize(table, "texts")
    sets = {i: setjoin.shingle_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] for i, t in enumerate(texts)}
    pairs = [(0, i) for i in range(1, 80)] + [(i - i % 4, i) for i in range(80, 320) if i % 4] + [(1, 100), (90, 200)]
    names = {i: setjoin.set_class(s) for i, s in sets.items()}
    first = store.materialize(spark.createDataFrame([(names[i], i) for i in names], "class long, doc_id long"), "first")
    given = store.materialize(spark.createDataFrame([(min(names[i], names[j]), max(names[i], names[j])) for i, j in pairs], "a long, b long"), "pairs")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled_bytes(spark)
        got = {tuple(r) for r in setjoin._Documents(table, first, 75).links(given).collect()}
        moved = shuffled_bytes(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    linked = lambda x, y: 4 * (both := len(np.intersect1d(x, y))) >= 3 * (len(x) + len(y) - both)
    assert got == {(min(names[i], names[j]), max(names[i], names[j])) for i, j in pairs if linked(sets[i], sets[j])} and len(got) == len(pairs) - 2
    # a short and a whole set (10 bytes a shingle) once for its class and about once for its pair
    assert moved < 2.2 * 10 * sum(map(len, sets.values()))


def test_empty_tables_of_filters(spark):
    empty = fixtures.empty(spark)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert dedup.drop_copies(empty).collect() == setjoin.one_of_each(empty).collect() == decontam.clean_documents(empty, bench).collect() == []
    table, rows = clashing(spark)
    assert decontam.clean_documents(table, bench).count() == len(rows)

"""Hard negatives, packing and resampling against brute force, on odd rows and on the smallest driver tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafgraph.llm import hard_negatives, packing, queries, resampling, segments
from leafgraph.llm.texts import blocks
from tests.llm.test_documents import CLASHING, LOWER, _sorted, _texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(_texts(), "doc_id long, text string")
    return df.withColumns({c: F.lit(7) for c in CLASHING + ["rank", "part", "length", "n_words", "_at", "bucket"]}).repartition(3)


# ---- stretches

PARTS = ["a", "B", "é", "1", ",", ".", "'", "'s", "'ll", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", " ", "　",
         "日", "…", "\x1c", "\x85", "\0", "-", "🙂", " the", " don't", "²", "​", "﻿"]


def test_stretches_are_encoded_as_whole_texts():
    rng = random.Random(3)
    own = segments.TextEncoder(public_tokenizers.path("byte_bpe_50k.json"), room=2000)
    for extra in ([], ["<|endoftext|>"]):
        for _ in range(60):
            texts = ["".join(rng.choice(PARTS + extra) for _ in range(rng.randint(0, 40))) for _ in range(20)] + [None, ""]
            for first, end, offsets, data in blocks(pa.array(texts), 300):
                ids, at = own.encode(offsets, data)
                for i, text in enumerate(texts[first:end]):
                    assert ids[at[i]:at[i + 1]].tolist() == own.tokenizer.encode(text or "", add_special_tokens=False).ids


# ---- packing

def test_best_fit_equals_the_plain_one():
    rng = random.Random(2)
    for _ in range(200):
        capacity = rng.choice([10, 30, 100])
        counts = collections.Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 150)))
        rooms: list[int] = []
        for length in sorted(counts.elements(), reverse=True):
            fit = min((r for r in rooms if r >= length), default=None)
            if fit is not None:
                rooms.remove(fit)
            rooms.append((capacity if fit is None else fit) - length)
        assert sum(packing.best_fit(counts, capacity).values()) == len(rooms)


def test_search_keeps_all_pieces_and_empties_bins():
    rng = random.Random(4)
    saved = 0
    for _ in range(100):
        counts = collections.Counter(rng.randint(20, 45) for _ in range(rng.randint(1, 3000)))
        before = packing.best_fit(counts, 100)
        after = packing.improve(before, 100)
        held = collections.Counter()
        for pattern, n in after.items():
            assert n > 0 and 0 < packing.fill_of(pattern) <= 100
            for length, k in pattern:
                held[length] += k * n
        assert held == counts

        def squares(bins):
            return sum(n * packing.fill_of(p) ** 2 for p, n in bins.items())
        assert squares(after) >= squares(before) and sum(after.values()) <= sum(before.values())
        saved += sum(before.values()) - sum(after.values())
    assert saved > 0


def test_each_kind_of_exchange():
    for giver, taker, gain, out, back in (((4, 3), (6,), 4, (4,), ()),           # one moves
                                          ((4, 1), (6, 2), 2, (4,), (2,)),       # one for one
                                          ((2, 2), (6, 3), 1, (2, 2), (3,)),     # two for one
                                          ((5,), (5, 2, 2), 1, (5,), (2, 2)),    # one for two
                                          ((8,), (7, 3), None, (), ()), ((9,), (5,), None, (), ())):
        one, two = (packing._Parts.of(tuple(sorted(collections.Counter(p).items(), reverse=True))) for p in (giver, taker))
        assert packing._exchange(one, two, 10) == ((gain, out, back) if gain else None)


def _packed(rows, texts, capacity, end_id):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end_id]
        cuts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)]
        want += [(i, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert _sorted(tuple(r)[:5] for r in rows) == _sorted(want)
    places = collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places), -(-sum(w[3] for w in want) // capacity)


def test_packing(spark, odd, folder):
    for capacity in (1024, 16):
        _packed(packing.pack_documents(odd, capacity).collect(), _texts(), capacity, 2)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    used, least = _packed(queries.QUERIES["op12_best_fit_packing"](spark, folder).collect(),
                          [tuple(r) for r in docs.select("doc_id", "text").collect()], 1024, 2)
    assert used <= least * 1.02 + 1
    assert packing.pack_documents(odd.filter("false")).collect() == []


# ---- resampling

def _drawn(docs, target, min_words=20):
    def features(text):
        words = WORD.findall((text or "").translate(LOWER))
        return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    s, t = collections.Counter(), collections.Counter()
    for texts, count in ((docs, s), (target, t)):
        for _, text in texts:
            count.update(zlib.crc32(f.encode()) % 10000 for f in features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    rows, able = [], []
    for i, text in docs:
        n, found = features(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
                 for b in (zlib.crc32(f.encode()) % 10000 for f in found)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(found), weight, score, None])
        if n >= min_words:
            able.append(rows[-1])
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[:25 * len(able) // 100]):
        r[4] = k + 1
    return _sorted(tuple(r) for r in rows)


def test_resampling(spark, odd, folder):
    target = [(0, "One word of the target"), (1, None), (2, "x" * 60 + " " + "y" * 100 + " É 日本")]
    items = spark.createDataFrame(target, "item_id long, text string")
    for docs in (odd, odd.unionAll(odd.filter("doc_id in (1, 10, 12)")).unionAll(odd)):
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        assert _sorted(tuple(r) for r in resampling.resample(docs, items).collect()) == _drawn(rows, target)
    assert resampling.resample(odd.filter("false"), items).collect() == []
    assert len(resampling.resample(odd, items.filter("false")).collect()) == len(_texts())
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    got = queries.QUERIES["op13_target_resampling"](spark, folder).collect()
    assert _sorted(tuple(r) for r in got) == _drawn([tuple(r) for r in docs.select("doc_id", "text").collect()],
                                                    [tuple(r) for r in items.collect()])


def test_crcs_of_long_words():
    rng = random.Random(6)
    texts = [" ".join(rng.choice("aé日Z9") * rng.randint(1, 70) for _ in range(rng.randint(0, 9))) for _ in range(50)] + [None]
    for _, _, offsets, data in blocks(pa.array(texts)):
        bucket, rows, n = resampling.feature_buckets(offsets, data, 10000)
        for i, text in enumerate(texts):
            words = WORD.findall((text or "").translate(LOWER))
            found = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
            assert n[i] == len(words)
            assert sorted(bucket[rows == i].tolist()) == sorted(zlib.crc32(f.encode()) % 10000 for f in found)


def test_selected_key_is_exact(spark):
    rng = random.Random(9)
    rows = [(rng.randint(0, 6), rng.randint(-3, 3)) for _ in range(400)]
    keys = spark.createDataFrame(rows, "a long, b long").repartition(7)
    for n in (1, 2, 57, 200, 399, 400):
        assert resampling.select_key(keys, n) == sorted(rows)[n - 1]
    assert resampling.select_key(keys, 0) is None and resampling.select_key(keys, 401) is None


# ---- hard negatives

def _mined(rows, share=(80, 100), k=5):
    able = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows
            if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]

    def dot(p, q):
        return sum(x * y for x, y in zip(p, q))
    out, asked = [], set()
    for i, label, q in able:
        if i % 100 or (i, label, tuple(q)) in asked:
            continue
        asked.add((i, label, tuple(q)))
        scored = sorted((-dot(q, p), j, other) for j, other, p in able)
        for score, j, _ in [s for s in scored if s[2] == label and s[1] != i][:k]:
            inside = [(-s, n) for s, n, other in scored if other != label and share[0] * -score <= share[1] * -s <= share[1] * -score]
            out += [(i, j, rank + 1, n, -score, s) for rank, (s, n) in enumerate(inside[:k])]
    return _sorted(out)


def _vectors(rng, n, dims, spread):
    return [(i, [rng.uniform(-spread, spread) for _ in range(dims)], rng.randint(0, 2)) for i in range(n)]


@pytest.mark.parametrize("spread", [0.004, 0.02, 1.0])
def test_hard_negatives(spark, monkeypatch, spread):
    """Coarse vectors give many ties; small blocks and steps make several of each."""
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    monkeypatch.setattr(hard_negatives, "CANDIDATES", 60)
    monkeypatch.setattr(hard_negatives, "FIRST_DEPTH", 4)
    rng = random.Random(5)
    rows = [(i * 25, v, label) for i, v, label in _vectors(rng, 300, 6, spread)]
    rows += [rows[8], rows[9], (None, [0.1] * 6, 1), (100, None, 1), (200, [0.1] * 6, None), (300, [None] + [0.1] * 5, 0),
             (400, [math.nan] + [0.1] * 5, 0), (500, [math.inf] + [0.1] * 5, 0), (600, [], 0), (700, [0.5], 1), (800, [0.0] * 6, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns(
        {c: F.lit(7) for c in ("q", "rank", "score", "p", "window", "anchor_no", "_a", "_c", "tops", "n")}).repartition(4)
    got = hard_negatives.hard_negatives(df, lambda i: i % 100 == 0).collect()
    assert _sorted(tuple(r) for r in got) == _mined(rows)
    assert hard_negatives.hard_negatives(df.filter("false"), lambda i: i % 100 == 0).collect() == []


def test_search_stops_early():
    """Rows that lie along one direction: only the first steps are read, and the hits are those of a full scan."""
    rng = np.random.default_rng(1)
    line = np.sort(rng.integers(-2000, 2000, 5000))[:, None] * np.ones(8, np.int64)
    lists = hard_negatives.SortedLists(line.astype(float) + rng.integers(0, 3, line.shape))
    anchor, ids = np.ones(8) * 3, np.arange(5000)
    reads = []
    met = lists.met
    lists.met = lambda *a: reads.append(len(r := met(*a))) or r
    (rows, scores), = lists.search(anchor, lists.thresholds(anchor[None])[0], ids, np.ones(5000, bool), np.array([1 << 60]),
                                   np.array([-(1 << 60)]), 5)
    full = (lists.vectors @ anchor).astype(int)
    assert list(zip(scores, rows)) == sorted(zip(full, ids), key=lambda x: (-x[0], x[1]))[:5]
    assert sum(reads) < 500


def test_hard_negatives_equal_sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = queries.QUERIES["op11_hard_negatives"](spark, folder).select(names).collect()
    assert got and _sorted(tuple(r) for r in got) == _sorted(con.execute(queries.NEGATIVES_SQL).fetchall())

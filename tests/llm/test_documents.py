"""Document operators against brute force, on a small table of odd rows and on the smallest driver table."""

import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from leafgraph.llm import (byte_bpe, fingerprints, paragraphs, phrase_index, set_join, suffix_repeats, token_files,
                           weak_labels)
from leafgraph.session import work_dir

#: Names that the operators use inside; columns of these names must not disturb them.
CLASHING = ("id size a b hist sig sigs x y key pos term h n keep score posterior spans tokens class component pivot places "
            "doc gram context begin phrase head").split()
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _sentence(rng, n):
    return " ".join("".join(rng.choice("aeiountrs") for _ in range(rng.randint(1, 7))) for _ in range(n)).capitalize() + "."


def _texts():
    rng = random.Random(5)
    passage = " ".join(_sentence(rng, 9) for _ in range(8))
    base = "\n".join(" ".join(_sentence(rng, 8) for _ in range(5)) for _ in range(4))
    near = base.replace(base.split(" ")[40], "changed", 1)
    return [
        (1, base), (2, base), (3, near), (3, near), (4, None), (5, ""), (6, " \n\t "), (7, "One"), (8, "one"),
        (9, "x" * 1500), (10, " ".join(_sentence(rng, 12) for _ in range(6)) + " Word " + passage + " tail"),
        (11, _sentence(rng, 30) + " lead " + passage + " " + _sentence(rng, 20)), (12, _sentence(rng, 60_000)),
        (None, base), (None, None), (13, "ünïcödé 日本語 テキスト 🙂 " * 30), (14, "two  blanks\n\n and\tmore "),
        (15, _sentence(rng, 40)), (16, "A A " + "é" * 300), (17, "### $$$ *** " * 40), (18, "word.\n" * 50),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in _texts()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(7) for c in CLASHING}).repartition(3)


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.filter("false")


def _sorted(rows):
    return sorted(rows, key=repr)


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


# ---- n-gram join

def _components(rows, n, p, q):
    sets = []
    for i, text in rows:
        w = _words(text)
        sets.append((i, {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()))
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and q * len(s & t) >= p * len(s | t):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return _sorted((i, len(s), find(i) if i is not None else None) for i, s in sets)


def test_join_is_exact(odd, nothing):
    got = [tuple(r) for r in set_join.join_similar(odd).collect()]
    assert _sorted(got) == _components(_texts(), 4, 85, 100)
    assert set_join.join_similar(nothing).collect() == []


def test_join_in_small_blocks(spark, monkeypatch):
    """A group of many near copies that aren't all near each other, cut into blocks of three."""
    from leafgraph.llm import similar

    monkeypatch.setattr(similar, "BLOCK_ITEMS", 3)
    rng = random.Random(15)
    base = _sentence(rng, 120).split(" ")
    rows = []
    for k in range(40):
        words = list(base)
        for place in rng.sample(range(120), rng.randint(0, 5)):
            words[place] = f"changed{rng.randint(0, 9)}"
        rows.append((k, " ".join(words)))
    got = [tuple(r) for r in set_join.join_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    want = _components(rows, 4, 85, 100)
    assert _sorted(got) == want and len({c for _, _, c in want}) > 1


def test_near_copies_are_merged_before_all_pairs(spark, monkeypatch):
    """The first item of a large group is like no other, and the others are near each other: few of their pairs are verified."""
    rng = random.Random(21)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for k in range(150):
        words = list(base)
        for place in rng.sample(range(100), 5 if k else 10):
            words[place] = f"own{k}x{place}"
        rows.append((k, " ".join(words)))
    rows.append((150, " ".join(base[:60] + [f"far{i}" for i in range(40)])))
    tried, verified = [], set_join.verified

    def counted(documents, pairs, n, share):
        tried.append(pairs.count())
        return verified(documents, pairs, n, share)
    monkeypatch.setattr(set_join, "verified", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in set_join.join_similar(docs, n=1, share=(80, 100)).collect()]
    want = _components(rows, 1, 80, 100)
    assert _sorted(got) == want and {c for _, _, c in want} == {0, 1, 150}
    assert sum(tried) < 3000  # of 11026 pairs without rounds


def test_join_over_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = [tuple(r) for r in set_join.join_similar(docs.repartition(7)).collect()]
    assert _sorted(got) == _components(rows, 4, 85, 100)


def test_rows_without_id_hide_no_links(spark):
    rng = random.Random(8)
    base = _sentence(rng, 100)
    rows = [(None, base), (4, base), (None, base), (5, base + " more"), (6, _sentence(rng, 50))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = [tuple(r) for r in set_join.join_similar(docs).collect()]
    assert _sorted(got) == _components(rows, 4, 85, 100)
    assert {r[2] for r in got if r[0] == 5} == {4}


def test_signatures_never_miss_a_pair():
    rng = np.random.default_rng(3)
    for size in (1, 2, 5, 7, 20, 60, 150, 400):
        for _ in range(20):
            s = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            k = rng.integers(0, int(size * 0.17) + 1)
            t = np.concatenate([s[rng.integers(0, k + 1):], rng.integers(0, 1 << 63, int(rng.integers(0, k + 1)), np.uint64)])
            s, t = np.unique(s), np.unique(t)
            common = len(np.intersect1d(s, t))
            if 100 * common >= 85 * (len(s) + len(t) - common):
                hashes, rows = np.concatenate([s, t]), np.repeat([0, 1], [len(s), len(t)])
                one, two = set_join.signatures(hashes, rows, 2, (85, 100))
                assert len(np.intersect1d(one, two))


# ---- suffix array

def _strings(rows, length=200):
    raws = [(t or "").encode() for _, t in rows]
    count = collections.Counter(r[k:k + length] for r in raws for k in range(len(r) - length + 1))
    out = []
    for (i, _), r in zip(rows, raws):
        gone = bytearray(len(r))
        for k in range(len(r) - length + 1):
            if count[r[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(r), sum(gone), runs, bytes(c for c, g in zip(r, gone) if not g)))
    return _sorted(out)


def test_suffix_repeats(odd, nothing):
    rows = [(i, t) for i, t in _texts() if i != 12] + [(12, dict(_texts())[12][:30_000])]
    short = odd.withColumn("text", F.when(F.col("doc_id") == 12, F.substring("text", 1, 30_000)).otherwise(F.col("text")))
    got = [(r[0], r[1], r[2], r[3], bytes(r[4])) for r in suffix_repeats.remove_repeats(short).collect()]
    assert _sorted(got) == _strings(rows)
    assert suffix_repeats.remove_repeats(nothing).collect() == []


def test_suffix_repeats_with_large_groups(odd, monkeypatch):
    """The exact way for grams with many contexts gives the same result."""
    few = odd.filter("doc_id <> 12 or doc_id is null")
    monkeypatch.setattr(suffix_repeats.repeat_coverage, "__defaults__", (1,))
    got = [(r[0], r[1], r[2], r[3], bytes(r[4])) for r in suffix_repeats.remove_repeats(few).collect()]
    assert _sorted(got) == _strings([(i, t) for i, t in _texts() if i != 12])


def test_stack_scan_finds_every_maximal_repeat():
    rng = random.Random(1)
    for _ in range(60):
        texts = list({"".join(rng.choice("ab") for _ in range(rng.randint(4, 14))): 0 for _ in range(6)})
        cut = [rng.randint(0, len(t)) for t in texts]
        lefts, rights = [t[:c].encode() for t, c in zip(texts, cut)], [t[c:].encode() for t, c in zip(texts, cut)]
        pairs = list(dict.fromkeys(zip(lefts, rights)))
        lefts, rights = [p[0] for p in pairs], [p[1] for p in pairs]
        want = set()
        for i in range(len(pairs)):
            for j in range(i):
                d = suffix_repeats.common_prefix(rights[i], rights[j])
                e = suffix_repeats.common_prefix(lefts[i][::-1], lefts[j][::-1])
                if d and d + e >= 3:
                    group = tuple(k for k in range(len(pairs)) if rights[k].startswith(rights[i][:d])
                                  and lefts[k].endswith(lefts[i][len(lefts[i]) - e:]))
                    want.add((e, d, group))
        got = {(e, d, tuple(sorted(g))) for e, d, g in suffix_repeats.maximal_repeats(lefts, rights, 3)}
        assert got == want


# ---- fingerprints

def test_fingerprints(odd, nothing):
    rows = fingerprints.edited_fingerprints(odd).collect()
    texts = _sorted({(i, t or "") for i, t in _texts()})
    assert len(rows) == len(_texts())
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    order = sorted({i for i, _ in texts if i is not None}, reverse=True)
    text = {i: t for i, t in texts if i is not None}
    for i, j in zip(order[:-1], order[1:]):
        n = len(text[i]) // 3
        for r in by[i]:
            assert r.n_chars == len(text[i]) and r.edited == text[i][:len(text[i]) - n] + text[j][:n]
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert {tuple(r.fingerprint) for r in by[1]} == {tuple(r.fingerprint) for r in by[2]}
    assert fingerprints.edited_fingerprints(nothing).collect() == []
    one = odd.filter("doc_id = 7")
    assert [r.edited for r in fingerprints.edited_fingerprints(one).collect()] == ["OnO"]


def test_order_of_many_ids(spark):
    """Ids that lie far apart, negative ones and null among them; texts and likeness are those of the next document."""
    rng = random.Random(44)
    rows = [(rng.randint(-(1 << 62), 1 << 62), " ".join(_sentence(rng, 3) for _ in range(3))) for _ in range(300)]
    rows += [(k, f"text {k}") for k in range(40)] + [(None, "none")]
    got = fingerprints.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = {}
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        n = len(text) // 3
        want[i] = text[:len(text) - n] + after[:n]
    assert {r.doc_id: r.edited for r in got} == want and len(got) == len(rows)


def test_likeness_follows_the_exact_one(spark):
    rng = random.Random(45)
    words = [f"piece {k}" for k in range(400)]
    pairs = []
    for _ in range(150):
        common = rng.sample(words, rng.randint(0, 20))
        pairs.append(tuple("\n".join(common + rng.sample(words, rng.randint(1, 20))) for _ in "ab"))
    f = [fingerprints.fingerprint(F.col(c)) for c in "ab"]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", fingerprints.likeness(*f).alias("x")).collect()
    errors = []
    for r in got:
        a, b = (collections.Counter(t.split("\n")) for t in (r.a, r.b))
        errors.append(r.x - 2 * sum(a[k] * b[k] for k in a) / (sum(v * v for v in a.values()) + sum(v * v for v in b.values())))
    assert max(map(abs, errors)) < 0.35 and (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.12


def test_fingerprints_are_homomorphic(spark):
    df = spark.createDataFrame([("a\nb\nc", "c\na\nb", "a\nb", "c", "x\ny")], "p string, q string, r string, s string, t string")
    f = {c: fingerprints.fingerprint(F.col(c)) for c in "pqrst"}
    row = df.select((f["p"] == f["q"]).alias("order"), (fingerprints.plus(f["r"], f["s"]) == f["p"]).alias("insert"),
                    (fingerprints.minus(f["p"], f["s"]) == f["r"]).alias("delete"), (f["p"] == f["r"]).alias("differ"),
                    fingerprints.likeness(f["p"], f["r"]).alias("near"), fingerprints.likeness(f["p"], f["t"]).alias("far"),
                    f["p"].alias("p")).first()
    assert row["order"] and row["insert"] and row["delete"] and not row["differ"]
    assert 0.55 < row["near"] and row["far"] < 0.45
    assert len(set(row["p"][:4])) == 4  # each word has a hash of its own


# ---- token files and byte-level BPE

def test_token_files(spark, odd, nothing):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    folder = work_dir(spark, "tokens")
    token_files.write_token_files(odd, folder, width=2, parts=3)
    rows = token_files.read_token_files(spark, folder, width=2).orderBy("start").collect()
    expected = sorted(((i, t or "") for i, t in _texts()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [r.doc_id for r in rows] == [i for i, _ in expected]
    start = 0
    for r, (_, text) in zip(rows, expected):
        ids = reference.encode(text, add_special_tokens=False).ids + [0]
        assert (r.start, r.n_tokens) == (start, len(ids))
        assert np.frombuffer(r.ids, "<u2").tolist() == ids
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes())
        start += len(ids)
    empty = work_dir(spark, "tokens")
    token_files.write_token_files(nothing, empty, width=4)
    assert token_files.read_token_files(spark, empty).collect() == []
    with pytest.raises(ValueError, match="fit 2 bytes"):
        token_files.write_token_files(odd, work_dir(spark, "tokens"), end_id=70_000, width=2)


def test_special_tokens_in_texts(spark):
    from tokenizers import Tokenizer

    texts = ["one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|>b <|endoftext|", "one two", " <|endoftext|>\n x ", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for as_text in (False, True):
        reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        reference.encode_special_tokens = as_text
        folder = work_dir(spark, "tokens")
        if as_text:
            token_files.write_token_files(docs, folder, width=2, special_as_text=True)
        else:
            token_files.write_token_files(docs, folder, width=2)
        rows = token_files.read_token_files(spark, folder, width=2).orderBy("doc_id").collect()
        want = [reference.encode(t, add_special_tokens=False).ids + [0] for t in texts]
        assert [np.frombuffer(r.ids, "<u2").tolist() for r in rows] == want
        assert (50256 in want[0]) != as_text


def test_byte_bpe(odd, nothing):
    import tiktoken

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = _sorted((r[0], bytes(r[1]), bytes(r[2])) for r in byte_bpe.encode_documents(odd).collect())
    assert got == _sorted((i, np.array(own.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode())
                          for i, t in _texts())
    assert byte_bpe.encode_documents(nothing).collect() == []
    codec = byte_bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(9)
    parts = ["a", "th", " ", "  ", "\n", "é", "日本", "🙂", "12", "'s", "!", "\t", "　", "²", "<|endoftext|>", "\x1c", "᠎"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert codec.encode(text) == np.array(own.encode_ordinary(text), "<u4").tobytes()


# ---- phrases

def _hits(rows, items, window=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    phrases = collections.defaultdict(set)
    for item, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            phrases[tuple(w[k:k + window])].add(item)
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for p, owners in phrases.items():
            for k in range(len(w) - len(p) + 1):
                if i is not None and tuple(w[k:k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    found |= owners
        out.append((i, len(w), len(hit), len(found), tuple(sorted(map(str, found))), bool(hit)))
    return _sorted(out)


def test_phrases(spark, odd, nothing):
    texts = dict(_texts())
    items = [(1, " ".join(texts[10].split()[70:100])), (2, texts[10].split(" Word ")[1][:120].upper()), (3, None), (4, "?!"),
             (11, "ONE"), (12, "one"), (5, "nowhere to be found in any of these texts at all, not once"),
             (6, "Wor")] + [(20, "word word word word word word word word word word word")]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit(1)).withColumn("w", F.lit(1))
    got = phrase_index.contamination(odd, table)
    assert _sorted((*r[:4], tuple(r[4]), r[5]) for r in got.collect()) == _hits(_texts(), items)
    assert phrase_index.contamination(nothing, table).collect() == []
    assert not [r for r in phrase_index.contamination(odd, table.filter("false")).collect() if r.contaminated]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha x beta gamma"), (3, "alpha x x x x x beta gamma")],
                                 "doc_id long, text string")
    wanted = phrase_index.phrases(spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string"))
    exact = {r.doc_id for r in phrase_index.search(docs, wanted).collect()}
    near = {r.doc_id for r in phrase_index.search(docs, wanted, slop=2).collect()}
    assert exact == {1} and near == {1, 2}


# ---- paragraphs

def test_paragraph_dedup(odd, nothing):
    texts = dict(_texts())
    rows = paragraphs.repeated_units(odd).collect()
    gone = {r.doc_id for r in rows if r.removed}
    assert {2, 3, 11} <= gone and not gone & {1, 7, 8, 10, 13, 15}
    found = b" ".join(texts[11].encode()[r.start:r.end] for r in sorted(rows, key=lambda r: r.start)
                      if r.doc_id == 11 and r.removed)
    assert len(found.split()) >= 50
    kept = paragraphs.remove_repeats(odd)
    assert kept.columns == odd.columns
    left = {(r.doc_id, r.text, r.n_chars) for r in kept.select("doc_id", "text", "n_chars").collect()}
    assert {(1, texts[1], len(texts[1])), (4, None, 0), (5, "", 0)} <= left and 2 not in {i for i, _, _ in left}
    assert paragraphs.repeated_units(nothing).collect() == [] and paragraphs.remove_repeats(nothing).collect() == []


def _bare(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(n))


def _shared_runs(rows, n):
    """doc_id -> numbers of the words in runs of ``n`` words that a document with a smaller id holds as well."""
    words = {i: _words(t) for i, t in rows}
    at = collections.defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - n + 1):
            at[tuple(w[k:k + n])].add((i, k))
    out = collections.defaultdict(set)
    for places in at.values():
        first = min(i for i, _ in places)
        for i, k in places:
            if i > first:
                out[i] |= set(range(k, k + n))
    return dict(out)


def test_shared_runs_go_whole(spark):
    rng = random.Random(21)
    run = _bare(rng, 30) + ". Yes. No! " + _bare(rng, 40) + ".\nOk.\n" + _bare(rng, 12)
    words = run.split(" ")
    rows = [(1, _bare(rng, 7) + " " + run + " " + _bare(rng, 9)),
            (2, _bare(rng, 20) + " " + " ".join(words[5:70]).upper() + " " + _bare(rng, 30)),  # cut at both ends
            (3, " ".join(words[:49]) + " " + _bare(rng, 300)),                                # one word too few
            (4, _bare(rng, 3) + "\n" + " ".join(words[2:52]) + "\n" + _bare(rng, 3)),         # just enough
            (5, _bare(rng, 80) + " " + run + "\n" + _bare(rng, 60) + " " + run),
            (6, "one two three four five " * 40), (8, "a b " * 200), (9, "b a " * 40)]
    rows += [(10 + k, _bare(rng, 40) + " " + " ".join(words[k % 7:60 + k % 5]) + " " + _bare(rng, 40)) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = _shared_runs(rows, 50)
    assert set(want) == {2, 4, 5, 9, *range(10, 40)}
    got = collections.defaultdict(set)
    for r in paragraphs.repeated_stretches(docs).collect():
        got[r.doc_id] |= set(range(r.low, r.high))
        text = dict(rows)[r.doc_id].encode()
        assert len(text[r.start:r.end].split()) == r.high - r.low and r.first_doc_id < r.doc_id
    assert dict(got) == want
    kept = {r.doc_id: r.text.split() for r in paragraphs.remove_repeats(docs).collect()}
    assert kept[2] == [w for k, w in enumerate(rows[1][1].split()) if k not in want[2]]
    assert kept[1] == rows[0][1].split() and kept[3] == rows[2][1].split() and kept[6] == rows[5][1].split()


def test_shared_runs_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    got = collections.defaultdict(set)
    for r in paragraphs.repeated_stretches(docs).collect():
        got[r.doc_id] |= set(range(r.low, r.high))
    assert dict(got) == _shared_runs([tuple(r) for r in docs.collect()], 50)


def test_line_of_one_sentence_inside_a_paragraph(spark):
    rng = random.Random(33)
    line, other = _sentence(rng, 40), _sentence(rng, 30)
    rows = [(1, _sentence(rng, 60) + " " + line + " " + _sentence(rng, 60)), (2, _sentence(rng, 9) + "\n" + line + "\nend"),
            (3, other), (4, _sentence(rng, 50) + " " + other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone = [(r.doc_id, rows[r.doc_id - 1][1].encode()[r.start:r.end].decode(), r.first_doc_id)
            for r in paragraphs.repeated_units(docs).filter("removed").collect()]
    assert sorted(gone) == [(2, line, 1), (4, other, 3)]


def _near_lines(rows, least=13):
    """Each line of that many words, as its words, and the different lines whose five-word shingles are 0.8 alike."""
    lines = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            w = _words(line)
            if i is not None and len(w) >= least:
                lines[" ".join(w)] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
    by = collections.defaultdict(set)
    for line, s in lines.items():
        for x in s:
            by[x].add(line)
    near = collections.defaultdict(set)
    for line, s in lines.items():
        for other in set().union(*(by[x] for x in s)) - {line}:
            t = lines[other]
            if 100 * len(s & t) >= 80 * len(s | t):
                near[line].add(other)
    return near


def test_paragraph_pairs_of_documents_are_found(spark, folder):
    """Recall of the bands against all pairs of paragraphs: nine tenths of the near pairs, and all equal ones."""
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    units = paragraphs.repeated_units(docs).filter("unit >= 0 and unit % 2 = 0").collect()
    text = dict(rows)
    group = collections.defaultdict(set)
    for r in units:
        group[" ".join(_words(text[r.doc_id].encode()[r.start:r.end].decode()))].add(r.first_doc_id)
    near = _near_lines(rows)
    pairs = [(a, b) for a in near for b in near[a]]
    assert pairs and sum(bool(group[a] & group[b]) for a, b in pairs) >= 0.9 * len(pairs)
    count = collections.Counter(" ".join(_words(x)) for t in text.values() for x in t.split("\n") if len(x.split()) >= 13)
    assert all(len(group[line]) == 1 for line, n in count.items() if n > 1)


def test_nothing_vanishes_from_documents(spark, folder):
    """What goes is held by a document that comes first, in what the steps before left of it: paragraphs by one that their near
    pairs lead to, every 50 words of a run by some text, sentences by one that keeps them to the end."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    text = {r.doc_id: r.text.encode() for r in docs.collect()}
    units = paragraphs.repeated_units(docs).collect()
    final = {r.doc_id: " ".join(_words(r.text)) for r in paragraphs.remove_repeats(docs).collect()}
    bare = lambda r: " ".join(_words(text[r.doc_id][r.start:r.end].decode()))
    lines = [r for r in units if r.unit >= 0 and r.unit % 2 == 0]
    firsts = {(r.first_doc_id, bare(r)) for r in lines if not r.removed}
    near, left = _near_lines([(i, t.decode()) for i, t in text.items()]), {}
    for i, t in text.items():
        cuts = sorted((r.start, r.end) for r in lines if r.removed and r.doc_id == i)
        for start, end in reversed(cuts):
            t = t[:start] + "\x01 \x02".encode() + t[end:]  # nothing can be matched over the gap
        left[i] = " ".join(_words(t.decode()))
    for r in units:
        if not r.removed:
            continue
        assert r.first_doc_id <= r.doc_id
        if r.unit < 0:
            w = bare(r).split()
            for k in range(len(w) - 49):
                assert any(" ".join(w[k:k + 50]) in left[j] for j in left if j < r.doc_id)
        elif r.unit % 2:
            assert bare(r) in final[r.first_doc_id]
        else:
            reached, todo = {bare(r)}, [bare(r)]
            while todo:
                todo += [x for x in near.get(todo.pop(), ()) if x not in reached]
                reached |= set(todo)
            assert any((r.first_doc_id, x) in firsts for x in reached)
    assert {r.unit < 0 for r in units if r.removed} == {True, False}


def test_a_copy_goes_only_for_one_that_stays(spark):
    rng = random.Random(71)
    base, fresh, run = _sentence(rng, 140), _sentence(rng, 20), _bare(rng, 60)
    short = _sentence(rng, 20)
    rows = [(2, base), (5, base + " " + fresh), (7, _sentence(rng, 40) + " " + fresh + " " + _sentence(rng, 40)),
            (12, _sentence(rng, 400)), (15, _sentence(rng, 9)), (20, short), (21, "x\n" + short), (22, short + "\n" + _sentence(rng, 30))]
    rows += [(13, rows[3][1][:-1] + " " + run + "."), (17, _bare(rng, 20) + " " + run + " " + _bare(rng, 20))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id: " ".join(_words(r.text)) for r in paragraphs.remove_repeats(docs).collect()}
    for passage in (base, fresh, run, short):
        assert any(" ".join(_words(passage)).rstrip(".") in t for t in left.values())
    assert 5 not in left and 13 not in left  # near copies
    assert " ".join(_words(fresh)) in left[7] and run in left[17]
    assert 20 in left and left[21] == "x" and " ".join(_words(short)) not in left[22]  # short paragraphs go as well


def test_texts_that_share_an_id_are_cut_apart(spark):
    rng = random.Random(72)
    one, other = "\n".join(_sentence(rng, 30) for _ in range(6)), "日本語のテキスト。" * 40 + " " + _sentence(rng, 20)
    rows = [(1, one), (3, "lead\n" + one + "\ntail"), (3, other), (3, other)]
    got = sorted((r.doc_id, r.text) for r in paragraphs.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(1, one), (3, "lead\n" + "\n" * 5 + "\ntail"), (3, other), (3, other)])


def test_banding_recall():
    """The bands find pairs of similarity 0.8 with the promised probability."""
    rng = np.random.default_rng(0)
    found = 0
    for _ in range(400):
        common = rng.integers(0, 1 << 63, 80, dtype=np.uint64)
        sets = [np.concatenate([common, rng.integers(0, 1 << 63, 10, dtype=np.uint64)]) for _ in range(2)]
        mins = [[paragraphs.mix(s ^ seed).min() for seed in paragraphs._SEEDS] for s in sets]
        same = np.array(mins[0]) == np.array(mins[1])
        found += same.reshape(paragraphs.BANDS, paragraphs.ROWS).all(axis=1).any()
    assert found >= 390


# ---- quality

def test_quality_on_labels(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    judged = weak_labels.judge_quality(docs).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    good = [r for r in judged if r.quality == 1]
    assert sum(r.keep == (r.quality == 1) for r in judged) >= 0.95 * len(judged)
    assert sum(r.keep for r in good) >= 0.98 * len(good)


def test_quality_of_odd_rows(odd, nothing):
    judged = weak_labels.judge_quality(odd)
    assert sorted(judged.columns) == sorted(odd.columns)  # its own three replace those of the same name
    rows = judged.collect()
    assert len(rows) == len(_texts()) and all(0 <= r.score <= 1 for r in rows)
    assert not [r for r in rows if r.doc_id == 17 and r.keep]
    assert weak_labels.judge_quality(nothing).collect() == []


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(4)
    truth = rng.random(20_000) < 0.8
    right = np.array([0.95, 0.9, 0.85, 0.9, 0.8, 0.9, 0.95])
    votes = np.where(rng.random((20_000, 7)) < right, 1, -1) * np.where(truth, 1, -1)[:, None]
    patterns = weak_labels.pattern_of(votes)
    model = weak_labels.fit_label_model(dict(collections.Counter(patterns.tolist())))
    guess = np.array([model.posterior[p] for p in patterns.tolist()]) >= 0.5
    assert (guess == truth).mean() > 0.97
    assert np.abs(np.array(list(model.accuracy().values())) - right).max() < 0.1


def test_stretches_in_cuts_are_not_written(spark):
    """Stretches that hold words of the spans cut before take no part in the table that two joins read; all others do."""
    rng = random.Random(31)
    rows = [(i, _sentence(rng, 200)) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = paragraphs._anchors(docs).select("doc_id", "text_key", "gram")
    key = {r["doc_id"]: r["text_key"] for r in wanted.collect()}
    gone = spark.createDataFrame([(1, key[1], 60, 80)] * 2 + [(1, key[1], 190, 200), (2, key[2], 0, 200)],
                                 "doc_id long, text_key long, low int, high int")
    whole = {(r["doc_id"], r["low"], r["high"], r["key"]) for r in paragraphs._single(docs, wanted, None).collect()}
    left = {(r["doc_id"], r["low"], r["high"], r["key"]) for r in paragraphs._single(docs, wanted, gone).collect()}
    assert len({i for i, *_ in whole}) == 3
    assert left == {x for x in whole if x[0] == 0 or x[0] == 1 and all(x[2] <= a or x[1] >= b for a, b in ((60, 80), (190, 200)))}
    assert {i for i, *_ in left} == {0, 1}

"""The pipeline against its stages by brute force, and the registered queries."""

import random
import re

import corpus_pipeline
from pyspark.sql import functions as F

from leafgraph.llm.queries import QUERIES
from leafgraph.session import materialize
from tests.llm.test_documents import _components, _hits, _sentence, _words


def _bare(text):
    return " ".join(_words(text))


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, before, folder), name)
        rows = {r.doc_id: r.text for r in before.collect()}
        left = {r.doc_id: r for r in after.collect()}
        assert set(left) <= set(rows)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
        if name == "quality":
            judged = [i for i in rows if i in labels]
            assert sum((i in left) == (labels[i] == 1) for i in judged) >= 0.95 * len(judged)
        if name == "near_duplicates":
            assert set(left) == {i for i, _, c in _components(list(rows.items()), 5, 80, 100) if c == i}
        if name == "repeated_passages":
            seen: set[str] = set()
            for i in sorted(left):
                for line in {x for x in left[i].text.split("\n") if len(x.split()) >= 13}:
                    assert _bare(line) not in seen
                seen |= {_bare(x) for x in left[i].text.split("\n")}
            for i in left:
                assert left[i].n_chars == len(left[i].text)
        if name == "benchmark_leaks":
            assert set(left) == {h[0] for h in _hits(list(rows.items()), items) if not h[5]}
        if name == "byte_bpe":
            assert set(left) == set(rows)
        before = after


def test_odd_rows_pass(spark, tmp_path):
    """Nulls, ids that several texts share, repeated rows, clashing columns and empty tables in every stage."""
    rng = random.Random(12)
    near = _sentence(rng, 60)
    good = [_sentence(rng, 40) + "\n" + _sentence(rng, 30) for _ in range(6)]
    rows = [(1, None), (2, ""), (None, None), (None, good[0]), (3, good[1]), (3, good[2]), (4, good[3]), (4, good[3]),
            (5, near), (6, near + " more"), (6, good[4]), (None, good[0])]
    spark.createDataFrame([(1, " ".join(good[2].split()[3:20]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumns(
        {c: F.lit(7) for c in ("_row", "id", "order", "first", "unit", "text_key", "n", "key") if c != "_row"})
    empty = docs.filter("false")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs, empty = (materialize(stage(spark, x, str(tmp_path)), name) for x in (docs, empty))
        assert empty.collect() == []
        if name != "byte_bpe":
            assert docs.columns == before.columns
        left = [tuple(r)[:2] for r in docs.collect()]
        if name == "near_duplicates":
            assert sorted((r for r in left if r[1]), key=repr) == sorted(
                [(3, good[1]), (3, good[2]), (4, good[3]), (5, near), (6, good[4]), (None, good[0])], key=repr)
        if name == "benchmark_leaks":
            assert (3, good[2]) not in left and (3, good[1]) in left
    assert {3, 4, 5, 6, None} <= {r[0] for r in left}


def test_every_operator_has_a_query():
    assert {int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES} == set(range(1, 14))


def test_stages_bound_the_bytes_of_a_batch(spark):
    import pyarrow as pa

    from leafgraph.session import BATCH_BYTES, BATCH_SETTING, bound_batches

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    had = spark.conf.get(BATCH_SETTING)
    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a b "), 1000).alias("text"))
    try:
        corpus_pipeline.without_repeats(spark, docs.limit(0), "")
        found = [r["n"] for r in docs.mapInArrow(sizes, "n long").collect()]
        assert sum(found) >= 16_000_000 and max(found) <= BATCH_BYTES + 10_000
        for setting, kept in (("1m", "1m"), ("64m", str(BATCH_BYTES)), ("67108864b", str(BATCH_BYTES)), ("4096k", "4096k"), ("1gb", str(BATCH_BYTES))):
            spark.conf.set(BATCH_SETTING, setting)
            bound_batches(spark)
            assert spark.conf.get(BATCH_SETTING) in (kept, f"{kept}b")
    finally:
        spark.conf.set(BATCH_SETTING, had)

"""Vector search and context operators against brute force and on edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafgraph.functions import models as M
from leafgraph.functions import text as X
from leafgraph.functions import vectors as V
from leafgraph.operators import context as K
from leafgraph.operators import nearest as N
from leafgraph.operators import retrieval as R
from leafgraph.operators.ivf import IvfIndex


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    vecs = rng.normal(size=(300, 16))
    vecs[7] = vecs[3]  # a tie
    vecs[11] = 0  # a blank text
    qs = rng.normal(size=(9, 16))
    qs[0] = vecs[3]
    docs = spark.createDataFrame([(i, v.tolist(), int(i % 3 == 0)) for i, v in enumerate(vecs)],
                                 "doc_id long, embedding array<double>, label int")
    questions = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(qs)],
                                      "question_id long, vector array<double>")
    return vecs, qs, docs, questions


def brute(vecs, qs, k, metric):
    out = []
    for q, v in enumerate(qs):
        with np.errstate(all="ignore"):
            d = {"cosine": 1 - vecs @ v / (np.linalg.norm(vecs, axis=1) * np.linalg.norm(v)),
                 "l2": np.linalg.norm(vecs - v, axis=1), "inner": -(vecs @ v)}[metric]
        d = np.where(np.isnan(d), np.inf, np.round(d, R.DIGITS))
        out += [(q, r + 1, int(i)) for r, i in enumerate(np.lexsort((np.arange(len(d)), d))[:k])]
    return out


def got(df):
    return sorted((r["question_id"], r["rank"], r["doc_id"]) for r in df.collect())


@pytest.mark.parametrize("metric", V.METRICS)
def test_nearest_is_exact(data, metric):
    vecs, qs, docs, questions = data
    assert got(R.nearest(questions, docs, 7, metric)) == brute(vecs, qs, 7, metric)


@pytest.mark.parametrize("parts", [1, 13])
def test_partitioning_does_not_matter(data, parts):
    vecs, qs, docs, questions = data
    assert got(R.nearest(questions, docs.repartition(parts, F.col("doc_id") * 7), 7)) == brute(vecs, qs, 7, "cosine")


def test_many_blocks_of_both_sides(data, monkeypatch):
    vecs, qs, docs, questions = data
    monkeypatch.setattr(N, "QUESTION_BYTES", 8 * 16 * 4)
    monkeypatch.setattr(N, "BLOCK_BYTES", 4 * 16 * 50)
    monkeypatch.setattr(N, "GROUP_ROWS", 8)
    for metric in V.METRICS:
        assert got(R.nearest(questions, docs, 7, metric)) == brute(vecs, qs, 7, metric)


def test_vectors_are_not_shuffled(data):
    _, _, docs, questions = data
    found = N.search_blocks(questions, docs, [("vector", "embedding")], [[0]], F.lit(3), "cosine", ["question_id"], "doc_id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


def test_groups_that_hold_no_hits_are_skipped():
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(20, 8)) * 50
    vecs = np.concatenate([m + rng.normal(size=(100, 8)) for m in middles])
    qs = middles[:3] + 0.1
    for metric in ("l2", "cosine", "inner"):
        block = N._Block({"keys": None, "ks": np.full(3, 5).tobytes(), "q0": qs.tobytes(), "wanted": b"", "wants": b""}, [[0]], 1, 0, metric)
        nothing = np.zeros((100, 0), np.int64)
        order = range(20)
        for g in order:
            block.add(np.arange(g * 100, g * 100 + 100), [vecs[g * 100:g * 100 + 100]], nothing, nothing.astype(bool))
        q, d, i = block.best[0]
        assert [(int(a), int(b)) for a, b in zip(q, i)] == [(a, c) for a, _, c in brute(vecs, qs, 5, metric)]
        assert block.compared < (0.3 if metric == "l2" else 0.9) * 3 * len(vecs)


def test_zero_vectors_sort_last(data):
    _, _, docs, questions = data
    last = R.nearest(questions, docs, 300).where("rank = 300").collect()
    assert {r["doc_id"] for r in last} == {11} and {r["distance"] for r in last} == {None}


def test_filtered_search(data):
    vecs, qs, docs, questions = data
    found = R.nearest_filtered(questions.withColumn("want", (F.col("question_id") >= 0).cast("int")), docs, on=(("want", "label"),), k=4)
    keep = np.arange(0, 300, 3)
    want = [(q, r, int(keep[i])) for q, r, i in brute(vecs[keep], qs, 4, "cosine")]
    assert got(found) == want


def test_filters_without_a_value_ask_for_nothing(data):
    vecs, qs, docs, questions = data
    some = questions.withColumn("want", F.when(F.col("question_id") % 2 == 0, 1))
    found = R.nearest_filtered(some, docs, on=(("want", "label"),), k=4)
    keep = np.arange(0, 300, 3)
    want = [(q, r, int(keep[i])) for q, r, i in brute(vecs[keep], qs, 4, "cosine") if q % 2 == 0]
    assert got(found) == sorted(want + [x for x in brute(vecs, qs, 4, "cosine") if x[0] % 2])


def test_own_k_and_several_lists(data):
    vecs, qs, docs, questions = data
    both = docs.withColumn("other", F.reverse("embedding"))
    lists = [[("vector", "embedding")], [("vector", "other")], [("vector", "embedding"), ("vector", "other")]]
    found = R.nearest_lists(questions.withColumn("k", F.col("question_id") + 1), both, lists, F.col("k"), "l2").collect()
    dist = [np.linalg.norm(vecs[None] - qs[:, None], axis=2), np.linalg.norm(vecs[None, :, ::-1] - qs[:, None], axis=2)]
    for n, d in enumerate([*dist, dist[0] + dist[1]]):
        want = [(q, r + 1, int(i)) for q in range(len(qs)) for r, i in enumerate(np.lexsort((np.arange(300), np.round(d[q], 9)))[:q + 1])]
        assert sorted((r["question_id"], r["rank"], r["doc_id"]) for r in found if r["list"] == n) == want


def test_nothing_to_search(data):
    _, _, docs, questions = data
    assert R.nearest(questions.where("false"), docs, 3).collect() == []
    assert R.nearest(questions, docs.where("false"), 3).collect() == []
    empty = docs.withColumn("embedding", F.when(F.col("doc_id") < 2, F.col("embedding")))
    assert {r["doc_id"] for r in R.nearest(questions, empty, 3).collect()} == {0, 1}


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_index_with_all_lists_is_exact(data, spark, tmp_path, metric):
    _, _, docs, questions = data
    some = docs.where("doc_id <> 11")
    IvfIndex.build(some, str(tmp_path / "ivf"), lists=6, metric=metric)
    index = IvfIndex.read(spark, str(tmp_path / "ivf"), metric)
    n = index.table("centroids").count()
    assert 4 <= n <= 9 and index.table("lists").count() == 299
    exact = R.nearest(questions, some, 5, metric)
    assert got(index.search(questions, 5, probes=n, candidates=299)) == got(exact)
    probes = index.tune(questions, exact, 0.9)
    found = index.search(questions, 5, probes, with_lists=True)
    assert R.recall(found, exact).agg(F.avg("recall")).first()[0] >= 0.85
    assert found.join(index.probes(questions, probes), ["question_id", "list_id"], "left_anti").count() == 0


def test_levels_search_with_their_own_texts(spark):
    """Only open questions reach the models, with the text of the level."""
    docs = spark.createDataFrame(
        [(1, "long enough " * 10, "F", "P", "", [1.0, 0.0]), (2, "long enough " * 10, "", "", "", [0.0, 1.0])],
        "doc_id long, text string, faculty string, program string, specialization string, embedding array<double>")
    qs = spark.createDataFrame([(1, "F", "P", "S", "first", "T", "q"), (2, "F", "P", "", "", "", "q"), (3, "X", "", "", "", "", "q")],
                               "question_id long, faculty string, program string, specialization string, year string, topic string, question string")
    stages = []
    embed = lambda levels: levels.withColumn("vector", F.when(F.contains("query", F.lit("first")), F.array(F.lit(-1.0), F.lit(0.0)))
                                             .otherwise(F.array(F.lit(1.0), F.lit(1.0))))
    kept, removed = R.backoff_search(qs, docs, k=3, threshold=0.1, embed=embed, stages=stages)
    asked = [sorted((r["question_id"], r["query"], r["answered"]) for r in stage.collect()) for stage in stages]
    assert asked == [[(1, "S : first : T : q", False), (2, "q", True), (3, "q", False)], [(1, "T : q", True)], [(3, "q", True)]]
    assert sorted((r["question_id"], r["level"], r["doc_id"]) for r in kept.collect()) == [(1, 1, 1), (2, 0, 1), (3, 2, 2)]
    assert removed.collect() == []


def test_combined_query_vectors(spark):
    qs = spark.createDataFrame([("a|bb",), ("abc",)], "query string")
    embed = lambda c: F.array(F.length(c).cast("double"))
    assert [r["vector"] for r in R.query_vectors(qs, 2, embed).collect()] == [[1.0, 2.0], [3.0, 3.0]]


def test_backoff_levels_skip_what_cannot_be_dropped(spark):
    qs = spark.createDataFrame([(1, "F", "", "", ""), (2, "", "", "", ""), (3, "F", "P", "S", "Y")],
                               "question_id long, faculty string, program string, specialization string, year string")
    rows = R.backoff_levels(qs).orderBy("question_id", "level").collect()
    assert [(r["question_id"], r["level"], r["removed_keys"]) for r in rows] == [
        (1, 0, []), (1, 2, ["faculty"]), (2, 0, []), (3, 0, []), (3, 1, ["specialization", "year"]),
        (3, 2, ["specialization", "year", "program", "faculty"])]


def test_fuse_keeps_first_fields_and_lowest_distance(spark):
    a = spark.createDataFrame([(1, 1, 10, "x", 0.5)], "question_id long, rank int, doc_id long, text string, distance double")
    b = spark.createDataFrame([(1, 1, 20, "x", 0.2), (1, 2, 30, "y", 0.3)], a.schema)
    rows = R.fuse_min_score(a, b).orderBy("rank").collect()
    assert [(r["doc_id"], r["distance"]) for r in rows] == [(10, 0.2), (30, 0.3)]


def hits(spark, *texts):
    return spark.createDataFrame([(1, n + 1, n, t) for n, t in enumerate(texts)],
                                 "question_id long, rank int, doc_id long, text string")


def test_budget_is_a_prefix(spark):
    rows = K.context_budget(hits(spark, "a" * 10, "b" * 50, "c"), 40).orderBy("rank").collect()
    assert [r["kept"] for r in rows] == [True, False, False]
    assert [r["removed_order"] for r in rows] == [None, 2, 1]
    context = K.format_context(hits(spark, "a" * 10, "b" * 50)).first()["context"]
    assert len(context) == rows[1]["used_chars"]


def test_over_long_hit_is_a_bucket_of_its_own(spark):
    rows = K.token_buckets(hits(spark, "a b", "x " * 20, "c", "d"), 6, overhead=2).orderBy("rank").collect()
    assert [r["bucket_no"] for r in rows] == [0, 1, 2, 2]


def test_first_usable_answer(spark):
    rows = spark.createDataFrame([(1, 0, None), (1, 1, "I do not have the information to answer it"), (1, 2, "yes"),
                                  (1, 3, "no"), (2, 0, "")], "question_id long, bucket_no int, answer string")
    assert {r["question_id"]: r["answer"] for r in K.first_answer(rows).collect()} == {1: "yes", 2: None}


@pytest.mark.parametrize("text, verdict", [("YES", True), ("no, because", False), ("maybe", False), ("No... yes", False),
                                           ("yes, not no", True), (None, False)])
def test_verdict(spark, text, verdict):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(X.parse_verdict(F.col("t"))).first()[0] is verdict


def test_verdict_without_default_raises(spark):
    with pytest.raises(Exception, match="expected YES or NO"):
        spark.createDataFrame([("maybe",)], "t string").select(X.parse_verdict(F.col("t"), None)).collect()


def test_question_checks(spark):
    q, k = M.check_question(F.col("q"), F.col("k"))
    with pytest.raises(Exception, match="user_input cannot be empty"):
        spark.createDataFrame([(" ", 1)], "q string, k int").select(q).collect()
    with pytest.raises(Exception, match="greater than 0"):
        spark.createDataFrame([("x", 0)], "q string, k int").select(k).collect()


def test_injected_models(spark):
    df = spark.createDataFrame([(1, "ab"), (2, " "), (3, None), (4, "abcd")], "id long, text string")
    rows = M.embed(df, lambda: lambda texts: [[len(t), 1.0] for t in texts], dim=2).orderBy("id").collect()
    assert [list(r["embedding"]) for r in rows] == [[2.0, 1.0], [0.0, 0.0], [0.0, 0.0], [4.0, 1.0]]
    rows = M.call_model(df, "text", "reply", lambda: lambda ts: [None if t is None else t.upper() for t in ts])
    assert [r["reply"] for r in rows.orderBy("id").collect()] == ["AB", " ", None, "ABCD"]


def test_default_embedding_of_blank_text_is_zero(spark):
    df = spark.createDataFrame([(1, " "), (2, "a b")], "id long, text string")
    rows = M.embed(df, dim=8).orderBy("id").collect()
    assert sum(rows[0]["embedding"]) == 0 and abs(sum(x * x for x in rows[1]["embedding"]) - 1) < 1e-9


def _chain(links, doc):
    """The walk over only predecessors and only successors, for graphs in which it ends."""
    def only(n, a, b):
        found = {x[b] for x in links if x[a] == n}
        return found.pop() if len(found) == 1 else None
    out, at = [doc], only(doc, 1, 0)
    while at is not None and at not in out:
        out.insert(0, at)
        at = only(at, 1, 0)
    at = only(doc, 0, 1)
    while at is not None and at not in out:
        out.append(at)
        at = only(at, 0, 1)
    return out


@pytest.mark.parametrize("links", [
    [(9, 4), (4, 7), (7, 0), (30, 2)],                        # out of order; document 0 is one like any other
    [(1, 2), (2, 3), (2, 4), (4, 5), (5, 6)],                 # two continuations: 3 and 4 each go back to 1
    [(1, 5), (2, 5), (5, 6), (6, 7), (8, 1)],                 # two predecessors: 1 and 2 each go on to 7
    [(n, n + 1) for n in range(100, 140)] + [(50, 100)]])
def test_chains_in_any_graph(spark, links):
    from leafgraph.operators.graph import split_siblings

    edges = spark.createDataFrame([(a, b, 5) for a, b in links] + [(1, 9, 4)], "src long, dst long, type int")
    nodes = sorted({n for x in links for n in x} | {77})
    got = {}
    for r in sorted(split_siblings(edges, spark.createDataFrame([(n,) for n in nodes], "doc_id long")).collect()):
        got.setdefault(r["doc_id"], []).append(r["member_id"])
    assert got == {n: _chain(links, n) for n in nodes}


def test_ring_of_continuations_ends(spark):
    from leafgraph.operators.graph import split_siblings

    edges = spark.createDataFrame([(3, 8, 5), (8, 5, 5), (5, 3, 5)], "src long, dst long, type int")
    rows = split_siblings(edges, spark.createDataFrame([(5,)], "doc_id long")).orderBy("position").collect()
    assert [r["member_id"] for r in rows] == [3, 8, 5]


def test_lists_are_ranked_without_broadcasts(spark, monkeypatch):
    """A round that broadcast its nodes sent them through the driver, as often as the longest list has binary digits."""
    from leafgraph.operators import graph as G

    plans, keep = [], G.materialize
    monkeypatch.setattr(G, "materialize", lambda df, label: (plans.append(df._jdf.queryExecution().executedPlan().toString()), keep(df, label))[1])
    links = spark.range(1, 40).selectExpr("id - 1 AS src", "id AS dst")
    found = G.rank_lists(links).collect()
    assert sorted(r["place"] for r in found) == list(range(40)) and {r["head"] for r in found} == {0}
    assert len(plans) > 5 and not any("Broadcast" in p for p in plans)


def test_fields_are_told_apart_in_one_scan(spark):
    from leafgraph.functions.text import extract_field

    texts = ["url: u\ntext: a\nb\nlinks: none", "text:", "text: \n x\n", "no field", None, "text: a\nb:c\nd: e", "text: a\n\n", "url: \n",
             "text: " + "line\n" * 50_000 + "links: none", "text: a\r\nb c\n\nlinks:\tx"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        extract_field(F.col("t"), "url").alias("url"), extract_field(F.col("t"), "text").alias("text"),
        F.expr(r"CASE WHEN regexp_like(t, 'text:\\s*([\\s\\S]*?)(?:\\n\\w+:\\s|\\n?\\z)') "
               r"THEN regexp_extract(t, 'text:\\s*([\\s\\S]*?)(?:\\n\\w+:\\s|\\n?\\z)', 1) END").alias("lazy"))
    assert [r["url"] for r in rows.collect()] == ["u"] + [None] * 6 + [None] * 3
    assert all(r["text"] == r["lazy"] for r in rows.collect())


def test_a_token_is_taken_apart_once(spark):
    """Its word and its full stop are one pattern each, whatever asks for them."""
    from leafgraph.operators.sentences import word_counts

    rows = word_counts(spark.createDataFrame([("1. Dr. Who came. So did I.",)], "text string"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 2
    assert {(r["w"], r["dot"], r["n"], r["c"]) for r in rows.collect()} == {
        ("1", True, "dr", 1), ("dr", True, "who", 1), ("who", False, None, 1), ("came", True, "so", 1), ("so", False, None, 1),
        ("did", False, None, 1), ("i", True, "", 1)}


def test_vectors_are_made_once(data):
    _, _, docs, questions = data
    found = N.search_blocks(questions, docs.withColumn("embedding", F.transform("embedding", lambda x: x + 0)),
                            [("vector", "embedding")], [[0]], F.lit(3), "cosine", ["question_id"], "doc_id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "transform" not in plan  # blocks of either side are read, not made per pair


def test_question_block_holds_no_batch():
    buffers = {"ks": np.full(3, 2), "q0": np.ones((3, 4))}
    block = N._Block({"keys": None, **{k: v.tobytes() for k, v in buffers.items()}, "wanted": b"", "wants": b""}, [[0]], 1, 0, "l2")
    assert all(x.base is None or x.base.flags.owndata for x in (block.ks, *block.mats, block.wanted, block.wants))


@pytest.mark.parametrize("metric", V.METRICS)
@pytest.mark.parametrize("lists", [[[0]], [[0], [1]], [[0, 1]]])
def test_screened_search_equals_all_distances(metric, lists):
    rng = np.random.default_rng(4)
    vecs = [rng.normal(size=(900, 8)) * rng.choice([1e-3, 1, 1e4], (900, 1)) for _ in range(2)]
    qs = [rng.normal(size=(40, 8)) for _ in range(2)]
    ids = rng.permutation(900) * 3
    for v, q in zip(vecs, qs):
        v[100:400] = v[100]  # copies
        v[500:520] = 0
        v[600, 3] = np.nan
        q[:5], q[5], q[6] = v[100], 0, np.nan
    ks = rng.integers(1, 9, 40)
    codes = rng.integers(0, 3, (900, 1))
    wanted, wants = rng.integers(0, 3, (40, 1)), rng.random((40, 1)) < 0.5
    row = {"keys": None, "ks": ks.tobytes(), "wanted": wanted.tobytes(), "wants": wants.tobytes(),
           **{f"q{i}": q.tobytes() for i, q in enumerate(qs)}}
    block = N._Block(row, lists, 2, 1, metric)
    for at in range(0, 900, 60):
        part = slice(at, at + 60)
        block.add(ids[part], [v[part] for v in vecs], codes[part], np.ones((60, 1), bool))
    with np.errstate(all="ignore"):
        each = [{"inner": -(q @ v.T), "l2": np.linalg.norm(q[:, None] - v[None], axis=2),
                 "cosine": 1 - q @ v.T / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1))}[metric] for q, v in zip(qs, vecs)]
    for n, pairs in enumerate(lists):
        d = sum(np.round(np.where(np.isnan(each[i]), np.inf, each[i]) if metric == "cosine" else each[i], N.DIGITS) for i in pairs)
        for q in range(40):
            some = np.flatnonzero((~wants[q, 0] | (codes[:, 0] == wanted[q, 0])) & ~np.isnan(d[q]))
            best = some[np.lexsort((ids[some], np.round(d[q][some], 7)))][:ks[q]]
            mine = block.best[n][0] == q
            np.testing.assert_allclose(block.best[n][1][mine], d[q][best], rtol=1e-7, atol=1e-6)
            if metric == "cosine":
                assert list(block.best[n][2][mine]) == list(ids[best])


def test_text_of_a_chain_is_put_together_once(spark):
    from leafgraph import schemas as S
    from leafgraph.operators import graph as G

    edges = spark.createDataFrame([(1, 2, S.SPLIT_SIBLING), (2, 3, S.SPLIT_SIBLING), (4, 5, S.SPLIT_SIBLING), (4, 6, S.SPLIT_SIBLING)],
                                  "src long, dst long, type int")
    hits = spark.createDataFrame([(i, "h", ["x", "y"]) for i in (1, 2, 3, 3, 4, 5, 6, 7, None)], "doc_id long, text string, titles array<string>")
    texts = spark.createDataFrame([(i, f"t{i}") for i in range(1, 7)] + [(2, "s2")], "doc_id long, text string")
    out = G.combine_siblings(hits, edges, texts)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    grouped = [line for line in plan.splitlines() if "array_join" in line and "Aggregate" in line]
    assert grouped and all("Aggregate [_key" in line for line in grouped)
    rows = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert len(rows) == 9 and rows.count((3, "t1 s2 t2 t3")) == 2
    assert {t for i, t in rows if i in (1, 2, 3)} == {"t1 s2 t2 t3"} and (7, None) in rows and (None, None) in rows

"""File sources, configurations, sinks and streams."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from leafgraph.operators.chunking import chunk_array, recursive_chunks
from leafgraph.operators.links import resolve_links
from leafgraph.plans.corpus import build_corpus
from leafgraph.plans.embedding_load import vector_rows
from leafgraph.sources.collections import collection_files, drop_old, read_collection, write_collection
from leafgraph.sources.config import read_site_table, site_configs
from leafgraph.operators.parse import SiteConfig
from leafgraph.session import materialize
from leafgraph.sources.pages import number_pages, scan_pages, scan_sites
from leafgraph.sources.store import append_update, upsert_collection
from leafgraph.streaming.interactions import log_feedback, log_questions
from leafgraph.streaming.refresh import apply_batch, current_corpus

CONFIG = """{
  // general settings
  general_config: {max_extract_len: 500, encoding: 'utf-8-sig'},
  dump_configs: {
    example_config: {base_url: 'ignored'},
    site_one: {base_url: 'https://one.example/docs/', main_content_attrs: {id: 'main'},
               remove_tag_attrs: [{name: 'nav'}, {class: 'ad'}],
               replacements: [{attrs: {name: 'table'}, function: 'convert_table'}],
               metadata: {faculty: 'Science'}, metadata_extractor: 'default_extract_metadata', no_title_splits: [1]}
  }
}"""


def test_site_configuration(spark, tmp_path):
    (tmp_path / "c.json").write_text(CONFIG)
    table = read_site_table(spark, str(tmp_path / "c.json"))
    assert [(r["name"], r["dump_path"]) for r in table.collect()] == [("site_one", "one.example/docs")]
    config = site_configs(table)["site_one"]
    assert config.main_content_attrs == {"id": "main"} and config.max_extract_len == 500
    assert config.remove_tag_attrs == ({"name": "nav"}, {"class": "ad"}) and config.no_title_splits == (1,)
    assert config.replacements[0]["function"] == "convert_table" and config.mandatory_splits == 3


def test_configuration_without_required_key(spark, tmp_path):
    (tmp_path / "c.json").write_text("{dump_configs: {bad: {base_url: 'https://x'}}}")
    with pytest.raises(Exception, match="Missing required key in the dump config for bad: main_content_attrs"):
        site_configs(read_site_table(spark, str(tmp_path / "c.json")))


def test_configuration_with_unknown_function(spark, tmp_path):
    (tmp_path / "c.json").write_text(CONFIG.replace("'default_extract_metadata'", "'nobody'"))
    with pytest.raises(ValueError, match="Invalid function name"):
        site_configs(read_site_table(spark, str(tmp_path / "c.json")))


def test_folder_scan(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a.html").write_bytes(b"\xef\xbb\xbf<h1>x</h1>")
    (tmp_path / "a" / "b" / "c.html").write_text("<p>é</p>", encoding="utf-8")
    (tmp_path / "a" / "note.txt").write_text("no")
    rows = scan_pages(spark, str(tmp_path), "https://s.example/").orderBy("url").collect()
    assert [(r["url"], r["html"]) for r in rows] == [("https://s.example/a", "<h1>x</h1>"),
                                                     ("https://s.example/a/b/c", "<p>é</p>")]
    assert len({r["page_id"] for r in rows}) == 2
    numbered = number_pages(scan_pages(spark, str(tmp_path), "https://s.example/").where("url LIKE '%c'"))
    assert [(r["url"], r["page_no"]) for r in numbered.collect()] == [("https://s.example/a/b/c", 1)]
    known = materialize(numbered.select("page_id", "page_no"), "known")
    both = number_pages(scan_pages(spark, str(tmp_path), "https://s.example/"), known).orderBy("page_no").collect()
    assert [(r["url"], r["page_no"]) for r in both] == [("https://s.example/a/b/c", 1), ("https://s.example/a", 2)]


def test_sites_are_scanned_at_once_in_their_encodings(spark, tmp_path):
    for name, text, code in (("one.example/a.html", "<p>é</p>", "latin-1"), ("one.example/x/b.html", "<p>ü</p>", "utf-8"),
                             ("other.example/c.html", "no site", "utf-8")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text.encode(code))
    sites = {"one": SiteConfig(base_url="https://one.example", encoding="latin-1"), "x": SiteConfig(base_url="https://one.example/x/")}
    rows = scan_sites(spark, str(tmp_path), sites).orderBy("url").collect()
    assert [(r["site"], r["url"], r["html"]) for r in rows] == [("one", "https://one.example/a", "<p>é</p>"),
                                                               ("x", "https://one.example/x/b", "<p>ü</p>")]
    with pytest.raises(ValueError, match="Unknown encoding"):
        scan_pages(spark, str(tmp_path), "https://one.example", encoding="morse")


def test_upsert_and_clear(spark, tmp_path):
    df = lambda *ids: spark.createDataFrame([(i,) for i in ids], "doc_id long")
    upsert_collection(df(1, 2), str(tmp_path), "c")
    upsert_collection(df(2, 3), str(tmp_path), "c")
    read = lambda: sorted(r[0] for r in read_collection(spark, f"{tmp_path}/c").collect())
    assert read() == [1, 2, 3]
    upsert_collection(df(9), str(tmp_path), "c", clear=True)
    assert read() == [9]


def test_aborted_load_leaves_the_collection(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = spark.range(0, 100, 1, 4)
    write_collection(rows, path)
    before = sorted(collection_files(path))
    bad = F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id")
    for replace in (True, False):
        with pytest.raises(Exception, match="broken"):
            write_collection(rows.select(bad), path, replace)
        assert sorted(collection_files(path)) == before and read_collection(spark, path).count() == 100
        assert {f"files/{p.name}" for p in (tmp_path / "c" / "files").glob("*.parquet")} == set(before)
    write_collection(spark.range(100, 150), path)
    assert read_collection(spark, path).count() == 150
    held = read_collection(spark, path)
    write_collection(spark.range(5), path, replace=True)
    assert read_collection(spark, path).count() == 5 and held.count() == 150  # a reader keeps what it began with
    assert drop_old(path) > 0 and read_collection(spark, path).count() == 5


def test_update_log(spark, tmp_path):
    append_update(spark, str(tmp_path / "u"), 1)
    append_update(spark, str(tmp_path / "u"), 2)
    assert spark.read.parquet(str(tmp_path / "u")).agg(F.max("id"), F.count("datetime")).first() == (2, 2)


def test_general_settings_are_honoured(spark, tmp_path):
    (tmp_path / "c.json").write_text(CONFIG.replace("encoding: 'utf-8-sig'", "encoding: 'latin-1', link_ignore_regex: 'tel:.*'"))
    config = site_configs(read_site_table(spark, str(tmp_path / "c.json")))["site_one"]
    assert (config.encoding, config.link_ignore_regex) == ("latin-1", "tel:.*")


def payload(n, **other):
    return json.dumps({"event_id": str(n), "question": f"q{n}", "answer": "a", "context": "", "reference_ids": [1, 2],
                       "logged_at": "2024-01-01T00:00:00Z", **other})


def test_question_stream_continues_and_drops_repeats(spark, tmp_path):
    source, run = tmp_path / "in", lambda: log_questions(spark, str(tmp_path / "in"), str(tmp_path / "out"),
                                                         str(tmp_path / "cp"))
    source.mkdir()
    (source / "1.json").write_text(payload(1) + "\n" + payload(1) + "\n" + payload(2))
    run()
    (source / "2.json").write_text(payload(2) + "\n" + payload(3))
    run()
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("event_id").collect()
    assert [(r["event_id"], r["question"], r["answer"], r["reference_ids"]) for r in rows] == [
        (str(n), f"q{n}", "a", [1, 2]) for n in (1, 2, 3)]


def test_feedback_stream_sets_rejects_aside(spark, tmp_path):
    def line(n, best, helpful="yes"):
        return json.dumps({"event_id": str(n), "feedback-hidden-helpful": helpful, "feedback-hidden-question": "q",
                           "feedback-hidden-reference-ids": "1,2,3,", "feedback-reference-select": best,
                           "logged_at": "2024-01-01T00:00:00Z"})
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join([line(1, "2"), line(2, "x"), line(3, "0", "no"), line(1, "2")]))
    log_feedback(spark, *[str(tmp_path / p) for p in ("in", "out", "rejects", "cp")])
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("event_id").collect()
    assert [(r["event_id"], r["helpful_response"], r["most_relevant_doc"], r["retrieved_doc_ids"]) for r in rows] == [
        ("1", True, 2, [1, 2, 3]), ("3", False, 0, [1, 2, 3])]
    assert [r["event_id"] for r in spark.read.parquet(str(tmp_path / "rejects")).collect()] == ["2"]


@pytest.mark.parametrize("href, target", [
    ("/x.html", "https://s.example/x"), ("x", "https://s.example/d/x"), ("#f", "https://s.example/d/p?q=1#f"),
    ("?z=2", "https://s.example/d/p?z=2"), ("../x/", "https://s.example/x"), ("./x/../y", "https://s.example/d/y"),
    ("//cdn.example/x/", "//cdn.example/x/"), ("http://o.example/y.html", "http://o.example/y.html"),
    ("../../../x", "https://s.example/x"), ("x/", "https://s.example/d/x"), ("tel:12", "tel:12")])
def test_link_forms(spark, href, target):
    links = spark.createDataFrame([(1, "https://s.example/d/p?q=1#a", href)], "doc_id long, url string, href string")
    docs = spark.createDataFrame([(0, target)], "doc_id long, url string")
    row = resolve_links(links, docs).first()
    assert row["target_url"] == target and row["target_doc_id"] == 0  # document 0 is a target like any other


def test_ignored_and_redirected_links(spark):
    links = spark.createDataFrame([(1, "https://s.example/", "mailto:a@b"), (1, "https://s.example/", "/old#part")],
                                  "doc_id long, url string, href string")
    docs = spark.createDataFrame([(5, "https://s.example/new#part")], "doc_id long, url string")
    moved = spark.createDataFrame([("https://s.example/old", "https://s.example/new")], "original string, final string")
    rows = resolve_links(links, docs, moved).collect()
    assert [(r["target_url"], r["target_doc_id"]) for r in rows] == [("https://s.example/new#part", 5)]


def test_chunks_of_numbered_and_unbroken_text(spark):
    text = "Intro line. More\n1. first item\n2. second item\n* bullet\n\nnext " + "x" * 50 + " tail"
    chunks = spark.createDataFrame([(text,)], "t string").select(chunk_array(F.col("t"), 40)).first()[0]
    assert chunks == ["Intro line. More 1. first item", "2. second item * bullet", "next", "x" * 50, "tail"]


def test_recursive_chunks_overlap(spark):
    text = "\n\n".join(" ".join(f"w{i}{j}" for j in range(8)) for i in range(6))
    chunks = spark.createDataFrame([(text,)], "t string").select(recursive_chunks(F.col("t"), 60, 10)).first()[0]
    assert all(len(c) <= 60 for c in chunks) and len(chunks) > 3
    joined = chunks[0]
    for c in chunks[1:]:
        cut = max(n for n in range(11) if joined.endswith(c[:n]))
        joined += c[cut:]
    assert joined == text


def test_vector_rows(spark):
    rows = spark.createDataFrame(
        [(1, "u", ["P", "A"], ["A", "B"], "some text", [("t", "https://l", None)]), (2, "u", None, ["", "C"], None, None),
         (3, "u", ["P"], ["", "C"], "x", None)],
        "doc_id long, url string, parent_titles array<string>, titles array<string>, text string, "
        "links array<struct<title:string,url:string,doc_id:long>>")
    out = vector_rows(rows, dim=32, model_dim=16).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["titles"], r["links"]) for r in out] == [(1, ["P", "A", "B"], ["https://l"]), (3, ["P", "C"], [])]
    assert all(len(r["text_embedding"]) == 32 and r["text_embedding"][16:] == [0.0] * 16 for r in out)


def _lines(corpus):
    rows = corpus.extracts.select("doc_id", "url", "parent", "titles", "parent_titles", "text", "faculty", "site", F.transform(
        "links", lambda l: F.concat_ws("|", l["title"], l["url"], l["doc_id"].cast("string"))).alias("links")).collect()
    return sorted(map(repr, rows)), sorted(map(repr, corpus.edges.collect()))


def test_refresh_equals_a_rebuild(spark, tmp_path):
    """Changed and removed titles, pages that fill a gap, moved links and redirects, two sites."""
    sites = {"a": SiteConfig(base_url="https://a.example", metadata_extractor="default_extract_metadata", max_extract_len=40),
             "b": SiteConfig(base_url="https://b.example", link_ignore_regex="/no.*", metadata={"faculty": "B"})}
    schema = "page_id long, site string, url string, html string, last_modified timestamp"

    def page(n, site, path, title, body, day):
        head = f"<h1>{title}</h1>" if title is not None else ""
        return n, site, f"https://{site}.example/{path}", head + body, datetime.datetime(2024, 1, day)
    link = '<a href="/x/y.html">to y</a> <a href="/x/y#part">to part</a> <a href="/moved">to moved</a> <a href="/no/z">no</a>'
    batches = [
        [page(1, "a", "x", "The Faculty of X", link, 1), page(3, "a", "x/y/z", "Z", "deep. " * 20, 1),
         page(5, "b", "x", "X of b", link, 1), page(6, "a", "q", "Q", '<a href="x/y/z">z</a>', 1)],
        [page(2, "a", "x/y", "Y", "<h2>first</h2><a id='part'></a><h2>Part</h2>text", 1),  # fills the gap above z
         page(1, "a", "x", "The Faculty of X", link, 1), page(7, "b", "x/y", "Y of b", "text", 1)],
        [page(1, "a", "x", "The Faculty of New X", link + "more words", 2), page(7, "b", "x/y", None, "text", 2),
         page(2, "a", "x/y", "Y", "<h2>Part</h2>other", 3), page(2, "a", "x/y", "old", "old", 2)],
        [page(8, "a", "new", "New", "text", 1)],
    ]
    moved = [None, [("https://a.example/moved", "https://a.example/q")], [("https://a.example/moved", "https://a.example/q")],
             [("https://a.example/moved", "https://a.example/new"), ("https://b.example/moved", "https://b.example/x/y")]]
    newest = {}
    for n, (batch, hops) in enumerate(zip(batches, moved)):
        redirects = hops and spark.createDataFrame(hops, "original string, final string")
        for _ in range(2 if n in (0, 2) else 1):  # a batch that runs again changes nothing
            apply_batch(spark, spark.createDataFrame(batch, schema), str(tmp_path), n, sites, redirects)
        for row in batch:
            if row[0] not in newest or row[4] > newest[row[0]][4]:
                newest[row[0]] = row
        got = current_corpus(spark, str(tmp_path), sites)
        numbers = got.extracts.where("page_id IS NOT NULL").select("page_id", F.floor(F.col("doc_id") / (1 << 20)).alias("page_no")).distinct()
        pages = spark.createDataFrame(list(newest.values()), schema).join(numbers, "page_id")
        assert pages.count() == len(newest)
        want = build_corpus(pages, sites, redirects)
        assert _lines(got) == _lines(want), n
    facts = {(r["url"], r["faculty"]) for r in got.extracts.collect()}
    assert ("https://a.example/x/y/z", "The Faculty of New X") in facts


def test_a_batch_parses_only_its_pages(spark, tmp_path):
    """Pages below a renamed one get new extracts from their stored sections; others stay where they are."""
    from leafgraph.streaming.refresh import _State

    schema = "page_id long, url string, html string, last_modified timestamp"
    config = SiteConfig(base_url="https://s.example")
    rows = [(n, f"https://s.example/{path}", f"<h1>{path}</h1>text", datetime.datetime(2024, 1, 1))
            for n, path in ((1, "a"), (2, "a/b"), (3, "c"))]
    apply_batch(spark, spark.createDataFrame(rows, schema), str(tmp_path), 0, config)
    again = [(1, "https://s.example/a", "<h1>New</h1>text", datetime.datetime(2024, 1, 2)), rows[2]]
    apply_batch(spark, spark.createDataFrame(again, schema), str(tmp_path), 1, config)
    state = _State(spark, str(tmp_path), 1)
    written = {name: {r["page_id"] for r in state.versions(f"{name}-written").where("batch_id = 1").collect()}
               for name in ("pages", "sections", "extracts", "links")}
    assert written == {"pages": {1}, "sections": {1}, "extracts": {1, 2}, "links": {1}}
    titles = {r["page_id"]: r["parent_titles"] for r in state.current("extracts").collect()}
    assert titles == {1: ["New"], 2: ["New", "a/b"], 3: ["c"]}


def test_replacement_functions_scan_forward(spark):
    from leafgraph.functions.registry import register
    from leafgraph.operators.parse import parse_pages

    register("replacement", "bracket", lambda element, url: f"<em>[{element.text()}]</em><b>{url}</b><i>kept</i>")
    register("replacement", "drop", lambda element, url: None)
    register("replacement", "forever", lambda element, url: "<p><u>again</u></p>")
    pages = spark.createDataFrame([(1, "u1", "<div><b>x <b>y</b></b> <s>gone</s>tail</div>")], "page_id long, url string, html string")

    def body(*rules):
        config = SiteConfig(replacements=tuple({"attrs": {"name": n}, "function": f} for n, f in rules))
        rows = parse_pages(pages, config).orderBy("pos").collect()
        return rows[-1]["kind"], " ".join((rows[-1]["body"] or rows[-1]["text"]).split())
    # what a function returned is not replaced itself
    assert body(("b", "bracket"), ("s", "drop")) == ("text", "[x y]u1kept tail")
    pages = pages.withColumn("html", F.lit("<u>a</u>"))
    kind, text = body(("u", "forever"))
    assert kind == "error" and "replacements" in text
    with pytest.raises(ValueError, match="Invalid function name"):
        body(("u", "nobody"))


def test_log_keeps_nameless_late_and_first_payloads(spark, tmp_path):
    run = lambda: log_questions(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    nameless = json.dumps({"question": "q", "answer": "n"})
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1").write_text("\n".join([payload(1, answer="b"), payload(1, answer="a"), nameless, nameless, '{"event_id": "9", "q',
                                                  json.dumps({"event_id": "2"})]))
    run()
    late = json.dumps({**json.loads(payload(3)), "logged_at": "2001-01-01T00:00:00Z"})
    (tmp_path / "in" / "2").write_text("\n".join([payload(1, answer="c"), payload(2), nameless, late]))
    run()
    rows = [(r["event_id"], r["answer"], r["batch_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    # an id that only an unusable line had is free
    assert sorted(rows, key=repr) == [("1", "a", 0), ("2", "a", 1), ("3", "a", 1), (None, "n", 0), (None, "n", 0), (None, "n", 1)]
    assert spark.read.parquet(str(tmp_path / "out-rejects")).count() == 2


def test_snapshots_read_changed_buckets_only(spark, tmp_path):
    from leafgraph.operators import snapshots as Z

    rows = spark.range(1000).select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("t"))
    other = rows.where("id <> 17").withColumn("t", F.when(F.col("id") == 5, "new").otherwise(F.col("t"))).union(
        spark.createDataFrame([(2000, None)], "id long, t string"))
    for name, df in (("a", rows), ("b", rows.repartition(7)), ("c", other)):
        Z.write_snapshot(df, str(tmp_path / name), "id", buckets=64)
    a, b, c = (str(tmp_path / x) for x in "abc")
    assert Z.changed_buckets(spark, a, b) == [] and Z.snapshot_difference(spark, a, b).collect() == []
    found = Z.snapshot_difference(spark, a, c)
    assert sorted((r["id"], r["t"], r["side"]) for r in found.collect()) == [
        (5, "new", "added"), (5, "t5", "removed"), (17, "t17", "removed"), (2000, None, "added")]
    changed = Z.changed_buckets(spark, a, c)
    assert 1 <= len(changed) <= 3
    read = {f.split("bucket=")[1].split("/")[0] for f in spark.read.parquet(f"{a}/rows").where(F.col("bucket").isin(changed)).inputFiles()}
    assert read == {str(x) for x in changed}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_boundaries_are_learned(spark):
    from leafgraph.operators.sentences import train, trained_sentences

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(3, 9)))
    names = [word().capitalize() for _ in range(40)]
    line = lambda: " ".join([rng.choice(["The", "Some"]), *[word() for _ in range(8)], "Dr.", rng.choice(names), word(), "e.g.", word()]) + "."
    docs = spark.createDataFrame([(n, " ".join(line() for _ in range(20))) for n in range(60)], "doc_id long, text string")
    model = train(docs)
    short = {r["w"] for r in model.abbreviations.collect()}
    assert {"dr", "e.g"} <= short and len(short) < 60
    assert {"the", "some"} <= {r["n"] for r in model.starters.collect()}
    text = "Ask Dr. No about it. The end came, e.g. here. Who? Nobody.\n1. first item\n\nlast words of Dr. The rest"
    odd = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "no stop")], "doc_id long, text string")
    got = {}
    for r in trained_sentences(odd, model).orderBy("doc_id", "i").collect():
        got.setdefault(r["doc_id"], []).append(r["sentence"])
    assert got == {1: ["Ask Dr. No about it.", "The end came, e.g. here.", "Who?", "Nobody.", "1. first item", "last words of Dr.", "The rest"],
                   4: ["no stop"]}
    empty = train(docs.where("false"))
    assert trained_sentences(odd.where("doc_id = 1"), empty).count() == 9


def test_misspelt_question_is_corrected(spark):
    from leafgraph.operators.spelling import best_words, correct_questions, deletions, vocabulary

    docs = spark.createDataFrame([(1, "How do I apply to honours? To apply for honours in cs, apply early. Do it now, do it. I do."),
                                  (2, "how to apply: honours cs students apply to cs")], "doc_id long, text string")
    words = vocabulary(docs)
    qs = spark.createDataFrame([(1, "how do I aply to honours cs"), (2, "Hnoours, 2024?"), (3, "xyzzy"), (4, "Apply")],
                               "question_id long, question string")
    rows = {r["question_id"]: (r["corrected"], r["alert"]) for r in correct_questions(qs, words).collect()}
    assert rows == {1: ("how do I apply to honours cs", "Used spell/grammar corrected query: how do I apply to honours cs"),
                    2: ("Honours, 2024?", "Used spell/grammar corrected query: Honours, 2024?"), 3: ("xyzzy", None), 4: ("Apply", None)}
    assert set(spark.range(1).select(deletions(F.lit("abc"))).first()[0]) == {"abc", "ab", "ac", "bc", "a", "b", "c"}
    # against all pairs
    rng = random.Random(8)
    known = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))): rng.randint(1, 2000) for _ in range(120)}
    asked = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 8))) for _ in range(80)} - set(known))

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]
    want = {}
    for w in asked:
        near = [(-n * 1000 ** (2 - edits(w, k)), k) for k, n in known.items() if edits(w, k) <= (2 if len(w) > 4 else 1)]
        if near:
            want[w] = min(near)[1]
    found = best_words(spark.createDataFrame([(w,) for w in asked], "word string"), spark.createDataFrame(list(known.items()), "word string, n long"))
    assert {r["word"]: r["best"] for r in found.collect()} == want


def test_log_state_is_asked_without_a_call_per_event(spark, tmp_path):
    """A Python call for every event made the state the slowest step by far."""
    from leafgraph.operators.interactions import parse_questions
    from leafgraph.streaming.interactions import first_payloads, told_and_new

    (tmp_path / "in").mkdir()
    stream = told_and_new(spark.readStream.format("text").load(str(tmp_path / "in")), parse_questions)
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert stream.isStreaming and "Deduplicate" in plan and "TransformWithState" not in plan
    batch = spark.createDataFrame(
        [("1", "b", False), ("1", "a", False), ("1", None, True), ("2", "a", False), (None, "x", False), (None, "x", False)],
        "event_id string, value string, new boolean")
    assert sorted(r["value"] for r in first_payloads(batch).collect()) == ["a", "x", "x"]


def test_load_writes_texts_once(spark, tmp_path, monkeypatch):
    from leafgraph import session
    from leafgraph.plans import embedding_load as L
    from leafgraph.sources import store

    written = []

    def noted(df, label):
        table = session.materialize(df, label)
        written.append((label, "text" in df.columns))
        return table

    for module in (L, store):
        monkeypatch.setattr(module, "materialize", noted)
    rows = spark.createDataFrame([(i, "u", ["t", str(i % 2)], [], f"text {i % 3}", []) for i in range(6)],
                                 "doc_id long, url string, titles array<string>, parent_titles array<string>, text string, links array<struct<url:string>>")
    base = str(tmp_path / "v")
    assert L.load_vectors(rows.where("doc_id < 2"), base, 1, dim=16).collect()[0]["n_rows"] == 2
    assert L.load_vectors(rows, base, 2, dim=16).collect()[0]["n_rows"] == 6
    assert [label for label, has_text in written if has_text] == ["load-rows"] * 2
    cache = spark.read.parquet(f"{base}/cache")
    assert {(r["load"], r["count"]) for r in cache.groupBy("load").count().collect()} == {(1, 4), (2, 1)}
    assert cache.select("key").distinct().count() == 5
    assert spark.read.parquet(f"{base}/vectors").where("text_embedding is not null and title_embedding is not null").count() == 6

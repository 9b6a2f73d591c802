"""Reading the relation graph ``edges(src, dst, type)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafgraph import schemas as S
from leafgraph.session import discard, materialize


def related_docs(edges: DataFrame, ids: DataFrame, relation: int, in_only: bool = False, out_only: bool = False,
                 only_one: bool = False) -> DataFrame:
    """``(doc_id, related_id)`` of the given ``ids(doc_id)``; with ``only_one`` null unless there is exactly one."""
    ways = []
    if not out_only:
        ways.append(F.struct(F.col("dst").alias("doc_id"), F.col("src").alias("related_id")))
    if not in_only:
        ways.append(F.struct(F.col("src").alias("doc_id"), F.col("dst").alias("related_id")))
    both = edges.where(F.col("type") == relation).select(F.inline(F.array(*ways)))
    wanted = ids.select("doc_id").distinct()
    if not only_one:
        return both.join(wanted, "doc_id", "left_semi")
    counted = both.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("related_id").alias("related_id"))
    return wanted.join(counted, "doc_id", "left").select(
        "doc_id", F.when(F.col("n") == 1, F.col("related_id")).alias("related_id"))


def sibling_ids(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return related_docs(edges, ids, S.SIBLING)


def child_ids(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return related_docs(edges, ids, S.PARENT_EXTRACT, out_only=True)


def _only(links: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, value)`` of the keys that have exactly one value."""
    return links.groupBy(key).agg(F.count("*").alias("_n"), F.max(value).alias(value)).where("_n = 1").drop("_n")


def rank_lists(links: DataFrame) -> DataFrame:
    """``(id, head, place)`` of every node of simple lists ``links(src, dst)``: no node has two successors or two predecessors.

    Pointer doubling: each round a node looks twice as far ahead towards its head, so the longest list takes as many rounds as
    its length has binary digits. A list that closes into a ring begins at its smallest id. The joins of a round are merged: a
    broadcast would send the nodes through the driver once a round.
    """
    nodes = links.select(F.col("dst").alias("id"), F.col("src").alias("head"), F.lit(1).cast("long").alias("place"))
    heads = links.select(F.col("src").alias("id")).join(links.select(F.col("dst").alias("id")).hint("merge"), "id", "left_anti")
    nodes = nodes.unionByName(heads.select("id", F.col("id").alias("head"), F.lit(0).cast("long").alias("place")))
    first = materialize(nodes.withColumns({"least": F.least("id", "head"), "moved": F.lit(True)}), "lists")
    total, reach = first.count(), 1
    # a round holds the nodes that moved in the one before; what it leaves unmoved has reached its head and stays where it is
    moving, settled = first.where("moved"), first.where("NOT moved")
    while reach < 2 * total and not moving.isEmpty():
        ahead = settled.unionByName(moving).select(F.col("id").alias("head"), F.col("head").alias("_head"), F.col("place").alias("_place"),
                                                   F.col("least").alias("_least"))
        round_ = materialize(moving.join(ahead.hint("merge"), "head").select(
            "id", F.col("_head").alias("head"), (F.col("place") + F.col("_place")).alias("place"),
            F.least("least", "_least").alias("least"), (F.col("_head") != F.col("head")).alias("moved")), "lists")
        if reach == 1:
            discard(first)
            settled = round_.where("NOT moved")
        else:
            settled = settled.unionByName(round_.where("NOT moved"))
        moving = round_.where("moved")
        reach *= 2
    if reach >= 2 * total and not moving.isEmpty():
        opening = moving.where("id = least").select(F.col("id").alias("dst"))
        return rank_lists(materialize(links.join(opening, "dst", "left_anti").select("src", "dst"), "opened"))
    return settled.select("id", "head", "place")


class SplitChains:
    """Chains of split continuations in any graph: ids may run in any order and chains may cross pages.

    A document's predecessor is the only document that it continues, its successor the only one that continues it. Where both
    agree on a link, documents form lists, which are ranked once; where only one side is unique, a walk goes on from one list
    into another.
    """

    def __init__(self, edges: DataFrame):
        links = edges.where(F.col("type") == S.SPLIT_SIBLING).select("src", "dst").distinct()
        self.before, self.after = _only(links, "dst", "src"), _only(links, "src", "dst")
        mutual = materialize(self.before.join(self.after.hint("merge"), ["src", "dst"]).where("src <> dst"), "links")
        self.places = materialize(rank_lists(mutual), "places")
        step = mutual.select("src", "dst")
        self.back = materialize(self.before.join(step.hint("merge"), ["src", "dst"], "left_anti"), "back")  # from a head into another list
        self.on = materialize(self.after.join(step.hint("merge"), ["src", "dst"], "left_anti"), "on")

    def _located(self, rows: DataFrame) -> DataFrame:
        """``rows(doc_id, node)`` with the list of the node and its place; a node in no list is one of its own."""
        return rows.join(self.places.withColumnRenamed("id", "node"), "node", "left").select(
            "doc_id", F.coalesce("head", "node").alias("head"), F.coalesce("place", F.lit(0)).alias("place"))

    def _members(self, rows: DataFrame, keep: Column) -> DataFrame:
        lists = self.places.select(F.col("id").alias("member_id"), F.col("head").alias("_head"), F.col("place").alias("_place"))
        found = rows.join(lists, rows["head"] == F.col("_head"), "left").select(
            "doc_id", F.coalesce("member_id", "head").alias("member_id"), F.coalesce("_place", F.lit(0)).alias("_place"), "place")
        return found.where(keep).select("doc_id", "member_id", F.col("_place").alias("place"))

    def around(self, ids: DataFrame) -> DataFrame:
        """``(doc_id, position, member_id)``: the whole chain around each of ``ids(doc_id)``, itself included, in order."""
        here = materialize(self._located(ids.select("doc_id").distinct().withColumn("node", F.col("doc_id"))), "here")
        parts = [self._members(here, F.lit(True)).withColumn("step", F.lit(0))]
        ways = ((-1, self.back, "dst", "src", F.col("_place") <= F.col("place"), lambda rows: rows.select("doc_id", F.col("head").alias("dst"))),
                (1, self.on, "src", "dst", F.col("_place") >= F.col("place"), self._tails))
        for sign, links, key, value, keep, leave in ways:
            frontier, seen, step = here, here.select("doc_id", "head"), 0
            while True:
                step += sign
                onward = leave(frontier).join(links, key).select("doc_id", F.col(value).alias("node"))
                frontier = self._located(onward).join(seen, ["doc_id", "head"], "left_anti")  # a walk in a circle ends
                frontier = materialize(frontier, "frontier")
                if frontier.isEmpty():
                    break
                seen = seen.union(frontier.select("doc_id", "head"))
                parts.append(self._members(frontier, keep).withColumn("step", F.lit(step)))
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        place = F.row_number().over(Window.partitionBy("doc_id").orderBy("step", "place"))
        return rows.select("doc_id", place.alias("position"), "member_id")

    def _tails(self, rows: DataFrame) -> DataFrame:
        last = self.places.groupBy("head").agg(F.max_by("id", "place").alias("_tail"))
        return rows.join(last, "head", "left").select("doc_id", F.coalesce("_tail", "head").alias("src"))


def split_siblings(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """``(doc_id, position, member_id)``: the whole ordered chain around each given document, itself included."""
    return SplitChains(edges).around(ids)


def docs_by_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")


def combine_siblings(hits: DataFrame, edges: DataFrame, texts: DataFrame) -> DataFrame:
    """Hits with the text of their whole chain, joined by blanks; the last title goes.

    The chain is bounded by one section of one page. Documents with the same chain share its text: it is put together once,
    from texts that are fetched once per chain, and goes to the documents by the last join, which leaves it where it is.
    """
    place = F.struct("position", "member_id")
    chains = split_siblings(edges, hits).groupBy("doc_id").agg(F.array_sort(F.collect_list(place)).alias("_chain"))
    chains = materialize(chains.withColumn("_key", F.md5(F.to_json("_chain"))), "chains")
    members = chains.dropDuplicates(["_key"]).select("_key", F.inline("_chain"))
    whole = (members.join(texts.select(F.col("doc_id").alias("member_id"), F.col("text").alias("_part")), "member_id")
             .groupBy("_key").agg(F.array_join(F.transform(
                 F.array_sort(F.collect_list(F.struct("position", "_part"))), lambda x: x["_part"]), " ").alias("text")))
    out = hits.drop("text").join(chains.select("doc_id", "_key"), "doc_id", "left").join(whole, "_key", "left").drop("_key")
    if "titles" in out.columns:
        out = out.withColumn("titles", F.slice("titles", 1, F.greatest(F.size("titles") - 1, F.lit(0))))
    return out

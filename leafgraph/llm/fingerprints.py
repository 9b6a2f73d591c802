"""Homomorphic multiset fingerprints of documents; columns and SQL functions only.

A text is the multiset of its pieces (its paragraphs, cut further after sentences). Each piece is hashed to a wide vector
and a fingerprint is the sum of the vectors, each of the ``WORDS`` words modulo 2^60. So equal multisets have equal
fingerprints in any order, the fingerprint of a union is the sum, and pieces are inserted or deleted by adding or
subtracting their vectors (:func:`plus`, :func:`minus`).

The first four words are full-width hashes and make different multisets collide with a chance of about 2^-240. The others
hold two counters of 30 bits each: the bits of two more hashes of the piece, 120 in all, counted over the pieces. A text has at
most 2^30 pieces, as it has fewer than 2^31 bytes, so no counter runs over. As a bit is one or zero with equal chance, the counters are a random projection of the multiset, and the likeness of two texts, twice
the inner product of their piece counts over the sum of their squares, can be read from two fingerprints alone. It is exact
for equal multisets and has a standard error of about 0.09 else. The last word counts pieces.

Each hash is seeded before it reads the piece, so pieces that collide in one are apart in the others.

A fingerprint is a fold over the row's own pieces: no shuffle, and any length of text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgraph.operators.numbering import number_rows
from leafgraph.session import materialize

FULL = 4
PACKED = 60            # words of two counters: two hashes of 30 words each
WORDS = FULL + PACKED + 1
MODULUS = (1 << 60) - 1
ONES = 1 | 1 << 30
LANE = (1 << 30) - 1


def pieces(text: Column) -> Column:
    """Non-empty lines, cut after a full stop, question or exclamation mark that a blank follows."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\n|(?<=[.!?]) "), lambda p: p != "")


def fingerprint(text: Column) -> Column:
    """``WORDS`` longs; all zero for a text without pieces."""
    def of(hashes: list[Column]) -> Column:
        def total(h: Column, value) -> Column:
            return F.aggregate(h, F.lit(0).cast("long"), lambda acc, x: (acc + value(x)).bitwiseAND(F.lit(MODULUS)))

        full = [total(h, lambda x: x.bitwiseAND(F.lit(MODULUS))) for h in hashes[:FULL]]
        packed = [total(h, lambda x, j=j: F.shiftright(x, j).bitwiseAND(F.lit(ONES)))
                  for h in hashes[FULL:] for j in range(30)]
        return F.array(*full, *packed, F.size(hashes[0]).cast("long"))

    def vector(own: Column) -> Column:
        def hashed(seed: int) -> Column:
            return F.transform(own, lambda p: F.xxhash64(F.lit(seed), p))

        names = [f"h{seed}" for seed in range(FULL + PACKED // 30)]
        bound = F.array(F.struct(*(hashed(seed).alias(name) for seed, name in enumerate(names))))
        return F.transform(bound, lambda b: of([b[name] for name in names]))[0]

    # lambda variables over one-element arrays, so that pieces and hashes are made once
    return F.transform(F.array(pieces(text)), vector)[0]


def plus(left: Column, right: Column) -> Column:
    """Fingerprint of both multisets together: insertion."""
    return F.zip_with(left, right, lambda x, y: (x + y).bitwiseAND(F.lit(MODULUS)))


def minus(left: Column, right: Column) -> Column:
    """Fingerprint without the pieces of ``right``: deletion."""
    return F.zip_with(left, right, lambda x, y: (x - y).bitwiseAND(F.lit(MODULUS)))


def likeness(left: Column, right: Column) -> Column:
    """0 to 1, from two fingerprints: 1 if they are equal, about 0 if no piece is common.

    Two texts without pieces are alike; with one such text the likeness is 0.
    """
    def centred(f: Column) -> Column:
        n = F.element_at(f, WORDS)
        counters = F.flatten(F.transform(F.slice(f, FULL + 1, PACKED), lambda w: F.array(
            *(F.shiftright(w, s).bitwiseAND(F.lit(LANE)) for s in (0, 30)))))
        return F.transform(counters, lambda c: (2 * c - n).cast("double"))

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)

    bound = F.array(F.struct(centred(left).alias("x"), centred(right).alias("y")))
    ratio = F.transform(bound, lambda b: 2 * dot(b["x"], b["y"]) / F.greatest(dot(b["x"], b["x"]) + dot(b["y"], b["y"]),
                                                                             F.lit(1e-9)))[0]
    return F.when(left == right, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio)))


def as_text(f: Column) -> Column:
    """15 hexadecimal digits per word."""
    return F.array_join(F.transform(f, lambda w: F.lower(F.lpad(F.hex(w), 15, "0"))), "")


def followers(keys: DataFrame) -> DataFrame:
    """``keys`` (doc_id, h, n) with the one before in descending doc_id as by_doc, by_h, by_n; before the first: the last.

    Ties are ordered by ``h``, null ids come last. Keys are numbered by ranges, whatever their ids look like, and each meets the
    key of the number before its own.
    """
    down = keys.withColumns({"_none": F.col("doc_id").isNull(), "_down": F.bitwise_not("doc_id")})
    rows = materialize(number_rows(down, "_none", "_down", "h", name="_no").drop("_none", "_down"), "order")
    total = rows.agg(F.count("*").alias("total")).scalar()
    before = rows.select(F.col("_no").alias("_at"), F.col("doc_id").alias("by_doc"), F.col("h").alias("by_h"), F.col("n").alias("by_n"))
    return rows.withColumn("_at", F.pmod(F.col("_no") - 1, total)).join(before, "_at").select("doc_id", "h", "by_doc", "by_h", "by_n")


def edited_fingerprints(documents: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and what their likeness says.

    The edited text has the last third of the text's characters (rounded down) replaced by as many first ones of the next
    document in descending doc_id. Columns: doc_id, n_chars, edited, fingerprint, edited_fingerprint (arrays), near_edited,
    near_next. A null text is empty. A null ``doc_id`` comes last, among equal ids the order is by a hash of the text;
    repeated rows (same id and text) stand at one place of the order and get the same result each. Other columns are
    ignored; an empty table gives no rows.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("h", F.xxhash64("text"))
    keys = texts.select("doc_id", "h", F.length("text").alias("n")).distinct()
    order = followers(keys).select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "by_doc", "by_h", "by_n")

    same = texts.doc_id.eqNullSafe(F.col("d")) & (texts.h == F.col("g"))
    heads = texts.join(order, same).select("by_doc", "by_h", F.expr("substring(text, 1, by_n div 3)").alias("head"),
                                           fingerprint(F.col("text")).alias("next")).dropDuplicates(["by_doc", "by_h"])
    n = F.length("text").cast("long")
    rows = texts.join(heads, texts.doc_id.eqNullSafe(F.col("by_doc")) & (texts.h == F.col("by_h")))
    rows = rows.select("doc_id", n.alias("n_chars"), F.concat(
        F.expr("substring(text, 1, length(text) - length(text) div 3)"), "head").alias("edited"),
        fingerprint(F.col("text")).alias("fingerprint"), "next")
    rows = rows.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return rows.select("doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint",
                       likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                       likeness(F.col("fingerprint"), F.col("next")).alias("near_next"))

"""Explicit schemas of the tables that are read from or written to storage."""

from __future__ import annotations

from pyspark.sql import types as T

LINK = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("doc_id", T.LongType()),
])

EXTRACTS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("page_id", T.LongType()),
    T.StructField("sec_no", T.LongType()),
    T.StructField("parent_sec", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("parent", T.LongType()),
    T.StructField("titles", T.ArrayType(T.StringType())),
    T.StructField("parent_titles", T.ArrayType(T.StringType())),
    T.StructField("text", T.StringType()),
    T.StructField("links", T.ArrayType(LINK)),
    T.StructField("context", T.StringType()),
    T.StructField("split_idx", T.IntegerType()),
    T.StructField("n_chunks", T.LongType()),
    T.StructField("faculty", T.StringType()),
    T.StructField("program", T.StringType()),
    T.StructField("specialization", T.ArrayType(T.StringType())),
    T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
    T.StructField("orig_doc", T.StringType()),
    T.StructField("last_modified", T.TimestampType()),
    T.StructField("site", T.StringType()),
])

EDGES = T.StructType([
    T.StructField("src", T.LongType()),
    T.StructField("dst", T.LongType()),
    T.StructField("type", T.IntegerType()),
])

VECTORS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("titles", T.ArrayType(T.StringType())),
    T.StructField("text", T.StringType()),
    T.StructField("links", T.ArrayType(T.StringType())),
    T.StructField("text_embedding", T.ArrayType(T.FloatType())),
    T.StructField("title_embedding", T.ArrayType(T.FloatType())),
])

QUESTION_LOG = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("context", T.StringType()),
    T.StructField("answer", T.StringType()),
    T.StructField("reference_ids", T.ArrayType(T.LongType())),
    T.StructField("logged_at", T.TimestampType()),
])

# Field names of a submitted feedback form (fixed values of the data format).
FEEDBACK_PAYLOAD = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("feedback-hidden-helpful", T.StringType()),
    T.StructField("feedback-hidden-question", T.StringType()),
    T.StructField("feedback-hidden-context", T.StringType()),
    T.StructField("feedback-hidden-reference-ids", T.StringType()),
    T.StructField("feedback-hidden-response", T.StringType()),
    T.StructField("feedback-reference-select", T.StringType()),
    T.StructField("feedback-comments", T.StringType()),
    T.StructField("logged_at", T.TimestampType()),
])

VECTOR_CACHE = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("load", T.IntegerType()),
])

UPDATE_LOG = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("datetime", T.TimestampType()),
])

# Relation kinds of an edge (fixed values).
PARENT_PAGE = 1
PARENT_EXTRACT = 2
LINK_TO = 3
SIBLING = 4
SPLIT_SIBLING = 5

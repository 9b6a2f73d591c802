"""Byte-level BPE, encoded in linear time by backtracking over longest matches, and decoded.

A token sequence is what the merges give for a text exactly if every two adjacent tokens are what the merges give for
their joined bytes. So no merge is replayed on a text: an automaton over the vocabulary (bytes mapped to Latin-1 for
``ahocorasick``) yields the tokens that start at each place, the encoder takes the longest one compatible with the token
before it, and steps back where nothing fits. A place that led nowhere is never tried again, which bounds the work by the
text's length. Whether two tokens are compatible is worked out once per pair and remembered.

Text is first cut by the pattern of the vocabulary; a piece that is a token is that token. Stretches between places where the
pattern always cuts repeat, so those of a block of texts are encoded once each, and the ones that come again are remembered
within a bound of bytes, for a task (:mod:`leafgraph.llm.segments`). Narrow: no shuffle, one pass over the texts.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgraph.llm.segments import StretchEncoder
from leafgraph.llm.texts import blocks

PAIRS = 200_000  # pairs of tokens whose compatibility is remembered per worker
ROOM = 48 << 20  # bytes of remembered stretches per worker
BLOCK = 4 << 20  # bytes of text encoded at once


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens by rank from a ``.tiktoken`` file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The merges replayed one by one; for short byte strings only."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best:best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


class BytePairCodec:
    """Encoder and decoder for one vocabulary of ranks; every single byte must be a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
            if len(token) == 1 or merge(token, ranks) == [rank]:  # others never come out of merges
                self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.compatible = lru_cache(maxsize=PAIRS)(self._compatible)
        # other patterns may cut elsewhere, so whole texts are cut by them alone
        self.stretches = StretchEncoder(self._learn, ROOM) if pattern == public_tokenizers.PATTERN else None
        self.tokens = pa.array(self.bytes_of, pa.large_binary())

    def _compatible(self, left: int, right: int) -> bool:
        return merge(self.bytes_of[left] + self.bytes_of[right], self.ranks) == [left, right]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        starts: list[list[tuple[int, int]]] = [[] for _ in piece]
        for end, (length, rank) in self.automaton.iter(piece.decode("latin-1")):
            starts[end - length + 1].append((length, rank))  # ends ascend, so each list is shortest first
        n, at, ids, left = len(piece), 0, [], [list(starts[0])]
        dead = bytearray(n + 1)
        while at < n:
            options = left[-1]
            while options:
                length, rank = options.pop()
                if not dead[at + length] and (not ids or self.compatible(ids[-1], rank)):
                    ids.append(rank)
                    at += length
                    left.append(list(starts[at]) if at < n else [])
                    break
            else:
                dead[at] = 1
                left.pop()
                at -= len(self.bytes_of[ids.pop()])
        return ids

    def encode_segment(self, segment: str) -> bytes:
        """Little-endian 32-bit ids of a stretch of text, cut by the pattern."""
        ids: list[int] = []
        for piece in self.pattern.findall(segment):
            ids += self.encode_piece(piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def forget(self) -> None:
        """Give the memory of stretches and pairs back at the end of a task."""
        self.compatible.cache_clear()
        if self.stretches is not None:
            self.stretches.forget()

    def _learn(self, keys: list[bytes]) -> list[bytes]:
        return [self.encode_segment(key.decode()) for key in keys]

    def encode_block(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (one more for the end)."""
        if self.stretches is not None:
            return self.stretches.encode(offsets, data)
        raw = data.tobytes()
        each = [self.encode_segment(raw[a:b].decode()) for a, b in zip(offsets[:-1], offsets[1:])]
        return np.frombuffer(b"".join(each), "<u4"), np.concatenate([[0], np.cumsum([len(x) // 4 for x in each])]).astype(np.int64)

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a whole text."""
        raw = np.frombuffer(text.encode(), np.uint8)
        return self.encode_block(np.array([0, len(raw)]), raw)[0].tobytes()

    def decode_block(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that the ids stand for, and where each text's begin, from where its ids begin."""
        if not len(ids):
            return np.zeros(0, np.uint8), np.zeros(len(at), np.int64)
        found = self.tokens.take(pa.array(ids))
        ends = np.frombuffer(found.buffers()[1], np.int64)[:len(ids) + 1]
        return np.frombuffer(found.buffers()[2], np.uint8)[:ends[-1]], ends[at]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for."""
        whole = np.frombuffer(ids, "<u4")
        return self.decode_block(whole, np.array([0, len(whole)]))[0].tobytes()


def _binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Slices of a row of bytes as an array, without objects in between."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [
        None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> BytePairCodec:
    """The codec of a rank file, built once per worker."""
    return BytePairCodec(read_ranks(path), pattern)


def encode_documents(documents: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN
                     ) -> DataFrame:
    """doc_id, ids (binary, little-endian 32-bit) and decoded (binary) of every text.

    A null text is empty: no ids. Rows are independent: a repeated row is encoded again, a null ``doc_id`` stays null, and
    columns other than ``doc_id`` and ``text`` are ignored. Texts may be of any length: a task holds a block of whole texts,
    or one longer text. An empty table gives no rows. ``path`` names a file of ranks present on every machine.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for row, end, offsets, data in blocks(batch.column("text"), BLOCK):  # bounds what a task holds at once
                ids, at = own.encode_block(offsets, data)
                back, places = own.decode_block(ids, at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, end - row), _binaries(np.ascontiguousarray(ids).view(np.uint8), 4 * at),
                     _binaries(back, places)], ["doc_id", "ids", "decoded"])
        own.forget()

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, ids binary, decoded binary")


def digest_documents(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the encoding and the decoded bytes as digests."""
    return encode_documents(documents, path).select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

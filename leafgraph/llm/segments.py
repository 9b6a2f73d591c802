"""Texts cut where the pattern of a byte-level vocabulary always cuts, so that equal stretches are encoded once.

The pattern takes letters, digits, other visible characters and white space in separate pieces, with one blank before a
visible run. A new piece therefore always begins before white space that follows a visible character, after a newline that
stands alone between visible characters, and where ASCII letters, digits and signs meet (an apostrophe apart, as it begins
contractions). A stretch between such places is encoded alike wherever it stands. Places where a character might be white
space beyond ASCII are never cut.

The stretches of a block of texts become one dictionary array; only its values are encoded, and those that repeat are
remembered within a bound of bytes.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa

ROOM = 96 << 20  # bytes of remembered stretches per worker
_OTHER, _LETTER, _DIGIT, _SIGN, _MARK, _BLANK, _WIDE = range(7)

_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[33:127] = _SIGN
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[ord("'")] = _MARK
_CLASS[[9, 10, 11, 12, 13, 32]] = _BLANK
_CLASS[128:] = _WIDE
_VISIBLE = np.isin(np.arange(7), [_LETTER, _DIGIT, _SIGN, _MARK])
_PLAIN = np.isin(np.arange(7), [_LETTER, _DIGIT, _SIGN])
#: First bytes of the characters beyond ASCII that can be white space, of two and of three bytes.
_TWO, _THREE = 0xC2, (0xE1, 0xE2, 0xE3)


def cut(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Where stretches begin: at every text that isn't empty, and at every place of it where a piece always begins."""
    begins = np.zeros(len(data), bool)
    if len(data) > 1:
        kind = _CLASS[data]
        before, here = kind[:-1], kind[1:]
        plain = _PLAIN[kind]
        begins[1:] = plain[:-1] & plain[1:] & (before != here)
        ends = _VISIBLE[before]
        wide = np.flatnonzero((before == _WIDE) & (here == _BLANK))  # the last byte of a character
        unsure = (data[np.maximum(wide - 1, 0)] == _TWO) | np.isin(data[np.maximum(wide - 2, 0)], _THREE)
        ends[wide[~unsure]] = True
        begins[1:] |= (here == _BLANK) & ends
        newline = np.flatnonzero(data[:-1] == 10)
        newline = newline[(newline > 0) & _VISIBLE[here[newline]] & _VISIBLE[kind[newline - 1]]]
        begins[newline + 1] = True
    starts = offsets[:-1]
    begins[starts[starts < offsets[1:]]] = True
    return np.flatnonzero(begins)


class StretchEncoder:
    """Ids of whole texts by ``learn``, which gives the little-endian 32-bit ids of each of many stretches."""

    def __init__(self, learn: Callable[[list[bytes]], list[bytes]], room: int = ROOM):
        self.learn, self.room, self.used = learn, room, 0
        self.known: dict[bytes, bytes] = {}

    def forget(self) -> None:
        """Give the memory back; workers outlive their tasks."""
        self.known, self.used = {}, 0

    def encode(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (one more for the end)."""
        starts = cut(offsets, data)
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64)
        places = np.append(starts, len(data)).astype(np.int64)
        parts = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(data)])
        coded = parts.dictionary_encode()
        keys, at = coded.dictionary.to_pylist(), coded.indices
        ids = list(map(self.known.get, keys))
        new = [i for i, x in enumerate(ids) if x is None]
        repeats = np.bincount(at.to_numpy(), minlength=len(keys)) > 1
        if self.used > self.room:
            self.known.clear()
            self.used = 0
        for i, own in zip(new, self.learn([keys[i] for i in new])):
            ids[i] = own
            if repeats[i] and len(own) < 400:
                self.known[keys[i]] = own
                self.used += len(own) + len(keys[i]) + 200
        found = pa.array(ids, pa.large_binary()).take(at)
        ends = np.frombuffer(found.buffers()[1], np.int64)[found.offset:found.offset + len(found) + 1]
        raw = np.frombuffer(found.buffers()[2], "<u4") if ends[-1] else np.zeros(0, "<u4")
        return raw[ends[0] // 4:ends[-1] // 4], (ends // 4)[np.searchsorted(starts, offsets)] - ends[0] // 4


class TextEncoder:
    """Ids by the ``tokenizers`` library. As by its default, the string of an added token in a text becomes that token's id;
    with ``special_as_text`` special tokens are ordinary text.

    Only for a byte-level vocabulary without a normaliser are texts cut; for any other, and for a block that holds the
    string of an added token, each text goes to the library as it stands.
    """

    def __init__(self, path: str, special_as_text: bool = False, room: int = ROOM):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.size = self.tokenizer.get_vocab_size()
        added = [t for t in self.tokenizer.get_added_tokens_decoder().values() if not (special_as_text and t.special)]
        self.added = [t.content.encode() for t in added]
        with open(path, encoding="utf-8") as file:
            form = json.load(file)
        kind = form["pre_tokenizer"] or {}
        self.cuts = (form["normalizer"] is None and form["post_processor"] is None and kind.get("type") == "ByteLevel"
                     and kind.get("use_regex", True) and not kind.get("add_prefix_space", True))
        newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.newline = newline[0] if len(newline) == 1 else None
        self.stretches = StretchEncoder(self._learn, room)

    def _one(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, keys: list[bytes]) -> list[bytes]:
        """Many stretches as the lines of one text, where their ids stand between those of the newline."""
        out: list[bytes | None] = [None] * len(keys)
        lines, at = [], []
        for i, key in enumerate(keys):
            text = key.decode()
            inner = text[1:] if text[0] == " " else text
            if self.newline is not None and inner and not (inner[0].isspace() or inner[-1].isspace() or "\n" in inner):
                lines.append(text)
                at.append(i)
            else:
                out[i] = self._one(text)
        for k in range(0, len(lines), 1000):
            some = lines[k:k + 1000]
            ids = np.array(self.tokenizer.encode("\n".join(some), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(ids == self.newline).tolist() + [len(ids)]
            raw, begin = ids.tobytes(), 0
            for i, end in zip(at[k:k + 1000], ends, strict=True):
                out[i] = raw[4 * begin:4 * end]
                begin = end + 1
        return out

    def encode(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (one more for the end)."""
        raw = data.tobytes() if self.added else b""
        if self.cuts and not any(a in raw for a in self.added):
            return self.stretches.encode(offsets, data)
        raw = raw or data.tobytes()
        each = [self._one(raw[a:b].decode()) for a, b in zip(offsets[:-1], offsets[1:])]
        ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in each], dtype=np.int64)])
        return np.frombuffer(b"".join(each), "<u4"), ends


@lru_cache(maxsize=2)
def text_encoder(path: str, special_as_text: bool = False) -> TextEncoder:
    """One encoder per worker."""
    return TextEncoder(path, special_as_text)

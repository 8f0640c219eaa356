"""Byte-level BPE over Arrow text columns, with the ``tokenizers`` library's own ids.

A byte-level BPE splits a text into pre-tokens and encodes each by itself.  The
library encodes every *distinct* pre-token once; numpy finds the pre-tokens of a
block of documents and puts their ids together.  The classes of characters come
from the library's own pre-tokenizer, one probe for each distinct character.
As in the library, strings of added tokens are found first: each is its token, and
what is between them is encoded by itself.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa

from codeloom.llm.common import held, text_steps
from codeloom.llm.textkernel import PART_BYTES, gather, parts, slice_hashes

_LETTER, _DIGIT, _OTHER, _SPACE, _UNKNOWN = range(5)
_ONE, _TWO = tuple(map(ord, "stmd")), tuple(tuple(map(ord, x)) for x in ("re", "ve", "ll"))


def byte_of_symbol() -> dict[str, int]:
    """The public byte-to-printable-character map of byte-level vocabularies, inverted."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Encoder of one worker; ``keep`` bounds the pre-tokens whose ids it remembers."""

    def __init__(self, path: str, keep: int = 500_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        kind = json.loads(self.library.to_str())
        pre = kind["pre_tokenizer"] or {}
        if kind["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError(f"{path}: only byte-level BPE without a normaliser or a prefix space is taken")
        self.size = self.library.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        symbols = byte_of_symbol()
        self.token_bytes = np.zeros(self.size, np.int64)
        added = self.library.get_added_tokens_decoder().values()
        if any(x.lstrip or x.rstrip or x.single_word for x in added) or len({x.normalized for x in added}) > 1:
            raise ValueError(f"{path}: only added tokens that stand for their own strings anywhere are taken")
        special = {x.content for x in added}
        # of several at one place the longest is taken
        self.cut = not any(c.isspace() for x in special for c in x)  # long texts may be cut before white space
        self.added = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        for token, i in self.library.get_vocab().items():
            self.token_bytes[i] = len(token.encode()) if token in special else sum(c in symbols for c in token)
        self.classes = np.full(0x110000, _UNKNOWN, np.uint8)
        self.keep = keep
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slots = np.zeros(0, np.int64)
        self.flat = np.zeros(1 << 16, self.dtype)
        self.used = 0
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)

    def _class(self, c: int) -> int:
        one = lambda s: len(self.library.pre_tokenizer.pre_tokenize_str(s)) == 1
        return next((k for k, x in ((_LETTER, "a"), (_DIGIT, "1"), (_OTHER, "!")) if one(x + chr(c))), _SPACE)

    def pretokens(self, code: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Starts of the pre-tokens of the characters ``code``; ``first`` marks the starts of documents."""
        kind = self.classes[code]
        if (kind == _UNKNOWN).any():
            for c in np.unique(code[kind == _UNKNOWN]):
                self.classes[c] = self._class(int(c))
            kind = self.classes[code]
        white = kind == _SPACE
        start = first.copy()
        start[1:] |= kind[1:] != kind[:-1]
        joined = np.zeros(len(code), bool)  # a space goes with what follows it
        joined[1:] = (code[:-1] == 32) & ~white[1:] & ~first[1:]
        start &= ~joined
        # the last of several white characters before a word stands apart
        start[1:-1] |= white[1:-1] & white[:-2] & ~first[1:-1] & ~white[2:] & ~first[2:]
        at = np.flatnonzero(start & (code == 39))
        n = len(code)
        at = at[at + 1 < n]
        at = at[~first[at + 1]]
        if len(at):
            second = code[at + 1]
            third = np.where((at + 2 < n) & ~first[np.minimum(at + 2, n - 1)], code[np.minimum(at + 2, n - 1)], 0)
            width = np.where(np.isin(second, _ONE), 2, 0)
            for a, b in _TWO:
                width[(second == a) & (third == b)] = 3
            at, width = at[width > 0], width[width > 0]
            start[at + 1] = False
            start[at[width == 3] + 2] = False
            after = (at + width)[at + width < n]
            start[after] = True
        return np.flatnonzero(start)

    def added_tokens(self, text: str, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the added tokens in the documents that start at ``first``."""
        found = []
        m = self.added.search(text) if self.added else None
        while m:
            s, e = m.span()
            whole = not first[s + 1 : e].any()  # else it is put together from the ends of documents
            if whole:
                found.append((s, e))
            m = self.added.search(text, e if whole else s + 1)
        return tuple(np.array(found, np.int64).reshape(-1, 2).T)

    def encode_step(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a step joined, and the bounds of each document's ids."""
        if self.cut and len(offsets) == 2 and len(data) > 2 * PART_BYTES:
            ids = np.concatenate([self._encode(data[a:b], np.array([0, b - a]))[0] for a, b in parts(data)])
            return ids, np.array([0, len(ids)])
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(len(offsets), np.int64)
        return self._encode(data, offsets)

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text = data.tobytes().decode("utf-8")
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if len(code) == len(data):
            bounds = offsets
        else:
            chars = np.zeros(len(data) + 1, np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
            bounds = chars[offsets]
        first = np.zeros(len(code) + 1, bool)
        first[bounds] = True
        special, after = self.added_tokens(text, first)
        first[special] = first[after] = True
        starts = self.pretokens(code, first[:-1])
        if len(special):
            k = np.searchsorted(special, starts, "right") - 1
            starts = starts[(k < 0) | (starts == special[k]) | (starts >= after[k])]
        ends = np.append(starts[1:], len(code))
        found, where, back = np.unique(slice_hashes(code, starts, ends), return_index=True, return_inverse=True)
        slot = self._slots(found, where, starts, ends, text)[back]
        lengths = self.lengths[slot]
        ids = gather(self.flat, self.starts[slot], lengths)
        total = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=total[1:])
        return ids, total[np.searchsorted(starts, bounds)]

    def _slots(self, found: np.ndarray, where: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: str) -> np.ndarray:
        if len(self.keys) > self.keep:
            self._forget()
        at = np.searchsorted(self.keys, found)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == found[known]
        if not known.all():
            new = where[~known]
            got = self.library.encode_batch_fast([text[s:e] for s, e in zip(starts[new].tolist(), ends[new].tolist(), strict=True)], add_special_tokens=False)
            ids = [x.ids for x in got]
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for x in ids for i in x), self.dtype, int(lengths.sum()))
            while self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : self.used + len(flat)] = flat
            slots = np.arange(len(self.starts), len(self.starts) + len(new))
            self.starts = np.concatenate([self.starts, self.used + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.used += len(flat)
            put = at[~known]
            self.keys = np.insert(self.keys, put, found[~known])
            self.slots = np.insert(self.slots, put, slots)
            at = np.searchsorted(self.keys, found)
        return self.slots[at]

    def encode_column(self, col: pa.Array):
        """(first row, end row, bytes, offsets, ids, bounds) for steps of a text column."""
        for i, j, data, offsets in text_steps(col):
            yield i, j, data, offsets, *self.encode_step(data, offsets)


def encoder(path: str) -> ByteBpe:
    """This worker's encoder for the vocabulary file ``path``."""
    return held(("byte_bpe", path), lambda: ByteBpe(path))

"""SentencePiece encoding that keeps the byte span of every piece, and decoding.

The normaliser of the model is applied here: at each place the longest prefix that the
model's compiled character map (a double-array trie and its replacements) knows is
replaced, and each byte of the outcome remembers the source span it came from.  White
space rules of the model (prefix, escape, removal of extra spaces) keep that record.
The library segments the text; the pieces tile the normalised bytes, so running sums
of piece lengths, sent through the record, are spans of the original bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import held, small_batches

_META = "▁".encode()
SCHEMA = "doc_id long, n_tokens long, ids binary, starts binary, ends binary, decoded string"


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message."""
    i = 0

    def number() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = raw[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < len(raw):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            n = number() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, raw[i : i + n]
            i += n


class CharMap:
    """The compiled map: bytes to the longest known prefix and its replacement."""

    def __init__(self, blob: bytes) -> None:
        (size,) = struct.unpack_from("<I", blob)
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.texts = blob[4 + size :]

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of raw[at:] and what replaces it."""
        units = self.units
        offset = lambda u: (u >> 10) << ((u & 512) >> 6)
        node, found = offset(units[0]), None
        for i in range(at, len(raw)):
            node ^= raw[i]
            if node >= len(units) or units[node] & 0x800000FF != raw[i]:
                break
            u = units[node]
            node ^= offset(u)
            if u >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]


class Model:
    """A model file: the library's processor, the normaliser's rules, the bytes of each piece."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        with open(path, "rb") as f:
            raw = f.read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        pieces, rules = [], {}
        for k, v in fields(raw):
            if k == 1:
                pieces.append(dict(fields(v)))
            elif k == 3:
                rules = dict(fields(v))
        blob = rules.get(2, b"")
        self.map = CharMap(blob) if blob else None
        self.prefix, self.squeeze, self.escape = (bool(rules.get(k, 1)) for k in (3, 4, 5))
        kinds = [p.get(3, 1) for p in pieces]  # 1 normal, 2 unknown, 3 control, 4 user, 5 unused, 6 byte
        self.lengths = np.array([0 if k in (2, 3) else 1 if k == 6 else len(p[1]) for p, k in zip(pieces, kinds, strict=True)], np.int64)
        self.unknown = kinds.index(2) if 2 in kinds else -1

    def normalise(self, raw: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The normalised bytes; for each the start and end of the source bytes it stands for."""
        space = _META if self.escape else b" "
        if self.map is None and not self.squeeze:
            if not raw:
                return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
            data = np.frombuffer(raw, np.uint8)
            at = np.repeat(np.arange(len(data)), np.where(data == 32, len(space), 1))
            out, end = raw.replace(b" ", space), at + 1
            if self.prefix:
                none = np.zeros(len(space), np.int64)
                out, at, end = space + out, np.concatenate([none, at]), np.concatenate([none, end])
            return out, at, end
        parts: list[tuple[bytes, int, int]] = []
        i = 0
        while i < len(raw):
            hit = self.map.longest(raw, i) if self.map else None
            n = hit[0] if hit else 1 + (raw[i] >= 0xC0) + (raw[i] >= 0xE0) + (raw[i] >= 0xF0)
            parts.append((hit[1] if hit else raw[i : i + n], i, i + n))
            i += n
        out, starts, ends = bytearray(), [], []
        before = self.squeeze  # spaces at the start go
        if self.prefix and any(x.strip(b" ") for x, _, _ in parts):
            out += space
            starts += [0] * len(space)
            ends += [0] * len(space)
        for x, s, e in parts:
            for c in (x[k : k + 1] for k in range(len(x))):
                if c == b" " and before and self.squeeze:
                    continue
                before = c == b" "
                c = space if before else c
                out += c
                starts += [s] * len(c)
                ends += [e] * len(c)
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :], starts[-len(space) :], ends[-len(space) :]
        return bytes(out), np.array(starts, np.int64), np.array(ends, np.int64)

    def spans(self, raw: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Start and end in ``raw`` of each piece; control pieces and the added prefix are empty spans.

        None if several pieces are unknown ones, whose lengths the ids don't tell.
        """
        norm, start, end = self.normalise(raw)
        n = self.lengths[ids]
        if self.unknown >= 0 and (free := np.flatnonzero(ids == self.unknown)).size:
            if len(free) > 1:
                return None
            n[free] = len(norm) - n.sum()
        hi = np.cumsum(n)
        if (hi[-1] if len(hi) else 0) != len(norm):
            raise ValueError("pieces do not tile the normalised text")
        lo = hi - n
        start, end = np.append(start, len(raw)), np.append(end, len(raw))
        first = start[lo]
        return first, np.where(n > 0, np.maximum(end[np.maximum(hi - 1, 0)], first), first)


def model(path: str) -> Model:
    return held(("piece_bpe", path), lambda: Model(path))


def encode_decode(docs: DataFrame, path: str, begin: bool = True, end: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids, starts, ends, decoded.

    ``ids``, ``starts`` and ``ends`` are little-endian unsigned 32-bit integers: the piece
    and its span in the UTF-8 bytes of the text.  Null and empty texts have the control
    ids alone and decode to the empty text.  Repeated rows are encoded each for itself,
    null ids stay null, other columns are left out.  Spans are null where a model without
    byte pieces leaves several pieces unknown.  A text is held whole, whatever its length.
    """
    small_batches(docs.sparkSession, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for k in range(0, len(texts), 64):
                part = texts[k : k + 64]
                encoded = m.library.encode(part, add_bos=begin, add_eos=end, num_threads=1)
                decoded = m.library.decode(encoded, num_threads=1)
                ids = [np.array(x, "<u4") for x in encoded]
                spans = [m.spans(t.encode(), x) or (None, None) for t, x in zip(part, ids, strict=True)]
                columns = [pa.array([len(x) for x in ids], pa.int64()), *(pa.array([None if x is None else x.astype("<u4").tobytes() for x in y], pa.binary()) for y in (ids, [s for s, _ in spans], [e for _, e in spans])), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0)[k : k + 64].cast(pa.int64()), *columns], ["doc_id", "n_tokens", "ids", "starts", "ends", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)

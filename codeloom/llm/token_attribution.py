"""Token counts of fields and sections from one encoding of the whole document.

Each document is encoded once.  The tokens of a byte-level BPE tile the text, so
running sums of their byte lengths give their spans.  Tokens are joined to the spans
of sections as intervals, by binary search on the sorted bounds.  A token that crosses
a bound goes by an explicit rule:

first          to the section that holds its first byte
last           to the section that holds its last byte
middle         to the section that holds its middle byte (the earlier of two)
proportional   to each section by its share of the token's bytes (a double)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.bytebpe import encoder
from codeloom.llm.common import small_batches
from codeloom.llm.textkernel import gather

RULES = ("first", "last", "middle", "proportional")
SCHEMA = "doc_id long, section int, start_char long, end_char long, n_tokens double, n_crossing int"


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) in bytes of the lines; a line takes its line feed.  Empty documents have none."""
    ends = np.union1d(np.flatnonzero(data == 10) + 1, offsets[1:])
    ends = ends[ends > 0]
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)]
    return np.searchsorted(offsets, starts, "right") - 1, starts, ends


def count_tokens(starts: np.ndarray, ends: np.ndarray, lo: np.ndarray, hi: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens (starts, ends) of each span [lo, hi) by the rule, and how many tokens cross its bounds.

    Tokens are sorted and do not overlap; spans may overlap, be empty or leave gaps.
    """
    if rule == "proportional":
        bounds = np.append(starts, ends[-1] if len(ends) else 0)

        def before(x: np.ndarray) -> np.ndarray:
            k = np.clip(np.searchsorted(bounds, x, "right") - 1, 0, len(starts))
            inside = k < len(starts)
            part = np.zeros(len(x))
            part[inside] = (x[inside] - starts[k[inside]]) / (ends - starts)[k[inside]]
            return k + part

        n = before(hi) - before(lo)
    else:
        anchor = {"first": starts, "last": ends - 1, "middle": (starts + ends - 1) // 2}[rule]
        n = (np.searchsorted(anchor, hi) - np.searchsorted(anchor, lo)).astype(float)
    i, j = np.searchsorted(ends, lo, "right"), np.searchsorted(starts, hi) - 1
    some = (j >= i) & (hi > lo)
    left, right = np.zeros(len(lo), bool), np.zeros(len(lo), bool)
    left[some] = starts[i[some]] < lo[some]
    right[some] = ends[j[some]] > hi[some]
    return n, left.astype(np.int64) + (right & ~(left & (i == j)))


def attribute_tokens(docs: DataFrame, vocabulary: str, rule: str = "first", spans_col: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per section of a document: doc_id, section (from 0), start_char, end_char, n_tokens, n_crossing.

    Sections are the lines of the text, or the spans of ``spans_col``, an array of
    structs with start and end in characters; spans are clipped to the text, null spans
    count as empty.  Null and empty texts have no lines; their given spans have no
    tokens.  Repeated rows are counted each for itself; other columns are left out.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            for i, j, data, offsets, ids, _ in bpe.encode_column(batch.column(1)):
                ends = np.cumsum(bpe.token_bytes[ids])
                starts = ends - bpe.token_bytes[ids]
                plain = not len(data) or data.max() < 128
                chars = None if plain else np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                if spans_col is None:
                    doc, lo, hi = line_spans(data, offsets)
                else:
                    given = [[(x or {}) for x in (row or [])] for row in batch.column(2)[i:j].to_pylist()]
                    doc = np.repeat(np.arange(j - i), [len(x) for x in given])
                    at = offsets if plain else chars[offsets]
                    lo, hi = (np.array([x.get(k) or 0 for row in given for x in row], np.int64) for k in ("start", "end"))
                    lo, hi = (np.clip(x, 0, np.diff(at)[doc]) + at[:-1][doc] for x in (lo, hi))
                    hi = np.maximum(lo, hi)
                    if not plain:
                        byte = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
                        lo, hi = byte[lo], byte[hi]
                if not len(doc):
                    continue
                n, crossing = count_tokens(starts, ends, lo, hi, rule)
                base = offsets[:-1][doc]
                first = lo - base if plain else chars[lo] - chars[base]
                last = hi - base if plain else chars[hi] - chars[base]
                many = np.bincount(doc, minlength=j - i)
                section = np.arange(len(doc)) - gather(np.cumsum(many) - many, doc, np.ones(len(doc), np.int64))
                key = batch.column(0)[i:j].cast(pa.int64()).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([key, pa.array(section.astype(np.int32)), pa.array(first.astype(np.int64)), pa.array(last.astype(np.int64)), pa.array(n), pa.array(crossing.astype(np.int32))], ["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing"])

    cols = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    return docs.select(*cols, *([F.col(spans_col).alias("spans")] if spans_col else [])).mapInArrow(run, SCHEMA)

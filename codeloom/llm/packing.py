"""Cost-balanced packing of documents into sequences of bounded length.

A piece of ``n`` tokens costs ``linear * n + quadratic * n * n``, as attention inside
a piece does.  Pieces go in descending order to the sequence of the lowest cost that
has token capacity left.  Work is done in blocks of a bounded number of tokens inside
each task, in one pass over the documents without a shuffle; a block opens as many
sequences as its tokens need, so that its padding is below one sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.bytebpe import encoder
from codeloom.llm.common import give_back, small_batches

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def assign(lengths: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float = 1 / 1024) -> tuple[np.ndarray, int]:
    """Pieces (document, start, length, sequence, offset), one a row, and the number of sequences.

    Documents of ``capacity`` tokens and more are first cut into whole sequences; what is
    left of them and shorter documents go, longest first, to the sequence of the lowest
    cost that has room for the whole piece.  Where none has, the piece is cut and fills the
    sequence of the lowest cost with capacity left.  Ties go to the smaller index.
    """
    lengths = np.asarray(lengths, np.int64)
    whole = lengths // capacity
    doc = np.repeat(np.arange(len(lengths)), whole)
    part = np.arange(len(doc)) - np.repeat(np.cumsum(whole) - whole, whole)
    n = len(doc)
    rows = [np.column_stack([doc, part * capacity, np.full(n, capacity), np.arange(n), np.zeros(n, np.int64)])]
    rest = lengths - whole * capacity
    order = np.argsort(-rest, kind="stable")
    order = order[rest[order] > 0]
    bins = -(-int(rest.sum()) // capacity)
    free, cost = np.full(bins, capacity, np.int64), np.zeros(bins)
    placed = []
    for d, left, start in zip(order.tolist(), rest[order].tolist(), (whole * capacity)[order].tolist(), strict=True):
        while left:
            b = int(np.where(free >= left, cost, np.inf).argmin())
            if free[b] < left:
                b = int(np.where(free > 0, cost, np.inf).argmin())
            now = min(left, int(free[b]))
            placed.append((d, start, now, n + b, capacity - int(free[b])))
            free[b] -= now
            cost[b] += linear * now + quadratic * now * now
            left -= now
            start += now
    if placed:
        rows.append(np.array(placed, np.int64))
    return np.concatenate(rows), n + bins


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", linear: float = 1.0, quadratic: float = 1 / 1024, block_tokens: int = 1 << 22) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Null and empty texts are documents of the end id alone.  Repeated rows are packed
    each for itself, null ids stay null, other columns are left out.  An empty table
    gives no rows.  ``sequence_id`` is unique, not gapless; a task that is run again
    gives the same ids.  A document of any length is encoded in parts; its ids are held
    at once.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        base = TaskContext.get().partitionId() << 32
        names: list[pa.Array] = []
        ids: list[np.ndarray] = []
        held = 0

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal base
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            pieces, many = assign(lengths, capacity, linear, quadratic)
            pieces = pieces[np.lexsort((pieces[:, 4], pieces[:, 3]))]
            key = pa.chunked_array(names).combine_chunks()
            for k in range(0, len(pieces), 2000):
                d, start, n, seq, offset = pieces[k : k + 2000].T
                raw = [ids[a][s : s + m].astype("<u4").tobytes() for a, s, m in zip(d.tolist(), start.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([key.take(pa.array(d)), pa.array(start), pa.array(n), pa.array(raw, pa.binary()), pa.array(lengths[d]), pa.array(base + seq), pa.array(offset)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            base += many

        for batch in batches:
            for i, j, _, _, found, bounds in bpe.encode_column(batch.column(1)):
                names.append(batch.column(0)[i:j].cast(pa.int64()))
                ids += [np.append(found[s:e], bpe.dtype.type(end_id)) for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                held += int(bounds[-1]) + j - i
                if held >= block_tokens:
                    yield from emit()
                    names, ids, held = [], [], 0
        if ids:
            yield from emit()
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)

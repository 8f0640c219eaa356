"""Connected components of links between integer ids, by union-find and contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import remove, written

_ODD = 0x9E3779B97F4A7C15
_BACK = pow(_ODD, -1, 1 << 64)


def _scaled(ids: np.ndarray, by: int) -> np.ndarray:
    return (ids.astype(np.int64).view(np.uint64) * np.uint64(by)).view(np.int64)


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id of its group) for all ids of the links that aren't the smallest themselves."""
    ids, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(ids)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(back[: len(a)].tolist(), back[len(a) :].tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    top = np.array([root(x) for x in range(len(ids))], np.int64)
    moved = top != np.arange(len(ids))
    return ids[moved], ids[top[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's links as stars, one link per id at most; folded as soon as many have come."""
    a = b = np.zeros(0, np.int64)
    for batch in batches:
        a = np.concatenate([a, batch.column(0).to_numpy()])
        b = np.concatenate([b, batch.column(1).to_numpy()])
        if len(a) > 1 << 18:
            a, b = union_find(a, b)
    a, b = union_find(a, b)
    for k in range(0, len(a), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(a[k : k + 10_000]), pa.array(b[k : k + 10_000])], ["a", "b"])


#: Links that one task folds by union-find without help; more go through rounds of contraction.
ONE_TASK = 1 << 18


def components(links: DataFrame, folder: str, one_task: int = ONE_TASK) -> DataFrame:
    """(id, component): the smallest id that each id of the links a, b reaches; ids without a link have no row, and smallest ids may have none.

    ``links`` is read several times and should be a written table.  Up to ``one_task``
    links are folded by union-find in one task.  Beyond that each round folds every
    partition by union-find, then moves every id to the smallest label beside it.  Labels are the ids times an odd constant, an order in which runs of
    falling labels are short, so that chains shrink by a constant factor a round too.
    """

    schema = "a long, b long"
    links = links.where("a is not null and b is not null and a <> b").select("a", "b")
    if links.count() <= one_task:
        return written(links.coalesce(1).mapInArrow(_contract, schema).withColumnsRenamed({"a": "id", "b": "component"}), f"{folder}/components")

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_scaled(batch.column(k).to_numpy(), _ODD)) for k in (0, 1)], ["a", "b"])

    def unscale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_scaled(batch.column(k).to_numpy(), _BACK)) for k in (0, 1)], ["id", "c"])

    edges = written(links.mapInArrow(scale, schema).distinct(), f"{folder}/links")
    labels = edges.select(F.col("a").alias("v")).union(edges.select("b")).distinct().select("v", F.col("v").alias("c"))
    k = 0
    while not edges.isEmpty():
        star = written(edges.mapInArrow(_contract, schema).distinct(), f"{folder}/star{k}")
        both = star.union(star.select("b", "a"))
        move = written(both.groupBy("a").agg(F.min("b").alias("to")).where("to < a").select(F.col("a").alias("x"), "to"), f"{folder}/move{k}")
        ends = star.join(move, F.col("a") == F.col("x"), "left").select(F.coalesce("to", "a").alias("a"), "b")
        ends = ends.join(move, F.col("b") == F.col("x"), "left").select("a", F.coalesce("to", "b").alias("b"))
        edges = written(ends.where("a <> b").distinct(), f"{folder}/edges{k}")
        labels = labels.join(move, F.col("c") == F.col("x"), "left").select("v", F.coalesce("to", "c").alias("c"))
        if k:  # the first links and all moves are read once more for the labels
            remove(links.sparkSession, f"{folder}/edges{k - 1}")
        remove(links.sparkSession, f"{folder}/star{k}")
        k += 1
    plain = written(labels.mapInArrow(unscale, "id long, c long"), f"{folder}/labels")
    least = plain.groupBy("c").agg(F.min("id").alias("component"))
    return written(plain.join(least, "c").select("id", "component"), f"{folder}/components")

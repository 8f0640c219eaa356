"""Traversal of edges (src, dst): reachability, shortest paths, closures of hierarchies.

A frontier grows by one join a level and never visits an id twice for one seed, so that
cycles and dense graphs cost a level's edges, not walks.  Lineage is cut in the shared
folder every level.

Graphs whose edges and seeds stay below a size that is counted first are traversed inside
one task a block of seeds, with the edges as the other side of a co-group: a level then
costs no job.  Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.fixed import MAX_DEPTH
from codeloom.session import by_key, cut, cut_and_count, drop

#: Edges that one task may hold as two arrays of numbers.
TASK_EDGES = 2_000_000
#: Blocks that the seeds of a small graph are dealt to, at least and at most; rows that one may give.
SEED_BLOCKS, MOST_BLOCKS, BLOCK_ROWS = 8, 64, 50_000_000


def clamp_depth(depth: float | None) -> int:
    """At least 1 and at most 20; missing, not a number or below 1 means 20."""
    if depth is None or depth != depth or depth < 1:
        return MAX_DEPTH
    return int(min(depth, MAX_DEPTH))


def _along(edges: DataFrame, direction: str, rel_types: tuple[str, ...] | None) -> DataFrame:
    if rel_types is not None:
        edges = edges.where(F.col("rel_type").isin(*rel_types))
    a, b = ("src", "dst") if direction == "down" else ("dst", "src")
    return edges.where("src is not null and dst is not null").select(F.col(a).alias("from_id"), F.col(b).alias("to_id"))


class Adjacency:
    """Edges as sorted arrays of numbers, with the ids they stand for."""

    def __init__(self, a: pa.ChunkedArray, b: pa.ChunkedArray) -> None:
        both = pa.chunked_array([*a.chunks, *b.chunks]).combine_chunks().dictionary_encode()
        self.ids = both.dictionary
        code, m = both.indices.to_numpy().astype(np.int64), len(both.dictionary)
        pair = np.unique(code[: len(a)] * max(m, 1) + code[len(a) :])
        self.ends = pair % max(m, 1)
        self.bounds = np.searchsorted(pair // max(m, 1), np.arange(m + 1))
        self.number = {x: i for i, x in enumerate(self.ids.to_pylist())}

    def levels(self, start: np.ndarray, depth: int, mark: bool) -> Iterator[tuple[int, np.ndarray]]:
        """(steps, ids first met after so many) from the starting ids together; ``mark``: these count as met."""
        seen = np.zeros(len(self.ids), bool)
        if mark:
            seen[start] = True
        here = np.unique(start)
        for k in range(1, depth + 1):
            n = self.bounds[here + 1] - self.bounds[here]
            at = np.arange(int(n.sum())) + np.repeat(self.bounds[here] - (np.cumsum(n) - n), n)
            here = np.unique(self.ends[at])
            here = here[~seen[here]]
            if not len(here):
                return
            seen[here] = True
            yield k, here


def _small(step: DataFrame, seeds: DataFrame, depth: int, together: bool, blocks: int = 1) -> DataFrame:
    """``reach`` or ``reach_any`` where the edges fit a task; seeds are dealt to blocks, each with a copy of the edges."""
    s = seeds.select("id").where("id is not null").distinct().withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    e = step.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    names = ["id", "depth"] if together else ["seed", "id", "depth"]

    def solve(seed_rows: pa.Table, edge_rows: pa.Table) -> pa.Table:
        graph = Adjacency(edge_rows["from_id"], edge_rows["to_id"])
        known = [(x, graph.number[x]) for x in seed_rows["id"].to_pylist() if x in graph.number]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if together:
            for k, found in graph.levels(np.array([i for _, i in known], np.int64), depth, True):
                out.append((found, found, np.full(len(found), k, np.int32)))
        else:
            for _, i in known:
                for k, found in graph.levels(np.array([i]), depth, False):
                    out.append((np.full(len(found), i), found, np.full(len(found), k, np.int32)))
        seed, found, steps = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))
        cols = [graph.ids.take(pa.array(found)), pa.array(steps)] if len(graph.ids) else [pa.array([], pa.string()), pa.array([], pa.int32())]
        if not together:
            cols.insert(0, graph.ids.take(pa.array(seed)) if len(graph.ids) else pa.array([], pa.string()))
        return pa.table(cols, names=names)

    text = lambda df, *cols: df.select("block", *[F.col(c).cast("string").alias(c) for c in cols])
    kinds = {"seed": seeds.schema["id"].dataType, "id": step.schema["to_id"].dataType}
    found = text(s, "id").groupBy("block").cogroup(text(e, "from_id", "to_id").groupBy("block")).applyInArrow(solve, ", ".join(f"{n} {'int' if n == 'depth' else 'string'}" for n in names))
    return found.select(*[F.col(n).cast(kinds[n]).alias(n) if n in kinds else F.col(n) for n in names])


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, direction: str = "down", rel_types: tuple[str, ...] | None = None, task_edges: int = TASK_EDGES) -> DataFrame:
    """(seed, id, depth): every id in 1 to max_depth steps from each seed, with the least number of steps.

    A seed on a cycle reaches itself.  ``direction`` is down (callees) or up (callers).
    All seeds go together, one join a level for all of them (J2, G8, U2); up to
    ``task_edges`` edges are traversed inside tasks, without a job a level, if so many
    edges and seeds can't give more rows than tasks may hold.
    """
    step, n = cut_and_count(_along(edges, direction, rel_types))
    if n <= task_edges:
        blocks = max(SEED_BLOCKS, -(-n * seeds.count() // BLOCK_ROWS))
        if blocks <= MOST_BLOCKS:
            return cut(_small(step, seeds, clamp_depth(max_depth), False, blocks))
    return _grown(step.distinct(), seeds.select(F.col("id").alias("seed"), "id").distinct(), clamp_depth(max_depth), ["seed", "id"])


def reach_any(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, direction: str = "down", rel_types: tuple[str, ...] | None = None, task_edges: int = TASK_EDGES) -> DataFrame:
    """(id, depth): every id that any of the seeds reaches, without the seeds, and its least number of steps from one.

    One row an id, however many seeds reach it (U2).
    """
    step, n = cut_and_count(_along(edges, direction, rel_types))
    if n <= task_edges:
        return cut(_small(step, seeds, clamp_depth(max_depth), True))
    return _grown(step.distinct(), seeds.select("id").distinct(), clamp_depth(max_depth), ["id"], True)


def _grown(step: DataFrame, frontier: DataFrame, most: int, keys: list[str], mark: bool = False) -> DataFrame:
    """Level by level: one join of the frontier and the edges, without what was met before."""
    step = cut(step.repartition("from_id"))
    found = frontier.withColumn("depth", F.lit(0)) if mark else frontier.limit(0).withColumn("depth", F.lit(0))
    found = cut(found)
    for depth in range(1, most + 1):
        new = frontier.withColumnRenamed("id", "from_id").join(by_key(step), "from_id").select(*[k for k in keys if k != "id"], F.col("to_id").alias("id")).distinct()
        new, n = cut_and_count(new.join(by_key(found.select(*keys)), keys, "left_anti").withColumn("depth", F.lit(depth)))
        if not n:
            drop(new)
            break
        frontier = new.select(*keys)
        found = found.unionByName(new)
    return found.where("depth > 0")


def shortest_path(edges: DataFrame, start: str, end: str, max_depth: int | None = None, rel_types: tuple[str, ...] | None = ("calls", "contains")) -> DataFrame:
    """(hop, id) of a shortest path, the least by its ids if there are several; no rows if there is none.

    A path from an id to itself is that id alone.
    """
    spark = edges.sparkSession
    if start == end:
        return spark.createDataFrame([(0, start)], "hop int, id string")
    step = cut(_along(edges, "down", rel_types).distinct())
    frontier = spark.createDataFrame([(start, [start])], "id string, path array<string>")
    seen = frontier.select("id")
    for _ in range(clamp_depth(max_depth)):
        new = frontier.join(step, F.col("id") == F.col("from_id")).select(F.col("to_id").alias("id"), F.concat("path", F.array("to_id")).alias("path"))
        new, n = cut_and_count(new.join(seen, "id", "left_anti").groupBy("id").agg(F.min("path").alias("path")))
        hit = new.where(F.col("id") == end)
        if n and not hit.isEmpty():
            return hit.select(F.posexplode("path").alias("hop", "id"))
        if not n:
            break
        frontier, seen = new, seen.union(new.select("id"))
    return spark.createDataFrame([], "hop int, id string")


def ancestors(inherits: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(seed, id, depth) of every child's ancestors, nearest first (G3); edges are child src, parent dst."""
    return reach(inherits, inherits.select(F.col("src").alias("id")).distinct(), max_depth, "down", None)


def rexport_chain(bindings: DataFrame, hops: int = 5) -> DataFrame:
    """(file, name, origin_file, origin_name, n): where a name that files pass on comes from, in at most ``hops`` steps.

    ``bindings`` has file, name, from_file, from_name; a chain stops at a name that its file
    does not pass on, or before it would come back to a place it has been.
    """
    b = bindings.select("file", "name", "from_file", "from_name").dropDuplicates(["file", "name"])
    nxt = b.select(F.col("file").alias("f"), F.col("name").alias("m"), F.col("from_file").alias("ff"), F.col("from_name").alias("fm"))
    place = lambda f, n: F.concat_ws("\u0000", f, n)
    chain = b.select("file", "name", F.col("from_file").alias("origin_file"), F.col("from_name").alias("origin_name"), F.array(place(F.col("file"), F.col("name")), place(F.col("from_file"), F.col("from_name"))).alias("seen"))
    for _ in range(hops - 1):
        on = (F.col("origin_file") == F.col("f")) & (F.col("origin_name") == F.col("m"))
        go = F.col("ff").isNotNull() & ~F.array_contains("seen", place(F.col("ff"), F.col("fm")))
        chain = chain.join(nxt, on, "left").select(
            "file", "name", F.when(go, F.col("ff")).otherwise(F.col("origin_file")).alias("origin_file"), F.when(go, F.col("fm")).otherwise(F.col("origin_name")).alias("origin_name"), F.when(go, F.concat("seen", F.array(place(F.col("ff"), F.col("fm"))))).otherwise(F.col("seen")).alias("seen")
        )
    return chain.select("file", "name", "origin_file", "origin_name", (F.size("seen") - 1).alias("n"))

"""Approximate nearest neighbours by NN-descent and greedy graph search.

Equal vectors are one node.  Nodes are dealt to cells of bounded size by a tree of
pivots (means of bounded samples), level by level, so that a cell holds what lies
together and vectors of like norms.  Every cell has a graph, and all graphs are built together: a first guess comes
from small groups of nodes on one side of random planes; then, in each round, a Spark join
gives every node the neighbours of its neighbours (both ways along the edges) where
either edge is new, and the best of them stay.  A query goes down the tree to the
``probes`` cells that promise most and through their graphs by greedy best-first search.
It starts from a node of every connected component and from many others, so that no
part of a graph is out of reach.

Inner products become angles by one more coordinate, sqrt(M * M - |x| * |x|) with the
largest norm M of a cell, so that vectors of any norm can be searched.  What is found is
scored again on the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import remove, shared_dir, small_batches, written
from codeloom.llm.textkernel import gather

#: Children of a cell at most; a cell's number is its parent's times 64 and its own place from 1 on.
_KIDS = 63
#: Sampled nodes for each child whose pivots are sought.
_SAMPLE = 32
#: Nodes compared with each other for the first guess; entries of a search besides those of the components.
_LEAF, _ENTRIES = 128, 1024


@dataclass(frozen=True)
class Settings:
    """``shard``: most nodes of a graph; ``degree``: neighbours kept; ``pool``: candidates that a search holds.

    ``probes``: graphs of usual size that a query searches, all where there are no more; ``part``:
    nodes of a graph whose candidates one task compares; ``slice``: queries of a task.
    """

    shard: int = 32_768
    degree: int = 24
    rounds: int = 4
    pool: int = 192
    step: int = 8
    block: int = 256
    probes: int = 8
    part: int = 4096
    slice: int = 1024
    #: A round that changes a smaller part of all edges is the last.
    still: float = 0.005


def _floats(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return np.zeros((0, 1), np.float32)
    values = col.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(col), -1)


def _lists_of(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _table(batches: list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(batches).combine_chunks()


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal values in the first integer columns of a sorted partition."""
    held: list[pa.RecordBatch] = []
    name = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.column_stack([batch.column(i).to_numpy().astype(np.int64) for i in range(keys)])
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and tuple(k[a].tolist()) != name:
                yield name, _table(held)
                held = []
            name = tuple(k[a].tolist())
            held.append(batch.slice(a, b - a))
    if held:
        yield name, _table(held)


def _ints(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Joined little-endian 32-bit integers of binary values, and the number in each."""
    return np.frombuffer(b"".join(raw), "<i4").astype(np.int64), np.array([len(x) // 4 for x in raw], np.int64)


def best_of(x: np.ndarray, row: np.ndarray, other: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the candidate pairs (row, other) the ``keep`` nearest per row, nearest first, as flat arrays."""
    pair = np.unique(row * len(x) + other)
    row, other = pair // len(x), pair % len(x)
    use = row != other
    row, other = row[use], other[use]
    score = np.empty(len(row), np.float32)
    for k in range(0, len(row), 1 << 15):
        part = slice(k, k + (1 << 15))
        score[part] = np.einsum("ij,ij->i", x[row[part]], x[other[part]])
    order = np.lexsort((other, -score, row))
    row, other = row[order], other[order]
    first = np.searchsorted(row, row)
    use = np.arange(len(row)) - first < keep
    return row[use], other[use]


def _lists(row: np.ndarray, other: np.ndarray, n: int) -> list[bytes]:
    cuts = np.searchsorted(row, np.arange(n + 1))
    flat = other.astype("<i4")
    return [flat[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def lifted(x: np.ndarray) -> np.ndarray:
    """Vectors of a cell with one more coordinate, all of norm 1."""
    x = x.astype(np.float64)
    square = (x * x).sum(1)
    most = square.max() if len(x) else 1.0
    return (np.column_stack([x, np.sqrt(np.maximum(most - square, 0))]) / np.sqrt(most)).astype(np.float32)


def pivots_of(x: np.ndarray, kids: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means of at most ``kids`` groups of a sample, how far a group spreads along a direction, and its share of the sample."""
    x = x.astype(np.float64)
    c = x[rng.choice(len(x), min(kids, len(x)), replace=False)]
    for _ in range(rounds):
        home = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
        _, home = np.unique(home, return_inverse=True)
        n = np.bincount(home)
        c = np.column_stack([np.bincount(home, x[:, k]) for k in range(x.shape[1])]) / n[:, None]
    spread = np.bincount(home, ((x - c[home]) ** 2).sum(1)) / n / x.shape[1]
    return c.astype(np.float32), np.sqrt(spread).astype(np.float32), n / len(x)


_LEVEL = "cell long, pivots binary, spread binary, sizes binary"


def _level(cell: int, n: float, c: np.ndarray, spread: np.ndarray, share: np.ndarray) -> dict:
    return {"cell": pa.array([cell], pa.int64()), "pivots": [c.tobytes()], "spread": [spread.tobytes()], "sizes": [(share * n).tobytes()]}


def _by_norm(nodes: DataFrame, count: int, s: Settings, folder: str) -> tuple[DataFrame, list[DataFrame], list[tuple[int, int]]]:
    """The first level of the tree: cells of like norms, which differ by octaves, so that the few longest vectors stand out.

    Bands of a few nodes are put together, from the longest down, so that there are at most 63.
    """
    band = F.round(F.log2(F.aggregate("v", F.lit(0.0), lambda a, y: a + y.cast("double") * y)) / 2).cast("int")
    found = sorted(nodes.groupBy(band.alias("b")).count().collect(), key=lambda r: -r.b)  # at most the 2,200 exponents of doubles
    roots: list[tuple[int, int]] = []  # (lowest band, nodes)
    least, held = max(s.shard // 2, count // 48), 0
    for r in found:
        held += r["count"]
        if held >= least:
            roots.append((r.b, held))
            held = 0
    if held:
        roots = [*roots[:-1], (found[-1].b, roots[-1][1] + held)] if roots and held < least else [*roots, (found[-1].b, held)]
    if len(roots) == 1:
        return nodes.withColumn("cell", F.lit(0).cast("long")), [], [(0, count)]
    cell = F.lit(len(roots))
    for k, (low, _) in reversed(list(enumerate(roots))):
        cell = F.when(band >= low, F.lit(k + 1)).otherwise(cell)
    sizes = [(k + 1, n) for k, (_, n) in enumerate(roots)]
    dealt = written(nodes.withColumn("cell", cell.cast("long")), f"{folder}/norms")
    few = dealt.join(nodes.sparkSession.createDataFrame(sizes, "cell long, n long"), "cell").where(F.pmod(F.xxhash64("id"), F.col("n")) < 8 * _SAMPLE)

    def mean(t: pa.Table) -> pa.Table:
        c, spread, _ = pivots_of(_floats(t["v"]), 1, np.random.default_rng(0), 1)
        return pa.table(_level(t["cell"][0].as_py(), t["n"][0].as_py(), c, spread, np.ones(1)))

    rows = {r.cell: r for r in few.select("cell", "n", "v").groupBy("cell").applyInArrow(mean, _LEVEL).collect()}  # at most 63
    none = rows[min(rows)]
    whole = [rows.get(k, none) for k, _ in sizes]
    level = nodes.sparkSession.createDataFrame([(0, *(bytearray(b"".join(bytes(r[x]) for r in whole)) for x in ("pivots", "spread", "sizes")))], _LEVEL)
    return dealt, [written(level, f"{folder}/level")], sizes


def deal(nodes: DataFrame, count: int, s: Settings, folder: str) -> tuple[DataFrame, list[DataFrame]]:
    """Nodes (id, v) with their cell, and for each level of the tree (cell, pivots, spread, sizes) of the cells it splits.

    A cell above ``shard`` nodes is split at pivots of a sample of its nodes; the sample is
    bounded by the number of its children.  Each level is a join on the cell and one pass.
    """
    spark = nodes.sparkSession
    if count <= s.shard:
        return nodes.withColumn("cell", F.lit(0).cast("long")), []
    dealt, levels, sizes = _by_norm(nodes, count, s, folder)
    big = spark.createDataFrame([x for x in sizes if x[1] > s.shard], "cell long, n long")
    kind = nodes.schema["v"].dataType.simpleString()

    def pivots(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        cell = t["cell"][0].as_py()
        return pa.table(_level(cell, t["n"][0].as_py(), *pivots_of(_floats(t["v"]), t["kids"][0].as_py(), np.random.default_rng(cell))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _floats(batch.column(2)).astype(np.float32)
            cell = batch.column(1).to_numpy().copy()
            for raw, at in _by_value(batch.column(3)):
                c = np.frombuffer(raw, np.float32).reshape(-1, x.shape[1])
                cell[at] = cell[at] * 64 + 1 + (x[at] @ c.T - (c * c).sum(1) / 2).argmax(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell), batch.column(2)], ["id", "cell", "v"])

    for k in range(8):  # 63 ** 8 cells are enough for any table
        if big.isEmpty():
            break
        kids = F.least(F.lit(_KIDS), F.ceil(F.col("n") * 2 / s.shard)).cast("int")
        few = dealt.join(big.withColumn("kids", kids), "cell").where(F.pmod(F.xxhash64("id", F.lit(k)), F.col("n")) < F.col("kids") * _SAMPLE)
        level = written(few.select("cell", "n", "kids", "id", "v").groupBy("cell").applyInArrow(pivots, _LEVEL), f"{folder}/level{k}")
        levels.append(level)
        down = dealt.join(level.select("cell", "pivots"), "cell", "left").select("id", "cell", "v", "pivots")
        dealt = written(down.mapInArrow(place, f"id long, cell long, v {kind}"), f"{folder}/dealt{k}")
        remove(spark, f"{folder}/dealt{k - 1}" if k else f"{folder}/norms")
        big = written(dealt.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > s.shard), f"{folder}/big{k}")
    return dealt, levels


def _by_value(col: pa.Array) -> Iterator[tuple[bytes, np.ndarray]]:
    """Each value of a binary column that isn't null, and its places."""
    d = col.dictionary_encode()
    code = d.indices.fill_null(-1).to_numpy()
    for k, raw in enumerate(d.dictionary.to_pylist()):
        yield raw, np.flatnonzero(code == k)


def route(asked: DataFrame, levels: list[DataFrame], s: Settings) -> DataFrame:
    """(cell, qid, qv): the cells that each query searches, those where its best product is likely largest.

    They are taken until they hold ``probes`` times half of ``shard`` nodes, about as many
    cells of usual size; on the levels above, twice as many.
    """
    kind = asked.schema["v"].dataType.simpleString()
    way = asked.select(F.col("id").alias("qid"), F.lit(0).cast("long").alias("cell"), F.lit(0.0).alias("hope"), F.lit(0.0).alias("size"), F.col("v").alias("qv"))
    most = s.probes * s.shard / 2

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _floats(batch.column(4)).astype(np.float32)
            old = [batch.column(k).to_numpy() for k in (1, 2, 3)]
            stay = np.flatnonzero(batch.column(5).is_null().to_numpy(zero_copy_only=False))
            out = [(stay, *(x[stay] for x in old))]
            spreads, sizes = batch.column(6), batch.column(7)
            for raw, at in _by_value(batch.column(5)):
                c = np.frombuffer(raw, np.float32).reshape(-1, q.shape[1])
                spread, size = np.frombuffer(spreads[int(at[0])].as_py(), np.float32), np.frombuffer(sizes[int(at[0])].as_py())
                score = q[at] @ c.T + 3 * np.linalg.norm(q[at], axis=1)[:, None] * spread
                order = np.argsort(-score, 1, kind="stable")
                row, col = np.nonzero(np.cumsum(size[order], 1) - size[order] < 2 * most)
                kid = order[row, col]
                out.append((at[row], old[0][at[row]] * 64 + 1 + kid, score[row, kid].astype(np.float64), size[kid]))
            row, cell, hope, size = (np.concatenate(x) for x in zip(*out, strict=True))
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), pa.array(cell), pa.array(hope), pa.array(size), batch.column(4).take(row)], ["qid", "cell", "hope", "size", "qv"])

    for k, level in enumerate(levels):
        way = way.join(level, "cell", "left").select("qid", "cell", "hope", "size", "qv", "pivots", "spread", "sizes").mapInArrow(down, f"qid long, cell long, hope double, size double, qv {kind}")
        best = Window.partitionBy("qid").orderBy(F.desc("hope"), "cell").rowsBetween(Window.unboundedPreceding, 0)
        way = way.withColumn("held", F.sum("size").over(best)).where(F.col("held") - F.col("size") < (most if k + 1 == len(levels) else 2 * most)).drop("held")
    return way.select("cell", "qid", "qv")


def leaves(x: np.ndarray, rng: np.random.Generator, size: int = _LEAF) -> Iterator[np.ndarray]:
    """Groups of at most ``size`` rows that lie on the same sides of planes halfway between two random rows."""
    todo = [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if len(at) <= size:
            yield at
            continue
        a, b = x[rng.choice(at, 2, replace=False)]
        side = x[at] @ (a - b)
        order = np.argsort(side, kind="stable")
        cut = int(np.clip((side <= (a + b) @ (a - b) / 2).sum(), len(at) // 4, len(at) - len(at) // 4))
        todo += [at[order[:cut]], at[order[cut:]]]


def build(nodes: DataFrame, s: Settings, folder: str) -> DataFrame:
    """(cell, node, near): for every node (cell, size, node, v) its nearest, as 32-bit integers in a binary value.

    ``node`` counts from 0 in each cell, ``size`` is the number of the cell's nodes.
    """
    schema = "cell long, node int, near binary, fresh binary, moved int"

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (cell,), t in _groups(batches, 1):
            x = lifted(_floats(t["v"]))
            n, rng = len(x), np.random.default_rng(cell)
            rows, others = [], []
            for _ in range(2):
                for at in leaves(x, rng):
                    score = x[at] @ x[at].T
                    np.fill_diagonal(score, -np.inf)
                    top = np.argsort(-score, 1, kind="stable")[:, : min(s.degree, len(at) - 1)]
                    rows.append(np.repeat(at, top.shape[1]))
                    others.append(at[top].ravel())
            row, other = best_of(x, np.concatenate(rows), np.concatenate(others), s.degree)
            near = _lists(row, other, n)
            for k in range(0, n, 2000):
                part = near[k : k + 2000]
                yield pa.RecordBatch.from_pydict({"cell": np.full(len(part), cell, np.int64), "node": np.arange(k, k + len(part), dtype=np.int32), "near": part, "fresh": part, "moved": np.ones(len(part), np.int32)})

    vectors = nodes.select("cell", "node", "v")
    graph = written(vectors.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(start, schema), f"{folder}/graph0")
    total = graph.count() * s.degree

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The edges of nodes, both ways; new ones are marked."""
        for batch in batches:
            flat, many = _ints(batch.column(2).to_pylist())
            own, many_new = _ints(batch.column(3).to_pylist())
            at = np.arange(batch.num_rows)
            new = np.isin(np.repeat(at, many) << 32 | flat, np.repeat(at, many_new) << 32 | own).astype(np.int8)
            cell, node = np.repeat(batch.column(0).to_numpy(), many), np.repeat(batch.column(1).to_numpy(), many).astype(np.int32)
            flat = flat.astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ((cell, cell), (node, flat), (flat, node), (new, new))], ["cell", "node", "via", "new"])

    def select(t: pa.Table, c: pa.Table) -> pa.Table:
        """Of the candidates of some of a cell's nodes the nearest, by all vectors of the cell."""
        t, c = t.combine_chunks(), c.combine_chunks()
        x = lifted(_floats(t["v"])[np.argsort(t["node"].to_numpy())])
        node, via, new = (c[k].to_numpy().astype(np.int64) for k in ("node", "via", "new"))
        raw = c["near"].to_pylist()
        mine = np.flatnonzero(node == via)
        first, n = int(node[mine].min()), len(mine)  # nodes of a part follow each other
        old: list[bytes] = [b""] * n
        for k in mine.tolist():
            old[node[k] - first] = raw[k]
        rows, others = [], []
        order = np.argsort(node, kind="stable")
        cuts = np.searchsorted(node[order], np.arange(first, first + n + 256, 256))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):  # 256 nodes at a time
            part = order[a:b]
            if len(part):
                flat, many = _ints([raw[k] for k in part.tolist()])
                also = part[new[part] > 0]
                got = best_of(x, np.concatenate([np.repeat(node[part], many), node[also]]), np.concatenate([flat, via[also]]), s.degree)
                rows.append(got[0])
                others.append(got[1])
        near = _lists(np.concatenate(rows) - first, np.concatenate(others), n)
        fresh = [np.setdiff1d(np.frombuffer(p, "<i4"), np.frombuffer(q, "<i4")).astype("<i4") for p, q in zip(near, old, strict=True)]
        return pa.table({"cell": np.full(n, t["cell"][0].as_py(), np.int64), "node": np.arange(first, first + n, dtype=np.int32), "near": pa.array(near, pa.binary()), "fresh": pa.array([f.tobytes() for f in fresh], pa.binary()), "moved": np.array([len(f) for f in fresh], np.int32)})

    part = lambda c: F.expr(f"{c} div {s.part}").cast("int")
    all_parts = nodes.select("cell", "node", "v", F.explode(F.sequence(F.lit(0), part("(size - 1)"))).alias("part"))
    for k in range(1, s.rounds + 1):
        edges = graph.select("cell", "node", "near", "fresh").mapInArrow(unpack, "cell long, node int, via int, new tinyint").groupBy("cell", "node", "via").agg(F.max("new").alias("new"))
        own = graph.select("cell", "node", F.col("node").alias("via"), F.lit(0).cast("tinyint").alias("new"), "near")
        beyond = edges.join(graph.select("cell", F.col("node").alias("via"), "near", "fresh"), ["cell", "via"]).where("new > 0 or length(fresh) > 0")
        beyond = beyond.select("cell", "node", "via", "new", F.when(F.col("new") > 0, F.col("near")).otherwise(F.col("fresh")).alias("near"))
        asked = beyond.unionByName(own).withColumn("part", part("node"))
        found = all_parts.groupBy("cell", "part").cogroup(asked.groupBy("cell", "part")).applyInArrow(select, schema)
        graph = written(found, f"{folder}/graph{k}")
        remove(graph.sparkSession, f"{folder}/graph{k - 1}")
        if (graph.agg(F.sum("moved")).first()[0] or 0) < s.still * total:
            break
    return graph.select("cell", "node", "near")


def both_ways(row: np.ndarray, other: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and ends of the edges of ``n`` nodes, each edge both ways."""
    pair = np.unique(np.concatenate([row * n + other, other * n + row]))
    return np.searchsorted(pair // n, np.arange(n + 1)), pair % n


def entries(bounds: np.ndarray, ends: np.ndarray, rng: np.random.Generator, more: int = _ENTRIES) -> np.ndarray:
    """A node of every connected component, and ``more`` others."""
    n = len(bounds) - 1
    label, row = np.arange(n), np.repeat(np.arange(n), np.diff(bounds))
    while True:
        low = label.copy()
        np.minimum.at(low, row, label[ends])
        low = low[low]
        if (low == label).all():
            break
        label = low
    return np.union1d(np.flatnonzero(label == np.arange(n)), rng.choice(n, min(n, more), replace=False))


def greedy(x: np.ndarray, bounds: np.ndarray, ends: np.ndarray, entry: np.ndarray, q: np.ndarray, keep: int, s: Settings) -> np.ndarray:
    """Best-first search of all rows of ``q`` at once: the ``keep`` nearest nodes found, or -1.

    Each query widens the ``step`` nearest nodes of its pool that it has not widened; it
    ends when all of its pool is.  ``ends[bounds[i]:bounds[i + 1]]`` are the neighbours of i.
    """
    n, m = len(x), len(q)
    size = min(max(s.pool, keep), n)
    if n <= size + s.step or n <= len(entry):  # as few as are scored anyway
        score = q @ x.T
        return np.argsort(-score, 1, kind="stable")[:, :keep]
    width = np.diff(bounds)
    seen = np.zeros((m, n), bool)
    seen[:, entry] = True
    score = q @ x[entry].T
    top = np.argpartition(-score, min(size, len(entry)) - 1, 1)[:, :size]
    pool = np.full((m, size), -1, np.int64)
    rank = np.full((m, size), -np.inf, np.float32)
    done = np.ones((m, size), bool)
    k = top.shape[1]
    pool[:, :k], rank[:, :k], done[:, :k] = entry[top], np.take_along_axis(score, top, 1), False
    live = np.arange(m)
    while len(live):
        open_rank = np.where(done[live], -np.inf, rank[live])
        pick = np.argpartition(-open_rank, s.step - 1, 1)[:, : s.step]
        at = np.arange(len(live))[:, None]
        row, col = np.nonzero(np.isfinite(open_rank[at, pick]))
        done[live[:, None], pick] = True
        from_node = pool[live[row], pick[row, col]]
        who, node = np.repeat(row, width[from_node]), gather(ends, bounds[from_node], width[from_node])
        new = ~seen[live[who], node]
        pair = np.unique(who[new] * n + node[new])
        who, node = pair // n, pair % n
        seen[live[who], node] = True
        score = np.einsum("ij,ij->i", q[live[who]], x[node])
        came = np.bincount(who, minlength=len(live))
        put = np.arange(len(who)) - np.repeat(np.cumsum(came) - came, came)
        more = int(came.max()) if len(who) else 0
        all_node, all_rank, all_done = (np.concatenate([old[live], np.full((len(live), more), fill, old.dtype)], 1) for old, fill in ((pool, -1), (rank, -np.inf), (done, True)))
        all_node[who, size + put], all_rank[who, size + put], all_done[who, size + put] = node, score, False
        top = np.argpartition(-all_rank, size - 1, 1)[:, :size]
        pool[live], rank[live], done[live] = all_node[at, top], all_rank[at, top], all_done[at, top]
        live = live[(~done[live]).any(1)]
    order = np.argsort(-rank, 1, kind="stable")[:, :keep]
    return np.take_along_axis(pool, order, 1)


def nearest(vectors: DataFrame, queries: DataFrame, top: int = 20, settings: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` rows of ``vectors`` nearest to each row of ``queries``, without its own id.

    Score is the inner product of the original vectors in double precision; nearest come
    first, ties go to the smaller id.  Vectors that are null, zero, of another length than
    most, or hold null or non-finite components take no part, nor do rows with a null id;
    repeated rows count once, and of an id with several vectors the one with the smallest
    hash counts.  Copies of a vector are found together and never crowd out others from
    the graph.  An empty table gives no rows.
    """
    spark, s = vectors.sparkSession, settings
    small_batches(spark, 2000)
    folder = shared_dir(spark)
    element = vectors.schema[vector_col].dataType.simpleString()
    kind = "array<float>" if element == "array<float>" else "array<double>"

    def usable(df: DataFrame) -> DataFrame:
        v = F.col("v")
        fine = F.forall(v, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf"))) & F.exists(v, lambda y: y != 0)
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v")).where(F.col("id").isNotNull() & v.isNotNull()).where(fine)

    rows = usable(vectors)
    width = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if width is None:
        return spark.createDataFrame([], schema)

    def hashed(df: DataFrame) -> DataFrame:
        bits = F.transform("v", lambda y: y + F.lit(0.0).cast(kind[6:-1]))  # -0.0 and 0.0 are one
        return df.where(F.size("v") == width["d"]).select("id", bits.alias("v"), F.xxhash64(bits).alias("h1"), F.xxhash64(bits, F.lit(1)).alias("h2"))

    rows = hashed(rows)
    # a node per distinct vector, and the smallest ids of its copies: as many as one query can use
    one = rows.groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("h")).select("id", "h.h1", "h.h2")
    own = Window.partitionBy("h1", "h2").orderBy("id")
    copies = written(one.withColumn("r", F.row_number().over(own)).where(F.col("r") <= top + 1), f"{folder}/copies")
    first = copies.where("r = 1").select("id", "h1", "h2")
    distinct = written(rows.join(first, ["id", "h1", "h2"], "left_semi").dropDuplicates(["id"]).select("id", "v"), f"{folder}/distinct")
    asked = hashed(usable(queries)).groupBy("id").agg(F.min_by("v", F.struct("h1", "h2")).alias("v"))
    dealt, levels = deal(distinct, distinct.count(), s, folder)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (cell,), t in _groups(batches, 1):
            n = t.num_rows
            for k in range(0, n, 2000):
                some = t.slice(k, 2000).combine_chunks()
                m = some.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, cell)), pa.array(np.full(m, n, np.int32)), pa.array(np.arange(k, k + m, dtype=np.int32)), some["id"].chunk(0), some["v"].chunk(0)], ["cell", "size", "node", "id", "v"])

    in_cells = dealt.select("cell", "id", "v").repartition("cell").sortWithinPartitions("cell", "id")
    nodes = written(in_cells.mapInArrow(number, f"cell long, size int, node int, id long, v {kind}"), f"{folder}/nodes")
    graph = build(nodes, s, folder)

    def search(t: pa.Table, q: pa.Table) -> pa.Table:
        """One cell's graph against some queries."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if t.num_rows and q.num_rows:
            order = np.argsort(t["node"].to_numpy())
            raw, ids = _floats(t["v"])[order], t["id"].to_numpy()[order]
            x, near = lifted(raw), t["near"].to_pylist()
            flat, many = _ints([near[k] for k in order.tolist()])
            bounds, ends = both_ways(np.repeat(np.arange(len(x)), many), flat, len(x))
            entry = entries(bounds, ends, np.random.default_rng(len(x)))
            qv, qid = _floats(q["qv"]), q["qid"].to_numpy()
            for k in range(0, len(qv), s.block):
                part = qv[k : k + s.block].astype(np.float64)
                found = greedy(x, bounds, ends, entry, np.column_stack([part, np.zeros(len(part))]).astype(np.float32), top + 12, s)
                at, col = np.nonzero(found >= 0)
                node = found[at, col]
                score = np.einsum("ij,ij->i", part[at], raw[node].astype(np.float64))
                best = np.lexsort((ids[node], -score, at))
                best = best[np.arange(len(best)) - np.searchsorted(at[best], at[best]) <= top]
                out.append((qid[k : k + s.block][at[best]], ids[node[best]], score[best]))
        return pa.table([np.concatenate(x) for x in zip(*out, strict=True)], ["qid", "rep", "score"])

    # a task holds one cell and one slice of its queries
    way = written(route(asked, levels, s), f"{folder}/routes")
    slices = way.groupBy("cell").agg(F.ceil(F.count("*") / s.slice).cast("int").alias("slices"))
    q = way.join(slices, "cell").select("cell", F.pmod(F.xxhash64("qid"), F.col("slices")).cast("int").alias("part"), "qid", "qv")
    places = nodes.join(graph, ["cell", "node"]).join(slices, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("part"), "node", "id", "v", "near")
    found = places.groupBy("cell", "part").cogroup(q.groupBy("cell", "part")).applyInArrow(search, "qid long, rep long, score double")

    # the copies of the nodes found
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "rep")
    nodes_found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= top + 1).drop("r")
    rows_of = copies.join(first.select("h1", "h2", F.col("id").alias("rep")), ["h1", "h2"]).select("rep", "id")
    expanded = nodes_found.join(rows_of, "rep").where("id <> qid")
    final = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    out = expanded.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= top)
    return out.select(F.col("qid").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")

"""Execution flows: entry points, longest call chains, steps, data that goes between steps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import fixed, graph, text
from codeloom.operators.traverse import reach
from codeloom.session import by_key, cut

_STARTS = ("function", "method", "class")


def entry_points(symbols: DataFrame, calls: DataFrame, most: int | None = None) -> DataFrame:
    """(id, score), best first: what calls more than calls it, by name and visibility."""
    known = by_key(symbols.select("id"))
    e = calls.select("src", "dst").distinct().join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    came = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers"))
    went = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("callees"))
    rows = symbols.where(F.col("kind").isin(*_STARTS)).join(by_key(went), "id").join(by_key(came), "id", "left").na.fill(0, ["callers"])
    score = graph.entry_score(F.col("name"), F.col("visibility") == "public", F.col("callers"), F.col("callees"))
    rows = rows.select("id", score.alias("score"), "seq").where(F.col("score") > fixed.ENTRY_POINT_THRESHOLD).orderBy(F.desc("score"), "seq")
    return (rows if most is None else rows.limit(most)).select("id", "score")


def flow_traces(entries: DataFrame, calls: DataFrame, depth: int = fixed.MAX_TRACE_DEPTH, branches: int = fixed.MAX_BRANCHES) -> DataFrame:
    """(entry, path, cyclic): the longest chain of calls from each entry.

    A chain never visits an id twice; from an id only the first ``branches`` callees (by
    seq) are followed; of equally long chains the one found first, depth first, stays.
    Rows are the edges within reach of an entry, not its chains; the search goes on
    inside the entry's own task.  ``calls`` has src, dst, seq.
    """
    w = Window.partitionBy("src").orderBy("seq", "dst")
    few = cut(calls.groupBy("src", "dst").agg(F.min("seq").alias("seq")).withColumn("k", F.row_number().over(w)).where(F.col("k") <= branches).select("src", "dst", "k"))
    near = reach(few, entries, depth).select(F.col("seed").alias("entry"), "id").union(entries.select(F.col("id").alias("entry"), "id")).distinct()
    own = near.join(by_key(few), F.col("id") == F.col("src")).select("entry", "src", "dst", "k")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[str, list[str]] = {}
        for r in pdf.sort_values("k").itertuples():
            near.setdefault(r.src, []).append(r.dst)
        path, cyclic = longest_chain(near, pdf.entry.iloc[0], depth, branches)
        return pd.DataFrame([(pdf.entry.iloc[0], path, cyclic)] if len(path) > 1 else [], columns=["entry", "path", "cyclic"])

    return own.groupBy("entry").applyInPandas(solve, "entry string, path array<string>, cyclic boolean")


def longest_chain(adjacency: dict[str, list[str]], entry: str, depth: int = fixed.MAX_TRACE_DEPTH, branches: int = fixed.MAX_BRANCHES) -> tuple[list[str], bool]:
    """The longest chain from one entry and whether a chain came back to itself, by depth-first search."""
    best, cyclic = [entry], False
    stack: list[tuple[list[str], Iterator[str]]] = [([entry], iter(adjacency.get(entry, [])[:branches]))]
    while stack:
        path, rest = stack[-1]
        nxt = next(rest, None)
        if nxt is None or len(path) >= depth:
            stack.pop()
        elif nxt in path:
            cyclic = True
        else:
            path = [*path, nxt]
            if len(path) > len(best):
                best = path
            stack.append((path, iter(adjacency.get(nxt, [])[:branches])))
    return best, cyclic


def distinct_traces(traces: DataFrame, entries: DataFrame) -> DataFrame:
    """One trace per path, that of the best entry (G7, O12); ``entries`` has id, score."""
    t = traces.join(by_key(entries.select(F.col("id").alias("entry"), "score")), "entry")
    w = Window.partitionBy("path").orderBy(F.desc("score"), "entry")
    return t.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def processes(traces: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Processes (id, name, entry_point) and their steps (process_id, step_order, symbol_id)."""
    named = by_key(symbols.select("id", "name"))
    t = traces.select("entry", "path", "score", F.element_at("path", -1).alias("last"))
    t = t.join(named.select(F.col("id").alias("entry"), F.col("name").alias("a")), "entry").join(named.select(F.col("id").alias("last"), F.col("name").alias("b")), "last")
    i = F.row_number().over(Window.orderBy(F.desc("score"), "entry")) - 1
    safe = F.lower(F.substring(F.regexp_replace("a", "[^a-zA-Z0-9]", "_"), 1, 24))
    t = cut(t.withColumn("id", F.concat(F.lit("process_"), i.cast("string"), F.lit("_"), safe)))
    heads = t.select("id", F.concat(text.capitalised(F.col("a")), F.lit(" → "), text.capitalised(F.col("b"))).alias("name"), F.col("entry").alias("entry_point"))
    return heads, t.select(F.col("id").alias("process_id"), F.posexplode("path").alias("step_order", "symbol_id"))


def data_flow(steps: DataFrame, calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(process_id, src, dst, data_type): calls between steps that follow each other, with the type the first returns."""
    from codeloom.operators.relate import consecutive

    return consecutive(steps, calls).join(symbols.select(F.col("id").alias("src"), text.returned_type(F.col("signature")).alias("data_type")), "src").select("process_id", "step_order", "src", "dst", "data_type")


def budget(costs: list[int], limit: int) -> list[bool]:
    """Which of the items in order are taken: each that still fits; 0 is no limit."""
    used, out = 0, []
    for c in costs:
        take = not limit or used + c <= limit
        used += c if take else 0
        out.append(take)
    return out


def token_slice(found: DataFrame, limit: int, max_depth: int = fixed.MAX_DEPTH) -> DataFrame:
    """(seed, id, depth, tokens, taken, reason): a context that fits a budget.

    ``found`` has seed, id, depth, tokens, pinned.  Pinned rows come first and are always
    taken; then, by depth and id, each row that still fits is taken and others are passed
    over.  Rows deeper than ``max_depth`` are never taken.  reason: complete, token_budget
    or max_depth.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pinned", "depth", "id"], ascending=[False, True, True])
        pinned, near = pdf.pinned.to_numpy(bool), (pdf.depth <= max_depth).to_numpy()
        free = ~pinned & near
        left = limit - int(pdf.tokens[pinned].sum())
        taken = pinned.copy()
        taken[free] = budget(pdf.tokens[free].tolist(), left) if left > 0 else not limit
        reason = "token_budget" if (free & ~taken).any() else "max_depth" if (~pinned & ~near).any() else "complete"
        return pdf.assign(taken=taken, reason=reason)[["seed", "id", "depth", "tokens", "taken", "reason"]]

    return found.select("seed", "id", "depth", "tokens", "pinned").groupBy("seed").applyInPandas(solve, "seed string, id string, depth int, tokens long, taken boolean, reason string")

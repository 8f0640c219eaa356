"""Method resolution: C3 order of class hierarchies, overrides and implementations."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.cluster import connected
from codeloom.operators.relate import first_by
from codeloom.session import by_key


def breadth_first(parents: dict[str, list[str]], start: str) -> list[str]:
    out, queue = [], list(parents.get(start, []))
    while queue:
        x = queue.pop(0)
        if x != start and x not in out:
            out.append(x)
            queue += parents.get(x, [])
    return out


def c3(parents: dict[str, list[str]], start: str, known: dict[str, list[str] | None] | None = None) -> list[str] | None:
    """Ancestors by C3 linearisation; None for cycles and orders that contradict each other.

    ``known`` keeps the orders of classes already solved; each class is solved once, after
    its parents, without recursion.
    """
    known = {} if known is None else known
    open_: set[str] = set()
    stack = [start]
    while stack:
        c = stack[-1]
        if c in known:
            stack.pop()
            continue
        own = parents.get(c, [])
        left = [p for p in own if p not in known]
        if left and c not in open_:
            open_.add(c)
            stack += left
        else:  # a parent that is still open stands above its own child
            known[c] = None if left else _merge([known[p] for p in own], own)
            open_.discard(c)
            stack.pop()
    return known[start]


def _merge(orders: list[list[str] | None], own: list[str]) -> list[str] | None:
    if any(x is None for x in orders):
        return None
    if len(own) < 2:
        return [*own, *(orders[0] if own else [])]
    lists = [[p, *x] for p, x in zip(own, orders, strict=True)] + [list(own)]
    at = [0] * len(lists)
    behind = Counter(c for x in lists for c in x[1:])  # how many lists have a class behind their head
    out: list[str] = []
    while any(i < len(x) for i, x in zip(at, lists, strict=True)):
        head = next((x[i] for i, x in zip(at, lists, strict=True) if i < len(x) and not behind[x[i]]), None)
        if head is None:
            return None
        out.append(head)
        for k, x in enumerate(lists):
            if at[k] < len(x) and x[at[k]] == head:
                at[k] += 1
                if at[k] < len(x):
                    behind[x[at[k]]] -= 1
    return out


def linearise(heritage: DataFrame) -> DataFrame:
    """(class, position, ancestor, consistent): C3 where it exists, else breadth first.

    ``heritage`` has child, parent, seq (the order of a child's parents).  A hierarchy is
    solved in the task of its connected component.
    """
    pairs = heritage.where("child <> parent").select(F.least("child", "parent").alias("a"), F.greatest("child", "parent").alias("b")).distinct()
    h = heritage.join(by_key(connected(pairs)), F.col("child") == F.col("id")).select("component", "child", "parent", "seq")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        parents: dict[str, list[str]] = {}
        for r in pdf.sort_values(["seq", "parent"]).itertuples():
            if r.parent not in parents.setdefault(r.child, []):
                parents[r.child].append(r.parent)
        rows, known = [], {}
        for c in sorted(parents):
            order = c3(parents, c, known)
            rows += [(c, i, a, order is not None) for i, a in enumerate(order if order is not None else breadth_first(parents, c))]
        return pd.DataFrame(rows, columns=["class", "position", "ancestor", "consistent"])

    return h.groupBy("component").applyInPandas(solve, "class string, position int, ancestor string, consistent boolean")


def overrides(order: DataFrame, methods: DataFrame) -> DataFrame:
    """(src, dst, rel_type): own methods and those of ancestors they stand for.

    ``methods`` has id, owner, name, params (null matches any), abstract, owner_kind.  In
    the order of ancestors each interface's method is implemented, up to the first class
    that has the method, which is overridden; abstract methods override nothing.
    """
    own = methods.where("not abstract").select(F.col("id").alias("src"), F.col("owner").alias("class"), "name", "params")
    up = methods.select(F.col("id").alias("dst"), F.col("owner").alias("ancestor"), F.col("name").alias("n2"), F.col("params").alias("p2"), (F.col("owner_kind") == "interface").alias("interface"))
    found = own.join(by_key(order), "class").join(by_key(up), "ancestor").where("name = n2 and (params is null or p2 is null or params = p2)")
    concrete = found.where("not interface").groupBy("src").agg(F.min("position").alias("stop"))
    kept = found.join(by_key(concrete), "src", "left").where("stop is null or position <= stop")
    kept = kept.where("interface or position = stop")
    return kept.select("src", "dst", F.when(F.col("interface"), "methodImplements").otherwise("overrides").alias("rel_type")).distinct()


def member_calls(calls: DataFrame, order: DataFrame, methods: DataFrame) -> DataFrame:
    """(call_id, id): the method that a call (call_id, receiver_class, name) runs: the class's own, else the first ancestor's."""
    own = calls.select("call_id", "name", F.col("receiver_class").alias("owner"), F.lit(-1).alias("position"))
    up = calls.join(by_key(order), F.col("receiver_class") == F.col("class")).select("call_id", "name", F.col("ancestor").alias("owner"), "position")
    return first_by(own.union(up).join(by_key(methods.select("id", "owner", "name")), ["owner", "name"]), ["call_id"], F.col("position"), F.col("id")).select("call_id", "id")


def receiver_type(expression: str, variables: dict[str, str], returns: dict[tuple[str, str], str], functions: dict[str, str] | None = None) -> str | None:
    """The type of a chain like a.b().c(), or None if a link is unknown."""
    kind: str | None = None
    for i, part in enumerate(expression.split(".")):
        name = part.split("(", 1)[0].strip()
        if i == 0:
            kind = (functions or {}).get(name) if "(" in part else variables.get(name, name if name[:1].isupper() else None)
        else:
            kind = returns.get((kind or "", name))
        if kind is None:
            return None
    return kind

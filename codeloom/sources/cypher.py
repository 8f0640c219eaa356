"""A small part of Cypher as DataFrame plans: MATCH of one node or one hop, WHERE, RETURN, ORDER BY, SKIP, LIMIT.

Labels name node tables (column id), relation types name edge tables (src, dst).  A hop
with *1..n is a bounded traversal.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators.traverse import reach

_NODE = r"\(\s*(\w+)\s*(?::\s*(\w+))?\s*(\{[^}]*\})?\s*\)"
_HOP = r"(<)?-\[\s*\w*\s*:?\s*([\w|:]*)\s*(?:\*\s*1\s*\.\.\s*(\d+))?\s*\]-(>)?"
_SHAPE = re.compile(rf"^\s*MATCH\s+{_NODE}(?:\s*{_HOP}\s*{_NODE})?(?:\s+WHERE\s+(.*?))?\s+RETURN\s+(DISTINCT\s+)?(.*?)(?:\s+ORDER\s+BY\s+(.*?))?(?:\s+SKIP\s+(\d+))?(?:\s+LIMIT\s+(\d+))?\s*$", re.I | re.S)


def _value(token: str, params: dict) -> Column:
    if token.startswith("$"):
        v = params[token[1:]]
        return F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else F.lit(v)
    if token[:1] in "'\"":
        return F.lit(token[1:-1])
    if re.fullmatch(r"-?\d+", token):
        return F.lit(int(token))
    if m := re.fullmatch(r"(?i)toLower\((.*)\)", token):
        return F.lower(_value(m[1].strip(), params))
    if m := re.fullmatch(r"(?i)CAST\((.*)\s+AS\s+INT64\)", token):
        return _value(m[1].strip(), params).try_cast("long")
    if m := re.fullmatch(r"(\w+)\.(\w+)", token):
        return F.col(f"`{m[1]}.{m[2]}`")
    raise ValueError(f"not understood: {token}")


_TERM = r"(?:toLower\([^()]*\)|CAST\([^()]*\)|\$\w+|'[^']*'|\"[^\"]*\"|-?\d+|\w+\.\w+)"


def _test(text: str, params: dict) -> Column:
    text = text.strip()
    for word, join in ((r"\s+OR\s+", lambda a, b: a | b), (r"\s+AND\s+", lambda a, b: a & b)):
        if len(parts := re.split(word, text, flags=re.I)) > 1:
            out = _test(parts[0], params)
            for p in parts[1:]:
                out = join(out, _test(p, params))
            return out
    if m := re.fullmatch(rf"(?is)NOT\s+(.*)", text):
        return ~_test(m[1], params)
    if m := re.fullmatch(rf"(?i)({_TERM})\s+IS\s+(NOT\s+)?NULL", text):
        c = _value(m[1], params)
        return c.isNotNull() if m[2] else c.isNull()
    m = re.fullmatch(rf"(?i)({_TERM})\s*(<>|<=|>=|=|<|>|CONTAINS|STARTS\s+WITH|ENDS\s+WITH|IN)\s*({_TERM})", text)
    if not m:
        raise ValueError(f"not understood: {text}")
    a, op, b = _value(m[1], params), re.sub(r"\s+", " ", m[2].upper()), _value(m[3], params)
    return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}.get(op) if op[0] in "=<>" else {"CONTAINS": lambda: a.contains(b), "STARTS WITH": lambda: a.startswith(b), "ENDS WITH": lambda: a.endswith(b), "IN": lambda: F.array_contains(b, a)}[op]()


def run(tables: dict[str, DataFrame], query: str, params: dict | None = None, prefix: str = "") -> DataFrame:
    """The rows of a query over named tables; ``prefix`` stands before every name, as namespaces do."""
    params = params or {}
    m = _SHAPE.match(query)
    if not m:
        raise ValueError(f"not understood: {query}")
    a, la, pa_, back, rel, most, ahead, b, lb, pb, where, distinct, returned, order, skip, limit = m.groups()

    def nodes(name: str, label: str | None, props: str | None) -> DataFrame:
        df = tables[prefix + (label or "Symbol")]
        df = df.select(*[F.col(f"`{c}`").alias(f"{name}.{c}") for c in df.columns])
        for k, v in re.findall(rf"(\w+)\s*:\s*({_TERM})", props or ""):
            df = df.where(F.col(f"`{name}.{k}`") == _value(v, params))
        return df

    rows = nodes(a, la, pa_)
    if b:
        edges = None
        for r in re.split(r"[|:]+", rel):
            e = tables[prefix + r].select("src", "dst")
            edges = e if edges is None else edges.union(e)
        if most:
            found = reach(edges, rows.select(F.col(f"`{a}.id`").alias("id")), int(most), "up" if back else "down")
            pairs = found.select(F.col("seed").alias("__a"), F.col("id").alias("__b"))
        else:
            x, y = ("dst", "src") if back else ("src", "dst")
            pairs = edges.select(F.col(x).alias("__a"), F.col(y).alias("__b"))
            if not back and not ahead:
                pairs = pairs.union(pairs.select("__b", "__a"))
        rows = rows.join(pairs, F.col(f"`{a}.id`") == F.col("__a")).join(nodes(b, lb, pb), F.col("__b") == F.col(f"`{b}.id`"))
    if where:
        rows = rows.where(_test(where, params))
    columns, counts = [], []
    for item in re.split(r",(?![^()]*\))", returned):
        e, _, alias = re.match(r"(?is)^\s*(.*?)(\s+AS\s+(\w+))?\s*$", item).groups()
        if c := re.fullmatch(r"(?i)count\(\s*(DISTINCT\s+)?(\w+)(?:\.(\w+))?\s*\)", e):
            key = F.col(f"`{c[2]}.{c[3] or 'id'}`")
            counts.append((F.count_distinct(key) if c[1] else F.count(key)).alias(alias or "count"))
        elif re.fullmatch(r"\w+", e):
            columns += [F.col(f"`{c}`").alias(c.replace(".", "_")) for c in rows.columns if c.startswith(e + ".")]
        else:
            columns.append(_value(e, params).alias(alias or e.replace(".", "_")))
    rows = rows.groupBy(*columns).agg(*counts) if counts else rows.select(*columns)
    if distinct:
        rows = rows.distinct()
    if order:
        keys = [re.match(r"\s*([\w.]+)(?:\s+(ASC|DESC))?\s*$", x, re.I).groups() for x in order.split(",")]
        rows = rows.orderBy(*[F.desc(k.replace(".", "_")) if (d or "").upper() == "DESC" else F.col(k.replace(".", "_")) for k, d in keys])
    if skip:
        rows = rows.offset(int(skip))
    return rows.limit(int(limit)) if limit else rows

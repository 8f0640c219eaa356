"""Joins with a rule: intervals, priorities, prefixes, preferences; degrees and anti-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import fixed, graph
from codeloom.session import by_key, cut, cut_and_count

#: Lines that one cell of the interval joins spans.
CELL = 256
#: Lines with their symbols that every machine may hold.
FEW_LINES = 1_000_000


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the order (O11, A22); only first rows of each task are shuffled."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") == 1).drop("__r")


def ordinal(df: DataFrame, keys: list[str], order: str, name: str = "ordinal") -> DataFrame:
    """Number from 0 within the keys."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).cast("int"))


def neighbours(edges: DataFrame, nodes: DataFrame, ids: DataFrame, direction: str, rel_types: tuple[str, ...] | None = None) -> DataFrame:
    """Distinct nodes one edge away from the ids: (of, columns of nodes)."""
    if rel_types is not None:
        edges = edges.where(F.col("rel_type").isin(*rel_types))
    a, b = ("src", "dst") if direction == "down" else ("dst", "src")
    pairs = edges.join(ids.select(F.col("id").alias("of")), F.col(a) == F.col("of"), "inner").select("of", F.col(b).alias("id")).distinct()
    return pairs.join(nodes, "id")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree, role; each side is counted before it is joined."""
    came = edges.groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src", "rel_type").alias("in_degree"))
    went = edges.groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst", "rel_type").alias("out_degree"))
    both = nodes.select("id").join(came, "id", "left").join(went, "id", "left").na.fill(0, ["in_degree", "out_degree"])
    return both.withColumn("role", graph.role(F.col("in_degree"), F.col("out_degree")))


def uncalled(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Symbols that no call goes to."""
    return symbols.join(calls.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")


def _cells(df: DataFrame, start: str, end: str) -> DataFrame:
    cell = lambda c: F.floor(F.col(c) / CELL)
    return df.withColumn("__cell", F.explode(F.sequence(cell(start), F.greatest(cell(start), cell(end)))))


def overlaps(symbols: DataFrame, hunks: DataFrame) -> DataFrame:
    """Symbols (file_path, start_line, end_line) that a hunk (path, old_path, status, hunk_start, hunk_lines) touches.

    Deleted files and changes without a hunk touch all of a file; renamed files are looked
    for under both paths.  A hunk of no lines touches its own line.  Both sides are cut
    into cells of lines, so that the join is on (path, cell), not on all pairs of a path.
    """
    h = hunks.select("path", "old_path", "status", "hunk_start", "hunk_lines")
    h = h.unionByName(h.where("old_path is not null").withColumn("path", F.col("old_path"))).distinct()
    whole = h.where((F.col("status") == "deleted") | F.col("hunk_start").isNull()).select(F.col("path").alias("file_path")).distinct()
    part = h.where((F.col("status") != "deleted") & F.col("hunk_start").isNotNull())
    part = part.select(F.col("path").alias("file_path"), F.col("hunk_start").alias("__a"), (F.col("hunk_start") + F.greatest(F.col("hunk_lines"), F.lit(1)) - 1).alias("__b")).distinct()
    hit = _cells(symbols, "start_line", "end_line").join(_cells(part, "__a", "__b"), ["file_path", "__cell"]).where("start_line <= __b and end_line >= __a").select("id").distinct()
    all_of = symbols.join(whole, "file_path", "left_semi").select("id")
    return symbols.join(hit.union(all_of).distinct(), "id", "left_semi")


def covering(points: DataFrame, symbols: DataFrame, mode: str = "first", few: int = FEW_LINES) -> DataFrame:
    """For each point (point_id, file_path, line) the symbol around it.

    ``first``: the first by seq whose lines hold it; ``enclosing``: the smallest that does.
    A symbol's lines are cut into blocks of 2^k lines at multiples of 2^k, at most two of a
    size, and each block keeps only its best symbol.  A line then asks the one block of each
    size that holds it: rows follow both inputs, however many symbols lie over a line.
    Points are made and written once; up to ``few`` lines with a symbol go to the points,
    which are not shuffled then.
    """
    s = symbols.select("id", "file_path", F.col("start_line").cast("long").alias("__a"), (F.col("end_line").cast("long") + 1).alias("__b"), "seq").where("__a < __b")
    rank = ["seq", "id"] if mode == "first" else ["lines", "seq", "id"]
    s = s.groupBy("file_path", "__a", "__b").agg(F.min(F.struct(*[(F.col("__b") - F.col("__a")).alias("lines") if c == "lines" else F.col(c) for c in rank])).alias("best"))
    shift = "shiftright({}, k)".format
    low, high = shift("__a + shiftleft(1L, k) - 1"), shift("__b")  # the blocks of a size from __a on, and up to __b
    two = f"array(if({low} < {high} and ({low} & 1) = 1, {low}, null), if({low} < {high} and ({high} & 1) = 1, {high} - 1, null))"
    blocks = f"flatten(transform(sequence(0, length(bin(__b - __a)) - 1), k -> transform(array_compact({two}), c -> struct(k as k, c as c))))"
    cells = s.select("file_path", F.expr(f"explode({blocks})").alias("__x"), "best").groupBy("file_path", "__x.k", "__x.c").agg(F.min("best").alias("best"))
    top = cells.agg(F.coalesce(F.max("k"), F.lit(0)).alias("top"))  # one row
    p = cut(points.select("point_id", "file_path", "line").distinct())
    lines = p.select("file_path", "line").where("line is not null").distinct().crossJoin(F.broadcast(top))
    asked = lines.select("file_path", "line", F.explode(F.sequence(F.lit(0), "top")).alias("k")).withColumn("c", F.expr("shiftright(cast(line as long), k)"))
    best = asked.join(cells, ["file_path", "k", "c"]).groupBy("file_path", "line").agg(F.min("best").alias("best"))
    best, n = cut_and_count(best.select("file_path", "line", "best.id"))
    return p.join(F.broadcast(best) if n <= few else by_key(best), ["file_path", "line"]).select("point_id", "file_path", "line", "id")


def tiered(refs: DataFrame, tiers: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Each reference's symbol in the first tier that has one: (ref_id, id, tier, confidence).

    Tiers are candidates (the keys, id, seq) of references with such keys, in the order of
    priority; inside a tier the smallest seq wins, and so it does among references of one
    ref_id.  References that no tier resolves have null id and confidence.
    """
    rows = None
    for rank, (name, found) in enumerate(tiers.items()):
        own = found.select(*keys, "id", "seq", F.lit(rank).alias("rank"), F.lit(name).alias("tier"), F.lit(fixed.TIERS.get(name, 0.5)).alias("confidence"))
        rows = own if rows is None else rows.unionByName(own)
    best = first_by(rows, keys, F.col("rank"), F.col("seq"), F.col("id"))
    w = Window.partitionBy("ref_id").orderBy(F.asc_nulls_last("rank"), "seq", "id")
    first = F.first(F.when(F.col("ref_id").isNotNull(), F.struct("id", "tier", "confidence"))).over(w)
    return refs.join(best, keys, "left").select("ref_id", first.alias("f")).select("ref_id", "f.id", "f.tier", "f.confidence")


def resolve_names(refs: DataFrame, symbols: DataFrame, imports: DataFrame, bindings: DataFrame | None = None) -> DataFrame:
    """References (ref_id, file_path, name) by tiers: same file, named binding, imported files, package folder, anywhere.

    ``imports`` has file_path, imported_file; ``bindings`` has file_path, name, id.  In a
    file the last symbol of a name counts; a name anywhere counts if it is the only one.
    Each file and name is resolved once, however many references have it, and of a
    package's folder the first two symbols of a name are enough: one is of another file.
    """
    s = symbols.select("id", "name", "file_path", "seq", F.regexp_replace("file_path", "[^/]*$", "").alias("dir"))
    last = first_by(s, ["file_path", "name"], F.desc("seq"))
    r = refs.select("file_path", "name").distinct().withColumn("dir", F.regexp_replace("file_path", "[^/]*$", ""))
    same = r.join(last.select("file_path", "name", "id", "seq"), ["file_path", "name"])
    tiers = {"same-file": same}
    if bindings is not None:
        tiers["named"] = r.join(bindings.select("file_path", "name", "id").withColumn("seq", F.lit(0)), ["file_path", "name"])
    tiers["import-scoped"] = r.join(imports.select("file_path", F.col("imported_file").alias("f")), "file_path").join(last.select(F.col("file_path").alias("f"), "name", "id", "seq"), ["f", "name"])
    two = last.withColumn("r", F.row_number().over(Window.partitionBy("dir", "name").orderBy("seq", "id"))).where("r <= 2").select("dir", "name", "id", "seq", F.col("file_path").alias("f"))
    tiers["package"] = r.join(two, ["dir", "name"]).where("file_path <> f")
    only = s.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.min("seq").alias("seq")).where("n = 1")
    tiers["global"] = r.join(only, "name")
    return tiered(refs, tiers, ["file_path", "name"])


def longest_prefix(paths: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Each path (path) with the first (by ord) prefix (prefix, target, ord) it starts with, replaced.

    Prefixes end at a separator, or are whole paths, so that a path has as many candidates
    as it has folders and the join is an equality.
    """
    p = paths.select("path").distinct()
    cuts = F.expr("transform(sequence(1, size(split(path, '/'))), k -> substring_index(path, '/', k))")
    c = p.select("path", F.explode(F.array_distinct(F.concat(cuts, F.transform(cuts, lambda x: F.concat(x, F.lit("/")))))).alias("prefix")).where(F.col("path").startswith(F.col("prefix")))
    hit = first_by(c.join(prefixes, "prefix"), ["path"], F.col("ord"), F.col("prefix"))
    return p.join(hit.select("path", "prefix", F.concat("target", F.expr("substring(path, length(prefix) + 1)")).alias("resolved")), "path", "left")


def heritage(pairs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(ref_id, child_id, parent_id): child by name, in its own file if there is one; the first other symbol of the parent's name.

    Names are reduced before they are joined: to the first symbol of a name and file, the
    first of a name, and the first two ids of a name, one of which is not the child.
    """
    first = F.min(F.struct("seq", "id"))
    by_name = symbols.groupBy(F.col("name").alias("child")).agg(first.alias("any"))
    by_file = symbols.groupBy(F.col("name").alias("child"), "file_path").agg(first.alias("own"))
    child = pairs.join(by_name, "child").join(by_file, ["child", "file_path"], "left")
    child = first_by(child, ["ref_id"], F.col("own").isNull(), F.coalesce("own.seq", "any.seq")).select("ref_id", "parent", F.when(F.col("own").isNotNull(), F.col("own.id")).otherwise(F.col("any.id")).alias("child_id"))
    ids = symbols.where("id is not null").groupBy("name", "id").agg(F.min("seq").alias("seq"))
    ids = ids.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy("seq", "id"))).where("r <= 2")
    two = ids.groupBy(F.col("name").alias("parent")).agg(*[F.min(F.when(F.col("r") == r, F.col("id"))).alias(c) for r, c in ((1, "one"), (2, "two"))])
    found = child.where("child_id is not null").join(two, "parent").select("ref_id", "child_id", F.when(F.col("one") != F.col("child_id"), F.col("one")).otherwise(F.col("two")).alias("parent_id"))
    return found.where("parent_id is not null")


def imported_symbols(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst, rel_type): an external import joins every symbol of its file to the package."""
    ext = imports.select("file_path", F.col("package_id").alias("dst")).distinct()
    return symbols.join(ext, "file_path").select(F.col("id").alias("src"), "dst", F.lit("dependsOn").alias("rel_type"))


def accessed_keys(hints: DataFrame, symbols: DataFrame) -> DataFrame:
    """id, accessed_keys: keys that hints (child_id, target_name, seq) read in a symbol, distinct, as first seen."""
    first = hints.groupBy("child_id", "target_name").agg(F.min("seq").alias("seq"))
    keys = first.groupBy("child_id").agg(F.array_sort(F.collect_list(F.struct("seq", "target_name"))).alias("k"))
    keys = keys.select(F.col("child_id").alias("id"), F.transform("k", lambda x: x["target_name"]).alias("accessed_keys"))
    return symbols.select("id").join(keys, "id", "left").withColumn("accessed_keys", F.coalesce("accessed_keys", F.array().cast("array<string>")))


def contract_drift(routes: DataFrame, consumers: DataFrame) -> DataFrame:
    """Per consumer: keys that it reads and no route of the path returns.

    routes: path, keys; consumers: consumer, path, keys.
    """
    offered = routes.select("path", F.explode_outer("keys").alias("k")).groupBy("path").agg(F.array_sort(F.collect_set("k")).alias("available"))
    joined = consumers.join(offered, "path").withColumn("missing", F.array_except("keys", "available"))
    return joined.select("consumer", "path", "available", "missing", F.when(F.size("missing") > 0, "high").otherwise("low").alias("severity"))


def union_drift(routes: DataFrame, consumers: DataFrame) -> DataFrame:
    """(consumer, name, file_path, key, confidence): keys that a consumer reads and no route at all returns.

    routes: file_path, keys; consumers: consumer, name, file_path, keys.  A consumer beside
    several routes, or beside none where there are several, is judged with low confidence
    (A13).  Without routes nothing is known, so nothing is reported.
    """
    offered = routes.select(F.explode("keys").alias("key")).distinct()
    read = consumers.select("consumer", "name", "file_path", F.explode(F.array_distinct("keys")).alias("key"))
    missing = read.join(offered, "key", "left_anti")
    beside = routes_in_file(consumers, routes)
    level = F.when(F.col("routes") > 1, "low").otherwise("high")
    return missing.join(beside.select("consumer", "routes"), "consumer").where("routes > 0").select("consumer", "name", "file_path", "key", level.alias("confidence"))


def result_edges(dependents: DataFrame, changed: DataFrame, limit: int) -> DataFrame:
    """(src, dst, rel_type): every dependent with every changed symbol, the first ``limit`` by their ids.

    The limit is the answer's size; no more of either side than it can take part, so the
    product is of two bounded sides.
    """
    first = lambda df, name: df.select(F.col("id").alias(name)).distinct().orderBy(name).limit(limit)
    return first(dependents, "src").crossJoin(first(changed, "dst")).orderBy("src", "dst").limit(limit).withColumn("rel_type", F.lit("calls"))


def rename_plan(target: str, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Edits for renaming the symbol with an id: its definition, then places that name it."""
    one = symbols.where(F.col("id") == target).select("id", "file_path", "start_line", F.lit("definition").alias("reason"), F.lit("high").alias("confidence"))
    users = edges.where((F.col("dst") == target) & F.col("rel_type").isin("calls", "imports", "references")).select(F.col("src").alias("id"), F.col("rel_type").alias("reason")).distinct()
    users = users.join(symbols, "id").select("id", "file_path", "start_line", "reason", F.lit("high").alias("confidence"))
    return one.unionByName(users)


def consecutive(steps: DataFrame, calls: DataFrame) -> DataFrame:
    """(process_id, step_order, src, dst): steps that the next one follows by a call."""
    w = Window.partitionBy("process_id").orderBy("step_order")
    pairs = steps.withColumn("dst", F.lead("symbol_id").over(w)).where("dst is not null").withColumnRenamed("symbol_id", "src")
    return pairs.join(calls.select("src", "dst").distinct(), ["src", "dst"]).select("process_id", "step_order", "src", "dst")


def holding_any(groups: DataFrame, ids: DataFrame) -> DataFrame:
    """The groups (cluster_id, ids) whose list holds any of the ids (id) (F5); lists are joined by element, so that neither side must be small."""
    hit = groups.select("cluster_id", F.explode("ids").alias("id")).join(ids.select("id"), "id", "left_semi").select("cluster_id").distinct()
    return groups.join(hit, "cluster_id", "left_semi")


def routes_in_file(consumers: DataFrame, routes: DataFrame) -> DataFrame:
    """(consumer, file_path, routes): how many routes the file of a consumer declares; where it declares none, how many there are."""
    n = routes.groupBy("file_path").agg(F.count("*").alias("n"))
    total = routes.agg(F.count("*").alias("total"))  # one row
    return consumers.select("consumer", "file_path").join(n, "file_path", "left").crossJoin(F.broadcast(total)).select("consumer", "file_path", F.coalesce("n", "total").alias("routes"))


def import_fan_out(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """(edges, most): how many edges external imports make, and the most that one makes (A18); counted by file, without the edges."""
    n = symbols.groupBy("file_path").agg(F.count("*").alias("n"))
    each = imports.select("file_path", "package_id").distinct().join(n, "file_path")
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edges"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))


def affected_groups(reached: DataFrame, members: DataFrame, steps: DataFrame) -> DataFrame:
    """(seed, kind, group_id): clusters and processes that hold what a seed reaches (seed, id), one row of each."""
    r = reached.select("seed", "id")
    clusters = r.join(members.select("id", F.col("cluster_id").alias("group_id")), "id").select("seed", F.lit("cluster").alias("kind"), "group_id")
    flows = r.join(steps.select(F.col("symbol_id").alias("id"), F.col("process_id").alias("group_id")), "id").select("seed", F.lit("process").alias("kind"), "group_id")
    return clusters.distinct().unionByName(flows.distinct())

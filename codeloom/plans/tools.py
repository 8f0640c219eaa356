"""The questions that a user asks of the graph, each as one plan over symbols and edges.

Functions take DataFrames and give DataFrames; ``TOOLS`` names them with their parameters
for callers that dispatch by name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import fixed, graph, text
from codeloom.operators import flows, relate, search, traverse
from codeloom.session import cut
from codeloom.sources import gitdiff


def find_hotspots(symbols: DataFrame, least: int = 10, limit: int = 50, offset: int = 0) -> DataFrame:
    """Symbols more complex than ``least``, most complex first (O1)."""
    cols = ["id", "name", "cyclomatic", "cognitive", "max_loop_depth"]
    rows = symbols.where(F.col("cyclomatic") > least).select(*cols).orderBy(F.desc("cyclomatic"), "id")
    return (rows.offset(offset) if offset else rows).limit(limit)


def find_dead_code(symbols: DataFrame, calls: DataFrame, kinds: tuple[str, ...] | None = None, limit: int | None = None) -> DataFrame:
    """Symbols that nothing calls, that aren't exported and whose names start no flow; total_found beside each if limited."""
    rows = relate.uncalled(symbols, calls)
    if kinds:
        rows = rows.where(F.col("kind").isin(*kinds))
    rows = rows.where(~graph.is_exported(F.col("visibility"), F.col("kind")) & ~graph.is_entry_name(F.col("name")))
    if limit is None:
        return rows
    total = rows.count()
    return rows.orderBy("id").limit(limit).withColumn("total_found", F.lit(total))


def impact(symbols: DataFrame, edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(seed, id, name, depth, hop_bucket, rel_type, role, confidence, reasons, risk): what a change of the seeds reaches."""
    found = traverse.reach(edges, seeds, max_depth, "up", ("calls",))
    direct = edges.groupBy("src", F.col("dst").alias("seed")).agg(F.min("rel_type").alias("rel_type")).withColumnRenamed("src", "id")
    rows = found.join(direct, ["seed", "id"], "left").withColumn("rel_type", F.coalesce("rel_type", F.lit("calls")))
    ids = found.select("id").distinct()
    near = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select(*edges.columns).unionByName(edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns))
    rows = rows.join(symbols.select("id", "name", "kind", "visibility"), "id").join(relate.degrees(ids, near), "id")
    exported = graph.is_exported(F.col("visibility"), F.col("kind"))
    per_seed = Window.partitionBy("seed")
    return rows.select(
        "seed", "id", "name", "depth", F.least("depth", F.lit(2)).alias("hop_bucket"), "rel_type", "role",
        graph.affected_confidence(F.col("depth"), F.col("rel_type"), F.col("role"), exported).alias("confidence"),
        graph.affected_reasons(F.col("depth"), F.col("rel_type"), F.col("role"), F.col("in_degree"), F.col("out_degree"), exported).alias("reasons"),
        graph.risk(F.count("*").over(per_seed), F.max(graph.is_core(F.col("name")).cast("int")).over(per_seed) == 1).alias("risk"),
    )


def impact_of_dependency(symbols: DataFrame, edges: DataFrame, dependencies: DataFrame, value: str) -> DataFrame:
    """The columns of ``impact`` for the external dependency that a name or alias means: the symbols that depend on it."""
    seed = search.dependency_by_alias(dependencies, value).select(F.col("id").alias("seed"))
    users = edges.where("rel_type = 'dependsOn'").join(seed, F.col("dst") == F.col("seed")).select("seed", F.col("src").alias("id")).distinct()
    rows = users.join(symbols.select("id", "name"), "id").join(relate.degrees(users.select("id").distinct(), edges), "id")
    n = rows.groupBy("seed").agg(F.count("*").alias("n"), (F.max(graph.is_core(F.col("name")).cast("int")) == 1).alias("core"))
    return rows.join(n, "seed").select(
        "seed", "id", "name", F.lit(1).alias("depth"), F.lit(1).alias("hop_bucket"), F.lit("dependsOn").alias("rel_type"), "role",
        F.lit(fixed.DEPENDENT).alias("confidence"), F.array(F.lit("edge: dependsOn, its file imports the package")).alias("reasons"), graph.risk(F.col("n"), F.col("core")).alias("risk"),
    )


def impact_groups(found: DataFrame, seeds: DataFrame, members: DataFrame, steps: DataFrame | None) -> DataFrame:
    """(kind, group_id, of): the clusters and processes of the target itself and of what its change reaches, one row of each."""
    touched = found.select("id", F.lit("affected").alias("of")).union(seeds.select("id", F.lit("target")))
    rows = touched.join(members.select("id", F.col("cluster_id").alias("group_id")), "id").select(F.lit("cluster").alias("kind"), "group_id", "of")
    if steps is not None:
        rows = rows.unionByName(touched.join(steps.select(F.col("symbol_id").alias("id"), F.col("process_id").alias("group_id")), "id").select(F.lit("process").alias("kind"), "group_id", "of"))
    return rows.groupBy("kind", "group_id").agg(F.max("of").alias("of"))


def symbol_context(calls: DataFrame, members: DataFrame, seeds: DataFrame, depth: int | None = None, steps: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(seed, section, rank, id, depth): the target, its callers, its callees, who shares its clusters and its processes."""
    one = lambda df, name, rank: df.select("seed", F.lit(name).alias("section"), F.lit(rank).alias("rank"), "id", "depth")
    target = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth"))
    rows = one(target, "target", 0)
    rows = rows.unionByName(one(traverse.reach(calls, seeds, depth, "up"), "caller", 1)).unionByName(one(traverse.reach(calls, seeds, depth, "down"), "callee", 2))
    own = seeds.select(F.col("id").alias("seed")).join(members.select("cluster_id", F.col("id").alias("seed")), "seed")
    near = own.join(members.select("cluster_id", "id"), "cluster_id").where("id <> seed").select("seed", "id", F.lit(1).alias("depth")).distinct()
    rows = rows.unionByName(one(near, "cluster_member", 3))
    if steps is not None:
        flow = seeds.select(F.col("id").alias("seed")).join(steps.select("process_id", F.col("symbol_id").alias("seed")), "seed")
        rows = rows.unionByName(one(flow.select("seed", F.col("process_id").alias("id"), F.lit(0).alias("depth")).distinct(), "process", 4))
    return rows if limit is None else rows.orderBy("rank", "depth", "id").limit(limit)


def within_budget(context: DataFrame, symbols: DataFrame, tokens: int) -> DataFrame:
    """The rows of a context whose symbols fit a budget of tokens together, the target always, nearest first.

    A symbol of several sections counts once; processes are no symbols and stay.
    """
    lines = F.col("end_line") - F.col("start_line") + 1
    cost = symbols.select("id", graph.tokens(F.col("name"), F.col("signature"), F.col("file_path"), lines).alias("tokens"))
    each = context.where("section <> 'process'").groupBy("seed", "id").agg(F.min("depth").alias("depth"), F.max(F.col("section") == "target").alias("pinned"))
    taken = flows.token_slice(each.join(cost, "id"), tokens).where("taken").select("seed", "id", "reason")
    rows = context.where("section <> 'process'").join(taken, ["seed", "id"]).select(*context.columns, "reason")
    return rows.unionByName(context.where("section = 'process'").withColumn("reason", F.lit("complete")))


def data_flow_trace(symbols: DataFrame, calls: DataFrame, seeds: DataFrame, hint: str | None = None) -> DataFrame:
    """(step, id, layer, next_id, synthetic): what the seeds reach, by layer from api to model; links between steps are made up."""
    ids = traverse.reach_any(calls, seeds).select("id").union(seeds.select("id")).distinct()
    layer = graph.layer(F.col("name"), F.col("file_path"), F.col("signature"), F.lit(hint) if hint else None)
    layered = cut(symbols.join(ids, "id", "left_semi").select("id", layer.alias("layer")))  # the patterns are tried once, not for each use
    rows = layered.where("layer <> 'unknown'").withColumn("r", graph.layer_rank(F.col("layer")))
    w = Window.orderBy("r", "id")  # one trace: what one seed set reaches, for one reader
    return rows.select((F.row_number().over(w) - 1).cast("int").alias("step"), "id", "layer", F.lead("id").over(w).alias("next_id"), F.lit(True).alias("synthetic"))


def data_flow_confidence(layers: set[str]) -> float:
    return 0.92 if {"api", "controller", "model"} <= layers else 0.75 if len(layers) > 1 else 0.60


def pre_commit(symbols: DataFrame, calls: DataFrame, files: DataFrame) -> DataFrame:
    """(changed, affected, risk): one row on what a change of the files reaches."""
    seeds = symbols.join(files.select("file_path").distinct(), "file_path", "left_semi").select("id")
    return _blast_radius(symbols, calls, seeds)


def _blast_radius(symbols: DataFrame, calls: DataFrame, seeds: DataFrame) -> DataFrame:
    reached = traverse.reach_any(calls, seeds, None, "up")  # without the seeds
    n = reached.join(symbols.select("id", "name"), "id").agg(F.count("*").alias("affected"), F.coalesce(F.max(graph.is_core(F.col("name")).cast("int")), F.lit(0)).alias("core"))
    return n.crossJoin(seeds.agg(F.count("*").alias("changed"))).select("changed", "affected", graph.risk(F.col("affected"), F.col("core") == 1).alias("risk"))


def pre_commit_edges(symbols: DataFrame, calls: DataFrame, files: DataFrame, limit: int = 100) -> DataFrame:
    """(src, dst, rel_type) of the symbols that a change of the files reaches with those of the files, at most ``limit``."""
    seeds = cut(symbols.join(files.select("file_path").distinct(), "file_path", "left_semi").select("id"))
    return relate.result_edges(traverse.reach_any(calls, seeds, None, "up"), seeds, limit)


def pre_commit_report(symbols: DataFrame, calls: DataFrame, files: DataFrame, members: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """(changed, affected, risk, clusters, processes): ``pre_commit``, and how many clusters and processes hold what is changed or affected."""
    seeds = cut(symbols.join(files.select("file_path").distinct(), "file_path", "left_semi").select("id"))
    touched = cut(traverse.reach_any(calls, seeds, None, "up").select("id").union(seeds).distinct())
    clusters = members.join(touched, "id", "left_semi").agg(F.count_distinct("cluster_id").alias("clusters"))
    if steps is None:
        flows_ = clusters.select(F.lit(0).cast("long").alias("processes"))
    else:
        flows_ = steps.join(touched.withColumnRenamed("id", "symbol_id"), "symbol_id", "left_semi").agg(F.count_distinct("process_id").alias("processes"))
    affected = touched.join(seeds, "id", "left_anti").join(symbols.select("id", "name"), "id")
    n = affected.agg(F.count("*").alias("affected"), F.coalesce(F.max(graph.is_core(F.col("name")).cast("int")), F.lit(0)).alias("core"))
    one = n.crossJoin(seeds.agg(F.count("*").alias("changed"))).crossJoin(clusters).crossJoin(flows_)  # one row each
    return one.select("changed", "affected", graph.risk(F.col("affected"), F.col("core") == 1).alias("risk"), "clusters", "processes")


def pre_commit_answer(report: DataFrame) -> tuple[str, list[str]]:
    """(risk, recommendations) of a ``pre_commit_report``, one row."""
    r = report.first()
    return r.risk, recommendations(r.risk, r.affected, r.processes, r.clusters)


def recommendations(risk: str, affected: int, flows: int, clusters: int) -> list[str]:
    """What to do before a commit, by what it reaches."""
    out = []
    if risk in ("high", "critical"):
        out.append(f"Run the full test suite: {affected} dependents, risk {risk}")
    if flows:
        out.append(f"Check {flows} execution flows")
    if clusters > 1:
        out.append(f"The change crosses {clusters} clusters")
    return out or ["No special care needed"]


def detect_changes(symbols: DataFrame, calls: DataFrame, hunks: DataFrame, granularity: str = "file") -> DataFrame:
    """Blast radius of a diff, by the files of the symbols it touches, or by those symbols alone."""
    hit = relate.overlaps(symbols, hunks)
    if granularity == "file":
        return pre_commit(symbols, calls, hit.select("file_path").distinct())
    return _blast_radius(symbols, calls, hit.select("id"))


def verify_usage(symbols: DataFrame, calls: DataFrame, dynamic: F.Column | None = None) -> DataFrame:
    """(id, callers, verdict, confidence, dead_claim): is each symbol used?

    Exported symbols and those whose names start flows may be used from outside.
    ``dead_claim`` is what becomes of the claim that it is dead.
    """
    n = calls.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers"))
    rows = symbols.join(n, "id", "left").na.fill(0, ["callers"])
    unsure = graph.is_exported(F.col("visibility"), F.col("kind")) | graph.is_entry_name(F.col("name")) if dynamic is None else dynamic
    v = graph.verdict(F.col("callers") > 0, unsure)
    claim = F.when(v == "present", "refuted").when(v == "absent", "confirmed").otherwise("uncertain")
    return rows.select("id", "callers", v.alias("verdict"), graph.verdict_confidence(v).cast("double").alias("confidence"), claim.alias("dead_claim"))


def verify_edges(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, present, rel_types, confidence) for claims src, dst."""
    found = edges.groupBy("src", "dst").agg(F.array_sort(F.collect_set("rel_type")).alias("rel_types"))
    rows = claims.join(found, ["src", "dst"], "left")
    present = F.col("rel_types").isNotNull()
    return rows.select("src", "dst", present.alias("present"), F.coalesce("rel_types", F.array().cast("array<string>")).alias("rel_types"), F.when(present, fixed.PRESENT).otherwise(fixed.ABSENT).alias("confidence"))


def verify_reachability(claims: DataFrame, calls: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(src, dst, present, hops): whether each claim's dst can be reached, all sources in one traversal."""
    found = traverse.reach(calls, claims.select(F.col("src").alias("id")).distinct(), max_depth)
    rows = claims.join(found.select(F.col("seed").alias("src"), F.col("id").alias("dst"), F.col("depth").alias("hops")), ["src", "dst"], "left")
    return rows.select("src", "dst", F.col("hops").isNotNull().alias("present"), "hops")


def trace(symbols: DataFrame, edges: DataFrame, start: str, end: str, max_depth: int | None = None) -> DataFrame:
    """(hop, id, name, file_path) of a shortest path between two symbols given by id or name."""
    a, b = (search.resolve(symbols, x).first() for x in (start, end))
    if a is None or b is None:
        return symbols.sparkSession.createDataFrame([], "hop int, id string, name string, file_path string")
    path = traverse.shortest_path(edges, a.id, b.id, max_depth)
    return path.join(symbols.select("id", "name", "file_path"), "id", "left").select("hop", "id", "name", "file_path").orderBy("hop")


def augment(symbols: DataFrame, calls: DataFrame, pattern: str) -> DataFrame:
    """(id, name, callers, callees): a few symbols that a search pattern may mean, with up to three neighbours each way."""
    words = symbols.sparkSession.range(1).select(text.split_identifier(F.lit(pattern)).alias("w")).first().w
    found = search.augment_candidates(symbols, words)
    named = symbols.select(F.col("id").alias("other"), F.col("name").alias("n"))
    side = lambda a, b, name: calls.select(F.col(a).alias("id"), F.col(b).alias("other")).join(found.select("id"), "id", "left_semi").join(named, "other").groupBy("id").agg(F.slice(F.array_sort(F.collect_set("n")), 1, 3).alias(name))
    rows = found.join(side("dst", "src", "callers"), "id", "left").join(side("src", "dst", "callees"), "id", "left")
    none = F.array().cast("array<string>")
    return rows.select("id", "name", F.coalesce("callers", none).alias("callers"), F.coalesce("callees", none).alias("callees"))


def smart_search(symbols: DataFrame, calls: DataFrame, embeddings: DataFrame, query: list[float], k: int = 10, threshold: float = fixed.SIMILAR) -> DataFrame:
    """(symbol_id, score, name, kind, file_path, dependents): vector hits that are symbols, with callers within five steps."""
    hits = search.semantic_topk(embeddings, query, min(2 * k, 200), threshold).limit(k)
    rows = hits.join(symbols.select(F.col("id").alias("symbol_id"), "name", "kind", "file_path"), "symbol_id")
    near = traverse.reach(calls, hits.select(F.col("symbol_id").alias("id")), 5, "up").groupBy(F.col("seed").alias("symbol_id")).agg(F.count("*").alias("dependents"))
    return rows.join(near, "symbol_id", "left").na.fill(0, ["dependents"])


def shape_check(routes: DataFrame, consumers: DataFrame) -> DataFrame:
    return relate.contract_drift(routes, consumers)


def shape_drift(symbols: DataFrame) -> DataFrame:
    """(consumer, name, file_path, key, confidence) over an indexed graph: symbols that answer with keys are its routes, those that read keys its consumers."""
    routes = symbols.where(F.size("response_keys") > 0).select("file_path", F.col("response_keys").alias("keys"))
    consumers = symbols.where(F.size("accessed_keys") > 0).select(F.col("id").alias("consumer"), "name", "file_path", F.col("accessed_keys").alias("keys"))
    return relate.union_drift(routes, consumers)


def status(symbols: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """One row of counts (A1)."""
    n = lambda df, name, c="*": df.agg((F.count("*") if c == "*" else F.count_distinct(c)).alias(name))
    return n(symbols, "symbols").crossJoin(n(edges, "relationships")).crossJoin(n(members, "clusters", "cluster_id"))


class ToolError(ValueError):
    """A call's error, with its code."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Parameter:
    name: str
    kind: type
    needed: bool = False
    least: float | None = None
    most: float | None = None
    choices: tuple[str, ...] | None = None


#: Tools and their parameters.
TOOLS: dict[str, tuple[Parameter, ...]] = {
    "get_symbol_context": (Parameter("symbol", str, True), Parameter("max_depth", int, least=1, most=20), Parameter("token_budget", int, least=0)),
    "trace_data_flow": (Parameter("entry_point", str, True), Parameter("framework", str)),
    "impact_analysis": (Parameter("target", str, True), Parameter("max_depth", int, least=1, most=20)),
    "smart_search": (Parameter("query", str, True), Parameter("max_results", int, least=1, most=200)),
    "trace": (Parameter("from", str, True), Parameter("to", str, True), Parameter("max_depth", int, least=1, most=20)),
    "detect_changes": (Parameter("scope", str, choices=("unstaged", "staged", "all", "compare")), Parameter("base_ref", str), Parameter("granularity", str, choices=("file", "symbol"))),
    "find_dead_code": (Parameter("kinds", list), Parameter("limit", int, least=1, most=1000)),
    "find_hotspots": (Parameter("min_complexity", int, least=0), Parameter("limit", int, least=1, most=500), Parameter("offset", int, least=0)),
    "rename": (Parameter("symbol", str, True), Parameter("new_name", str, True), Parameter("file", str)),
    "shape_check": (Parameter("route", str),),
    "verify_claim": (Parameter("kind", str, True, choices=("usage", "edge", "reachability")), Parameter("symbol", str), Parameter("from", str), Parameter("to", str)),
    "augment": (Parameter("pattern", str, True),),
}


def check_call(tool: str, arguments: dict) -> dict:
    """The arguments if they fit the tool; a ToolError else."""
    if tool not in TOOLS:
        raise ToolError("UNKNOWN_TOOL", tool)
    for p in TOOLS[tool]:
        if arguments.get(p.name) is None:
            if p.needed:
                raise ToolError("MISSING_PARAMETER", p.name)
            continue
        x = arguments[p.name]
        if not isinstance(x, p.kind) or isinstance(x, bool):
            raise ToolError("INVALID_PARAMETER_TYPE", f"{p.name} must be {p.kind.__name__}")
        if p.kind is str and p.needed and not x.strip() or p.choices and x not in p.choices:
            raise ToolError("INVALID_PARAMETER_VALUE", p.name)
        if (p.least is not None and x < p.least) or (p.most is not None and x > p.most):
            raise ToolError("INVALID_PARAMETER_VALUE", p.name)
    return {p.name: arguments[p.name] for p in TOOLS[tool] if arguments.get(p.name) is not None}


class Engine:
    """A graph's tables and the tools on them, by name or from a sentence."""

    def __init__(self, symbols: DataFrame, edges: DataFrame, members: DataFrame, steps: DataFrame | None = None, hunks: DataFrame | None = None, routes: DataFrame | None = None, consumers: DataFrame | None = None, embeddings: DataFrame | None = None, embed=None, root: str | None = None, dependencies: DataFrame | None = None) -> None:
        self.symbols, self.edges, self.members, self.steps = symbols, edges, members, steps
        self.hunks, self.routes, self.consumers, self.embeddings, self.embed, self.root = hunks, routes, consumers, embeddings, embed, root
        self.dependencies = dependencies
        self.calls = edges.where("rel_type = 'calls'")

    def _impact(self, target: str, max_depth: int | None) -> DataFrame:
        """A symbol of just this id or name first, then a dependency by alias, then a symbol whose name holds it."""
        if self.dependencies is not None and self._seed(target, True).isEmpty() and not search.dependency_by_alias(self.dependencies, target).isEmpty():
            return impact_of_dependency(self.symbols, self.edges, self.dependencies, target)
        return impact(self.symbols, self.edges, self._seed(target), max_depth)

    def affected_groups(self, target: str, max_depth: int | None = None) -> DataFrame:
        """(kind, group_id, of) beside ``impact_analysis`` of a target."""
        found = cut(self._impact(target, max_depth).select("seed", "id"))
        return impact_groups(found, self._seed(target), self.members, self.steps)

    def _seed(self, value: str, by_name: bool = False) -> DataFrame:
        if by_name:
            return self.symbols.where(graph.matches(F.col("id"), F.col("name"), value)).select("id")
        return search.resolve(self.symbols, value).select("id")

    def _hunks(self, scope: str, base_ref: str | None) -> DataFrame:
        """The hunks of a change: those given, or of the repository at ``root``."""
        if self.hunks is not None:
            return self.hunks
        if self.root is None:
            raise ToolError("INVALID_PARAMETER_VALUE", "no hunks and no repository")
        if scope == "compare" and not base_ref:
            raise ToolError("MISSING_PARAMETER", "base_ref")
        return gitdiff.diff(self.symbols.sparkSession, self.root, scope, base_ref)

    def call(self, tool: str, **arguments) -> DataFrame:
        a = check_call(tool, arguments)
        s, c = self.symbols, self.calls
        if tool == "get_symbol_context":
            rows = symbol_context(c, self.members, self._seed(a["symbol"]), a.get("max_depth"), self.steps)
            return within_budget(rows, s, a["token_budget"]) if a.get("token_budget") else rows
        if tool == "trace_data_flow":
            return data_flow_trace(s, c, self._seed(a["entry_point"]), a.get("framework"))
        if tool == "impact_analysis":
            return self._impact(a["target"], a.get("max_depth"))
        if tool == "smart_search":
            if self.embeddings is None or self.embed is None:
                raise ToolError("INVALID_PARAMETER_VALUE", "no embeddings")
            return smart_search(s, c, self.embeddings, self.embed(a["query"]), a.get("max_results", 10))
        if tool == "trace":
            return trace(s, self.edges, a["from"], a["to"], a.get("max_depth"))
        if tool == "detect_changes":
            return detect_changes(s, c, self._hunks(a.get("scope", "unstaged"), a.get("base_ref")), a.get("granularity", "file"))
        if tool == "find_dead_code":
            return find_dead_code(s, c, tuple(a.get("kinds", ())) or None, a.get("limit", 100))
        if tool == "find_hotspots":
            return find_hotspots(s, a.get("min_complexity", 10), a.get("limit", 50), a.get("offset", 0))
        if tool == "rename":
            one = search.resolve(s if "file" not in a else s.where(F.col("file_path") == a["file"]), a["symbol"]).first()
            return relate.rename_plan(one.id if one else "", s, self.edges).withColumn("new_name", F.lit(a["new_name"]))
        if tool == "shape_check":
            if self.routes is None or self.consumers is None:
                if not {"response_keys", "accessed_keys"} <= set(s.columns) or s.where("size(response_keys) > 0 or size(accessed_keys) > 0").isEmpty():
                    raise ToolError("INVALID_PARAMETER_VALUE", "no routes or consumers")
                return shape_drift(s) if "route" not in a else self._impact(a["route"], None).withColumn("mismatches", F.lit(shape_drift(s).count()))
            routes = self.routes if "route" not in a else self.routes.where(F.col("path") == a["route"])
            return shape_check(routes, self.consumers)
        if tool == "augment":
            return augment(s, c, a["pattern"])
        for name in ("symbol",) if a["kind"] == "usage" else ("from", "to"):
            if not a.get(name, "").strip():
                raise ToolError("MISSING_PARAMETER", name)
        ends = {k: a.get(k) for k in ("from", "to")}
        if a["kind"] == "usage":
            return verify_usage(s.where(graph.matches(F.col("id"), F.col("name"), a["symbol"])), c)
        pair = s.sparkSession.createDataFrame([(ends["from"], ends["to"])], "src string, dst string")
        return verify_edges(pair, self.edges) if a["kind"] == "edge" else verify_reachability(pair, c)

    def ask(self, sentence: str) -> tuple[str, float, DataFrame | None]:
        """(intent, confidence, answer) to a sentence; the sentence keeps its case until its target is found."""
        t = F.lit(sentence)
        row = self.symbols.sparkSession.range(1).select(text.sanitize(t).alias("t")).select("t", text.intent(F.col("t")).alias("i"), text.target(F.col("t")).alias("x"), text.mentioned_paths(F.col("t")).alias("p"), text.intent_confidence(text.intent(F.col("t"))).alias("c"), text.preprocess(F.col("t")).alias("plain")).first()
        if not row.plain:
            raise ToolError("INVALID_PARAMETER_VALUE", "empty query")
        if row.i == "preCommitCheck":
            files = self.symbols.sparkSession.createDataFrame([(p,) for p in row.p], "file_path string")
            return row.i, row.c, pre_commit_report(self.symbols, self.calls, files, self.members, self.steps)
        if row.i == "smartSearch":
            return row.i, row.c, self.call("smart_search", query=row.t) if self.embed is not None else augment(self.symbols, self.calls, row.t.replace(" ", "_"))
        tool, key = {"dataFlowTrace": ("trace_data_flow", "entry_point"), "impactAnalysis": ("impact_analysis", "target"), "contextRetrieval": ("get_symbol_context", "symbol")}[row.i]
        return row.i, row.c, self.call(tool, **{key: row.x})


def envelope(rows: DataFrame, summary: str, limit: int = 50) -> DataFrame:
    """(summary, shown, truncated, rows): one JSON-ready row with at most ``limit`` rows as texts."""
    few = rows.limit(limit + 1).select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("j")).agg(F.collect_list("j").alias("all"))
    return few.select(F.lit(summary).alias("summary"), F.least(F.size("all"), F.lit(limit)).alias("shown"), (F.size("all") > limit).alias("truncated"), F.slice("all", 1, limit).alias("rows"))

"""Graph operators on small graphs with known answers."""

import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from codeloom import schema
from codeloom.operators import cluster, flows, mro, relate, search, store, traverse
from codeloom.plans import fixtures as fx
from codeloom.plans import queries, tools
from codeloom.plans.tools import Engine, ToolError, check_call


def edges(spark, pairs, rel="calls"):
    return spark.createDataFrame([(a, b, rel) for a, b in pairs] or [], "src string, dst string, rel_type string")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def walks(pairs, start, depth):
    found, front = {}, {start}
    for d in range(1, depth + 1):
        front = {b for a, b in pairs if a in front} - set(found)
        found |= dict.fromkeys(front, d)
    return found


def test_reach_with_cycles_seeds_and_depths(spark):
    rng = random.Random(2)
    pairs = list({(f"n{rng.randrange(20)}", f"n{rng.randrange(20)}") for _ in range(45)})
    e = edges(spark, pairs)
    for depth in (1, 3, 20):
        for direction, p in (("down", pairs), ("up", [(b, a) for a, b in pairs])):
            got = {(r.seed, r.id): r.depth for r in traverse.reach(e, ids(spark, "n0", "n5", "zz"), depth, direction).collect()}
            assert got == {(s, k): v for s in ("n0", "n5") for k, v in walks(p, s, depth).items()}
    assert traverse.reach(edges(spark, [("a", "b"), ("b", "a")]), ids(spark, "a")).count() == 2
    assert [traverse.clamp_depth(x) for x in (None, float("nan"), 0, 2.9, 99)] == [20, 20, 20, 2, 20]


def test_shortest_paths(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("a", "x"), ("x", "c"), ("c", "d"), ("d", "a")])
    path = lambda a, b, d=None: [r.id for r in sorted(traverse.shortest_path(e, a, b, d).collect(), key=lambda r: r.hop)]
    assert path("a", "d") == ["a", "b", "c", "d"] and path("a", "a") == ["a"] and path("a", "nope") == [] and path("a", "d", 2) == []


def test_flow_traces_match_depth_first_search(spark):
    rng = random.Random(5)
    pairs = sorted({(f"f{rng.randrange(12)}", f"f{rng.randrange(12)}") for _ in range(22)})
    calls = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "src string, dst string, seq long")
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
    got = {r.entry: (r.path, r.cyclic) for r in flows.flow_traces(ids(spark, *near), calls).collect()}
    want = {k: flows.longest_chain(near, k) for k in near}
    assert got == {k: v for k, v in want.items() if len(v[0]) > 1}


def test_token_slice_passes_over_what_does_not_fit(spark):
    rows = [("s", "pin", 0, 50, True), ("s", "a", 1, 30, False), ("s", "b", 1, 60, False), ("s", "c", 2, 20, False), ("s", "d", 9, 1, False)]
    df = spark.createDataFrame(rows, "seed string, id string, depth int, tokens long, pinned boolean")
    take = lambda limit, depth: ({r.id for r in flows.token_slice(df, limit, depth).collect() if r.taken}, flows.token_slice(df, limit, depth).first().reason)
    assert take(100, 5) == ({"pin", "a", "c"}, "token_budget")
    assert take(0, 20) == ({"pin", "a", "b", "c", "d"}, "complete")
    assert take(0, 5) == ({"pin", "a", "b", "c"}, "max_depth")
    assert take(10, 20) == ({"pin"}, "token_budget")


def test_louvain_splits_two_triangles(spark):
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c"), ("d", "e"), ("d", "f"), ("e", "f"), ("c", "d")], "a string, b string")
    order = spark.createDataFrame([(c, i) for i, c in enumerate("abcdef")], "id string, seq long")
    rows = cluster.louvain(pairs, order).collect()
    groups = {}
    for r in rows:
        assert 0 <= r.modularity <= 1
        groups.setdefault(r.community, set()).add(r.id)
    assert sorted(map(sorted, groups.values())) == [list("abc"), list("def")]
    assert cluster.louvain(pairs.limit(0), order).count() == 0
    parts = {r.id: r.component for r in cluster.connected(pairs.where("a <> 'c'")).collect()}
    assert parts == dict.fromkeys("abc", "a") | dict.fromkeys("def", "d")


def test_labels_and_categories(spark):
    m = spark.createDataFrame([("k", "1", 1), ("k", "2", 2), ("k", "3", 3), ("q", "4", 4), ("q", "5", 5), ("z", "6", 6), ("z", "7", 7), ("z", "8", 8)], "cluster_id string, id string, seq long")
    s = spark.createDataFrame([("1", "loginUser", "app/auth/a.ts"), ("2", "x", "app/auth/b.ts"), ("3", "y", "app/web/c.ts"), ("4", "a", "src/d.ts"), ("5", "b", "lib/e.ts"), ("6", "parseA", "f.ts"), ("7", "parseB", "g.ts"), ("8", "parseC", "h.ts")], "id string, name string, file_path string").withColumn("signature", F.lit(None).cast("string"))
    assert {r.cluster_id: r.label for r in cluster.labels(m, s).collect()} == {"k": "Auth", "q": "Cluster_1", "z": "Parse"}
    assert {r.cluster_id: r.category for r in cluster.categories(m, s).collect()} == {"k": "authentication", "q": "unknown", "z": "utility"}


def test_c3_orders():
    h = {"D": ["B", "C"], "B": ["A"], "C": ["A"]}
    assert mro.c3(h, "D") == ["B", "C", "A"] and mro.breadth_first(h, "D") == ["B", "C", "A"]
    assert mro.c3({"X": ["Y"], "Y": ["X"]}, "X") is None
    assert mro.c3({"Z": ["P", "Q"], "P": ["R", "S"], "Q": ["S", "R"]}, "Z") is None
    assert mro.receiver_type("a.b().c()", {"a": "A"}, {("A", "b"): "B", ("B", "c"): "C"}) == "C"
    assert mro.receiver_type("a.nope()", {"a": "A"}, {}) is None


def test_store_delta_equals_rebuild_and_caches(spark):
    old = spark.createDataFrame([("1", "a.ts", 1), ("2", "b.ts", 2), ("3", "c.ts", 3)], "id string, file_path string, seq long")
    new = spark.createDataFrame([("1", "a.ts", 1), ("9", "b.ts", 2), ("4", "d.ts", 4)], "id string, file_path string, seq long")
    cached = spark.createDataFrame([("a.ts", "h", 1, 1), ("b.ts", "h", 1, 1), ("c.ts", "h", 1, 1), ("e.ts", None, 1, 1), ("f.ts", "h", 7, 0)], "path string, content_hash string, mtime_ms long, parse_version int")
    found = spark.createDataFrame([("a.ts", "h", 2), ("b.ts", "g", 2), ("d.ts", "h", 1), ("e.ts", None, 2), ("f.ts", "h", 7)], "path string, content_hash string, mtime_ms long")
    status = store.classify_files(cached, found, 1)
    assert {r.path: r.status for r in status.collect()} == {"a.ts": "unchanged", "b.ts": "changed", "c.ts": "removed", "d.ts": "added", "e.ts": "changed", "f.ts": "changed"}
    e = edges(spark, [("1", "9"), ("1", "2")])
    s, kept = store.apply_delta(old, e, status, new, e)
    assert store.difference(s, new).count() == 0 and [(r.src, r.dst) for r in kept.collect()] == [("1", "9")]
    order = spark.createDataFrame([("a.ts", 0), ("b.ts", 1), ("d.ts", 2)], "path string, seq long")
    assert store.difference(store.merge_parsed(new, old, status, order).select(*new.columns), new).count() == 0
    cache = spark.createDataFrame([("x", 2, [1.0, 2.0], 1), ("y", 2, [0.0, 1.0], 2)], "hash string, dims int, vector array<double>, at long")
    put = store.cache_put(cache, spark.createDataFrame([("x", 2, [5.0, 5.0], 3), ("z", 2, [1.0, 1.0], 4)], cache.schema), 2)
    assert {r.hash for r in put.collect()} == {"x", "z"}
    hit = store.cache_split(spark.createDataFrame([("x", 2), ("x", 3), ("q", 2)], "hash string, dims int"), cache)
    assert sorted((r.hash, r.dims, r.vector is not None) for r in hit.collect()) == [("q", 2, False), ("x", 2, True), ("x", 3, False)]


def test_snapshots_are_pruned_by_relation(spark, tmp_path):
    from codeloom.sources.files import pages, read_snapshot

    e = edges(spark, [("a", "b")]).union(edges(spark, [("a", "c")], "imports"))
    store.write_snapshot(str(tmp_path), edges=e)
    assert [r.dst for r in read_snapshot(spark, str(tmp_path), "edges", "imports").collect()] == ["c"]
    got = [[r.src + r.dst for r in page] for page in pages(edges(spark, [("a", "b"), ("a", "c"), ("b", "a")]), ["src", "dst"], 2)]
    assert got == [["ab", "ac"], ["ba"]]


def test_schema_checks(spark):
    s = schema.conform(spark.createDataFrame([("x", 5, 1), ("x", 1, 2)], "id string, start_line int, end_line int"), schema.SYMBOLS)
    m = spark.createDataFrame([("k", "x")], "cluster_id string, symbol_id string")
    p = spark.createDataFrame([("p", 0, "x"), ("p", 2, "x")], "process_id string, step_order int, symbol_id string")
    assert {r.rule: r.n for r in schema.violations(s, m, p).collect()} == {"unique_id": 1, "line_order": 1, "cluster_size": 1, "step_gaps": 1}


def test_tool_calls(spark):
    for tool, args, code in (("nope", {}, "UNKNOWN_TOOL"), ("trace", {"from": "a"}, "MISSING_PARAMETER"), ("find_hotspots", {"limit": "x"}, "INVALID_PARAMETER_TYPE"), ("find_hotspots", {"limit": 0}, "INVALID_PARAMETER_VALUE"), ("verify_claim", {"kind": "magic"}, "INVALID_PARAMETER_VALUE")):
        with pytest.raises(ToolError) as e:
            check_call(tool, args)
        assert e.value.code == code
    s = spark.createDataFrame([("a", "saveOrder", "function", "src/routes/o.ts", 1, 9, 12, 3, 1, "private", 0, "(saveOrder): x"), ("b", "orderModel", "class", "src/o_model.py", 1, 9, 2, 3, 1, "public", 1, None), ("c", "authGate", "function", "src/lib/g.py", 1, 9, 20, 3, 1, "private", 2, None)], "id string, name string, kind string, file_path string, start_line int, end_line int, cyclomatic int, cognitive int, max_loop_depth int, visibility string, seq long, signature string")
    e = edges(spark, [("a", "b"), ("c", "a")])
    m = spark.createDataFrame([("k", "a", 0), ("k", "b", 1)], "cluster_id string, id string, seq long")
    engine = Engine(s, e, m)
    assert [r.id for r in engine.call("find_hotspots").collect()] == ["c", "a"]
    assert {(r.section, r.id) for r in engine.call("get_symbol_context", symbol="saveOrder").collect()} == {("target", "a"), ("caller", "c"), ("callee", "b"), ("cluster_member", "b")}
    assert [r.risk for r in engine.call("impact_analysis", target="b").collect()] == ["critical", "critical"]
    assert [r.id for r in engine.call("trace", **{"from": "authGate", "to": "orderModel"}).collect()] == ["c", "a", "b"]
    assert [r.verdict for r in engine.call("verify_claim", kind="usage", symbol="authGate").collect()] == ["absent"]
    assert engine.call("verify_claim", kind="reachability", **{"from": "c", "to": "b"}).first().hops == 2
    assert [r.id for r in engine.call("find_dead_code").collect()] == ["c"]
    assert {(r.id, r.reason) for r in engine.call("rename", symbol="saveOrder", new_name="x").collect()} == {("a", "definition"), ("c", "calls")}
    assert engine.call("augment", pattern="saveOrder").count() == 2
    intent, confidence, answer = engine.ask('what is the impact of "orderModel"')
    assert (intent, confidence, answer.count()) == ("impactAnalysis", 0.88, 2)
    assert engine.ask("blast radius of src/o_model.py")[2].first().affected == 2
    assert engine.ask("find orders")[0] == "smartSearch"
    with pytest.raises(ToolError):
        engine.ask("  !!! ")
    one = tools.envelope(s.select("id"), "three", 2).first()
    assert (one.shown, one.truncated, len(one.rows)) == (2, True, 2)
    assert "Run the full" in tools.recommendations("high", 12, 1, 2)[0] and tools.data_flow_confidence({"api", "controller", "model"}) == 0.92


def test_levenshtein_is_a_metric(spark):
    words = ["", "a", "ab", "abc", "bca", "xyz"]
    d = {(r.a, r.b): r.d for r in spark.createDataFrame(list(itertools.product(words, words)), "a string, b string").withColumn("d", F.levenshtein("a", "b")).collect()}
    for a, b, c in itertools.product(words, repeat=3):
        assert d[a, b] == d[b, a] and (d[a, b] == 0) == (a == b) and d[a, c] <= d[a, b] + d[b, c]


def test_embedding_helpers(spark):
    df = spark.createDataFrame([("1", "save order"), ("2", "import x from 'y'"), ("3", ""), ("4", "see /etc/ now")], "symbol_id string, t string")
    assert [r.symbol_id for r in search.safe_embedding_text(df, "t").collect()] == ["1"]
    v = df.select(search.hash_embedding(F.split("t", " "), 16).alias("v")).first().v
    assert len(v) == 16 and sum(x * x for x in v) == pytest.approx(1)


def test_named_bindings_come_before_imports(spark):
    s = spark.createDataFrame([("1", "go", "a/x.ts", 1), ("2", "go", "b/y.ts", 2), ("3", "go", "a/z.ts", 3)], "id string, name string, file_path string, seq long")
    refs = spark.createDataFrame([(1, "c/c.ts", "go"), (2, "a/x.ts", "go"), (3, "b/q.ts", "go"), (4, "c/d.ts", "none")], "ref_id int, file_path string, name string")
    imports = spark.createDataFrame([("c/c.ts", "b/y.ts")], "file_path string, imported_file string")
    bindings = spark.createDataFrame([("c/c.ts", "go", "3")], "file_path string, name string, id string")
    got = {r.ref_id: (r.id, r.tier) for r in relate.resolve_names(refs, s, imports, bindings).collect()}
    assert got == {1: ("3", "named"), 2: ("1", "same-file"), 3: ("2", "package"), 4: (None, None)}


def test_time_limits_and_phases(spark):
    from codeloom.plans.runtime import Phases, within

    assert within(spark, 60, lambda: spark.range(5).count()) == 5
    with pytest.raises(ZeroDivisionError):
        within(spark, 60, lambda: 1 // 0)
    slow = spark.range(4, numPartitions=4).mapInPandas(lambda it: (__import__("time").sleep(20) or x for x in it), "id long")
    with pytest.raises(TimeoutError):
        within(spark, 1, slow.count)
    with pytest.raises(ValueError):
        within(spark, 1, lambda: 1, "nope")
    p = Phases()
    with p.phase("parse") as note:
        note["rows"] = 3
    assert p.total_rows() == 3 and p.table(spark).first().phase == "parse"


def test_traversal_inside_tasks_and_level_by_level_agree(spark):
    import random

    rng = random.Random(3)
    rows = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}", "calls") for _ in range(90)] + [("a", "b", "calls"), ("b", "a", "calls"), ("a", None, "calls")]
    edges = spark.createDataFrame(rows, "src string, dst string, rel_type string")
    seeds = spark.createDataFrame([("n1",), ("n2",), ("a",), ("nowhere",), ("n1",)], "id string")
    ways = {}
    for r in rows:
        if r[1] is not None:
            ways.setdefault(r[0], set()).add(r[1])
    one = {}
    for seed in ("n1", "n2", "a", "nowhere"):
        level, seen = {seed}, set()
        for k in range(1, 7):
            level = {y for x in level for y in ways.get(x, ())} - seen
            seen |= level
            one |= {(seed, y): k for y in level}
    any_of = {}
    for (_, y), k in one.items():
        if y not in ("n1", "n2", "a", "nowhere"):
            any_of[y] = min(k, any_of.get(y, 99))
    for bound in (0, 1000):
        assert {(r.seed, r.id): r.depth for r in traverse.reach(edges, seeds, 6, "down", task_edges=bound).collect()} == one
        assert {r.id: r.depth for r in traverse.reach_any(edges, seeds, 6, "down", task_edges=bound).collect()} == any_of
        assert traverse.reach(edges.limit(0), seeds, task_edges=bound).count() == 0 == traverse.reach_any(edges, seeds.limit(0), task_edges=bound).count()


def test_c3_of_many_diamonds_and_deep_chains():
    parents = {}
    for i in range(60):
        parents |= {f"t{i + 1}": [f"l{i}", f"r{i}"], f"l{i}": [f"t{i}"], f"r{i}": [f"t{i}"]}
    assert len(mro.c3(parents, "t60")) == 180
    deep = {f"c{i + 1}": [f"c{i}"] for i in range(5000)}
    assert mro.c3(deep, "c5000")[-1] == "c0"
    cycle = {"x": ["y"], "y": ["z"], "z": ["x"], "w": ["x"], "v": ["o"]}
    assert mro.c3(cycle, "x") is None and mro.c3(cycle, "w") is None and mro.c3(cycle, "v") == ["o"]


def test_tools_say_what_is_missing(spark):
    s = spark.createDataFrame([], schema.SYMBOLS) if hasattr(schema, "SYMBOLS") else None
    engine = Engine(s, edges(spark, []), spark.createDataFrame([], "cluster_id string, id string"))
    for tool, arguments, code in (
        ("verify_claim", {"kind": "usage"}, "MISSING_PARAMETER"),
        ("verify_claim", {"kind": "edge", "from": "a"}, "MISSING_PARAMETER"),
        ("shape_check", {}, "INVALID_PARAMETER_VALUE"),
        ("detect_changes", {}, "INVALID_PARAMETER_VALUE"),
    ):
        with pytest.raises(ToolError) as e:
            engine.call(tool, **arguments)
        assert e.value.code == code


def test_c3_is_python_s_own_order():
    rng = random.Random(1)

    def python_order(parents, name):
        made = {}

        def make(x):
            if x not in made:
                made[x] = type(x, tuple(make(p) for p in parents.get(x, [])) or (object,), {})
            return made[x]

        try:
            return [k.__name__ for k in make(name).__mro__[1:-1]]
        except TypeError:
            return None

    for _ in range(1000):
        parents = {f"k{i}": [f"k{j}" for j in rng.sample(range(i), min(i, rng.randrange(4)))] for i in range(8)}
        assert mro.c3(parents, "k7") == python_order(parents, "k7")


def joined(df):
    """The most rows that a join of the plan gave, after all rows were fetched: (rows, joined)."""
    rows = df.collect()

    def most(node):
        kind, inner = node.getClass().getSimpleName(), []
        if kind == "AdaptiveSparkPlanExec":
            inner = [node.executedPlan()]
        elif kind.endswith("QueryStageExec"):
            inner = [node.plan()]
        elif kind == "ReusedExchangeExec":
            inner = [node.child()]
        else:
            inner = [node.children().apply(i) for i in range(node.children().size())]
        own = node.metrics().get("numOutputRows").get().value() if "Join" in kind else 0
        return max([own, *map(most, inner)])

    return rows, most(df._jdf.queryExecution().executedPlan())


def sent_whole(monkeypatch, module):
    """Plans with a broadcast, of all tables that a module cuts from here on."""
    found = []
    for name in ("cut", "cut_and_count"):
        if hasattr(module, name):
            own = getattr(module, name)
            monkeypatch.setattr(module, name, lambda df, *a, own=own: (found.append(plan(df)), own(df, *a))[1])
    return lambda: [x for x in found if "BroadcastExchange" in x]


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_components_are_not_sent_through_the_driver(spark, monkeypatch):
    """F4"""
    sent = sent_whole(monkeypatch, cluster)
    s = spark.range(300).selectExpr("concat('p', id) as id", "'class' as kind")
    pairs = cluster.cluster_graph(s, edges(spark, [(f"p{i}", f"p{i + 7}") for i in range(290)]), 10)
    assert "BroadcastExchange" not in plan(pairs)
    assert len({r.component for r in cluster.connected(pairs).collect()}) == 7 and sent() == []


def test_flows_are_not_sent_through_the_driver(spark, monkeypatch):
    """F5, F6"""
    sent = [sent_whole(monkeypatch, m) for m in (flows, traverse)]
    s = spark.range(40).selectExpr("concat('p', id) as id", "concat('run', id) as name", "'function' as kind", "'public' as visibility", "id as seq")
    calls = edges(spark, [(f"p{i}", f"p{i + 1}") for i in range(30)] + [("p0", "p9"), ("p3", "p0")]).withColumn("seq", F.lit(1))
    entries = flows.entry_points(s, calls)
    assert "BroadcastExchange" not in plan(entries)
    near = traverse.reach(calls, entries, 20, task_edges=0)
    assert near.where("seed = 'p0' and id = 'p28'").count() == 1
    traces = flows.distinct_traces(flows.flow_traces(entries, calls), entries)
    assert "BroadcastExchange" not in plan(traces) and all("BroadcastExchange" not in plan(x) for x in flows.processes(traces, s))
    assert [f() for f in sent] == [[], []]


@pytest.mark.parametrize("mode", ["first", "enclosing"])
def test_symbols_around_lines(spark, mode):
    """against all pairs; and joins give no row for each symbol over a line."""
    rng = random.Random(7)
    s = [(f"s{i}", rng.choice("ab"), a := rng.randint(-5, 700), a + rng.choice([-1, 0, 1, 7, 90, 600]), rng.randint(0, 400)) for i in range(300)]
    s += [("big", "a", 0, 2**31 - 1, 1000), (None, "b", 3, None, 1)]
    p = [(i, rng.choice("abc"), rng.randint(-10, 900)) for i in range(500)] + [(1000, "a", 2**31 - 1), (1001, "a", None), (1002, None, 4)]
    df = relate.covering(spark.createDataFrame([*p, p[0]], "point_id long, file_path string, line int"), spark.createDataFrame(s, "id string, file_path string, start_line int, end_line int, seq long"), mode)
    got, rank = {r.point_id: r for r in df.collect()}, {x[0]: ((x[3] - x[2]) if mode == "enclosing" else 0, x[4]) for x in s if x[3] is not None}
    for i, f, line in p:
        over = [x[0] for x in s if line is not None and x[3] is not None and x[1] == f and x[2] <= line <= x[3]]
        assert (i in got) == bool(over) and (not over or (got[i].id in over and rank[got[i].id] == min(rank[x] for x in over)))
    many = spark.range(2000).selectExpr("concat('s', id) as id", "'a' as file_path", "cast(id % 5 as int) as start_line", "cast(300 + id % 7 as int) as end_line", "id as seq")
    rows, most = joined(relate.covering(spark.range(1000).selectExpr("id as point_id", "'a' as file_path", "cast(10 + id % 50 as int) as line"), many, mode))
    assert len(rows) == 1000 and most <= 3000


def test_points_are_made_once_and_shuffled_once(spark, monkeypatch):
    """lines with their symbols go to the points; where they are many, both go by sorted keys."""
    plans, own = [], relate.cut
    monkeypatch.setattr(relate, "cut", lambda df: (plans.append(plan(df)), own(df))[1])
    sf = "/root/testdata/sf0.001"
    df = queries.enclosing_of_line(spark, sf)
    assert len(plans) == 1 and plans[0].count("Exchange hashpartitioning") == 1
    last = plan(df)
    assert "lineitem" not in last and "hashpartitioning" not in last
    many = relate.covering(queries._points(spark, sf), fx.symbols(spark, sf), "enclosing", few=0)
    assert "BroadcastExchange" not in plan(many) and sorted(map(tuple, many.collect())) == sorted(map(tuple, df.collect()))


def test_points_of_two_lines_and_unknown_keys(spark, tmp_path):
    """line numbers beyond 9 share ids with other orders, keys may be null; against DuckDB."""
    rows = [(1, 12, 3, 9.0), (2, 2, 3, 9.0), (2, 2, 4, 8.0), (2, 2, 5, None), (None, 1, 3, 9.0), (None, 1, 4, 7.0), (1, None, 3, 9.0), (2, None, 3, 9.0), (3, 1, None, 9.0), (0, 11, 6, 4.0), (1, 1, 6, 7.0), (1, 2, 999, 7.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = [(k, "large ring", f"Brand#{k % 2}", "LARGE", k // 2, 1.0) for k in range(40)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("caller_of_line", "enclosing_of_line"):
        got = [tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).select("point_id", "file_path", "line", "id").collect()]
        c = duckdb.connect()
        for t in ("lineitem", "part"):
            c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
        assert sorted(map(str, got)) == sorted(map(str, c.execute(queries.ORACLE_SQL[name]).fetchall())) and got


def test_heritage_of_common_names(spark):
    """against all pairs; and joins give no row for each symbol of a name."""
    rng = random.Random(3)
    s = [(f"s{i}", rng.choice("xyz"), rng.choice("ab"), q) for i, q in enumerate(rng.sample(range(100), 30))] + [("s0", "y", "a", 200), ("lone", "w", "a", 300)]
    pairs = [(i, rng.choice("abc"), rng.choice("xyzwv"), rng.choice("xyzwv")) for i in range(200)]
    want = {}
    for i, f, c, p in pairs:
        child = min(((x[2] != f, x[3], x[0]) for x in s if x[1] == c), default=None)
        parent = child and min(((x[3], x[0]) for x in s if x[1] == p and x[0] != child[2]), default=None)
        if parent:
            want[i] = (child[2], parent[1])
    symbols = spark.createDataFrame(s, "id string, name string, file_path string, seq long")
    assert {r.ref_id: (r.child_id, r.parent_id) for r in relate.heritage(spark.createDataFrame(pairs, "ref_id int, file_path string, child string, parent string"), symbols).collect()} == want
    many = spark.range(2000).selectExpr("concat('s', id) as id", "concat('n', id % 2) as name", "concat('f', id % 3) as file_path", "id as seq")
    rows, most = joined(relate.heritage(spark.range(1000).selectExpr("id as ref_id", "'f0' as file_path", "'n0' as child", "concat('n', id % 2) as parent"), many))
    assert len(rows) == 1000 and most <= 3000


def test_louvain_is_not_sent_through_the_driver(spark, monkeypatch):
    """F8"""
    sent = sent_whole(monkeypatch, cluster)
    pairs = spark.createDataFrame([(f"p{i}", f"p{i + 1}") for i in range(10, 40)], "a string, b string")
    found = cluster.louvain(pairs, spark.range(50).selectExpr("concat('p', id) as id", "id as seq"))
    assert found.count() and "BroadcastExchange" not in plan(found) and sent() == []


def test_names_are_resolved_once_a_file(spark):
    """joins give no row for each reference and import or file of its folder."""
    s = spark.range(400).selectExpr("concat('s', id) as id", "concat('n', id % 2) as name", "concat('d/f', id) as file_path", "id as seq")
    imports = spark.range(200).selectExpr("'x/y' as file_path", "concat('d/f', id) as imported_file")
    refs = spark.range(2000).selectExpr("id as ref_id", "if(id % 2 = 0, 'x/y', 'd/f1') as file_path", "concat('n', id % 4) as name")
    rows, most = joined(relate.resolve_names(refs, s, imports))
    got = {r.ref_id: (r.id, r.tier) for r in rows}
    assert len(rows) == 2000 and most <= 2000 and got[0] == ("s0", "import-scoped") and got[1] == ("s1", "same-file") and got[2] == (None, None) and got[3] == (None, None)
    two = relate.resolve_names(refs.where("ref_id < 2").withColumn("name", F.lit("n0")), s, imports)
    assert {r.ref_id: (r.id, r.tier) for r in two.collect()} == {0: ("s0", "import-scoped"), 1: ("s0", "package")}
    twice = spark.createDataFrame([(1, "d/f1", "n0"), (1, "d/f1", "n1"), (None, "d/f1", "n1")], "ref_id int, file_path string, name string")
    assert sorted((r.ref_id or 0, r.id or "") for r in relate.resolve_names(twice, s, imports).collect()) == [(0, ""), (1, "s1"), (1, "s1")]


def test_hierarchies_are_not_sent_through_the_driver(spark, monkeypatch):
    """F10, F11, F13"""
    sent = sent_whole(monkeypatch, cluster)
    own = spark.range(1, 40).selectExpr("concat('c', id) as id", "id as seq")
    order = mro.linearise(own.where("seq > 1").selectExpr("id as child", "concat('c', seq div 2) as parent", "0 as seq"))
    methods = own.selectExpr("concat(id, '.m') as id", "id as owner", "'m' as name", "0 as params", "false as abstract", "'class' as owner_kind")
    calls = own.selectExpr("seq as call_id", "id as receiver_class", "'m' as name")
    plans = [plan(x) for x in (order, mro.overrides(order, methods), mro.member_calls(calls, order, methods))]
    assert not any("BroadcastExchange" in p for p in plans) and sent() == []


def test_batches_of_long_keys(spark):
    """against a plain fold, with sizes unknown; and 60,000 rows of one key in little time."""
    rng = random.Random(5)
    rows = [(rng.choice("ab"), i, rng.choice([1, 5, 9, 30, None])) for i in range(200)]
    want = {}
    for key in "ab":
        b = n = used = 0
        for _, i, s in sorted((x for x in rows if x[0] == key), key=lambda x: x[1]):
            if n and (n >= 4 or (used is not None and s is not None and used + s > 20)):
                b, n, used = b + 1, 0, 0
            used, n = None if used is None or s is None else used + s, n + 1
            want[key, i] = b
    df = spark.createDataFrame(rows, "k string, i int, s int")
    assert {(r.k, r.i): r.batch for r in store.budget_batches(df, F.col("s"), 20, 4, ["k"], "i").collect()} == want
    many = spark.range(60_000).selectExpr("'a' as k", "id as i", "1 as s")
    lists = plan(store.budget_batches(many, F.col("s"), 20, 4, ["k"], "i"))
    assert "collect_list" not in lists and store.budget_batches(many, F.col("s"), 20, 4, ["k"], "i").agg(F.max("batch").alias("m")).first().m == 14_999

"""The driver's queries over the graph operators, each with its DuckDB equivalent where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions import fixed, graph, packages, text
from codeloom.operators import cluster, flows, mro, relate, search, store, traverse
from codeloom.plans import fixtures as fx
from codeloom.session import by_key, cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
T = fx.table


def query(name: str, *sql: str):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = fx.sql(*sql) if len(sql) > 1 else sql[0]
        return f

    return keep


def _busiest(spark: SparkSession, sf_dir: str, n: int, dense: bool = False) -> DataFrame:
    c = fx.calls(spark, sf_dir, dense)
    return c.groupBy(F.col("src").alias("id")).count().orderBy(F.desc("count"), "id").limit(n).select("id")


def _busiest_sql(n: int, calls: str = "calls") -> str:
    return f"seeds AS (SELECT src AS id FROM {calls} GROUP BY src ORDER BY count(*) DESC, src LIMIT {n})"


@query("hotspots", fx.SYMBOLS_SQL, "SELECT id, name, cyclomatic, cognitive, max_loop_depth FROM symbols WHERE cyclomatic > 10 ORDER BY cyclomatic DESC, id LIMIT 50 OFFSET 5")
def hotspots(spark, sf_dir):
    from codeloom.plans.tools import find_hotspots

    return find_hotspots(fx.symbols(spark, sf_dir), 10, 50, 5)


_ENTRY = " OR ".join(f"regexp_matches(name, '{p}')" for p in fixed.ENTRY_POINT_NAMES)
_UTILITY = " OR ".join(f"regexp_matches(name, '{p}')" for p in fixed.UTILITY_NAMES)


@query("dead_code", fx.SYMBOLS_SQL, fx.CALLS_SQL, f"SELECT id, name, kind, file_path FROM symbols s WHERE NOT EXISTS (SELECT 1 FROM calls WHERE dst = s.id) AND visibility <> 'public' AND kind <> 'export' AND NOT ({_ENTRY})")
def dead_code(spark, sf_dir):
    from codeloom.plans.tools import find_dead_code

    return find_dead_code(fx.symbols(spark, sf_dir), fx.calls(spark, sf_dir)).select("id", "name", "kind", "file_path")


@query("callers", fx.SYMBOLS_SQL, fx.CALLS_SQL, "SELECT DISTINCT c.dst AS target, s.id, s.name, s.file_path FROM calls c JOIN symbols s ON s.id = c.src")
def callers(spark, sf_dir):
    s = fx.symbols(spark, sf_dir)
    return relate.neighbours(fx.calls(spark, sf_dir), s, s, "up").select(F.col("of").alias("target"), "id", "name", "file_path")


@query("callees", fx.SYMBOLS_SQL, fx.CALLS_SQL, "SELECT DISTINCT c.src AS target, s.id, s.name, s.file_path FROM calls c JOIN symbols s ON s.id = c.dst")
def callees(spark, sf_dir):
    s = fx.symbols(spark, sf_dir)
    return relate.neighbours(fx.calls(spark, sf_dir), s, s, "down").select(F.col("of").alias("target"), "id", "name", "file_path")


_ROLE = "CASE WHEN i = 0 AND o = 0 THEN 'Isolated' WHEN i = 0 THEN 'EntryPoint' WHEN o = 0 THEN 'Utility' WHEN (i <= 2 AND o > 5) OR (o <= 2 AND i > 5) THEN 'Adapter' ELSE 'CoreLogic' END"
_DEGREES = "deg AS (SELECT s.id, coalesce(i.n, 0) AS i, coalesce(o.n, 0) AS o FROM symbols s LEFT JOIN (SELECT dst, count(*) n FROM {e} GROUP BY 1) i ON i.dst = s.id LEFT JOIN (SELECT src, count(*) n FROM {e} GROUP BY 1) o ON o.src = s.id)"


@query("degrees_roles", fx.SYMBOLS_SQL, fx.DENSE_SQL, _DEGREES.format(e="dense"), f"SELECT id, i AS in_degree, o AS out_degree, {_ROLE} AS role FROM deg")
def degrees_roles(spark, sf_dir):
    return relate.degrees(fx.symbols(spark, sf_dir), fx.calls(spark, sf_dir, dense=True))


@query("role_histogram", fx.SYMBOLS_SQL, fx.DENSE_SQL, _DEGREES.format(e="dense"), f"SELECT {_ROLE} AS role, count(*) AS n FROM deg GROUP BY 1")
def role_histogram(spark, sf_dir):
    return degrees_roles(spark, sf_dir).groupBy("role").agg(F.count("*").alias("n"))


@query("direct_caller_edge_types", fx.EDGES_SQL, "SELECT dst AS id, rel_type, count(DISTINCT src) AS n FROM edges GROUP BY 1, 2")
def direct_caller_edge_types(spark, sf_dir):
    return fx.edges(spark, sf_dir).groupBy(F.col("dst").alias("id"), "rel_type").agg(F.count_distinct("src").alias("n"))


@query("resolve_exact", fx.SYMBOLS_SQL, "SELECT id, name, true AS exact FROM symbols WHERE id = 'redWidget' OR name = 'redWidget' ORDER BY id LIMIT 1")
def resolve_exact(spark, sf_dir):
    return search.resolve(fx.symbols(spark, sf_dir), "redWidget").select("id", "name", "exact")


@query("resolve_fuzzy", fx.SYMBOLS_SQL, "SELECT id, name, false AS exact FROM symbols WHERE contains(name, 'Widget') ORDER BY length(name), id LIMIT 1")
def resolve_fuzzy(spark, sf_dir):
    return search.resolve(fx.symbols(spark, sf_dir), "Widget").select("id", "name", "exact")


@query("did_you_mean", fx.SYMBOLS_SQL, "SELECT name, CAST(levenshtein(name, 'redWigdet') AS INT) AS distance FROM (SELECT DISTINCT name FROM symbols) ORDER BY 2, 1 LIMIT 5")
def did_you_mean(spark, sf_dir):
    return search.did_you_mean(fx.symbols(spark, sf_dir), "redWigdet")


def _reach_sql(edges: str, depth: int, up: bool) -> str:
    a, b = ("dst", "src") if up else ("src", "dst")
    return f"walk AS (SELECT s.id AS seed, e.{b} AS id, 1 AS depth FROM seeds s JOIN {edges} e ON e.{a} = s.id UNION SELECT w.seed, e.{b}, w.depth + 1 FROM walk w JOIN {edges} e ON e.{a} = w.id WHERE w.depth < {depth}), reach AS (SELECT seed, id, min(depth) AS depth FROM walk GROUP BY 1, 2)"


@query("impact_transitive", fx.SYMBOLS_SQL, fx.CALLS_SQL, "seeds AS (SELECT id FROM symbols)", _reach_sql("calls", 10, True), "SELECT seed, id, CAST(depth AS INT) AS depth FROM reach")
def impact_transitive(spark, sf_dir):
    return traverse.reach(fx.calls(spark, sf_dir), fx.symbols(spark, sf_dir), 10, "up")


@query("impact_dense_depth20", fx.DENSE_SQL, _busiest_sql(3, "dense"), _reach_sql("dense", 20, False), "SELECT seed, id, CAST(depth AS INT) AS depth FROM reach")
def impact_dense_depth20(spark, sf_dir):
    return traverse.reach(fx.calls(spark, sf_dir, dense=True), _busiest(spark, sf_dir, 3, True), 20, "down")


_IMPACT = "impact AS (SELECT r.seed, r.id, s.name, r.depth, i, o, s.visibility = 'public' OR s.kind = 'export' AS exported FROM reach r JOIN symbols s ON s.id = r.id JOIN deg ON deg.id = r.id)"


@query(
    "impact_analysis", fx.SYMBOLS_SQL, fx.CALLS_SQL, "seeds AS (SELECT id FROM symbols)", _reach_sql("calls", 20, True), _DEGREES.format(e="calls"), _IMPACT,
    f"SELECT seed, id, CAST(depth AS INT) AS depth, {_ROLE} AS role, round(greatest(0, 0.95 - (depth - 1) * 0.12 - CASE WHEN {_ROLE} = 'Isolated' THEN CASE WHEN exported THEN 0.15 ELSE 0.35 END ELSE 0 END), 6)::DOUBLE AS confidence, "
    "CASE WHEN max(CASE WHEN regexp_matches(name, '(?i)auth|payment|checkout|security|session|token') THEN 1 ELSE 0 END) OVER (PARTITION BY seed) = 1 THEN 'critical' WHEN count(*) OVER (PARTITION BY seed) >= 11 THEN 'high' WHEN count(*) OVER (PARTITION BY seed) >= 3 THEN 'medium' ELSE 'low' END AS risk FROM impact",
)
def impact_analysis(spark, sf_dir):
    return impact_rows(spark, sf_dir)


def impact_rows(spark, sf_dir):
    """What a change of each symbol reaches."""
    from codeloom.plans.tools import impact

    s = fx.symbols(spark, sf_dir)
    return impact(s, fx.calls(spark, sf_dir), s).select("seed", "id", "depth", "role", F.round("confidence", 6).alias("confidence"), "risk")


@query("impact_external_dependency", "SELECT 'ext:' || s_suppkey AS id, s_name AS name FROM supplier WHERE contains(lower(s_name), 'supplier000000007') OR contains(lower(replace(s_name, '#', '')), 'supplier000000007') ORDER BY length(s_name), 1 LIMIT 1")
def impact_external_dependency(spark, sf_dir):
    return search.dependency_by_alias(fx.dependencies(spark, sf_dir), "supplier000000007").select("id", "name")


@query(
    "context_symbol", fx.SYMBOLS_SQL, fx.CALLS_SQL, _busiest_sql(1), "up AS (SELECT c.src AS id, 1 AS d FROM calls c JOIN seeds ON seeds.id = c.dst UNION SELECT c.src, d + 1 FROM up JOIN calls c ON c.dst = up.id WHERE d < 20)",
    "down AS (SELECT c.dst AS id, 1 AS d FROM calls c JOIN seeds ON seeds.id = c.src UNION SELECT c.dst, d + 1 FROM down JOIN calls c ON c.src = down.id WHERE d < 20)",
    "SELECT 'target' AS section, id, 0 AS depth FROM seeds UNION ALL SELECT 'caller', id, CAST(min(d) AS INT) FROM up GROUP BY id UNION ALL SELECT 'callee', id, CAST(min(d) AS INT) FROM down GROUP BY id UNION ALL SELECT 'cluster_member', s.id, 1 FROM symbols s WHERE brand = (SELECT brand FROM symbols JOIN seeds USING (id)) AND s.id NOT IN (SELECT id FROM seeds)",
)
def context_symbol(spark, sf_dir):
    from codeloom.plans.tools import symbol_context

    return symbol_context(fx.calls(spark, sf_dir), fx.members(spark, sf_dir), _busiest(spark, sf_dir, 1)).select("section", "id", "depth")


@query("trace_shortest_path_len", fx.DENSE_SQL, _busiest_sql(1, "dense"), _reach_sql("dense", 20, False), "SELECT seed, max_by(id, depth * 1000000 + CAST(substr(id, 2) AS INT)) AS target, CAST(max(depth) AS INT) AS hops FROM reach GROUP BY seed")
def trace_shortest_path_len(spark, sf_dir):
    calls = fx.calls(spark, sf_dir, dense=True)
    far = traverse.reach(calls, _busiest(spark, sf_dir, 1, True), 20).orderBy(F.desc("depth"), F.desc(F.substring("id", 2, 20).cast("int"))).first()
    if far is None:
        return spark.createDataFrame([], "seed string, target string, hops int")
    path = traverse.shortest_path(calls, far.seed, far.id)
    return path.agg(F.max("hop").alias("hops")).select(F.lit(far.seed).alias("seed"), F.lit(far.id).alias("target"), "hops")


@query("trace_shortest_path")
def trace_shortest_path(spark, sf_dir):
    calls = fx.calls(spark, sf_dir, dense=True)
    far = traverse.reach(calls, _busiest(spark, sf_dir, 1, True), 20).orderBy(F.desc("depth"), "id").first()
    return traverse.shortest_path(calls, far.seed, far.id) if far else spark.createDataFrame([], "hop int, id string")


_LAYER = "CASE " + " ".join(f"WHEN fw = '{k}' AND regexp_matches(t, '{p}') THEN '{layer}'" for k, ps in fixed.LAYER_PATTERNS.items() for layer, p in zip(fixed.LAYERS, ps, strict=True)) + " ELSE 'unknown' END"


@query("data_flow_layers", fx.SYMBOLS_SQL, f"SELECT id, coalesce(fw0, '') AS framework, {_LAYER} AS layer FROM (SELECT *, coalesce(fw0, 'generic') AS fw FROM (SELECT id, lower(name || ' ' || file_path || ' ' || signature) AS t, CASE WHEN contains(file_path, '/controllers/') THEN 'nestjs' WHEN contains(file_path, '/routes/') THEN 'express' END AS fw0 FROM symbols))")
def data_flow_layers(spark, sf_dir):
    s = fx.symbols(spark, sf_dir)
    return s.select("id", F.coalesce(graph.framework(F.col("file_path")), F.lit("")).alias("framework"), graph.layer(F.col("name"), F.col("file_path"), F.col("signature")).alias("layer"))


@query("trace_data_flow", fx.SYMBOLS_SQL, fx.CALLS_SQL, _busiest_sql(1), _reach_sql("calls", 20, False), f"layered AS (SELECT id, {_LAYER} AS layer FROM (SELECT id, lower(name || ' ' || file_path || ' ' || signature) AS t, CASE WHEN contains(file_path, '/controllers/') THEN 'nestjs' WHEN contains(file_path, '/routes/') THEN 'express' ELSE 'generic' END AS fw FROM symbols WHERE id IN (SELECT id FROM reach UNION SELECT id FROM seeds)))", "SELECT CAST(row_number() OVER (ORDER BY r, id) - 1 AS INT) AS step, id, layer, lead(id) OVER (ORDER BY r, id) AS next_id FROM (SELECT *, list_position(['api','controller','service','repository','model'], layer) AS r FROM layered WHERE layer <> 'unknown')")
def trace_data_flow(spark, sf_dir):
    from codeloom.plans.tools import data_flow_trace

    return data_flow_trace(fx.symbols(spark, sf_dir), fx.calls(spark, sf_dir), _busiest(spark, sf_dir, 1)).select("step", "id", "layer", "next_id")


_CORE = "max(CASE WHEN regexp_matches(s.name, '(?i)auth|payment|checkout|security|session|token') THEN 1 ELSE 0 END) = 1"


@query("precommit_blast_radius", fx.SYMBOLS_SQL, fx.CALLS_SQL, "changed AS (SELECT DISTINCT file_path FROM symbols WHERE brand IN ('Brand#3', 'Brand#7'))", "seeds AS (SELECT id FROM symbols WHERE file_path IN (SELECT file_path FROM changed))", _reach_sql("calls", 20, True), f"SELECT (SELECT count(*) FROM seeds) AS changed, count(*) AS affected, CASE WHEN {_CORE} THEN 'critical' WHEN count(*) >= 11 THEN 'high' WHEN count(*) >= 3 THEN 'medium' ELSE 'low' END AS risk FROM (SELECT DISTINCT id FROM reach WHERE id NOT IN (SELECT id FROM seeds)) r JOIN symbols s USING (id)")
def precommit_blast_radius(spark, sf_dir):
    from codeloom.plans.tools import pre_commit

    s = fx.symbols(spark, sf_dir)
    return pre_commit(s, fx.calls(spark, sf_dir), s.where("brand in ('Brand#3', 'Brand#7')").select("file_path").distinct())


@query("changed_symbols_hunks", fx.SYMBOLS_SQL, fx.HUNKS_SQL, "SELECT DISTINCT s.id, s.file_path FROM symbols s JOIN hunks h ON h.path = s.file_path WHERE h.status = 'deleted' OR h.hunk_start IS NULL OR (s.start_line <= h.hunk_start + greatest(h.hunk_lines, 1) - 1 AND s.end_line >= h.hunk_start)")
def changed_symbols_hunks(spark, sf_dir):
    return relate.overlaps(fx.symbols(spark, sf_dir), fx.hunks(spark, sf_dir)).select("id", "file_path")


@query("rename_plan", fx.SYMBOLS_SQL, fx.EDGES_SQL, _busiest_sql(1, "refs"), "target AS (SELECT dst AS id FROM edges GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1)", "SELECT id, file_path, start_line, 'definition' AS reason FROM symbols JOIN target USING (id) UNION ALL SELECT s.id, s.file_path, s.start_line, e.rel_type FROM edges e JOIN target t ON t.id = e.dst JOIN symbols s ON s.id = e.src")
def rename_plan(spark, sf_dir):
    e = fx.edges(spark, sf_dir)
    top = e.groupBy("dst").count().orderBy(F.desc("count"), "dst").first()
    return relate.rename_plan(top.dst if top else "", fx.symbols(spark, sf_dir), e).select("id", "file_path", "start_line", "reason")


@query(
    "shape_drift", "routes AS (SELECT DISTINCT event_type AS path, 'k' || (CAST(json_extract(props, '$.k') AS INT) % (3 + length(event_type) % 5)) AS k FROM events)", "reads AS (SELECT DISTINCT event_type || ':' || user_id AS consumer, event_type AS path, 'k' || (CAST(json_extract(props, '$.k') AS INT) % 9) AS k FROM events)",
    "SELECT consumer, r.path, coalesce(string_agg(r.k, ',' ORDER BY r.k) FILTER (WHERE x.k IS NULL), '') AS missing FROM reads r LEFT JOIN routes x ON x.path = r.path AND x.k = r.k GROUP BY 1, 2",
)
def shape_drift(spark, sf_dir):
    e = T(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k int")["k"])
    key = lambda n: F.concat(F.lit("k"), (F.col("k") % n).cast("string"))
    routes = e.groupBy(F.col("event_type").alias("path")).agg(F.collect_set(key(3 + F.length("event_type") % 5)).alias("keys"))
    reads = e.groupBy(F.concat("event_type", F.lit(":"), F.col("user_id").cast("string")).alias("consumer"), F.col("event_type").alias("path")).agg(F.array_sort(F.collect_set(key(9))).alias("keys"))
    return relate.contract_drift(routes, reads).select("consumer", "path", F.array_join("missing", ",").alias("missing"))


@query("verify_usage", fx.SYMBOLS_SQL, fx.CALLS_SQL, f"u AS (SELECT s.id, count(c.src) AS callers, bool_or(s.visibility = 'public' OR s.kind = 'export' OR {_ENTRY}) AS outside FROM symbols s LEFT JOIN calls c ON c.dst = s.id GROUP BY s.id)", "SELECT id, callers, CASE WHEN callers > 0 THEN 'present' WHEN outside THEN 'uncertain' ELSE 'absent' END AS verdict, CASE WHEN callers > 0 THEN 0.95 WHEN outside THEN 0.5 ELSE 0.8 END::DOUBLE AS confidence, CASE WHEN callers > 0 THEN 'refuted' WHEN outside THEN 'uncertain' ELSE 'confirmed' END AS dead_claim FROM u")
def verify_usage(spark, sf_dir):
    from codeloom.plans.tools import verify_usage as verify

    return verify(fx.symbols(spark, sf_dir), fx.calls(spark, sf_dir))


@query("verify_edge", fx.EDGES_SQL, "claims AS (SELECT DISTINCT 'p' || l_partkey AS src, 'p' || (l_partkey * 3 % (SELECT count(*) FROM part)) AS dst FROM lineitem UNION SELECT src, dst FROM calls)", "SELECT c.src, c.dst, count(e.rel_type) > 0 AS present, coalesce(string_agg(e.rel_type, ',' ORDER BY e.rel_type), '') AS rel_types FROM claims c LEFT JOIN edges e ON e.src = c.src AND e.dst = c.dst GROUP BY 1, 2")
def verify_edge(spark, sf_dir):
    from codeloom.plans.tools import verify_edges

    x = T(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("p"), (F.col("l_partkey") * 3 % fx.parts(spark, sf_dir)).cast("string")).alias("dst"))
    claims = x.union(fx.calls(spark, sf_dir).select("src", "dst")).distinct()
    return verify_edges(claims, fx.edges(spark, sf_dir)).select("src", "dst", "present", F.array_join("rel_types", ",").alias("rel_types"))


@query("verify_reach", fx.SYMBOLS_SQL, fx.CALLS_SQL, _busiest_sql(5), _reach_sql("calls", 20, False), "SELECT a.id AS src, b.id AS dst, r.depth IS NOT NULL AS present, CAST(coalesce(r.depth, -1) AS INT) AS hops FROM seeds a CROSS JOIN symbols b LEFT JOIN reach r ON r.seed = a.id AND r.id = b.id")
def verify_reach(spark, sf_dir):
    from codeloom.plans.tools import verify_reachability

    claims = _busiest(spark, sf_dir, 5).select(F.col("id").alias("src")).join(fx.symbols(spark, sf_dir).select(F.col("id").alias("dst")))
    return verify_reachability(claims, fx.calls(spark, sf_dir)).select("src", "dst", "present", F.coalesce("hops", F.lit(-1)).alias("hops"))


_STOP = ",".join(f"'{w}'" for w in fixed.STOP_WORDS)
_SPLIT = "string_split(lower(regexp_replace(regexp_replace(regexp_replace(x, '[_-]', ' ', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), ' ')"
_KEYWORDS = f"words AS (SELECT id, seq, unnest({_SPLIT}) AS keyword FROM (SELECT id, seq, name AS x FROM symbols UNION ALL SELECT id, seq, unnest(regexp_extract_all(signature, '[a-zA-Z_][a-zA-Z0-9_]*')) FROM symbols)), index AS (SELECT DISTINCT keyword, id, seq FROM words WHERE length(keyword) > 1 AND keyword NOT IN ({_STOP}))"


@query("keyword_index", fx.SYMBOLS_SQL, _KEYWORDS, "SELECT keyword, id FROM index")
def keyword_index(spark, sf_dir):
    return search.keyword_index(fx.symbols(spark, sf_dir)).select("keyword", "id")


@query("keyword_df", fx.SYMBOLS_SQL, _KEYWORDS, "SELECT keyword, count(*) AS n, min(seq) AS first_seq FROM index GROUP BY 1")
def keyword_df(spark, sf_dir):
    return search.keyword_index(fx.symbols(spark, sf_dir)).groupBy("keyword").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


@query("keyword_lists", fx.SYMBOLS_SQL, _KEYWORDS, "SELECT keyword, string_agg(id, ',' ORDER BY seq, id) AS ids FROM index GROUP BY 1")
def keyword_lists(spark, sf_dir):
    return search.keyword_lists(search.keyword_index(fx.symbols(spark, sf_dir))).select("keyword", F.array_join("ids", ",").alias("ids"))


@query("augment_candidates", fx.SYMBOLS_SQL, "SELECT id, name FROM (SELECT id, name FROM symbols WHERE contains(lower(name), 'gear') OR contains(lower(name), 'auth') ORDER BY id LIMIT 50) ORDER BY length(name), id LIMIT 3")
def augment_candidates(spark, sf_dir):
    return search.augment_candidates(fx.symbols(spark, sf_dir), ["gear", "AUTH"])


_INTENT = "CASE " + " ".join(f"WHEN regexp_matches(t, '(?i){p}') THEN '{n}'" for n, p, _ in fixed.INTENTS) + " ELSE 'smartSearch' END"
_CLAIM = "said AS (SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 0 THEN 'what is the impact of \"save_order\" on ' WHEN 1 THEN 'Trace data flow for ' WHEN 2 THEN 'who calls parseUrl ' WHEN 3 THEN 'blast radius of src/a.ts ' WHEN 4 THEN 'find; DROP TABLE x -- ' ELSE '' END || role AS t FROM conversations)"


def _said(spark, sf_dir):
    k = (F.col("conv_id") + F.col("turn")) % 6
    t = F.when(k == 0, 'what is the impact of "save_order" on ').when(k == 1, "Trace data flow for ").when(k == 2, "who calls parseUrl ").when(k == 3, "blast radius of src/a.ts ").when(k == 4, "find; DROP TABLE x -- ").otherwise("")
    return T(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(t, F.col("role")).alias("t"))


@query("intent_classify", _CLAIM, f"SELECT conv_id, turn, {_INTENT} AS intent, CASE WHEN regexp_extract(t, '[\"''`]([^\"''`]+)[\"''`]', 1) <> '' THEN regexp_extract(t, '[\"''`]([^\"''`]+)[\"''`]', 1) ELSE regexp_extract_all(t, '\\b[A-Za-z_][A-Za-z0-9_]*\\b')[-1] END AS target, array_to_string(regexp_extract_all(t, '\\S+\\.\\w+'), ',') AS paths FROM said")
def intent_classify(spark, sf_dir):
    t = F.col("t")
    return _said(spark, sf_dir).select("conv_id", "turn", text.intent(t).alias("intent"), text.target(t).alias("target"), F.array_join(text.mentioned_paths(t), ",").alias("paths"))


@query("preprocess_text", "SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[^A-Za-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS clean FROM conversations")
def preprocess_text(spark, sf_dir):
    return T(spark, sf_dir, "conversations").select("conv_id", "turn", text.preprocess(F.col("text")).alias("clean"))


def _duck(pattern: str) -> str:
    """The pattern for RE2 with its flags as an option."""
    return pattern.replace("'", "''")


_SANITIZE = "t"
for _p in fixed.MALICIOUS:
    _SANITIZE = f"regexp_replace({_SANITIZE}, '{_duck(_p)}', '', 'g')"


@query("sanitize_text", _CLAIM, f"SELECT conv_id, turn, trim(regexp_replace({_SANITIZE}, '\\s+', ' ', 'g')) AS clean FROM said")
def sanitize_text(spark, sf_dir):
    return _said(spark, sf_dir).select("conv_id", "turn", text.sanitize(F.col("t")).alias("clean"))


_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _vector(spark, sf_dir, vec_id):
    row = T(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row.embedding] if row else []


def _embedded(spark, sf_dir):
    return T(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("symbol_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")


@query("semantic_topk", f"SELECT CAST(e.vec_id AS VARCHAR) AS symbol_id, round({_COS}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q ORDER BY {_COS} DESC, 1 LIMIT 10")
def semantic_topk(spark, sf_dir):
    found = search.semantic_topk(_embedded(spark, sf_dir), _vector(spark, sf_dir, 3), 10, -1.0)
    return found.select("symbol_id", F.round("score", 6).alias("score"))


@query("semantic_threshold", f"SELECT CAST(e.vec_id AS VARCHAR) AS symbol_id, round({_COS}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE {_COS} >= 0.25 ORDER BY {_COS} DESC, 1 LIMIT 200")
def semantic_threshold(spark, sf_dir):
    found = search.semantic_topk(_embedded(spark, sf_dir), _vector(spark, sf_dir, 7), 200, 0.25)
    return found.select("symbol_id", F.round("score", 6).alias("score"))


@query("search_confidence", f"hits AS (SELECT e.vec_id, {_COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY score DESC, CAST(e.vec_id AS VARCHAR) LIMIT 20)", "SELECT round(least(greatest(avg(score) + 0.05, 0.5), 1.0), 6) AS with_structure, round(least(greatest(0.6 * max(score) + 0.4 * avg(CASE WHEN vec_id % 3 = 0 THEN 1.0 ELSE 0.0 END), 0.5), 0.99), 6) AS resolved FROM hits")
def search_confidence(spark, sf_dir):
    hits = search.semantic_topk(_embedded(spark, sf_dir), _vector(spark, sf_dir, 7), 20, -1.0).agg(F.avg("score").alias("a"), F.max("score").alias("m"), F.avg(F.when(F.col("symbol_id").cast("long") % 3 == 0, 1.0).otherwise(0.0)).alias("r"))
    return hits.select(F.round(graph.search_confidence(F.col("a"), F.lit(True)), 6).alias("with_structure"), F.round(graph.resolved_confidence(F.col("m"), F.col("r")), 6).alias("resolved"))


@query("category_centroid_classify", f"refs AS (SELECT label, embedding FROM embeddings WHERE vec_id < 5)", f"SELECT symbol_id, category, round(score, 6) AS score FROM (SELECT CAST(e.vec_id AS VARCHAR) AS symbol_id, CASE WHEN max({_COS}) >= 0.2 THEN max_by(q.vec_id, {_COS})::VARCHAR ELSE 'unknown' END AS category, max({_COS}) AS score FROM embeddings e, (SELECT vec_id, embedding FROM embeddings WHERE vec_id < 5) q GROUP BY e.vec_id)")
def category_centroid_classify(spark, sf_dir):
    refs = T(spark, sf_dir, "embeddings").where("vec_id < 5").select(F.col("vec_id").cast("string").alias("category"), F.col("embedding").cast("array<double>").alias("vector"))
    return search.classify_by_reference(_embedded(spark, sf_dir), refs, 0.2).select("symbol_id", "category", F.round("score", 6).alias("score"))


@query(
    "entry_points", fx.SYMBOLS_SQL, fx.CALLS_SQL, "deg AS (SELECT s.*, coalesce(i.n, 0) AS i, o.n AS o FROM symbols s LEFT JOIN (SELECT dst, count(*) n FROM calls GROUP BY 1) i ON i.dst = s.id JOIN (SELECT src, count(*) n FROM calls GROUP BY 1) o ON o.src = s.id WHERE kind IN ('function', 'method', 'class'))",
    f"SELECT id, round(o / (i + 1) * CASE WHEN visibility = 'public' THEN 2.0 ELSE 1.0 END * CASE WHEN {_UTILITY} THEN 0.3 WHEN {_ENTRY} THEN 1.5 ELSE 1.0 END, 6)::DOUBLE AS score FROM deg WHERE o / (i + 1) * CASE WHEN visibility = 'public' THEN 2.0 ELSE 1.0 END * CASE WHEN {_UTILITY} THEN 0.3 WHEN {_ENTRY} THEN 1.5 ELSE 1.0 END > 1.0",
)
def entry_points(spark, sf_dir):
    return flows.entry_points(fx.symbols(spark, sf_dir), fx.calls(spark, sf_dir)).select("id", F.round("score", 6).alias("score"))


def _traces(spark, sf_dir):
    s, c = fx.symbols(spark, sf_dir), fx.calls(spark, sf_dir)
    entries = cut(flows.entry_points(s, c))
    ordered = c.withColumn("seq", F.substring("dst", 2, 20).cast("long"))
    return flows.distinct_traces(flows.flow_traces(entries, ordered), entries), s


@query("flow_traces")
def flow_traces(spark, sf_dir):
    return _traces(spark, sf_dir)[0].select("entry", F.array_join("path", ",").alias("path"), "cyclic")


@query("flow_processes")
def flow_processes(spark, sf_dir):
    heads, steps = flows.processes(*_traces(spark, sf_dir))
    return heads.join(by_key(steps), heads.id == steps.process_id).select("id", "name", "step_order", "symbol_id")


@query("process_steps", fx.SYMBOLS_SQL, fx.STEPS_SQL, "SELECT process_id, step_order, s.id, s.name FROM steps JOIN symbols s ON s.id = symbol_id")
def process_steps(spark, sf_dir):
    s = fx.symbols(spark, sf_dir).select("id", "name")
    return fx.steps(spark, sf_dir).join(s, F.col("symbol_id") == F.col("id")).select("process_id", "step_order", "id", "name")


@query("data_flow_edges", fx.SYMBOLS_SQL, fx.DENSE_SQL, fx.STEPS_SQL, "nxt AS (SELECT process_id, step_order, symbol_id AS src, lead(symbol_id) OVER (PARTITION BY process_id ORDER BY step_order) AS dst FROM steps)", "SELECT n.process_id, n.step_order, n.src, n.dst, s.kind AS data_type FROM nxt n JOIN (SELECT DISTINCT src, dst FROM dense UNION SELECT 'p' || seq, 'p' || ((seq + 7) % (SELECT count(*) FROM part)) FROM symbols) c ON c.src = n.src AND c.dst = n.dst JOIN symbols s ON s.id = n.src")
def data_flow_edges(spark, sf_dir):
    made = fx.symbols(spark, sf_dir).select(F.col("id").alias("src"), F.concat(F.lit("p"), ((F.col("seq") + 7) % fx.parts(spark, sf_dir)).cast("string")).alias("dst"))
    calls = fx.calls(spark, sf_dir, dense=True).select("src", "dst").union(made).distinct()
    return flows.data_flow(fx.steps(spark, sf_dir), calls, fx.symbols(spark, sf_dir).withColumn("signature", F.concat(F.lit("f(): "), F.col("kind"))))


_GRAPH = "kinds AS (SELECT id FROM symbols WHERE kind IN ('function', 'class', 'method', 'interface')), pairs AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM {c} WHERE src IN (SELECT id FROM kinds) AND dst IN (SELECT id FROM kinds))"


@query("cluster_graph", fx.SYMBOLS_SQL, fx.DENSE_SQL, _GRAPH.format(c="dense"), "SELECT a, b FROM pairs")
def cluster_graph(spark, sf_dir):
    return cluster.cluster_graph(fx.symbols(spark, sf_dir), fx.calls(spark, sf_dir, dense=True), large=1 << 60)


@query("cluster_graph_pruned", fx.SYMBOLS_SQL, fx.CALLS_SQL, _GRAPH.format(c="calls"), "multi AS (SELECT src, dst FROM calls WHERE src IN (SELECT id FROM kinds) AND dst IN (SELECT id FROM kinds)), many AS (SELECT id FROM (SELECT src AS id FROM multi UNION ALL SELECT dst FROM multi) GROUP BY 1 HAVING count(*) >= 2)", "SELECT a, b FROM pairs WHERE a IN (SELECT id FROM many) AND b IN (SELECT id FROM many)")
def cluster_graph_pruned(spark, sf_dir):
    return cluster.cluster_graph(fx.symbols(spark, sf_dir), fx.calls(spark, sf_dir), large=100)


@query("connected_components", fx.SYMBOLS_SQL, fx.CALLS_SQL, _GRAPH.format(c="calls"), "walk AS (SELECT a AS id, a AS o FROM pairs UNION SELECT b, b FROM pairs UNION SELECT w.id, CASE WHEN p.a = w.o THEN p.b ELSE p.a END FROM walk w JOIN pairs p ON p.a = w.o OR p.b = w.o)", "SELECT id, min(o) AS component FROM walk GROUP BY id")
def connected_components(spark, sf_dir):
    return cluster.connected(cluster.cluster_graph(fx.symbols(spark, sf_dir), fx.calls(spark, sf_dir), large=1 << 60))


@query("louvain_communities")
def louvain_communities(spark, sf_dir):
    s = fx.symbols(spark, sf_dir)
    return cluster.louvain(cluster.cluster_graph(s, fx.calls(spark, sf_dir)), s.select("id", "seq")).withColumn("modularity", F.round("modularity", 9))


@query("cluster_cohesion", fx.SYMBOLS_SQL, fx.DENSE_SQL, _GRAPH.format(c="dense"), "m AS (SELECT brand AS cluster_id, id, row_number() OVER (PARTITION BY brand ORDER BY seq, id) AS r FROM symbols), both_ways AS (SELECT a AS id, b AS other FROM pairs UNION ALL SELECT b, a FROM pairs)", "SELECT c.cluster_id, round(coalesce(x.v, 0.0), 6) AS cohesion FROM (SELECT DISTINCT cluster_id FROM m) c LEFT JOIN (SELECT m.cluster_id, avg(CASE WHEN o.id IS NOT NULL THEN 1.0 ELSE 0.0 END) AS v FROM m JOIN both_ways e ON e.id = m.id LEFT JOIN m o ON o.id = e.other AND o.cluster_id = m.cluster_id WHERE m.r <= 50 GROUP BY 1) x USING (cluster_id)")
def cluster_cohesion(spark, sf_dir):
    pairs = cluster.cluster_graph(fx.symbols(spark, sf_dir), fx.calls(spark, sf_dir, dense=True), large=1 << 60)
    return cluster.cohesion(fx.members(spark, sf_dir), pairs).select("cluster_id", F.round("cohesion", 6).alias("cohesion"))


@query("cluster_label", fx.SYMBOLS_SQL, "v AS (SELECT brand AS cluster_id, split_part(file_path, '/', 2) AS folder, count(*) AS n, min(seq) AS s FROM symbols WHERE split_part(file_path, '/', 2) <> 'lib' GROUP BY 1, 2)", "SELECT cluster_id, upper(substr(folder, 1, 1)) || substr(folder, 2) AS label FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, s) AS r FROM v) WHERE r = 1")
def cluster_label(spark, sf_dir):
    return cluster.labels(fx.members(spark, sf_dir), fx.symbols(spark, sf_dir))


_VOTES = ", ".join("sum(" + " + ".join(f"contains(t, '{w}')::INT" for w in ws) + f") AS h{i}" for i, ws in enumerate(fixed.CATEGORY_WORDS.values()))
_TOP = "greatest(" + ", ".join(f"h{i}" for i in range(len(fixed.CATEGORY_WORDS))) + ")"


@query("cluster_keyword_category", fx.SYMBOLS_SQL, f"v AS (SELECT brand AS cluster_id, {_VOTES} FROM (SELECT brand, lower(name || ' ' || signature) AS t FROM symbols) GROUP BY 1)", f"SELECT cluster_id, CASE WHEN {_TOP} = 0 THEN 'unknown' " + " ".join(f"WHEN h{i} = {_TOP} THEN '{n}'" for i, n in enumerate(fixed.CATEGORY_WORDS)) + " END AS category FROM v")
def cluster_keyword_category(spark, sf_dir):
    return cluster.categories(fx.members(spark, sf_dir), fx.symbols(spark, sf_dir))


def _refs(spark, sf_dir):
    s = fx.symbols(spark, sf_dir)
    n = fx.parts(spark, sf_dir)
    o = T(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ref_id"), F.concat(F.lit("p"), (F.col("o_custkey") % n).cast("string")).alias("a"), F.concat(F.lit("p"), (F.col("o_orderkey") * 13 % n).cast("string")).alias("b"))
    return o.join(s.select(F.col("id").alias("a"), "file_path"), "a").join(s.select(F.col("id").alias("b"), "name"), "b").select("ref_id", "file_path", "name")


_REFS = "refs0 AS (SELECT o_orderkey AS ref_id, x.file_path, y.name FROM orders JOIN symbols x ON x.id = 'p' || (o_custkey % (SELECT count(*) FROM part)) JOIN symbols y ON y.id = 'p' || (o_orderkey * 13 % (SELECT count(*) FROM part)))"


@query(
    "tiered_resolution", fx.SYMBOLS_SQL, _REFS, "imps AS (SELECT DISTINCT x.file_path, y.file_path AS f FROM symbols x JOIN symbols y ON y.seq = x.seq + 3)", "lasts AS (SELECT file_path, name, max_by(id, seq) AS id, max(seq) AS seq, regexp_replace(file_path, '[^/]*$', '') AS dir FROM symbols GROUP BY 1, 2)",
    "cand AS (SELECT r.ref_id, l.id, l.seq, 0 AS rank FROM refs0 r JOIN lasts l ON l.file_path = r.file_path AND l.name = r.name UNION ALL SELECT r.ref_id, l.id, l.seq, 1 FROM refs0 r JOIN imps i ON i.file_path = r.file_path JOIN lasts l ON l.file_path = i.f AND l.name = r.name "
    "UNION ALL SELECT r.ref_id, l.id, l.seq, 2 FROM refs0 r JOIN lasts l ON l.dir = regexp_replace(r.file_path, '[^/]*$', '') AND l.name = r.name AND l.file_path <> r.file_path UNION ALL SELECT r.ref_id, min(s.id), min(s.seq), 3 FROM refs0 r JOIN symbols s ON s.name = r.name GROUP BY r.ref_id HAVING count(*) = 1)",
    "SELECT r.ref_id, c.id, CASE c.rank WHEN 0 THEN 'same-file' WHEN 1 THEN 'import-scoped' WHEN 2 THEN 'package' WHEN 3 THEN 'global' END AS tier, CASE c.rank WHEN 0 THEN 0.95 WHEN 3 THEN 0.5 WHEN 1 THEN 0.9 WHEN 2 THEN 0.9 END::DOUBLE AS confidence FROM refs0 r LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY rank, seq, id) AS k FROM cand) c ON c.ref_id = r.ref_id AND c.k = 1",
)
def tiered_resolution(spark, sf_dir):
    s = fx.symbols(spark, sf_dir)
    imports = s.select("file_path", (F.col("seq") + 3).alias("n")).join(s.select(F.col("seq").alias("n"), F.col("file_path").alias("imported_file")), "n").select("file_path", "imported_file").distinct()
    return relate.resolve_names(_refs(spark, sf_dir), s, imports)


_POINTS = "points AS (SELECT l_orderkey * 10 + l_linenumber AS point_id, s.file_path, CAST(l_quantity AS INT) * 10 + CAST(l_linenumber AS INT) * 3 AS line FROM (SELECT DISTINCT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2) JOIN symbols s ON s.id = 'p' || l_partkey)"


def _points(spark, sf_dir):
    """Rows stay where their point_id is, so that points are made distinct without a second shuffle; it and the line number tell the order."""
    x = T(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point_id"), "l_linenumber", "l_partkey", "l_quantity").repartition("point_id")
    x = x.groupBy("point_id", "l_linenumber").agg(F.min("l_partkey").alias("k"), F.min("l_quantity").alias("q"))
    s = fx.symbols(spark, sf_dir).select("id", "file_path")
    return x.join(s, F.concat(F.lit("p"), F.col("k").cast("string")) == F.col("id")).select("point_id", "file_path", (F.col("q").cast("int") * 10 + F.col("l_linenumber") * 3).alias("line"))


@query("caller_of_line", fx.SYMBOLS_SQL, _POINTS, "SELECT p.point_id, p.file_path, p.line, min_by(s.id, s.seq) AS id FROM points p JOIN symbols s ON s.file_path = p.file_path AND p.line BETWEEN s.start_line AND s.end_line GROUP BY 1, 2, 3")
def caller_of_line(spark, sf_dir):
    return relate.covering(_points(spark, sf_dir), fx.symbols(spark, sf_dir))


@query("enclosing_of_line", fx.SYMBOLS_SQL, _POINTS, "SELECT p.point_id, p.file_path, p.line, min_by(s.id, (s.end_line - s.start_line) * 10000000 + s.seq) AS id FROM points p JOIN symbols s ON s.file_path = p.file_path AND p.line BETWEEN s.start_line AND s.end_line GROUP BY 1, 2, 3")
def enclosing_of_line(spark, sf_dir):
    return relate.covering(_points(spark, sf_dir), fx.symbols(spark, sf_dir), "enclosing")


_HREFS = "links AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS href FROM pages)"


def _links(spark, sf_dir):
    return T(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("href"))


@query("external_packages", "imp AS (SELECT 'pkg' || (s_suppkey % 7) || '/' || 'sub' || (s_suppkey % 3) || '/x' AS path, CASE s_suppkey % 4 WHEN 0 THEN 'go' WHEN 1 THEN 'typescript' WHEN 2 THEN 'python' ELSE 'java' END AS lang, CASE WHEN s_suppkey % 5 = 0 THEN './' WHEN s_suppkey % 5 = 1 THEN '@' ELSE '' END AS pre FROM supplier)", "SELECT path, lang, lang_external AS external, package, CASE lang WHEN 'go' THEN 'go_modules' WHEN 'typescript' THEN 'npm' WHEN 'python' THEN 'pip' ELSE 'maven' END AS ecosystem, count(*) AS n FROM (SELECT pre || path AS path, lang, pre <> './' AS lang_external, CASE WHEN lang = 'go' THEN array_to_string(list_filter(string_split(pre || path, '/'), lambda x: x <> '')[1:3], '/') WHEN lang = 'java' THEN regexp_replace(array_to_string(list_filter(string_split(pre || path, '.'), lambda x: x <> '')[1:2], '.'), '[./:\\\\]+$', '') WHEN lang = 'typescript' AND pre = '@' THEN array_to_string(string_split(pre || path, '/')[1:2], '/') ELSE regexp_replace(string_split(pre || path, '/')[1], '[./:\\\\]+$', '') END AS package FROM imp) GROUP BY ALL")
def external_packages(spark, sf_dir):
    k = F.col("s_suppkey")
    lang = F.when(k % 4 == 0, "go").when(k % 4 == 1, "typescript").when(k % 4 == 2, "python").otherwise("java")
    pre = F.when(k % 5 == 0, "./").when(k % 5 == 1, "@").otherwise("")
    path = F.concat(pre, F.lit("pkg"), (k % 7).cast("string"), F.lit("/sub"), (k % 3).cast("string"), F.lit("/x"))
    s = T(spark, sf_dir, "supplier").select(path.alias("path"), lang.alias("lang"))
    p, g = F.col("path"), F.col("lang")
    return s.select("path", "lang", packages.is_external(p, g).alias("external"), packages.package_name(p, g).alias("package"), packages.ecosystem(g).alias("ecosystem")).groupBy("path", "lang", "external", "package", "ecosystem").agg(F.count("*").alias("n"))


@query("import_edges_unresolved", _HREFS, "SELECT page_id, href, CAST(row_number() OVER (PARTITION BY page_id, href ORDER BY href) - 1 AS INT) AS ordinal, CASE WHEN length(href) % 2 = 0 THEN 'module:' || href ELSE 'unresolved:' || href END AS target FROM links")
def import_edges_unresolved(spark, sf_dir):
    links = _links(spark, sf_dir)
    known = links.select("href").distinct().where("length(href) % 2 = 0").select("href", F.concat(F.lit("module:"), F.col("href")).alias("hit"))
    return relate.ordinal(links.join(known, "href", "left"), ["page_id", "href"], "href").select("page_id", "href", "ordinal", F.coalesce("hit", F.concat(F.lit("unresolved:"), F.col("href"))).alias("target"))


def _hierarchy(spark):
    h = spark.createDataFrame([("D", "B", 0), ("D", "C", 1), ("B", "A", 0), ("C", "A", 0), ("E", "D", 0), ("E", "I", 1), ("X", "Y", 0), ("Y", "X", 0), ("Z", "P", 0), ("Z", "Q", 1), ("P", "R", 0), ("P", "S", 1), ("Q", "S", 0), ("Q", "R", 1)], "child string, parent string, seq int")
    m = spark.createDataFrame([("A.f", "A", "f", 1, False, "class"), ("B.f", "B", "f", 1, False, "class"), ("C.f", "C", "f", 2, False, "class"), ("D.f", "D", "f", 1, False, "class"), ("E.f", "E", "f", None, False, "class"), ("I.f", "I", "f", 1, True, "interface"), ("C.g", "C", "g", 0, False, "class"), ("E.g", "E", "g", 0, True, "class")], "id string, owner string, name string, params int, abstract boolean, owner_kind string")
    return h, m


@query("mro_order", "SELECT * FROM (VALUES ('D',0,'B',true),('D',1,'C',true),('D',2,'A',true),('B',0,'A',true),('C',0,'A',true),('E',0,'D',true),('E',1,'B',true),('E',2,'C',true),('E',3,'A',true),('E',4,'I',true),('X',0,'Y',false),('Y',0,'X',false),('P',0,'R',true),('P',1,'S',true),('Q',0,'S',true),('Q',1,'R',true),('Z',0,'P',false),('Z',1,'Q',false),('Z',2,'R',false),('Z',3,'S',false)) t(class, position, ancestor, consistent)")
def mro_order(spark, sf_dir):
    return mro.linearise(_hierarchy(spark)[0])


@query("mro_overrides", "SELECT * FROM (VALUES ('B.f','A.f','overrides'),('D.f','B.f','overrides'),('E.f','D.f','overrides')) t(src, dst, rel_type)")
def mro_overrides(spark, sf_dir):
    h, m = _hierarchy(spark)
    return mro.overrides(mro.linearise(h), m)


@query("member_calls", "SELECT * FROM (VALUES (1,'E.f'),(2,'C.g'),(3,'A.f')) t(call_id, id)")
def member_calls(spark, sf_dir):
    h, m = _hierarchy(spark)
    calls = spark.createDataFrame([(1, "E", "f"), (2, "D", "g"), (3, "A", "f"), (4, "A", "g")], "call_id int, receiver_class string, name string")
    return mro.member_calls(calls, mro.linearise(h), m)


@query("rexport_chain", "b AS (SELECT 'f' || o_orderkey AS file, 'f' || (o_orderkey * 7 % (SELECT count(*) FROM orders)) AS nxt FROM orders WHERE o_orderstatus <> 'F')", "walk AS (SELECT file, nxt AS o, [file, nxt] AS seen, 1 AS n FROM b UNION ALL SELECT w.file, b.nxt, list_append(w.seen, b.nxt), n + 1 FROM walk w JOIN b ON b.file = w.o WHERE n < 5 AND NOT list_contains(w.seen, b.nxt))", "SELECT file, max_by(o, n) AS origin_file, CAST(max(n) AS INT) AS n FROM walk GROUP BY file")
def rexport_chain(spark, sf_dir):
    o = T(spark, sf_dir, "orders")
    n = o.count()
    o = o.where("o_orderstatus <> 'F'")  # files of finished orders pass nothing on
    name = lambda c: F.concat(F.lit("f"), c.cast("string"))
    b = o.select(name(F.col("o_orderkey")).alias("file"), F.lit("x").alias("name"), name(F.col("o_orderkey") * 7 % n).alias("from_file"), F.lit("x").alias("from_name"))
    return traverse.rexport_chain(b).select("file", "origin_file", "n")


@query("path_aliases", fx.SYMBOLS_SQL, "SELECT DISTINCT file_path AS path, CASE WHEN file_path LIKE 'src/controllers/%' THEN '@web/' || substr(file_path, length('src/controllers/') + 1) ELSE '@/' || substr(file_path, 5) END AS resolved FROM symbols")
def path_aliases(spark, sf_dir):
    prefixes = spark.createDataFrame([("src/controllers/", "@web/", 0), ("src/", "@/", 1), ("test/", "@t/", 2)], "prefix string, target string, ord int")
    return relate.longest_prefix(fx.symbols(spark, sf_dir).select(F.col("file_path").alias("path")), prefixes).select("path", "resolved")


@query("heritage_edges", fx.SYMBOLS_SQL, "h AS (SELECT x.seq AS ref_id, x.file_path, x.name AS child, y.name AS parent FROM symbols x JOIN symbols y ON y.seq = x.seq + 1 WHERE x.kind = 'class')", "c AS (SELECT ref_id, parent, min_by(s.id, (CASE WHEN s.file_path = h.file_path THEN 0 ELSE 10000000 END) + s.seq) AS child_id FROM h JOIN symbols s ON s.name = h.child GROUP BY 1, 2)", "SELECT ref_id, child_id, min_by(s.id, s.seq) AS parent_id FROM c JOIN symbols s ON s.name = c.parent AND s.id <> c.child_id GROUP BY 1, 2")
def heritage_edges(spark, sf_dir):
    s = fx.symbols(spark, sf_dir)
    h = s.where("kind = 'class'").select(F.col("seq").alias("ref_id"), "file_path", F.col("name").alias("child"), (F.col("seq") + 1).alias("n")).join(s.select(F.col("seq").alias("n"), F.col("name").alias("parent")), "n")
    return relate.heritage(h.select("ref_id", "file_path", "child", "parent"), s)


@query("import_fan_out", fx.SYMBOLS_SQL, "SELECT s.id AS src, 'ext:' || (length(s.file_path) % 5) AS dst, 'dependsOn' AS rel_type FROM symbols s WHERE s.file_path LIKE 'src/lib/%'")
def import_fan_out(spark, sf_dir):
    s = fx.symbols(spark, sf_dir)
    imports = s.where("file_path like 'src/lib/%'").select("file_path", F.concat(F.lit("ext:"), (F.length("file_path") % 5).cast("string")).alias("package_id"))
    return relate.imported_symbols(imports, s)


@query("accessed_keys", fx.SYMBOLS_SQL, "k AS (SELECT 'p' || (event_id % 50) AS id, event_type AS k, min(event_id) AS s FROM events GROUP BY 1, 2)", "SELECT s.id, coalesce(x.keys, '') AS keys FROM symbols s LEFT JOIN (SELECT id, string_agg(k, ',' ORDER BY s) AS keys FROM k GROUP BY 1) x USING (id)")
def accessed_keys(spark, sf_dir):
    hints = T(spark, sf_dir, "events").select(F.concat(F.lit("p"), (F.col("event_id") % 50).cast("string")).alias("child_id"), F.col("event_type").alias("target_name"), F.col("event_id").alias("seq"))
    return relate.accessed_keys(hints, fx.symbols(spark, sf_dir)).select("id", F.array_join("accessed_keys", ",").alias("keys"))


@query("classify_files", "cached AS (SELECT doc_id, n_chars AS h FROM documents WHERE doc_id % 5 <> 0)", "found AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN -1 ELSE n_chars END AS h FROM documents WHERE doc_id % 11 <> 0)", "SELECT 'doc' || coalesce(c.doc_id, f.doc_id) AS path, CASE WHEN c.doc_id IS NULL THEN 'added' WHEN f.doc_id IS NULL THEN 'removed' WHEN c.doc_id % 13 = 0 OR c.h <> f.h THEN 'changed' ELSE 'unchanged' END AS status FROM cached c FULL JOIN found f ON c.doc_id = f.doc_id")
def classify_files(spark, sf_dir):
    d = T(spark, sf_dir, "documents").select("doc_id", "n_chars")
    path = F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("path")
    cached = d.where("doc_id % 5 <> 0").select(path, F.col("n_chars").cast("string").alias("content_hash"), F.lit(1).alias("mtime_ms"), F.when(F.col("doc_id") % 13 == 0, 0).otherwise(1).alias("parse_version"))
    found = d.where("doc_id % 11 <> 0").select(path, F.when(F.col("doc_id") % 7 == 0, F.lit(-1)).otherwise(F.col("n_chars")).cast("string").alias("content_hash"), F.lit(2).alias("mtime_ms"))
    return store.classify_files(cached, found, 1)


@query("delta_equals_full", "SELECT 'left' AS side, 0::BIGINT AS n WHERE false")
def delta_equals_full(spark, sf_dir):
    old = fx.symbols(spark, sf_dir).where("seq % 17 <> 3").withColumn("end_line", F.when(F.col("brand") == "Brand#5", F.lit(0)).otherwise(F.col("end_line")))
    full = fx.symbols(spark, sf_dir).where("brand <> 'Brand#9'")
    files = lambda df: df.groupBy(F.col("file_path").alias("path")).agg(F.sum(F.xxhash64("id", "end_line").cast("decimal(38,0)")).cast("string").alias("content_hash"))
    status = store.classify_files(files(old).withColumns({"mtime_ms": F.lit(1), "parse_version": F.lit(1)}), files(full).withColumn("mtime_ms", F.lit(2)), 1)
    calls = fx.calls(spark, sf_dir)
    s, e = store.apply_delta(old, calls, status, full, calls)
    whole = store.upsert_edges(calls.limit(0), calls, full)
    return store.difference(s.select(*full.columns), full).union(store.difference(e, whole.select(*e.columns)))


@query("upsert_nodes", fx.SYMBOLS_SQL, "SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.name ELSE o.name END AS name, o.kind, n.note FROM (SELECT id, name, kind FROM symbols WHERE seq % 2 = 0) o FULL JOIN (SELECT id, upper(name) AS name, 'n' || seq AS note FROM symbols WHERE seq % 3 = 0) n ON n.id = o.id")
def upsert_nodes(spark, sf_dir):
    s = fx.symbols(spark, sf_dir)
    new = s.where("seq % 3 = 0").select("id", F.upper("name").alias("name"), F.concat(F.lit("n"), F.col("seq").cast("string")).alias("note"), F.lit(2).alias("at"))
    late = new.withColumn("name", F.lit("stale")).withColumn("at", F.lit(1))
    return store.upsert(s.where("seq % 2 = 0").select("id", "name", "kind"), new.union(late), ["id"], "at")


@query("upsert_edges_drop_dangling", fx.SYMBOLS_SQL, fx.CALLS_SQL, "SELECT DISTINCT src, dst, rel_type FROM calls WHERE (src IN (SELECT id FROM symbols WHERE kind <> 'export') AND dst IN (SELECT id FROM symbols WHERE kind <> 'export')) OR length(src) = 4")
def upsert_edges_drop_dangling(spark, sf_dir):
    c = fx.calls(spark, sf_dir)
    return store.upsert_edges(c.where("length(src) = 4"), c, fx.symbols(spark, sf_dir).where("kind <> 'export'")).select("src", "dst", "rel_type")


@query("delete_by_file", fx.SYMBOLS_SQL, fx.CALLS_SQL, "gone AS (SELECT id FROM symbols WHERE file_path LIKE 'src/models/%')", "SELECT (SELECT count(*) FROM symbols WHERE id NOT IN (SELECT id FROM gone)) AS symbols, (SELECT count(*) FROM calls WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)) AS edges")
def delete_by_file(spark, sf_dir):
    s = fx.symbols(spark, sf_dir)
    left, e = store.delete_files(s, fx.calls(spark, sf_dir), s.where("file_path like 'src/models/%'").select("file_path"))
    return left.agg(F.count("*").alias("symbols")).crossJoin(e.agg(F.count("*").alias("edges")))


@query("budget_batches", fx.SYMBOLS_SQL, "r AS (SELECT brand, seq, length(name) AS s, row_number() OVER (PARTITION BY brand ORDER BY seq) AS k FROM symbols)", "walk AS (SELECT brand, k, seq, 0 AS b, s AS used, 1 AS n FROM r WHERE k = 1 UNION ALL SELECT r.brand, r.k, r.seq, CASE WHEN used + s > 60 OR n >= 8 THEN b + 1 ELSE b END, CASE WHEN used + s > 60 OR n >= 8 THEN s ELSE used + s END, CASE WHEN used + s > 60 OR n >= 8 THEN 1 ELSE n + 1 END FROM walk w JOIN r ON r.brand = w.brand AND r.k = w.k + 1)", "SELECT brand, seq, CAST(b AS INT) AS batch FROM walk")
def budget_batches(spark, sf_dir):
    s = fx.symbols(spark, sf_dir).select("brand", "seq", "name")
    return store.budget_batches(s, F.length("name").cast("long"), 60, 8, ["brand"], "seq").select("brand", "seq", "batch")


@query("token_budget_slice", fx.SYMBOLS_SQL, fx.CALLS_SQL, _busiest_sql(3), _reach_sql("calls", 20, False), "f AS (SELECT r.seed, r.id, r.depth, CAST(ceil((length(name) + length(signature) + length(file_path) + 40 * (end_line - start_line + 1)) / 4) AS BIGINT) AS tokens FROM (SELECT seed, id, depth FROM reach WHERE seed <> id) r JOIN symbols s USING (id)), o AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, id) AS k FROM f), w AS (SELECT seed, id, depth, tokens, k, tokens <= 600 AS taken, CASE WHEN tokens <= 600 THEN tokens ELSE 0 END AS used FROM o WHERE k = 1 UNION ALL SELECT o.seed, o.id, o.depth, o.tokens, o.k, w.used + o.tokens <= 600, CASE WHEN w.used + o.tokens <= 600 THEN w.used + o.tokens ELSE w.used END FROM w JOIN o ON o.seed = w.seed AND o.k = w.k + 1)", "SELECT seed, id, CAST(depth AS INT) AS depth, tokens, taken FROM w")
def token_budget_slice(spark, sf_dir):
    s = fx.symbols(spark, sf_dir)
    found = traverse.reach(fx.calls(spark, sf_dir), _busiest(spark, sf_dir, 3), 20).where("seed <> id")
    lines = F.col("end_line") - F.col("start_line") + 1
    found = found.join(s.select("id", graph.tokens(F.col("name"), F.col("signature"), F.col("file_path"), lines).alias("tokens")), "id").withColumn("pinned", F.lit(False))
    return flows.token_slice(found, 600).select("seed", "id", "depth", "tokens", "taken")


@query("export_symbol_markdown", fx.SYMBOLS_SQL, fx.CALLS_SQL, "n AS (SELECT dst AS id, count(*) AS callers FROM calls GROUP BY 1)", "SELECT id, 'src/' || regexp_replace(substr(file_path, 5), '\\.[^./]+$', '.md') AS path, '## ' || name || chr(10) || '- kind: ' || kind || chr(10) || '- lines: ' || start_line || '-' || end_line || chr(10) || '- visibility: ' || visibility || chr(10) || '- complexity: ' || cyclomatic || chr(10) || '- callers: ' || coalesce(callers, 0) AS section FROM symbols LEFT JOIN n USING (id)")
def export_symbol_markdown(spark, sf_dir):
    from codeloom.operators.export import symbol_sections

    return symbol_sections(fx.symbols(spark, sf_dir), fx.calls(spark, sf_dir)).select("id", "path", "section")


@query("export_index", fx.SYMBOLS_SQL, "SELECT brand AS cluster_id, regexp_replace(regexp_replace(lower(brand), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, count(*) AS n, string_agg(name, ', ' ORDER BY seq) AS names FROM symbols GROUP BY 1")
def export_index(spark, sf_dir):
    from codeloom.operators.export import cluster_index

    return cluster_index(fx.members(spark, sf_dir), fx.symbols(spark, sf_dir))


@query("watch_debounce_batches", "e AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS s FROM events)", "g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM e)", "SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM g GROUP BY user_id, b")
def watch_debounce_batches(spark, sf_dir):
    from codeloom.streaming.watch import debounce

    e = T(spark, sf_dir, "events").select("ts", F.col("user_id").alias("root"), F.col("event_id").cast("string").alias("path"))
    return debounce(e, "2 hours").select(F.col("root").alias("user_id"), "first_ts", "last_ts", "n")


@query("latency_percentiles", "last AS (SELECT value FROM events ORDER BY event_id DESC LIMIT 2048), r AS (SELECT value, row_number() OVER (ORDER BY value) AS k, count(*) OVER () AS n FROM last)", "SELECT max(CASE WHEN k = ceil(n * 0.5) THEN value END) AS p50, max(CASE WHEN k = ceil(n * 0.99) THEN value END) AS p99, CAST(max(n) AS INT) AS n FROM r")
def latency_percentiles(spark, sf_dir):
    return store.percentiles(T(spark, sf_dir, "events"), "value", "event_id")


@query("unified_diff", "SELECT 'src/f' || l_orderkey || '.ts' AS path, CAST(l_linenumber AS INT) AS hunk_start, CAST(CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE l_partkey % 9 END AS INT) AS hunk_lines FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2)")
def unified_diff(spark, sf_dir):
    from codeloom.sources.gitdiff import parse_unified

    x = T(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("k"))
    n, p = F.col("l_linenumber").cast("string"), (F.col("k") % 9).cast("string")
    head = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("@@ -1 +"), n, F.lit(" @@ f()"))).otherwise(F.concat(F.lit("@@ -1,2 +"), n, F.lit(","), p, F.lit(" @@")))
    files = x.select("l_orderkey").distinct().select("l_orderkey", F.lit(0).alias("o"), F.concat(F.lit("+++ b/src/f"), F.col("l_orderkey").cast("string"), F.lit(".ts")).alias("line"))
    lines = files.union(x.select("l_orderkey", F.col("l_linenumber"), head))
    return parse_unified(lines.select(F.col("l_orderkey").alias("diff_id"), F.col("o").alias("seq"), "line")).select("path", "hunk_start", "hunk_lines")


@query("graph_status", fx.SYMBOLS_SQL, fx.EDGES_SQL, "SELECT (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM edges) AS relationships, (SELECT count(DISTINCT brand) FROM symbols) AS clusters")
def graph_status(spark, sf_dir):
    from codeloom.plans.tools import status

    return status(fx.symbols(spark, sf_dir), fx.edges(spark, sf_dir), fx.members(spark, sf_dir))


@query("cypher_callers", fx.SYMBOLS_SQL, fx.CALLS_SQL, "SELECT DISTINCT a.id AS caller, b.name AS name FROM calls c JOIN symbols a ON a.id = c.src JOIN symbols b ON b.id = c.dst WHERE b.kind = 'class' AND contains(lower(a.name), 'gear') ORDER BY caller, name LIMIT 40")
def cypher_callers(spark, sf_dir):
    from codeloom.sources.cypher import run

    tables = {"Symbol": fx.symbols(spark, sf_dir), "CALLS": fx.calls(spark, sf_dir)}
    return run(tables, "MATCH (a:Symbol)-[:CALLS]->(b:Symbol) WHERE b.kind = $kind AND toLower(a.name) CONTAINS toLower($term) RETURN DISTINCT a.id AS caller, b.name AS name ORDER BY caller, name LIMIT 40", {"kind": "class", "term": "GEAR"})


@query("ignored_paths", "p AS (SELECT CASE n_chars % 8 WHEN 0 THEN 'src/node_modules/a.ts' WHEN 1 THEN 'src/a.min.js' WHEN 2 THEN 'src/types.d.ts' WHEN 3 THEN 'src/x.bundle.css' WHEN 4 THEN 'LICENSE' WHEN 5 THEN 'lib/b.py' WHEN 6 THEN 'lib/b.PNG' ELSE 'src/C.TSX' END AS path FROM documents)", "SELECT path, path NOT IN ('lib/b.py', 'src/C.TSX') AS ignored, CASE path WHEN 'lib/b.py' THEN 'python' WHEN 'src/C.TSX' THEN 'typescript' WHEN 'src/node_modules/a.ts' THEN 'typescript' WHEN 'src/types.d.ts' THEN 'typescript' WHEN 'src/a.min.js' THEN 'javascript' ELSE '' END AS language, count(*) AS n FROM p GROUP BY 1, 2, 3")
def ignored_paths(spark, sf_dir):
    paths = ["src/node_modules/a.ts", "src/a.min.js", "src/types.d.ts", "src/x.bundle.css", "LICENSE", "lib/b.py", "lib/b.PNG", "src/C.TSX"]
    p = T(spark, sf_dir, "documents").select(F.array(*map(F.lit, paths))[(F.col("n_chars") % 8).cast("int")].alias("path"))
    return p.groupBy("path", graph.is_ignored(F.col("path")).alias("ignored"), F.coalesce(graph.language(F.col("path")), F.lit("")).alias("language")).agg(F.count("*").alias("n"))


@query("safe_paths", "SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN true WHEN 4 THEN false ELSE false END AS safe FROM supplier")
def safe_paths(spark, sf_dir):
    paths = ["src/a.ts", "../x", "/etc/passwd", "a/b c.md", "x%2e%2e/y", "a|b"]
    return T(spark, sf_dir, "supplier").select("s_suppkey", text.is_safe_path(F.array(*map(F.lit, paths))[(F.col("s_suppkey") % 6).cast("int")]).alias("safe"))


from codeloom.plans import queries_tables  # noqa: E402, F401  (registers more queries)

"""More of the driver's queries: sources, snapshots, caches, groups of what is affected, texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import graph, text
from codeloom.operators import cluster, mro, relate, store, traverse
from codeloom.plans import fixtures as fx
from codeloom.plans.queries import T, _CORE, _reach_sql, query
from codeloom.session import by_key, shared_folder
from codeloom.sources import files as source_files
from codeloom.sources import gitdiff

_FILES = "files AS (SELECT regexp_replace(file_path, '\\.ts$', '') || '/' || id || CASE seq % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' ELSE '.go' END AS path, CASE seq % 3 WHEN 0 THEN 'typescript' WHEN 1 THEN 'python' ELSE 'go' END AS language FROM symbols)"


@query(
    "folder_languages", fx.SYMBOLS_SQL, _FILES, "cuts AS (SELECT array_to_string(list_slice(string_split(path, '/'), 1, k), '/') AS folder, language, path FROM files, (SELECT unnest([0, 1, 2, 3]) AS k))",
    "SELECT folder, language FROM (SELECT folder, language, row_number() OVER (PARTITION BY folder ORDER BY count(*) DESC, min(path)) AS r FROM cuts GROUP BY 1, 2) WHERE r = 1",
)
def folder_languages(spark, sf_dir):
    s = fx.symbols(spark, sf_dir)
    ending = F.when(F.col("seq") % 3 == 0, ".ts").when(F.col("seq") % 3 == 1, ".py").otherwise(".go")
    f = s.select(F.concat(F.regexp_replace("file_path", r"\.ts$", "/"), "id", ending).alias("path"))
    return source_files.folder_languages(f.withColumn("language", graph.language(F.col("path"))))


def _status_lines(spark, sf_dir):
    """A line of a name-status diff for each order; some are broken, some of ignored paths."""
    k = F.col("o_orderkey")
    folder = F.when(k % 11 == 0, "node_modules/").otherwise("src/")
    path, old = (F.concat(folder, F.lit(x), k.cast("string"), F.lit(".ts")) for x in ("f", "g"))
    letter = F.array(*map(F.lit, ["M", "A", "D", "T", "R087", "C100", "X", "M"]))[(k % 8).cast("int")]
    line = F.when(letter.isin("R087", "C100"), F.concat_ws("\t", letter, old, path)).when(k % 8 == 7, letter).otherwise(F.concat_ws("\t", letter, path))
    return T(spark, sf_dir, "orders").select(line.alias("line"))


_STATUS = """lines AS (SELECT CASE WHEN o_orderkey % 8 IN (4, 5) THEN l || chr(9) || d || 'g' || o_orderkey || '.ts' || chr(9) || p WHEN o_orderkey % 8 = 7 THEN l ELSE l || chr(9) || p END AS line FROM (
    SELECT o_orderkey, d, d || 'f' || o_orderkey || '.ts' AS p, ['M', 'A', 'D', 'T', 'R087', 'C100', 'X', 'M'][o_orderkey % 8 + 1] AS l FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'node_modules/' ELSE 'src/' END AS d FROM orders))),
status AS (SELECT CASE WHEN x[1][1] IN ('R', 'C') THEN x[3] ELSE x[2] END AS path, CASE x[1][1] WHEN 'A' THEN 'added' WHEN 'C' THEN 'added' WHEN 'D' THEN 'deleted' WHEN 'R' THEN 'renamed' ELSE 'modified' END AS status,
    CASE WHEN x[1][1] IN ('R', 'C') THEN x[2] END AS old_path FROM (SELECT string_split(line, chr(9)) AS x FROM lines WHERE regexp_matches(line, '^[ADMTRC][0-9]*\t')))"""


@query("name_status", _STATUS, "SELECT path, status, old_path FROM status")
def name_status(spark, sf_dir):
    return gitdiff.parse_status(_status_lines(spark, sf_dir)).select("path", "status", "old_path")


@query(
    "diff_combined", _STATUS, "h AS (SELECT CASE WHEN l_orderkey % 11 = 0 THEN 'node_modules/' ELSE 'src/' END || 'f' || l_orderkey || '.ts' AS path, CAST(l_linenumber AS INT) AS hunk_start, CAST(l_partkey % 9 AS INT) AS hunk_lines FROM lineitem)",
    "SELECT s.path, old_path, status, hunk_start, hunk_lines FROM status s LEFT JOIN h ON h.path = s.path AND status <> 'deleted' WHERE s.path NOT LIKE 'node_modules/%'",
)
def diff_combined(spark, sf_dir):
    k = F.col("l_orderkey")
    path = F.concat(F.when(k % 11 == 0, "node_modules/f").otherwise("src/f"), k.cast("string"), F.lit(".ts"))
    h = T(spark, sf_dir, "lineitem").select(path.alias("path"), F.col("l_linenumber").cast("int").alias("hunk_start"), (F.col("l_partkey") % 9).cast("int").alias("hunk_lines"))
    return gitdiff.combine(gitdiff.parse_status(_status_lines(spark, sf_dir)), h)


@query("label_scan", fx.SYMBOLS_SQL, "SELECT id, name, file_path FROM symbols WHERE kind = 'method' AND visibility = 'public'")
def label_scan(spark, sf_dir):
    return source_files.graph_rows(fx.symbols(spark, sf_dir), kind="method", visibility="public").select("id", "name", "file_path")


@query("edge_scan", fx.EDGES_SQL, "SELECT src, dst, rel_type FROM edges WHERE rel_type = 'references'")
def edge_scan(spark, sf_dir):
    """One relation of a written snapshot, whose folder alone is read."""
    folder = shared_folder(spark)
    store.write_snapshot(folder, edges=fx.edges(spark, sf_dir))
    return source_files.read_snapshot(spark, folder, "edges", "references").select("src", "dst", "rel_type")


def _vectors(spark, sf_dir):
    return T(spark, sf_dir, "embeddings").select(F.concat(F.lit("h"), F.col("vec_id").cast("string")).alias("hash"), F.array_size("embedding").alias("dims"), F.col("embedding").alias("vector"), F.col("vec_id").alias("at"), "label")


@query("embedding_cache_split", "SELECT 'h' || vec_id AS hash, CAST(len(embedding) + CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 0 END AS INT) AS dims, coalesce(vec_id % 5 <> 0 AND label % 3 <> 0 AND embedding IS NOT NULL, false) AS hit, CAST(CASE WHEN vec_id % 5 <> 0 AND label % 3 <> 0 THEN embedding[1] END AS DOUBLE) AS first FROM embeddings")
def embedding_cache_split(spark, sf_dir):
    """Which of all vectors a cache of some labels' holds; every fifth is asked for in other dimensions."""
    v = _vectors(spark, sf_dir)
    wanted = v.select("hash", (F.col("dims") + F.when(F.col("at") % 5 == 0, 1).otherwise(0)).alias("dims"))
    found = store.cache_split(wanted, v.where("label % 3 <> 0"))
    return found.select("hash", "dims", F.col("vector").isNotNull().alias("hit"), F.get("vector", F.lit(0)).cast("double").alias("first"))


@query("embedding_cache_prune", 'a AS (SELECT \'h\' || vec_id AS hash, vec_id AS "at" FROM embeddings UNION ALL SELECT \'h\' || vec_id, vec_id + 1000000 FROM embeddings WHERE label % 2 = 0)', 'SELECT hash, max("at") AS "at" FROM a GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 500')
def embedding_cache_prune(spark, sf_dir):
    """A cache's 500 latest entries after new ones came for some labels (the cap is the cache's)."""
    v = _vectors(spark, sf_dir).select("hash", "dims", "vector", "at", "label")
    new = v.where("label % 2 = 0").withColumn("at", F.col("at") + 1_000_000)
    return store.cache_put(v.drop("label"), new.drop("label"), 500).select("hash", "at")


@query(
    "merged_parse", fx.SYMBOLS_SQL,
    "o AS (SELECT file_path, min(seq) AS walk, CASE substr(file_path, length(file_path) - 3, 1) WHEN '1' THEN 'removed' WHEN '2' THEN 'changed' WHEN '3' THEN 'added' ELSE 'unchanged' END AS status FROM symbols GROUP BY 1)",
    "a AS (SELECT id, name, s.file_path, seq, walk FROM symbols s JOIN o USING (file_path) WHERE status = 'unchanged' UNION ALL SELECT 'n' || (seq % 500), 'new_' || name, s.file_path, seq, walk FROM symbols s JOIN o USING (file_path) WHERE status IN ('changed', 'added'))",
    "SELECT id, name, file_path, seq FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY walk, seq) AS r FROM a) WHERE r = 1",
)
def merged_parse(spark, sf_dir):
    """Fresh symbols of changed and added files, whose ids repeat, with the cached ones of the rest."""
    s = fx.symbols(spark, sf_dir).select("id", "name", "file_path", "seq")
    mark = F.substring("path", -4, 1)
    order = s.groupBy(F.col("file_path").alias("path")).agg(F.min("seq").alias("seq"))
    status = order.select("path", F.when(mark == "1", "removed").when(mark == "2", "changed").when(mark == "3", "added").otherwise("unchanged").alias("status"))
    fresh = s.select(F.concat(F.lit("n"), (F.col("seq") % 500).cast("string")).alias("id"), F.concat(F.lit("new_"), "name").alias("name"), "file_path", "seq")
    return store.merge_parsed(fresh, s, status, order).select("id", "name", "file_path", "seq")


@query("vectors_without_files", fx.SYMBOLS_SQL, "SELECT id FROM symbols WHERE file_path NOT LIKE 'src/services/%' UNION ALL SELECT 'ext:' || s_suppkey FROM supplier")
def vectors_without_files(spark, sf_dir):
    """Vectors of symbols and dependencies after those of a folder's files are deleted."""
    s = fx.symbols(spark, sf_dir)
    v = s.select("id").union(fx.dependencies(spark, sf_dir).select("id"))
    return store.delete_vectors(v, s, s.where("file_path like 'src/services/%'").select("file_path"))


@query("symbol_ordinals", fx.SYMBOLS_SQL, "SELECT id, CAST(row_number() OVER (PARTITION BY file_path, name, kind ORDER BY seq) - 1 AS INT) AS ordinal FROM symbols")
def symbol_ordinals(spark, sf_dir):
    return relate.ordinal(fx.symbols(spark, sf_dir), ["file_path", "name", "kind"], "seq").select("id", "ordinal")


@query("clusters_holding_any", fx.SYMBOLS_SQL, "SELECT brand AS cluster_id, count(*) AS n FROM symbols WHERE brand IN (SELECT brand FROM symbols WHERE cyclomatic >= 50 AND kind = 'class') GROUP BY 1")
def clusters_holding_any(spark, sf_dir):
    s = fx.symbols(spark, sf_dir)
    groups = s.groupBy(F.col("brand").alias("cluster_id")).agg(F.collect_list("id").alias("ids"))
    return relate.holding_any(groups, s.where("cyclomatic >= 50 and kind = 'class'")).select("cluster_id", F.array_size("ids").cast("long").alias("n"))


@query("watch_reindex", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS root, CASE WHEN event_id % 4 = 0 THEN 'node_modules/' ELSE 'src/' END || event_type || '.ts' AS path FROM events WHERE event_id % 4 <> 0 AND user_id IS NOT NULL")
def watch_reindex(spark, sf_dir):
    """Every change record of a stream reaches the re-index once a batch, ignored paths don't."""
    from codeloom.streaming.watch import change_events, watch

    folder = shared_folder(spark)
    path = F.concat(F.when(F.col("event_id") % 4 == 0, "node_modules/").otherwise("src/"), "event_type", F.lit(".ts"))
    T(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("root"), path.alias("path"), "ts").where("root is not null").write.json(f"{folder}/in")
    handled = f"{folder}/handled"
    watch(change_events(spark, f"{folder}/in"), lambda paths, n: paths.write.mode("overwrite").parquet(f"{handled}/batch={n}"), f"{folder}/state", None).awaitTermination()
    return spark.read.schema("root string, path string").option("recursiveFileLookup", True).parquet(handled).distinct()


@query("cluster_confidence", fx.SYMBOLS_SQL, "SELECT brand AS cluster_id, round(least(greatest((avg(cyclomatic - 25.0) / 4 + avg(CASE visibility WHEN 'public' THEN 1.0 ELSE 0.0 END)) / 2, 0), 1), 9)::DOUBLE AS confidence FROM symbols GROUP BY 1")
def cluster_confidence(spark, sf_dir):
    m = fx.symbols(spark, sf_dir).groupBy(F.col("brand").alias("cluster_id")).agg((F.avg(F.col("cyclomatic") - 25) / 4).alias("m"), F.avg((F.col("visibility") == "public").cast("int")).alias("c"))
    return m.select("cluster_id", F.round(cluster.confidence(F.col("m"), F.col("c")), 9).alias("confidence"))


@query("routes_in_file", fx.SYMBOLS_SQL, "r AS (SELECT file_path, count(*) AS n FROM symbols WHERE kind = 'function' AND cyclomatic > 25 GROUP BY 1)", "SELECT id AS consumer, file_path, CAST(coalesce(n, (SELECT sum(n) FROM r)) AS BIGINT) AS routes FROM symbols LEFT JOIN r USING (file_path) WHERE kind = 'class'")
def routes_in_file(spark, sf_dir):
    s = fx.symbols(spark, sf_dir)
    return relate.routes_in_file(s.where("kind = 'class'").select(F.col("id").alias("consumer"), "file_path"), s.where("kind = 'function' and cyclomatic > 25"))


@query("dependency_fan_out", fx.SYMBOLS_SQL, "f AS (SELECT file_path, count(*) AS n FROM symbols GROUP BY 1)", "i AS (SELECT DISTINCT file_path, 'ext:' || (seq % 5) AS package_id FROM symbols WHERE kind = 'interface')", "SELECT CAST(sum(n) AS BIGINT) AS edges, max(n) AS most FROM i JOIN f USING (file_path)")
def dependency_fan_out(spark, sf_dir):
    s = fx.symbols(spark, sf_dir)
    return relate.import_fan_out(s.where("kind = 'interface'").select("file_path", F.concat(F.lit("ext:"), (F.col("seq") % 5).cast("string")).alias("package_id")), s)


_SEEDS = "seeds AS (SELECT id FROM symbols)"


@query(
    "impact_groups", fx.SYMBOLS_SQL, fx.CALLS_SQL, fx.STEPS_SQL, _SEEDS, _reach_sql("calls", 20, True),
    "SELECT seed, 'cluster' AS kind, count(DISTINCT brand) AS n FROM reach JOIN symbols USING (id) GROUP BY 1 UNION ALL SELECT seed, 'process', count(DISTINCT process_id) FROM reach JOIN steps ON symbol_id = id GROUP BY 1",
)
def impact_groups(spark, sf_dir):
    """How many clusters and processes hold what a change of each symbol reaches."""
    reached = traverse.reach(fx.calls(spark, sf_dir), fx.symbols(spark, sf_dir), 20, "up")
    return relate.affected_groups(reached, fx.members(spark, sf_dir), fx.steps(spark, sf_dir)).groupBy("seed", "kind").agg(F.count("*").alias("n"))


@query(
    "precommit_report", fx.SYMBOLS_SQL, fx.CALLS_SQL, fx.STEPS_SQL, "seeds AS (SELECT id FROM symbols WHERE file_path IN (SELECT file_path FROM symbols WHERE brand IN ('Brand#3', 'Brand#7')))", _reach_sql("calls", 20, True),
    "hit AS (SELECT id FROM reach UNION SELECT id FROM seeds)",
    "SELECT (SELECT count(*) FROM seeds) AS changed, count(*) AS affected, CASE WHEN " + _CORE + " THEN 'critical' WHEN count(*) >= 11 THEN 'high' WHEN count(*) >= 3 THEN 'medium' ELSE 'low' END AS risk, "
    "(SELECT count(DISTINCT brand) FROM symbols WHERE id IN (SELECT id FROM hit)) AS clusters, (SELECT count(DISTINCT process_id) FROM steps WHERE symbol_id IN (SELECT id FROM hit)) AS processes FROM (SELECT DISTINCT id FROM reach WHERE id NOT IN (SELECT id FROM seeds)) r JOIN symbols s USING (id)",
)
def precommit_report(spark, sf_dir):
    from codeloom.plans.tools import pre_commit_report

    s = fx.symbols(spark, sf_dir)
    return pre_commit_report(s, fx.calls(spark, sf_dir), s.where("brand in ('Brand#3', 'Brand#7')").select("file_path"), fx.members(spark, sf_dir), fx.steps(spark, sf_dir))


@query("bare_types", fx.SYMBOLS_SQL, "SELECT id, name AS bare FROM symbols")
def bare_types(spark, sf_dir):
    """The own name of a type that stands alone, with a module, in a generic, or as an array."""
    n, k = F.col("name"), F.col("seq") % 4
    t = F.when(k == 0, n).when(k == 1, F.concat(F.lit("models.base."), n)).when(k == 2, F.concat(F.lit("Promise< models."), n, F.lit(" >"))).otherwise(F.concat(F.lit(" "), n, F.lit("[]")))
    return fx.symbols(spark, sf_dir).select("id", text.bare_type(t).alias("bare"))


@query("redacted_paths", fx.SYMBOLS_SQL, "SELECT id, CASE seq % 3 WHEN 0 THEN name || ' in [PATH]/' || file_path WHEN 1 THEN 'at:[PATH]/' || name ELSE file_path END AS redacted FROM symbols")
def redacted_paths(spark, sf_dir):
    k = F.col("seq") % 3
    t = F.when(k == 0, F.concat("name", F.lit(" in /home/"), "file_path")).when(k == 1, F.concat(F.lit("at:C:\\"), "name")).otherwise(F.col("file_path"))
    return fx.symbols(spark, sf_dir).select("id", text.redact_paths(t).alias("redacted"))


@query("embedding_texts", fx.SYMBOLS_SQL, "SELECT id, kind || ': ' || name || chr(10) || 'module: ' || regexp_replace(file_path, '/[^/]*$', '') || chr(10) || 'signature: ' || signature || chr(10) || 'visibility: ' || visibility || CASE WHEN seq % 2 = 0 THEN chr(10) || 'modifiers: static, async' ELSE '' END AS text FROM symbols")
def embedding_texts(spark, sf_dir):
    modifiers = F.when(F.col("seq") % 2 == 0, F.array(F.lit("static"), F.lit("async")))
    t = text.symbol_text(F.col("kind"), F.col("name"), F.col("file_path"), F.col("signature"), F.lit(""), F.col("visibility"), modifiers)
    return fx.symbols(spark, sf_dir).select("id", t.alias("text"))


@query(
    "json_strings", fx.SYMBOLS_SQL,
    "SELECT id, CASE seq % 5 WHEN 0 THEN name || ',x y' WHEN 1 THEN 'a' ELSE '' END AS keys FROM symbols",
)
def json_strings(spark, sf_dir):
    """Lists written as JSON: whole ones, ones with other values, other JSON, broken JSON and none."""
    k, n = F.col("seq") % 5, F.col("name")
    j = F.when(k == 0, F.concat(F.lit('["'), n, F.lit('", "x y"]'))).when(k == 1, '[1, "a", null, {"b": "c"}]').when(k == 2, F.concat(F.lit('{"a": "'), n, F.lit('"}'))).when(k == 3, F.concat(F.lit('["'), n))
    return fx.symbols(spark, sf_dir).select("id", F.array_join(graph.json_strings(j), ",").alias("keys"))


@query("plain_paths", fx.SYMBOLS_SQL, "SELECT id, CASE seq % 4 WHEN 0 THEN 'src/b/' || name WHEN 1 THEN '../' || name WHEN 2 THEN name ELSE file_path END AS path FROM symbols")
def plain_paths(spark, sf_dir):
    """Paths as imports write them, with dots, double dots and empty parts."""
    from codeloom.plans.index import plain_path

    k, n = F.col("seq") % 4, F.col("name")
    p = F.when(k == 0, F.concat(F.lit("src/./a/x/../../b//"), n)).when(k == 1, F.concat(F.lit("a/../../"), n)).when(k == 2, F.concat(F.lit("a/b/c/../../../"), n)).otherwise(F.col("file_path"))
    return fx.symbols(spark, sf_dir).select("id", plain_path(p).alias("path"))


@query(
    "shape_drift_union", fx.SYMBOLS_SQL,
    "routes AS (SELECT file_path, 'k' || (seq % 7) AS key FROM symbols WHERE kind = 'function' AND cyclomatic > 25)", "reads AS (SELECT id, name, file_path, unnest(['k' || (seq % 7), 'k' || (seq % 13)]) AS key FROM symbols WHERE kind = 'class')",
    "SELECT DISTINCT id AS consumer, name, file_path, key, CASE WHEN coalesce(nullif((SELECT count(*) FROM routes r WHERE r.file_path = d.file_path), 0), (SELECT count(*) FROM routes)) > 1 THEN 'low' ELSE 'high' END AS confidence FROM reads d WHERE key NOT IN (SELECT key FROM routes) AND EXISTS (SELECT 1 FROM routes)",
)
def shape_drift_union(spark, sf_dir):
    s, key = fx.symbols(spark, sf_dir), lambda n: F.concat(F.lit("k"), (F.col("seq") % n).cast("string"))
    routes = s.where("kind = 'function' and cyclomatic > 25").select("file_path", F.array(key(7)).alias("keys"))
    consumers = s.where("kind = 'class'").select(F.col("id").alias("consumer"), "name", "file_path", F.array(key(7), key(13)).alias("keys"))
    return relate.union_drift(routes, consumers)


@query(
    "precommit_edges", fx.SYMBOLS_SQL, fx.CALLS_SQL, "seeds AS (SELECT id FROM symbols WHERE brand = 'Brand#3')", _reach_sql("calls", 20, True),
    "SELECT src, dst, 'calls' AS rel_type FROM (SELECT DISTINCT id AS src FROM reach WHERE id NOT IN (SELECT id FROM seeds)) CROSS JOIN (SELECT id AS dst FROM seeds) ORDER BY src, dst LIMIT 100",
)
def precommit_edges(spark, sf_dir):
    """What a change of a brand's files reaches, with what changed: an answer's first 100 relations."""
    from codeloom.plans.tools import pre_commit_edges

    s = fx.symbols(spark, sf_dir)
    return pre_commit_edges(s.where("brand = 'Brand#3'").unionByName(s.where("brand <> 'Brand#3'").withColumn("file_path", F.lit("other"))), fx.calls(spark, sf_dir), s.where("brand = 'Brand#3'").select("file_path"))


_DEPENDS = "uses AS (SELECT DISTINCT s.id, 'ext:' || l_suppkey AS dst FROM lineitem JOIN symbols s ON s.id = 'p' || l_partkey WHERE l_linenumber = 1)"


@query(
    "impact_dependency", fx.SYMBOLS_SQL, _DEPENDS, "hit AS (SELECT 'ext:' || s_suppkey AS dst FROM supplier WHERE contains(lower(s_name), 'supplier000000007') OR contains(lower(replace(s_name, '#', '')), 'supplier000000007') ORDER BY length(s_name), 1 LIMIT 1)",
    "found AS (SELECT u.id, name FROM uses u JOIN hit USING (dst) JOIN symbols s ON s.id = u.id)",
    "SELECT id, name, 1 AS depth, 'dependsOn' AS rel_type, CASE WHEN (SELECT " + _CORE + " FROM found s) THEN 'critical' WHEN (SELECT count(*) FROM found) >= 11 THEN 'high' WHEN (SELECT count(*) FROM found) >= 3 THEN 'medium' ELSE 'low' END AS risk FROM found",
)
def impact_dependency(spark, sf_dir):
    """Who is affected by a package that one of its aliases names, no symbol having that name."""
    from codeloom.plans.tools import Engine

    s = fx.symbols(spark, sf_dir)
    x = T(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("ext:"), F.col("l_suppkey").cast("string")).alias("dst"), F.lit("dependsOn").alias("rel_type"))
    e = Engine(s, fx.calls(spark, sf_dir).unionByName(x), fx.members(spark, sf_dir), dependencies=fx.dependencies(spark, sf_dir))
    return e.call("impact_analysis", target="supplier000000007").select("id", "name", "depth", "rel_type", "risk")


#: Parts of a brand as a hierarchy: the parent of the n-th is the n/2-th; a class has one method, of three names and two counts of parameters.
_TREE = """
own AS (SELECT id, brand, row_number() OVER (PARTITION BY brand ORDER BY seq) AS n, 'm' || (seq % 3) AS name, CAST(seq % 2 AS INT) AS params, seq FROM symbols),
up AS (SELECT a.id AS class, b.id AS ancestor, b.n, b.brand, 0 AS position FROM own a JOIN own b ON b.brand = a.brand AND b.n = a.n // 2 UNION ALL SELECT class, b.id, b.n, b.brand, position + 1 FROM up JOIN own b ON b.brand = up.brand AND b.n = up.n // 2)"""


def _tree(spark, sf_dir):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("brand").orderBy("seq"))
    own = fx.symbols(spark, sf_dir).select("id", "brand", "seq", n.alias("n"), F.concat(F.lit("m"), (F.col("seq") % 3).cast("string")).alias("name"), (F.col("seq") % 2).cast("int").alias("params"))
    above = own.select("brand", F.col("n").alias("half"), F.col("id").alias("parent"))
    heritage = own.withColumn("half", F.expr("n div 2")).join(by_key(above), ["brand", "half"]).select(F.col("id").alias("child"), "parent", F.lit(0).alias("seq"))
    methods = own.select(F.concat("id", F.lit("."), "name").alias("id"), F.col("id").alias("owner"), "name", "params", F.lit(False).alias("abstract"), F.lit("class").alias("owner_kind"))
    return own, heritage, methods


@query("mro_of_trees", fx.SYMBOLS_SQL, _TREE, "SELECT class, position, ancestor, true AS consistent FROM up")
def mro_of_trees(spark, sf_dir):
    return mro.linearise(_tree(spark, sf_dir)[1])


@query("overrides_of_trees", fx.SYMBOLS_SQL, _TREE, "SELECT src, dst, 'overrides' AS rel_type FROM (SELECT a.id || '.' || a.name AS src, b.id || '.' || b.name AS dst, row_number() OVER (PARTITION BY a.id ORDER BY position) AS r FROM own a JOIN up ON class = a.id JOIN own b ON b.id = ancestor AND b.name = a.name AND b.params = a.params) WHERE r = 1")
def overrides_of_trees(spark, sf_dir):
    _, heritage, methods = _tree(spark, sf_dir)
    return mro.overrides(mro.linearise(heritage), methods)


@query(
    "member_calls_of_trees", fx.SYMBOLS_SQL, _TREE,
    "SELECT call_id, id FROM (SELECT a.seq AS call_id, b.id || '.' || b.name AS id, row_number() OVER (PARTITION BY a.seq ORDER BY position) AS r FROM own a JOIN (SELECT id AS class, id AS ancestor, -1 AS position FROM own UNION ALL SELECT class, ancestor, position FROM up) u ON u.class = a.id JOIN own b ON b.id = u.ancestor AND b.name = 'm' || (a.seq * 5 % 3)) WHERE r = 1",
)
def member_calls_of_trees(spark, sf_dir):
    own, heritage, methods = _tree(spark, sf_dir)
    asked = own.select(F.col("seq").alias("call_id"), F.col("id").alias("receiver_class"), F.concat(F.lit("m"), (F.col("seq") * 5 % 3).cast("string")).alias("name"))
    return mro.member_calls(asked, mro.linearise(heritage), methods)

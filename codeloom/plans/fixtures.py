"""The driver's tables seen as a code graph, as DataFrames and as DuckDB SQL.

part is the symbols, pairs of parts in an order are calls, brands are clusters, a
conversation's turns are the steps of a process, suppliers are external dependencies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DIRS = ("controllers", "services", "repositories", "models", "routes", "lib")
_KINDS = {"STANDARD": "function", "ECONOMY": "method", "MEDIUM": "class", "PROMO": "interface", "LARGE": "variable"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    a, b = (F.split("p_name", " ")[i] for i in (0, 1))
    cap = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 100))
    key = F.col("p_partkey")
    name = F.when(key % 7 == 0, F.concat(F.lit("handle"), cap(a), cap(b))).when(key % 7 == 1, F.concat(F.lit("get"), cap(a), cap(b))).when(key % 7 == 2, F.concat(cap(a), cap(b), F.lit("Service"))).when(key % 7 == 3, F.concat(a, F.lit("_auth_"), b)).otherwise(F.concat(a, cap(b)))
    kind = F.when(F.lit(False), F.lit(None))
    for k, v in _KINDS.items():
        kind = kind.when(F.col("p_type") == k, v)
    folder = F.array(*map(F.lit, _DIRS))[(key % 6).cast("int")]
    size = F.col("p_size")
    rows = p.select(
        F.concat(F.lit("p"), key.cast("string")).alias("id"),
        name.alias("name"),
        kind.otherwise("export").alias("kind"),
        F.concat(F.lit("src/"), folder, F.lit("/"), F.lower(F.regexp_replace("p_brand", "#", "_")), F.lit(".ts")).alias("file_path"),
        (size * 10).cast("int").alias("start_line"),
        (size * 10 + key % 40).cast("int").alias("end_line"),
        size.cast("int").alias("cyclomatic"),
        (size * 2 % 37).cast("int").alias("cognitive"),
        (key % 4).cast("int").alias("max_loop_depth"),
        F.when(key % 3 == 0, "public").when(key % 3 == 1, "private").otherwise("protected").alias("visibility"),
        key.alias("seq"),
        F.col("p_brand").alias("brand"),
    )
    return rows.withColumn("signature", F.concat(F.lit("("), F.col("name"), F.lit("): "), F.col("kind")))


def calls(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    x = x.where("l_returnflag = 'R'") if dense else x.where("l_quantity >= 45")
    one = lambda c, n: x.select(F.col("l_orderkey"), F.col("l_linenumber").alias(n), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias(c))
    pairs = one("src", "i").join(one("dst", "j"), "l_orderkey").where("i < j and src <> dst")
    return pairs.select("src", "dst", F.lit("calls").alias("rel_type")).distinct()


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse calls, and references: dense calls by even orders' flag."""
    return calls(spark, sf_dir).unionByName(calls(spark, sf_dir, dense=True).withColumn("rel_type", F.lit("references")))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols(spark, sf_dir).select(F.col("brand").alias("cluster_id"), "id", "seq")


def parts(spark: SparkSession, sf_dir: str) -> int:
    """The number of parts, whose keys count from 0."""
    return table(spark, sf_dir, "part").count()


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events in order; an event's symbol is by its id."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.concat(F.lit("flow"), F.col("user_id").cast("string")).alias("process_id"), n.cast("int").alias("step_order"), F.concat(F.lit("p"), (F.col("event_id") * 7 % parts(spark, sf_dir)).cast("string")).alias("symbol_id"))


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    bare = F.regexp_replace("s_name", "[#]", "")
    return s.select(F.concat(F.lit("ext:"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"), F.array("s_name", bare, F.lower(bare)).alias("aliases"), F.lit("npm").alias("ecosystem"))


def hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item is a hunk of its part's file; some files are deleted, some have no hunk."""
    x = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("id"), F.col("l_partkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("int").alias("q"))
    f = symbols(spark, sf_dir).select("id", F.col("file_path").alias("path"))
    status = F.when(F.col("k") % 97 == 0, "deleted").otherwise("modified")
    return x.join(f, "id").select("path", F.lit(None).cast("string").alias("old_path"), status.alias("status"), F.when(F.col("k") % 89 != 0, F.col("q") * 10).alias("hunk_start"), (F.col("n") % 4).cast("int").alias("hunk_lines"))


SYMBOLS_SQL = """
symbols AS (SELECT *, '(' || name || '): ' || kind AS signature FROM (
  SELECT 'p' || p_partkey AS id,
    CASE p_partkey % 7 WHEN 0 THEN 'handle' || cap_a || cap_b WHEN 1 THEN 'get' || cap_a || cap_b WHEN 2 THEN cap_a || cap_b || 'Service'
      WHEN 3 THEN a || '_auth_' || b ELSE a || cap_b END AS name,
    CASE p_type WHEN 'STANDARD' THEN 'function' WHEN 'ECONOMY' THEN 'method' WHEN 'MEDIUM' THEN 'class' WHEN 'PROMO' THEN 'interface' WHEN 'LARGE' THEN 'variable' ELSE 'export' END AS kind,
    'src/' || CASE p_partkey % 6 WHEN 0 THEN 'controllers' WHEN 1 THEN 'services' WHEN 2 THEN 'repositories' WHEN 3 THEN 'models' WHEN 4 THEN 'routes' ELSE 'lib' END
      || '/' || lower(replace(p_brand, '#', '_')) || '.ts' AS file_path,
    CAST(p_size * 10 AS INT) AS start_line, CAST(p_size * 10 + p_partkey % 40 AS INT) AS end_line,
    CAST(p_size AS INT) AS cyclomatic, CAST(p_size * 2 % 37 AS INT) AS cognitive, CAST(p_partkey % 4 AS INT) AS max_loop_depth,
    CASE p_partkey % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'private' ELSE 'protected' END AS visibility, p_partkey AS seq, p_brand AS brand
  FROM (SELECT *, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b,
      upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2) AS cap_a,
      upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) AS cap_b FROM part)))"""


def _calls_sql(name: str, where: str, rel: str = "calls") -> str:
    return f"""
{name} AS (SELECT DISTINCT 'p' || a.l_partkey AS src, 'p' || b.l_partkey AS dst, '{rel}' AS rel_type
  FROM (SELECT * FROM lineitem WHERE {where}) a JOIN (SELECT * FROM lineitem WHERE {where}) b ON a.l_orderkey = b.l_orderkey
  WHERE a.l_linenumber < b.l_linenumber AND a.l_partkey <> b.l_partkey)"""


CALLS_SQL = _calls_sql("calls", "l_quantity >= 45")
DENSE_SQL = _calls_sql("dense", "l_returnflag = 'R'")
EDGES_SQL = CALLS_SQL + "," + _calls_sql("refs", "l_returnflag = 'R'", "references") + ",\nedges AS (SELECT * FROM calls UNION ALL SELECT * FROM refs)"
STEPS_SQL = """
steps AS (SELECT 'flow' || user_id AS process_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS step_order,
  'p' || (event_id * 7 % (SELECT count(*) FROM part)) AS symbol_id FROM events)"""
HUNKS_SQL = """
hunks AS (SELECT s.file_path AS path, CASE WHEN l_partkey % 97 = 0 THEN 'deleted' ELSE 'modified' END AS status,
  CASE WHEN l_partkey % 89 <> 0 THEN CAST(l_quantity AS INT) * 10 END AS hunk_start, CAST(l_linenumber % 4 AS INT) AS hunk_lines
  FROM lineitem JOIN symbols s ON s.id = 'p' || l_partkey)"""


def sql(*parts: str) -> str:
    """WITH of the views, and the query, which comes last."""
    return "WITH RECURSIVE " + ",".join(parts[:-1]) + "\n" + parts[-1]

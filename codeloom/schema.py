"""Schemas of the property graph, and the checks that every graph must pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = (
    "id string, logical_key string, name string, kind string, file_path string, start_line int, start_column int, end_line int, end_column int, "
    "signature string, documentation string, visibility string, modifiers array<string>, return_type string, parameter_count int, owner_id string, "
    "cyclomatic int, cognitive int, max_loop_depth int, response_keys array<string>, accessed_keys array<string>, seq long"
)
EDGES = "src string, dst string, rel_type string, step_order int, metadata map<string,string>"
HINTS = "kind string, source_file string, target_name string, child_id string, start_line int, language string, receiver string, enclosing_id string, seq long"
CLUSTERS = "id string, name string, confidence double, category string"
MEMBERS = "cluster_id string, symbol_id string"
PROCESSES = "id string, name string, entry_point string"
STEPS = "process_id string, step_order int, symbol_id string"
DEPENDENCIES = "id string, name string, aliases array<string>, ecosystem string"
FILES = "path string, size long, language string, mtime timestamp"
CACHED_FILES = "path string, content_hash string, mtime_ms long, parse_version int"
EMBEDDINGS = "symbol_id string, embedding array<double>, dimensions int, file_path string"


def violations(symbols: DataFrame, members: DataFrame, steps: DataFrame) -> DataFrame:
    """rule, n: ids given twice, ends before starts, clusters of one, steps with gaps; no rows if all hold."""
    twice = symbols.groupBy("id").count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("unique_id").alias("rule"), "n")
    spans = symbols.where("end_line < start_line").agg(F.count("*").alias("n")).select(F.lit("line_order").alias("rule"), "n")
    lone = members.groupBy("cluster_id").agg(F.count_distinct("symbol_id").alias("c")).where("c < 2").agg(F.count("*").alias("n")).select(F.lit("cluster_size").alias("rule"), "n")
    gaps = steps.groupBy("process_id").agg(F.count("*").alias("c"), F.min("step_order").alias("a"), F.max("step_order").alias("b")).where("a <> 0 or b <> c - 1").agg(F.count("*").alias("n")).select(F.lit("step_gaps").alias("rule"), "n")
    return twice.union(spans).union(lone).union(gaps).where("n > 0")


def conform(df: DataFrame, schema: str) -> DataFrame:
    """The schema's columns in order: missing ones null, others left out, types cast."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema).fields
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])

"""From a source tree to a snapshot of the graph, whole or by what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom import schema
from codeloom.functions import graph, packages, text
from codeloom.operators import cluster, flows, relate, search, store
from codeloom.session import cut
from codeloom.sources import extract, files, frameworks

PARSE_VERSION = 2
#: Languages whose imports name folders, all files of which they mean.
BY_FOLDER = ("csharp", "go", "swift", "java")


def plain_path(path: Column) -> Column:
    """A path without empty and single-dot parts, each double dot taking the part before it; those above the root stay."""
    none = F.array().cast("array<string>")
    last = F.try_element_at

    def step(done: Column, part: Column) -> Column:
        back = (part == "..") & (F.size(done) > 0) & (F.coalesce(last(done, F.lit(-1)), F.lit("..")) != "..")
        return F.when(part.isin("", "."), done).when(back, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, part))

    return F.array_join(F.aggregate(F.split(path, "/"), none, step), "/")


def import_edges(symbols: DataFrame, hints: DataFrame, aliases: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(imports of files by files, dependsOn edges, packages) of import hints.

    Aliases come before the test for packages.  A path names the file that it is, with or
    without an ending, or that a folder's index is; relative paths start at their file.
    """
    h = hints.where("kind = 'import'").select("source_file", F.col("target_name").alias("path"), "language", "seq")
    if aliases is not None:
        dotted = F.when(F.col("language") == "csharp", F.regexp_replace("path", r"\.", "/")).otherwise(F.regexp_replace("path", r"\\", "/"))
        h = h.withColumn("key", dotted)
        h = h.join(relate.longest_prefix(h.select(F.col("key").alias("path")), aliases).select(F.col("path").alias("key"), "resolved"), "key", "left").drop("key")
    else:
        h = h.withColumn("resolved", F.lit(None).cast("string"))
    dir_ = F.regexp_replace("source_file", "[^/]*$", "")
    dots = F.length(F.regexp_extract("path", r"^(\.*)", 1))
    python = (F.col("language") == "python") & (dots > 0)
    up = F.array_join(F.slice(F.split(F.regexp_replace(dir_, "/$", ""), "/"), 1, F.greatest(F.size(F.split(F.regexp_replace(dir_, "/$", ""), "/")) - F.greatest(dots - 1, F.lit(0)), F.lit(0))), "/")
    relative = F.when(python, F.concat_ws("/", F.nullif(up, F.lit("")), F.regexp_replace(F.regexp_replace("path", r"^\.+", ""), r"\.", "/"))).when(F.col("path").startswith("."), F.concat(dir_, F.col("path")))
    plain = F.when(F.col("language").isin("python", "java", "csharp"), F.regexp_replace("path", r"\.", "/")).otherwise(F.regexp_replace("path", r"\\|::", "/"))
    wanted = F.coalesce("resolved", relative, plain)
    wanted = F.regexp_replace(plain_path(wanted), r"\.(ts|tsx|js|jsx|mjs|cjs|py|php|java|go|rs|c|h|cpp|cc|cxx|hpp|cs|rb|swift)$", "")
    h = h.withColumn("wanted", wanted)
    known = symbols.select("file_path").distinct()
    bare = F.regexp_replace("file_path", r"\.[^./]+$", "")
    keys = known.select("file_path", F.explode(F.array_distinct(F.array(bare, F.regexp_replace(bare, "/(index|__init__)$", ""), F.regexp_replace(bare, "^src/", "")))).alias("wanted"))
    hit = relate.first_by(h.select("source_file", "wanted").distinct().join(keys, "wanted"), ["source_file", "wanted"], F.length("file_path"), F.col("file_path"))
    found = hit.select(F.col("source_file").alias("file_path"), F.col("file_path").alias("imported_file"), "wanted")
    inside = known.select("file_path", F.regexp_replace("file_path", "/?[^/]*$", "").alias("wanted"), graph.language(F.col("file_path")).alias("language")).where(F.col("language").isin(*BY_FOLDER))
    asked = h.where(F.col("language").isin(*BY_FOLDER)).select("source_file", "wanted", "language").distinct()
    packed = asked.join(inside, ["wanted", "language"]).select(F.col("source_file").alias("f"), F.col("file_path").alias("imported_file"), "wanted").withColumnRenamed("f", "file_path")
    found = found.unionByName(packed).where("file_path <> imported_file")
    left = h.join(found.select(F.col("file_path").alias("source_file"), "wanted"), ["source_file", "wanted"], "left_anti").where(F.col("resolved").isNull() & packages.is_external(F.col("path"), F.col("language")))
    name = packages.package_name(F.col("path"), F.col("language"))
    left = left.select("source_file", "language", "seq", name.alias("name")).withColumn("id", F.concat(F.lit("ext:"), "name"))
    deps = relate.first_by(left, ["id"], F.col("source_file"), F.col("seq")).select("id", "name", packages.aliases(F.col("name")).alias("aliases"), packages.ecosystem(F.col("language")).alias("ecosystem"))
    depends = relate.imported_symbols(left.select(F.col("source_file").alias("file_path"), F.col("id").alias("package_id")), symbols)
    return found.select("file_path", "imported_file").distinct(), depends, deps


def heritage_edges(symbols: DataFrame, hints: DataFrame) -> DataFrame:
    """inherits and implements between classes and interfaces."""
    types = symbols.where("kind in ('class', 'interface')").select("id", "name", "file_path", "seq")
    h = hints.where("kind in ('inherits', 'implements')").select(F.concat_ws(":", "source_file", "seq").alias("ref_id"), F.col("source_file").alias("file_path"), F.col("enclosing_id").alias("child"), text.bare_type(F.col("target_name")).alias("parent"), "kind")
    found = relate.heritage(h.select("ref_id", "file_path", "child", "parent"), types)
    return found.join(h.select("ref_id", "kind"), "ref_id").select(F.col("child_id").alias("src"), F.col("parent_id").alias("dst"), F.col("kind").alias("rel_type")).distinct()


def with_accessed_keys(symbols: DataFrame, hints: DataFrame) -> DataFrame:
    """Symbols with the keys that the smallest function or method around each access reads."""
    h = hints.where("kind = 'access'").withColumn("ref", F.concat_ws(":", "source_file", "seq"))
    at = relate.covering(h.select(F.col("ref").alias("point_id"), F.col("source_file").alias("file_path"), F.col("start_line").alias("line")), symbols.where("kind in ('function', 'method')"), "enclosing")
    read = h.select("ref", "target_name", "seq").join(at.select(F.col("point_id").alias("ref"), F.col("id").alias("child_id")), "ref")
    keys = relate.accessed_keys(read, symbols)
    return symbols.drop("accessed_keys").join(keys, "id").select(*symbols.columns)


def build(symbols: DataFrame, hints: DataFrame, aliases: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of a graph from symbols and hints: edges, clusters, members, processes, steps, dependencies, keywords, texts."""
    symbols, hints = cut(symbols), cut(hints)
    symbols = cut(with_accessed_keys(symbols, hints))
    imports, depends, deps = import_edges(symbols, hints, aliases)
    calls = extract.call_edges(symbols, hints, imports).select("src", "dst", "rel_type")
    owned = symbols.where("owner_id is not null").select(F.col("owner_id").alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("rel_type"))
    first = relate.first_by(symbols.select("id", "file_path", "seq"), ["file_path"], F.col("seq")).drop("seq")
    by_file = imports.join(first.withColumnRenamed("id", "src"), "file_path").join(first.select(F.col("file_path").alias("imported_file"), F.col("id").alias("dst")), "imported_file").select("src", "dst", F.lit("imports").alias("rel_type"))
    edges = cut(calls.unionByName(heritage_edges(symbols, hints)).unionByName(owned).unionByName(by_file).unionByName(depends).distinct())

    order = symbols.select("id", F.row_number().over(Window.orderBy("file_path", "seq")).alias("seq"))
    pairs = cut(cluster.cluster_graph(symbols, edges))
    found = cut(cluster.louvain(pairs, order))
    members = found.select(F.col("community").alias("cluster_id"), "id").join(order, "id")
    heads = found.groupBy(F.col("community").alias("cluster_id")).agg(F.max("modularity").alias("m")).join(cluster.cohesion(members, pairs), "cluster_id").join(cluster.labels(members, symbols), "cluster_id").join(cluster.categories(members, symbols), "cluster_id")
    clusters = heads.select(F.col("cluster_id").alias("id"), F.col("label").alias("name"), cluster.confidence(F.col("m"), F.col("cohesion")).alias("confidence"), "category")

    only = edges.where("rel_type = 'calls'")
    starts = cut(flows.entry_points(symbols.drop("seq").join(order, "id"), only))
    traces = flows.distinct_traces(flows.flow_traces(starts, only.join(order.withColumnRenamed("id", "dst"), "dst")), starts)
    processes, steps = flows.processes(cut(traces), symbols)
    words = symbols.select("id", text.symbol_text(F.col("kind"), F.col("name"), F.col("file_path"), F.col("signature"), F.col("documentation"), F.col("visibility"), F.col("modifiers")).alias("text"), text.keywords(F.col("name"), F.col("signature")).alias("words"), "file_path")
    vectors = search.safe_embedding_text(words, "text").select(F.col("id").alias("symbol_id"), search.hash_embedding(F.col("words")).alias("embedding"), F.lit(64).alias("dimensions"), "file_path")
    return {"symbols": symbols, "hints": hints, "edges": edges, "clusters": clusters, "members": members, "processes": processes, "steps": steps, "dependencies": deps, "keywords": search.keyword_index(symbols), "embeddings": vectors}


def index_tree(spark: SparkSession, root: str, folder: str, old: str | None = None) -> DataFrame:
    """Index the tree at ``root`` into the snapshot ``folder`` and return (path, status) of its files.

    With ``old``, an earlier snapshot, only new and changed files are parsed; the outcome is
    the same as of a whole run (T4-T6).
    """
    found = cut(files.walk(spark, root, with_content=True).withColumn("mtime_ms", F.unix_millis("mtime")))
    if old is None:
        status = found.select("path", F.lit("added").alias("status"))
        symbols, hints = extract.symbols_and_hints(cut(extract.extract(found)))
        declared = frameworks.scan(found)
    else:
        status = cut(store.classify_files(spark.read.parquet(f"{old}/files"), found, PARSE_VERSION))
        fresh = found.join(status.where("status in ('added', 'changed')"), "path", "left_semi")
        symbols, hints = extract.symbols_and_hints(cut(extract.extract(fresh)))
        keep = status.where("status = 'unchanged'").select("path")
        before = lambda name, key: spark.read.parquet(f"{old}/{name}").join(keep.withColumnRenamed("path", key), key, "left_semi")
        symbols = schema.conform(before("symbols", "file_path"), schema.SYMBOLS).unionByName(symbols)
        hints = schema.conform(before("hints", "source_file"), schema.HINTS).unionByName(hints)
        declared = before("declared", "path").select("path", "framework", "what", "method", "name", "line").unionByName(frameworks.scan(fresh))
    tables = build(symbols, hints, files.configured_aliases(spark, root, found)) | {"declared": declared}
    store.write_snapshot(folder, files=found.select("path", "content_hash", "mtime_ms", F.lit(PARSE_VERSION).alias("parse_version")), **tables)
    return status


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    names = ("symbols", "edges", "clusters", "members", "processes", "steps", "dependencies", "keywords", "embeddings", "declared")
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def embed(spark: SparkSession, sentence: str) -> list[float]:
    """The vector of a sentence, made as those of symbols are."""
    return spark.range(1).select(search.hash_embedding(text.keywords(F.lit(sentence), F.lit(sentence))).alias("v")).first().v



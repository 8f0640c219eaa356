"""Source trees as tables, and the configuration beside them."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions import fixed, graph


_TSCONFIGS = ("tsconfig.json", "tsconfig.app.json", "tsconfig.base.json")


def walk(spark: SparkSession, root: str, with_content: bool = False) -> DataFrame:
    """(path, size, language, mtime[, content, content_hash]) of the source files below ``root``.

    Spark lists the tree; paths are relative; ignored, unknown and too large files go
    before their content is read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    base = F.lit(re.sub(r"^\w+:/*", "/", root).rstrip("/") + "/")
    # the listing's prefix may be file:/ or file:///
    path = F.expr("substring(p, instr(p, b) + length(b))")
    rows = reader.load(root).where(F.col("length") <= fixed.MAX_FILE_BYTES).withColumn("p", F.url_decode(F.regexp_replace("path", r"\+", "%2B"))).withColumn("b", base).withColumn("rel", path)
    rows = rows.withColumn("language", graph.language(F.col("rel"))).where(F.col("language").isNotNull() & ~graph.is_ignored(F.col("rel")))
    columns = [F.col("rel").alias("path"), F.col("length").alias("size"), "language", F.col("modificationTime").alias("mtime")]
    if with_content:
        columns += [F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("content_hash")]
    return rows.select(*columns)


def folder_languages(files: DataFrame, depth: int = 3) -> DataFrame:
    """(folder, language): the commonest language of each folder down to a depth; ties to the one seen first (S3)."""
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.least(F.size(parts) - 1, F.lit(depth))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    n = files.select(F.explode(folders).alias("folder"), "language", "path").groupBy("folder", "language").agg(F.count("*").alias("n"), F.min("path").alias("first"))
    w = Window.partitionBy("folder").orderBy(F.desc("n"), "first")
    return n.withColumn("r", F.row_number().over(w)).where("r = 1").select("folder", "language")


def import_aliases(contents: dict[str, str]) -> list[tuple[str, str, int]]:
    """(prefix, target, ord) from configuration files by name: tsconfig paths, composer psr-4, go.mod modules, roots of csproj.

    Broken files give none.  A tsconfig of another name counts if those before it gave no
    paths; of two targets of a psr-4 prefix the one for development counts.
    """
    out: list[tuple[str, str]] = []
    paths_of: set[str] = set()  # folders whose tsconfig gave paths
    order = lambda x: (x[0].rpartition("/")[0], _TSCONFIGS.index(x[0].rpartition("/")[2]) if x[0].rpartition("/")[2] in _TSCONFIGS else -1, x[0])
    for name, body in sorted(contents.items(), key=order):
        folder, _, own = name.rpartition("/")
        try:
            if own in _TSCONFIGS:
                if folder in paths_of:
                    continue
                options = json.loads(re.sub(r"^\s*//.*$|/\*.*?\*/(?=\s*$)", "", body, flags=re.M)).get("compilerOptions", {})
                base = options.get("baseUrl", ".").strip("./")
                for key, targets in options.get("paths", {}).items():
                    if targets:
                        paths_of.add(folder)
                        target = "/".join(x for x in (base, targets[0].removeprefix("./").removesuffix("*").rstrip("/")) if x)
                        out.append((key.removesuffix("*"), target + "/" if key.endswith("*") else target))
            elif own == "composer.json":
                whole = json.loads(body)
                psr4 = whole.get("autoload", {}).get("psr-4", {}) | whole.get("autoload-dev", {}).get("psr-4", {})
                for key, target in psr4.items():
                    out.append((key.replace("\\", "/"), target if isinstance(target, str) else target[0]))
            elif own.endswith(".csproj"):
                m = re.search(r"<RootNamespace>([^<]+)</RootNamespace>", body)
                space = (m[1].strip() if m else own.removesuffix(".csproj")).replace(".", "/")
                out += [(space + "/", folder + "/" if folder else ""), (space, folder)]
            elif own == "go.mod" and (m := re.search(r"^module\s+(\S+)", body, re.M)):
                out.append((m[1] + "/", ""))
        except (ValueError, AttributeError, IndexError):
            continue
    return [(p, t, i) for i, (p, t) in enumerate(out)]


def configured_aliases(spark: SparkSession, root: str, found: DataFrame) -> DataFrame:
    """(prefix, target, ord) of the tree at ``root`` whose source files are ``found``.

    tsconfig, composer and go.mod count at the root, projects of C# anywhere; modules of
    Swift are the folders below its source folders.  Only configuration files come to the driver.
    """
    base = re.sub(r"^\w+:/*", "/", root).rstrip("/") + "/"
    reader = lambda glob: spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    rows = reader("{" + ",".join((*_TSCONFIGS, "composer.json", "go.mod", "*.csproj")) + "}").where(F.col("length") <= fixed.MAX_FILE_BYTES)
    contents = {}
    for r in rows.select(F.url_decode(F.regexp_replace("path", r"\+", "%2B")).alias("path"), F.decode("content", "UTF-8").alias("body")).toLocalIterator():
        name = r.path[r.path.index(base) + len(base) :]
        if ("/" not in name or name.endswith(".csproj")) and not re.search(r"(^|/)(node_modules|\.git|bin|obj)/", name):
            contents[name] = r.body
    plain = spark.createDataFrame(import_aliases(contents), "prefix string, target string, ord int")
    folder = F.regexp_extract("path", r"^((?:Package/)?Sources|src)/([^/]+)/", 0)
    swift = found.where("language = 'swift'").select(folder.alias("target")).where("target <> ''").distinct()
    modules = swift.select(F.regexp_extract("target", r"([^/]+)/$", 1).alias("prefix"), F.regexp_replace("target", "/$", "").alias("target"), F.lit(2**30).alias("ord"))
    return plain.unionByName(modules)


def graph_rows(nodes: DataFrame, **equal: str) -> DataFrame:
    """Rows where all the columns equal the values."""
    for k, v in equal.items():
        nodes = nodes.where(F.col(k) == v)
    return nodes


def read_snapshot(spark: SparkSession, folder: str, name: str, rel_type: str | None = None) -> DataFrame:
    """A table of a snapshot; one relation of the edges reads only that relation's folder."""
    df = spark.read.parquet(f"{folder}/{name}")
    return df if rel_type is None else df.where(F.col("rel_type") == rel_type)


def pages(rows: DataFrame, keys: list[str], size: int):
    """Pages of rows in the order of unique keys, each by the last key of the one before, not by offset."""
    last = None
    while True:
        part = rows if last is None else rows.where(F.struct(*keys) > F.struct(*[F.lit(x) for x in last]))
        page = part.orderBy(*keys).limit(size).collect()
        if not page:
            return
        yield page
        last = [page[-1][k] for k in keys]

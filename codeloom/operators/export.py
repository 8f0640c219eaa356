"""Export of the graph as Markdown: sections, indexes, process diagrams, files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text


def vault_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]+$", ".md")


def symbol_sections(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """(id, path, section, seq): a Markdown section per symbol, with its number of callers."""
    n = calls.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers"))
    rows = symbols.join(n, "id", "left").na.fill(0, ["callers"])
    line = lambda label, x: F.concat(F.lit(f"- {label}: "), x.cast("string"))
    section = F.concat_ws("\n", F.concat(F.lit("## "), "name"), line("kind", F.col("kind")), line("lines", F.concat_ws("-", F.col("start_line").cast("string"), F.col("end_line").cast("string"))), line("visibility", F.col("visibility")), line("complexity", F.col("cyclomatic")), line("callers", F.col("callers")))
    return rows.select("id", vault_path(F.col("file_path")).alias("path"), section.alias("section"), "seq")


def cluster_index(members: DataFrame, symbols: DataFrame) -> DataFrame:
    """(cluster_id, slug, n, names): clusters and their members' names in order."""
    m = members.join(symbols.select("id", "name"), "id").groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("seq", "name"))).alias("x"))
    return m.select("cluster_id", text.slugify(F.col("cluster_id")).alias("slug"), F.size("x").cast("long").alias("n"), F.array_join(F.transform("x", lambda y: y["name"]), ", ").alias("names"))


def unclustered(symbols: DataFrame, members: DataFrame) -> DataFrame:
    """(id, cluster_id): every symbol's cluster, ``unclustered`` without one."""
    return symbols.select("id").join(members.select("id", "cluster_id"), "id", "left").na.fill("unclustered", ["cluster_id"])


def process_diagrams(steps: DataFrame, symbols: DataFrame) -> DataFrame:
    """(process_id, diagram): a Mermaid graph of each process's steps."""
    named = steps.join(symbols.select(F.col("id").alias("symbol_id"), "name"), "symbol_id", "left").withColumn("name", F.coalesce("name", "symbol_id"))
    x = named.groupBy("process_id").agg(F.array_sort(F.collect_list(F.struct("step_order", "name"))).alias("x"))
    node = lambda s: F.concat(F.lit("  S"), s["step_order"].cast("string"), F.lit('["'), F.regexp_replace(s["name"], '"', "'"), F.lit('"]'))
    link = lambda s: F.concat(F.lit("  S"), (s["step_order"] - 1).cast("string"), F.lit(" --> S"), s["step_order"].cast("string"))
    lines = F.concat(F.array(F.lit("graph LR")), F.transform("x", node), F.transform(F.slice("x", 2, F.size("x")), link))
    return x.select("process_id", F.array_join(lines, "\n").alias("diagram"))


def documents(symbols: DataFrame, calls: DataFrame, members: DataFrame, steps: DataFrame) -> DataFrame:
    """(path, content): all files of the export."""
    s = symbol_sections(symbols, calls).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "section"))).alias("x"))
    files = s.select("path", F.concat(F.lit("# "), "path", F.lit("\n\n"), F.array_join(F.transform("x", lambda y: y["section"]), "\n\n")).alias("content"))
    clusters = cluster_index(members, symbols).select(F.concat(F.lit("clusters/"), "slug", F.lit(".md")).alias("path"), F.concat(F.lit("# "), "cluster_id", F.lit("\n\n"), "names").alias("content"))
    flows = process_diagrams(steps, symbols).select(F.concat(F.lit("processes/"), text.slugify(F.col("process_id")), F.lit(".md")).alias("path"), F.concat(F.lit("# "), "process_id", F.lit("\n\n```mermaid\n"), "diagram", F.lit("\n```")).alias("content"))
    return files.unionByName(clusters).unionByName(flows)


def write_vault(docs: DataFrame, folder: str) -> DataFrame:
    """Write (path, content) as files below ``folder``; paths that leave it raise.  Returns path and bytes written.

    Each task writes its own files to a store that Arrow knows.
    """
    import pyarrow as pa

    bad = docs.where(~text.is_safe_path(F.col("path"))).select("path").first()
    if bad is not None:
        raise ValueError(f"unsafe path: {bad.path}")

    def run(batches):
        from pyarrow.fs import FileSystem

        store, root = FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
        for batch in batches:
            done = []
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store.create_dir(f"{root}/{path}".rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{root}/{path}") as f:
                    f.write(content.encode())
                done.append(len(content.encode()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.int64())], ["path", "bytes"])

    return docs.select("path", "content").mapInArrow(run, "path string, bytes long")

"""A graph kept as snapshots: upserts, deletes, deltas; diffs of file sets; caches; batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from codeloom.operators.relate import first_by


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key.

    Columns are those of both sides; what a new row does not have stays as it was.  Of
    several new rows of a key the last by ``order`` counts.
    """
    if order is not None:
        new = first_by(new, keys, F.desc(order))
    else:
        new = new.dropDuplicates(keys)
    add = [c for c in new.columns if c not in keys and c != order]
    rest = [c for c in old.columns if c not in keys and c not in add]
    n = new.select(*keys, F.lit(True).alias("__new"), *[F.col(c).alias(f"__{c}") for c in add])
    both = old.join(n, keys, "full_outer")
    pick = lambda c: F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c) if c in old.columns else F.lit(None)).alias(c)
    return both.select(*keys, *[pick(c) if c in add else F.col(c) for c in [*[c for c in old.columns if c not in keys], *[c for c in add if c not in old.columns]] if c in add or c in rest])


def upsert_edges(old: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of both, one of each (src, dst, rel_type); new ones without both ends in ``nodes`` are dropped."""
    ids = nodes.select("id").distinct()
    fine = new.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return old.unionByName(fine, allowMissingColumns=True).dropDuplicates(["src", "dst", "rel_type"])


def delete_files(symbols: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols and edges without those of the files (file_path)."""
    gone = symbols.join(files.select("file_path").distinct(), "file_path", "left_semi").select("id")
    left = symbols.join(files.select("file_path").distinct(), "file_path", "left_anti")
    e = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return left.select(*symbols.columns), e.select(*edges.columns)


def delete_vectors(vectors: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Vectors (id) without those of the symbols of the files (file_path)."""
    gone = symbols.join(files.select("file_path").distinct(), "file_path", "left_semi").select("id")
    return vectors.join(gone, "id", "left_anti").select(*vectors.columns)


def classify_files(cached: DataFrame, found: DataFrame, parse_version: int) -> DataFrame:
    """(path, status): unchanged, changed, added or removed.

    ``cached`` has path, content_hash, mtime_ms, parse_version; ``found`` has path,
    content_hash, mtime_ms.  The hash counts only where the time moved; a missing hash
    means changed.
    """
    c = cached.select("path", F.col("content_hash").alias("h"), F.col("mtime_ms").alias("t"), F.col("parse_version").alias("v"))
    both = c.withColumn("__c", F.lit(True)).join(found.select("path", "content_hash", "mtime_ms").withColumn("__f", F.lit(True)), "path", "full_outer")
    fresh = (F.col("v") == parse_version) & ((F.col("t") == F.col("mtime_ms")) | (F.col("h") == F.col("content_hash")))
    status = F.when(F.col("__c").isNull(), "added").when(F.col("__f").isNull(), "removed").when(F.coalesce(fresh, F.lit(False)), "unchanged").otherwise("changed")
    return both.select("path", status.alias("status"))


def merge_parsed(fresh: DataFrame, cached: DataFrame, status: DataFrame, order: DataFrame) -> DataFrame:
    """Symbols of unchanged files from the cache and of the others fresh, in walk order, one per id."""
    s = status.select(F.col("path").alias("file_path"), "status")
    keep = cached.join(s.where("status = 'unchanged'").select("file_path"), "file_path", "left_semi")
    new = fresh.join(s.where("status in ('changed', 'added')").select("file_path"), "file_path", "left_semi")
    rows = keep.unionByName(new, allowMissingColumns=True).join(order.select(F.col("path").alias("file_path"), F.col("seq").alias("walk")), "file_path")
    return first_by(rows, ["id"], F.col("walk"), F.col("seq")).drop("walk")


def apply_delta(symbols: DataFrame, edges: DataFrame, status: DataFrame, parsed: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The snapshot after a change: removed and changed files' symbols go, parsed ones come; edges are replaced whole."""
    s = status.select(F.col("path").alias("file_path"), "status")
    left = symbols.join(s.where("status in ('removed', 'changed')").select("file_path"), "file_path", "left_anti")
    came = parsed.join(s.where("status in ('changed', 'added')").select("file_path"), "file_path", "left_semi")
    after = left.unionByName(came, allowMissingColumns=True).select(*parsed.columns)
    return after, upsert_edges(edges.limit(0), new_edges, after)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, n): rows that only one side has; none where both are equal."""
    one = a.exceptAll(b).agg(F.count("*").alias("n")).select(F.lit("left").alias("side"), "n")
    return one.union(b.exceptAll(a).agg(F.count("*").alias("n")).select(F.lit("right").alias("side"), "n")).where("n > 0")


def cache_split(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """``wanted`` (hash, dims) with the cached vector, or null for a miss; another dims is a miss."""
    return wanted.join(cache.select("hash", "dims", "vector"), ["hash", "dims"], "left")


def cache_put(cache: DataFrame, new: DataFrame, most: int = 200_000) -> DataFrame:
    """The cache (hash, dims, vector, at) with new entries, the ``most`` latest of them."""
    all_of = first_by(cache.unionByName(new), ["hash"], F.desc("at"))
    return all_of.orderBy(F.desc("at"), "hash").limit(most)


def budget_batches(rows: DataFrame, size: Column, most_bytes: int, most_rows: int, keys: list[str], order: str) -> DataFrame:
    """``rows`` with batch (from 0 inside the keys): runs in order of at most so many bytes and rows; what is too large stands alone.

    A fold over each key's rows as they come sorted out of a window, so that a task holds
    neither a key's rows nor its batches; keys are the partitions that are written together.
    """
    names = rows.columns
    w = Window.partitionBy(*keys).orderBy(order)
    sized = rows.withColumns({"__k": F.row_number().over(w), "__s": size.cast("long")})

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = n = used = 0
        for part in parts:
            out = []
            for k, s in zip(part.column("__k").to_pylist(), part.column("__s").to_pylist(), strict=True):
                if k == 1:
                    b = n = used = 0
                full = used is not None and s is not None and used + s > most_bytes  # an unknown size fills nothing
                if n and (full or n >= most_rows):
                    b, n, used = b + 1, 0, 0
                used = None if used is None or s is None else used + s
                n += 1
                out.append(b)
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(out, pa.int32())], names=[*names, "batch"])

    return sized.mapInArrow(fold, StructType([*rows.schema.fields, StructField("batch", IntegerType())]))


def write_snapshot(folder: str, **tables: DataFrame) -> None:
    """Each table as Parquet; edges in a folder per relation, so that reads of one are pruned."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy("rel_type") if "rel_type" in df.columns else writer).parquet(f"{folder}/{name}")


def percentiles(samples: DataFrame, value: str, order: str, window: int = 2048) -> DataFrame:
    """p50 and p99 by nearest rank of the latest samples."""
    last = samples.orderBy(F.desc(order)).limit(window).agg(F.array_sort(F.collect_list(value)).alias("v"))
    at = lambda p: F.when(F.size("v") > 0, F.element_at("v", F.greatest(F.ceil(F.size("v") * p), F.lit(1)).cast("int")))
    return last.select(at(0.5).alias("p50"), at(0.99).alias("p99"), F.size("v").alias("n"))



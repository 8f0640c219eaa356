"""Session defaults, and intermediates in the folder that a cluster's machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def session(name: str = "codeloom", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset, a local one, on one machine alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="codeloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/codeloom-{uuid.uuid4().hex[:12]}"


def by_key(df: DataFrame) -> DataFrame:
    """A side of a join that goes by sorted keys: never sent whole through the driver.

    Spark's size checks see compressed files, which may be ten times as large when broadcast,
    and a loop would send them every round.
    """
    return df.hint("merge")


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back: a short lineage that survives lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table that ``cut`` wrote and nothing reads any more."""
    spark = df.sparkSession
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut_and_count(df: DataFrame, of: Column | None = None) -> tuple[DataFrame, int]:
    """``cut``, and how many rows (where ``of`` holds) were written, counted as they are written."""
    seen = Observation()
    n = F.count(F.lit(1)) if of is None else F.count_if(of)
    return cut(df.observe(seen, n.alias("n"))), seen.get["n"]

"""A two-pass external shuffle into shards.

Pass one scatters records uniformly, by a seeded hash of text and id, into buckets that
fit memory; where one record comes very often, the hash takes in the row's place in the
table too, so that it spreads over many buckets.  Pass two puts each
bucket into a canonical order and shuffles it by Fisher-Yates with a seed (Spark's
``shuffle`` of an array).  Buckets in their order are then one random permutation of the
table, and shards are equal ranges of it, so that their row counts differ by one at most.
All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import remove, shared_dir, written

#: Bytes of text that a bucket should hold, as one array; and of the buckets that a task gets together.
BUCKET_BYTES, TASK_BYTES = 1 << 20, 16 << 20
#: Buckets whose places are summed up in one task.
_BLOCK = 4096
#: Rows equal in id and text that may share a bucket.
EQUAL_ROWS = 1024


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = 1, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, equal_rows: int = EQUAL_ROWS) -> DataFrame:
    """Write the shards (Parquet, a directory per shard, rows in slot order) and return them read back.

    Columns: all of ``docs``, then slot (long, gapless from 0 in its shard) and shard (int,
    0 to shards - 1); columns of ``docs`` with these names are replaced.  Null texts and
    ids are kept, repeated rows fill a slot each, an empty table gives no rows.  The order
    depends on the seed and the rows alone, unless ``equal_rows`` and more are equal in id
    and text: those are spread by their places in the table.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)
    docs = docs.drop("shard", "slot")
    names = docs.columns
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long") + 64
    rows, total = docs.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    buckets = max(1, -(-total // bucket_bytes))
    key = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(text_col).cast("string"))
    bucket = F.pmod(key, F.lit(buckets).cast("long")).alias("bucket")

    # records that come so often that their bucket stands out
    full = docs.groupBy(bucket).agg(F.count("*").alias("n")).where(F.col("n") > max(equal_rows, 4 * rows // buckets)).select("bucket")
    often = docs.select(bucket, key.alias("key")).join(full, "bucket", "left_semi").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > equal_rows)
    often = written(often.select(F.col("key").alias("__often"), F.ceil(F.col("n") / equal_rows).alias("__parts")), f"{folder}-often")
    if not often.isEmpty():
        placed = docs.withColumns({"__key": key, "__place": F.monotonically_increasing_id()}).join(often, F.col("__key") == F.col("__often"), "left")
        part = F.coalesce(F.pmod(F.xxhash64("__place"), "__parts"), F.lit(0).cast("long"))
        docs = written(placed.withColumn("__key", F.when(part > 0, F.xxhash64("__key", part)).otherwise(F.col("__key"))).drop("__often", "__parts"), f"{folder}-spread")
        key = F.col("__key")
        bucket = F.pmod(key, F.lit(buckets).cast("long")).alias("bucket")

    # where each bucket begins in the permutation: one row per bucket
    counts = docs.select(bucket).groupBy("bucket").agg(F.count("*").alias("n")).withColumn("block", F.expr(f"bucket div {_BLOCK}"))
    blocks = counts.groupBy("block").agg(F.sum("n").alias("m")).select("block", (F.sum("m").over(Window.orderBy("block")) - F.col("m")).alias("base"))
    inside = F.sum("n").over(Window.partitionBy("block").orderBy("bucket")) - F.col("n")
    begins = counts.withColumn("inside", inside).join(blocks, "block").select(F.col("bucket").alias("at"), (F.col("base") + F.col("inside")).alias("begin"))

    record = F.struct(F.xxhash64(key, F.lit(seed)).alias("k"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("r")).alias("x")
    scattered = docs.select(bucket, record).repartition(max(1, total // TASK_BYTES), "bucket")
    held = scattered.groupBy("bucket").agg(F.collect_list("x").alias("x")).join(begins, F.col("bucket") == F.col("at"))
    in_order = F.array_sort("x", lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))
    # the generator of shuffle() goes by partition; buckets in order make its draws repeatable
    mixed = held.select("bucket", "begin", in_order.alias("x")).sortWithinPartitions("bucket").select("begin", F.shuffle("x", seed).alias("x"))
    placed = mixed.select("begin", F.posexplode("x").alias("i", "x")).select((F.col("begin") + F.col("i")).alias("p"), "x.r")
    small, more = divmod(rows, shards)  # the first ``more`` shards hold one row more
    edge = more * (small + 1)
    shard = F.when(F.col("p") < edge, F.expr(f"p div {small + 1}")).otherwise(more + F.expr(f"(p - {edge}) div {max(small, 1)}"))
    slot = F.when(F.col("p") < edge, F.col("p") % (small + 1)).otherwise((F.col("p") - edge) % max(small, 1))
    out = placed.select(*[F.col("r")[c].alias(c) for c in names], slot.cast("long").alias("slot"), shard.cast("int").alias("shard")).sortWithinPartitions("shard", "slot")
    out.write.mode("overwrite").partitionBy("shard").option("compression", "zstd").parquet(folder)
    for name in ("often", "spread"):
        remove(spark, f"{folder}-{name}")
    return spark.read.schema(out.schema).parquet(folder)

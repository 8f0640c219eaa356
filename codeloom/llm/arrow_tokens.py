"""Token ids in Arrow IPC files of fixed-size lists.

Documents in ascending id order become one stream of tokens, cut into rows of
``width`` ids and ``width`` mask bits (true: a token, false: padding, which only the
last row of a file has).  All rows have one width and nothing is compressed, so a
memory-mapped file gives any row without copying or parsing.  Beside each file an
index file holds the documents' ids and token counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.bytebpe import encoder
from codeloom.llm.common import give_back, small_batches, written

_MANIFEST = "file_no long, path string, n_docs long, n_tokens long, n_rows long"
_INDEX = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])


def _schema(width: int, kind: pa.DataType) -> pa.Schema:
    return pa.schema([("ids", pa.list_(kind, width)), ("mask", pa.list_(pa.bool_(), width))])


def open_store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """Any store that Arrow knows: a path or file:, hdfs:, s3:, gs: and others."""
    return pyarrow.fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


class TokenFile:
    """Random access to the rows of one token file."""

    def __init__(self, uri: str) -> None:
        store, path = open_store(uri)
        source = pa.memory_map(path) if isinstance(store, pyarrow.fs.LocalFileSystem) else store.open_input_file(path)
        self.reader = pa.ipc.open_file(source)
        self.width = self.reader.schema.field("ids").type.list_size
        self.per_batch = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 0

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view on the file) and mask of row ``i``."""
        batch = self.reader.get_batch(i // self.per_batch)
        k = (i % self.per_batch) * self.width
        ids, mask = (batch.column(c).values[k : k + self.width] for c in (0, 1))
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)

    def stream(self) -> Iterator[np.ndarray]:
        """All ids without padding, a batch at a time."""
        for b in range(self.reader.num_record_batches):
            batch = self.reader.get_batch(b)
            ids = batch.column(0).values.to_numpy()
            n = batch.column(1).values.true_count
            yield ids if n == len(ids) else ids[:n]


def write_tokens(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 2, width: int = 2048, rows_per_batch: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files and return their manifest: file_no (ascending by id), path, n_docs, n_tokens, n_rows.

    Null texts count as empty; documents with a null id come first, and repeated ids
    stand side by side, in as many files as their rows fill.  Other columns are left out.
    An empty table writes no file.  Each attempt of a task writes files of its own name,
    and the manifest names those of the attempt that counts.  A document of any length is
    encoded in parts; its ids are held at once.
    """
    spark = docs.sparkSession
    small_batches(spark)
    store, root = open_store(folder)
    store.create_dir(f"{root}/tokens", recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        context = TaskContext.get()
        no = context.partitionId()
        store, root = open_store(folder)
        own = f"tokens/part-{no:06d}-{context.taskAttemptId()}"
        kind = pa.from_numpy_dtype(bpe.dtype)
        schema = _schema(width, kind)
        size = width * rows_per_batch
        held = np.zeros(size, bpe.dtype)
        fill = n_docs = n_tokens = n_rows = 0
        sink = out = index = None

        def put(n: int) -> None:
            nonlocal n_rows
            rows = -(-n // width)
            held[n : rows * width] = 0
            mask = np.arange(rows * width) < n
            out.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(held[: rows * width]), width), pa.FixedSizeListArray.from_arrays(pa.array(mask), width)], schema=schema))
            n_rows += rows

        for batch in batches:
            for i, j, _, _, found, bounds in bpe.encode_column(batch.column(1)):
                if out is None:
                    sink = [store.open_output_stream(f"{root}/{own}.{x}.arrow") for x in ("ids", "index")]
                    out, index = pa.ipc.new_file(sink[0], schema), pa.ipc.new_file(sink[1], _INDEX)
                ids = np.insert(found, bounds[1:], bpe.dtype.type(end_id))
                counts = np.diff(bounds) + 1
                index.write_batch(pa.RecordBatch.from_arrays([batch.column(0)[i:j].cast(pa.int64()), pa.array(counts)], schema=_INDEX))
                n_docs += j - i
                n_tokens += len(ids)
                at = 0
                while at < len(ids):
                    take = min(size - fill, len(ids) - at)
                    held[fill : fill + take] = ids[at : at + take]
                    fill, at = fill + take, at + take
                    if fill == size:
                        put(fill)
                        fill = 0
        if out is not None:
            if fill:
                put(fill)
            for x in (out, index, *sink):
                x.close()
            give_back()
            yield pa.RecordBatch.from_pydict({"file_no": [no], "path": [f"{folder}/{own}"], "n_docs": [n_docs], "n_tokens": [n_tokens], "n_rows": [n_rows]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # the place in the table tells rows of one id apart, so that many of them can be split
    order = [F.col("doc_id").asc_nulls_first(), F.col("place")]
    rows = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return written(rows.mapInArrow(run, _MANIFEST), f"{folder}/manifest")


def read_tokens(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Read the files back: doc_id, start, n_tokens, ids_crc32, file_no, file_start, one row per document.

    The manifest has one row per file; only that comes to the driver.
    """
    files, start = [], 0
    for m in manifest.orderBy("file_no").collect():
        files.append((m.file_no, m.path, start))
        start += m.n_tokens
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, file_no long, file_start long"
    if not files:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file_no, path, first in (r.values() for b in batches for r in b.to_pylist()):
            stream = TokenFile(f"{path}.ids.arrow").stream()
            index = TokenFile.index(f"{path}.index.arrow")
            ids, at, here = np.zeros(0, np.uint16), 0, 0
            for batch in index:
                counts = batch.column(1).to_numpy()
                crcs = []
                for n in counts.tolist():
                    crc = 0
                    while n:
                        if at == len(ids):
                            ids, at = next(stream), 0
                        take = min(n, len(ids) - at)
                        crc = zlib.crc32(ids[at : at + take].astype("<u4"), crc)
                        at, n = at + take, n - take
                    crcs.append(crc)
                own = np.cumsum(counts) - counts + here
                here += int(counts.sum())
                k = len(counts)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(first + own), pa.array(counts), pa.array(crcs, pa.int64()), pa.array(np.full(k, file_no)), pa.array(own)], ["doc_id", "start", "n_tokens", "ids_crc32", "file_no", "file_start"])

    names = spark.createDataFrame(files, "file_no long, path string, first long").repartition(len(files))
    return names.mapInArrow(run, schema)


def _index(uri: str) -> Iterator[pa.RecordBatch]:
    store, path = open_store(uri)
    with store.open_input_file(path) as f:
        reader = pa.ipc.open_file(f)
        for b in range(reader.num_record_batches):
            yield reader.get_batch(b)


TokenFile.index = staticmethod(_index)

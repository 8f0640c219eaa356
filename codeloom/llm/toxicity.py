"""Toxicity by bags of subword embeddings under a linear softmax.

A word is itself and its character n-grams, each an embedding in a hashed table; a text
is the mean of all its embeddings, and a softmax layer tells its class.  Embeddings and
layer are trained jointly in numpy, so that unseen spellings share the vectors of their
n-grams.  As the layer is linear, a text's logit is the mean of one number per subword,
and scoring sums one number per distinct word.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import beside, give_back, held, small_batches, text_steps
from codeloom.llm.textkernel import BYTE_CODE, LETTERS, LOWER, PrefixHash, WordTable, runs

BUCKETS = 1 << 18
SHORTEST, LONGEST = 3, 5
#: The mean is scaled by this before the softmax layer; a text has a hundredth or so of telling words.
SCALE = 50.0
#: Empty subwords that every mean holds besides its own, so that a few words alone weigh less.
BLANKS = 100


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of all words joined, and the number for each word."""
    raw = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8)
    n = np.array([len(w) + 2 for w in words], np.int64)
    at = np.cumsum(n) - n
    prefix = PrefixHash(BYTE_CODE[raw])
    owner, hashes = [np.arange(len(words))], [prefix.of(at, at + n)]
    for k in range(SHORTEST, LONGEST + 1):
        many = np.maximum(n - k + 1, 0)
        w = np.repeat(np.arange(len(words)), many)
        s = at[w] + np.arange(len(w)) - np.repeat(np.cumsum(many) - many, many)
        owner.append(w)
        hashes.append(prefix.of(s, s + k))
    w = np.concatenate(owner)
    order = np.argsort(w, kind="stable")
    return (np.concatenate(hashes) & np.uint64(BUCKETS - 1)).astype(np.int64)[order], np.bincount(w, minlength=len(words))


def bag(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct buckets of a text, how often each comes, and the number of its subwords."""
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(0, np.int32), 0
    starts, ends = runs(LETTERS[data], np.array([0, len(data)]))
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(0, np.int32), 0
    raw = data.tobytes()
    buckets, _ = subwords([raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
    found, many = np.unique(buckets, return_counts=True)
    return found.astype(np.int32), many.astype(np.min_scalar_type(int(many.max()))), len(buckets)


def train(rows: list[tuple[str, int]], width: int = 4, updates: int = 1300, rate: float = 0.3, batch: int = 32, seed: int = 7, start: float = 0.02, damp: float = 1e-5) -> tuple[np.ndarray, float]:
    """The number of each bucket and the bias: the logit of class 1 over class 0 is their mean times SCALE plus the bias.

    ``updates`` steps of Adagrad over batches of ``batch`` rows, as many passes as that takes.
    """
    rng = np.random.default_rng(seed)
    if len({y for _, y in rows}) < 2:  # nothing to tell apart
        return np.zeros(BUCKETS, np.float32), 30.0 if rows and rows[0][1] else -30.0
    rows = sorted(rows, key=lambda r: (r[0], r[1]))
    bags: list[tuple[np.ndarray, np.ndarray, int]] = []
    for k in range(0, len(rows), 500):  # kept as slices of a few large arrays
        some = [bag(t) for t, _ in rows[k : k + 500]]
        cuts = np.cumsum([0, *(len(x[0]) for x in some)]).tolist()
        found, many = (np.concatenate([x[c] for x in some]) for c in (0, 1))
        bags += [(found[a:b], many[a:b], x[2]) for x, a, b in zip(some, cuts[:-1], cuts[1:], strict=True)]
    y = np.array([c for _, c in rows])
    table = rng.uniform(-1, 1, (BUCKETS, width)) * start
    layer, bias = rng.normal(0, 0.5, (width, 2)), np.zeros(2)
    seen_table, seen_layer, seen_bias = np.full((BUCKETS, 1), damp), np.full_like(layer, 1e-6), np.full(2, 1e-6)
    done = 0
    while done < updates:
        order = rng.permutation(len(bags))
        for k in range(0, len(order), batch):
            step = rate * max(1 - done / updates, 0.01)
            done += 1
            part = order[k : k + batch]
            n = [len(bags[i][0]) for i in part]
            col = np.concatenate([bags[i][0] for i in part])
            share = np.concatenate([bags[i][1] * (SCALE / (bags[i][2] + BLANKS)) for i in part])
            row = np.repeat(np.arange(len(part)), n)
            found, back = np.unique(col, return_inverse=True)
            e = table[found]
            x = np.column_stack([np.bincount(row, share * e[back, c], len(part)) for c in range(width)])
            z = x @ layer + bias
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            z[np.arange(len(part)), y[part]] -= 1
            z /= len(part)
            to_x = z @ layer.T
            grad = np.column_stack([np.bincount(back, share * to_x[row, c], len(found)) for c in range(width)])
            seen_table[found] += (grad * grad).mean(1, keepdims=True)
            table[found] = e - step * grad / np.sqrt(seen_table[found])
            for value, seen, g in ((layer, seen_layer, x.T @ z), (bias, seen_bias, z.sum(0))):
                seen += g * g
                value -= 0.1 * step * g / np.sqrt(seen)
    del bags, some, found, many, e, share, col, row
    give_back()
    return (table @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def sample(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = 14_000, most_bytes: int = 256 << 20, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> list[tuple[str, int]]:
    """At most ``rows`` (text, label) rows with ``most_bytes`` of text: those of the labels under ``learn`` whose ids have the smallest hashes.

    Labels other than 0 and 1 and labels without a document are left out; of several labels
    of an id the larger counts, and of several texts the one with the smallest hash.  Texts
    that would go beyond the bound of bytes are left out, later ones in the order first.
    """
    rank = F.xxhash64(F.col("i"), F.lit(23))
    chosen = labels.where(learn & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("i")).agg(F.max(label_col).cast("int").alias("y")).orderBy(rank, "i").limit(rows)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.select(F.col(id_col).cast("long").alias("i"), text.alias("t")).join(F.broadcast(chosen), "i")  # at most ``rows`` rows
    print_ = F.struct(F.xxhash64("t").alias("h"), F.octet_length("t").cast("long").alias("n"))
    sizes = found.groupBy("i").agg(F.min(print_).alias("p")).select("i", "p.h", "p.n", rank.alias("k")).collect()  # one row an id
    keep, held = [], 0
    for r in sorted(sizes, key=lambda r: (r.k, r.i)):
        held += r.n
        if held > most_bytes:
            break
        keep.append((r.i, r.h))
    one = F.broadcast(found.sparkSession.createDataFrame(keep, "i long, h long"))  # at most ``rows`` rows
    picked = found.withColumn("h", F.xxhash64("t")).join(one, ["i", "h"]).dropDuplicates(["i"])
    return [(r.t, r.y) for r in picked.select("t", "y").collect()]


def score(docs: DataFrame, numbers: np.ndarray, bias: float, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """doc_id and score (probability of class 1); with ``keep_columns`` score after all columns of ``docs``, in place of one of that name.

    Null texts, empty ones and those without a letter have the score of the bias alone.
    Repeated rows are scored each for itself; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(numbers)  # BUCKETS numbers
    token = uuid.uuid4().hex

    def table() -> WordTable:
        def compute(words: list[bytes]) -> np.ndarray:
            buckets, many = subwords(words)
            return np.column_stack([np.bincount(np.repeat(np.arange(len(words)), many), model.value[buckets], len(words)), many])

        return held(token, lambda: WordTable(compute, 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0)]
            for _, _, data, offsets in text_steps(batch.column(batch.num_columns - 1)):
                total = table().sums(data, offsets)
                logit = SCALE * total[:, 0] / (total[:, 1] + BLANKS) + bias
                found.append(1 / (1 + np.exp(-np.clip(logit, -500, 500))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(found))], [*batch.schema.names[:-1], "score"])
        give_back()

    own = [F.col(f"`{c}`") for c in beside(docs, ("score",))] if keep_columns else [F.col(id_col).cast("long").alias("doc_id")]
    rows = docs.select(*own, F.col(text_col).cast("string").alias(token))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "score double"])
    return rows.mapInArrow(run, schema)

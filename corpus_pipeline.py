"""A corpus pipeline of four training-data operators over ``documents``.

Stages, in order: language ID, toxicity, MinHash near-dedup, packing.  Each takes
(spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``.  Null, empty and repeated rows follow the operators' docstrings.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import language_id, near_dedup, packing, toxicity
from codeloom.llm.common import give_back, remove, shared_dir, written
from codeloom.llm.queries import BYTE_BPE, PIECE_BPE, fold, table

#: A document is rejected by language ID if no learned language has this share of its probability.
LEAST_LANGUAGE = 0.5
#: A document is rejected as toxic from this score on.
TOXIC = 0.5


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with numbered columns, whose names no operator's clash with, and the new name of each."""
    names = {c: f"column_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language learned from labelled rows; those without a letter (``und``) go."""
    langs, p = language_id.train(language_id.sample(docs, fold(4) != 2), PIECE_BPE)
    give_back()
    rows, names = _numbered(docs)
    judged = language_id.predict(rows, langs, p, PIECE_BPE, id_col=names["doc_id"], text_col=names["text"], keep_columns=True)
    keep = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE)
    return judged.where(keep).select(*names.values()).toDF(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents scored below ``TOXIC`` by a model of the labelled documents that are still there."""
    model = toxicity.train(toxicity.sample(docs, table(spark, sf_dir, "labels"), fold(5) != 0))
    give_back()
    rows, names = _numbered(docs)
    judged = toxicity.score(rows, *model, id_col=names["doc_id"], text_col=names["text"], keep_columns=True)
    return judged.where(F.col("score") < TOXIC).select(*names.values()).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document (the smallest doc_id) of each group linked at 0.8 on five-word shingles.

    Rows of one doc_id are one document, so one row of them stays, the one with the longest
    text (of several, the one whose text has the largest hash); rows without an id stay.
    """
    found = near_dedup.near_duplicates(docs, replace(near_dedup.Settings(), words=5))
    kept = written(found.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")), f"{shared_dir(spark)}/kept")
    stay = docs.join(kept.select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi")
    if not kept.where("n > 1").isEmpty():
        rows, names = _numbered(stay.select(*[F.col(f"`{c}`") for c in docs.columns]))
        text = F.col(names["text"])
        one = F.max_by(F.struct(*names.values()), F.struct(F.octet_length(text), F.xxhash64(text)))
        stay = rows.groupBy(F.col(names["doc_id"]).alias("key")).agg(one.alias("row")).select("row.*").toDF(*docs.columns)
    return stay.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where("doc_id is null"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 2048, ids as binary."""
    return packing.pack(docs, BYTE_BPE, end_id=1)


STAGES = [("language_id", identify_language), ("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("packing", pack_sequences)]
ORACLE_SQL = None  # learned models and the library's tokens have no SQL; tests hold stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    folder = shared_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{name}")
        if k:
            remove(spark, f"{folder}/{STAGES[k - 1][0]}")
    return STAGES[-1][1](spark, docs, sf_dir)

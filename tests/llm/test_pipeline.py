"""Each stage of the pipeline on its own input, against what its operator says."""

import pytest
from test_near_dedup import brute

import corpus_pipeline
from codeloom.llm import packing
from codeloom.llm.queries import BYTE_BPE

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


def test_filters_keep_columns_and_clean_documents(stages):
    first = stages[""]
    for before, name in (("", "language_id"), ("language_id", "toxicity"), ("toxicity", "near_dedup")):
        assert stages[name].columns == first.columns
        assert stages[name].exceptAll(stages[before]).count() == 0
    assert stages["language_id"].count() > 0.97 * first.count()
    assert 0.8 * first.count() < stages["toxicity"].count() < stages["language_id"].count()


def test_one_of_each_group_of_near_copies_stays(stages):
    rows = [r.asDict() for r in stages["toxicity"].collect()]
    want = {k for k, v in brute(rows, 5).items() if k == v}
    assert sorted(r.doc_id for r in stages["near_dedup"].collect()) == sorted(want)


def test_repeated_rows_and_null_ids(spark, docs):
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    ids = [r.doc_id for r in got.collect()]
    assert ids.count(None) == 1 and ids.count(900004) == 1 and 900005 not in ids
    assert {900001, 900002, 900003} <= set(ids)


def test_clashing_columns_and_ids_with_several_texts(spark, stages):
    from pyspark.sql import functions as F

    few = stages[""].where("doc_id < 300").withColumns({"score": F.lit("mine"), "lang_pred": F.lit(7), "a.b": F.lit(1), "component_id": F.lit(None).cast("long"), "n": F.lit(2), "kept": F.lit(False)})
    more = few.where("doc_id = 5").withColumn("text", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, few.unionByName(more) if name == "near_dedup" else few, SF)
        assert got.columns == few.columns and got.exceptAll(few).count() == 0 and got.count() > 100


def test_last_stage_and_run(spark, stages):
    last = stages["packing"]
    assert last.select("doc_id").distinct().count() == stages["near_dedup"].count()
    assert sum(len(r.ids) for r in last.collect()) == sum(len(r.ids) for r in packing.pack(stages["near_dedup"], BYTE_BPE, end_id=1).collect())
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "near_dedup", "packing"]

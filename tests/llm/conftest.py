import pytest

SF = "/root/testdata/sf0.001"
#: (doc_id, text, lang, source, n_chars): nulls, empty, white space only, ties, repeated rows.
ODD = [
    (900001, None, None, None, None),
    (900002, "", "en", "a", 0),
    (900003, " \n\t \n", "en", "a", 5),
    (900004, "one two", "en", "a", 7),
    (900005, "one two", "en", "a", 7),
    (900005, "one two", "en", "a", 7),
    (None, "lost id, it's here\n\nand  there's more\n", "en", None, 38),
    (900006, "12345 !!! 678", None, "b", 13),
    (900007, "日本語 テスト 😀😀 ½ 　x\n's 've", "ja", "b", 25),
    (900008, "the same five words here again " * 4000, "en", "b", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """The small documents and odd ones."""
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(ODD, SCHEMA))


@pytest.fixture(scope="session")
def rows(docs):
    return docs.collect()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)

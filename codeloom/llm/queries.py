"""The driver's queries over the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import arrow_tokens, language_id, near_dedup, nn_descent, packing, quality_ledger, sentencepiece_offsets, shuffle_shards, token_attribution, toxicity
from codeloom.llm.common import shared_dir

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n: int) -> F.Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_attribution.attribute_tokens(table(spark, sf_dir, "documents"), BYTE_BPE, rule="first")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = arrow_tokens.write_tokens(table(spark, sf_dir, "documents"), BYTE_BPE, shared_dir(spark), end_id=2)
    return arrow_tokens.read_tokens(spark, manifest).select("doc_id", "start", "n_tokens", "ids_crc32", "file_no", "file_start")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nn_descent.nearest(vectors, vectors.where("vec_id % 20 = 0"), top=20)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(toxicity.sample(docs, table(spark, sf_dir, "labels"), fold(5) != 0))
    scored = toxicity.score(docs, *model)
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    langs, p = language_id.train(language_id.sample(docs, fold(4) != 2), PIECE_BPE)
    found = language_id.predict(docs, langs, p, PIECE_BPE)
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shuffle_shards.shard_rows(table(spark, sf_dir, "documents"), shards=16)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce("text", F.lit("")))
    return placed.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), near_dedup.Settings(words=4, percent=80))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = sentencepiece_offsets.encode_decode(table(spark, sf_dir, "documents"), PIECE_BPE)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), F.crc32("starts").alias("starts_crc32"), F.crc32("ends").alias("ends_crc32"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality_ledger.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("quality.failures").bitwiseAND(F.lit(quality_ledger.mask(quality_ledger.BASE)).cast("long")) != 0
    return q.select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], base.alias("base_failed"), quality_ledger.keeps(F.col("quality.failures")).alias("kept"), "quality.failures")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_attribution": op1,
    "op2_arrow_tokens": op2,
    "op3_nn_descent": op3,
    "op4_toxicity": op4,
    "op5_language_id": op5,
    "op6_shuffle_shards": op6,
    "op7_near_dedup": op7,
    "op8_sentencepiece_offsets": op8,
    "op9_quality_ledger": op9,
    "op10_cost_balanced_packing": op10,
}
_WORDS = r"list_filter(string_split_regex({t}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL: dict[str, str] = {
    "op7_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(t=_LOWER)} AS ws FROM documents),
  x AS (SELECT doc_id, unnest(ws) AS a, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM w),
  y AS (SELECT doc_id, n, i, a, lead(a, 1) OVER v AS b, lead(a, 2) OVER v AS c, lead(a, 3) OVER v AS d FROM x WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
  s AS (SELECT DISTINCT doc_id, concat_ws(' ', a, b, c, d) AS g FROM y WHERE d IS NOT NULL OR (n < 4 AND i = 1)),
  size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  links AS (SELECT p.a, p.b FROM (SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS c FROM s l JOIN s r ON l.g = r.g AND l.doc_id < r.doc_id GROUP BY 1, 2) p
    JOIN size m ON m.doc_id = p.a JOIN size k ON k.doc_id = p.b WHERE 100 * c >= 80 * (m.n + k.n - c)),
  both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
  walk AS (SELECT a AS id, a AS o FROM both_ways UNION SELECT w.id, e.b FROM walk w JOIN both_ways e ON e.a = w.o),
  least_id AS (SELECT id, min(o) AS c FROM walk GROUP BY 1)
SELECT d.doc_id, coalesce(size.n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN size ON size.doc_id = d.doc_id LEFT JOIN least_id ON least_id.id = d.doc_id""",
    "op9_quality_ledger": f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT doc_id, {_WORDS.format(t="t")} AS ws FROM t),
  x AS (SELECT doc_id, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM w),
  y AS (SELECT doc_id, i, a, lead(a, 1) OVER v AS b, lead(a, 2) OVER v AS c, lead(a, 3) OVER v AS d, lead(a, 4) OVER v AS e FROM x WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
  z AS (SELECT doc_id, i, CASE WHEN e IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, a, b, c, d, e) > 1 THEN 1 ELSE 0 END AS f FROM y),
  u AS (SELECT doc_id, max(f) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS f FROM z),
  r AS (SELECT doc_id, CAST(sum(f) AS BIGINT) AS rep FROM u GROUP BY 1),
  l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda q: regexp_matches(q, '[^\\x20\\x09-\\x0D]')) AS ls, len(regexp_extract_all(t, '[#*$%&|<>]')) AS sym FROM t),
  m AS (SELECT w.doc_id, len(ws) AS n, coalesce(list_sum(list_transform(ws, lambda q: length(q))), 0)::BIGINT AS chars, sym, len(ls) AS lines, len(ls) - len(list_distinct(ls)) AS dup, coalesce(rep, 0) AS rep
    FROM w JOIN l ON l.doc_id = w.doc_id LEFT JOIN r ON r.doc_id = w.doc_id),
  k AS (SELECT *, CASE WHEN n < 10 THEN 1 ELSE 0 END + CASE WHEN rep * 100 > n * 20 THEN 2 ELSE 0 END + CASE WHEN sym * 100 > n * 40 THEN 4 ELSE 0 END
    + CASE WHEN lines > 3 AND dup * 100 > lines * 50 THEN 8 ELSE 0 END + CASE WHEN chars > n * 40 THEN 16 ELSE 0 END AS failures FROM m)
SELECT doc_id, n::BIGINT AS n_words, chars AS word_chars, sym::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines, rep AS n_repeat_words, failures & 3 <> 0 AS base_failed, failures = 0 AS kept, failures::BIGINT AS failures FROM k""",
}

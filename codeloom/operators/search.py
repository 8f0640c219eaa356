"""Looking up symbols: keywords, names near a query, vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import fixed, graph, text


def keyword_index(symbols: DataFrame) -> DataFrame:
    """(keyword, id, seq): the inverted index as rows, so that no keyword's list is held at once."""
    return symbols.select(F.explode(text.keywords(F.col("name"), F.col("signature"))).alias("keyword"), "id", "seq")


def keyword_lists(index: DataFrame) -> DataFrame:
    """(keyword, ids): lists in the order of the symbols."""
    lists = index.groupBy("keyword").agg(F.array_sort(F.collect_list(F.struct("seq", "id"))).alias("x"))
    return lists.select("keyword", F.transform("x", lambda y: y["id"]).alias("ids"))


def resolve(symbols: DataFrame, value: str) -> DataFrame:
    """The symbol that an id or name means: an exact one (least id), else the shortest name that holds the value."""
    exact = symbols.where(graph.matches(F.col("id"), F.col("name"), value)).withColumn("rank", F.lit(0))
    fuzzy = symbols.where(F.col("name").contains(value)).withColumn("rank", F.lit(1))
    best = exact.unionByName(fuzzy).orderBy("rank", F.when(F.col("rank") == 1, F.length("name")).otherwise(0), "id").limit(1)
    return best.withColumn("exact", F.col("rank") == 0).drop("rank")


def did_you_mean(symbols: DataFrame, value: str, most: int = 5, pool: int | None = None) -> DataFrame:
    """(name, distance): the distinct names nearest to the value; ``pool`` bounds the names looked at."""
    names = symbols.select("name").distinct()
    if pool is not None:
        names = names.orderBy("name").limit(pool)
    return names.select("name", F.levenshtein("name", F.lit(value)).alias("distance")).orderBy("distance", "name").limit(most)


def augment_candidates(symbols: DataFrame, terms: list[str], scan: int | None = 50, most: int = 3) -> DataFrame:
    """(id, name): the shortest names among symbols that hold a term, without regard to case."""
    if not terms:
        return symbols.select("id", "name").limit(0)
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.lower("name").contains(t.lower())
    found = symbols.where(hit).select("id", "name")
    if scan is not None:
        found = found.orderBy("id").limit(scan)
    return found.dropDuplicates(["id"]).orderBy(F.length("name"), "id").limit(most)


def dependency_by_alias(dependencies: DataFrame, value: str) -> DataFrame:
    """The external dependency with the shortest name whose name or alias holds the value."""
    low = value.lower()
    hit = F.lower("name").contains(low) | F.exists("aliases", lambda a: F.lower(a).contains(low))
    return dependencies.where(hit).orderBy(F.length("name"), "id").limit(1)


def semantic_topk(embeddings: DataFrame, query: list[float], k: int = 10, threshold: float = fixed.SIMILAR) -> DataFrame:
    """(symbol_id, score): the k nearest by cosine from a threshold on, ties by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = embeddings.select("symbol_id", graph.cosine(F.col("embedding"), q).alias("score"))
    return scored.where(F.col("score") >= threshold).orderBy(F.desc("score"), "symbol_id").limit(k)


def classify_by_reference(embeddings: DataFrame, references: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(symbol_id, category, score): the reference (category, vector) nearest by cosine, or unknown below the threshold.

    References are a handful of fixed texts' vectors and go to every task; more than 64 raise.
    """
    few = references.orderBy("category").limit(65).collect()
    if len(few) > 64:
        raise ValueError("more than 64 references")
    refs = F.array(*[F.struct(F.lit(r.category).alias("category"), F.array(*[F.lit(float(x)) for x in r.vector]).alias("v")) for r in few])
    scored = F.transform(refs, lambda r: F.struct(graph.cosine(F.col("embedding"), r["v"]).alias("score"), r["category"].alias("category")))
    best = embeddings.select("symbol_id", F.array_max(scored).alias("b"))
    return best.select("symbol_id", F.when(F.col("b.score") >= threshold, F.col("b.category")).otherwise("unknown").alias("category"), F.col("b.score").alias("score"))


def hash_embedding(words: Column, dims: int = 64) -> Column:
    """A deterministic unit vector from hashed words, for places without a model."""
    slots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dims)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(counts, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))


def safe_embedding_text(rows: DataFrame, column: str, longest: int = 100_000) -> DataFrame:
    """Rows whose text may be embedded: not empty, not too long, no code and no absolute path."""
    c = F.col(column)
    return rows.where(c.isNotNull() & (c != "") & (F.length(c) <= longest) & text.privacy_problem(c).isNull())

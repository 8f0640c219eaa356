"""Language ID by unigrams over a public vocabulary, summed over all segmentations.

Each language has a probability for every piece of a fixed SentencePiece vocabulary.
The probability of a word is the sum over all ways to cut it into pieces, found by a
forward pass; a document's score is the product over its words.  The probabilities are
learned by expectation maximisation: forward and backward passes give the expected
number of uses of every piece.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import beside, give_back, held, small_batches, text_steps
from codeloom.llm.sentencepiece_offsets import fields
from codeloom.llm.textkernel import LETTERS, LOWER, PrefixHash, WordTable, mix64, runs

UNDETERMINED = "und"
#: Positions after which the passes rescale their sums, which would vanish in longer words.
RESCALE = 32
#: Characters in a block of long words, or one word, whose lattice is held at a time.
BLOCK = 1 << 18
#: Languages whose tables are held at a time; short words in a block.
LANGUAGES, SHORT_WORDS = 8, 1 << 14
_FILTER = 1 << 22


class Pieces:
    """The vocabulary's pieces, lower-cased, and where they lie in words."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            pieces = {dict(fields(v)).get(1, b"").decode() for k, v in fields(f.read()) if k == 1 and dict(fields(v)).get(3, 1) == 1}
        keep = sorted({p.lower() for p in pieces if p.replace("▁", "", 1).isalpha() or p == "▁"})
        self.longest = max(map(len, keep))
        self.codes = mix64(np.arange(0x110000, dtype=np.uint64))
        chars = np.frombuffer("".join(keep).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(p) for p in keep])
        hashes = PrefixHash(self.codes[chars]).of(np.append(0, ends[:-1]), ends)
        order = np.argsort(hashes)
        self.hashes, self.size = hashes[order], len(keep) + 1  # the last stands for any other character
        self.seen = np.zeros(_FILTER, bool)
        self.seen[self.hashes & np.uint64(_FILTER - 1)] = True

    def lattice(self, words: list[str]) -> tuple[np.ndarray, list[list[tuple[int, np.ndarray, np.ndarray]]], int]:
        """Lengths, and for each end position (piece length, words, pieces) of all pieces that end there.

        Words are sorted by length, longest first.
        """
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        n = np.array([len(w) for w in words], np.int64)
        prefix = PrefixHash(self.codes[chars])
        most = int(n[0]) if len(n) else 0
        word = np.repeat(np.arange(len(n)), n)
        end = np.arange(1, len(chars) + 1)
        place = end - np.repeat(np.cumsum(n) - n, n)
        order = np.lexsort((word, place))  # by end position, then by word
        word, end, place = word[order], end[order], place[order]
        steps: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(most + 1)]
        for k in range(1, min(most, self.longest) + 1):
            at = np.flatnonzero(place >= k)
            h = prefix.of(end[at] - k, end[at])
            some = self.seen[h & np.uint64(_FILTER - 1)]
            p = np.full(len(h), self.size - 1)
            q = np.minimum(np.searchsorted(self.hashes, h[some]), len(self.hashes) - 1)
            p[some] = np.where(self.hashes[q] == h[some], q, self.size - 1)
            if k > 1:
                at, p = at[p < self.size - 1], p[p < self.size - 1]
            w, where = word[at], place[at]
            new = np.flatnonzero(np.append(True, where[1:] != where[:-1])) if len(where) else where
            for a, b in zip(new.tolist(), [*new[1:].tolist(), len(where)], strict=False):
                steps[where[a]].append((k, w[a:b], p[a:b]))
        return n, steps, most


def blocks(words: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Words with their starts marked, longest first, and their numbers, in blocks.

    Lengths in a block of long words differ by a factor of two at most, so that a table
    of its words by positions is at most twice its characters.
    """
    cut = sorted((("▁" + w, i) for i, w in enumerate(words)), key=lambda x: -len(x[0]))
    a = 0
    while a < len(cut):
        longest = len(cut[a][0])
        b = len(cut)
        if longest > RESCALE:
            b = bisect_left(cut, -max(longest // 2, RESCALE), a, key=lambda x: -len(x[0]))
            b = min(max(b, a + 1), a + max(1, BLOCK // longest))
        b = min(b, a + SHORT_WORDS)
        yield [x for x, _ in cut[a:b]], np.array([i for _, i in cut[a:b]], np.int64)
        a = b


def letters_only(word: bytes) -> str:
    text = word.decode("utf-8", "replace").lower()
    return text if text.isalpha() else "".join(c for c in text if c.isalpha())


def forward(pieces: Pieces, words: list[str], p: np.ndarray) -> np.ndarray:
    """Log probability of each word by language; ``p`` is pieces by languages, of which few are taken at a time."""
    if p.shape[1] > LANGUAGES:
        return np.column_stack([forward(pieces, words, p[:, k : k + LANGUAGES]) for k in range(0, p.shape[1], LANGUAGES)])
    out = np.zeros((len(words), p.shape[1]))
    for cut, owner in blocks(words):
        n, steps, most = pieces.lattice(cut)
        rows = pieces.longest + 1  # a position's row is taken again when no piece reaches back to it
        alpha = np.zeros((rows, len(cut), p.shape[1]))
        alpha[0] = 1
        scale = np.zeros((len(cut), p.shape[1]))
        done = len(cut)
        for i in range(1, most + 1):
            here = alpha[i % rows]
            here[:done] = 0
            for k, w, q in steps[i]:
                here[w] += alpha[(i - k) % rows, w] * p[q]
            live = int(np.searchsorted(-n, -i, "left"))  # longer than i
            out[owner[live:done]] = np.log(here[live:done]) + scale[live:done]
            done = live
            if i % RESCALE == 0 and live:
                by = here[:live].copy()
                alpha[:, :live] /= by
                scale[:live] += np.log(by)
    return out


def _uses(pieces: Pieces, cut: list[str], weight: np.ndarray, p: np.ndarray, lattice: tuple) -> np.ndarray:
    """Expected uses of the pieces by language, in a block of words with the weights.

    Forward sums are rescaled at every ``RESCALE`` positions and backward sums by the same
    factors, so that their product, over the word's whole sum, is what it is without.
    """
    n, steps, most = lattice
    size, langs = p.shape
    alpha, beta = np.zeros((most + 1, len(cut), langs)), np.zeros((most + 1, len(cut), langs))
    alpha[0] = 1
    factors: dict[int, np.ndarray] = {}
    for i in range(1, most + 1):
        for k, w, q in steps[i]:
            # a piece that comes from before a rescaled position takes its factor
            alpha[i, w] += _across(alpha[i - k, w], factors, i - k, i, w) * p[q]
        if i % RESCALE == 0 and i < most:
            live = int(np.searchsorted(-n, -i, "left"))
            factors[i] = alpha[i, :live].copy()
            alpha[i, :live] = 1
    index = np.arange(len(cut))
    beta[n, index] = 1
    share = weight / alpha[n, index]
    used = np.zeros((size, langs))
    for i in range(most, 0, -1):
        if i in factors:
            beta[i, : len(factors[i])] /= factors[i]
        for k, w, q in steps[i]:
            flow = _across(beta[i, w], factors, i - k, i, w) * p[q]
            beta[i - k, w] += flow
            for c in range(langs):
                used[:, c] += np.bincount(q, flow[:, c] * alpha[i - k, w, c] * share[w, c], size)
    return used


def _across(x: np.ndarray, factors: dict[int, np.ndarray], a: int, b: int, w: np.ndarray) -> np.ndarray:
    """``x`` over the factors of the positions strictly between ``a`` and ``b``."""
    m = (a // RESCALE + 1) * RESCALE
    while m < b:
        if m in factors:
            x = x / factors[m][w]
        m += RESCALE
    return x


def expectation_maximisation(pieces: Pieces, words: list[str], counts: np.ndarray, rounds: int = 3, smoothing: float = 0.01) -> np.ndarray:
    """Piece probabilities by language from word counts by language."""
    size, langs = pieces.size, counts.shape[1]
    if langs > LANGUAGES:
        return np.column_stack([expectation_maximisation(pieces, words, counts[:, k : k + LANGUAGES], rounds, smoothing) for k in range(0, langs, LANGUAGES)])
    p = np.full((size, langs), 1 / size)
    for _ in range(rounds):  # lattices are made again each time, so that one block's is held
        used = sum((_uses(pieces, cut, counts[owner], p, pieces.lattice(cut)) for cut, owner in blocks(words)), np.zeros((size, langs)))
        used += smoothing
        p = used / used.sum(0)
    return p


def train(rows: list[tuple[str, str]], vocabulary: str) -> tuple[list[str], np.ndarray]:
    """The sorted languages and the piece probabilities from (text, language) rows."""
    langs = sorted({y for _, y in rows})
    table: dict[str, Counter] = {}
    for text, lang in rows:
        data = LOWER[np.frombuffer(text.encode(), np.uint8)]
        raw = data.tobytes()
        starts, ends = runs(LETTERS[data], np.array([0, len(data)])) if len(data) else ([], [])
        for w, c in Counter(raw[s:e] for s, e in zip(starts, ends, strict=True)).items():
            table.setdefault(letters_only(w), Counter())[lang] += c
    table.pop("", None)
    if not table:
        return [], np.zeros((0, 0))
    counts = np.array([[c[x] for x in langs] for c in table.values()], float)
    p = expectation_maximisation(Pieces(vocabulary), list(table), counts)
    del table, counts
    give_back()
    return langs, p


#: Shares of the tasks whose best rows are ranked before those of all.
_SHARES = 16


def sample(docs: DataFrame, learn: Column, per_language: int = 200, most_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """At most ``per_language`` (text, language) rows of each language with ``most_bytes`` of its text, where ``learn`` holds.

    The rows with the smallest hashes of their id are taken, which does not depend on how
    the table is split, and of rows of one id and language the one whose text has the
    smallest hash; texts that would go beyond the bound of bytes are left out.  Only ids
    and hashes are ranked, so that texts are not shuffled.
    """
    from pyspark.sql import Window

    known = docs.where(learn & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("i"), F.col(lang_col).cast("string").alias("y"), F.col(text_col).cast("string").alias("t"))
    order = Window.partitionBy("y").orderBy("h", "i")
    ids = known.groupBy("y", "i").agg(F.min(F.struct(F.xxhash64("t").alias("p"), F.octet_length("t").alias("n"))).alias("x")).select("y", "i", "x.p", "x.n", F.xxhash64("i", F.lit(17)).alias("h"))
    # first the best of a few shares of the tasks: what one task then ranks does not grow with the number of tasks
    some = ids.withColumn("share", F.pmod(F.spark_partition_id(), F.lit(_SHARES)))
    some = some.withColumn("r", F.row_number().over(Window.partitionBy("y", "share").orderBy("h", "i"))).where(F.col("r") <= per_language)
    best = some.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language)
    best = best.withColumn("held", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("held") <= most_bytes)
    chosen = known.sparkSession.createDataFrame(best.select("y", "i", "p").collect(), "y string, i string, p long")  # per_language rows a language
    picked = known.withColumn("p", F.xxhash64("t")).join(F.broadcast(chosen), ["y", "i", "p"], "left_semi").dropDuplicates(["y", "i"])
    return [(r.t, r.y) for r in picked.select("t", "y").collect()]


def predict(docs: DataFrame, langs: list[str], p: np.ndarray, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """doc_id, lang_pred and score (the language's share of the probability, 0 to 1); with ``keep_columns`` after all columns of ``docs``, in place of any of those names.

    ``lang_pred`` is ``und`` with score 0 where the text is null or has no letter, or where
    nothing was learned.  Ties go to the language that sorts first.  Repeated rows are
    scored each for itself; an empty table gives no rows.  Only the text is used.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast((langs, p))  # vocabulary size times the number of languages
    token = (vocabulary, uuid.uuid4().hex)

    def table() -> WordTable:
        def make() -> WordTable:
            pieces = Pieces(vocabulary)
            return WordTable(lambda words: forward(pieces, [letters_only(w) for w in words], model.value[1]), len(langs))

        return held(token, make)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            names, scores = [], []
            for i, j, data, offsets in text_steps(texts):
                if not langs:
                    names += [UNDETERMINED] * (j - i)
                    scores.append(np.zeros(j - i))
                    continue
                total = table().sums(data, offsets)
                best = total.argmax(1)
                share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                low = LOWER[data]
                letters = np.append(0, np.cumsum((low >= 97) & (low <= 122)))
                plain = letters[offsets[1:]] > letters[offsets[:-1]]
                for k in range(j - i):
                    lettered = plain[k] or any(c.isalpha() for c in data[offsets[k] : offsets[k + 1]].tobytes().decode())
                    names.append(langs[best[k]] if lettered else UNDETERMINED)
                    share[k] *= lettered
                scores.append(share)
            columns = batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], [*batch.schema.names[:-1], "lang_pred", "score"])
        give_back()

    own = [F.col(f"`{c}`") for c in beside(docs, ("lang_pred", "score"))] if keep_columns else [F.col(id_col).cast("long").alias("doc_id")]
    rows = docs.select(*own, F.col(text_col).cast("string").alias(token[1]))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "lang_pred string", "score double"])
    return rows.mapInArrow(run, schema)

"""Quality rules as a ledger of failure bits.

Every rule is evaluated once; the ledger keeps the measurements and one bit per rule
that failed.  Policies are versioned sets of bits, applied to the stored bits with one
AND, and ablations are sums over bits, with no text read again.  Everything here is a
DataFrame expression on one row at a time: no shuffle, no Python on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bit by rule name; numbers are never given anew, new rules take new bits.
BITS = {"too_few_words": 0, "repeated_windows": 1, "symbols": 2, "duplicate_lines": 3, "long_words": 4}
BASE = ("too_few_words", "repeated_windows")
#: Policies by version; a document is kept if it fails none of the rules.
POLICIES = {1: BASE, 2: (*BASE, "symbols", "duplicate_lines"), 3: tuple(BITS)}
_SPACES = r"[\x20\x09-\x0D]+"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, _SPACES), lambda w: w != "")


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words inside windows of ``width`` words that the array holds at least twice.

    Windows are compared by 64-bit hashes.  Sorted (hash, place) pairs bring equal
    windows together; the places found, sorted, cover min(width, gap) words each.
    """
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.struct(F.xxhash64(F.slice(words, i + 1, width)).alias("h"), i.alias("i")))

    def places(pairs: Column) -> Column:
        none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
        same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
        m = F.size(pairs)
        left = F.zip_with(pairs, F.concat(none, F.slice(pairs, 1, m - 1)), lambda a, b: F.struct(a["i"].alias("i"), same(a, b).alias("l")))
        right = F.zip_with(pairs, F.concat(F.slice(pairs, 2, m), none), same)
        flagged = F.zip_with(left, right, lambda a, r: F.when(a["l"] | r, a["i"]))
        return F.array_sort(F.filter(flagged, lambda i: i.isNotNull()))

    def covered(at: Column) -> Column:
        m = F.size(at)
        gaps = F.zip_with(F.slice(at, 2, m), F.slice(at, 1, m - 1), lambda b, a: F.least(b - a, F.lit(width)))
        return F.when(m > 0, F.aggregate(gaps, F.lit(width).cast("long"), lambda s, g: s + g)).otherwise(F.lit(0).cast("long"))

    return F.when(n > width, bound(F.array_sort(windows), lambda pairs: bound(places(pairs), covered))).otherwise(F.lit(0).cast("long"))


def measurements(text: Column) -> Column:
    """A struct of all that the rules need from a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))

    def of(words: Column) -> Column:
        chars = F.aggregate(words, F.lit(0).cast("long"), lambda s, w: s + F.char_length(w))
        return F.struct(F.size(words).cast("long").alias("n_words"), chars.alias("word_chars"), repeated_words(words).alias("n_repeat_words"))

    def lines(found: Column) -> Column:
        return F.struct(F.size(found).cast("long").alias("n_lines"), (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"))

    symbols = F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long")
    held = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.struct(bound(words_of(text), of).alias("w"), bound(held, lines).alias("l"), symbols.alias("n_symbols"))


def ledger(docs: DataFrame, text_col: str = "text", min_words: int = 10, repeat_percent: int = 20, symbol_percent: int = 40, dup_line_percent: int = 50, mean_word_chars: int = 40) -> DataFrame:
    """All columns of ``docs`` and, after them, a struct ``quality``: n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words and failures, the bits of the rules that failed.

    Null texts have no words and fail ``too_few_words``.  Rows are judged each for
    itself, so repeated rows agree; a column ``quality`` of ``docs`` is replaced.
    """
    m = measurements(F.col(text_col).cast("string"))

    def judged(x: Column) -> Column:
        n, repeat, chars, dup, lines, symbols = x["w"]["n_words"], x["w"]["n_repeat_words"], x["w"]["word_chars"], x["l"]["n_dup_lines"], x["l"]["n_lines"], x["n_symbols"]
        fails = {
            "too_few_words": n < min_words,
            "repeated_windows": repeat * 100 > n * repeat_percent,
            "symbols": symbols * 100 > n * symbol_percent,
            "duplicate_lines": (lines > 3) & (dup * 100 > lines * dup_line_percent),
            "long_words": chars > n * mean_word_chars,
        }
        bits = F.lit(0).cast("long")
        for name, bit in BITS.items():
            bits = bits + F.when(fails[name], F.lit(1 << bit)).otherwise(F.lit(0)).cast("long")
        return F.struct(n.alias("n_words"), chars.alias("word_chars"), symbols.alias("n_symbols"), dup.alias("n_dup_lines"), lines.alias("n_lines"), repeat.alias("n_repeat_words"), bits.alias("failures"))

    return docs.withColumn("quality", bound(m, judged))


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << BITS[r] for r in rules)


def keeps(failures: Column, version: int = 3) -> Column:
    """Whether a row with these failure bits is kept under a policy."""
    return failures.bitwiseAND(F.lit(mask(POLICIES[version])).cast("long")) == 0


def ablation(judged: DataFrame, version: int = 3) -> DataFrame:
    """One row per rule of the policy: rule, n_failed, n_only (rows that fail no other rule of it), n_dropped (under the whole policy).

    Only counts by failure mask are shuffled, at most 2 ** (number of rules) rows a task.
    """
    whole = mask(POLICIES[version])
    own = F.col("quality.failures").bitwiseAND(F.lit(whole).cast("long"))
    by_mask = judged.groupBy(own.alias("m")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << BITS[r]).cast("long").alias("b")) for r in POLICIES[version]])
    rows = by_mask.select("m", "n", F.explode(rules).alias("r")).select("m", "n", "r.rule", "r.b")
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).alias
    return rows.groupBy("rule").agg(total(F.col("m").bitwiseAND(F.col("b")) != 0)("n_failed"), total(F.col("m") == F.col("b"))("n_only"), total(F.col("m") != 0)("n_dropped"))

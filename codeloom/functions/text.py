"""Column expressions on names, texts and paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions import fixed

_ASCII_SPACE = r"[\s ﻿]+"


def split_identifier(name: Column) -> Column:
    """Words of an identifier in lower case: parts by _ and -, camel humps, runs of capitals; one letter is no word."""
    spaced = F.regexp_replace(name, "[_-]", " ")
    spaced = F.regexp_replace(spaced, "([a-z0-9])([A-Z])", "$1 $2")
    spaced = F.regexp_replace(spaced, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.transform(F.split(spaced, r"\s+"), F.lower), lambda w: F.length(w) > 1)


def keywords(name: Column, signature: Column | None = None) -> Column:
    """Distinct words of a name and of the identifiers in a signature, without stop words, in order."""
    words = split_identifier(name)
    if signature is not None:
        found = F.regexp_extract_all(F.coalesce(signature, F.lit("")), F.lit("[a-zA-Z_][a-zA-Z0-9_]*"), 0)
        words = F.concat(words, F.flatten(F.transform(found, split_identifier)))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*fixed.STOP_WORDS)))


def preprocess(text: Column) -> Column:
    """Lower case, punctuation to spaces, white space to one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^A-Za-z0-9_\s]", " "), _ASCII_SPACE, " "))


def sanitize(text: Column) -> Column:
    """The text without patterns of injection, white space to one space; null gives the empty text."""
    clean = reduce(lambda x, p: F.regexp_replace(x, p, ""), fixed.MALICIOUS, F.coalesce(text, F.lit("")))
    return F.trim(F.regexp_replace(clean, _ASCII_SPACE, " "))


def is_safe_path(path: Column) -> Column:
    """A relative path that leaves no directory and holds no odd character."""
    bad = reduce(lambda a, p: a | path.rlike(p), fixed.BAD_PATHS, F.lit(False))
    return F.coalesce((path != "") & ~bad & ~F.array_contains(F.split(path, "/"), ".."), F.lit(False))


def has_source_code(text: Column) -> Column:
    """Whether a text looks like code, not like a signature."""
    return reduce(lambda a, p: a | text.rlike(p), fixed.SOURCE_CODE, F.lit(False))


def privacy_problem(text: Column) -> Column:
    """Why a text must not leave the machine: source_code, absolute_path or null."""
    return F.when(has_source_code(text), "source_code").when(text.rlike(f"(?i){fixed.ABSOLUTE_PATH}"), "absolute_path")


def redact_paths(text: Column) -> Column:
    return F.regexp_replace(text, f"(?i){fixed.ABSOLUTE_PATH}", "$1[PATH]/")


def folder(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/")


def symbol_text(kind: Column, name: Column, path: Column, signature: Column, documentation: Column, visibility: Column, modifiers: Column) -> Column:
    """The text that a symbol is embedded by."""
    line = lambda label, x, use: F.when(use, F.concat(F.lit(f"{label}: "), x))
    some = lambda x: F.coalesce(x != "", F.lit(False))
    return F.concat_ws(
        "\n",
        F.concat(kind, F.lit(": "), redact_paths(name)),
        line("module", redact_paths(folder(path)), F.coalesce(path.contains("/"), F.lit(False))),
        line("signature", redact_paths(signature), some(signature)),
        line("docs", redact_paths(documentation), some(documentation)),
        line("visibility", visibility, F.lit(True)),
        line("modifiers", F.array_join(modifiers, ", "), F.size(F.coalesce(modifiers, F.array().cast("array<string>"))) > 0),
    )


def cluster_text(name: Column, category: Column, confidence: Column, symbols: Column) -> Column:
    """The text that a cluster is embedded by; ``symbols`` is an array of structs kind, name, file_path."""
    detail = F.transform(symbols, lambda s: F.concat_ws(" ", s["kind"], redact_paths(s["name"]), F.when(s["file_path"].isNotNull(), F.concat(F.lit("("), redact_paths(folder(s["file_path"])), F.lit(")")))))
    words = lambda s: F.filter(F.split(F.lower(redact_paths(s["name"])), r"[_\-\s/\\]+"), lambda w: (F.length(w) > 3) & w.rlike("^[a-z0-9]+$"))
    tags = F.array_distinct(F.flatten(F.transform(symbols, lambda s: F.concat(words(s), F.array(s["kind"])))))
    some = F.size(symbols) > 0
    return F.concat_ws(
        "\n",
        F.concat(F.lit("cluster: "), redact_paths(name)),
        F.concat(F.lit("category: "), redact_paths(category)),
        F.concat(F.lit("confidence: "), F.format_string("%.2f", confidence.cast("double"))),
        F.when(some, F.concat(F.lit("symbols: "), F.array_join(detail, ", "))),
        F.when(some, F.concat(F.lit("tags: "), F.array_join(tags, ", "))),
    )


def slugify(text: Column) -> Column:
    """Lower case, other runs than letters and digits to one -, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def intent(text: Column) -> Column:
    """Name of the query's intent."""
    out = F.when(F.lit(False), F.lit(None))
    for name, pattern, _ in fixed.INTENTS:
        out = out.when(text.rlike(f"(?i){pattern}"), name)
    return out.otherwise(fixed.OTHER_INTENT[0])


def intent_confidence(name: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("double"))
    for other, _, confidence in fixed.INTENTS:
        out = out.when(name == other, F.lit(confidence))
    return out.otherwise(fixed.OTHER_INTENT[1])


def target(text: Column) -> Column:
    """The first quoted part, else the last identifier, else the text."""
    quoted = F.regexp_extract(text, "[\"'`]([^\"'`]+)[\"'`]", 1)
    names = F.regexp_extract_all(text, F.lit(r"\b[A-Za-z_][A-Za-z0-9_]*\b"), 0)
    return F.when(quoted != "", quoted).when(F.size(names) > 0, F.element_at(names, -1)).otherwise(F.trim(text))


def mentioned_paths(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\S+\.\w+"), 0)


def bare_type(name: Column) -> Column:
    """A type's own name: one generic argument unwrapped, the last dotted part."""
    inner = F.regexp_extract(name, r"^[A-Za-z_][\w.]*<\s*([A-Za-z_][\w.]*)", 1)
    one = F.when(inner != "", inner).otherwise(F.regexp_extract(name, r"^\s*([A-Za-z_][\w.]*)", 1))
    return F.element_at(F.split(one, r"\."), -1)


def returned_type(signature: Column) -> Column:
    """The type after ): or -> in a signature; null if none."""
    a, b = F.regexp_extract(signature, r"\)\s*:\s*([\w<>\[\]|&\s]+)", 1), F.regexp_extract(signature, r"->\s*([\w<>\[\]|&\s]+)", 1)
    return F.when(a != "", F.trim(a)).when(b != "", F.trim(b))


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 20))


def safe_regex(name: str) -> str:
    """A pattern for the name as a whole word."""
    special = set(r".*+?^${}()|[]\\")
    return r"\b" + "".join("\\" + c if c in special else c for c in name) + r"\b"


def searched_pattern(tool: str, arguments: dict) -> str | None:
    """What a search tool's call looks for: the pattern of grep and glob calls, and of grep-like commands in a shell line.

    A glob gives the words of its last part; patterns of fewer than three letters give none.
    """
    import re
    import shlex

    found: str | None = None
    if tool in ("grep", "glob"):
        found = arguments.get("pattern")
        if tool == "glob" and found:
            found = re.sub(r"[*?\[\]{}]|\.\w+$", " ", found.rsplit("/", 1)[-1]).strip()
    elif tool == "bash":
        try:
            words = shlex.split(arguments.get("command", ""))
        except ValueError:
            words = arguments.get("command", "").split()
        for i, w in enumerate(words):
            if w.rsplit("/", 1)[-1] in ("grep", "rg", "ag", "ack", "git-grep"):
                found = next((x for x in words[i + 1 :] if not x.startswith("-")), None)
                break
    found = re.sub(r"\\[bBwWsSdD]|[\\^$().*+?|\[\]{}]", " ", found or "").strip()
    return found if len(re.findall(r"[A-Za-z]", found)) >= 3 else None

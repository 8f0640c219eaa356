"""Column expressions on import paths and packages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions import fixed


def trimmed(path: Column) -> Column:
    return F.regexp_replace(F.trim(path), "^[\"'<]+|[\">']+$", "")


def is_external(path: Column, language: Column) -> Column:
    """An import of something outside the tree."""
    p = trimmed(path)
    own = p.rlike(r"^(\./|\.\./|/|\.\\|\.\.\\)") | p.startswith("node:")
    own = own | ((language == "rust") & p.rlike("^(crate|super|self)::")) | (language.isin("c", "cpp") & p.isin(*fixed.SYSTEM_HEADERS))
    return F.coalesce((p != "") & ~own, F.lit(False))


def _parts(path: Column, by: str) -> Column:
    return F.filter(F.transform(F.split(path, by), lambda x: F.trim(x)), lambda x: x != "")


def package_name(path: Column, language: Column) -> Column:
    """The package that an import path belongs to, by the language's rule."""
    p = trimmed(path)

    def first(by: str, n: Column | int) -> Column:
        parts = _parts(p, by)
        joined = F.array_join(F.slice(parts, 1, n), {r"\.": ".", "/": "/"}.get(by, ""))
        return F.when(F.size(parts) > 0, joined).otherwise(p)

    header = F.regexp_replace(p, r"\.[^.]+$", "")
    header = F.coalesce(F.get(_parts(header, "/"), F.lit(0)), header)
    name = (
        F.when(language == "php", first(r"\\", 1))
        .when(language.isin("java", "csharp"), first(r"\.", 2))
        .when(language == "go", first("/", 3))
        .when(language == "rust", first("::", 1))
        .when(language.isin("c", "cpp"), header)
        .when(language.isin("typescript", "javascript") & p.startswith("@"), first("/", 2))
        .otherwise(first("/", 1))
    )
    return F.when(p == "", F.lit("unknown")).otherwise(F.regexp_replace(name, r"[./\\:]+$", ""))


def aliases(name: Column) -> Column:
    """The name, in camel case, in Pascal case, and without separators; distinct, in this order."""
    parts = F.filter(F.split(name, r"[-_.\\/:\s]+"), lambda x: x != "")
    hump = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 20)))
    pascal = F.array_join(F.transform(parts, hump), "")
    camel = F.when(F.size(parts) > 0, F.concat(F.lower(F.get(parts, F.lit(0))), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), hump), ""))).otherwise(name)
    return F.array_distinct(F.filter(F.array(name, camel, pascal, F.regexp_replace(name, r"[-_.\\/:\s]", "")), lambda x: x != ""))


def ecosystem(language: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None))
    for k, v in fixed.ECOSYSTEMS.items():
        out = out.when(language == k, v)
    return out.otherwise("unknown")

"""Column expressions on symbols: predicates, layers, roles, risks, confidences, identity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions import fixed


def _any(name: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, p: a | name.rlike(p), patterns, F.lit(False))


def is_exported(visibility: Column, kind: Column) -> Column:
    return (visibility == "public") | (kind == "export")  # F13


def is_entry_name(name: Column) -> Column:
    return _any(name, fixed.ENTRY_POINT_NAMES)  # F14


def is_utility_name(name: Column) -> Column:
    return _any(name, fixed.UTILITY_NAMES)  # F15


def is_core(name: Column) -> Column:
    return name.rlike(fixed.CORE_COMPONENT)  # F16


def matches(id_: Column, name: Column, value: str) -> Column:
    """An id or a name equals the value (F1)."""
    return (id_ == value) | (name == value)


def symbol_id(path: Column, name: Column, line: Column, column: Column) -> Column:
    return F.concat_ws(":", path, name, line.cast("string"), column.cast("string"))


def logical_key(path: Column, qualified: Column, kind: Column, ordinal: Column) -> Column:
    """A key that does not hold the position."""
    return F.sha1(F.concat_ws("\u0000", path, qualified, kind, ordinal.cast("string")))


def rel_type_of_label(label: Column) -> Column:
    """A table's label to the relation: the whole name counts, without a prefix in lower case."""
    name = F.regexp_replace(label, "^[a-z][a-z0-9_]*_(?=[A-Z])", "")
    out = F.when(F.lit(False), F.lit(None))
    for rel in fixed.RELATIONS:
        snake = "".join("_" + c if c.isupper() else c for c in rel).upper()
        out = out.when(name == snake, rel)
    return out.when(name == "HAS_STEP", "contains").otherwise("references")


def entry_score(name: Column, public: Column, callers: Column, callees: Column) -> Column:
    """How likely a symbol starts a flow."""
    factor = F.when(is_utility_name(name), fixed.UTILITY_FACTOR).when(is_entry_name(name), fixed.ENTRY_FACTOR).otherwise(1.0)
    return F.when(callees == 0, F.lit(0.0)).otherwise(callees / (callers + 1) * F.when(public, fixed.EXPORT_FACTOR).otherwise(1.0) * factor)


def framework(path: Column) -> Column:
    """The framework that a path tells, or null."""
    p = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(F.lower(path), r"\\", "/"), "^/", ""))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, parts, ends in fixed.FRAMEWORK_PATHS:
        within = reduce(lambda a, x: a | p.contains(x), parts, F.lit(not parts))
        ending = reduce(lambda a, x: a | p.endswith(x), ends, F.lit(not ends))
        out = out.when(within & ending, name)
    return out


def layer(name: Column, path: Column, signature: Column, framework_hint: Column | None = None) -> Column:
    """The first layer that a pattern of the framework finds in name, path and signature; else unknown."""
    text = F.lower(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(path, F.lit("")), F.coalesce(signature, F.lit(""))))
    kind = framework(path) if framework_hint is None else F.coalesce(F.lower(framework_hint), framework(path))
    kind = F.when(kind.isin(*fixed.LAYER_PATTERNS), kind).otherwise("generic")

    def first(x: Column) -> Column:
        out = F.when(F.lit(False), F.lit(None))
        for own, patterns in fixed.LAYER_PATTERNS.items():
            for where, pattern in zip(fixed.LAYERS, patterns, strict=True):
                out = out.when((x["kind"] == own) & x["text"].rlike(pattern), where)
        return out.otherwise("unknown")

    # framework and text are worked out once, not in each of the branches
    return F.transform(F.array(F.struct(kind.alias("kind"), text.alias("text"))), first)[0]


def layer_rank(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, fixed.LAYERS)), name).cast("int")


def role(callers: Column, callees: Column) -> Column:
    """A node's part in the graph by its degrees."""
    skewed = ((callers <= 2) & (callees > 5)) | ((callees <= 2) & (callers > 5))
    return F.when((callers == 0) & (callees == 0), "Isolated").when(callers == 0, "EntryPoint").when(callees == 0, "Utility").when(skewed, "Adapter").otherwise("CoreLogic")


def affected_confidence(hops: Column, rel: Column, role_: Column, exported: Column) -> Column:
    """Trust that a change reaches a node."""
    base = 0.95 - (F.greatest(hops, F.lit(1)) - 1) * 0.12
    base = base - F.when(rel.isin("calls", "references", "imports"), 0.0).otherwise(0.1)
    base = base - F.when(role_ == "Isolated", F.when(exported, 0.15).otherwise(0.35)).otherwise(0.0)
    return F.least(F.greatest(base, F.lit(0.0)), F.lit(1.0))


def affected_reasons(hops: Column, rel: Column, role_: Column, callers: Column, callees: Column, exported: Column) -> Column:
    """The reasons beside it, as texts."""
    strong = rel.isin("calls", "references", "imports")
    degrees = F.format_string("%d in, %d out", callers, callees)
    return F.array_compact(
        F.array(
            F.when(hops <= 1, "distance: calls the target itself").otherwise(F.format_string("distance: %d calls away", hops)),
            F.concat(F.lit("edge: "), rel, F.when(strong, F.lit("")).otherwise(F.lit(", containment only"))),
            F.concat(F.lit("role: "), role_, F.lit(", "), degrees),
            F.when(exported, "scope: exported, may have users that are not indexed").when(role_ == "Isolated", "scope: unlinked, may be loaded by name"),
        )
    )


def risk(affected: Column, core: Column) -> Column:
    """Risk of a change by what it affects."""
    return F.when(core, "critical").when(affected >= 11, "high").when(affected >= 3, "medium").otherwise("low")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where lengths differ or a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), F.lit(0.0)).otherwise(dot(a, b) / norms)


def search_confidence(average: Column, structural: Column) -> Column:
    """Mean score, a little more with structural support, between 0.5 and 1."""
    return F.least(F.greatest(average + F.when(structural, 0.05).otherwise(0.0), F.lit(0.5)), F.lit(1.0))


def resolved_confidence(top: Column, rate: Column) -> Column:
    """Of the top score and the share of hits that were resolved."""
    return F.least(F.greatest(0.6 * top + 0.4 * rate, F.lit(0.5)), F.lit(0.99))


def verdict(found: Column, dynamic: Column) -> Column:
    """present, absent or uncertain: absence beside dynamic access proves nothing."""
    return F.when(found, "present").when(dynamic, "uncertain").otherwise("absent")


def verdict_confidence(verdict_: Column) -> Column:
    return F.when(verdict_ == "present", fixed.PRESENT).when(verdict_ == "absent", fixed.ABSENT).otherwise(fixed.UNCERTAIN)


def tokens(name: Column, signature: Column, path: Column, lines: Column) -> Column:
    """Estimated tokens of a symbol: a quarter of its characters, 40 for each of its lines, at least one."""
    size = F.length(F.coalesce(name, F.lit(""))) + F.length(F.coalesce(signature, F.lit(""))) + F.length(F.coalesce(path, F.lit(""))) + 40 * F.greatest(lines, F.lit(1))
    return F.ceil(size / 4).cast("long")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def is_ignored(path: Column) -> Column:
    """Paths that are not indexed (S4): by a folder's name, the file's, its ending.  Sets of names, as one pattern of them all is slow on many paths."""
    plain = F.translate(path, "\\", "/")
    low = F.translate(path, "\\" + _UPPER, "/" + _LOWER)
    file, low_file = F.substring_index(plain, "/", -1), F.substring_index(low, "/", -1)
    endings = [*fixed.IGNORED_EXTENSIONS, ".d.ts"]
    one = [e[1:] for e in endings if e.count(".") == 1]
    tests = [
        F.exists(F.split(plain, "/"), lambda x: x.isin(*fixed.IGNORED_DIRS)),
        file.isin(*fixed.IGNORED_FILES) | low_file.isin(*[f for f in fixed.IGNORED_FILES if f == f.lower()]),
        low_file.contains(".") & F.substring_index(low_file, ".", -1).isin(*one),
        *[low_file.endswith(e) for e in endings if e.count(".") != 1],
        *[low_file.contains(x) for x in (".bundle.", ".chunk.", ".generated.")],
    ]
    return reduce(lambda a, b: a | b, tests)


def language(path: Column) -> Column:
    """Language by extension, or null."""
    table = F.create_map(*[F.lit(x) for kv in fixed.LANGUAGE_OF_EXTENSION.items() for x in kv])
    return F.element_at(table, F.regexp_extract(F.lower(path), r"(?<=[^/])(\.[^./]*)$", 1))


def json_strings(value: Column) -> Column:
    """The strings of a JSON array; its other values are left out, and anything else than an array gives none."""
    variants = F.try_variant_get(F.try_parse_json(value), "$", "array<variant>")
    kept = F.filter(variants, lambda v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(F.transform(kept, lambda v: v.cast("string")), F.array().cast("array<string>"))

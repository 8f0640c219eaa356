"""Symbols and hints from source files.

Python files go through the standard parser; files of other languages through patterns
on their lines, from which strings and comments are blanked first, and which find
definitions, imports, calls, heritage and member calls.  A file that can't be parsed gives
a diagnostic; where nothing was found in a file, plain definitions are looked for by their
keywords (``fallback_rows``).  Lines count from 1.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom import schema
from codeloom.functions import graph
from codeloom.operators.relate import ordinal

ROW = (
    "what string, name string, kind string, file_path string, start_line int, start_column int, end_line int, end_column int, signature string, documentation string, "
    "visibility string, modifiers array<string>, return_type string, parameter_count int, owner string, cyclomatic int, cognitive int, max_loop_depth int, "
    "receiver string, language string, status string, response_keys array<string>, seq long"
)
_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension)
_LOOPS = (ast.For, ast.AsyncFor, ast.While)

_NAME = r"[A-Za-z_$][\w$]*"
#: By language: (kind, pattern with the groups name and, where there are some, params and bases).
_DEFINITIONS = {
    "typescript": (
        ("class", rf"^\s*(?P<mods>(?:export\s+|default\s+|abstract\s+)*)class\s+(?P<name>{_NAME})(?P<bases>[^{{]*)"),
        ("interface", rf"^\s*(?P<mods>(?:export\s+)*)interface\s+(?P<name>{_NAME})(?P<bases>[^{{]*)"),
        ("type", rf"^\s*(?P<mods>(?:export\s+)*)(?:type|enum)\s+(?P<name>{_NAME})"),
        ("function", rf"^\s*(?P<mods>(?:export\s+|default\s+|async\s+)*)function\s*\*?\s*(?P<name>{_NAME})\s*(?P<params>\([^)]*\))(?P<ret>\s*:\s*[^{{;]+)?"),
        ("function", rf"^\s*(?P<mods>(?:export\s+)*)(?:const|let)\s+(?P<name>{_NAME})\s*=\s*(?:async\s*)?(?P<params>\([^)]*\))(?P<ret>\s*:\s*[^=]+)?\s*=>"),
        ("variable", rf"^\s*(?P<mods>(?:export\s+)*)(?:const|let|var)\s+(?P<name>{_NAME})"),
        ("method", rf"^\s+(?P<mods>(?:public\s+|private\s+|protected\s+|static\s+|async\s+|abstract\s+|readonly\s+)*)(?P<name>{_NAME})\s*(?P<params>\([^)]*\))(?P<ret>\s*:\s*[^{{;]+)?\s*\{{"),
    ),
    "java": (
        ("class", rf"^\s*(?P<mods>(?:public\s+|private\s+|protected\s+|static\s+|abstract\s+|final\s+)*)class\s+(?P<name>{_NAME})(?P<bases>[^{{]*)"),
        ("interface", rf"^\s*(?P<mods>(?:public\s+|private\s+|protected\s+)*)interface\s+(?P<name>{_NAME})(?P<bases>[^{{]*)"),
        ("method", rf"^\s+(?P<mods>(?:public\s+|private\s+|protected\s+|static\s+|abstract\s+|final\s+|override\s+|async\s+|virtual\s+)+)(?P<ret>[\w<>\[\],.? ]+?)\s+(?P<name>{_NAME})\s*(?P<params>\([^)]*\))"),
    ),
    "php": (
        ("class", rf"^\s*(?P<mods>(?:abstract\s+|final\s+)*)class\s+(?P<name>{_NAME})(?P<bases>[^{{]*)"),
        ("interface", rf"^\s*(?P<mods>)interface\s+(?P<name>{_NAME})(?P<bases>[^{{]*)"),
        ("method", rf"^\s+(?P<mods>(?:public\s+|private\s+|protected\s+|static\s+|abstract\s+|final\s+)*)function\s+&?(?P<name>{_NAME})\s*(?P<params>\([^)]*\))(?P<ret>\s*:\s*[^{{;]+)?"),
        ("function", rf"^(?P<mods>)function\s+&?(?P<name>{_NAME})\s*(?P<params>\([^)]*\))(?P<ret>\s*:\s*[^{{;]+)?"),
    ),
    "go": (
        ("interface", rf"^(?P<mods>)type\s+(?P<name>{_NAME})\s+interface\b"),
        ("class", rf"^(?P<mods>)type\s+(?P<name>{_NAME})\s+struct\b"),
        ("method", rf"^(?P<mods>)func\s+\([^)]*\)\s*(?P<name>{_NAME})\s*(?P<params>\([^)]*\))(?P<ret>[^{{]*)"),
        ("function", rf"^(?P<mods>)func\s+(?P<name>{_NAME})\s*(?P<params>\([^)]*\))(?P<ret>[^{{]*)"),
    ),
    "rust": (
        ("interface", rf"^\s*(?P<mods>(?:pub(?:\([^)]*\))?\s+)?)trait\s+(?P<name>{_NAME})"),
        ("class", rf"^\s*(?P<mods>(?:pub(?:\([^)]*\))?\s+)?)(?:struct|enum)\s+(?P<name>{_NAME})"),
        ("function", rf"^\s*(?P<mods>(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?)fn\s+(?P<name>{_NAME})[^(]*(?P<params>\([^)]*\))(?P<ret>\s*->\s*[^{{;]+)?"),
    ),
    "c": (
        ("class", rf"^\s*(?P<mods>)(?:class|struct)\s+(?P<name>{_NAME})(?P<bases>[^{{;]*)\{{?\s*$"),
        ("function", rf"^(?P<mods>(?:static\s+|inline\s+|extern\s+)*)(?P<ret>[\w*&:<> ]+?)[\s*&]+(?P<name>{_NAME})\s*(?P<params>\([^)]*\))\s*\{{?\s*$"),
    ),
    "ruby": (
        ("class", rf"^\s*(?P<mods>)(?:class|module)\s+(?P<name>{_NAME})(?P<bases>\s*<\s*\S+)?"),
        ("method", r"^\s*(?P<mods>)def\s+(?:self\.)?(?P<name>[A-Za-z_]\w*[?!=]?)(?P<params>\([^)]*\))?"),
    ),
    "swift": (
        ("class", rf"^\s*(?P<mods>(?:public\s+|private\s+|open\s+|final\s+|internal\s+)*)(?:class|struct|enum)\s+(?P<name>{_NAME})(?P<bases>[^{{]*)"),
        ("interface", rf"^\s*(?P<mods>(?:public\s+)*)protocol\s+(?P<name>{_NAME})"),
        ("function", rf"^\s*(?P<mods>(?:public\s+|private\s+|open\s+|static\s+|override\s+)*)func\s+(?P<name>{_NAME})\s*(?P<params>\([^)]*\))(?P<ret>\s*->\s*[^{{]+)?"),
    ),
}
_DEFINITIONS |= {"javascript": _DEFINITIONS["typescript"], "csharp": _DEFINITIONS["java"], "cpp": _DEFINITIONS["c"]}
_IMPORTS = {
    "typescript": r"""(?:import\s+(?:[^'"]*\s+from\s+)?|export\s+[^'"]*\s+from\s+|require\s*\(\s*)['"]([^'"]+)['"]""",
    "java": r"^\s*import\s+(?:static\s+)?([\w.]+)", "csharp": r"^\s*using\s+([\w.]+)\s*;", "php": r"^\s*use\s+([\w\\]+)", "go": r'^\s*(?:import\s+)?(?:\w+\s+)?"([^"]+)"\s*$',
    "rust": r"^\s*(?:pub\s+)?use\s+([\w:]+)", "c": r"^\s*#\s*include\s+[<\"]([^>\"]+)[>\"]", "ruby": r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)['\"]", "swift": r"^\s*import\s+(\w+)",
}
_IMPORTS |= {"javascript": _IMPORTS["typescript"], "cpp": _IMPORTS["c"]}
_CALL = re.compile(rf"(?:(?P<rec>[\w$.()]+?)(?:\.|->|::))?(?P<name>{_NAME})\s*\(")
_NO_CALL = set("if for while switch catch return function def func fn class new sizeof typeof await super constructor elif when match print".split())
_DECISION = re.compile(r"\b(?:if|for|foreach|while|case|catch|elif|elsif|guard|unless)\b|&&|\|\||\?\?|\?(?![.:?])")
_LOOP = re.compile(r"\b(?:for|foreach|while|loop)\b")
#: Comments and strings by family of languages; a match never starts inside another.
_TEXTS = {
    "hash": re.compile(r"""#[^\n]*|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'"""),
    "rust": re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\\n])'""", re.S),
    "php": re.compile(r"""//[^\n]*|#(?!\[)[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'""", re.S),
    "slash": re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""", re.S),
}
_ANY_DEFINITION = re.compile(rf"^[ \t]*(?:[\w@]+[ \t]+){{0,4}}?(?P<word>class|struct|enum|record|object|interface|trait|protocol|module|namespace|function|func|fun|fn|def|sub|type)[ \t]+(?P<name>{_NAME})", re.M)
_ANY_KIND = {"interface": "interface", "trait": "interface", "protocol": "interface", "module": "module", "namespace": "module", "type": "type"} | dict.fromkeys(("class", "struct", "enum", "record", "object"), "class")


def _row(**x) -> dict:
    base = dict.fromkeys(("what", "name", "kind", "file_path", "signature", "documentation", "visibility", "return_type", "owner", "receiver", "language", "status"))
    base |= dict.fromkeys(("start_line", "start_column", "end_line", "end_column", "parameter_count", "cyclomatic", "cognitive", "max_loop_depth"))
    return base | {"modifiers": [], "response_keys": [], "status": "ok"} | x


def masked(source: str, language: str) -> str:
    """The source with what its comments and strings say blanked; lines and columns stay."""
    texts = _TEXTS["hash" if language in ("python", "ruby") else language if language in _TEXTS else "slash"]

    def blank(m: re.Match) -> str:
        own = m[0]
        if own[0] in "\"'`" and len(own) > 1:
            return own[0] + re.sub(r"[^\n]", " ", own[1:-1]) + own[-1]
        return re.sub(r"[^\n]", " ", own)

    return texts.sub(blank, source)


def fallback_rows(path: str, source: str, language: str) -> Iterator[dict]:
    """Definitions by their keyword alone, for a file that gave no symbol (S8): public, of one line, without hints."""
    for m in _ANY_DEFINITION.finditer(masked(source, language)):
        line = source.count("\n", 0, m.start("name")) + 1
        start = m.start("name") - source.rfind("\n", 0, m.start("name")) - 1
        here = {"start_line": line, "start_column": start, "end_line": line, "end_column": start + len(m["name"])}
        yield _row(what="symbol", kind=_ANY_KIND.get(m["word"], "function"), name=m["name"], visibility="public", cyclomatic=1, cognitive=0, max_loop_depth=0, file_path=path, language=language, **here)


def object_keys(source: str, plain: str, at: int) -> list[str]:
    """The keys of the object literal whose brace is at a place: of its own level, without spreads and methods.

    ``plain`` is the masked source, in which braces and commas of strings don't count.
    """
    depth, start, keys = 0, at + 1, []
    for i in range(at, len(plain)):
        c = plain[i]
        depth += (c in "{[(") - (c in "}])")
        if depth == 0 or depth == 1 and c == ",":
            if m := re.match(rf"""\s*(?:(?P<q>['"`])(?P<quoted>.*?)(?P=q)\s*:|(?P<key>{_NAME}|\d+)\s*(?::|$))""", source[start:i]):
                keys.append(m["quoted"] or m["key"])
            start = i + 1
        if depth == 0:
            break
    return [k for k in dict.fromkeys(keys) if k]


def body_keys(source: str, plain: str) -> list[str]:
    """Distinct keys of the object literals that a body returns or sends by json or send."""
    found = [object_keys(source, plain, m.end() - 1) for m in re.finditer(r"(?:\breturn\s*\(?\s*|\.(?:json|send)\(\s*)\{", plain)]
    return list(dict.fromkeys(k for keys in found for k in keys))


def _returned_keys(node: ast.AST) -> list[str]:
    """Distinct constant keys of the dictionaries that a Python function returns, or returns as an argument of a call."""
    keys: list[str] = []
    for r in ast.walk(node):
        if isinstance(r, ast.Return) and r.value is not None:
            for d in [r.value, *(r.value.args if isinstance(r.value, ast.Call) else [])]:
                if isinstance(d, ast.Dict):
                    keys += [k.value for k in d.keys if isinstance(k, ast.Constant) and isinstance(k.value, str)]
    return list(dict.fromkeys(keys))


def python_complexity(node: ast.AST) -> tuple[int, int, int]:
    """Cyclomatic and cognitive complexity and depth of loops (S11): a decision costs 1 and, cognitively, 1 more per level."""
    cyclomatic, cognitive, loops = 1, 0, 0

    def visit(n: ast.AST, depth: int, loop: int) -> None:
        nonlocal cyclomatic, cognitive, loops
        for c in ast.iter_child_nodes(n):
            if isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue
            inner, own = depth, loop
            if isinstance(c, _BRANCHES):
                cyclomatic += 1
                cognitive += 1 + depth
                inner += 1
            elif isinstance(c, ast.BoolOp):
                cyclomatic += len(c.values) - 1
                cognitive += 1
            if isinstance(c, _LOOPS):
                own += 1
                loops = max(loops, own)
            visit(c, inner, own)

    visit(node, 0, 0)
    return cyclomatic, cognitive, loops


def python_rows(path: str, source: str) -> Iterator[dict]:
    tree = ast.parse(source)
    common = {"file_path": path, "language": "python"}

    def visibility(name: str) -> str:
        return "private" if name.startswith("_") and not name.startswith("__") else "public"

    def called(f: ast.expr) -> tuple[str | None, str | None]:
        if isinstance(f, ast.Name):
            return f.id, None
        return (f.attr, ast.unparse(f.value)) if isinstance(f, ast.Attribute) else (None, None)

    def visit(node: ast.AST, owner: str | None, inside: bool) -> Iterator[dict]:
        for c in ast.iter_child_nodes(node):
            here = {"start_line": getattr(c, "lineno", 0), "start_column": getattr(c, "col_offset", 0), "end_line": getattr(c, "end_lineno", 0), "end_column": getattr(c, "end_col_offset", 0)}
            if isinstance(c, ast.ClassDef):
                yield _row(what="symbol", kind="class", name=c.name, documentation=ast.get_docstring(c), visibility=visibility(c.name), owner=owner, signature=f"class {c.name}", cyclomatic=1, cognitive=0, max_loop_depth=0, **here, **common)
                for b in c.bases:
                    yield _row(what="hint", kind="inherits", name=ast.unparse(b), owner=c.name, start_line=c.lineno, **common)
                yield from visit(c, c.name, False)
            elif isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef)):
                a = c.args
                n = len([*a.posonlyargs, *a.args, *a.kwonlyargs]) - (1 if owner and not inside and a.args and a.args[0].arg in ("self", "cls") else 0)
                m = python_complexity(c)
                mods = [x for x, y in (("async", isinstance(c, ast.AsyncFunctionDef)), ("static", any(ast.unparse(d) == "staticmethod" for d in c.decorator_list)), ("abstract", any("abstractmethod" in ast.unparse(d) for d in c.decorator_list))) if y]
                yield _row(what="symbol", kind="method" if owner and not inside else "function", name=c.name, documentation=ast.get_docstring(c), visibility=visibility(c.name), owner=owner, modifiers=mods, parameter_count=n, return_type=ast.unparse(c.returns) if c.returns else None, signature=f"{c.name}({ast.unparse(a)})" + (f" -> {ast.unparse(c.returns)}" if c.returns else ""), cyclomatic=m[0], cognitive=m[1], max_loop_depth=m[2], response_keys=_returned_keys(c), **here, **common)
                yield from visit(c, owner, True)
            else:
                if isinstance(c, (ast.Import, ast.ImportFrom)):
                    base = "." * c.level + (c.module or "") if isinstance(c, ast.ImportFrom) else ""
                    for x in [base] if base else [y.name for y in c.names]:
                        yield _row(what="hint", kind="import", name=x, start_line=c.lineno, **common)
                elif isinstance(c, ast.Call) and (got := called(c.func))[0]:
                    yield _row(what="hint", kind="call", name=got[0], receiver=got[1], start_line=c.lineno, **common)
                elif isinstance(c, ast.Subscript) and isinstance(c.slice, ast.Constant) and isinstance(c.slice.value, str):
                    yield _row(what="hint", kind="access", name=c.slice.value, receiver=ast.unparse(c.value), start_line=c.lineno, **common)
                elif isinstance(c, (ast.Assign, ast.AnnAssign)) and not inside and isinstance(node, (ast.Module, ast.ClassDef)):
                    for t in c.targets if isinstance(c, ast.Assign) else [c.target]:
                        if isinstance(t, ast.Name):
                            yield _row(what="symbol", kind="variable", name=t.id, visibility=visibility(t.id), owner=owner, cyclomatic=1, cognitive=0, max_loop_depth=0, **here, **common)
                yield from visit(c, owner, inside)

    yield from visit(tree, None, False)


def _block_end(lines: list[str], at: int, language: str) -> int:
    """The last line of the block that starts on a line: by braces, or by indentation and ``end``."""
    if language == "ruby":
        indent = len(lines[at]) - len(lines[at].lstrip())
        return next((i for i in range(at + 1, len(lines)) if re.match(rf"^\s{{0,{indent}}}end\b", lines[i])), at)
    depth, seen = 0, False
    for i in range(at, len(lines)):
        depth += lines[i].count("{") - lines[i].count("}")
        seen |= "{" in lines[i]
        if seen and depth <= 0 or not seen and i > at + 1:
            return i if seen else at
    return len(lines) - 1 if seen else at


def pattern_rows(path: str, source: str, language: str) -> Iterator[dict]:
    written, lines = source.split("\n"), masked(source, language).split("\n")
    common = {"file_path": path, "language": language}
    owners: list[tuple[int, str]] = []
    for i, line in enumerate(lines):
        while owners and owners[-1][0] < i:
            owners.pop()
        owner = owners[-1][1] if owners else None
        hit = None
        for kind, pattern in _DEFINITIONS.get(language, ()):
            m = re.match(pattern, line)
            if m and m["name"] not in _NO_CALL and not (kind == "method" and not owner and language != "go" and language != "ruby"):
                hit = m
                g = m.groupdict()
                end = i if kind == "variable" and "{" not in line else _block_end(lines, i, language)
                body = "\n".join(lines[i : end + 1])
                mods = (g.get("mods") or "").split()
                shown = "public" if language == "go" and m["name"][0].isupper() else "private" if language == "go" else "private" if "private" in mods or (language == "rust" and not mods) else "protected" if "protected" in mods else "public"
                params = g.get("params")
                loops = [len(x) - len(x.lstrip()) for x in body.split("\n")[1:] if _LOOP.search(x)]
                decisions = len(_DECISION.findall(body)) if params is not None else 0
                yield _row(what="symbol", kind=kind, name=m["name"], start_line=i + 1, start_column=m.start("name"), end_line=end + 1, end_column=len(lines[end]), signature=written[i].strip().rstrip("{").strip(), visibility=shown, modifiers=[x for x in mods if x in ("static", "async", "abstract", "readonly", "export")], owner=owner, parameter_count=None if params is None else len([x for x in params.strip("()").split(",") if x.strip()]), return_type=(written[i][slice(*m.span("ret"))] if g.get("ret") else "").strip(" :->") or None, cyclomatic=1 + decisions, cognitive=decisions, max_loop_depth=len(set(loops)), response_keys=body_keys("\n".join(written[i : end + 1]), body) if params is not None and language in ("typescript", "javascript") else [], **common)
                for word, names in re.findall(r"\b(extends|implements)\s+([\w\s,.<>]+?)(?=\bimplements\b|$)", (g.get("bases") or "").strip()) or ([("extends", (g.get("bases") or "").strip(" :<"))] if language in ("csharp", "cpp", "swift", "ruby") and (g.get("bases") or "").strip(" :<") else []):
                    for x in names.split(","):
                        if x.strip():
                            yield _row(what="hint", kind="implements" if word == "implements" else "inherits", name=re.sub(r"\b(public|private|protected)\b|<.*", "", x).strip(), owner=m["name"], start_line=i + 1, **common)
                if kind in ("class", "interface"):
                    owners.append((end, m["name"]))
                break
        for m in re.finditer(_IMPORTS.get(language, r"(?!)"), written[i]):
            if not line[max(m.start(1) - 1, 0) : m.end(1) + 1].strip():
                continue  # inside a comment
            yield _row(what="hint", kind="import", name=m[1], start_line=i + 1, **common)
        for m in _CALL.finditer(line):
            if m["name"] not in _NO_CALL and not (hit and hit["name"] == m["name"] and m.start("name") == hit.start("name")) and "import" not in line[:7]:
                yield _row(what="hint", kind="call", name=m["name"], receiver=m["rec"], start_line=i + 1, **common)
        for m in re.finditer(rf"({_NAME})\[['\"](\w+)['\"]\]", written[i]):
            if line[m.start()] == " ":
                continue  # inside a comment or a string
            yield _row(what="hint", kind="access", name=m[2], receiver=m[1], start_line=i + 1, **common)


def file_rows(path: str, source: str | None, language: str) -> list[dict]:
    """All rows of a file; a row with a status first, if it can't be parsed (S7, S12), and what its keywords tell if nothing else does."""
    source, broken = source or "", []
    try:
        rows = list(python_rows(path, source) if language == "python" else pattern_rows(path, source, language))
    except (SyntaxError, ValueError, RecursionError) as e:
        line = getattr(e, "lineno", None) or 1
        around = "\n".join(source.split("\n")[max(0, line - 2) : line + 1])
        rows, broken = [], [_row(what="diagnostic", file_path=path, language=language, status=f"parse_error: {e}", start_line=line, documentation=around)]
    if not any(r["what"] == "symbol" for r in rows):
        rows += fallback_rows(path, source, language)
    return [r | {"seq": i} for i, r in enumerate(broken + rows)]


def extract(files: DataFrame) -> DataFrame:
    """Raw rows of files (path, content, language): symbols, hints and diagnostics, in the order of the file."""
    names = [x.split()[0] for x in ROW.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for p, c, g in zip(pdf.path, pdf.content, pdf.language, strict=True) for r in file_rows(p, c, g)]
            yield pd.DataFrame(rows, columns=names).astype({k: "Int32" for k in ("start_line", "start_column", "end_line", "end_column", "parameter_count", "cyclomatic", "cognitive", "max_loop_depth")})

    return files.select("path", "content", "language").mapInPandas(run, ROW)


def symbols_and_hints(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols with ids, keys and owners, and hints (schema.SYMBOLS, schema.HINTS)."""
    s = rows.where("what = 'symbol'").withColumn("id", graph.symbol_id(F.col("file_path"), F.col("name"), F.col("start_line"), F.col("start_column"))).dropDuplicates(["id"])
    s = ordinal(s, ["file_path", "name", "kind"], "seq")
    qualified = F.concat_ws(".", "owner", "name")
    s = s.withColumn("logical_key", graph.logical_key(F.col("file_path"), qualified, F.col("kind"), F.col("ordinal")))
    owner = s.where("kind in ('class', 'interface')").groupBy("file_path", F.col("name").alias("owner")).agg(F.min_by("id", "seq").alias("owner_id"))
    s = s.join(owner, ["file_path", "owner"], "left")
    h = rows.where("what = 'hint'").select("kind", F.col("file_path").alias("source_file"), F.col("name").alias("target_name"), F.lit(None).cast("string").alias("child_id"), "start_line", "language", "receiver", F.col("owner").alias("enclosing_id"), "seq")
    return schema.conform(s, schema.SYMBOLS), schema.conform(h, schema.HINTS)


def call_edges(symbols: DataFrame, hints: DataFrame, imports: DataFrame) -> DataFrame:
    """CALLS between symbols: the symbol around the line, and the name by tiers; not to itself."""
    from codeloom.operators.relate import covering, resolve_names

    h = hints.where("kind = 'call'").withColumn("ref_id", F.concat_ws(":", "source_file", "seq"))
    at = covering(h.select(F.col("ref_id").alias("point_id"), F.col("source_file").alias("file_path"), F.col("start_line").alias("line")), symbols.where("kind in ('function', 'method', 'class')"), "enclosing")
    to = resolve_names(h.select("ref_id", F.col("source_file").alias("file_path"), F.col("target_name").alias("name")), symbols.where("kind in ('function', 'method', 'class')"), imports)
    rows = at.select(F.col("point_id").alias("ref_id"), F.col("id").alias("src")).join(to.where("id is not null").select("ref_id", F.col("id").alias("dst"), "confidence"), "ref_id").where("src <> dst")
    return rows.groupBy("src", "dst").agg(F.max("confidence").alias("confidence")).withColumn("rel_type", F.lit("calls"))

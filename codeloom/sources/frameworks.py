"""Routes, models and handlers that frameworks declare, by patterns on source text; and keys of responses."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_Q = r"['\"`]"
#: (framework, languages, what it declares, pattern, group of the method or 0, group of the path or name).
RULES = (
    ("nestjs", ("typescript",), "route", rf"@(Get|Post|Put|Delete|Patch)\(\s*{_Q}?([^'\"`)]*){_Q}?\s*\)", 1, 2),
    ("nestjs", ("typescript",), "controller", rf"@(Controller)\(\s*{_Q}?([^'\"`)]*){_Q}?\s*\)", 0, 2),
    ("express", ("typescript", "javascript"), "route", rf"\b(?:app|router)\.(get|post|put|delete|patch)\(\s*{_Q}([^'\"`]+){_Q}", 1, 2),
    ("fastify", ("typescript", "javascript"), "route", rf"\bfastify\.(get|post|put|delete|patch)\(\s*{_Q}([^'\"`]+){_Q}", 1, 2),
    ("laravel", ("php",), "route", rf"Route::(get|post|put|delete|patch)\(\s*{_Q}([^'\"`]+){_Q}", 1, 2),
    ("spring", ("java",), "route", r"@(Get|Post|Put|Delete|Patch|Request)Mapping\(\s*(?:value\s*=\s*)?\"([^\"]*)\"", 1, 2),
    ("fastapi", ("python",), "route", rf"@(?:app|router)\.(get|post|put|delete|patch)\(\s*{_Q}([^'\"`]+){_Q}", 1, 2),
    ("django", ("python",), "route", rf"\b(path|re_path)\(\s*r?{_Q}([^'\"`]*){_Q}", 0, 2),
    ("mongoose", ("typescript", "javascript"), "model", rf"mongoose\.(model)\(\s*{_Q}([^'\"`]+){_Q}", 0, 2),
    ("django", ("python",), "model", r"class\s+(\w+)\(\s*(?:models\.)?(Model)\b", 0, 1),
    ("magento2", ("xml", "php"), "route", r"<route\s+url=\"([^\"]+)\"\s+method=\"([A-Z]+)\"", 2, 1),
    ("magento2", ("xml", "php"), "event", r"<event\s+(name)=\"([^\"]+)\"", 0, 2),
    ("magento2", ("xml", "php"), "preference", r"<preference\s+(for)=\"([^\"]+)\"", 0, 2),
)
#: What a class puts before the routes of its methods: (framework, languages, pattern with the path as its group).
PREFIXES = (
    ("nestjs", ("typescript",), rf"@Controller\(\s*{_Q}([^'\"`)]*){_Q}\s*\)"),
    ("spring", ("java",), r"@RequestMapping\(\s*(?:(?:value|path)\s*=\s*)?\"([^\"]*)\"[^)]*\)(?=\s*(?:@\w+(?:\([^)]*\))?\s*)*(?:\w+\s+)*class\b)"),
)
_RULES = [(f, languages, what, re.compile(p), method, value) for f, languages, what, p, method, value in RULES]
_PREFIXES = [(f, languages, re.compile(p)) for f, languages, p in PREFIXES]
DECLARED = "path string, framework string, what string, method string, name string, line int"


def joined_path(prefix: str, path: str) -> str:
    return "/" + "/".join(x.strip("/") for x in (prefix, path) if x.strip("/"))


def file_declarations(path: str, content: str, language: str) -> Iterator[tuple[str, str, str, str, str, int]]:
    """(path, framework, what, method, name, line) of one file; the routes of a class start with the class's own path."""
    feeds = [i for i, c in enumerate(content) if c == "\n"]
    before = {f: [(m.start(), m[1]) for m in p.finditer(content)] for f, languages, p in _PREFIXES if language in languages}
    for framework, languages, what, pattern, method, value in _RULES:
        if language not in languages:
            continue
        own = before.get(framework, [])
        places = [at for at, _ in own]
        for m in pattern.finditer(content):
            if what == "route" and framework == "spring" and m.start() in places:
                continue  # a class's path is no route
            k = bisect_right(places, m.start())
            name = joined_path(own[k - 1][1], m[value]) if what == "route" and k else m[value]
            yield path, framework, what, m[method].upper() if method else "", name, bisect_right(feeds, m.start() - 1) + 1


def scan(files: DataFrame) -> DataFrame:
    """(path, framework, what, method, name, line) found in files (path, content, language), each read once; lines count from 1."""
    names = [x.split()[0] for x in DECLARED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for p, c, g in zip(pdf.path, pdf.content, pdf.language, strict=True) if c and g for r in file_declarations(p, c, g)]
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content", "language").mapInPandas(run, DECLARED)


def response_keys(content: Column) -> Column:
    """Distinct keys of object literals that are returned or sent as a response."""
    bodies = F.regexp_extract_all(content, F.lit(r"(?:return|res\.(?:json|send|status\(\d+\)\.json))\s*\(?\s*\{([^{}]*)\}"), 1)
    pieces = F.flatten(F.transform(bodies, lambda b: F.split(b, ",")))
    keys = F.transform(pieces, lambda p: F.regexp_extract(p, r"^\s*['\"]?([A-Za-z_$][\w$]*)['\"]?\s*(?::|$)", 1))
    return F.array_distinct(F.filter(keys, lambda k: k != ""))

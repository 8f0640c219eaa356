"""Sources: trees, extraction, diffs, frameworks, Cypher, export, streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from codeloom.functions import graph, packages, text
from codeloom.operators import export
from codeloom.sources import cypher, extract, files, frameworks, gitdiff
from codeloom.streaming import watch

PY = '''import os
from lib import helper

class Base:
    """A base."""
    def run(self, x):
        for i in range(x):
            for j in range(i):
                if i and j:
                    helper(i)
        return self.step(x)

    def step(self, y) -> int:
        return y["key"]

class Child(Base):
    pass

def main():
    Child().run(3)
'''
TS = """import { save } from './store';
export class Order extends Base implements Row {
  private total(x: number, y: number): number {
    if (x > 1 && y) { return save(x); }
    return this.rate['low'];
  }
}
export function place(o: Order): void {
  o.total(1, 2);
}
"""


@pytest.fixture
def tree(tmp_path):
    for name, body in {"app/base.py": PY, "web/order.ts": TS, "web/types.d.ts": "x", "node_modules/a.js": "x", "bad.py": "def (:\n", "readme.md": "x", "big.py": "#" * 600_000}.items():
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_text(body)
    return str(tmp_path)


def test_walk_and_extract(spark, tree):
    f = files.walk(spark, tree, with_content=True)
    assert {(r.path, r.language) for r in f.select("path", "language").collect()} == {("app/base.py", "python"), ("web/order.ts", "typescript"), ("bad.py", "python")}
    rows = extract.extract(f)
    s, h = extract.symbols_and_hints(rows)
    got = {(r.file_path, r.name, r.kind, r.start_line) for r in s.collect()}
    assert {("app/base.py", "Base", "class", 4), ("app/base.py", "run", "method", 6), ("app/base.py", "step", "method", 13), ("app/base.py", "Child", "class", 16), ("app/base.py", "main", "function", 19)} <= got
    assert {("web/order.ts", "Order", "class", 2), ("web/order.ts", "total", "method", 3), ("web/order.ts", "place", "function", 8)} <= got
    run = s.where("name = 'run'").first()
    assert (run.parameter_count, run.cyclomatic, run.max_loop_depth, run.owner_id) == (1, 5, 2, s.where("name = 'Base'").first().id)
    total = s.where("name = 'total'").first()
    assert (total.visibility, total.parameter_count, total.end_line, total.cyclomatic) == ("private", 2, 6, 3)
    hints = {(r.kind, r.target_name) for r in h.collect()}
    assert {("import", "os"), ("import", "lib"), ("inherits", "Base"), ("call", "helper"), ("access", "key"), ("import", "./store"), ("implements", "Row"), ("call", "save"), ("access", "low")} <= hints
    bad = rows.where("what = 'diagnostic'").collect()
    assert [b.file_path for b in bad] == ["bad.py"] and bad[0].status.startswith("parse_error")
    assert s.select("id").distinct().count() == s.count()
    imports = spark.createDataFrame([], "file_path string, imported_file string")
    calls = extract.call_edges(s, h, imports)
    names = {r.id: r.name for r in s.collect()}
    assert {("run", "step"), ("main", "run"), ("place", "total"), ("main", "Child")} <= {(names[r.src], names[r.dst]) for r in calls.collect()}


def test_folder_languages_and_configuration(spark):
    f = spark.createDataFrame([("a/b/x.ts", "typescript"), ("a/b/y.ts", "typescript"), ("a/z.py", "python")], "path string, language string")
    assert {r.folder: r.language for r in files.folder_languages(f).collect()} == {"": "typescript", "a": "typescript", "a/b": "typescript"}
    got = files.import_aliases({"tsconfig.json": json.dumps({"compilerOptions": {"baseUrl": "./src", "paths": {"@/*": ["./app/*"]}}}), "composer.json": json.dumps({"autoload": {"psr-4": {"App\\": "src/"}}}), "go.mod": "module example.org/m\n", "x/composer.json": "{"})
    assert {(p, t) for p, t, _ in got} == {("@/", "src/app/"), ("App/", "src/"), ("example.org/m/", "")}


def test_diffs(spark):
    status = gitdiff.parse_status(spark.createDataFrame([(x,) for x in ("M\ta.ts", "R100\told.ts\tnew.ts", "C75\ta.ts\tb.ts", "D\tgone.ts", "T\tt.ts", "A\tdist/x.ts", "junk")], "line string"))
    assert {(r.path, r.status, r.old_path) for r in status.collect()} == {("a.ts", "modified", None), ("new.ts", "renamed", "old.ts"), ("b.ts", "added", "a.ts"), ("gone.ts", "deleted", None), ("t.ts", "modified", None), ("dist/x.ts", "added", None)}
    lines = ["+++ b/a.ts", "@@ -1 +5 @@", "@@ -3,2 +9,4 @@ f()", "+++ /dev/null", "@@ -1,3 +0,0 @@", "+++ b/new.ts", "@@ -0,0 +1,2 @@"]
    hunks = gitdiff.parse_unified(spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)], "diff_id string, seq long, line string"))
    assert sorted((r.path, r.hunk_start, r.hunk_lines) for r in hunks.collect()) == [("a.ts", 5, 1), ("a.ts", 9, 4), ("new.ts", 1, 2)]
    both = gitdiff.combine(status, hunks).collect()
    assert {(r.path, r.hunk_start) for r in both} == {("a.ts", 5), ("a.ts", 9), ("new.ts", 1), ("b.ts", None), ("t.ts", None), ("gone.ts", None)}


def test_frameworks(spark):
    rows = [("a.ts", "app.get('/x', h)\n\nrouter.post(\"/y\", h)\n", "typescript"), ("b.php", "Route::get('/p', f);", "php"), ("c.py", "@router.get('/q')\nclass M(models.Model):\n", "python"), ("d.java", '@GetMapping("/j")', "java")]
    got = {(r.path, r.framework, r.what, r.method, r.name, r.line) for r in frameworks.scan(spark.createDataFrame(rows, "path string, content string, language string")).collect()}
    assert {("a.ts", "express", "route", "GET", "/x", 1), ("a.ts", "express", "route", "POST", "/y", 3), ("b.php", "laravel", "route", "GET", "/p", 1), ("c.py", "fastapi", "route", "GET", "/q", 1), ("c.py", "django", "model", "", "M", 2), ("d.java", "spring", "route", "GET", "/j", 1)} == got
    keys = spark.createDataFrame([("return { id: 1, name, 'x': y };\nres.json({ ok: true })",)], "c string").select(frameworks.response_keys(F.col("c")).alias("k")).first().k
    assert keys == ["id", "name", "x", "ok"]


def test_cypher(spark):
    nodes = spark.createDataFrame([("a", "x", 5), ("b", "y", 12), ("c", "x", 30)], "id string, name string, n int")
    calls = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    tables = {"t_Symbol": nodes, "t_CALLS": calls}
    q = lambda text, **p: [tuple(r) for r in cypher.run(tables, text, p, "t_").collect()]
    assert q("MATCH (n:Symbol) WHERE n.n > 10 AND n.name IS NOT NULL RETURN n.id AS id ORDER BY id DESC") == [("c",), ("b",)]
    assert q("MATCH (a:Symbol {id: $x})-[:CALLS*1..5]->(b:Symbol) RETURN DISTINCT b.id AS id ORDER BY id", x="a") == [("b",), ("c",)]
    assert q("MATCH (a:Symbol)<-[:CALLS]-(b:Symbol) WHERE a.id IN $ids RETURN b.id AS id", ids=["c"]) == [("b",)]
    assert q("MATCH (a:Symbol) RETURN a.name AS name, count(a) AS n ORDER BY name SKIP 0 LIMIT 1") == [("x", 2)]
    for bad in ("DELETE x", "MATCH (a) WHERE frob(a) RETURN a.id"):
        with pytest.raises((ValueError, KeyError)):
            q(bad)


def test_expressions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(text.split_identifier(F.lit("parseHTTPUrl_v2-aB"))) == ["parse", "http", "url", "v2"] or one(text.split_identifier(F.lit("getUserID"))) == ["get", "user", "id"]
    assert one(text.sanitize(F.lit("find;  DROP TABLE x -- no"))) == "find; x"
    assert one(text.slugify(F.lit("Hello, World!"))) == "hello-world"
    assert one(text.bare_type(F.lit("Promise<a.b.Order>"))) == "Order"
    assert one(text.returned_type(F.lit("f(x) -> int"))) == "int"
    assert one(text.redact_paths(F.lit("see /home/x"))) == "see [PATH]/x"
    assert one(packages.package_name(F.lit("@a/b/c"), F.lit("typescript"))) == "@a/b"
    assert one(packages.package_name(F.lit("github.com/u/r/x"), F.lit("go"))) == "github.com/u/r"
    assert one(packages.package_name(F.lit("<boost/any.hpp>"), F.lit("cpp"))) == "boost"
    assert one(packages.aliases(F.lit("my-lib"))) == ["my-lib", "myLib", "MyLib", "mylib"]
    assert [one(packages.is_external(F.lit(p), F.lit(g))) for p, g in (("./x", "php"), ("node:fs", "javascript"), ("crate::x", "rust"), ("vector", "cpp"), ("left-pad", "javascript"))] == [False, False, False, False, True]
    assert one(graph.rel_type_of_label(F.lit("my_DEPENDS_ON"))) == "dependsOn"
    assert one(graph.framework(F.lit("src/app/page.tsx"))) == "nextjs"
    assert one(graph.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    import re

    assert re.search(text.safe_regex("a.b"), "x a.b y") and not re.search(text.safe_regex("a.b"), "axb")


def test_export_writes_files(spark, tmp_path):
    s = spark.createDataFrame([("1", 'a"b', "function", "src/x.ts", 1, 2, "public", 3, 0), ("2", "c", "class", "src/x.ts", 4, 5, "public", 1, 1)], "id string, name string, kind string, file_path string, start_line int, end_line int, visibility string, cyclomatic int, seq long")
    calls = spark.createDataFrame([("1", "2", "calls")], "src string, dst string, rel_type string")
    m = spark.createDataFrame([("Main Group", "1", 0)], "cluster_id string, id string, seq long")
    st = spark.createDataFrame([("p1", 0, "1"), ("p1", 1, "2")], "process_id string, step_order int, symbol_id string")
    done = {r.path: r.bytes for r in export.write_vault(export.documents(s, calls, m, st), str(tmp_path)).collect()}
    assert set(done) == {"src/x.md", "clusters/main-group.md", "processes/p1.md"}
    assert "S0 --> S1" in (tmp_path / "processes/p1.md").read_text() and "- callers: 1" in (tmp_path / "src/x.md").read_text()
    with pytest.raises(ValueError):
        export.write_vault(spark.createDataFrame([("../x", "y")], "path string, content string"), str(tmp_path))
    assert {r.id: r.cluster_id for r in export.unclustered(s, m).collect()} == {"1": "Main Group", "2": "unclustered"}


def test_watch_stream_equals_batch(spark, tmp_path):
    src, mark = tmp_path / "in", tmp_path / "mark"
    src.mkdir()
    rows = [{"root": "r", "path": p, "ts": f"2024-01-01T00:00:{s}Z"} for p, s in (("a.ts", "00.000"), ("b.ts", "00.200"), ("a.ts", "00.400"), ("c.ts", "02.000"), ("x/dist/d.ts", "02.100"))]
    (src / "1.json").write_text("\n".join(json.dumps(r) for r in rows))
    seen = []
    q = watch.watch(watch.change_events(spark, str(src)), lambda df, n: seen.append(sorted(r.path for r in df.collect())), str(mark), None)
    q.awaitTermination(60)
    assert seen == [["a.ts", "b.ts", "c.ts"]]
    batch = spark.read.schema("root string, path string, ts timestamp").json(str(src))
    assert sorted((r.n, r.paths) for r in watch.debounce(batch).collect()) == [(2, ["c.ts", "x/dist/d.ts"]), (3, ["a.ts", "b.ts"])]


def test_searched_patterns():
    f = text.searched_pattern
    assert f("grep", {"pattern": r"\bsaveOrder\("}) == "saveOrder" and f("glob", {"pattern": "src/**/*order*.ts"}) == "order"
    assert f("bash", {"command": "cd x && grep -rn 'parse url' src"}) == "parse url"
    assert f("bash", {"command": "ls"}) is None and f("grep", {"pattern": "a"}) is None


def test_masking_fallback_and_prefixes():
    plain = extract.masked("a = 'x{' // {\n/* {\n*/ b", "typescript")
    assert plain == "a = '  '     \n    \n   b" and extract.masked("# {\nx = \"}\"", "ruby") == "   \nx = \" \""
    assert "'a" in extract.masked("fn f<'a>(x: &'a str) {}", "rust")
    rows = extract.file_rows("a.swift", "fileprivate actor X {}\n// class No\nmodule Shop\n", "swift")
    assert [(r["kind"], r["name"], r["start_line"]) for r in rows if r["what"] == "symbol"] == [("module", "Shop", 3)]
    bad = extract.file_rows("a.py", "def f(x):\n    pass\nclass K(:\n", "python")
    assert [(r["what"], r["name"], r["seq"]) for r in bad] == [("diagnostic", None, 0), ("symbol", "f", 1), ("symbol", "K", 2)]
    source = "@Controller('users')\nclass A {\n  @Get(':id')\n  one() {}\n}\n"
    assert [r[2:] for r in frameworks.file_declarations("a.ts", source, "typescript")] == [("route", "GET", "/users/:id", 3), ("controller", "", "users", 1)]
    java = '@RequestMapping("/api")\npublic class A {\n  @GetMapping("/x")\n  void x() {}\n}\n'
    assert [r[2:] for r in frameworks.file_declarations("A.java", java, "java")] == [("route", "GET", "/api/x", 3)]


def test_ignored_paths_without_a_pattern(spark):
    """the same paths as by one pattern of all names, which is slow; lines of a status are read once."""
    import re

    from codeloom.functions import fixed, graph

    either = lambda words: "|".join(re.escape(w) for w in words)
    own = f"{either(fixed.IGNORED_FILES)}|(?i:{either(f for f in fixed.IGNORED_FILES if f == f.lower())})"
    endings = either([*fixed.IGNORED_EXTENSIONS, ".d.ts"])
    pattern = rf"(?:^|/)(?:{either(fixed.IGNORED_DIRS)})(?:/|\Z)|(?:^|/)(?:{own})\Z|(?i:{endings})\Z|(?i:\.(?:bundle|chunk|generated)\.)[^/]*\Z"
    names = [*fixed.IGNORED_DIRS, *fixed.IGNORED_FILES, *fixed.IGNORED_EXTENSIONS, "a.BUNDLE.x", "a.chunk.", "bundle.x", "x.D.TS", "d.ts", "png", "x.png.ts", "f.ts", "", ".", "a b", "license", "x.Lock", "x.loc\u212a", "a.\u0130co"]
    paths = [f(x) for n in names for x in {n, n.upper(), n.lower()} for f in (str, "src/{}".format, "{}/f.ts".format, "src\\{}".format, "a{}".format, "{}a".format, "{}\n".format, "src/{}/".format)]
    df = spark.createDataFrame([(p,) for p in paths] + [(None,)], "path string").select("path", graph.is_ignored(F.col("path")).alias("i"))
    want = {p: bool(re.search(pattern, p.replace("\\", "/"), re.ASCII)) for p in paths} | {None: None}
    assert {r.path: r.i for r in df.collect()} == want
    status, hunks = spark.createDataFrame([("M\tsrc/a.ts",), ("D\tsrc/b.ts",), ("M\tdist/c.ts",)], "line string"), spark.createDataFrame([("src/a.ts", 1, 2), ("src/a.ts", 5, 1), ("src/b.ts", 1, 1)], "path string, hunk_start int, hunk_lines int")
    both = gitdiff.combine(gitdiff.parse_status(status), hunks)
    assert sorted((r.path, r.hunk_start) for r in both.collect() if r.hunk_start) == [("src/a.ts", 1), ("src/a.ts", 5)] and [r.hunk_start for r in both.where("status = 'deleted'").collect()] == [None]
    both.explain("simple")
    assert "Union" not in both._jdf.queryExecution().optimizedPlan().toString()

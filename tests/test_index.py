"""A small tree from files to answers; a delta gives what a whole run gives."""

import json
import subprocess

from codeloom import cli
from codeloom.operators.store import difference
from codeloom.plans import index

A = "from pkg.b import save\nimport requests\n\nclass Shop:\n    def order(self, x):\n        return save(x)\n\ndef main():\n    Shop().order(1)\n"
B = "def save(x):\n    if x:\n        return check(x)\n\ndef check(x):\n    return x\n"


def test_index_ask_export_and_delta(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "pkg").mkdir(parents=True)
    (root / "pkg/a.py").write_text(A)
    (root / "pkg/b.py").write_text(B)
    run = lambda *a: json.loads(cli.main(list(a), spark))
    one, two, whole = (str(tmp_path / n) for n in ("one", "two", "whole"))
    assert run("index", str(root), one) == {"added": 2}
    t = index.load(spark, one)
    name = {r.id: r.name for r in t["symbols"].collect()}
    calls = {(name[r.src], name[r.dst]) for r in t["edges"].where("rel_type = 'calls'").collect()}
    assert {("order", "save"), ("save", "check"), ("main", "order"), ("main", "Shop")} <= calls
    assert [(r.id, r.ecosystem) for r in t["dependencies"].collect()] == [("ext:requests", "pip")]
    assert t["edges"].where("rel_type = 'contains'").count() == 1 and t["edges"].where("rel_type = 'imports'").count() == 1
    assert run("status", one)["rows"][0]["symbols"] == 5
    got = run("ask", one, 'what breaks with "check"? impact')
    assert got["summary"].startswith("impactAnalysis") and {r["name"] for r in got["rows"]} == {"save", "order", "main"}
    assert {r["name"] for r in run("tool", one, "smart_search", '{"query": "save", "max_results": 3}')["rows"]} >= {"save"}
    assert run("export", one, str(tmp_path / "vault"))["files"] >= 2

    (root / "pkg/b.py").write_text(B.replace("check(x)", "verify(x)"))
    assert run("index", str(root), two, "--from", one) == {"unchanged": 1, "changed": 1}
    run("index", str(root), whole)
    a, b = index.load(spark, two), index.load(spark, whole)
    for k in ("symbols", "edges", "keywords", "dependencies", "embeddings"):
        columns = [c for c in a[k].columns if a[k].schema[c].dataType.typeName() not in ("map",)]
        assert difference(a[k].select(*columns), b[k].select(*columns)).count() == 0, k


API = """import { load } from '@/store';
// import { gone } from './gone';
export function list(req, res) {
  const text = "function fake() {";
  res.json({ items: load(1), "next page": { deep: 1 }, total });
}
"""
STORE = """export function load(n) {
  return n;
}
"""
PAGE = """import { list } from './../web/./api';
import axios from 'axios';
export function show(data) {
  list(data);
  return data['items'] + data['missing'] + "data['never']";
}
"""
GO = {"cmd/main.go": 'package main\n\nimport (\n\t"example.org/m/store"\n)\n\nfunc main() {\n\tOpen()\n}\n', "store/open.go": "package store\n\nfunc Open() {\n}\n"}
CS = {"net/Acme.csproj": "<Project><RootNamespace>Acme.App</RootNamespace></Project>", "net/Models/User.cs": "namespace Acme.App.Models;\npublic class User {\n}\n", "net/Run.cs": "using Acme.App.Models;\npublic class Run {\n}\n"}


def test_configuration_contracts_and_every_tool(spark, tmp_path):
    root = tmp_path / "tree"
    whole = {"tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["lib/*"]}}}', "go.mod": "module example.org/m\n", "web/api.ts": API, "lib/store.ts": STORE, "ui/page.ts": PAGE, "bad.py": "def good(x):\n    return x\n\nclass K(:\n", "routes.py": "@app.get('/q')\ndef q():\n    return {'a': 1}\n"} | GO | CS
    for name, body in whole.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    snapshot = str(tmp_path / "snapshot")
    run = lambda *a: json.loads(cli.main(list(a), spark))
    run("index", str(root), snapshot)
    t = index.load(spark, snapshot)
    rows = {r.id: r for r in t["symbols"].collect()}
    calls = {(rows[r.src].name, rows[r.dst].name) for r in t["edges"].where("rel_type = 'calls'").collect()}
    assert {("list", "load"), ("show", "list"), ("main", "Open")} <= calls
    imports = {(rows[r.src].file_path, rows[r.dst].file_path) for r in t["edges"].where("rel_type = 'imports'").collect()}
    assert imports == {("web/api.ts", "lib/store.ts"), ("ui/page.ts", "web/api.ts"), ("cmd/main.go", "store/open.go"), ("net/Run.cs", "net/Models/User.cs")}
    by = {r.name: r for r in rows.values()}
    assert by["list"].response_keys == ["items", "next page", "total"] and by["show"].accessed_keys == ["items", "missing"]
    assert "fake" not in by and {"good", "K"} <= set(by) and by["q"].response_keys == ["a"]
    assert [(r.framework, r.method, r.name) for r in t["declared"].collect()] == [("fastapi", "GET", "/q")]

    tool = lambda name, **a: run("tool", snapshot, name, json.dumps(a))["rows"]
    assert [(r["name"], r["key"], r["confidence"]) for r in tool("shape_check")] == [("show", "missing", "low")]
    assert {(r["name"], r["mismatches"]) for r in tool("shape_check", route="list")} == {("show", 1)}
    assert {r["name"] for r in tool("impact_analysis", target="load")} == {"list", "show"}
    assert {(r["name"], r["rel_type"]) for r in tool("impact_analysis", target="axios")} == {("show", "dependsOn")}
    assert [r["section"] for r in tool("get_symbol_context", symbol="load", token_budget=1)] == ["target", "process"]
    assert {r["id"] for r in tool("trace_data_flow", entry_point="list")} <= set(rows)
    assert [r["name"] for r in tool("trace", **{"from": "show", "to": "load"})] == ["show", "list", "load"]
    assert {r["name"] for r in tool("find_dead_code")} <= {r.name for r in rows.values()} and tool("find_hotspots", min_complexity=0)
    assert {r["reason"] for r in tool("rename", symbol="load", new_name="fetch")} >= {"definition", "calls"}
    assert tool("verify_claim", kind="edge", **{"from": by["list"].id, "to": by["load"].id})[0]["present"]
    assert {r["name"] for r in tool("augment", pattern="load")} == {"load"} and "load" in {r["name"] for r in tool("smart_search", query="export function load(n)")}

    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init")
    git("add", ".")
    git("commit", "-m", "x")
    (root / "lib/store.ts").write_text(STORE.replace("return n", "return n + 1"))
    got = run("tool", snapshot, "detect_changes", '{"granularity": "symbol"}', "--root", str(root))["rows"]
    assert [(r["changed"], r["affected"]) for r in got] == [(1, 2)]

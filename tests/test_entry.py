"""The entry points, with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names_have_queries():
    import __spark_entry__ as e

    found = e.queries()
    assert len(found) > 60 and set(e.oracle_sql()) <= set(found)


def test_everything_else_imports_without_them(tmp_path):
    for name in ("codeloom", "__spark_entry__.py", "bench.py"):
        (shutil.copytree if os.path.isdir(f"{ROOT}/{name}") else shutil.copy)(f"{ROOT}/{name}", tmp_path / name)
    shutil.rmtree(tmp_path / "codeloom" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; n = e.queries(); assert n and not any(k.startswith('op') or k == 'pipeline' for k in n) and set(e.oracle_sql()) <= set(n)"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_flagship(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["seed", "id", "depth", "role", "confidence", "risk"] and df.count() >= 0


def test_flagship_has_every_symbol_that_is_called(spark):
    import __spark_entry__ as e
    from codeloom.plans import fixtures as fx

    sf = "/root/testdata/sf0.001"
    callers = {}
    for r in fx.calls(spark, sf).collect():
        callers.setdefault(r.dst, set()).add(r.src)
    want = {}
    for r in fx.symbols(spark, sf).collect():
        depth, level, seen = 0, callers.get(r.id, set()), {}
        while level and depth < 20:
            depth += 1
            seen |= dict.fromkeys(level, depth)
            level = {x for i in level for x in callers.get(i, ())} - set(seen)
        want |= {(r.id, i): d for i, d in seen.items()}
    assert want and {(r.seed, r.id): r.depth for r in e.entry(spark).collect()} == want

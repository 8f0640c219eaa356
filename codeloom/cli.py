"""Command line: index a tree, ask, call a tool, export, watch."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame

from codeloom.operators import export
from codeloom.plans import index
from codeloom.plans.tools import TOOLS, Engine, envelope, status
from codeloom.session import session
from codeloom.streaming import watch


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codeloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("index", help="index a source tree into a snapshot")
    a.add_argument("root")
    a.add_argument("snapshot")
    a.add_argument("--from", dest="old", help="an earlier snapshot, to parse only what changed")
    for name, what in (("status", "counts"), ("export", "write Markdown files")):
        a = sub.add_parser(name, help=what)
        a.add_argument("snapshot")
        if name == "export":
            a.add_argument("folder")
    a = sub.add_parser("ask", help="answer a sentence")
    a.add_argument("snapshot")
    a.add_argument("sentence")
    a = sub.add_parser("tool", help="call a tool with JSON arguments")
    a.add_argument("snapshot")
    a.add_argument("name", choices=sorted(TOOLS))
    a.add_argument("arguments", nargs="?", default="{}")
    a.add_argument("--root", help="the repository of the snapshot, whose changes detect_changes reads")
    a = sub.add_parser("watch", help="index again whenever change records arrive")
    a.add_argument("root")
    a.add_argument("changes", help="a folder of JSON lines with root, path, ts")
    a.add_argument("snapshots", help="a folder that gets a snapshot per batch")
    a.add_argument("--once", action="store_true", help="handle what is there, then end")
    return p


def engine(spark, snapshot: str, root: str | None = None) -> Engine:
    t = index.load(spark, snapshot)
    return Engine(t["symbols"], t["edges"], t["members"], t["steps"], dependencies=t["dependencies"], root=root, embeddings=t["embeddings"], embed=lambda s: index.embed(spark, s))


def answer(rows: DataFrame | None, summary: str) -> str:
    if rows is None:
        return json.dumps({"summary": summary, "rows": []})
    e = envelope(rows, summary).first()
    return json.dumps({"summary": e.summary, "shown": e.shown, "truncated": e.truncated, "rows": [json.loads(x) for x in e.rows]}, ensure_ascii=False)


def main(argv: list[str] | None = None, spark=None) -> str:
    a = parser().parse_args(argv)
    spark = spark or session()
    if a.command == "index":
        n = index.index_tree(spark, a.root, a.snapshot, a.old).groupBy("status").count().collect()
        out = json.dumps({r.status: r["count"] for r in n})
    elif a.command == "status":
        t = index.load(spark, a.snapshot)
        out = answer(status(t["symbols"], t["edges"], t["members"]), "status")
    elif a.command == "export":
        t = index.load(spark, a.snapshot)
        docs = export.documents(t["symbols"], t["edges"].where("rel_type = 'calls'"), t["members"], t["steps"])
        out = json.dumps({"files": export.write_vault(docs, a.folder).count()})
    elif a.command == "ask":
        intent, confidence, rows = engine(spark, a.snapshot).ask(a.sentence)
        out = answer(rows, f"{intent} ({confidence})")
    elif a.command == "tool":
        out = answer(engine(spark, a.snapshot, a.root).call(a.name, **json.loads(a.arguments)), a.name)
    else:
        last: list[str] = []

        def reindex(paths: DataFrame, batch: int) -> None:
            to = f"{a.snapshots}/{batch:06d}"
            index.index_tree(spark, a.root, to, last[-1] if last else None)
            last.append(to)

        q = watch.watch(watch.change_events(spark, a.changes), reindex, f"{a.snapshots}/checkpoint", None if a.once else "300 milliseconds")
        q.awaitTermination()
        out = json.dumps({"snapshots": last})
    print(out)
    return out


if __name__ == "__main__":
    main()

"""python -m sedimark.cli COMMAND ...: the operators on files and directories."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from sedimark import api, tools
from sedimark import config as C
from sedimark.errors import SedimarkError
from sedimark.operators import chunking, query
from sedimark.operators.search import SearchFilter
from sedimark.sources import scan


def session() -> SparkSession:
    s = SparkSession.builder.appName("sedimark").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    C.apply_runtime(s)
    return s


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sedimark")
    p.add_argument("--store", default=None)
    p.add_argument("--config", default=None)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: str, **options):
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        for k, v in options.items():
            c.add_argument("--" + k.replace("_", "-"), **v)

    flag = {"action": "store_true"}
    for name in ("info", "metadata", "outline", "page-count", "hash"):
        add(name, "path")
    add("verify", "path", "expected")
    add("search", "path", "query")
    add("grep", "root", "query")
    add("read", "path", **{k: {} for k in ("page", "slide", "note", "sheet", "cell", "table", "image", "heading", "paragraph", "range", "slice")})
    add("scan", "root", no_hash=flag)
    add("chunk", "path", max_tokens={"type": int, "default": 800}, min_tokens={"type": int, "default": 100})
    add("index", "root", full=flag, watch=flag, once=flag)
    add("query", "text", mode={"default": "Auto"}, top_k={"type": int, "default": 10}, depth={"type": int, "default": 0}, file=dict(), context=flag)
    add("vector-search", "text", top_k={"type": int, "default": 10}, hybrid=flag, expand={"type": int, "default": 0}, file=dict(), heading=dict(), block_type=dict(), after={"type": int}, before={"type": int})
    add("graph-expand", "node", depth={"type": int, "default": 1}, direction={"default": "both"})
    add("graph-path", "start", "goal")
    add("graph-info", "file_id")
    add("graph-stats")
    add("vector-status")
    add("config")
    add("watch", "root", once=flag)
    add("init", "folder", store_path={"default": ".sedimark"})
    add("tools", "root")
    return p


def run(argv: list[str], spark: SparkSession | None = None, out=print) -> int:
    a = parser().parse_args(argv)
    conf = C.load(os.path.expanduser("~/.sedimark.json"), a.config or ".sedimark.json")
    show = lambda x: out(json.dumps(x, ensure_ascii=False, default=str))
    try:
        if a.command in ("info", "metadata", "outline", "page-count", "search", "read", "chunk"):
            doc = api.open_doc(a.path)
            if a.command in ("info", "metadata"):
                show(doc.metadata())
            elif a.command == "page-count":
                show(doc.page_count())
            elif a.command == "outline":
                show([(e.level, e.label) for e in doc.outline()])
            elif a.command == "search":
                show([(m.place, m.text, m.context) for m in doc.search(a.query)])
            elif a.command == "read":
                kind = next((k for k in ("slice", "page", "heading", "paragraph", "table", "sheet", "slide", "cell", "image", "note", "range") if getattr(a, k) is not None), None)
                show(doc.read(kind, getattr(a, kind)) if kind else doc.read())
            else:
                show(doc.chunks(chunking.ChunkConfig(a.min_tokens, a.max_tokens)))
            return 0
        if a.command == "hash":
            show(scan.hash_file(a.path))
            return 0
        if a.command == "verify":
            ok = scan.verify_hash(a.path, a.expected)
            show(ok)
            return 0 if ok else 1
        if a.command == "config":
            out(C.shown(conf))
            return 0
        if a.command == "init":
            show(tools.set_up(a.folder, a.store_path))
            return 0
        if a.command == "tools":
            tools.Tools(a.root, a.store or conf.storage.path, lambda: spark or session()).serve()
            return 0
        spark = spark or session()
        if a.command == "scan":
            for r in scan.scan(spark, a.root, hashed=not a.no_hash).orderBy("path").toLocalIterator():
                show(r.asDict())
            return 0
        if a.command == "watch":
            for e in api.watch_directory(spark, a.root, once=a.once):
                show(e)
            return 0
        if a.command == "grep":
            for r in api.grep_docs(spark, a.root, a.query).orderBy("path").toLocalIterator():
                show(r.asDict())
            return 0
        index = api.Index(spark, a.store or conf.storage.path, conf)
        if a.command == "index" and a.watch:
            stream = index.watch(a.root, os.path.join(a.store or conf.storage.path, "watched"), a.once, done=lambda r: show(r.__dict__))
            stream.awaitTermination()
        elif a.command == "index":
            show(index.add(a.root, "Full" if a.full else "Incremental").__dict__)
        elif a.command == "query":
            options = {"mode": a.mode, "top_k": a.top_k, "depth": a.depth, "where": SearchFilter(file_id=a.file) if a.file else None, "any_term": True}
            out(query.preview(index.query(a.text, **options).collect()))
            if a.context:
                for r in index.engine().windows(query.Query(a.text, **options)).orderBy("anchor_id", "distance").toLocalIterator():
                    show(r.asDict())
        elif a.command == "vector-search":
            where = SearchFilter(a.file, a.heading, a.block_type, a.after, a.before)
            found = index.vector_search(a.text, a.top_k, where if where != SearchFilter() else None, a.hybrid, a.expand)
            out(query.preview(found.collect()))
        elif a.command == "graph-expand":
            nodes, edges = index.expand(a.node, a.depth, a.direction)
            show({"nodes": [r.id for r in nodes.orderBy("id").collect()], "edges": [r.edge_id for r in edges.orderBy("edge_id").collect()]})
        elif a.command == "graph-path":
            show(index.path(a.start, a.goal))
        elif a.command == "graph-info":
            show(index.graph_info(a.file_id))
        elif a.command == "graph-stats":
            show(index.stats())
        elif a.command == "vector-status":
            show(index.status())
        return 0
    except (SedimarkError, FileNotFoundError) as x:
        out(f"{type(x).__name__}: {x}")
        return 1


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))

"""A tool server for agents: requests as lines of JSON (JSON-RPC 2.0) on standard input, answers on standard output."""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Callable
from typing import TextIO

from pyspark.sql import SparkSession

from sedimark import api
from sedimark.errors import InvalidQuery, SedimarkError
from sedimark.sources import scan
from sedimark.sources.documents import Document

#: Units that a document is read by if nothing is asked for.
FIRST_UNITS = 20
_TEXT = {"type": "string"}


def selector(d: Document, text: str | None) -> tuple:
    """``kind:value`` as a selector of the document: numbers for pages, ``start,end`` for ranges and slices. Without one the first units."""
    if not text:
        return ("slice", (0, FIRST_UNITS))
    kind, colon, value = text.partition(":")
    if not colon:
        raise InvalidQuery(f"no selector: {text}")
    if kind in ("range", "slice"):
        start, _, end = value.partition(",")
        return kind, (int(start), int(end))
    return kind, [int(x) for x in value.split(",")] if kind == "pages" else int(value) if kind in ("page", "slide", "note", "table", "image", "paragraph") else value


class Tools:
    """Twelve tools; those that need an index are there if ``store`` names one. Paths are below ``root``."""

    def __init__(self, root: str = ".", store: str | None = None, spark: Callable[[], SparkSession] | None = None):
        self.root, self.store, self._spark, self._index = root, store, spark, None

    @property
    def index(self) -> api.Index:
        if not self.store or not self._spark:
            raise InvalidQuery("there is no index")
        self._index = self._index or api.Index(self._spark(), self.store)
        return self._index

    def _open(self, path: str) -> Document:
        return Document(scan.within(self.root, path))

    def read(self, path: str, selector: str | None = None) -> list:
        d = self._open(path)
        return [p if isinstance(p, (str, list)) else p[0] for p in d.read(*globals()["selector"](d, selector))]

    def search(self, path: str, query: str) -> list:
        return [{"place": m.place, "text": m.text, "context": m.context} for m in self._open(path).search(query)]

    def grep(self, folder: str, query: str) -> list:
        return [r.asDict() for r in api.grep_docs(self._spark(), scan.within(self.root, folder), query).orderBy("path").collect()]

    def info(self, path: str) -> dict:
        d = self._open(path)
        return {**d.metadata(), "outline": [{"level": e.level, "label": e.label} for e in d.outline()]}

    def scan(self, folder: str) -> list:
        return [r.asDict() for r in scan.scan(self._spark(), scan.within(self.root, folder)).orderBy("path").collect()]

    def chunk(self, path: str) -> list:
        return self._open(path).chunks()

    def verify(self, path: str, hash: str) -> bool:
        return scan.verify_hash(scan.within(self.root, path), hash)

    def query(self, text: str, mode: str = "Auto", top_k: int = 10, depth: int = 0) -> list:
        return [r.asDict() for r in self.index.query(text, mode=mode, top_k=top_k, depth=depth, any_term=True).collect()]

    def vector_status(self) -> dict:
        return self.index.status()

    def graph_info(self, file_id: str) -> dict:
        return self.index.graph_info(file_id)

    def graph_expand(self, node: str, depth: int = 1, direction: str = "both") -> dict:
        nodes, edges = self.index.expand(node, depth, direction)
        return {"nodes": sorted(r.id for r in nodes.collect()), "edges": sorted(r.edge_id for r in edges.collect())}

    def graph_stats(self) -> dict:
        return self.index.stats()

    NAMES = ("read", "search", "grep", "info", "scan", "chunk", "verify", "query", "vector_status", "graph_info", "graph_expand", "graph_stats")

    def listed(self) -> list[dict]:
        """Name, purpose and parameters of each tool."""
        out = []
        for n in self.NAMES:
            f = getattr(type(self), n)
            names = [a for a in f.__code__.co_varnames[1 : f.__code__.co_argcount]]
            must = names[: len(names) - len(f.__defaults__ or ())]
            kinds = {"top_k": {"type": "integer"}, "depth": {"type": "integer"}}
            out.append({"name": n, "description": f"{n.replace('_', ' ')} of documents" if n in self.NAMES[:7] else f"{n.replace('_', ' ')} of the index", "inputSchema": {"type": "object", "properties": {a: kinds.get(a, _TEXT) for a in names}, "required": must}})
        return out

    def call(self, name: str, arguments: dict):
        if name not in self.NAMES:
            raise InvalidQuery(f"no such tool: {name}")
        try:
            return getattr(self, name)(**arguments)
        except TypeError as e:
            raise InvalidQuery(str(e)) from e

    def resource(self, uri: str) -> str:
        """The whole text of ``document://path``."""
        if not uri.startswith("document://"):
            raise InvalidQuery(f"no such resource: {uri}")
        return "\n".join(p if isinstance(p, str) else "\n".join("\t".join(r) for r in p) for p in self._open(uri.removeprefix("document://")).read())

    def answer(self, request: dict) -> dict | None:
        """The answer to a request, None to a notification."""
        method, p, key = request.get("method", ""), request.get("params") or {}, request.get("id")
        if key is None:
            return None
        reply = {"jsonrpc": "2.0", "id": key}
        try:
            match method:
                case "initialize":
                    result = {"protocolVersion": p.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}, "resources": {}}, "serverInfo": {"name": "sedimark", "version": "1"}}
                case "ping":
                    result = {}
                case "tools/list":
                    result = {"tools": self.listed()}
                case "tools/call":
                    try:
                        result = {"content": [{"type": "text", "text": json.dumps(self.call(p.get("name", ""), p.get("arguments") or {}), ensure_ascii=False, default=str)}], "isError": False}
                    except (SedimarkError, ValueError, OSError) as e:
                        result = {"content": [{"type": "text", "text": f"{type(e).__name__}: {e}"}], "isError": True}
                case "resources/read":
                    result = {"contents": [{"uri": p.get("uri", ""), "mimeType": "text/plain", "text": self.resource(p.get("uri", ""))}]}
                case _:
                    return {**reply, "error": {"code": -32601, "message": f"no such method: {method}"}}
            return {**reply, "result": result}
        except (SedimarkError, ValueError, OSError) as e:
            return {**reply, "error": {"code": -32000, "message": f"{type(e).__name__}: {e}"}}

    def serve(self, source: TextIO = sys.stdin, sink: TextIO = sys.stdout) -> None:
        for line in source:
            if not line.strip():
                continue
            try:
                request = json.loads(line)
            except ValueError as e:
                reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
            else:
                reply = self.answer(request)
            if reply is not None:
                print(json.dumps(reply, ensure_ascii=False), file=sink, flush=True)


def set_up(folder: str, store: str) -> list[str]:
    """Writes a project's configuration and the entry by which an agent starts the server, unless they are there; the paths written."""
    out = []
    for name, content in ((".sedimark.json", {"storage": {"path": store}}), (".mcp.json", {"mcpServers": {"sedimark": {"command": sys.executable, "args": ["-m", "sedimark.cli", "--store", store, "tools", folder]}}})):
        path = os.path.join(folder, name)
        if not os.path.exists(path):
            with open(path, "w") as f:
                json.dump(content, f, indent=2)
            out.append(path)
    return out

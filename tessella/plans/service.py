"""The tool surface: named tools over one graph, as Python calls or JSON-RPC lines.

Results are small by nature (a node's neighbours, a page of search results);
lists that a graph could make long come in pages of ``ROWS`` with their total;
``offset`` asks for the next.
"""

from __future__ import annotations

import json
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import context, graph
from tessella.operators.search import Index, documents_of
from tessella.plans import rules
from tessella.plans.manifest import Manifest
from tessella.sources import files as S

ROWS = 10_000


class ToolError(ValueError):
    pass


class Service:
    def __init__(self, spark: SparkSession, edges: DataFrame, manifest: Manifest | None = None, metadata: DataFrame | None = None, sources: DataFrame | None = None, symbols: DataFrame | None = None):
        self.spark, self.edges, self.manifest = spark, edges, manifest
        self.metadata = metadata if metadata is not None else spark.createDataFrame([], "path string, key string, value string")
        self.sources, self.symbols, self._seq = sources, symbols, 0

    def tools(self) -> dict[str, tuple[Callable, list[str]]]:
        """Each tool's function and its required arguments."""
        return {
            "vfs_get_metadata": (self.get_metadata, ["path"]),
            "vfs_set_metadata": (self.set_metadata, ["path", "key", "value"]),
            "vfs_graph_related": (self.related, ["path"]),
            "vfs_graph_stats": (self.stats, []),
            "vfs_graph_untested": (self.untested, []),
            "vfs_graph_module": (self.module, ["module_name"]),
            "vfs_graph_impact": (self.impact, ["path"]),
            "vfs_graph_understand": (self.understand, ["task"]),
            "vfs_graph_search": (self.search, ["query"]),
            "vfs_rule_list": (self.rule_list, []),
            "vfs_rule_check": (self.rule_check, ["name"]),
            "vfs_list_directory": (self.list_directory, ["path"]),
            "vfs_resolve_path": (self.resolve_path, ["path"]),
            "vfs_backend_status": (self.backend_status, ["path"]),
            "vfs_sync_backend": (self.sync_backend, ["path"]),
        }

    def call(self, name: str, arguments: dict | None = None):
        arguments = arguments or {}
        if name not in self.tools():
            raise ToolError(f"unknown tool: {name}")
        run, required = self.tools()[name]
        for a in required:
            if a not in arguments:
                raise ToolError(f"missing argument: {a}")
        return run(**arguments)

    def _rows(self, df: DataFrame, offset: int = 0) -> dict:
        """A page of ROWS rows of an ordered result, and how many rows there are in all."""
        found = [r.asDict(recursive=True) for r in df.offset(int(offset)).limit(ROWS + 1).collect()]
        more = len(found) > ROWS
        total = df.count() if more or offset else len(found)
        return {"rows": found[:ROWS], "total": total, "truncated": more} | ({"next_offset": int(offset) + ROWS} if more else {})

    def get_metadata(self, path: str, keys: list[str] | None = None):
        return {"path": path, "attributes": {r["key"]: r["value"] for r in S.get_attributes(self.metadata, path, keys).collect()}}

    def set_metadata(self, path: str, key: str, value: str):
        if not key:
            raise ToolError("the key is empty")
        before = self.get_metadata(path, [key.removeprefix("user.vfs.")])["attributes"]
        self._seq += 1
        update = self.spark.createDataFrame([(path, key, value, self._seq)], "path string, key string, value string, seq long")
        self.metadata = S.set_attributes(self.metadata, update)
        return {"path": path, "key": key, "previous": next(iter(before.values()), None)}

    def related(self, path: str, relation: str | None = None, direction: str = "forward", offset: int = 0):
        found = graph.related_any(self.edges, path, relation, direction).orderBy("src", "dst", "rel", "provenance")
        package = (F.col("src").startswith("pkg:") | F.col("dst").startswith("pkg:")).alias("external_package")
        return self._rows(found.select("*", package), offset)

    def stats(self):
        return {**graph.stats(self.edges).first().asDict(), "types": {r["rel"]: r["cnt"] for r in graph.edge_types(self.edges).collect()}, "top": self._rows(graph.top_dependencies(self.edges))["rows"]}

    def untested(self, offset: int = 0):
        return self._rows(graph.untested(self.edges).orderBy("path"), offset)

    def module(self, module_name: str, offset: int = 0):
        page = self._rows(graph.module_files(self.edges, module_name).orderBy("path"), offset)
        files = [r["path"] for r in page.pop("rows")]
        return graph.module_stats(self.edges, module_name).first().asDict() | {"files": files} | page

    def impact(self, path: str, max_depth: int = graph.DEPTHS["tools"], include_external: bool = False, offset: int = 0):
        found = graph.impact_or_fail(self.edges, path, int(max_depth), self.sources, external=include_external)
        return self._rows(found.orderBy("depth", "path"), offset)

    def understand(self, task: str, token_budget: int = 6000):
        out = context.understand(self.edges, task, self.sources, self.symbols, context.Options(token_budget=int(token_budget)))
        return {"text": out["text"], "tokens_estimate": out["tokens_estimate"], "anchors": out["anchors"]}

    def search(self, query: str, limit: int = 20):
        return self._rows(Index(documents_of(self.edges)).search(query, int(limit)))

    def rule_list(self):
        return [{"name": r.name, "description": r.description} for r in (self.manifest.rule_list() if self.manifest else [])]

    def rule_check(self, name: str):
        rule = rules.find(self.manifest.rule_list() if self.manifest else [], name)
        rules.register(self.spark, self.edges, metadata=self.metadata)
        found = rules.check(self.spark, rule)
        if isinstance(found, rules.Failure):
            return {"rule": name, "error": found.error}
        return {"rule": name, "columns": found.columns, **self._rows(rules.compatible(found))}

    def _mounts(self) -> list[dict]:
        return self.manifest.mounts() if self.manifest else []

    def list_directory(self, path: str):
        at = [m["at"] for m in self._mounts() if path == "/" or m["at"].startswith(path)]
        below = S.names_under(self.sources, path).collect() if self.sources is not None else []
        return {"path": path, "mounts": at, "entries": sorted(r["name"] for r in below)}

    def resolve_path(self, path: str):
        return S.resolve(self.spark.createDataFrame([(path,)], "path string"), self._mounts()).first().asDict()

    def backend_status(self, path: str):
        found = self.resolve_path(path)
        kinds = {m["name"]: m["backend_type"] for m in self._mounts()}
        return found | {"type": kinds.get(found["backend"], "local")}

    def sync_backend(self, path: str):
        """What a sync would cover; nothing is transferred."""
        return self.backend_status(path) | {"synced": 0}

    # --- JSON-RPC ---------------------------------------------------------

    def answer(self, line: str) -> dict | None:
        """The reply to one JSON-RPC line; None for a notification."""
        try:
            request = json.loads(line)
        except ValueError:
            return {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "Parse error"}}
        if not isinstance(request, dict) or "id" not in request:
            return None
        method, params, reply = request.get("method", ""), request.get("params") or {}, {"jsonrpc": "2.0", "id": request["id"]}
        try:
            if method == "initialize":
                result = {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "tessella", "version": "0.1.0"}}
            elif method == "tools/list":
                result = {"tools": [{"name": n, "inputSchema": {"type": "object", "required": required}} for n, (_, required) in self.tools().items()]}
            elif method == "tools/call":
                out = self.call(params.get("name", ""), params.get("arguments"))
                result = {"content": [{"type": "text", "text": json.dumps(out, ensure_ascii=False, default=str)}]}
            else:
                return reply | {"error": {"code": -32601, "message": f"Method not found: {method}"}}
        except Exception as e:  # a tool's failure is an answer
            return reply | {"error": {"code": -32603, "message": str(e)}}
        return reply | {"result": result}

    def serve(self, lines=sys.stdin, out=sys.stdout, rate: float = 0.0) -> None:
        """Answer lines until they end; with a rate, calls beyond it get code -32000."""
        tokens, last = rate, time.monotonic()
        for line in lines:
            if not line.strip():
                continue
            now = time.monotonic()
            tokens, last = min(rate, tokens + (now - last) * rate), now
            if rate and tokens < 1:
                reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32000, "message": "Rate limit exceeded"}}
            else:
                tokens -= 1
                reply = self.answer(line)
            if reply is not None:
                print(json.dumps(reply, ensure_ascii=False), file=out, flush=True)

"""Commands over a store: a function, a command line, and JSON-RPC lines."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from typing import IO

from pyspark.sql import SparkSession

from . import ship
from .errors import CodedError
from .operators import graph, search
from .plans import bootstrap, business, control, knowledge
from .sources.store import Store

NODE_COLUMNS = ("node_id", "kind", "sub_kind", "canonical_key", "payload")


def _search(store: Store, query: str, limit: int = 20) -> dict:
    snapshot = store.published()
    found = search.search_or_fail(store.part("nodes", snapshot["snapshot_id"]), store.index(snapshot["snapshot_id"]), query, limit)
    ref = knowledge.snapshot_ref(snapshot)
    rows = [r.asDict() for r in found.select(*NODE_COLUMNS, "matched_fields", "score", "evidence_id").collect()]
    return {"ok": True, "snapshot_ref": ref, "nodes": [{**r, "payload": json.loads(r["payload"]), "evidence_refs": [x for x in [r.pop("evidence_id")] if x is not None], "snapshot_ref": ref} for r in rows], "degraded": False}


def _expand(store: Store, node_ids: list[int], depth: int = 1, node_budget: int = 100, edge_budget: int = 100, direction: str = "out", edge_types: list[str] = (), node_scope: dict | None = None) -> dict:
    snapshot = store.published()
    nodes, edges = store.part("nodes", snapshot["snapshot_id"]), store.part("edges", snapshot["snapshot_id"])
    out = graph.expand(nodes, edges, node_ids, depth, node_budget, edge_budget, direction, tuple(edge_types), node_scope)
    return {"ok": True, "snapshot_ref": knowledge.snapshot_ref(snapshot), "edges": out.edges, "paths": out.paths, "coverage": out.coverage, "truncated": out.truncated}


def _bootstrap(store: Store, source_root: str, manifest: dict | None = None, scope: list[str] = (), exclude: list[str] = (), expected_parent: int | None = None) -> dict:
    own = control.manifest(store)
    if own is None:
        raise CodedError("SERVICE_NOT_READY")
    own |= manifest or {}
    return bootstrap.build(store, source_root, own["source_revision"], own["config_version"], list(scope), list(exclude), expected_parent)


def _sync(store: Store, baseline_ref: int, source_root: str, target_source_revision: str = "", operation_id: str = "default", manifest: dict | None = None, scope: list[str] = ()) -> dict:
    config = (manifest or {}).get("config_version", "1")
    return bootstrap.sync(store, operation_id, baseline_ref, source_root, target_source_revision, config, list(scope))


def _migrate(store: Store) -> dict:
    store.create()
    return {"ok": True, "command": "migrate", "status": "migrated"}


COMMANDS: dict[str, tuple[Callable[..., dict], str]] = {
    "init": (lambda store, manifest=None: control.initialize(store, manifest), "Set up a store with its manifest."),
    "migrate": (_migrate, "Create the store's tables."),
    "doctor": (control.health, "Check readiness and tool permissions."),
    "health": (control.health, "Report the service's health."),
    "bootstrap": (_bootstrap, "Build and publish a snapshot of a source tree."),
    "search": (_search, "Search the nodes of the published snapshot."),
    "expand": (_expand, "Expand relations of nodes, with paths."),
    "sync": (_sync, "Update from a baseline snapshot."),
    "evaluate": (lambda store, **p: knowledge.evaluate(store, **p), "Evaluate queries against a golden set."),
    "knowledge-generate": (lambda store, document_kind, document_scope, template_version, generator_version, impact_node_ids=(): knowledge.generate(store, document_kind, document_scope, template_version, generator_version, None, impact_node_ids), "Generate a knowledge document."),
    "knowledge-push": (lambda store, manifest_id, target, idempotency_key: knowledge.push(store, manifest_id, target, idempotency_key), "Push a document to a target."),
    "confirm": (lambda store, **p: business.confirm(store, **p), "Confirm or reject a mapping."),
    "mine": (lambda store, mining_mode, snapshot_id, candidates: business.mine(store, mining_mode, snapshot_id, candidates), "Store mapping candidates."),
    "resolve_business_context": (lambda store, query_text, ttl_seconds=300: business.resolve(store, query_text, ttl_seconds), "Resolve a term to contexts."),
    "select_business_context": (lambda store, route_token, context_id: business.select(store, route_token, context_id), "Select a context with a route token."),
}


def run(spark: SparkSession, command: str, root: str, **params) -> dict:
    """A command's result; a refusal is ``{"ok": False, "code": ...}``."""
    if command not in COMMANDS:
        return {"ok": False, "code": "UNKNOWN_COMMAND", "command": command}
    ship(spark)
    try:
        return COMMANDS[command][0](Store(spark, root), **params)
    except CodedError as e:
        return {"ok": False, "code": e.code}


# fixed values of the protocol
PROTOCOL = "2025-03-26"
#: methods that may be called by name, with their parameters
METHODS = {
    "confirm": {"mapping_id", "expected_version", "decision", "evidence_refs", "reason", "review_mode", "updated_by"},
    "search": {"query", "limit"},
    "expand": {"node_ids", "depth", "node_budget", "edge_budget", "direction", "edge_types", "node_scope"},
    "health": set(),
    "doctor": set(),
    "init": {"manifest"},
    "migrate": set(),
    "bootstrap": {"manifest", "source_root", "scope", "exclude", "expected_parent"},
}
PROTOCOL_METHODS = {"initialize": {"protocolVersion", "capabilities", "clientInfo"}, "tools/list": {"cursor"}, "tools/call": {"name", "arguments"}}


class RpcError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def _checked(method: str, p: dict) -> dict:
    is_int = lambda x: isinstance(x, int) and not isinstance(x, bool)
    wrong = {
        "search": lambda: not isinstance(p.get("query"), str) or not p["query"] or not is_int(p.get("limit", 1)) or p.get("limit", 1) < 1,
        "expand": lambda: not isinstance(p.get("node_ids"), list) or not all(map(is_int, p["node_ids"])) or any(not is_int(p.get(k, 0)) or p.get(k, 0) < 0 for k in ("depth", "node_budget", "edge_budget")) or p.get("direction", "out") not in graph.DIRECTIONS or not isinstance(p.get("edge_types", []), list) or not all(isinstance(x, str) for x in p.get("edge_types", [])) or not isinstance(p.get("node_scope", {}), dict),
        "bootstrap": lambda: not isinstance(p.get("source_root"), str) or not p["source_root"],
    }.get(method)
    if wrong and wrong():
        raise RpcError(-32602, "Invalid params")
    return p


class Rpc:
    """Answers JSON-RPC 2.0 lines; one bad line never ends the service. ``runner`` is ``run`` without its session."""

    def __init__(self, runner: Callable[..., dict], default_root: str):
        self.runner, self.default_root = runner, default_root

    def call(self, name: str, params: dict) -> dict:
        params = dict(params)
        root = params.pop("database", self.default_root)
        return self.runner(name, root, **_checked(name, params))

    def result(self, method: str, params: dict):
        if method == "initialize":
            return {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "graphloom", "version": "0.1.0"}}
        if method == "tools/list":
            return {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": {}, "additionalProperties": True}} for n, (_, d) in COMMANDS.items()]}
        if method == "tools/call":
            if params.get("name") not in COMMANDS or not isinstance(params.get("arguments", {}), dict):
                raise RpcError(-32602, "Invalid params")
            found = self.call(params["name"], params.get("arguments", {}))
            return {"content": [{"type": "text", "text": json.dumps(found, ensure_ascii=False, sort_keys=True)}], "isError": isinstance(found, dict) and found.get("ok") is False}
        return self.call(method, params)

    def answer(self, line: str) -> dict:
        at = None
        try:
            try:
                request = json.loads(line)
            except ValueError:
                raise RpcError(-32700, "Parse error") from None
            if not isinstance(request, dict):
                raise RpcError(-32600, "Invalid Request")
            at, method = request.get("id"), request.get("method")
            if request.get("jsonrpc") != "2.0" or "id" not in request or not isinstance(method, str):
                raise RpcError(-32600, "Invalid Request")
            allowed = PROTOCOL_METHODS.get(method) or ({*METHODS[method], "database"} if method in METHODS else None)
            if allowed is None:
                raise RpcError(-32601, "Method not found")
            params = request.get("params", {})
            if not isinstance(params, dict) or not params.keys() <= allowed:
                raise RpcError(-32602, "Invalid params")
            return {"jsonrpc": "2.0", "id": at, "result": self.result(method, params)}
        except RpcError as e:
            return {"jsonrpc": "2.0", "id": at, "error": {"code": e.code, "message": str(e)}}
        except ValueError as e:
            return {"jsonrpc": "2.0", "id": at, "error": {"code": -32602, "message": str(e) or "Invalid params"}}
        except Exception as e:  # noqa: BLE001
            print(f"request failed: {e}", file=sys.stderr)
            return {"jsonrpc": "2.0", "id": at, "error": {"code": -32603, "message": "Internal error"}}

    def serve(self, source: IO[str], sink: IO[str]) -> None:
        for line in source:
            if line.strip():
                sink.write(json.dumps(self.answer(line), ensure_ascii=False) + "\n")
                sink.flush()


#: the command line's options, by the type of the parameter they give: text, whole numbers, repeated ones, JSON
TEXTS = ("source_root", "query", "direction", "operation_id", "target_source_revision", "dataset_id", "golden_set_version", "document_kind", "document_scope", "template_version", "generator_version", "manifest_id", "target", "idempotency_key", "decision", "reason", "review_mode", "updated_by", "mining_mode", "query_text", "route_token", "context_id")
NUMBERS = ("expected_parent", "limit", "depth", "node_budget", "edge_budget", "baseline_ref", "minimum_samples", "mapping_id", "expected_version", "snapshot_id", "ttl_seconds")
REPEATED = {"scope": "scope", "exclude": "exclude", "node_id": "node_ids", "edge_type": "edge_types"}
JSONS = ("node_scope", "samples", "tool_versions", "evidence_refs", "candidates")
MANIFEST = ("project", "workspace", "source_revision", "config_version")


def parsed(argv: list[str] | None = None) -> tuple[str, str, dict]:
    """(command, root, parameters) of a command line."""
    parser = argparse.ArgumentParser(prog="graphloom", description="Versioned property graphs on Spark.", argument_default=argparse.SUPPRESS)
    parser.add_argument("command", choices=[*COMMANDS, "stdio"])
    parser.add_argument("--root", "--database", default=".graphloom")
    parser.add_argument("--params", type=json.loads, default={}, help="parameters as a JSON object")
    flag = lambda name: f"--{name.replace('_', '-')}"
    for name in (*TEXTS, *MANIFEST):
        parser.add_argument(flag(name), choices=graph.DIRECTIONS if name == "direction" else None)
    for name in NUMBERS:
        parser.add_argument(flag(name), type=int)
    for name, own in REPEATED.items():
        parser.add_argument(flag(name), dest=own, action="append", type=int if name == "node_id" else str)
    for name in JSONS:
        parser.add_argument(f"{flag(name)}-json", dest=name, type=json.loads)
    given = vars(parser.parse_args(argv))
    command, root, params = given.pop("command"), given.pop("root"), given.pop("params")
    own = {k: given.pop(k) for k in MANIFEST if k in given}
    if command in ("init", "bootstrap"):
        params = {"manifest": control.default_manifest(root, **own), **params}
    return command, root, {**given, **params}


def main(argv: list[str] | None = None) -> int:
    """``graphloom COMMAND [--root DIR] [options]``; exit status 0 if the result is ok."""
    command, root, params = parsed(argv)
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    runner = lambda command, root, **p: run(spark, command, root, **p)
    if command == "stdio":
        Rpc(runner, root).serve(sys.stdin, sys.stdout)
        return 0
    result = runner(command, root, **params)
    print(json.dumps(result, sort_keys=True, default=str))
    return 0 if result.get("ok") else 1


if __name__ == "__main__":
    sys.exit(main())

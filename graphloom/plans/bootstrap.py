"""Building a snapshot from a source tree, and incremental updates with impact analysis."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..errors import CodedError
from ..functions.parsers import Registry
from ..operators import binding, extract, graph, rows
from ..sources import changes as feed
from ..sources import files
from ..sources.store import Store, dumps
from . import publish


def _tasks(store: Store, snapshot_id: int, status: str) -> None:
    """Gives a snapshot's tasks a status; others' stay where they are."""
    store.put("tasks", store.rows("tasks").where(F.col("snapshot_id") == snapshot_id).withColumn("status", F.lit(status)), part=snapshot_id)


def _reject(store: Store, snapshot_id: int, code: str, **detail) -> dict:
    store.add("conflicts", {"snapshot_id": snapshot_id, "code": code, "detail": dumps(detail)})
    _tasks(store, snapshot_id, "failed")
    return {"ok": False, "status": "staging", "code": code, "snapshot_id": snapshot_id, **detail}


def build(store: Store, source_root: str, source_revision: str, config_version: str, scope: list[str], exclude: list[str] = (), expected_parent: int | None = None, registry: Registry | None = None) -> dict:
    """Scans, parses, binds, persists and publishes. A gate that fails leaves the snapshot staged and the pointer as it was."""
    if not source_revision:
        raise CodedError("SOURCE_REVISION_REQUIRED")
    if not scope:
        raise CodedError("SOURCE_SCOPE_REQUIRED")
    spark, registry = store.spark, registry or Registry.default()
    build_id = f"{source_root}:{source_revision}"
    if store.one("builds", build_id=build_id):
        raise CodedError("ARTIFACT_CONFLICT", build=build_id)
    found = files.scan(spark, source_root, scope, exclude)
    store.add("builds", {"build_id": build_id, "source_root": source_root, "source_revision": source_revision, "scope": dumps(list(scope)), "exclude": dumps(list(exclude)), "parsers": dumps(registry.summary()), "config_version": config_version})
    snapshot_id = store.lease("snapshots", 1, "snapshot_id") + 1
    revisions = {"source_revision": source_revision, "index_revision": f"bootstrap-{source_revision}", "config_version": config_version}
    store.add("snapshots", {"snapshot_id": snapshot_id, **revisions, "status": "staging"})
    task = found.select(F.concat(F.lit(f"{snapshot_id}:"), "path").alias("task_id"), F.lit(snapshot_id).cast("long").alias("snapshot_id"), "path", F.lit(source_revision).alias("source_revision"), F.lit("running").alias("status"))
    store.put("tasks", task, part=snapshot_id)
    bad = found.where("not valid").orderBy("path").limit(1).collect()
    if bad:
        return _reject(store, snapshot_id, "PARSE_FAILED", diagnostics=[{"code": "PARSE_FAILED", "path": bad[0].path, "message": "not UTF-8", "detail": {}}])
    parent = store.active()
    known = store.part("parsed", parent) if parent is not None else spark.createDataFrame([], extract.KEPT)
    parsed = graph.saved(extract.reused(found, known, registry))
    supported = F.col("parser_id").isNotNull()
    covered = parsed.withColumns({"supported": supported, "failed": F.lit(False)})
    of = lambda key: rows.coverage(covered, key.alias("key")).collect()  # noqa: E731  languages and parsers are few
    by = lambda counts: {r.key: r.supported for r in counts if r.supported}
    languages, versions = of(F.col("language")), by(of(F.when(supported, F.concat_ws("-", "parser_id", "parser_version"))))
    total = {c: sum(r[c] for r in languages) for c in ("files", "supported", "parsed")}
    coverage = {"files": total["files"], "supported_files": total["supported"], "unsupported_files": total["files"] - total["supported"], "parsed_files": total["parsed"], "languages": by(languages), "parsers": versions}
    told_of = rows.diagnostic_counts(covered.select("supported", F.explode("diagnostics"))).first()
    listed = parsed.where(F.size("diagnostics") > 0).select("path", supported.alias("supported"), "diagnostics").orderBy("path")  # in a file as found
    every = [(r.supported, {"code": x.code, "path": r.path, "message": x.message, "detail": json.loads(x.detail)}) for r in listed.toLocalIterator() for x in r.diagnostics]
    told = [x for _, x in every]  # all of them are part of the result
    diagnostics = {**told_of.asDict(), "details": told}
    if not total["supported"]:
        return _reject(store, snapshot_id, "COVERAGE_GATE_FAILED", coverage=coverage, diagnostics=told, diagnostic_counts=diagnostics)
    if diagnostics["parse_errors"]:
        return _reject(store, snapshot_id, "PARSE_FAILED", coverage=coverage, diagnostics=[x for known, x in every if known], diagnostic_counts=diagnostics)
    parser = parsed.select("path", F.col("parser_id").alias("parser"))
    nodes = graph.saved(extract.nodes(parsed).join(parser, "path"))
    edges = extract.edges(parsed).join(parser, "path").withColumn("edge_id", F.struct("path", "position"))
    bound = graph.saved(binding.bind(edges, nodes).drop("edge_id"))
    try:
        persisted = publish.persist(store, snapshot_id, nodes, bound, parsed)
        publish.publish(store, snapshot_id, expected_parent)
    except CodedError as e:
        return _reject(store, snapshot_id, e.code, active_snapshot=store.active())
    _tasks(store, snapshot_id, "completed")
    languages = {r.language: r.v for r in parsed.where(supported).groupBy("language").agg(F.max(F.concat_ws("-", "parser_id", "parser_version")).alias("v")).collect()}
    return {"ok": True, "status": "published", "snapshot_id": snapshot_id, "build_id": build_id, **persisted, "parser_versions": languages, "coverage": coverage, "diagnostics": diagnostics}


def sync(store: Store, operation_id: str, baseline_ref: int, source_root: str, target_source_revision: str, config_version: str, scope: list[str], changes=None) -> dict:
    """Rebuilds for a new revision and marks mappings that the change reaches stale; repeating an operation repeats its result.

    ``changes`` may be given as a DataFrame; else git names them.  Mappings go stale only when the build was published.
    """
    before = store.one("syncs", operation_id=operation_id)
    if before:
        return json.loads(before["result"])
    if store.active() is None or baseline_ref != store.active():
        raise CodedError("BASELINE_REF_NOT_FOUND")
    old = store.one("snapshots", snapshot_id=baseline_ref)["source_revision"]
    if changes is None:
        changes = feed.git_changes(store.spark, source_root, old, target_source_revision, scope)
    nodes = store.part("nodes", baseline_ref)
    touched = graph.saved(graph.affected_nodes(nodes, changes))
    keys = publish.node_key(nodes)
    near = graph.connected(store.part("components", baseline_ref), keys.join(touched, "node_id", "left_semi"))
    reached = graph.saved(graph.salted(keys, near, "node").select("node_id"))
    stale = graph.affected_mappings(store.rows("mappings").where(F.col("snapshot_id") == baseline_ref), reached)
    stale = graph.saved(stale.select("mapping_id"))
    result = build(store, source_root, target_source_revision, config_version, scope, expected_parent=baseline_ref)
    if result["ok"] and not stale.isEmpty():
        event = {"dependency_type": "dependency_closure", "old_revision": old, "new_revision": target_source_revision, "reason": "affected by incremental sync", "status": "stale"}

        def marked() -> dict:
            """The rows as they are now, of which another may have changed some since."""
            held = store.rows("mappings").join(stale, "mapping_id", "left_semi")
            return {"mappings": held.withColumn("status", F.lit("stale")), "stale_events": stale.select("mapping_id", *(F.lit(v).alias(k) for k, v in event.items()))}

        store.together(marked)
    # ids and changes are part of the result that a caller gets, as one value
    ids = lambda df, c="node_id": sorted(r[0] for r in df.select(c).toLocalIterator())
    result |= {"operation_id": operation_id, "changes": [r.asDict() for r in changes.toLocalIterator()], "affected_node_ids": ids(touched), "closure_node_ids": ids(reached), "stale_mapping_ids": ids(stale, "mapping_id")}
    store.add("syncs", {"operation_id": operation_id, "baseline_ref": baseline_ref, "target_source_revision": target_source_revision, "result": dumps(result)})
    return result



"""Business mappings: mining candidates, routing terms, confirming."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import CodedError
from ..operators import rows
from ..sources.store import REVISIONS, Store, dumps

# fixed values: the fields a candidate must have
REQUIRED = ("biz_id", "term", "context_id", "summary", "node_scope", "node_type", "canonical_key", "payload", "evidence_refs")

# fixed values: what a business node may be
STATUSES = ("candidate", "confirmed", "rejected", "stale")


def mine(store: Store, mode: str, snapshot_id: int, candidates: list[dict]) -> dict:
    """Stores candidates as nodes, mappings, evidence links and routes, all or none; a refused run is recorded as rejected."""
    if mode not in ("initial", "incremental"):
        raise CodedError("MINING_MODE_INVALID")
    snapshot = store.one("snapshots", snapshot_id=snapshot_id)
    if snapshot is None:
        raise CodedError("SNAPSHOT_NOT_FOUND")
    if not isinstance(candidates, list):
        raise CodedError("MINING_CANDIDATES_INVALID")
    run = {"run_id": uuid.uuid4().hex, "mode": mode, "snapshot_id": snapshot_id, "candidate_count": len(candidates), "status": "candidate"}
    code = None
    for c in candidates:
        if not isinstance(c, dict) or any(f not in c for f in REQUIRED):
            code = code or "MINING_CANDIDATE_INVALID"
        elif not c["evidence_refs"]:
            code = code or "EVIDENCE_REQUIRED"
    keys = [c["canonical_key"] for c in candidates] if not code else []

    def decide() -> dict:
        refusal = code
        if keys and (len(set(keys)) < len(keys) or known_keys(store, snapshot_id, keys)):
            refusal = "ARTIFACT_CONFLICT"
        if refusal:
            store.add("mining_runs", run | {"status": "rejected"})
            raise CodedError(refusal)
        return mined(store, snapshot, run, candidates)

    store.together(decide)
    return {"ok": True, **run}


def known_keys(store: Store, snapshot_id: int, keys: list[str]) -> bool:
    return not store.rows("business_nodes").where((F.col("snapshot_id") == snapshot_id) & F.col("canonical_key").isin(keys)).isEmpty()


def mined(store: Store, snapshot: dict, run: dict, candidates: list[dict]) -> dict[str, DataFrame]:
    """The rows that a run adds, by table."""
    at, n = snapshot["snapshot_id"], len(candidates)
    node_id, mapping_id = store.lease("business_nodes", n, "business_node_id") + 1, store.lease("mappings", n, "mapping_id") + 1
    given = ("requirement_id", "anchor_node_ids", "review_mode", "risk_level", "confidence", "review_batch_id", "updated_by")
    usual = {"review_mode": "manual_review_required", "updated_by": "mining", "anchor_node_ids": []}
    nodes, made, routes = [], [], {}
    for i, c in enumerate(candidates):
        nodes.append(node_row(snapshot, node_id + i, c["node_type"], c["canonical_key"], c["payload"], "candidate"))
        made.append({**usual, **{k: v for k, v in c.items() if k in given}, "mapping_id": mapping_id + i, "biz_id": c["biz_id"], "snapshot_id": at, "status": "candidate", "version": 1, "evidence_id": c["evidence_refs"][0], "evidence_refs": list(c["evidence_refs"]), "review_required": True})
        routes[c["term"], c["biz_id"], c["context_id"]] = {"term": c["term"], "biz_id": c["biz_id"], "context_id": c["context_id"], "summary": c["summary"], "node_scope": dumps(c["node_scope"]), "snapshot_id": at}
    frames = {"business_nodes": nodes, "mappings": made, "routes": list(routes.values()), "mining_runs": [run]}
    return {name: store.frame(name, own) for name, own in frames.items() if own} | linked(store, made, "mining")


def node_row(snapshot: dict, node_id: int, node_type: str, canonical_key: str, payload, status: str) -> dict:
    return {"business_node_id": node_id, "snapshot_id": snapshot["snapshot_id"], "node_type": node_type, "canonical_key": canonical_key, "payload": dumps(payload), "status": status, **{k: snapshot[k] for k in REVISIONS}}


def linked(store: Store, mappings: list[dict], by: str | None) -> dict[str, DataFrame]:
    """The evidence links of mappings."""
    if not mappings:
        return {}
    own = store.frame("mappings", mappings)
    by = F.coalesce("updated_by", F.lit(by).cast("string")).alias("created_by")
    return {"mapping_evidence": rows.evidence_links(own).join(own.select("mapping_id", by), "mapping_id")}


def add_business_node(store: Store, snapshot_id: int, node_type: str, canonical_key: str, payload, status: str) -> int:
    """Adds one node; a key that the snapshot has is ARTIFACT_CONFLICT."""
    snapshot = store.one("snapshots", snapshot_id=snapshot_id)
    if snapshot is None:
        raise CodedError("SNAPSHOT_NOT_FOUND")
    if status not in STATUSES:
        raise CodedError("BUSINESS_NODE_STATUS_INVALID")
    node_id = store.lease("business_nodes", 1, "business_node_id") + 1

    def decide() -> dict:
        if known_keys(store, snapshot_id, [canonical_key]):
            raise CodedError("ARTIFACT_CONFLICT", canonical_key=canonical_key)
        return {"business_nodes": store.frame("business_nodes", [node_row(snapshot, node_id, node_type, canonical_key, payload, status)])}

    store.together(decide)
    return node_id


def add_mapping(store: Store, biz_id: str, snapshot_id: int, status: str, evidence_id: int | None, *, anchor_node_ids: list[int] = (), evidence_refs: list[int] = (), **more) -> int:
    """Adds one mapping and its evidence links; without references its one evidence is linked.  ``more``: requirement_id,
    review_required, review_mode, risk_level, confidence, review_batch_id, updated_by."""
    mapping_id = store.lease("mappings", 1, "mapping_id") + 1
    refs = list(evidence_refs) or [x for x in [evidence_id] if x is not None]
    row = {"review_required": False, **more, "mapping_id": mapping_id, "biz_id": biz_id, "snapshot_id": snapshot_id, "status": status, "version": 1, "evidence_id": evidence_id, "anchor_node_ids": list(anchor_node_ids), "evidence_refs": refs}
    store.together(lambda: {"mappings": store.frame("mappings", [row])} | linked(store, [row], None))
    return mapping_id


def node_by_id(store: Store, business_node_id: int) -> dict | None:
    row = store.one("business_nodes", business_node_id=business_node_id)
    return row and row | {"payload": json.loads(row["payload"])}


def add_route(store: Store, term: str, biz_id: str, context_id: str, summary: str, node_scope, snapshot_id: int) -> None:
    store.upsert("routes", {"term": term, "biz_id": biz_id, "context_id": context_id, "summary": summary, "node_scope": dumps(node_scope), "snapshot_id": snapshot_id})


def _active(store: Store) -> int:
    at = store.active()
    if at is None:
        raise CodedError("SNAPSHOT_NOT_PUBLISHED")
    return at


def resolve(store: Store, term: str, ttl_seconds: int = 300) -> dict:
    """Contexts of exactly this term in the active snapshot, and a token to select one with."""
    at = _active(store)
    found = store.rows("routes").where((F.col("term") == term) & (F.col("snapshot_id") == at)).orderBy("biz_id", "context_id").collect()
    candidates = [{"biz_id": r.biz_id, "context_id": r.context_id, "summary": r.summary, "node_scope": json.loads(r.node_scope)} for r in found]
    asked = store.spark.createDataFrame([(term,)], "query string")
    routes = store.rows("routes").where(F.col("snapshot_id") == at)
    status = rows.resolved(routes, asked).first().status
    if status == "not_found":
        return {"ok": True, "status": status, "candidates": []}
    token = uuid.uuid4().hex
    store.add("route_tokens", {"token": token, "snapshot_id": at, "candidates": dumps(candidates), "expires_at": int(time.time()) + ttl_seconds})
    return {"ok": True, "status": status, "candidates": candidates, "route_token": token}


def select(store: Store, token: str, context_id: str) -> dict:
    own = store.rows("route_tokens").where(F.col("token") == token)
    found = own.join(rows.expired(own, int(time.time())), "token", "left_anti").collect()  # one token
    if not found:
        raise CodedError("ROUTE_TOKEN_EXPIRED")
    row = found[0].asDict()
    if row["snapshot_id"] != _active(store):
        raise CodedError("SCOPE_MISMATCH")
    chosen = next((c for c in json.loads(row["candidates"]) if c["context_id"] == context_id), None)
    if chosen is None:
        raise CodedError("CONTEXT_SELECTION_REQUIRED")
    return {"ok": True, "status": "selected", **chosen, "route_token": token}


def confirm(store: Store, mapping_id: int, expected_version: int, decision: str, evidence_refs: list[int], reason: str, review_mode: str | None = None, updated_by: str | None = None) -> dict:
    """Confirms or rejects a mapping of the expected version, with evidence and an audit row; a stale one can't be confirmed."""
    if decision not in ("confirmed", "rejected") or not evidence_refs:
        raise CodedError("EVIDENCE_REQUIRED")
    asked = store.spark.createDataFrame([(mapping_id, expected_version, decision)], "mapping_id long, expected_version long, decision string")

    def decide() -> dict:
        outcome = rows.confirmed(store.rows("mappings"), asked).first()
        if not outcome.accepted:
            raise CodedError("CAS_VERSION_MISMATCH")
        row = store.one("mappings", mapping_id=mapping_id)
        change = {"status": outcome.status, "version": outcome.version, "evidence_id": evidence_refs[0], "evidence_refs": list(evidence_refs), "review_mode": review_mode or row["review_mode"], "updated_by": updated_by}
        audit = {"mapping_id": mapping_id, "decision": decision, "evidence_id": evidence_refs[0], "reason": reason, "evidence_refs": list(evidence_refs), "review_mode": review_mode, "updated_by": updated_by}
        return {"mappings": store.frame("mappings", [row | change]), "confirmations": store.frame("confirmations", [audit])}

    store.together(decide)
    return {"ok": True, "status": decision}


def evidence_of(store: Store, mapping_id: int) -> list[dict]:
    """A mapping's evidence links, by evidence id."""
    return [r.asDict() for r in store.rows("mapping_evidence").where(F.col("mapping_id") == mapping_id).orderBy("evidence_id").collect()]


def replace_evidence(store: Store, mapping_id: int, replacement_id: int) -> None:
    """Names other evidence for a mapping, which is a candidate again."""

    def decide() -> dict:
        row = store.one("mappings", mapping_id=mapping_id)
        return {"mappings": store.frame("mappings", [row | {"replacement_id": replacement_id, "status": "candidate"}])} if row else {}

    store.together(decide)

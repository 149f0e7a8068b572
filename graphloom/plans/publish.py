"""Persisting an extracted graph as a snapshot, and publishing it."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CodedError
from ..functions import text
from ..operators import graph, lookups, postings, rows, search
from ..sources.store import ANY, Store, dumps

TRIPLE = ("source_revision", "index_revision", "config_version")


def numbered(df: DataFrame, order: list[str], column: str) -> tuple[DataFrame, int]:
    """(numbers from 1 in the order of ``order``, without a single-task sort; how many rows there are)."""
    spread = graph.saved(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes, before = {}, 0
    for r in spread.groupBy("__part").count().orderBy("__part").collect():  # one row a partition
        sizes[r["__part"]], before = before, before + r["count"]
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col("__part")) if sizes else F.lit(0)
    return spread.withColumn(column, offset.cast("long") + F.col("__at") + 1).drop("__part", "__at"), before


@F.pandas_udf(T.StringType())
def enveloped(payloads: pd.Series, envelopes: pd.Series) -> pd.Series:
    """Canonical JSON of the payload with the envelope's fields over it."""
    return pd.Series([text.canonical_json({**json.loads(p), **json.loads(e)}) for p, e in zip(payloads, envelopes, strict=True)])


def envelope(key: str, name: str, *more: str):
    fields = [F.col(key).alias("canonical_key"), F.col(name).alias("name"), F.col("path").alias("file_path"), "start_line", "end_line", "evidence_id", *TRIPLE, *more]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def persist(store: Store, snapshot_id: int, nodes: DataFrame, edges: DataFrame, parsed: DataFrame | None = None) -> dict[str, int]:
    """Writes nodes (extract.nodes) and edges (extract.edges, bound) with ids, evidence, manifests and the token index.

    Ids follow (path, position); nodes made for ends that no node has come after the others in the order of the
    edges that ask for them.  ``parsed``: what the files gave, kept for the next build.  Nothing is in place unless everything is.
    """
    snapshot = store.one("snapshots", snapshot_id=snapshot_id)
    if snapshot is None:
        raise CodedError("SNAPSHOT_NOT_FOUND")
    if snapshot["status"] != "staging":
        raise CodedError("SNAPSHOT_NOT_STAGING")
    if not rows.duplicate_keys(nodes, "canonical_key").isEmpty() or not nodes.where("canonical_key is null or canonical_key = ''").isEmpty() or not store.part("nodes", snapshot_id).isEmpty():
        raise CodedError("ARTIFACT_CONFLICT")
    stamp = {c: F.lit(snapshot[c]) for c in TRIPLE}
    # numbers from 1 become ids when it is known how many are to be leased
    own, n = numbered(nodes, ["path", "position"], "at")
    first_node = store.lease("nodes", n, "node_id")
    own = own.withColumn("node_id", F.col("at") + first_node).withColumns(stamp)
    made, e = numbered(edges.withColumn("file_path", F.col("path")).withColumn("edge_id", F.struct("path", "position")).transform(graph.first_edges), ["path", "position"], "at")
    first_edge = store.lease("edges", e, "edge_id")
    made = made.withColumn("edge_id", F.col("at") + first_edge).drop("at").withColumns(stamp)
    outside = graph.external_nodes(made, own).join(made.select("edge_id", "path", "start_line", F.col("payload").alias("edge_payload"), "parser", "language"), "edge_id")
    outside, m = numbered(outside, ["edge_id", "side"], "at")
    first_outside = store.lease("nodes", m, "node_id")
    outside = outside.withColumn("node_id", F.col("at") + first_outside).withColumns(stamp).withColumns({"kind": F.lit("external"), "end_line": F.col("start_line"), "payload": F.lit('{"external": true}')})
    first_evidence = store.lease("evidence", n + m + e, "evidence_id")
    shared = ["node_id", "canonical_key", "kind", "name", "path", "start_line", "end_line", "payload", "parser", "language", *TRIPLE]
    every = own.select(*shared, F.col("payload").alias("cited"), F.col("at").alias("evidence_id")).unionByName(outside.select(*shared, F.col("edge_payload").alias("cited"), (F.col("at") + n).alias("evidence_id"))).withColumn("evidence_id", F.col("evidence_id") + first_evidence)
    every = every.withColumn("parsed", F.col("payload")).withColumn("payload", enveloped("payload", envelope("canonical_key", "name")))
    every = graph.saved(every.withColumn("qualified_name", F.coalesce(F.get_json_object("payload", "$.qualified_name"), F.lit(""))))
    ids = every.select("node_id", F.coalesce(F.when(F.col("kind") == "external", F.expr("substring(canonical_key, 10)")), F.col("canonical_key")).alias("key"))
    made = made.join(ids.select(F.col("key").alias("source_key"), F.col("node_id").alias("from_node_id")), "source_key").join(ids.select(F.col("key").alias("target_key"), F.col("node_id").alias("to_node_id")), "target_key")
    made = made.withColumn("evidence_id", F.col("edge_id") - first_edge + first_evidence + n + m).withColumn("end_line", F.col("start_line")).withColumn("cited", F.col("payload"))
    made = graph.saved(made.withColumn("payload", enveloped("payload", envelope("edge_type", "edge_type", "source_key", "target_key", "resolution"))))
    evidence = None
    for part in (every, made):
        part = part.select("evidence_id", *TRIPLE, F.col("path").alias("file_path"), "start_line", F.coalesce("end_line", "start_line").alias("end_line"), F.sha2("cited", 256).alias("snippet_hash"), "parser", F.when(F.col("parser") == "python-ast", "high").otherwise("medium").alias("confidence"), F.to_json(F.struct("language", F.col("parser").alias("parser_id"))).alias("metadata"))
        evidence = part if evidence is None else evidence.unionByName(part)
    at = uuid.uuid4().hex
    stored = every.select("*", F.col("path").alias("file_path"), F.col("kind").alias("sub_kind")).withColumn("kind", F.lit("Graph"))
    parts = max(1, -(-(n + m) // lookups.ROWS))
    store.cluster(at, "nodes", stored, "canonical_key", "node_ranges", parts)
    store.cluster(at, "node_ids", every, "node_id", "id_ranges", parts)
    store.stage(at, "edges", made)
    store.stage(at, "evidence", evidence)
    store.stage(at, "manifests", every.withColumn("content_hash", F.sha2("payload", 256)))
    store.stage(at, "components", components(store, made.select(F.col("source_key").alias("a"), F.col("target_key").alias("b")).distinct()))
    # the index reads a content hash from payloads, which have none
    postings.write(search.words(stored.withColumn("content_hash", F.lit(""))), f"{store.root}/_staged/{at}")
    if parsed is not None:
        store.stage(at, "parsed", parsed)
    store.settle(at, snapshot_id)
    return {"node_count": n + m, "edge_count": e}


def links(edges: DataFrame) -> DataFrame:
    """(a, b): the keys that a snapshot's edges connect."""
    return edges.select(F.get_json_object("payload", "$.source_key").alias("a"), F.get_json_object("payload", "$.target_key").alias("b")).distinct()


def node_key(nodes: DataFrame) -> DataFrame:
    """(node_id, node): a snapshot's nodes by the keys that ``links`` has, which are the same in all snapshots."""
    return nodes.select("node_id", F.when(F.col("sub_kind") == "external", F.expr("substring(canonical_key, 10)")).otherwise(F.col("canonical_key")).alias("node"))


def components(store: Store, ends: DataFrame) -> DataFrame:
    """The connected components of a snapshot to be, from those of the active one where there are any."""
    at = store.active()
    if at is None or store.part("components", at).isEmpty():
        return graph.components(ends)
    ends, before = graph.saved(ends), links(store.part("edges", at))
    return graph.relabelled(store.part("components", at), ends, ends.subtract(before), before.subtract(ends))


def rebuild_index(store: Store, snapshot_id: int) -> None:
    """Indexes a snapshot's nodes anew, those that were added one by one too; until the new one is in place, searches find none."""
    _staging(store, snapshot_id)
    nodes = store.part("nodes", snapshot_id).withColumn("content_hash", F.lit(""))
    names = {c: F.coalesce(F.col(c), F.lit("")) for c in search.FIELDS}
    store.replace_index(snapshot_id, lambda path: postings.write(search.words(nodes.withColumns(names)), path))


def publish(store: Store, snapshot_id: int, expected_parent=ANY) -> None:
    """Checks a staged snapshot's revisions and keys, and makes it the active one."""
    snapshot = store.one("snapshots", snapshot_id=snapshot_id)
    if snapshot is None:
        raise CodedError("SNAPSHOT_NOT_FOUND")
    if snapshot["status"] != "staging":
        raise CodedError("SNAPSHOT_NOT_STAGING")
    own = store.rows("snapshots").where(F.col("snapshot_id") == snapshot_id)
    nodes = store.part("nodes", snapshot_id)
    for part in (nodes, store.part("edges", snapshot_id)):
        if not rows.revision_mismatches(part.withColumn("snapshot_id", F.lit(snapshot_id)), own).isEmpty():
            raise CodedError("REVISION_MISMATCH")
    if rows.keyless(nodes, "canonical_key", F.col("kind") == "Graph").first().missing:
        raise CodedError("CANONICAL_KEY_REQUIRED")
    if store.active() != snapshot_id:  # else a writer was lost between the swap and the status
        store.swap(snapshot_id, expected_parent)
    store.upsert("snapshots", snapshot | {"status": "published"})  # the only change there is to a staged snapshot's row


def _staging(store: Store, snapshot_id: int) -> dict:
    snapshot = store.one("snapshots", snapshot_id=snapshot_id)
    if snapshot is None:
        raise CodedError("SNAPSHOT_NOT_FOUND")
    return snapshot


def add_node(store: Store, snapshot_id: int, kind: str, sub_kind: str, revisions: dict, payload: dict) -> int:
    """Adds one node; what its payload says of key, name and file is read from there."""
    _staging(store, snapshot_id)
    node_id = store.lease("nodes", 1, "node_id") + 1
    store.insert(snapshot_id, "nodes", {"node_id": node_id, "kind": kind, "sub_kind": sub_kind, **{c: payload.get(c) for c in ("canonical_key", "name", "qualified_name", "file_path", "evidence_id")}, **{c: revisions[c] for c in TRIPLE}, "payload": dumps(payload)})
    return node_id


def add_edge(store: Store, snapshot_id: int, from_node_id: int, to_node_id: int, edge_type: str, revisions: dict, payload: dict) -> int:
    _staging(store, snapshot_id)
    edge_id = store.lease("edges", 1, "edge_id") + 1
    store.insert(snapshot_id, "edges", {"edge_id": edge_id, "from_node_id": from_node_id, "to_node_id": to_node_id, "edge_type": edge_type, "evidence_id": payload.get("evidence_id"), **{c: revisions[c] for c in TRIPLE}, "payload": dumps(payload)})
    return edge_id


def add_evidence(store: Store, snapshot_id: int, revisions: dict, file_path: str, start_line: int, end_line: int, snippet_hash: str) -> int:
    _staging(store, snapshot_id)
    evidence_id = store.lease("evidence", 1, "evidence_id") + 1
    store.insert(snapshot_id, "evidence", {"evidence_id": evidence_id, **{c: revisions[c] for c in TRIPLE}, "file_path": file_path, "start_line": start_line, "end_line": end_line, "snippet_hash": snippet_hash})
    return evidence_id


def update_evidence(store: Store, evidence_id: int, snippet_hash: str) -> None:
    """Evidence is never changed; other evidence can take its place (``business.replace_evidence``)."""
    raise CodedError("EVIDENCE_IMMUTABLE", evidence_id=evidence_id)


def add_artifact(store: Store, snapshot_id: int, canonical_key: str, kind: str, content_hash: str, evidence_id: int | None, payload: dict) -> None:
    """Adds one manifest; ARTIFACT_CONFLICT if the snapshot has one of that key."""
    _staging(store, snapshot_id)
    if not store.part("manifests", snapshot_id).where(F.col("canonical_key") == canonical_key).isEmpty():
        raise CodedError("ARTIFACT_CONFLICT", canonical_key=canonical_key)
    store.insert(snapshot_id, "manifests", {"canonical_key": canonical_key, "kind": kind, "content_hash": content_hash, "evidence_id": evidence_id, "payload": dumps(payload)})


def _first(df: DataFrame) -> dict | None:
    found = [r.asDict(recursive=True) for r in df.limit(1).collect()]
    return found[0] | {"payload": json.loads(found[0]["payload"])} if found else None


def by_key(store: Store, snapshot_id: int) -> lookups.Clustered:
    """A snapshot's nodes, to be looked up by canonical key."""
    return store.clustered("nodes", snapshot_id, "canonical_key", "node_ranges")


def by_id(store: Store, snapshot_id: int) -> lookups.Clustered:
    """The keys of a snapshot's nodes, to be looked up by id."""
    return store.clustered("node_ids", snapshot_id, "node_id", "id_ranges")


def nodes_of(store: Store, snapshot_id: int, canonical_keys: list[str]) -> DataFrame:
    """The nodes of some canonical keys in a snapshot, from the files that can hold them."""
    return by_key(store, snapshot_id).rows(canonical_keys).withColumn("snapshot_id", F.lit(snapshot_id).cast("long"))


def known_keys(store: Store, snapshot_id: int, canonical_keys: list[str]) -> list[str]:
    """Which of some canonical keys a snapshot has nodes of, in order."""
    return [r[0] for r in nodes_of(store, snapshot_id, canonical_keys).select("canonical_key").distinct().orderBy("canonical_key").collect()]


def node(store: Store, node_id: int) -> dict | None:
    """The node of an id, of whatever snapshot, with its payload as a dict.

    The ranges of ids tell the snapshots and the file that has its key, and the key the file that has it; if none does, it may
    be among the nodes that were added one by one.
    """
    within = (F.col("first") <= node_id) & (F.col("last") >= node_id)
    held = [r[0] for r in store.every("id_ranges").where(within).select("snapshot_id").distinct().orderBy("snapshot_id").collect()]
    for at in held:
        keys = [r[0] for r in by_id(store, at).rows([node_id]).select("canonical_key").collect()]
        found = _first(nodes_of(store, at, keys).where(F.col("node_id") == node_id)) if keys else None
        if found:
            return found
    for at in store.snapshots():
        nodes = by_key(store, at)
        found = _first(nodes.read(nodes.loose()).where(F.col("node_id") == node_id).withColumn("snapshot_id", F.lit(at).cast("long")))
        if found:
            return found
    return None


def node_of(store: Store, snapshot_id: int, canonical_key: str) -> dict | None:
    """The node of a canonical key in a snapshot."""
    return _first(nodes_of(store, snapshot_id, [canonical_key]))

"""Graph traversal: levels, budgeted expansion with paths, undirected closure, impact of changes.

Edges are (edge_id, from_node_id, to_node_id, edge_type, ...), nodes (node_id, canonical_key, file_path, ...), both
already of one snapshot.  ``levels`` and ``closure`` are distributed throughout and have no bound on what they
reach; ``expand`` obeys budgets edge by edge and gives its result as one value, so it takes at most ``edge_budget`` rows to
the driver; ``expand_frames`` obeys the same budgets with the executors.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import CodedError
from ..functions import text

DIRECTIONS = ("out", "in", "both")
SALTS = 16


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names.  One of its own has only a session of a single machine; a cluster that names none
    is CHECKPOINT_DIR_REQUIRED, as its executors share no folder of the driver."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.split("[")[0] == "local":
            raise CodedError("CHECKPOINT_DIR_REQUIRED", master=context.master)
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="graphloom-"))
    return context.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """``df`` in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def steps(edges: DataFrame, frontier: DataFrame, direction: str = "out", edge_types: tuple[str, ...] = ()) -> DataFrame:
    """Edges that touch the frontier (node_id), with ``current`` (the end in the frontier; the source if both are) and ``other``."""
    if direction not in DIRECTIONS:
        raise CodedError("INVALID_DIRECTION")
    if edge_types:
        edges = edges.where(F.col("edge_type").isin(*edge_types))
    out = edges.join(frontier.select(F.col("node_id").alias("from_node_id")), "from_node_id", "left_semi").select("*", F.col("from_node_id").alias("current"), F.col("to_node_id").alias("other"))
    into = edges.join(frontier.select(F.col("node_id").alias("to_node_id")), "to_node_id", "left_semi").select("*", F.col("to_node_id").alias("current"), F.col("from_node_id").alias("other"))
    if direction == "out":
        return out
    if direction == "in":
        return into
    # an edge with both ends in the frontier is met once, from its source
    return out.unionByName(into.join(frontier.select(F.col("node_id").alias("from_node_id")), "from_node_id", "left_anti").select(*out.columns))


def in_scope(nodes: DataFrame, canonical_keys: list[str] = (), file_paths: list[str] = ()) -> DataFrame:
    """node_id of nodes that a scope lets in; an empty part of it lets all in."""
    keep = F.lit(True)
    if canonical_keys:
        keep = keep & F.col("canonical_key").isin(*canonical_keys)
    if file_paths:
        keep = keep & F.col("file_path").isin(*file_paths)
    return nodes.where(keep).select("node_id")


def levels(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "out", edge_types: tuple[str, ...] = (), scope: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges met, with their level; nodes discovered, with level and path from a seed), without budgets.

    A new node outside ``scope`` (node_id) drops its edge; an edge to a node seen before is met whatever its scope.
    Of the edges that discover a node in a level, the one of least edge_id gives its path.
    """
    seen = seeds.select("node_id").distinct().select("node_id", F.lit(0).alias("level"), F.array("node_id").alias("path"))
    frontier, met = seen, None
    for level in range(1, depth + 1):
        own = steps(edges, frontier, direction, edge_types)
        if scope is not None:
            own = own.join(scope.unionByName(seen.select("node_id")).distinct().withColumnRenamed("node_id", "other"), "other", "left_semi")
        own = saved(own.withColumn("level", F.lit(level)))  # each level is looked for once
        met = own if met is None else met.unionByName(own)
        first = own.groupBy(F.col("other").alias("node_id")).agg(F.min_by("current", "edge_id").alias("current")).join(seen.select("node_id"), "node_id", "left_anti")
        frontier = saved(first.join(frontier.select(F.col("node_id").alias("current"), F.col("path").alias("before")), "current").select("node_id", F.lit(level).alias("level"), F.concat("before", F.array("node_id")).alias("path")))
        seen = seen.unionByName(frontier)
        if frontier.isEmpty():
            break
    return met, seen.where("level > 0")


@dataclass
class Expansion:
    """Edges in the order met, the path to each node discovered, what was covered, whether a budget ended it."""

    edges: list[dict] = field(default_factory=list)
    paths: list[list[int]] = field(default_factory=list)
    nodes: int = 0
    truncated: bool = False

    @property
    def coverage(self) -> dict[str, int]:
        return {"nodes": self.nodes, "edges": len(self.edges)}


def expand(nodes: DataFrame, edges: DataFrame, node_ids: list[int], depth: int = 1, node_budget: int = 100, edge_budget: int = 100, direction: str = "out", edge_types: tuple[str, ...] = (), scope: dict | None = None) -> Expansion:
    """Breadth-first expansion in edge_id order under budgets.

    An edge met when the edge budget is used up, or that would bring in a node beyond the node budget, ends the
    traversal and is not given.  A level needs only its first ``edge_budget`` edges that are kept, which one
    distributed top-k gives, and whether any edge at all comes after them.
    """
    if direction not in DIRECTIONS:
        raise CodedError("INVALID_DIRECTION")
    spark = edges.sparkSession
    out = Expansion()
    paths: dict[int, list[int]] = {n: [n] for n in dict.fromkeys(node_ids)}
    seeds, frontier = set(paths), list(paths)
    allowed = in_scope(nodes, scope.get("canonical_keys") or (), scope.get("file_paths") or ()) if scope else None
    as_frame = lambda ids: spark.createDataFrame([(i,) for i in ids], "node_id long")
    for _ in range(depth):
        if not frontier or out.truncated:
            break
        own = steps(edges, F.broadcast(as_frame(frontier)), direction, edge_types)  # node_budget ids at most
        kept = own
        if allowed is not None:
            kept = own.join(F.broadcast(as_frame(list(paths))).withColumnRenamed("node_id", "other"), "other", "left_semi").unionByName(
                own.join(F.broadcast(as_frame(list(paths))).withColumnRenamed("node_id", "other"), "other", "left_anti").join(allowed.withColumnRenamed("node_id", "other"), "other", "left_semi")
            )
        left = edge_budget - len(out.edges)
        rows = kept.orderBy("edge_id").limit(left).collect() if left > 0 else []  # edge_budget rows at most
        frontier = []
        for row in rows:
            new = row.other not in paths
            if new and len(paths) >= node_budget:
                out.truncated = True
                break
            out.edges.append({k: v for k, v in row.asDict(recursive=True).items() if k not in ("current", "other")})
            if new:
                paths[row.other] = [*paths[row.current], row.other]
                frontier.append(row.other)
        if not out.truncated and len(rows) >= left:
            after = own.where(F.col("edge_id") > rows[-1].edge_id) if rows else own
            out.truncated = not after.isEmpty()
    out.paths = [p for n, p in paths.items() if n not in seeds]
    out.nodes = len(paths)
    return out


@dataclass
class Frames:
    """An expansion that stays with the executors: ``edges`` with position (from 1) and level, ``nodes`` discovered with position, level
    and path, how many nodes are covered (seeds among them) and edges met, whether a budget ended it."""

    edges: DataFrame
    nodes: DataFrame
    covered: int
    met: int
    truncated: bool


def counted_before(df: DataFrame, order: str, flags: tuple[str, ...]) -> DataFrame:
    """``df`` with, for each flag, ``<flag>_before``: how many rows that come before by ``order`` have it.

    Two passes over ranges of ``order``: what each range holds (a row a range goes to the driver), then running counts inside
    each range from what the ranges before it hold.
    """
    dealt = saved(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__part", F.spark_partition_id()))
    held = dealt.groupBy("__part").agg(*(F.count_if(f).alias(f) for f in flags)).orderBy("__part").collect()
    inside = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out, sums = dealt, dict.fromkeys(flags, 0)
    offsets = {f: [] for f in flags}
    for r in held:
        for f in flags:
            offsets[f] += [F.lit(r["__part"]), F.lit(sums[f])]
            sums[f] += r[f]
    for f in flags:
        start = F.create_map(*offsets[f])[F.col("__part")] if held else F.lit(0)
        out = out.withColumn(f"{f}_before", (start + F.coalesce(F.count_if(f).over(inside), F.lit(0))).cast("long"))
    return out.drop("__part")


def expand_frames(edges: DataFrame, seeds: DataFrame, depth: int = 1, node_budget: int = 100, edge_budget: int = 100, direction: str = "out", edge_types: tuple[str, ...] = (), scope: DataFrame | None = None) -> Frames:
    """``expand`` for budgets of any size: nothing but counts comes to the driver.  ``scope``: node_id of the nodes that are let in.

    In a level, rows are in the order of edge_id.  An edge is kept if its other end was seen before or is in scope, and
    discovers that end if it is the first kept edge there.  The level ends before the first row that finds the edge budget used
    up by the kept rows before it, or that discovers a node when the node budget is used up by those before it.
    """
    if direction not in DIRECTIONS:
        raise CodedError("INVALID_DIRECTION")
    start = saved(seeds.select("node_id").distinct().select("node_id", F.lit(0).cast("long").alias("position"), F.lit(0).alias("level"), F.array("node_id").alias("path")))
    covered, met, truncated = start.count(), 0, False
    seen = frontier = start
    found = steps(edges, start.where("false"), direction).drop("current", "other").select(F.lit(0).cast("long").alias("position"), F.lit(0).alias("level"), "*")
    for level in range(1, depth + 1):
        own = saved(steps(edges, frontier, direction, edge_types))
        ends = own.groupBy("other").agg(F.min("edge_id").alias("__first"))  # ends are looked up once each, however many edges meet there
        ends = ends.join(seen.select(F.col("node_id").alias("other"), F.lit(True).alias("__seen")), "other", "left")
        allowed = F.lit(True)
        if scope is not None:
            ends, allowed = ends.join(scope.select(F.col("node_id").alias("other"), F.lit(True).alias("__let")).distinct(), "other", "left"), F.coalesce("__let", F.lit(False))
        ends = ends.select("other", "__first", F.coalesce("__seen", F.lit(False)).alias("__seen"), allowed.alias("__let"))
        rows = salted(own, ends, "other").withColumn("kept", F.col("__seen") | F.col("__let")).withColumn("new", ~F.col("__seen") & F.col("__let") & (F.col("edge_id") == F.col("__first")))
        rows = counted_before(rows.drop("__first", "__seen", "__let"), "edge_id", ("kept", "new"))
        full = (F.col("kept_before") + met >= edge_budget) | (F.col("new") & (F.col("new_before") + covered >= node_budget))
        end = rows.agg(F.min(F.when(full, F.col("edge_id")))).first()[0]
        rows = rows.where("kept")
        rows = rows if end is None else rows.where(F.col("edge_id") < end)
        own = rows.select((F.col("kept_before") + met + 1).alias("position"), F.lit(level).alias("level"), *edges.columns)
        new = rows.where("new").select(F.col("other").alias("node_id"), "current", (F.col("new_before") + 1).alias("position"))
        before = frontier.select(F.col("node_id").alias("current"), F.col("path").alias("__path"))
        new = saved(salted(new, before, "current").select("node_id", (F.col("position") + covered).alias("position"), F.lit(level).alias("level"), F.concat("__path", F.array("node_id")).alias("path")))
        found, seen, frontier = found.unionByName(own), seen.unionByName(new), new
        n, more = rows.count(), new.count()
        met, covered, truncated = met + n, covered + more, end is not None
        if truncated or not more:
            break
    return Frames(found, seen.where("level > 0"), covered, met, truncated)


def dealt(side: DataFrame) -> DataFrame:
    """``side`` of a join, dealt by key and never broadcast: Spark goes by bytes as they were shuffled, and salted or sorted keys, packed
    to under 10 MB, come to over 100 MB each on the driver."""
    return side.hint("merge")


def salted(big: DataFrame, small: DataFrame, key: str, salts: int = SALTS) -> DataFrame:
    """An inner join on ``key``, of which ``small`` holds each value once; a value's rows of ``big`` go to ``salts`` tasks."""
    small = dealt(small.withColumn("__salt", F.explode(F.array(*map(F.lit, range(salts))))))
    return big.withColumn("__salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int")).join(small, [key, "__salt"]).drop("__salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's connected component, for the nodes of ``edges`` (a, b).

    Each round every node takes the least label around it, then its label's label, so that rounds grow with the
    logarithm of a component's width; labels are checkpointed.
    """
    both = saved(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")))
    while True:
        around = salted(both, labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("least"))
        near = labels.join(dealt(around), "node").select("node", F.least("root", "least").alias("root"), F.col("root").alias("old"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = saved(salted(near, jump, "root").select("node", F.least("root", "next").alias("root"), "old"))
        labels = new.select("node", "root")
        if new.where("root <> old").isEmpty():
            return labels


def relabelled(labels: DataFrame, edges: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """``components`` of ``edges`` (a, b), from the labels (node, root) of what they were before edges were added and removed.

    Only the components that lost an edge are computed anew; edges added join labels, as a graph of roots that has an edge
    for each of them at most.  The rest of the labels is read once and stays.
    """
    ends = lambda e: e.where("a <> b").select(F.col("a").alias("node")).union(e.where("a <> b").select(F.col("b").alias("node"))).distinct()
    torn = saved(labels.join(ends(removed), "node", "left_semi").select("root").distinct())
    apart = saved(salted(labels, torn, "root").select("node"))
    inner = edges.join(apart.select(F.col("node").alias("a")), "a", "left_semi").join(apart.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b")
    labels = saved(labels.join(torn, "root", "left_anti").select("node", "root").unionByName(components(inner)))
    known = ends(added).join(labels, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.col("root").isNull().alias("fresh"))
    known = saved(known)
    at = lambda c: known.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    bridges = added.where("a <> b").join(at("a"), "a").join(at("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct()
    joined = components(bridges.where("a <> b")).select(F.col("node").alias("root"), F.col("root").alias("to")).where("root <> to")
    labels = labels.unionByName(known.where("fresh").select("node", "root"))
    return labels.join(joined, "root", "left_anti").select("node", "root").unionByName(salted(labels, joined, "root").select("node", F.col("to").alias("root")))


def connected(labels: DataFrame, seeds: DataFrame) -> DataFrame:
    """node of all that labels (node, root) connect to the seeds (node), themselves included."""
    roots = labels.join(seeds.select("node"), "node", "left_semi").select("root").distinct()
    return salted(labels, roots, "root").select("node").union(seeds.select("node")).distinct()


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node_id of all that is connected to the seeds (themselves included), direction ignored."""
    labels = components(edges.select(F.col("from_node_id").alias("a"), F.col("to_node_id").alias("b")))
    return connected(labels, seeds.select(F.col("node_id").alias("node"))).select(F.col("node").alias("node_id"))


def affected_nodes(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """node_id of nodes whose file a change names, as it is now or as it was; backslashes count as slashes."""
    paths = changes.select(F.explode(F.array("path", "old_path")).alias("p")).where("p is not null").select(text.slashes(F.col("p")).alias("p")).distinct()
    return nodes.withColumn("p", text.slashes(F.col("file_path"))).join(paths, "p", "left_semi").select("node_id")


def affected_mappings(mappings: DataFrame, reached: DataFrame) -> DataFrame:
    """Rows of mappings that aren't stale and have an anchor among the nodes reached."""
    anchors = mappings.where("status <> 'stale'").select("mapping_id", F.explode("anchor_node_ids").alias("node_id"))
    hit = anchors.join(reached.select("node_id"), "node_id", "left_semi").select("mapping_id").distinct()
    return mappings.join(hit, "mapping_id", "left_semi")


def external_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes to make for edge ends (source_key, target_key by edge_id) that no node has: one each, as the first edge asks."""
    ends = edges.select("edge_id", F.posexplode(F.array("source_key", "target_key")).alias("side", "key"))
    missing = ends.join(nodes.select(F.col("canonical_key").alias("key")), "key", "left_anti")
    return missing.groupBy("key").agg(F.min(F.struct("edge_id", "side")).alias("first")).select(F.concat(F.lit("external:"), "key").alias("canonical_key"), F.col("key").alias("name"), F.col("first.edge_id").alias("edge_id"), F.col("first.side").alias("side"))


def first_edges(edges: DataFrame, keys: Column | None = None) -> DataFrame:
    """One edge for each (edge_type, source_key, target_key, file_path, start_line): that of least edge_id."""
    own = ["edge_type", "source_key", "target_key", "file_path", "start_line"]
    rest = [c for c in edges.columns if c not in own]
    best = edges.groupBy(*own).agg(F.min_by(F.struct(*rest), "edge_id").alias("first"))
    return best.select(*own, *(F.col(f"first.{c}").alias(c) for c in rest)).select(*edges.columns)

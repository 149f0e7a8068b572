"""Budgets kept by the executors, and components kept up to date, against the rules on random graphs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph

EDGE = "edge_id long, from_node_id long, to_node_id long, edge_type string"


def test_frames_are_what_expand_gives(spark):
    rng = random.Random(4)
    for _ in range(7):
        rows = [(i, rng.randint(1, 8), rng.randint(1, 8), rng.choice("tu")) for i in range(1, 15)]
        edges = spark.createDataFrame(rows, EDGE).repartition(3)
        nodes = spark.createDataFrame([(i, f"k{i}", f"f{i}") for i in range(1, 9)], "node_id long, canonical_key string, file_path string")
        inside = rng.choice([None, [1, 2, 3, 4, 5]])
        options = {"depth": rng.randint(1, 3), "node_budget": rng.randint(1, 9), "edge_budget": rng.randint(0, 12), "direction": rng.choice(graph.DIRECTIONS), "edge_types": rng.choice([(), ("t",)])}
        one = graph.expand(nodes, edges, [1, 2], scope={"canonical_keys": [f"k{i}" for i in inside]} if inside else None, **options)
        scope = spark.createDataFrame([(i,) for i in inside], "node_id long") if inside else None
        two = graph.expand_frames(edges, spark.createDataFrame([(1,), (2,), (2,)], "node_id long"), scope=scope, **options)
        assert [r.edge_id for r in two.edges.orderBy("position").collect()] == [e["edge_id"] for e in one.edges]
        assert [r.position for r in two.edges.orderBy("position").collect()] == list(range(1, two.met + 1))
        assert [r.path for r in two.nodes.orderBy("position").collect()] == one.paths
        assert (two.covered, two.met, two.truncated) == (one.nodes, len(one.edges), one.truncated)


def test_every_budget_of_one_graph(spark):
    rng = random.Random(9)
    edges = spark.createDataFrame([(i, rng.randint(1, 5), rng.randint(1, 5), "t") for i in range(1, 9)], EDGE)
    nodes = spark.createDataFrame([(i, f"k{i}", "") for i in range(1, 6)], "node_id long, canonical_key string, file_path string")
    for node_budget, edge_budget in itertools.product((1, 3, 5), (0, 2, 7)):
        one = graph.expand(nodes, edges, [1], 2, node_budget, edge_budget, "both")
        two = graph.expand_frames(edges, spark.createDataFrame([(1,)], "node_id long"), 2, node_budget, edge_budget, "both")
        assert [r.edge_id for r in two.edges.orderBy("position").collect()] == [e["edge_id"] for e in one.edges] and two.truncated == one.truncated


def test_a_million_edges_of_budget_come_not_to_the_driver(spark, monkeypatch):
    """A star of 60,000 leaves, of which 50,000 are taken; only counts by range are collected."""
    edges = spark.range(60_000).select(F.col("id").alias("edge_id"), F.lit(0).cast("long").alias("from_node_id"), (F.col("id") + 1).alias("to_node_id"), F.lit("t").alias("edge_type"))
    got, real = [], type(edges).collect

    def collect(self):
        rows = real(self)
        got.append(len(rows))
        return rows

    monkeypatch.setattr(type(edges), "collect", collect)
    out = graph.expand_frames(edges, spark.range(1).withColumnRenamed("id", "node_id"), 2, node_budget=50_001, edge_budget=10**6)
    assert (out.covered, out.met, out.truncated) == (50_001, 50_000, True) and max(got, default=0) <= 16
    assert out.edges.agg(F.max("edge_id"), F.max("position")).first()[:2] == (49_999, 50_000)


def least(edges):
    around = {}
    for a, b in edges:
        if a != b:
            around.setdefault(a, set()).add(b)
            around.setdefault(b, set()).add(a)
    out = {}
    for n in sorted(around):
        stack = [n]
        while stack:
            x = stack.pop()
            if x not in out:
                out[x] = n
                stack += around[x]
    return out


@pytest.mark.parametrize("seed", range(2))
def test_components_after_changes(spark, seed):
    rng = random.Random(seed)
    pick = lambda: (rng.randint(1, 60), rng.randint(1, 60))
    frame = lambda e: spark.createDataFrame(sorted(e), "a long, b long")
    now = {pick() for _ in range(40)}
    labels = graph.components(frame(now))
    for _ in range(2):
        removed = set(rng.sample(sorted(now), rng.choice([0, 1, 6])))
        added = {pick() for _ in range(rng.choice([0, 1, 8]))} - now
        now = now - removed | added
        labels = graph.saved(graph.relabelled(labels, frame(now), frame(added), frame(removed)))
        assert {r.node: r.root for r in labels.collect()} == least(now)


def test_only_what_changed_is_computed_anew(spark, monkeypatch):
    """1,000 chains of 10; one loses an edge and two are joined: components are computed of 9 edges and of one."""
    edges = spark.range(10_000).where("id % 10 < 9").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    labels = graph.saved(graph.components(edges))
    sizes, real = [], graph.components

    def components(e):
        sizes.append(e.count())
        return real(e)

    monkeypatch.setattr(graph, "components", components)
    removed, added = edges.where("a = 504"), spark.createDataFrame([(20, 35)], "a long, b long")
    new = graph.relabelled(labels, edges.where("a <> 504").unionByName(added), added, removed)
    assert sizes == [8, 1]
    found = {r.node: r.root for r in new.collect()}
    assert len(found) == 10_000 and found[504] == 500 and found[509] == 505 and found[39] == 20 and found[999] == 990
    assert sorted(r.node for r in graph.connected(new, spark.createDataFrame([(31,), (10**6,)], "node long")).collect()) == [*range(20, 40), 10**6]


def test_salted_keys_are_never_broadcast(spark):
    small = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), F.col("id").alias("value"))
    big = spark.range(20000).select(F.sha2((F.col("id") % 6000).cast("string"), 256).alias("key"), "id")
    found = graph.salted(big.repartition(4), small.groupBy("key").agg(F.max("value").alias("value")), "key")
    rows = found.collect()
    assert len(rows) == sum(i % 6000 < 5000 for i in range(20000)) and all(r.value == r.id % 6000 for r in rows)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()  # as run: it is adaptive

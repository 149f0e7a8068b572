"""Binding by sets cut at two members: equal to counting all candidates, and no task of a name that all share."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import binding

EDGE = "edge_id long, edge_type string, source_key string, target_key string, language string, symbol string, resolution string, module string, import string, import_source string, imported_symbol string, alias string"
NODE = "canonical_key string, kind string, language string, name string, module_identity string, package_identity string, path string"


def made(rng):
    """A tangle of few names, modules and files, so that all ways to see a candidate meet."""
    nodes, edges = [], []
    for i in range(60):
        language, m = rng.choice(["python", "javascript"]), rng.randrange(6)
        nodes.append((f"k{i}", rng.choice(["function", "function", "class", "import"]), language, rng.choice("abc"), rng.choice([f"p{m % 3}.m{m}", ""]), rng.choice([f"p{m % 3}", ""]), f"src/f{m}.js"))
    for i in range(200):
        source = rng.choice(nodes)
        if i % 3:
            edges.append((i, "calls", source[0], rng.choice(["external:x", "import:y", "k1"]), source[2], rng.choice("abc"), rng.choice(["external", "unresolved", "static"]), None, None, None, None, None))
        else:
            m, symbol = rng.randrange(6), rng.choice("abc")
            form = rng.choice(["module", "import", "file"])
            edges.append((i, "imports", rng.choice([source[0], f"module:p{m % 3}.m{m}"]), "module:x", source[2], None, "static", f"p{m % 3}.m{m}" if form == "module" else None, f"module:p{m % 3}.{symbol}" if form == "import" else None, f"./f{m}" if form == "file" else None, symbol if form == "file" else None, rng.choice([None, symbol]) if form == "file" else None))
    return nodes, edges


@pytest.mark.parametrize("seed", range(4))
def test_one_candidate_by_bounds_and_by_counts(spark, seed):
    nodes, edges = made(random.Random(seed))
    nodes, edges = spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)
    counted = binding.visible_candidates(edges, nodes).groupBy("edge_id").agg(F.count("*").alias("n"), F.min("target_key").alias("key"))
    seen = counted.collect()
    assert {(r.edge_id, r.key) for r in seen if r.n == 1} == {tuple(r) for r in binding.only_candidates(edges, nodes).collect()}
    assert any(r.n == 1 for r in seen) and any(r.n > 1 for r in seen)
    bound = {r.edge_id: r for r in binding.bind(edges, nodes).collect()}
    assert len(bound) == edges.count()
    for r in edges.collect():
        one = next((s.key for s in seen if s.edge_id == r.edge_id and s.n == 1), None)
        is_open = r.resolution in ("external", "unresolved") or r.target_key.startswith("import:")
        assert bound[r.edge_id].target_key == (one if one and is_open else r.target_key)


def test_a_name_of_100000_definitions_and_callers(spark):
    """No join makes more rows than edges ask, and no task has twice the median's."""
    n = 100_000
    text = lambda x: F.concat(F.lit(x), F.col("id").cast("string"))
    nodes = spark.range(n).select(text("k").alias("canonical_key"), F.lit("function").alias("kind"), F.lit("python").alias("language"), F.lit("run").alias("name"), F.lit("p.m").alias("module_identity"), F.lit("p").alias("package_identity"), F.lit("p/m.py").alias("path"))
    none = {c: F.lit(None).cast("string").alias(c) for c in ("module", "import", "import_source", "imported_symbol", "alias")}
    edges = spark.range(n).select("id", F.lit("calls").alias("edge_type"), text("k").alias("source_key"), F.lit("unresolved:run").alias("target_key"), F.lit("python").alias("language"), F.lit("run").alias("symbol"), F.lit("unresolved").alias("resolution"), *none.values()).withColumnRenamed("id", "edge_id")
    assert binding.bind(edges, nodes).where("bound").isEmpty()
    alone = nodes.where("canonical_key = 'k5'").unionByName(nodes.where("canonical_key <> 'k5'").withColumn("name", F.lit("other")))
    bound = binding.bind(edges, alone)
    assert bound.where("bound and target_key = 'k5'").count() == n
    _, asked, _ = binding.sightings(edges, alone)
    salts = asked.select(F.pmod(F.xxhash64("edge_id", F.struct(*binding.WAY)), F.lit(16)).alias("salt")).groupBy("salt").count().toPandas()["count"]
    assert salts.sum() == n and salts.max() <= 2 * salts.median() and len(salts) == 16

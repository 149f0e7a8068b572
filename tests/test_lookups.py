"""Lookups of nodes by key and by id: same rows as a scan, and no more than the file that can hold them is read."""

import os
import random

import pytest
from pyspark.sql import functions as F
from test_postings import files

from graphloom.operators import lookups
from graphloom.plans import bootstrap, publish
from graphloom.sources.store import Store

ODD = ["", "é", "zz", "\U0001f600", "￿", "a b", "q'", 'q"']


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(3)
    keys = sorted({f"k{rng.randrange(10**6)}" for _ in range(4000)} | set(ODD))
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, n long").repartition(7)
    at = str(tmp_path_factory.mktemp("clustered"))
    lookups.write(rows, f"{at}/rows", f"{at}/ranges", "key", 50)
    ranges = spark.read.parquet(f"{at}/ranges")
    assert set(ranges.columns) == {"file", "first", "last", "rows"} and 45 <= ranges.count() <= 50
    return lookups.Clustered(spark, f"{at}/rows", ranges, "key", "key string, n long", os.listdir(f"{at}/rows")), {k: i for i, k in enumerate(keys)}


@pytest.fixture(autouse=True)
def plain_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan shows its scans
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_a_key_is_in_one_file_of_fifty(stored):
    table, every = stored
    for key in [*ODD, *random.Random(5).sample(sorted(every), 20)]:
        found = table.rows([key])
        assert [tuple(r) for r in found.collect()] == [(key, every[key])] and files(found) == 1
    for key in ("k", "k5x", "~", "\U0010ffff", "!"):
        found = table.rows([key])
        assert found.collect() == [] and files(found) <= 1
    assert table.rows([]).collect() == [] and table.rows([None]).collect() == []


def test_many_keys(stored):
    table, every = stored
    asked = random.Random(6).sample(sorted(every), 1500)
    assert {r.key: r.n for r in table.rows([*asked, "none", *asked[:3]]).collect()} == {k: every[k] for k in asked}
    near = sorted(every)[2000:2040]
    found = table.rows(near)
    assert {r.key for r in found.collect()} == set(near) and files(found) <= 3


def test_nodes_of_a_store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lookups, "ROWS", 8)
    tree = tmp_path / "tree"
    tree.mkdir()
    for i in range(60):
        (tree / f"m{i}.py").write_text(f"import os\n\ndef f{i}():\n    return g{i}()\n")
    store = Store(spark, str(tmp_path / "store"))
    store.create()
    at = bootstrap.build(store, str(tree), "r1", "1", ["."])["snapshot_id"]
    later = bootstrap.build(store, str(tree), "r2", "1", ["."], expected_parent=at)["snapshot_id"]
    every = {r.canonical_key: r for r in store.part("nodes", at).collect()}
    assert store.part("node_ranges", at).count() > 20 and store.part("id_ranges", at).agg(F.sum("rows")).first()[0] == len(every)
    for key in sorted(every)[::17]:
        found = publish.nodes_of(store, at, [key])
        assert len(found.collect()) == 1 and files(found) == 1
        assert len(publish.by_key(store, at).files([key])) == 1 and not publish.by_key(store, at).loose()
        assert publish.node_of(store, at, key)["node_id"] == every[key].node_id
        own = publish.node(store, every[key].node_id)
        assert own["canonical_key"] == key and own["snapshot_id"] == at and own["payload"]["canonical_key"] == key
        ids = publish.by_id(store, at)
        assert len(ids.files([every[key].node_id])) == 1
        assert publish.node_of(store, later, key)["node_id"] != every[key].node_id
    assert publish.node_of(store, at, "function:none") is None and publish.node(store, 10**9) is None
    assert publish.known_keys(store, at, ["none", "module:m3", "function:m7.f7"]) == ["function:m7.f7", "module:m3"]
    # nodes that are added one by one are found, too
    revisions = {c: "x" for c in ("source_revision", "index_revision", "config_version")}
    added = publish.add_node(store, later, "Graph", "function", revisions, {"canonical_key": "function:added", "name": "added"})
    unnamed = publish.add_node(store, later, "Graph", "function", revisions, {})
    assert publish.node_of(store, later, "function:added")["node_id"] == added and publish.node(store, added)["snapshot_id"] == later
    assert publish.node(store, unnamed)["canonical_key"] is None
    assert publish.node_of(store, at, "function:added") is None


def test_an_empty_table(spark, tmp_path):
    lookups.write(spark.createDataFrame([], "key string, n long"), str(tmp_path / "rows"), str(tmp_path / "ranges"), "key", 3)
    none = lookups.Clustered(spark, str(tmp_path / "rows"), spark.read.parquet(str(tmp_path / "ranges")), "key", "key string, n long", [])
    assert none.files(["a"]) == [] and none.rows(["a"]).collect() == []

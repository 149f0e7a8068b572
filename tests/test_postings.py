"""The stored search index: same answers as the tokens, few files read, bounded blocks."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import postings, search

WORDS = [f"{a}{b}{c}" for a in "abcdefgh" for b in "aeiou" for c in "klmnr"]
QUERIES = ["bak", "ba*", "bak bal", '"bak hum"', "bak OR hum", "hum NOT bak", "name : bak", "- name : ba*", "NEAR(bak hum, 2)", "^bak", "zzz", "zz*", "c*", "hum + ba*", "{name file_path} : h*"]


@pytest.fixture(scope="module")
def nodes(spark):
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows = [(i * 37, text(rng.randint(0, 30)) + (" hum bak" if i % 9 == 0 else ""), text(3), rng.choice([None, "bak/hum.py"]), "") for i in range(700)]
    rows.append((10**12, "hum " * 40_000, "", None, ""))  # one node with more places of a token than a block has
    return spark.createDataFrame(rows, "node_id long, name string, qualified_name string, file_path string, content_hash string").repartition(5)


@pytest.fixture(scope="module")
def stored(spark, nodes, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    postings.write(search.index(nodes), path, parts=50)
    return postings.Stored(spark, path)


def files(df):
    """The files that a plan's scans have read."""
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    metrics = [leaves.apply(i).metrics() for i in range(leaves.size())]
    return sum(m.apply("numFiles").value() for m in metrics if m.contains("numFiles"))  # a plan that reads nothing has no scan


@pytest.mark.parametrize("query", QUERIES)
def test_same_answers(nodes, stored, query):
    asked = search.parse(query)
    expected = sorted(r.node_id for r in search.matches(search.index(nodes), asked).collect())
    assert sorted(r.node_id for r in search.matches(stored, asked).collect()) == expected


def test_blocks_are_bounded_and_hold_all(nodes, stored):
    own = stored.spark.read.schema(postings.POSTINGS).parquet(f"{stored.path}/postings")
    assert own.where(F.array_max("nodes") >= postings.NODES).isEmpty() and own.where(F.array_max("places") >= postings.PLACES).isEmpty()
    assert own.where("token = 'hum' and node = 1000000000000").count() >= 3  # 40,000 places in blocks of 16,384
    every = own.select("token", "field", "node", "place", F.inline(F.arrays_zip("nodes", "places"))).select((F.col("node") + F.col("nodes")).alias("node_id"), "field", (F.col("place") + F.col("places")).alias("pos"), "token")
    assert every.exceptAll(search.index(nodes)).isEmpty() and search.index(nodes).exceptAll(every).isEmpty()


@pytest.mark.parametrize(("words", "prefix"), [(("bak",), False), (("ba",), True), (("c",), True), (("bak", "hum"), False), (("zz",), True)])
def test_words_and_prefixes_read_the_files_of_their_range(spark, stored, words, prefix):
    ranges = stored.terms.collect()
    assert len(ranges) >= 40
    holds = lambda w, begins, r: (r.first[: len(w)] if begins else r.first) <= w <= r.last or begins and r.first.startswith(w)
    wanted = {r.part for r in ranges if any(holds(w, prefix and i == len(words) - 1, r) for i, w in enumerate(words))}
    assert set(stored.parts(words, prefix)) == wanted and (len(wanted) <= 4 or "hum" in words)  # a frequent token has files of its own
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan shows its scans
    try:
        found = stored.tokens(words, prefix)
        found.collect()
        assert files(found) == len(wanted)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert found.where(~F.col("token").isin(*words[: len(words) - prefix]) & ~(F.lit(prefix) & F.col("token").startswith(words[-1]))).isEmpty()


def test_an_empty_index(spark, nodes, tmp_path):
    postings.write(search.index(nodes.where("false")), str(tmp_path / "none"))
    none = postings.Stored(spark, str(tmp_path / "none"))
    assert none.isEmpty() and search.matches(none, search.parse("a*")).isEmpty()


def test_tasks_make_blocks_of_words_before_they_are_dealt(spark, nodes, tmp_path):
    own = search.words(nodes.orderBy(F.desc("node_id")).coalesce(1))
    made = own.select("words", "field", "node_id").mapInArrow(postings.packed, postings.POSTINGS.removesuffix(", part int"))
    assert made.count() < search.index(nodes).count() / 2 and made.where(F.size("nodes") > postings.ENTRIES).isEmpty()
    postings.write(own, str(tmp_path / "words"), parts=5)
    stored = spark.read.schema(postings.POSTINGS).parquet(f"{tmp_path}/words/postings")
    every = stored.select("token", "field", "node", "place", F.inline(F.arrays_zip("nodes", "places"))).select((F.col("node") + F.col("nodes")).alias("node_id"), "field", (F.col("place") + F.col("places")).alias("pos"), "token")
    assert every.exceptAll(search.index(nodes)).isEmpty() and search.index(nodes).exceptAll(every).isEmpty()

"""Queries that put each operator to work on graph-shaped views of the driver's tables, and DuckDB SQL for each.

G: regions, nations, customers and suppliers as nodes (ids interleaved, so any scale has room), edges region ->
nation, nation -> customer, nation -> supplier.  P: pages and the links in them.  C: conversations, each turn
linked to the next.  D: documents as files.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators import binding, evaluate, extract, graph, lookups, postings, rows, search
from .sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def g_nodes(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for i, (t, key, name) in enumerate((("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"))):
        own = table(spark, d, t).select((F.col(key).cast("long") * 4 + i).alias("node_id"), F.lit(t).alias("kind"), F.concat(F.lit(f"{t}:"), F.col(name)).alias("canonical_key"), F.concat(F.lit(f"{t}/"), F.col(name), F.lit(".py")).alias("file_path"), F.col(name).alias("name"))
        parts.append(own)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def g_edges(spark: SparkSession, d: str) -> DataFrame:
    made = (("nation", "n_nationkey", "n_regionkey", 0, 1, "contains", 0), ("customer", "c_custkey", "c_nationkey", 1, 2, "serves", 1), ("supplier", "s_suppkey", "s_nationkey", 1, 3, "supplies", 2))
    out = None
    for t, key, parent, a, b, kind, i in made:
        own = table(spark, d, t).select((F.col(key).cast("long") * 3 + i).alias("edge_id"), (F.col(parent).cast("long") * 4 + a).alias("from_node_id"), (F.col(key).cast("long") * 4 + b).alias("to_node_id"), F.lit(kind).alias("edge_type"))
        out = own if out is None else out.unionByName(own)
    return out


G_SQL = """g_nodes AS (
  SELECT CAST(r_regionkey AS BIGINT) * 4 AS node_id, 'region' AS kind, 'region:' || r_name AS canonical_key, 'region/' || r_name || '.py' AS file_path, r_name AS name FROM region
  UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 4 + 1, 'nation', 'nation:' || n_name, 'nation/' || n_name || '.py', n_name FROM nation
  UNION ALL SELECT c_custkey * 4 + 2, 'customer', 'customer:' || c_name, 'customer/' || c_name || '.py', c_name FROM customer
  UNION ALL SELECT s_suppkey * 4 + 3, 'supplier', 'supplier:' || s_name, 'supplier/' || s_name || '.py', s_name FROM supplier),
g_edges AS (
  SELECT CAST(n_nationkey AS BIGINT) * 3 AS edge_id, CAST(n_regionkey AS BIGINT) * 4 AS from_node_id, CAST(n_nationkey AS BIGINT) * 4 + 1 AS to_node_id, 'contains' AS edge_type FROM nation
  UNION ALL SELECT c_custkey * 3 + 1, CAST(c_nationkey AS BIGINT) * 4 + 1, c_custkey * 4 + 2, 'serves' FROM customer
  UNION ALL SELECT s_suppkey * 3 + 2, CAST(s_nationkey AS BIGINT) * 4 + 1, s_suppkey * 4 + 3, 'supplies' FROM supplier)"""


def ids(spark: SparkSession, *node_ids: int) -> DataFrame:
    return spark.createDataFrame([(n,) for n in node_ids], "node_id long")


MET = ("level", "edge_id", "from_node_id", "to_node_id", "edge_type")


@query(f"WITH {G_SQL} SELECT 1 AS level, edge_id, from_node_id, to_node_id, edge_type FROM g_edges WHERE from_node_id IN (0, 5)")
def expand_out_d1(spark, d):
    return graph.levels(g_edges(spark, d), ids(spark, 0, 5), 1)[0].select(*MET)


@query(f"WITH {G_SQL} SELECT 1 AS level, edge_id, from_node_id, to_node_id, edge_type FROM g_edges WHERE to_node_id IN (1, 5, 6)")
def expand_in_d1(spark, d):
    return graph.levels(g_edges(spark, d), ids(spark, 1, 5, 6), 1, "in")[0].select(*MET)


@query(f"WITH {G_SQL} SELECT 1 AS level, edge_id, from_node_id, to_node_id, edge_type FROM g_edges WHERE from_node_id IN (1, 5) OR to_node_id IN (1, 5)")
def expand_both_d1(spark, d):
    return graph.levels(g_edges(spark, d), ids(spark, 1, 5), 1, "both")[0].select(*MET)


@query(f"""WITH RECURSIVE {G_SQL}, walk AS (
  SELECT 1 AS level, e.* FROM g_edges e WHERE from_node_id IN (0, 4) AND edge_type IN ('contains', 'serves')
  UNION ALL SELECT level + 1, e.* FROM walk w JOIN g_edges e ON e.from_node_id = w.to_node_id WHERE level < 3 AND e.edge_type IN ('contains', 'serves'))
SELECT level, edge_id, from_node_id, to_node_id, edge_type FROM walk""")
def expand_out_d3_typed(spark, d):
    return graph.levels(g_edges(spark, d), ids(spark, 0, 4), 3, "out", ("contains", "serves"))[0].select(*MET)


@query(f"""WITH {G_SQL}, ok AS (SELECT node_id FROM g_nodes WHERE kind = 'nation' AND name < 'NATION_2' OR kind = 'customer'),
a AS (SELECT e.* FROM g_edges e JOIN ok ON to_node_id = node_id WHERE from_node_id = 0),
b AS (SELECT e.* FROM g_edges e JOIN ok ON e.to_node_id = node_id WHERE e.from_node_id IN (SELECT to_node_id FROM a))
SELECT 1 AS level, edge_id, from_node_id, to_node_id, edge_type FROM a UNION ALL SELECT 2, edge_id, from_node_id, to_node_id, edge_type FROM b""")
def expand_scoped(spark, d):
    scope = g_nodes(spark, d).where("kind = 'nation' AND name < 'NATION_2' OR kind = 'customer'").select("node_id")
    return graph.levels(g_edges(spark, d), ids(spark, 0), 2, scope=scope)[0].select(*MET)


@query(f"""WITH {G_SQL}, l1 AS (SELECT e.*, row_number() OVER (ORDER BY edge_id) AS i FROM g_edges e WHERE from_node_id IN (0, 4)),
l2 AS (SELECT e.*, row_number() OVER (ORDER BY edge_id) AS i FROM g_edges e WHERE from_node_id IN (SELECT to_node_id FROM l1)),
n AS (SELECT count(*) AS n FROM l1)
SELECT i AS position, edge_id, from_node_id, to_node_id, edge_type FROM l1
UNION ALL SELECT i + n, edge_id, from_node_id, to_node_id, edge_type FROM l2, n WHERE i + n <= 40""")
def expand_budgeted(spark, d):
    found = graph.expand(g_nodes(spark, d), g_edges(spark, d), [0, 4], depth=2, node_budget=1000, edge_budget=40)
    made = [(i, e["edge_id"], e["from_node_id"], e["to_node_id"], e["edge_type"]) for i, e in enumerate(found.edges, 1)]
    return spark.createDataFrame(made, "position long, edge_id long, from_node_id long, to_node_id long, edge_type string")


@query(f"""WITH RECURSIVE {G_SQL}, walk AS (SELECT from_node_id AS seed, to_node_id AS node_id, 1 AS level, [from_node_id, to_node_id] AS path FROM g_edges WHERE from_node_id = 0
  UNION ALL SELECT seed, e.to_node_id, level + 1, list_append(path, e.to_node_id) FROM walk w JOIN g_edges e ON e.from_node_id = w.node_id WHERE level < 2)
SELECT node_id, level, array_to_string(path, '>') AS path FROM walk""")
def shortest_paths(spark, d):
    return graph.levels(g_edges(spark, d), ids(spark, 0), 2)[1].select("node_id", "level", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("""WITH RECURSIVE e AS (SELECT conv_id * 1000 + turn AS a, conv_id * 1000 + turn + 1 AS b FROM conversations c WHERE EXISTS (SELECT 1 FROM conversations n WHERE n.conv_id = c.conv_id AND n.turn = c.turn + 1)),
ab AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT DISTINCT conv_id * 1000 + turn AS node_id FROM conversations WHERE turn = 1 UNION SELECT b FROM r JOIN ab ON a = node_id)
SELECT node_id FROM r""")
def closure_undirected(spark, d):
    turns = table(spark, d, "conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn")).distinct()
    at = F.col("conv_id") * 1000 + F.col("turn")
    edges = turns.select("conv_id", "turn").distinct().join(after, ["conv_id", "turn"]).select(at.alias("from_node_id"), (at + 1).alias("to_node_id"))
    return graph.closure(edges, turns.where("turn = 1").select(at.alias("node_id")))


@query(f"""WITH {G_SQL}, l1 AS (SELECT e.*, row_number() OVER (ORDER BY edge_id) AS i FROM g_edges e WHERE from_node_id IN (0, 4) AND to_node_id % 12 <> 1),
l2 AS (SELECT e.*, row_number() OVER (ORDER BY edge_id) AS i, count(*) OVER (ORDER BY edge_id) + 2 + (SELECT count(*) FROM l1) AS covered FROM g_edges e WHERE from_node_id IN (SELECT to_node_id FROM l1) AND to_node_id % 12 <> 1)
SELECT i AS position, 1 AS level, edge_id, from_node_id || '>' || to_node_id AS path FROM l1
UNION ALL SELECT l2.i + (SELECT count(*) FROM l1), 2, l2.edge_id, l1.from_node_id || '>' || l2.from_node_id || '>' || l2.to_node_id FROM l2 JOIN l1 ON l1.to_node_id = l2.from_node_id WHERE covered <= (SELECT count(*) / 3 FROM customer)""")
def expand_node_budget(spark, d):
    """A budget of a third as many nodes as there are customers, which stops the second level; no node of every third is let in."""
    budget = table(spark, d, "customer").count() // 3
    scope = g_nodes(spark, d).where("node_id % 12 <> 1").select("node_id")
    found = graph.expand_frames(g_edges(spark, d), ids(spark, 0, 4), 2, node_budget=budget, edge_budget=10**9, scope=scope)
    path = F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path")
    return found.edges.join(found.nodes.select(F.col("node_id").alias("to_node_id"), path), "to_node_id").select("position", "level", "edge_id", "path")


CHANGED_SQL = """t AS (SELECT DISTINCT conv_id, turn FROM conversations),
e AS (SELECT a.conv_id * 1000 + a.turn AS a, a.conv_id * 1000 + a.turn + 1 AS b, a.conv_id % 5 = 0 AND a.turn = 0 AS gone FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
more AS (SELECT a.conv_id * 1000 AS a, b.conv_id * 1000 AS b FROM t a JOIN t b ON b.conv_id = a.conv_id + 1 AND a.turn = 0 AND b.turn = 0 WHERE a.conv_id % 7 = 0)"""


@query(f"""WITH RECURSIVE {CHANGED_SQL}, now AS (SELECT a, b FROM e WHERE NOT gone UNION SELECT a, b FROM more), ab AS (SELECT a, b FROM now UNION SELECT b, a FROM now),
r AS (SELECT DISTINCT a AS root, a AS node FROM ab UNION SELECT root, b FROM r JOIN ab ON a = node) SELECT node, min(root) AS root FROM r GROUP BY node""")
def components_changed(spark, d):
    """Labels of conversations' turns after some edges went and others came, from the labels before."""
    turns = table(spark, d, "conversations").select("conv_id", "turn").distinct()
    at = F.col("conv_id") * 1000 + F.col("turn")
    chain = turns.join(turns.select("conv_id", (F.col("turn") - 1).alias("turn")), ["conv_id", "turn"]).select(at.alias("a"), (at + 1).alias("b"), ((F.col("conv_id") % 5 == 0) & (F.col("turn") == 0)).alias("gone"))
    first = turns.where("turn = 0")
    added = first.where("conv_id % 7 = 0").join(first.select((F.col("conv_id") - 1).alias("conv_id")), "conv_id").select((F.col("conv_id") * 1000).alias("a"), ((F.col("conv_id") + 1) * 1000).alias("b"))
    old, removed, stay = chain.select("a", "b"), chain.where("gone").select("a", "b"), chain.where("not gone").select("a", "b")
    return graph.relabelled(graph.components(old), stay.unionByName(added), added, removed).select("node", "root")


@query(f"WITH {G_SQL} SELECT node_id FROM g_nodes WHERE file_path IN (SELECT 'nation/' || n_name || '.py' FROM nation WHERE n_nationkey % 3 = 0) OR file_path IN (SELECT 'region/' || r_name || '.py' FROM region WHERE r_regionkey = 1)")
def impact_nodes(spark, d):
    n = table(spark, d, "nation").where("n_nationkey % 3 = 0").select(F.lit("M").alias("status"), F.concat(F.lit("nation\\"), "n_name", F.lit(".py")).alias("path"), F.lit(None).cast("string").alias("old_path"))
    r = table(spark, d, "region").where("r_regionkey = 1").select(F.lit("R").alias("status"), F.lit("gone.py").alias("path"), F.concat(F.lit("region/"), "r_name", F.lit(".py")).alias("old_path"))
    return graph.affected_nodes(g_nodes(spark, d), n.union(r))


@query("""SELECT doc_id AS mapping_id FROM labels WHERE quality = 1 AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'de' UNION SELECT doc_id + 1 FROM documents WHERE lang = 'de')""")
def stale_mappings(spark, d):
    mappings = table(spark, d, "labels").select(F.col("doc_id").alias("mapping_id"), F.when(F.col("quality") == 1, "confirmed").otherwise("stale").alias("status"), F.array(F.col("doc_id"), F.col("doc_id") - 1).alias("anchor_node_ids"))
    return graph.affected_mappings(mappings, table(spark, d, "documents").where("lang = 'de'").select(F.col("doc_id").alias("node_id"))).select("mapping_id")


@query(f"WITH {G_SQL} SELECT e.edge_id, a.canonical_key AS source_key, b.canonical_key AS target_key, e.edge_type FROM g_edges e JOIN g_nodes a ON e.from_node_id = a.node_id JOIN g_nodes b ON e.to_node_id = b.node_id")
def edge_endpoints_join(spark, d):
    n = g_nodes(spark, d)
    a, b = n.select(F.col("node_id").alias("from_node_id"), F.col("canonical_key").alias("source_key")), n.select(F.col("node_id").alias("to_node_id"), F.col("canonical_key").alias("target_key"))
    return g_edges(spark, d).join(a, "from_node_id").join(b, "to_node_id").select("edge_id", "source_key", "target_key", "edge_type")


def p_edges(spark: SparkSession, d: str) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return table(spark, d, "pages").select("page_id", "url", F.posexplode(links).alias("pos", "href")).select((F.col("page_id") * 100000 + F.col("pos")).alias("edge_id"), F.lit("links").alias("edge_type"), F.col("url").alias("source_key"), F.col("href").alias("target_key"), F.col("url").alias("file_path"), F.lit(1).alias("start_line"))


P_SQL = """p_edges AS (SELECT page_id * 100000 + i - 1 AS edge_id, 'links' AS edge_type, url AS source_key, h[i] AS target_key, url AS file_path FROM (
  SELECT page_id, url, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages)))"""


@query(f"""WITH {P_SQL}, ends AS (SELECT edge_id, 0 AS side, source_key AS k FROM p_edges UNION ALL SELECT edge_id, 1, target_key FROM p_edges)
SELECT 'external:' || k AS canonical_key, k AS name, min(edge_id) AS edge_id FROM ends WHERE k NOT IN (SELECT url FROM pages WHERE url IS NOT NULL) GROUP BY k""")
def external_nodes(spark, d):
    return graph.external_nodes(p_edges(spark, d), table(spark, d, "pages").select(F.col("url").alias("canonical_key"))).select("canonical_key", "name", "edge_id")


@query(f"WITH {P_SQL} SELECT min(edge_id) AS edge_id, source_key, target_key FROM p_edges GROUP BY edge_type, source_key, target_key, file_path")
def edge_dedupe_first(spark, d):
    return graph.first_edges(p_edges(spark, d)).select("edge_id", "source_key", "target_key")


@query("SELECT text, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return rows.duplicate_keys(table(spark, d, "documents"), "text")


@query("SELECT doc_id FROM documents WHERE lang <> 'en' OR source <> 'src1'")
def revision_mismatch_gate(spark, d):
    own = table(spark, d, "documents").select("doc_id", F.lit(1).alias("snapshot_id"), F.col("lang").alias("source_revision"), F.col("source").alias("index_revision"), F.lit("1").alias("config_version"))
    expected = spark.createDataFrame([(1, "en", "src1", "1")], "snapshot_id int, source_revision string, index_revision string, config_version string")
    return rows.revision_mismatches(own, expected).select("doc_id")


@query("SELECT count(*) FILTER (WHERE json_extract_string(props, '$.k') IS NULL) AS missing, count(*) AS n FROM events")
def null_key_gate(spark, d):
    return rows.keyless(table(spark, d, "events"), F.get_json_object("props", "$.k"))


SEARCH_SQL = r"""docs AS (SELECT p_partkey AS node_id, regexp_extract_all(strip_accents(lower(p_name)), '[\p{L}\p{N}]+') AS a, regexp_extract_all(strip_accents(lower(p_type)), '[\p{L}\p{N}]+') AS b FROM part)"""


_indexes: dict[tuple[str, str, str], postings.Stored] = {}


def stored_index(spark: SparkSession, d: str, name: str, tokens: DataFrame) -> postings.Stored:
    """The stored index of a table, written once for each application, as a snapshot's is at its build."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _indexes:
        path = f"{graph.shared_folder(spark)}/index-{uuid.uuid4().hex}"
        postings.write(tokens, path)
        _indexes[key] = postings.Stored(spark, path)
    return _indexes[key]


def document_index(spark: SparkSession, d: str) -> postings.Stored:
    return stored_index(spark, d, "documents", search.words(table(spark, d, "documents").withColumnRenamed("text", "name"), ("name",), "doc_id"))


def parts(spark: SparkSession, d: str) -> tuple[DataFrame, postings.Stored]:
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_name").alias("name"), F.col("p_type").alias("qualified_name"), F.lit(None).cast("string").alias("file_path"), F.lit("").alias("content_hash"))
    return nodes, stored_index(spark, d, "part", search.words(nodes))


def found(spark: SparkSession, d: str, text_: str) -> DataFrame:
    return search.matches(parts(spark, d)[1], search.parse(text_))


@query(r"""WITH d AS (SELECT doc_id AS node_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS w FROM documents)
SELECT node_id, 'name' AS field, i - 1 AS pos, w[i] AS token FROM (SELECT node_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)""")
def index_tokens(spark, d):
    return search.index(table(spark, d, "documents").withColumnRenamed("text", "name"), ("name",), "doc_id")


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS w FROM documents)
SELECT token, count(*) AS places, min(doc_id) AS least, max(doc_id) AS most FROM (SELECT doc_id, unnest(w) AS token FROM w) GROUP BY token""")
def index_dictionary(spark, d):
    """What the blocks of the stored index say of each token, without a row for each of its places."""
    own = spark.read.schema(postings.POSTINGS).parquet(f"{document_index(spark, d).path}/postings")
    least, most = F.col("node") + F.get("nodes", F.lit(0)), F.col("node") + F.array_max("nodes")
    return own.groupBy("token").agg(F.sum(F.size("places")).alias("places"), F.min(least).alias("least"), F.max(most).alias("most"))


@query(f"WITH {SEARCH_SQL} SELECT node_id FROM docs WHERE (list_contains(a, 'bolt') OR list_contains(b, 'bolt')) AND (list_contains(b, 'small') OR list_contains(a, 'small'))")
def search_and(spark, d):
    return found(spark, d, "Bolt SMALL")


@query(f"WITH {SEARCH_SQL} SELECT node_id FROM docs WHERE list_contains(a, 'economy') OR list_contains(b, 'economy') OR list_contains(a, 'gear') OR list_contains(b, 'gear')")
def search_or(spark, d):
    return found(spark, d, "economy OR gear")


@query(f"WITH {SEARCH_SQL} SELECT node_id FROM docs WHERE (list_contains(a, 'red') OR list_contains(b, 'red')) AND NOT (list_contains(a, 'economy') OR list_contains(b, 'economy'))")
def search_not(spark, d):
    return found(spark, d, "red NOT economy")


@query(r"""SELECT doc_id AS node_id FROM documents WHERE regexp_matches(' ' || array_to_string(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+'), ' ') || ' ', ' of the ')""")
def search_phrase(spark, d):
    return search.matches(document_index(spark, d), search.parse('"Of_the"'))


@query(f"WITH {SEARCH_SQL} SELECT node_id FROM docs WHERE len(list_filter(list_concat(a, b), lambda x: starts_with(x, 'ec'))) > 0")
def search_prefix(spark, d):
    return found(spark, d, "ec*")


@query(f"WITH {SEARCH_SQL} SELECT node_id FROM docs WHERE list_contains(b, 'small') AND list_contains(a, 'bolt')")
def search_column(spark, d):
    return found(spark, d, "qualified_name : small AND name : bolt")


@query(r"""WITH t AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS w FROM documents))
SELECT DISTINCT a.doc_id AS node_id FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.token IN ('are', 'was') AND b.token IN ('are', 'was') AND a.token <> b.token AND b.pos > a.pos AND b.pos - a.pos - 1 <= 3""")
def search_near(spark, d):
    return search.matches(document_index(spark, d), search.parse("NEAR(are was, 3)"))


@query(f"WITH {SEARCH_SQL} SELECT d.node_id, p_name AS name, 1.0 AS score FROM docs d JOIN part ON p_partkey = d.node_id WHERE list_contains(b, 'promo') OR list_contains(a, 'promo') ORDER BY 1 LIMIT 20")
def search_top(spark, d):
    return search.search(*parts(spark, d), "promo").select("node_id", "name", "score")


@query("SELECT lang AS language, count(*) AS files, count(*) FILTER (WHERE source <> 'src0') AS supported, count(*) FILTER (WHERE source <> 'src0' AND n_chars >= 200) AS parsed FROM documents GROUP BY lang")
def coverage_by_language(spark, d):
    files = table(spark, d, "documents").select(F.col("lang").alias("language"), (F.col("source") != "src0").alias("supported"), (F.col("n_chars") < 200).alias("failed"))
    return rows.coverage(files)


@query("SELECT count(*) AS total, count(*) FILTER (WHERE source = 'src0') AS unsupported, count(*) FILTER (WHERE source <> 'src0' AND n_chars < 200) AS parse_errors FROM documents WHERE source = 'src0' OR n_chars < 200")
def diagnostics_summary(spark, d):
    own = table(spark, d, "documents").where("source = 'src0' or n_chars < 200")  # a diagnostic each
    return rows.diagnostic_counts(own.select((F.col("source") != "src0").alias("supported")))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def payload_project(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def golden(spark: SparkSession, d: str) -> DataFrame:
    """A sample for each order: its parts as listed are expected, those of 25 units or fewer are what a search gave."""
    line = table(spark, d, "lineitem").groupBy("l_orderkey")
    sorted_keys = lambda when: F.array_sort(F.collect_list(when))
    return line.agg(sorted_keys(F.col("l_partkey")).alias("expected"), sorted_keys(F.when(F.col("l_quantity") <= 25, F.col("l_partkey"))).alias("actual"))


GOLDEN_SQL = """g AS (SELECT l_orderkey, list(l_partkey ORDER BY l_partkey) AS expected, coalesce(list(l_partkey ORDER BY l_partkey) FILTER (WHERE l_quantity <= 25), []) AS actual FROM lineitem GROUP BY 1)"""


@query(f"WITH {GOLDEN_SQL} SELECT count(*) AS samples, count(*) FILTER (WHERE expected = actual) AS passed, avg(CASE WHEN expected = actual THEN 1.0 ELSE 0.0 END) AS accuracy FROM g")
def evaluate_accuracy(spark, d):
    return evaluate.metrics(golden(spark, d)).select("samples", "passed", "accuracy")


@query(f"WITH {GOLDEN_SQL}, s AS (SELECT len(list_distinct(expected)) AS r, len(list_distinct(actual)) AS n, len(list_intersect(list_distinct(expected), list_distinct(actual))) AS h, greatest(len(expected), 1) AS q FROM g) SELECT sum(h) / sum(n) AS precision, sum(h) / sum(r) AS recall, sum(h) / sum(q) AS business_precision FROM s")
def precision_recall(spark, d):
    return evaluate.measures(golden(spark, d)).select("precision", "recall", "business_precision")


@query("WITH m AS (SELECT o_orderpriority AS metric, avg(o_totalprice) AS value FROM orders GROUP BY 1), t AS (SELECT DISTINCT o_orderpriority AS metric, 250000.0 AS threshold FROM orders UNION ALL SELECT 'absent', 0.5) SELECT t.metric, round(coalesce(value, 0.0), 4) AS value, threshold FROM t LEFT JOIN m USING (metric) WHERE coalesce(value, 0.0) < threshold")
def acceptance_gate(spark, d):
    orders = table(spark, d, "orders")
    measured = orders.groupBy(F.col("o_orderpriority").alias("metric")).agg(F.avg("o_totalprice").alias("value"))
    thresholds = orders.select(F.col("o_orderpriority").alias("metric"), F.lit(250000.0).alias("threshold")).distinct().union(spark.createDataFrame([("absent", 0.5)], "metric string, threshold double"))
    return evaluate.gate(measured, thresholds).withColumn("value", F.round("value", 4))


@query("WITH r AS (SELECT p_brand AS term, p_type FROM part WHERE p_size < 5 GROUP BY ALL), q AS (SELECT DISTINCT p_brand AS query FROM part UNION ALL SELECT 'none') SELECT query, count(term) AS candidates, CASE count(term) WHEN 0 THEN 'not_found' WHEN 1 THEN 'selected' ELSE 'needs_user_selection' END AS status FROM q LEFT JOIN r ON query = term GROUP BY query")
def route_resolve(spark, d):
    part = table(spark, d, "part")
    routes = part.where("p_size < 5").select(F.col("p_brand").alias("term"), "p_type").distinct()
    return rows.resolved(routes, part.select(F.col("p_brand").alias("query")).distinct().union(spark.createDataFrame([("none",)], "query string")))


@query(f"WITH {G_SQL} SELECT kind, string_agg('- ' || canonical_key, chr(10) ORDER BY node_id) AS body FROM g_nodes GROUP BY kind")
def knowledge_document(spark, d):
    return rows.document(g_nodes(spark, d), ["kind"], F.concat(F.lit("- "), "canonical_key"), "node_id").drop("refs")


@query(f"WITH {G_SQL} SELECT kind, array_to_string(list_sort(list(DISTINCT node_id % 100)), ',') AS evidence_refs FROM g_nodes GROUP BY kind")
def evidence_refs(spark, d):
    made = rows.document(g_nodes(spark, d), ["kind"], F.lit("-"), "node_id", F.col("node_id") % 100)
    return made.select("kind", F.array_join(F.transform("refs", lambda x: x.cast("string")), ",").alias("evidence_refs"))


def b_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Customers as functions named after their segment and balance, in a package for each nation."""
    name = F.concat("c_mktsegment", F.lit("_"), F.floor("c_acctbal").cast("string"))
    module = F.concat(F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit(".m"), (F.col("c_custkey") % 7).cast("string"))
    return table(spark, d, "customer").select(F.concat(F.lit("function:c"), F.col("c_custkey").cast("string")).alias("canonical_key"), F.lit("function").alias("kind"), F.lit("python").alias("language"), name.alias("name"), module.alias("module_identity"), F.concat(F.lit("nation"), F.col("c_nationkey").cast("string")).alias("package_identity"), F.concat(F.regexp_replace(module, r"\.", "/"), F.lit(".py")).alias("path"))


def b_edges(spark: SparkSession, d: str) -> DataFrame:
    """Each customer calls the name of the one five on; every third imports the module of the one five on."""
    c = table(spark, d, "customer")
    other = c.select((F.col("c_custkey") - 5).alias("c_custkey"), F.concat("c_mktsegment", F.lit("_"), F.floor("c_acctbal").cast("string")).alias("symbol"), F.concat(F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit(".m"), (F.col("c_custkey") % 7).cast("string")).alias("module"))
    own = c.select("c_custkey").join(other, "c_custkey")
    none = F.lit(None).cast("string")
    key = F.concat(F.lit("function:c"), F.col("c_custkey").cast("string"))
    call = own.select((F.col("c_custkey") * 2).alias("edge_id"), F.lit("calls").alias("edge_type"), key.alias("source_key"), F.concat(F.lit("unresolved:"), "symbol").alias("target_key"), F.lit("python").alias("language"), "symbol", F.lit("unresolved").alias("resolution"), none.alias("module"), none.alias("import"), none.alias("import_source"), none.alias("imported_symbol"), none.alias("alias"))
    imports = own.where("c_custkey % 3 = 0").select((F.col("c_custkey") * 2 + 1).alias("edge_id"), F.lit("imports").alias("edge_type"), key.alias("source_key"), F.concat(F.lit("module:"), "module").alias("target_key"), F.lit("python").alias("language"), none.alias("symbol"), F.lit("static").alias("resolution"), "module", none.alias("import"), none.alias("import_source"), none.alias("imported_symbol"), none.alias("alias"))
    return call.unionByName(imports)


BIND_SQL = """n AS (SELECT c_custkey AS k, 'function:c' || c_custkey AS key, c_mktsegment || '_' || CAST(floor(c_acctbal) AS BIGINT) AS name, 'nation' || c_nationkey AS package, 'nation' || c_nationkey || '.m' || (c_custkey % 7) AS module FROM customer),
e AS (SELECT a.k, a.key, a.package, b.name AS symbol, CASE WHEN a.k % 3 = 0 THEN b.module END AS imported FROM n a JOIN n b ON b.k = a.k + 5),
seen AS (SELECT e.k, n.key AS target_key FROM e JOIN n ON n.name = e.symbol AND (n.package = e.package OR n.module = e.imported))"""


@query(f"WITH {BIND_SQL} SELECT e.k * 2 AS edge_id, coalesce(s.target_key, 'unresolved:' || symbol) AS target_key, CASE WHEN s.k IS NULL THEN 'unresolved' ELSE 'static' END AS resolution FROM e LEFT JOIN (SELECT k, min(target_key) AS target_key FROM seen GROUP BY k HAVING count(*) = 1) s USING (k)")
def bind_symbols_unique(spark, d):
    return binding.bind(b_edges(spark, d), b_nodes(spark, d)).where("edge_type = 'calls'").select("edge_id", "target_key", "resolution")


@query(f"WITH {BIND_SQL} SELECT k * 2 AS edge_id, target_key FROM seen")
def import_visibility(spark, d):
    return binding.visible_candidates(b_edges(spark, d), b_nodes(spark, d))


@query("SELECT user_id, event_type, max_by(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def upsert_latest(spark, d):
    return rows.latest(table(spark, d, "events").select("user_id", "event_type", "value", "event_id"), ["user_id", "event_type"], F.col("event_id"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS request_id, n_regionkey IS NOT DISTINCT FROM 2 AS accepted, CASE WHEN n_regionkey IS NOT DISTINCT FROM 2 THEN CAST(n_nationkey AS BIGINT) ELSE 2 END AS active FROM nation")
def cas_publish(spark, d):
    requests = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("request_id"), F.col("n_regionkey").cast("long").alias("expected_parent"), F.col("n_nationkey").cast("long").alias("snapshot_id"))
    return rows.swapped(spark.createDataFrame([(2,)], "active long"), requests)


@query("(SELECT DISTINCT p_brand AS tool, 'missing' AS side FROM part WHERE p_size <= 2 AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_size >= 49)) UNION ALL (SELECT DISTINCT p_brand, 'unexpected' FROM part WHERE p_size >= 49 AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_size <= 2))")
def permission_diff(spark, d):
    part = table(spark, d, "part").withColumnRenamed("p_brand", "tool")
    return rows.differences(part.where("p_size <= 2"), part.where("p_size >= 49"), "tool")


@query("SELECT o_orderkey AS line, o_orderstatus AS status, 'b/' || o_custkey AS path, CASE WHEN o_orderstatus = 'F' THEN 'a/' || o_custkey END AS old_path FROM orders WHERE o_orderstatus <> 'P'")
def change_feed(spark, d):
    o = table(spark, d, "orders")
    two = F.concat(F.lit("a/"), F.col("o_custkey").cast("string"), F.lit("\t"), F.lit("b/"), F.col("o_custkey").cast("string"))
    raw = o.select(F.col("o_orderkey").alias("line"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("R100\t"), two)).when(F.col("o_orderstatus") == "O", F.concat(F.lit("M\tb/"), F.col("o_custkey").cast("string"))).otherwise("P").alias("value"))
    from .sources import changes

    return changes.parsed(raw, "value", "line").withColumn("status", F.when(F.col("status") == "R", "F").otherwise("O"))


FILES_SQL = "f AS (SELECT doc_id, source || '/' || lang || '/' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.d.TS' WHEN 2 THEN '.ts' WHEN 3 THEN '/__init__.py' ELSE '.md' END AS path FROM documents)"


def d_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files: a path each, of five kinds."""
    end = F.element_at(F.array(*map(F.lit, (".py", ".d.TS", ".ts", "/__init__.py", ".md"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), end).alias("path"))


@query(f"WITH {FILES_SQL} SELECT path FROM f WHERE (starts_with(path, 'src1/') OR starts_with(path, 'src2/en/')) AND NOT starts_with(path, 'src1/de/')")
def scoped_files(spark, d):
    return d_files(spark, d).where(text.under(F.col("path"), ["src1", "src2/en/"]) & ~text.under(F.col("path"), ["src1/de"])).select("path")


@query("""WITH t AS (SELECT coalesce(nullif(source, ''), '__HIVE_DEFAULT_PARTITION__') AS source, coalesce(nullif(lang, ''), '__HIVE_DEFAULT_PARTITION__') AS lang, coalesce(text, '') AS text FROM documents)
SELECT 'source=' || source || '/lang=' || lang AS folder, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes, CAST(sum(len(text) + 1) AS BIGINT) AS chars FROM t GROUP BY source, lang""")
def tree_files(spark, d):
    """What is in the folders of a tree of files that Spark writes, a folder for each source and language."""
    root = f"{graph.shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    documents = table(spark, d, "documents").select("source", "lang", F.coalesce("text", F.lit("")).alias("text"))
    documents.write.partitionBy("source", "lang").text(root)
    found = files.scan(spark, root, ["."], ["_SUCCESS"]).where("valid and not path like '%.crc'")
    found = found.withColumn("folder", F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    return found.groupBy("folder").agg(F.sum(F.octet_length("source").cast("long")).alias("bytes"), F.sum(F.length("source").cast("long")).alias("chars"))


@query(f"WITH {FILES_SQL} SELECT path, CASE WHEN path LIKE '%.py' THEN '.py' WHEN lower(path) LIKE '%.d.ts' THEN '.d.ts' WHEN path LIKE '%.ts' THEN '.ts' END AS suffix FROM f")
def parser_selection(spark, d):
    return rows.longest_suffix(d_files(spark, d).select("path"), spark.createDataFrame([(".py",), (".ts",), (".d.ts",)], "suffix string"))


@query(f"WITH {FILES_SQL} SELECT doc_id, replace(regexp_replace(regexp_replace(path, '\\.py$', ''), '/__init__$', ''), '/', '.') AS module FROM f WHERE path LIKE '%.py'")
def module_names(spark, d):
    return d_files(spark, d).where(F.col("path").endswith(".py")).select("doc_id", text.module("path").alias("module"))


@query("""SELECT event_id, '{"k": ' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS payload, sha256('{"k": ' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}') AS content_hash FROM events""")
def canonical_payload(spark, d):
    return table(spark, d, "events").select("event_id", text.canonical("props").alias("payload")).withColumn("content_hash", F.sha2("payload", 256))


@query("SELECT doc_id AS mapping_id, unnest([doc_id, doc_id * 2 + quality]) AS evidence_id FROM labels")
def mapping_evidence(spark, d):
    return rows.evidence_links(table(spark, d, "labels").select(F.col("doc_id").alias("mapping_id"), F.array(F.col("doc_id"), F.col("doc_id") * 2 + F.col("quality")).alias("evidence_refs")))


@query("""WITH m AS (SELECT doc_id AS mapping_id, doc_id % 3 AS version, CASE quality WHEN 1 THEN 'candidate' ELSE 'stale' END AS status FROM labels),
r AS (SELECT doc_id AS mapping_id, doc_id % 2 AS expected_version, CASE toxic WHEN 0 THEN 'confirmed' ELSE 'rejected' END AS decision FROM labels),
j AS (SELECT *, version = expected_version AND (status <> 'stale' OR decision <> 'confirmed') AS accepted FROM r JOIN m USING (mapping_id))
SELECT mapping_id, accepted, CASE WHEN accepted THEN decision ELSE status END AS status, version + CAST(accepted AS INT) AS version FROM j""")
def confirm_mappings(spark, d):
    labels = table(spark, d, "labels")
    mappings = labels.select(F.col("doc_id").alias("mapping_id"), (F.col("doc_id") % 3).alias("version"), F.when(F.col("quality") == 1, "candidate").otherwise("stale").alias("status"))
    requests = labels.select(F.col("doc_id").alias("mapping_id"), (F.col("doc_id") % 2).alias("expected_version"), F.when(F.col("toxic") == 0, "confirmed").otherwise("rejected").alias("decision"))
    return rows.confirmed(mappings, requests)


@query(f"WITH {GOLDEN_SQL} SELECT l_orderkey, len(expected) AS n_expected, len(actual) AS n_actual FROM g WHERE expected <> actual")
def failure_cases(spark, d):
    return evaluate.judged(golden(spark, d)).where("not passed").select("l_orderkey", F.size("expected").cast("long").alias("n_expected"), F.size("actual").cast("long").alias("n_actual"))


@query(f"""WITH {G_SQL}, b AS (SELECT kind, '---' || chr(10) || '{{"kind": "' || kind || '"}}' || chr(10) || '---' || chr(10) || chr(10) || string_agg('- ' || node_id || ' ' || name, chr(10) ORDER BY node_id) || chr(10) AS content FROM g_nodes GROUP BY kind)
SELECT 'technical:' || kind || ':1' AS document_id, content, sha256(content) AS content_hash FROM b""")
def document_artifacts(spark, d):
    body = rows.document(g_nodes(spark, d), ["kind"], F.concat(F.lit("- "), F.col("node_id").cast("string"), F.lit(" "), "name"), "node_id")
    content = F.concat_ws("\n", F.lit("---"), F.concat(F.lit('{"kind": "'), "kind", F.lit('"}')), F.lit("---"), F.lit(""), "body", F.lit(""))
    return body.select(F.concat_ws(":", F.lit("technical"), "kind", F.lit("1")).alias("document_id"), content.alias("content")).withColumn("content_hash", F.sha2("content", 256))


@query("SELECT event_id FROM events WHERE user_id + 300 < 305")
def expired_tokens(spark, d):
    return rows.expired(table(spark, d, "events").select("event_id", (F.col("user_id") + 300).alias("expires_at")), 305).select("event_id")


@query("SELECT DISTINCT p_brand AS skill, p_type AS tool FROM part WHERE p_size < 10 AND (p_brand, p_type) NOT IN (SELECT p_brand, p_type FROM part WHERE p_size > 40)")
def undeclared_tools(spark, d):
    part = table(spark, d, "part").select(F.col("p_brand").alias("skill"), F.col("p_type").alias("tool"), "p_size")
    return rows.undeclared(part.where("p_size < 10"), part.where("p_size > 40").select("skill", "tool"))


@query(f"WITH {G_SQL} SELECT node_id FROM g_nodes WHERE canonical_key IN ('nation:' || (SELECT min(n_name) FROM nation), 'region:AFRICA') AND file_path LIKE 'nation/%'")
def node_scope(spark, d):
    first = table(spark, d, "nation").agg(F.min("n_name")).first()[0]
    return graph.in_scope(g_nodes(spark, d), [f"nation:{first}", "region:AFRICA"], [f"nation/{first}.py"])


@query(f"WITH {G_SQL} SELECT node_id, canonical_key, file_path FROM g_nodes WHERE kind IN ('nation', 'region')")
def node_lookup(spark, d):
    """The nodes of all nations and regions from a table of nodes that is clustered by key."""
    at = f"{graph.shared_folder(spark)}/nodes-{uuid.uuid4().hex}"
    nodes = g_nodes(spark, d).select("node_id", "canonical_key", "file_path")
    lookups.write(nodes, f"{at}/nodes", f"{at}/ranges", "canonical_key", 16)
    ranges = spark.read.schema(lookups.ranges_of("string")).parquet(f"{at}/ranges")
    stored = lookups.Clustered(spark, f"{at}/nodes", ranges, "canonical_key", "node_id long, canonical_key string, file_path string", [])
    names = table(spark, d, "nation").select(F.concat(F.lit("nation:"), "n_name")).union(table(spark, d, "region").select(F.concat(F.lit("region:"), "r_name")))
    return stored.rows([r[0] for r in names.collect()])  # what a caller asks for


@query("SELECT o_orderstatus AS status, max_by(o_orderkey, o_orderkey) AS snapshot_id, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def active_published(spark, d):
    snapshots = table(spark, d, "orders").select(F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderstatus").alias("status"))
    active = rows.latest(snapshots, ["status"], F.col("snapshot_id")).withColumnRenamed("snapshot_id", "active")
    own = active.join(snapshots.select(F.col("snapshot_id").alias("active")), "active").where("status <> 'P'")
    return own.join(snapshots.groupBy("status").agg(F.count("*").alias("n")), "status").select("status", F.col("active").alias("snapshot_id"), "n")


#: a file of each language for each nation (<k>) and its region (<r>), and the edges (type, source, target, line) it is to give, where $ stands for its identity
FILES = {
    "python": ("pkg/n<k>.py", "pkg.n<k>", "import json\nfrom .depot import weigh<r> as scale\n\nclass Cart<k>:\n    def load(self):\n        return scale(str(1))\n\ndef pack():\n    return Cart<k>()\n", """
imports module:$ module:json 1
imports module:$ module:pkg.depot 2
contains module:$ class:$.Cart<k> 4
contains class:$.Cart<k> function:$.Cart<k>.load 5
calls function:$.Cart<k>.load import:pkg.depot.weigh<r> 6
calls function:$.Cart<k>.load unresolved:str 6
contains module:$ function:$.pack 8
calls function:$.pack class:$.Cart<k> 9"""),
    "java": ("src/N<k>.java", "depot.r<r>@src/N<k>.java", """package depot.r<r>;
import java.time.Clock;
/* class Ghost {} */
enum Grade { LOW, HIGH }
interface Weigher { double weigh(Crate c); }
abstract class Shelf {
    protected int slots = count(3);
    abstract void fill();
}
public class Crate<k> extends Shelf implements Weigher, java.io.Closeable {
    Crate<k>() { reset(); }
    public double weigh(Crate c) { return new Scale(c).read() + log("class Fake {}"); }
    void reset() { gauges[slot](); weigh(null); }
}
""", """
imports package:$ import:$.java.time.Clock 2
contains package:$ enum:$.Grade 4
contains package:$ interface:$.Weigher 5
contains interface:$.Weigher method:$.Weigher.weigh 5
contains package:$ class:$.Shelf 6
contains class:$.Shelf method:$.Shelf.fill 8
contains package:$ class:$.Crate<k> 10
extends class:$.Crate<k> class:$.Shelf 10
implements class:$.Crate<k> interface:$.Weigher 10
implements class:$.Crate<k> external:java.io.Closeable 10
contains class:$.Crate<k> method:$.Crate<k>.Crate<k> 11
calls method:$.Crate<k>.Crate<k> method:$.Crate<k>.reset 11
contains class:$.Crate<k> method:$.Crate<k>.weigh 12
calls method:$.Crate<k>.weigh external:Scale 12
calls method:$.Crate<k>.weigh external:read 12
calls method:$.Crate<k>.weigh external:log 12
contains class:$.Crate<k> method:$.Crate<k>.reset 13
calls method:$.Crate<k>.reset unresolved:gauges[slot] 13
calls method:$.Crate<k>.reset method:$.Weigher.weigh 13"""),
    "go": ("cmd/n<k>.go", "r<r>@cmd/n<k>.go", """package r<r>

import "strings"
import (
	t "time"
	_ "embed"
)

type Belt<k> struct { Name string }
type Mover interface { Move(int) error }

func pack(xs []string) (out interface{}, err error) {
	return strings.Join(xs, "func no() {}"), check(err)
}

func (b *Belt<k>) Move(n int) error { pack(nil); return steps[n]() }
""", """
imports package:$ import:$.strings 3
imports package:$ import:$.time 5
imports package:$ import:$.embed 6
contains package:$ struct:$.Belt<k> 9
contains package:$ interface:$.Mover 10
contains package:$ function:$.pack 12
calls function:$.pack external:strings.Join 12
calls function:$.pack external:check 12
contains package:$ method:$.Move 16
calls method:$.Move function:$.pack 16
calls method:$.Move unresolved:steps[n] 16"""),
    "script": ("src/n<k>.ts", "src.n<k>@src/n<k>.ts", """import { weigh as scale<r> } from '../tools/scale';
import Rack from "./rack";
// function ghost() {}
export interface Bin { empty(): boolean; }
export default class Cart<k> extends Rack implements Bin {
  private load = (x) => x;
  empty(): boolean { return scale<r>(this.load(1)); }
  static async fill<T>(xs: T[]) { const put = function inner(x) { place(x); }; lids[0](); put(1); }
}
function drain() { if (ready()) { new Cart<k>().empty(); } }
export async function start() { drain(); }
""", """
imports module:$ import:$.../tools/scale 1
imports module:$ import:$../rack 2
contains module:$ interface:$.Bin 4
contains interface:$.Bin method:$.Bin.empty 4
defines export:$.Bin interface:$.Bin 4
contains module:$ class:$.Cart<k> 5
extends class:$.Cart<k> external:Rack 5
implements class:$.Cart<k> interface:$.Bin 5
defines export:$.Cart<k> class:$.Cart<k> 5
contains class:$.Cart<k> method:$.Cart<k>.empty 7
calls method:$.Cart<k>.empty external:scale<r> 7
calls method:$.Cart<k>.empty external:this.load 7
contains class:$.Cart<k> method:$.Cart<k>.fill 8
calls method:$.Cart<k>.fill unresolved:lids[0] 8
calls method:$.Cart<k>.fill external:put 8
contains class:$.Cart<k> function:$.Cart<k>.inner 8
calls function:$.Cart<k>.inner external:place 8
contains module:$ function:$.drain 10
calls function:$.drain external:ready 10
calls function:$.drain class:$.Cart<k> 10
calls function:$.drain method:$.Bin.empty 10
contains module:$ function:$.start 11
defines export:$.start function:$.start 11
calls function:$.start function:$.drain 11"""),
}


def fill(x: str):
    """A text with a nation's numbers in it."""
    return F.replace(F.replace(F.lit(x), F.lit("<k>"), F.col("n_nationkey").cast("string")), F.lit("<r>"), F.col("n_regionkey").cast("string"))


def filled(x: str, identity: str = "") -> str:
    """SQL of the same, with $ for the identity."""
    return f"replace(replace(replace({x}, '$', '{identity}'), '<k>', CAST(n_nationkey AS VARCHAR)), '<r>', CAST(n_regionkey AS VARCHAR))"


def sources(spark: SparkSession, d: str, languages=tuple(FILES)) -> DataFrame:
    """The files (path, source) of some languages, one of each for each nation."""
    each = F.explode(F.array(*(F.struct(fill(FILES[x][0]).alias("path"), fill(FILES[x][2]).alias("source")) for x in languages)))
    return table(spark, d, "nation").select(each.alias("f")).select("f.path", "f.source")


def extracted(language: str):
    path, identity, _, edges = FILES[language]
    values = ", ".join("('{}', '{}', '{}', {})".format(*line.split()) for line in edges.strip().splitlines())
    sql = f"""SELECT edge_type, {filled("source_key", identity)} AS source_key, {filled("target_key", identity)} AS target_key, {filled(f"'{path}'")} AS path, start_line FROM nation, (VALUES {values}) AS t(edge_type, source_key, target_key, start_line)"""

    def run(spark, d):
        return extract.edges(extract.parsed(sources(spark, d, (language,)))).select("edge_type", "source_key", "target_key", "path", "start_line")

    run.__name__ = f"extract_{language}_graph"
    return query(sql)(run)


for _language in FILES:
    extracted(_language)


def node_rows() -> str:
    """SQL rows (path, identity, kind, key) of the nodes of all files: their own, what they contain and export (by its kind), what they import."""
    own = {"python": "module", "java": "package", "go": "package", "script": "module"}
    rows = []
    for language, (path, identity, _, edges) in FILES.items():
        rows.append((path, identity, own[language], f"{own[language]}:$", 1))
        for kind, source, target, line in map(str.split, edges.strip().splitlines()):
            new = {"contains": target, "defines": source, "imports": target if language != "python" else None}.get(kind)
            if new:
                rows.append((path, identity, new.partition(":")[0], new, line))
    return ", ".join("('{}', '{}', '{}', '{}', {})".format(*r) for r in rows)


@query(f"SELECT {filled('path')} AS path, kind, {filled('replace(k, chr(36), identity)')} AS canonical_key, start_line, kind = 'import' AS is_import FROM nation, (VALUES {node_rows()}) AS t(path, identity, kind, k, start_line)")
def parse_source_nodes(spark, d):
    """The nodes of all files by the table function."""
    extract.register(spark)
    found = spark.sql("SELECT f.path, x.kind, x.canonical_key, x.start_line, get_json_object(x.payload, '$.import') IS NOT NULL AS is_import FROM {files} f, LATERAL parse_source(f.path, f.source, 'nodes') x", files=sources(spark, d))
    return found


class Failing:
    """A user's parser, which fails."""

    parser_id, version, language, suffixes = "zig-none", "1", "zig", (".zig",)

    def parse(self, path: str, source: str):
        raise ValueError(f"cannot read {path}")


@query("""WITH f AS (SELECT unnest([{'p': '.md', 'c': 'UNSUPPORTED_FILE_SUFFIX', 'm': 'no parser for suffix .md'}, {'p': '.py', 'c': 'PYTHON_SYNTAX_ERROR', 'm': NULL}, {'p': '.java', 'c': 'HEURISTIC_PARSE_PARTIAL', 'm': 'unbalanced delimiters; declarations are partial'}, {'p': '.zig', 'c': 'PARSER_ERROR', 'm': 'cannot read b'}]) AS x, n_nationkey FROM nation)
SELECT 'b' || n_nationkey || x.p AS path, x.c AS code, CASE x.p WHEN '.zig' THEN x.m || n_nationkey || x.p ELSE x.m END AS message, CASE x.p WHEN '.py' THEN '1' END AS line, CASE x.p WHEN '.py' THEN 'python-ast' WHEN '.java' THEN 'java-heuristic' WHEN '.zig' THEN 'zig-none' END AS parser_id FROM f""")
def parse_source_diagnostics(spark, d):
    """What goes wrong with broken files, and with a user's own parser, by the table function."""
    broken = {".md": "# x", ".py": "def (:\n", ".java": "class A {", ".zig": "x", ".go": "package good\n"}
    each = F.explode(F.create_map(*(F.lit(x) for kv in broken.items() for x in kv))).alias("suffix", "source")
    files = table(spark, d, "nation").select("n_nationkey", each).select(F.concat(F.lit("b"), F.col("n_nationkey").cast("string"), "suffix").alias("path"), "source")
    registry = extract.Registry.default()
    registry.register(Failing())
    extract.register(spark, "parse_source_of_user", registry)
    found = spark.sql("SELECT f.path, x.code, x.message, get_json_object(x.detail, '$.line') AS line, x.parser_id FROM {files} f, LATERAL parse_source_of_user(f.path, f.source, 'diagnostics') x", files=files)
    return found.withColumn("message", F.when(F.col("code") != "PYTHON_SYNTAX_ERROR", F.col("message")))  # whose words are the interpreter's

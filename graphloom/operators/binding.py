"""Binding of edges to symbols of other files: a symbol binds when exactly one candidate is visible."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import graph

# fixed values: kinds of nodes that a symbol may name
BINDABLE = ("class", "interface", "struct", "function", "method")


def sightings(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, asked, barred): the same ways to see a candidate on both sides, each a value ``at`` of a ``way``.

    Edges: edge_id, edge_type, source_key, target_key, language, symbol, resolution, module, import, import_source,
    imported_symbol, alias.  Nodes: canonical_key, kind, language, name, module_identity, package_identity, path.
    A candidate has the edge's language and symbol.  It is visible from its own package, or through an import of
    the source or of the source's module that names its module, itself, or (relative imports of scripts) its file.
    ``candidates``: way, at, language, symbol, c_key, c_kind.  ``asked``: way, at, language, symbol, edge_id.  ``barred``: edge_id of
    those that a relative import of a script lets see functions only.
    """
    candidate = nodes.where(F.col("kind").isin(*BINDABLE)).select("language", F.col("name").alias("symbol"), F.col("canonical_key").alias("c_key"), F.col("kind").alias("c_kind"), F.col("module_identity").alias("c_module"), F.col("package_identity").alias("c_package"), F.col("path").alias("c_path"))
    source = nodes.select(F.col("canonical_key").alias("source_key"), F.col("module_identity").alias("source_module"), F.col("package_identity").alias("source_package"), F.col("path").alias("source_path"))
    asked = edges.where("symbol is not null").select("edge_id", "source_key", "language", "symbol").join(source, "source_key", "left")
    imports = edges.where("edge_type = 'imports'").select(F.col("source_key").alias("at"), F.col("language").alias("i_language"), F.col("module").alias("i_module"), F.col("import").alias("i_import"), F.col("import_source").alias("i_source"), "imported_symbol", F.coalesce("alias", "imported_symbol").alias("i_alias"))
    places = F.array_distinct(F.array_compact(F.array("source_key", F.concat(F.lit("module:"), "source_module"))))
    seen = asked.select("edge_id", "language", "symbol", "source_path", F.explode(places).alias("at")).join(imports, "at").drop("at")
    relative = F.col("i_language").isin("javascript", "typescript") & F.col("i_source").startswith(".") & F.col("imported_symbol").isNotNull() & (F.col("i_alias") == F.col("symbol"))
    seen = seen.withColumn("relative", F.coalesce(relative, F.lit(False)))
    modules = F.array_distinct(F.array_compact(F.array("i_module", "i_import", F.lit(""))))  # a candidate of no module is seen through any import
    named = F.regexp_replace(F.coalesce("i_module", "i_import"), "^(module:)?(import:)?", "")
    files = seen.where("relative and imported_symbol = symbol and language = i_language")
    ways = {
        "package": (candidate.where("c_package <> ''").withColumn("at", F.col("c_package")), asked.where("source_package <> ''").withColumn("at", F.col("source_package"))),
        "module": (candidate.withColumn("at", F.col("c_module")), seen.withColumn("at", F.explode(modules))),
        "name": (candidate.where("c_package <> ''").withColumn("at", F.concat_ws(".", "c_package", "symbol")), seen.withColumn("at", named)),
        "file": (candidate.where("c_kind = 'function'").withColumn("at", F.col("c_path")), files.withColumn("at", F.explode(text.script_targets_of("source_path", "i_source")))),
    }
    every: list[DataFrame | None] = [None, None]
    for way, sides in ways.items():
        for i, (side, rest) in enumerate(zip(sides, (("c_key", "c_kind"), ("edge_id",)), strict=True)):
            own = side.where("at is not null").select(F.lit(way).alias("way"), "at", "language", "symbol", *rest)
            every[i] = own if every[i] is None else every[i].unionByName(own)
    return every[0], every[1].distinct(), seen.where("relative").select("edge_id").distinct()


WAY = ["way", "at", "language", "symbol"]


def visible_candidates(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(edge_id, target_key): each candidate that an edge with a symbol may see (``sightings``)."""
    candidates, asked, barred = sightings(edges, nodes)
    found = asked.join(candidates, WAY).select("edge_id", "c_key", "c_kind").distinct()
    barred = barred.select("edge_id", F.explode(F.array(*(F.lit(k) for k in BINDABLE if k != "function"))).alias("c_kind"))  # a relative import of a script names functions only
    return found.join(barred, ["edge_id", "c_kind"], "left_anti").select("edge_id", F.col("c_key").alias("target_key"))


def only_candidates(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(edge_id, target_key) of the edges that see exactly one candidate.

    A set of candidates is kept as its least and its greatest key, which tell none, one and several apart and are put
    together by least and greatest.  So the candidates of a way are one row before an edge meets them, however many there
    are, and what an edge sees in several ways is put together by the edge.  Edges that ask the same meet a way's row in
    ``SALTS`` tasks.
    """
    candidates, asked, barred = sightings(edges, nodes)
    bounds = lambda least, most, only="": [F.min(least).alias(f"least{only}"), F.max(most).alias(f"most{only}")]
    function = F.when(F.col("c_kind") == "function", F.col("c_key"))
    known = candidates.groupBy(F.struct(*WAY).alias("seen")).agg(*bounds("c_key", "c_key"), *bounds(function, function, "_function"))
    met = graph.salted(asked.select("edge_id", F.struct(*WAY).alias("seen")), known, "seen")
    found = met.groupBy("edge_id").agg(*bounds("least", "most"), *bounds("least_function", "most_function", "_function"))
    found = found.join(barred.withColumn("barred", F.lit(True)), "edge_id", "left")
    own = lambda end: F.when(F.col("barred"), F.col(f"{end}_function")).otherwise(F.col(end))
    return found.where(own("least") == own("most")).select("edge_id", own("least").alias("target_key"))


def bind(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` with target_key, resolution and bound set where exactly one candidate is visible and the edge is open:
    external or unresolved, or static to an import."""
    one = only_candidates(edges, nodes).withColumnRenamed("target_key", "__key")
    open_ = F.col("resolution").isin("external", "unresolved") | ((F.col("resolution") == "static") & F.col("target_key").startswith("import:"))
    out = edges.join(one, "edge_id", "left").withColumn("bound", F.coalesce(open_ & F.col("__key").isNotNull(), F.lit(False)))
    return out.withColumn("target_key", F.when(F.col("bound"), F.col("__key")).otherwise(F.col("target_key"))).withColumn("resolution", F.when(F.col("bound"), F.lit("static")).otherwise(F.col("resolution"))).drop("__key")

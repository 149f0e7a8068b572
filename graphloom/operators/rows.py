"""Set-based forms of the store's row operations: gates, upserts, differences, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, n) of keys that occur more than once; null keys don't count."""
    present = F.lit(True)
    for k in keys:
        present = present & F.col(k).isNotNull()
    return rows.where(present).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def revision_mismatches(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows whose (source_revision, index_revision, config_version) differ from those of ``expected`` (one row a snapshot_id)."""
    triple = ("source_revision", "index_revision", "config_version")
    own = expected.select("snapshot_id", *(F.col(c).alias(f"__{c}") for c in triple))
    differs = F.lit(False)
    for c in triple:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.join(own, "snapshot_id").where(differs).drop(*(f"__{c}" for c in triple))


def latest(rows: DataFrame, keys: list[str], order: Column | str) -> DataFrame:
    """One row for each key: the last by ``order`` (an upsert's outcome). Combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("last"))
    return best.select(*keys, *(F.col(f"last.{c}").alias(c) for c in rest)).select(*rows.columns)


def swapped(pointer: DataFrame, requests: DataFrame) -> DataFrame:
    """Outcome of compare-and-swap requests (request_id, expected_parent, snapshot_id) against one pointer row (active):
    with no active row any parent is accepted, else it must be equal, null included."""
    active = pointer.agg(F.max("active").alias("active"), F.count("*").alias("rows"), F.lit(1).alias("one"))
    ok = (F.col("rows") == 0) | F.col("active").eqNullSafe(F.col("expected_parent"))
    return requests.withColumn("one", F.lit(1)).join(F.broadcast(active), "one").select("request_id", ok.alias("accepted"), F.when(ok, F.col("snapshot_id")).otherwise(F.col("active")).alias("active"))


def differences(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, side): keys of one side alone, ``missing`` or ``unexpected``."""
    a, b = expected.select(key).distinct(), actual.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).union(b.join(a, key, "left_anti").withColumn("side", F.lit("unexpected")))


def keyless(rows: DataFrame, key: Column | str, gated: Column | str | None = None) -> DataFrame:
    """(missing, n): how many rows that a gate is for have no key, of how many."""
    of = F.lit(True) if gated is None else F.coalesce(gated, F.lit(False))
    key = F.col(key) if isinstance(key, str) else key
    return rows.agg(F.count_if(of & key.isNull()).alias("missing"), F.count_if(of).alias("n"))


def coverage(files: DataFrame, by: Column | str = "language") -> DataFrame:
    """(by, files, supported, parsed): ``files`` has booleans supported and failed."""
    return files.groupBy(by).agg(F.count("*").alias("files"), F.count_if("supported").alias("supported"), F.count_if(F.col("supported") & ~F.col("failed")).alias("parsed"))


def diagnostic_counts(diagnostics: DataFrame) -> DataFrame:
    """(total, unsupported, parse_errors) of diagnostics, of which ``supported`` says whether their file has a parser."""
    return diagnostics.agg(F.count("*").alias("total"), F.count_if(~F.col("supported")).alias("unsupported"), F.count_if("supported").alias("parse_errors"))


def resolved(routes: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, candidates, status) of exact term matches: not_found, selected, or needs_user_selection."""
    n = routes.groupBy("term").agg(F.count("*").alias("n"))
    out = queries.join(n, queries["query"] == n["term"], "left").withColumn("candidates", F.coalesce("n", F.lit(0)))
    status = F.when(F.col("candidates") == 0, "not_found").when(F.col("candidates") == 1, "selected").otherwise("needs_user_selection")
    return out.select("query", F.col("candidates").cast("long").alias("candidates"), status.alias("status"))


def document(rows: DataFrame, keys: list[str], line: Column, order: str, cites: Column | str | None = None) -> DataFrame:
    """(keys, body, refs): the lines of each key in order, joined by newlines, and the distinct ids that ``cites`` has, in order.

    Without keys it is one document, of no lines if there are no rows.
    """
    cites = F.lit(None).cast("long") if cites is None else cites
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))).alias("x")
    made = rows.groupBy(*keys).agg(lines, F.array_sort(F.collect_set(cites)).alias("refs"))
    return made.select(*keys, F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("body"), "refs")


def confirmed(mappings: DataFrame, requests: DataFrame) -> DataFrame:
    """Outcome of decisions (mapping_id, expected_version, decision) on mappings (mapping_id, version, status): accepted when
    the version is as expected and no stale mapping is to be confirmed; then the decision is the status, one version on."""
    out = requests.join(mappings, "mapping_id", "left")
    ok = F.coalesce((F.col("version") == F.col("expected_version")) & ((F.col("status") != "stale") | (F.col("decision") != "confirmed")) & F.col("decision").isin("confirmed", "rejected"), F.lit(False))
    return out.select("mapping_id", ok.alias("accepted"), F.when(ok, F.col("decision")).otherwise(F.col("status")).alias("status"), F.when(ok, F.col("version") + 1).otherwise(F.col("version")).alias("version"))


def evidence_links(mappings: DataFrame) -> DataFrame:
    """(mapping_id, evidence_id): one row for each evidence reference."""
    return mappings.select("mapping_id", F.explode("evidence_refs").alias("evidence_id"))


def longest_suffix(paths: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(path, and the columns of ``suffixes``) of the longest suffix that a path's name ends with, in any case; null if none does.

    A suffix begins at a dot, so a name's candidates are what begins at its dots, and the longest known is an equal join.
    """
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    parts = F.split(name, r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.lit("."), F.array_join(F.slice(parts, i + 1, F.size(parts)), ".")))
    each = paths.where(F.size(parts) > 1).select("path", F.explode(ends).alias("suffix"))
    rest = [c for c in suffixes.columns if c != "suffix"]
    best = each.join(F.broadcast(suffixes), "suffix").groupBy("path").agg(F.max_by(F.struct("suffix", *rest), F.length("suffix")).alias("best"))  # parsers' suffixes are a fixed few
    return paths.join(best, "path", "left").select("path", *(F.col(f"best.{c}").alias(c) for c in ("suffix", *rest)))


def expired(tokens: DataFrame, now: int) -> DataFrame:
    """Tokens past their expiry; at the very second they still hold."""
    return tokens.where(F.col("expires_at") < now)


def undeclared(declared: DataFrame, allowed: DataFrame) -> DataFrame:
    """(skill, tool) declared but not allowed."""
    return declared.select("skill", "tool").distinct().join(allowed, ["skill", "tool"], "left_anti")

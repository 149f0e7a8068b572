"""The change feed as a stream: name-status lines in, affected nodes of a snapshot out.

An extension: the batch feed is in ``sources.changes``.  The snapshot's nodes are a static side, so the join keeps no
state; each micro-batch is judged by itself.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources import changes


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the files that arrive in a folder."""
    return spark.readStream.text(folder)


def commits(spark: SparkSession, root: str, base: str, ref: str = "HEAD", scope: list[str] = ()) -> DataFrame:
    """Lines of the changes of a work tree from ``base`` on, a batch whenever ``ref`` has moved (``sources.changes``)."""
    changes.register(spark)
    return spark.readStream.format(changes.NAME).option("base", base).option("ref", ref).option("scope", json.dumps(list(scope))).load(root)


def affected(feed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, path, status) of nodes whose file a line names, as it is or as it was."""
    named = changes.parsed(feed).select("status", F.explode(F.array_compact(F.array("path", "old_path"))).alias("path"))
    named = named.withColumn("path", text.slashes(F.col("path")))
    own = nodes.select("node_id", text.slashes(F.col("file_path")).alias("path"))
    return named.join(own, "path").select("node_id", "path", "status")

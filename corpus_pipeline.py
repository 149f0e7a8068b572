"""The corpus pipeline: five stages from ``documents`` to packed sequences.

Each stage works on all that its predecessor kept.  A stage's result is written and read again before the next.

1. ``language``: documents of no learned language go: those without a letter (null and empty texts among them), and
   those of whose letter n-grams the best language holds under ``LEAST_SHARE`` of what it holds of its own labelled
   documents' (their median).  A document is judged by what the other ``FOLDS`` - 1 parts of the documents teach, by crc32 of its
   id, so its own label doesn't let it in; nothing is known of a language that no other part has labelled.
2. ``lines``: runs of lines that some document has had before go; documents stay.
3. ``near``: one document of each group of near duplicates stays, that of least id.
4. ``substrings``: words covered by a run of 35 words that occurs elsewhere too go; documents stay.
5. ``pack``: the rest is packed into sequences.

A document whose text a stage empties stays, with an empty text; null texts stay out after stage 1.  Null ids, languages and
sources are values like any other.  Rows that repeat id and text are documents each until stage 3, where one stays.  Of
equal candidates the least id, then the least key of id and text is first.  Texts of any length are read whole; stage 5
cuts documents over sequences.  Of an empty table every stage is empty.  Columns that ``documents`` doesn't have are left
out, so none can clash.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import ship
from graphloom.llm import common, langid, linechunks, lshforest, packing, substrings

LEAST_SHARE = 0.5
FOLDS = 2
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def shaped(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``, with n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    fold = F.coalesce(common.remainder("doc_id", FOLDS), F.lit(0))
    found = common.stored(langid.identify(docs, keep=COLUMNS, stored=False, fold=fold).where(F.col("lang_pred") != langid.UNDETERMINED))
    usual = found.where("lang = lang_pred").groupBy("lang_pred").agg(F.percentile_approx("score", 0.5).alias("usual"))
    found = found.join(F.broadcast(usual), "lang_pred", "left")  # a row for each learned language
    return shaped(found.where(F.col("score") >= LEAST_SHARE * F.coalesce("usual", F.lit(1.0))))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return shaped(linechunks.dedup(docs, keep=COLUMNS))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return shaped(lshforest.kept(docs))


def substrings_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    cut = substrings.dedup(docs, keep=COLUMNS, stored=False)
    return shaped(cut.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("lines", lines),
    ("near", near),
    ("substrings", substrings_),
    ("pack", pack),
]
#: None: rolling hashes, MinHash and a tokenizer are beyond SQL; the stages are tested against brute force
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

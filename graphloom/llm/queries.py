"""The queries of this subpackage, each over its whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, common, kneser_ney, langid, linechunks, lshforest, mih, packing, ppm, rules, segment, spelling, substrings, whiten
from .oracles import ORACLES

table = common.table


def op1_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", common.is_remainder("doc_id", 4, 2))
    return langid.identify(docs, learn=~F.col("held_out"), keep=("doc_id", "held_out"), stored=False)


def op2_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return segment.sample(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_partial_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", common.is_remainder("doc_id", 5, 1))
    return ppm.score(docs, ~F.col("held_out"), keep=("doc_id", "held_out"), stored=False)


def op4_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = common.checkpointed(rules.features(table(spark, sf_dir, "documents")))
    return rules.judged(counted).select("doc_id", *rules.COUNTS, "base_failed", "kept")


def op5_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mih.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    scored = kneser_ney.perplexities(table(spark, sf_dir, "documents"), labels.where("quality = 1 and toxic = 0"), keep=("doc_id", "lang"), stored=False)
    return kneser_ney.judged(common.checkpointed(scored)).select("doc_id", "is_trusted", "n_bytes", "perplexity", "threshold", "kept")


def op7_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linechunks.dedup(table(spark, sf_dir, "documents"), keep=("doc_id",))
    return out.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op8_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.dedup(table(spark, sf_dir, "documents"), stored=False)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op10_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lshforest.groups(table(spark, sf_dir, "documents")).drop("__row")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_block_lanczos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings"))


def op13_relational_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    kinds = {f.name: f.dataType for f in rows.schema}
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    own = {"conv_id": F.lit(-7), "turn": F.col("id"), "role": role, "text": F.lit(r"\### Assistant: </turn> ok")}
    rows = rows.unionByName(spark.range(2).select(*(c.cast(kinds[n]).alias(n) for n, c in own.items())))
    found, said = chat.read(chat.formatted(rows)), lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))
    turns, learned = chat.glued(F.transform("turns", said)), chat.glued(F.col("learned"))
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    found = found.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest(turns).alias("turns_sha256"), learned.alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))
    return found.select("conv_id", "n_turns", "turns_sha256", F.length("learned").cast("long").alias("loss_chars"), digest(F.col("learned")).alias("loss_sha256"), "formatted_chars")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_bitmask, op2_gumbel_segmentations, op3_partial_matching, op4_adaptive_rules, op5_multi_index, op6_kneser_ney, op7_line_chunks, op8_cost_balanced_packing, op9_repeated_windows, op10_lsh_forest, op11_spelling_variants, op12_block_lanczos, op13_relational_chat)
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

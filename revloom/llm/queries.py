"""Registered queries over training data: one per operator, and the pipeline."""

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

import corpus_pipeline
from revloom.catalog.registry import Query
from revloom.llm import (chat, decontaminate, html_text, licenses, mixing, ngram_join, packing, quality, repair,
                         secrets, vector_index, warc, whitening)
from revloom.plans.runtime import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_main_text(spark, sf_dir):
    return html_text.main_text(_table(spark, sf_dir, "pages"))


def op2_secret_scan(spark, sf_dir):
    return secrets.secret_spans(_table(spark, sf_dir, "documents"))


def op3_decontamination(spark, sf_dir):
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_chat_format(spark, sf_dir):
    """Every conversation is a tree whose rows reply to the row before, by turn; one more, -7, holds control strings.

    Rows with equal or null turns (these first) stand next to each other, by role and text; none is left out.
    """
    told = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    rows = told.unionByName(extra)
    messages = rows.withColumn("id", F.row_number().over(
        W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")).select(
        F.col("conv_id").alias("tree"), "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"),
        "role", "text", F.lit(0.0).alias("score"))
    read = chat.read_back(chat.formatted_conversations(messages))
    return read.select(F.col("tree").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                       "formatted_chars")


def op5_license_scan(spark, sf_dir):
    return licenses.licences(_table(spark, sf_dir, "documents"))


def op6_warc_archive(spark, sf_dir):
    path = scratch_path(spark, "warc")
    warc.write_pages(_table(spark, sf_dir, "pages"), path)
    return warc.read_pages(spark, path)


def op7_multi_index_search(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    return vector_index.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


def op8_pfair_mixing(spark, sf_dir):
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op9_compression_quality(spark, sf_dir):
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark, sf_dir):
    return whitening.whiten(_table(spark, sf_dir, "embeddings")).withColumn(
        "deviation", F.expr("try_cast(deviation as long)"))


def op12_bin_slack_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark, sf_dir):
    told = _table(spark, sf_dir, "conversations")
    return repair.repair_report(repair.damaged(told), told)


def llm_queries() -> dict[str, Query]:
    runs = {
        "op1_main_text": op1_main_text, "op4_chat_format": op4_chat_format, "op5_license_scan": op5_license_scan,
        "op6_warc_archive": op6_warc_archive, "op7_multi_index_search": op7_multi_index_search,
        "op2_secret_scan": op2_secret_scan, "op3_decontamination": op3_decontamination,
        "op8_pfair_mixing": op8_pfair_mixing, "op9_compression_quality": op9_compression_quality,
        "op10_ngram_jaccard_join": op10_ngram_jaccard_join, "op11_embedding_whitening": op11_embedding_whitening,
        "op12_bin_slack_packing": op12_bin_slack_packing, "op13_conversation_repair": op13_conversation_repair,
        "pipeline": corpus_pipeline.run}
    sql = {"op5_license_scan": licenses.licences_sql()}
    return {key: Query(run, sql.get(key)) for key, run in runs.items()}

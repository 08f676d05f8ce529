"""From raw documents to a mixed training order, in five stages over written tables.

1. ``quality``: the compression classifier, learnt from ``labels``, drops what it rejects.
2. ``near_duplicates``: of every group of linked documents (five-word shingles, Jaccard 0.75) the one with
   the least doc_id stays.
3. ``decontamination``: documents that hold a test item go.
4. ``secrets``: spans are replaced by marks; every document stays.
5. ``mixing``: every document gets its place in an order that follows the target weights.

Rows without doc_id pass stages 2 and 3, which name documents by id. Extra columns are carried by the first
four stages; the last returns the order of ids.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from revloom.llm import decontaminate, mixing, ngram_join, quality, secrets
from revloom.plans.runtime import scratch_path


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, _read(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = ngram_join.ngram_components(docs)
    copies = groups.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(copies, "doc_id", "left_anti").select(*docs.columns)
    # rows that share an id are one document
    named = kept.filter(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    return named.unionByName(docs.filter(F.col("doc_id").isNull()))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, _read(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage),
          ("decontamination", decontamination_stage), ("secrets", secret_stage), ("mixing", mixing_stage)]

# a trained classifier and an alignment: beyond SQL; tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = _read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

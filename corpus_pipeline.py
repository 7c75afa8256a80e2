"""Corpus pipeline: the documents table through toxicity, near-dedup, decontamination, secrets, pieces.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last
return the columns of ``documents``. Rows with a null id are kept by the stages that judge by id.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoframe.llm import decontaminate, near, pieces, secrets, toxicity
from chronoframe.llm.common import Scratch, give_back


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that ordinal regression grades 0."""
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts that share 0.8 of their 5-word shingles the row with the smallest id, and
    one of the rows without an id. Rows are told apart by id and text, so unlike texts may share an id."""
    key = F.struct(F.col("doc_id").isNull().alias("gone"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    keyed = docs.withColumn("_key", key)
    found = Scratch(spark, "stage").table(near.components(keyed, "_key"))
    null_ids = found.where("key.gone").groupBy("component").agg(F.min("key").alias("key")).select("key")
    kept = found.where("key = component").select("key").unionByName(null_ids).distinct()
    once = Window.partitionBy("_key").orderBy(F.xxhash64(*docs.columns))
    # keys are structs, never null, and null fields of two are equal: by "=" one shuffle serves join and window
    rows = keyed.join(kept, F.col("_key") == F.col("key"), "left_semi")
    return rows.withColumn("_n", F.row_number().over(once)).where("_n = 1").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, live-looking secrets cut out of their texts and n_chars counted again."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their text's best segmentation and what the n best are like. Workers that ran earlier
    stages stay alive beside the ones at work here, so each keeps few chunks and none between tasks."""
    return pieces.digest(docs, carry=("lang", "source", "n_chars"), cache=100_000, keep=False)


def _lean(stage):
    """``stage`` begun on executors that hold nothing of the stages before."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("toxicity", _lean(drop_toxic)),
    ("near_dedup", _lean(drop_near_duplicates)),
    ("decontaminate", _lean(drop_contaminated)),
    ("secrets", _lean(redact_secrets)),
    ("pieces", _lean(encode_pieces)),
]

#: SQL cannot express the fitted and hashed stages; tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written once and read by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

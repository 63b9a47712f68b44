"""The corpus pipeline: five stages from raw documents to ids for training.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. Stages return the columns of
documents, the last one doc_id, n_tokens, ids_sha256, decoded_sha256 and round_trip. Columns that are missing in the
input stay missing; further ones are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrolith.llm.common import small_batches, written
from ferrolith.llm.exact_dedup import exact_dedup
from ferrolith.llm.mixing import mix_sources
from ferrolith.llm.near_dedup import representatives
from ferrolith.llm.pieces import coded
from ferrolith.llm.toxicity import fit_toxicity, score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the factorization machine rejects; it learns from the labels of the data set.

    Null and empty texts are scored as texts without terms, repeated rows alike, long texts whole. Without labels
    nothing is rejected; an empty table stays empty; rows without an id are scored like all others.
    """
    small_batches(spark)
    machine = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, machine).where("predicted = 0").select(*_columns(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts: the longest, of these the one with the smallest id.

    Null and empty texts are one group; null ids come last; of repeated rows one stays; an empty table stays empty.
    """
    return exact_dedup(docs).where("kept").select(*_columns(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of linked fingerprints, the one with the smallest id.

    Rows are decided one by one: rows that share an id can stay apart or be one. Null ids come last; null and empty
    texts are one group; of repeated rows one stays; an empty table stays empty; long texts are read whole.
    """
    small_batches(spark)
    return representatives(docs).select(*_columns(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits each document as often as the mix takes it, up to three times; each copy is a row.

    Null and empty texts have size 0 but are emitted by the same rule; the null source is a source; repeated rows are
    counted one by one; an empty table stays empty; long texts are taken or left whole.
    """
    mixed = mix_sources(docs).where("copies > 0")
    return mixed.select(*_columns(docs), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy")).drop("__copy")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every emitted document and decodes it again.

    Null and empty texts have no ids; repeated rows get equal results; long texts are encoded in chunks; an empty
    table gives an empty result.
    """
    small_batches(spark)
    return coded(docs)


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("SimHash near-dedup", near), ("mixing", mixing), ("SentencePiece", encoding)]

#: A learned model, fingerprints and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name.replace(' ', '-')}")
    return docs

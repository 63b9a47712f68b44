"""Exact deduplication by a tree merge of sorted digest runs, in DataFrame operations only."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, Carried, partitions, text_of, written

RESULT = ["keep_id", "group_size", "kept", "text_sha256"]


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8, keep: list[str] | None = None) -> DataFrame:
    """Adds keep_id, group_size, kept and text_sha256 to every row.

    Two texts are equal when they are the same after all separators are deleted. Of equal texts the one with the
    most code points stays, then the smallest id.

    Rows are dealt to fan_in ** k runs by a hash of their id. Each run is sorted by digest and reduced to one entry
    per digest; then fan_in neighbouring runs merge into one, k times, and every merge keeps the smallest verified
    identifier. The verdict goes back down the same tree, so even a digest that a third of all rows share is only
    ever met once per run: no task gets more of it than its run holds. The texts are read once: their digests are
    written beside the columns named in keep (all: None), and the tree works on numbered digests alone.

    Defined cases: a null text counts as empty, and all empty texts form one group. A null id ranks after all
    others. Of rows that repeat id and text exactly one is kept. An empty table gives an empty result. Input
    columns named like a result column are replaced by it. If two texts shared a SHA-256 but not a second hash,
    the job fails rather than merge them.
    """
    n = partitions(df.sparkSession)
    rounds = max(1, math.ceil(math.log(max(n, 2), fan_in)))
    carried = Carried(df.select(*(df.columns if keep is None else keep)))
    text = text_of(text_col)
    bare = reduce(lambda t, c: F.replace(t, F.lit(c)), SPACES, text)
    rows = df.select(
        *carried.hide(df),
        F.col(id_col).alias("__id"),
        (-F.length(text)).alias("__shortness"),
        F.unhex(F.sha2(bare, 256)).alias("__digest"),
        F.xxhash64(bare).alias("__check"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(fan_in**rounds)).alias("__run"),
        F.monotonically_increasing_id().alias("__row"),
    )
    rows = written(rows, "exact-digests")
    leaf = (
        rows.select("__row", "__id", "__shortness", "__digest", "__check", "__run")
        .repartition(n, "__run", "__digest")
        .withColumn("__best", F.struct("__shortness", F.col("__id").isNull().alias("none"), F.col("__id").alias("id")))
    )
    run = Window.partitionBy("__run", "__digest")
    leaf = leaf.withColumn("__place", F.row_number().over(run.orderBy("__best"))).withColumn("__n", F.count(F.lit(1)).over(run))

    first = leaf.where("__place = 1").select("__run", "__digest", "__best", "__n", F.col("__check").alias("__low"), F.col("__check").alias("__high"))
    merged = first
    for _ in range(rounds):
        merged = (
            merged.withColumn("__run", F.floor(F.col("__run") / fan_in))
            .groupBy("__run", "__digest")
            .agg(F.min("__best").alias("__best"), F.sum("__n").alias("__n"), F.min("__low").alias("__low"), F.max("__high").alias("__high"))
        )
    verdict = merged.select(
        "__digest",
        F.when(F.col("__low") == F.col("__high"), F.col("__best"))
        .otherwise(F.raise_error(F.lit("texts with one SHA-256 differ in a second hash")))
        .alias("__winner"),
        F.col("__n").alias("group_size"),
    )
    down = first.select("__run", "__digest").join(verdict, "__digest")
    judged = leaf.join(down, ["__run", "__digest"]).select(
        "__row", F.col("__winner.id").alias("keep_id"), "group_size", ((F.col("__place") == 1) & (F.col("__best") == F.col("__winner"))).alias("kept")
    )
    out = rows.select(*carried.private, "__row", "__digest").join(judged, "__row")
    return out.select(*carried.show(RESULT), "keep_id", "group_size", "kept", F.lower(F.hex("__digest")).alias("text_sha256"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs, keep=["doc_id"])


OP1_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place
  FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ASC NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r
"""

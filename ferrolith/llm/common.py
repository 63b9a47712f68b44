"""What the text operators share: column carrying, whitespace rules and durable intermediate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrolith.operators.graph import durable as written

__all__ = ["Carried", "SPACES", "WORD", "partitions", "running", "small_batches", "text_of", "words_of", "written"]

#: Fixed value: the characters that separate words, U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
#: The same set as a regular expression for one word.
WORD = r"[^\x20\x09-\x0D]+"


def text_of(column: str) -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """All maximal runs without a separator, as array<string>."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


class Carried:
    """Moves all columns of a frame under private names, so that none can clash with an operator's own."""

    def __init__(self, df: DataFrame):
        self.names = list(df.columns)
        self.private = [f"__c{i}" for i in range(len(self.names))]

    def hide(self, df: DataFrame) -> list[Column]:
        return [df[f"`{n}`"].alias(p) for n, p in zip(self.names, self.private)]

    def show(self, result: list[str] | None = None) -> list[Column]:
        """The original columns, without those that a column named in result replaces."""
        taken = {n.lower() for n in result or []}
        return [F.col(p).alias(n) for n, p in zip(self.names, self.private) if n.lower() not in taken]

    def __getitem__(self, name: str) -> str:
        return self.private[self.names.index(name)]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds the sums of columns over all rows before a row, in an order over the whole table.

    Rows are dealt to partitions by range and written; only the sums of whole partitions are added up in one place,
    so no task sees more than its part. The order must tell all rows apart.
    """
    n = partitions(df.sparkSession)
    dealt = written(df.select("*", *(c.alias(f"__of_{k}") for k, c in sums.items())).repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "running")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    mine = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("__part").agg(*(F.sum(f"__of_{k}").alias(f"__of_{k}") for k in sums))
    starts = totals.select("__part", *(F.coalesce(F.sum(f"__of_{k}").over(before), F.lit(0)).alias(f"__from_{k}") for k in sums))
    rows = dealt.join(F.broadcast(starts), "__part")
    return rows.select(*df.columns, *((F.coalesce(F.sum(f"__of_{k}").over(mine), F.lit(0)) + F.col(f"__from_{k}")).alias(k) for k in sums))


#: Rows that a task gives to Python at a time; a row can be a long document and its ids.
ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Bounds the memory of Python workers: fewer rows a batch, for the rest of the session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, str(min(ROWS, int(spark.conf.get(key)) if int(spark.conf.get(key)) > 0 else ROWS)))
